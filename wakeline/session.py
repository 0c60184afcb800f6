"""Session helpers: scratch space for cut lineage, and a local session for tests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: How tables in the shared folder are packed: digests and keys are most of them.
COMPRESSION = "zstd"


def local_session(cpus: int | str = "*", memory: str = "8g", app: str = "wakeline") -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Instants compare in UTC, whatever zone the session was started with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: what ``spark.checkpoint.dir`` names, else the checkpoint folder its owner set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """
    Write `df` once to the shared folder and read it back: the plan behind it
    is cut, and the rows outlive any executor. The row count rides along with
    the write, so no second pass is made for it.
    """
    log = RoundLog(df.sparkSession, label)
    return log.add(df)


#: Rows of a loop's round that may go to every executor by way of the driver, at some 100 bytes each.
SENT = 1 << 17


def grown(df: DataFrame) -> DataFrame:
    """
    A side of a join of which both sides grow with the tables: they are
    shuffled and sorted. Before it runs, Spark takes a table for as large as
    its packed files, which may be a fiftieth of its rows, and would send all
    of them to every executor by way of the driver.
    """
    return df.hint("merge")


def sent(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has at most `rows` rows: they are sent while they are few, and shuffled beyond that."""
    return F.broadcast(df) if rows <= SENT else grown(df)


class RoundLog:
    """
    The rows a loop has found so far, one written table per round. `add`
    writes a round and returns it with its row count; `rows` reads every
    round in one scan. `fold` rounds of a kind are folded into one table of
    the next kind, so a long loop reads a few tables, and each row is written
    again only as often as the logarithm of the rounds.
    """

    FOLD = 8

    def __init__(self, spark: SparkSession, label: str, fold: int = FOLD):
        self.spark, self.root, self.fold = spark, scratch_path(spark, label), fold
        self.paths, self.schema, self.kinds, self.made = [], None, [], 0

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        self.schema = self.schema or df.schema
        path = self._next()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path, compression=COMPRESSION)
        self._keep(path, 0)
        return self._read([path]), seen.get["rows"]

    def _next(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def _keep(self, path: str, kind: int) -> None:
        self.paths.append(path)
        self.kinds.append(kind)
        last = self.kinds[-self.fold:]
        if len(last) == self.fold and set(last) == {kind}:
            folded = self._next()
            self._read(self.paths[-self.fold:]).write.parquet(folded, compression=COMPRESSION)
            del self.paths[-self.fold:], self.kinds[-self.fold:]
            self._keep(folded, kind + 1)

    def rows(self) -> DataFrame:
        return self._read(self.paths)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)
