"""
Token counts as delta-maintained rollups.

A batch of changes inserts, revises or deletes documents. Every change becomes
signed rows: -1 with the counts that stood, +1 with the new ones. The journal
keeps those rows per document, so what stands is the rows whose signs add up
to one; the rollup keeps their sums by source, language and tokenizer version,
so totals are the sum of all batches' deltas and no document is counted again.

A batch is committed under a name. Its files are written first; it counts from
the moment its marker exists. Markers are numbered; one is written aside and
then renamed into the place of its number, which fails if that is taken, so a
marker is whole or not there, and of batches that run at once the later one
finds its place taken and works out its changes again from what then stands.
A batch that failed on the way leaves files that nothing reads; doing it again
under the same name counts once, and doing a committed one again does nothing.
`compact` folds the committed deltas into one, and the journal into what stands.
The store must rename atomically.

Counting is one pass over whole texts inside tasks; a group's sums are formed
in the tasks before they are shuffled, so a source with a third of all rows is
a few rows. Changes meet the journal by document id, which is spread evenly.

Defined cases: a null or empty text has no tokens. A null source or language
is a group of its own. An insert or revision of an id that stands replaces it;
deleting one that does not stand does nothing. Of several changes of one id in
a batch the one with the largest `seq` counts, of equal ones any one, the same
in each run. Rows without an id cannot be revised: they only ever insert, each
by itself. `apart` makes rows that repeat an id such rows, where a table holds
documents and not versions of them. Other columns may have any name. An empty batch changes nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k"
# Fixed value: how this vocabulary splits a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of repeated ids that are broadcast.
FEW_BYTES = 64 << 20
_JOURNAL = "doc_id string, source string, lang string, version string, tokens bigint, sign int"
_ROLLUP = "source string, lang string, version string, docs bigint, tokens bigint"


@lru_cache(maxsize=2)
def _encoding(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def counted(rows: DataFrame, body: str = "body", ranks: str = RANKS) -> DataFrame:
    """`rows` with `tokens` in place of the text column."""
    others = [c for c in rows.columns if c != body]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoding(ranks).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(count(x.as_py() or "")) for x in batch.column(body)), dtype=np.int64, count=len(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n)], [*others, "tokens"])

    fields = rows.select(*others).schema
    return rows.mapInArrow(of, fields.add("tokens", "long"))


def apart(docs: DataFrame) -> DataFrame:
    """`docs` without the ids that more than one row has: those rows are documents of their own, none a version of another."""
    twice, n = cut(docs.groupBy(F.col("doc_id").alias("twice")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 AND twice IS NOT NULL").select("twice"), "repeated-ids")
    rows = docs.join(F.broadcast(twice) if 16 * n <= FEW_BYTES else twice, F.col("doc_id") == F.col("twice"), "left")
    return rows.withColumn("doc_id", F.when(F.col("twice").isNull(), F.col("doc_id"))).drop("twice")


@dataclass
class Rollup:
    """Totals under `root`, a folder that all executors share, for one tokenizer version."""

    spark: SparkSession
    root: str
    version: str = VERSION
    ranks: str = RANKS

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _markers(self, kind: str) -> list[list[str]]:
        """What the markers of a kind say, in the order of their numbers."""
        fs, where = self._fs(f"{self.root}/{kind}/*")
        found = []
        for x in sorted(fs.globStatus(where) or [], key=lambda x: x.getPath().getName()):
            stream = fs.open(x.getPath())
            try:
                found.append(stream.readUTF().split("\n"))
            finally:
                stream.close()
        return found

    def committed(self) -> dict[str, str]:
        """The folder of every batch that counts, in the order of their commits."""
        return dict(self._markers("markers"))

    def _read(self, table: str, schema: str, only: dict[str, str] | None = None) -> DataFrame:
        paths = sorted(f"{p}/{table}" for p in set((self.committed() if only is None else only).values()))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def standing(self) -> DataFrame:
        """What stands: (doc_id, source, lang, version, tokens), from the last fold and the journals after it."""
        columns = ("doc_id", "source", "lang", "version", "tokens")
        folded, rest = self._folded()
        rows = self._read("journal", _JOURNAL, rest).where("doc_id IS NOT NULL")
        if folded:
            rows = rows.unionByName(self.spark.read.schema(_JOURNAL).parquet(f"{folded}/standing"))
        sums = rows.groupBy(*columns).agg(F.sum("sign").alias("n"))
        return sums.where("n > 0").select(*columns)

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens): the sum of all committed deltas, groups without documents left out."""
        folded, rest = self._folded()
        deltas = self._read("delta", _ROLLUP, rest)
        if folded:
            deltas = deltas.unionByName(self.spark.read.schema(_ROLLUP).parquet(f"{folded}/totals"))
        return deltas.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def commit(self, changes: DataFrame, batch: str) -> bool:
        """
        Apply (op, doc_id, seq, text, source, lang), op one of insert, revise
        and delete. Returns whether the batch is new.
        """
        if batch in self.committed():
            return False
        if "/" in batch or "\n" in batch:
            raise ValueError("a batch's name has no slash and no line end")
        rows = changes.select("op", F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("long").alias("seq"),
                              F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_of().alias("body"))
        rows = counted(rows, "body", self.ranks).withColumn("version", F.lit(self.version))
        path = f"{self.root}/batches/{batch}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
        rows.write.parquet(f"{path}/changes")
        rows = self.spark.read.schema(rows.schema).parquet(f"{path}/changes")
        last = Window.partitionBy("doc_id").orderBy(F.desc("seq"), "op", "source", "lang", "tokens")
        named = rows.where("doc_id IS NOT NULL").withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")
        free = rows.where("doc_id IS NULL AND op <> 'delete'")
        new = named.where("op <> 'delete'").unionByName(free).select("doc_id", "source", "lang", "version", "tokens", F.lit(1).alias("sign"))
        while batch not in (before := self.committed()):
            turn = f"{path}/{len(before)}"
            old = self.standing().where(F.col("version") == self.version).join(named.select("doc_id"), "doc_id", "left_semi")
            signed = old.select("doc_id", "source", "lang", "version", "tokens", F.lit(-1).alias("sign")).unionByName(new)
            signed.write.mode("overwrite").parquet(f"{turn}/journal")
            delta = self.spark.read.schema(_JOURNAL).parquet(f"{turn}/journal").groupBy("source", "lang", "version").agg(
                F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
            delta.coalesce(1).write.mode("overwrite").parquet(f"{turn}/delta")
            if self._mark("markers", f"{len(before):012}", batch, turn):
                return True
        return False

    def _mark(self, kind: str, name: str, *said: str) -> bool:
        """Put a marker that says something in its place; false where another one came first."""
        jvm = self.spark._jvm
        fs, aside = self._fs(f"{self.root}/aside/{jvm.java.util.UUID.randomUUID().toString()}")
        place = self._fs(f"{self.root}/{kind}/{name}")[1]
        out = fs.create(aside, False)
        out.writeUTF("\n".join(said))
        out.close()
        fs.mkdirs(place.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fs.makeQualified(aside), fs.makeQualified(place), never)
        except Exception:  # noqa: BLE001  the store says in its own words that the place is taken
            if not fs.exists(place):
                raise
            return False
        return True

    def _folded(self) -> tuple[str | None, dict[str, str]]:
        """The folder of the last fold, if any, and the batches it does not hold."""
        batches, folds = self.committed(), self._markers("folds")
        if not folds:
            return None, batches
        path, held = folds[-1][0], int(folds[-1][1])
        return path, dict(list(batches.items())[held:])

    def compact(self) -> bool:
        """Fold the deltas committed so far into one table and the journals into what stands; false if another fold came first."""
        number, batches = len(self._markers("folds")), self.committed()
        path = f"{self.root}/folded/{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
        before, rest = self._folded()
        held = {b: p for b, p in rest.items() if b in batches}
        sums, rows = self._read("delta", _ROLLUP, held), self._read("journal", _JOURNAL, held).where("doc_id IS NOT NULL")
        if before:
            sums = sums.unionByName(self.spark.read.schema(_ROLLUP).parquet(f"{before}/totals"))
            rows = rows.unionByName(self.spark.read.schema(_JOURNAL).parquet(f"{before}/standing"))
        sums.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/totals")
        standing = rows.groupBy("doc_id", "source", "lang", "version", "tokens").agg(F.sum("sign").cast("int").alias("sign")).where("sign > 0")
        standing.select("doc_id", "source", "lang", "version", "tokens", "sign").write.parquet(f"{path}/standing")
        return self._mark("folds", f"{number:012}", path, str(len(batches)))
