"""
Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed: its blob is the
SHA-256 of its text. A ledger folder keeps three tables, each written once per
commit: `versions` (which blob a path had in which commit), `scanned` (which
blob was scanned under which version of the rules) and `findings` (one row per
scanned blob that has any, with its spans). A commit scans only the pairs of
blob and rule version that the ledger has not seen, each blob once however many
paths or versions carry it, and findings are joined back to all paths.

Committing again under a name that the ledger has is a no-op. The `scanned`
rows of a commit are written last and only they make its findings count, so a
commit that failed on the way is done again and leaves no half.

Copies are merged inside every task before anything is shuffled; the join of
findings back to paths has plain shuffles on both sides, which Spark splits
where one blob is hot.

Defined cases: a null text is the empty text, which has no findings. Null and
repeated paths are versions of their own, and each gets its blob's findings.
Other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import marked, text_of

# The kinds in their order, what each matches, and the shortest match that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the leftmost longest runs, of which shorter ones would be dropped
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 8, "access": 16, "hex": 32}
WORDS = ("passw", "secret", "token", "api")
RULES = "base-1"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all secrets in one text, in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of blobs (blob, body) that have any; spans: array of (kind, start, end)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            names, spans = [], []
            for blob, body in zip(batch.column("blob"), batch.column("body")):
                if found := find(body.as_py()):
                    names.append(blob.as_py())
                    spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in found])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(spans, kind)], ["blob", "spans"])

    return blobs.select("blob", "body").mapInArrow(of, "blob string, spans array<struct<kind: string, start: bigint, end: bigint>>")


@dataclass
class Ledger:
    """A ledger of blobs under `root`, a folder that all executors share."""

    spark: SparkSession
    root: str

    def _commits(self, table: str) -> list[str]:
        """The commits whose rows of a table are whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/*/_SUCCESS")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getParent().toString() for x in store.globStatus(path) or [])

    def _read(self, table: str, schema: str) -> DataFrame:
        whole = {p.rpartition("/")[2] for p in self._commits("scanned")}
        paths = [p for p in self._commits(table) if p.rpartition("/")[2] in whole]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """(commit, path, blob); path is text."""
        return self._read("versions", "commit string, path string, blob string")

    def scanned(self) -> DataFrame:
        return self._read("scanned", "rules string, blob string")

    def findings(self) -> DataFrame:
        """(rules, blob, spans)."""
        return self._read("findings", "rules string, blob string, spans array<struct<kind: string, start: bigint, end: bigint>>")

    def has(self, commit: str, rules: str = RULES) -> bool:
        return any(p.rpartition("/")[2] == f"{commit}@{rules}" for p in self._commits("scanned"))

    def commit(self, docs: DataFrame, commit: str, rules: str = RULES, path: str = "doc_id", text: str = "text") -> None:
        """Record a version of every row's path, and scan what is new to these rules."""
        if self.has(commit, rules):
            return
        name = f"{commit}@{rules}"
        rows = docs.select(F.col(path).cast("string").alias("path"), text_of(text).alias("body")).withColumn("blob", F.sha2("body", 256))
        rows.select(F.lit(commit).alias("commit"), "path", "blob").write.mode("overwrite").parquet(f"{self.root}/versions/{name}")
        seen = self.scanned().where(F.col("rules") == rules).select("blob")
        # Digests tell what is new; only bodies that may be new leave their task.
        new = self.spark.read.parquet(f"{self.root}/versions/{name}").select("blob").distinct().join(seen, "blob", "left_anti")
        new.select(F.lit(rules).alias("rules"), "blob").write.mode("overwrite").parquet(f"{self.root}/new/{name}")
        new = self.spark.read.parquet(f"{self.root}/new/{name}").select("blob")
        bodies = marked(rows.select("blob", "body"), F.xxhash64("blob"), new.select(F.xxhash64("blob").alias("key")))
        unseen = bodies.groupBy("blob").agg(F.first("body").alias("body")).join(new, "blob", "left_semi")
        scan(unseen).select(F.lit(rules).alias("rules"), "blob", "spans").write.mode("overwrite").parquet(f"{self.root}/findings/{name}")
        new.select(F.lit(rules).alias("rules"), "blob").write.mode("overwrite").parquet(f"{self.root}/scanned/{name}")

    def by_path(self, docs: DataFrame, rules: str = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
        """(path, blob, spans) for every row of `docs`, spans empty where the blob has none."""
        rows = docs.select(F.col(path).alias("path"), F.sha2(text_of(text), 256).alias("blob"))
        return _joined(rows, self.findings().where(F.col("rules") == rules))

    def history(self, rules: str = RULES) -> DataFrame:
        """(commit, path, blob, spans) for every version of every path that has findings."""
        return self.versions().join(self.findings().where(F.col("rules") == rules).select("blob", "spans"), "blob")


def _joined(rows: DataFrame, findings: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    return rows.join(findings.select("blob", "spans"), "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))
