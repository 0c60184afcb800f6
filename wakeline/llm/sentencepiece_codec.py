"""
SentencePiece encoding and decoding, with a max-plus scan over giant documents.

A text is encoded as the library does it: spaces become U+2581, one is put in
front, pieces merge by their score, and characters without a piece become
bytes. A text of at most `chunk` characters is one chunk and is encoded where
it lies. A longer one is split into chunks at fixed places.

A piece sequence is the encoding of its text exactly if every two neighbours
are the encoding of their own concatenation. So with weight 0 for neighbours
that are and minus infinity for others, the encoding is the best path, and the
only one of finite weight. The state at a cut is the piece that reaches or
crosses it. For each state a chunk may begin with, a left-to-right pass gives
the states it may end with; these weights are the chunk's transfer matrix.
Matrices of one document are combined associatively (a tree of max-plus
products), which fixes the state at every cut; then each chunk is traced back
by itself from its own two states. Passes from several states soon agree and
are followed no further than that.

Matrices have a few entries a chunk, so a document's scan is small work for
one task whatever its length; its text is never in one task after the split.

Defined cases: a null text has null ids and decodes to null; an empty text has
no ids. A text with U+2581 decodes to spaces there, as in the library, and
`exact` is false. Equal giant texts are encoded once. Null and repeated ids are
rows of their own. Other columns may have any name. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .common import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
SPACE = "▁"
#: A character without a piece, as a state.
NONE = -1

State = tuple[int, int, int]  # start, end, piece
START: State = (0, 0, -2)


class Pieces:
    """The pieces of a model, and which of them may be neighbours."""

    def __init__(self, model: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        sp, n = self.processor, self.processor.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.texts = {i: p for p, i in self.ids.items()}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.known: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                break
            parts[-best[1]:2 - best[1]] = ["".join(parts[-best[1]:2 - best[1]])]
        return parts

    def allowed(self, a: int, b: int) -> bool:
        """Whether piece `b` may follow piece `a` (any where `a` is no piece)."""
        if b == NONE:
            return True
        found = self.known.get((a, b))
        if found is None:
            right = self.texts[b]
            if a < 0:
                found = self.merged(right) == [right]
            else:
                found = self.merged(self.texts[a] + right) == [self.texts[a], right]
            self.known[a, b] = found
        return found

    def ending(self, text: str, at: int, low: int) -> Iterator[tuple[int, int]]:
        """(start, piece) of the pieces that end at `at` and start at `low` or later."""
        for j in range(at - 1, max(low, at - self.longest) - 1, -1):
            piece = self.ids.get(text[j:at])
            if piece is not None:
                yield j, piece
            elif j == at - 1:
                yield j, NONE

    def spell(self, text: str, states: list[State]) -> list[int]:
        out = []
        for start, end, piece in states:
            out.extend([piece] if piece >= 0 else (self.bytes[b] for b in text[start:end].encode()))
        return out


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def follow(p: Pieces, text: str, state: State, stop: int, known: list[dict[int, State]]) -> dict[int, State]:
    """
    The last piece of the only path from `state` to each place up to `stop`,
    where there is one. Once as many places as the longest piece agree with an
    earlier pass over the same chunk, the rest is taken from it.
    """
    last, same = {state[1]: state}, [0] * len(known)
    for i in range(state[1] + 1, stop + 1):
        for j, piece in p.ending(text, i, state[1]):
            before = last.get(j)
            if before is not None and p.allowed(before[2], piece):
                last[i] = (j, i, piece)
                break
        for k, other in enumerate(known):
            same[k] = same[k] + 1 if other.get(i) == last.get(i) else 0
            if same[k] > p.longest:
                last.update((x, s) for x, s in other.items() if x > i)
                return last
    return last


def crossing(p: Pieces, text: str, at: int) -> list[State]:
    """The states that a path may have at a cut: pieces that start before it and end at it or later."""
    return [(j, i, piece) for i in range(at, min(len(text), at + p.longest - 1) + 1) for j, piece in p.ending(text, i, 0) if j < at]


def transfer(p: Pieces, text: str, begin: int, end: int, first: bool, final: bool) -> dict[State, dict[State, float]]:
    """
    The transfer matrix of a chunk: the weight from each state at `begin` to
    each at `end`; what is not listed is minus infinity. `text` reaches beyond
    both by the longest piece.
    """
    matrix, known = {}, []
    stop = len(text) if final else min(len(text), end + p.longest - 1)
    for state in [START] if first else crossing(p, text, begin):
        last = follow(p, text, state, stop, known)
        known.append(last)
        if final:
            exits = [last[stop]] if stop in last else []
        else:
            exits = [s for i in range(end, stop + 1) if (s := last.get(i)) is not None and s[0] < end]
        matrix[state] = {s: 0.0 for s in exits}
    return matrix


def product(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices."""
    out = {}
    for state, middle in a.items():
        row: dict = {}
        for m, x in middle.items():
            for to, y in b.get(m, {}).items():
                row[to] = max(row.get(to, float("-inf")), x + y)
        out[state] = row
    return out


def settle(matrices: list[dict], enter: State, leave: State) -> list[State]:
    """The states at all cuts, given those at both ends: products of halves, then each half by itself."""
    if len(matrices) == 1:
        return []
    middle = len(matrices) // 2
    left, right = _whole(matrices[:middle]), _whole(matrices[middle:])
    weight, state = max((x + right.get(m, {}).get(leave, float("-inf")), m) for m, x in left[enter].items())
    if weight == float("-inf"):
        raise ValueError("no path through the chunks")
    return [*settle(matrices[:middle], enter, state), state, *settle(matrices[middle:], state, leave)]


def _whole(matrices: list[dict]) -> dict:
    while len(matrices) > 1:
        matrices = [product(*matrices[i:i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def trace(p: Pieces, text: str, enter: State, leave: State) -> list[State]:
    """The pieces after `enter` up to and with `leave`."""
    last, out, state = follow(p, text, enter, leave[1], []), [], leave
    while state[1] > enter[1]:
        out.append(state)
        state = last[state[0]]
    return out[::-1]


def prepared(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


_CHUNK = "key string, no int, base long, begin int, end int, final boolean, body string"


def _chunks(giants: DataFrame, model: str, chunk: int) -> DataFrame:
    """The chunks of distinct giant texts (key, body), each with the longest piece's length of text around it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = pieces(model).longest
        for batch in batches:
            for key, body in zip(batch.column("key"), batch.column("body")):
                text = prepared(body.as_py())
                starts = list(range(0, len(text), chunk))
                rows = []
                for no, a in enumerate(starts):
                    b, base = min(len(text), a + chunk), max(0, a - margin)
                    rows.append((key.as_py(), no, base, a - base, b - base, b == len(text), text[base:b + margin]))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist([dict(zip(("key", "no", "base", "begin", "end", "final", "body"), r)) for r in rows[at:at + 64]], schema=pa.schema(
                        [("key", pa.string()), ("no", pa.int32()), ("base", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("final", pa.bool_()), ("body", pa.string())]))

    return cut(giants.mapInArrow(of, _CHUNK).repartition("key", "no"), "piece-chunks")[0]


def _giant_ids(giants: DataFrame, model: str, chunk: int) -> DataFrame:
    """(key, ids) of giant texts."""
    rows = _chunks(giants, model, chunk)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            keys, nos, entries = [], [], []
            for r in batch.to_pylist():
                found = transfer(p, r["body"], r["begin"], r["end"], r["no"] == 0, r["final"])
                put = lambda s, base=r["base"], whole=START: list(s) if s == whole else [s[0] + base, s[1] + base, s[2]]
                keys.append(r["key"])
                nos.append(r["no"])
                entries.append([{"a": put(a), "b": put(b), "w": w} for a, row in found.items() for b, w in row.items()])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("w", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(nos, pa.int32()), pa.array(entries, kind)], ["key", "no", "entries"])

    found = rows.mapInArrow(matrices, "key string, no int, entries array<struct<a: array<long>, b: array<long>, w: double>>")

    def scan(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        steps = []
        for r in rows:
            matrix: dict = {}
            for e in r["entries"]:
                matrix.setdefault(tuple(e["a"]), {})[tuple(e["b"])] = e["w"]
            steps.append(matrix)
        leave = next(b for row in steps[-1].values() for b in row)
        ends = [b for row in _whole(steps).values() for b in row]
        states = [START, *settle(steps, START, ends[0] if ends else leave), ends[0] if ends else leave]
        return pa.table({
            "key": [r["key"] for r in rows], "no": pa.array([r["no"] for r in rows], pa.int32()),
            "enter": pa.array([list(s) for s in states[:-1]], pa.list_(pa.int64())), "leave": pa.array([list(s) for s in states[1:]], pa.list_(pa.int64()))})

    settled = found.groupBy("key").applyInArrow(scan, "key string, no int, enter array<long>, leave array<long>")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            keys, nos, ids = [], [], []
            for r in batch.to_pylist():
                base = r["base"]
                enter = START if tuple(r["enter"]) == START else (r["enter"][0] - base, r["enter"][1] - base, r["enter"][2])
                leave = (r["leave"][0] - base, r["leave"][1] - base, r["leave"][2])
                keys.append(r["key"])
                nos.append(r["no"])
                ids.append(p.spell(r["body"], trace(p, r["body"], enter, leave)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(nos, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["key", "no", "ids"])

    parts = rows.join(settled, ["key", "no"]).mapInArrow(traced, "key string, no int, ids array<int>")
    return parts.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda s: s["ids"])).alias("ids"))


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, text: str = "text", out: str = "ids", exact: str | None = None) -> DataFrame:
    """
    The rows of `docs` with their whole text's ids in `out`, and in `out`_chunks
    how many chunks it was. `exact` names a column for whether the ids decode
    to the text again, decoded while they are at hand.
    """
    columns = [c for c in docs.columns if c not in (out, f"{out}_chunks", exact)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(text).cast("string").alias("body")).withColumn(
        "giant", F.coalesce(F.length("body") > chunk, F.lit(False)))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model).processor
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                bodies = part.column("body").to_pylist()
                ids = sp.encode([b or "" for b in bodies], num_threads=1)
                back = sp.decode(ids, num_threads=1) if exact else bodies
                same = pa.array([b is None or b == t for b, t in zip(bodies, back)], pa.bool_())
                ids = pa.array([None if b is None else i for b, i in zip(bodies, ids)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("row"), ids, pa.array([1] * len(part), pa.int32()), same], ["row", "ids", "n", "same"])

    schema = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("n", IntegerType()), StructField("same", BooleanType())])
    small = rows.where("NOT giant").select("row", "body").mapInArrow(short, schema)
    large = rows.where("giant").withColumn("key", F.sha2("body", 256))
    found = _giant_ids(large.select("key", "body").dropDuplicates(["key"]), model, chunk)
    sized = large.select("row", "key", F.ceil((F.length("body") + 1) / F.lit(chunk)).cast("int").alias("n"))
    giants = sized.join(found, "key").select("row", "ids", "n")
    if exact:
        giants = decode(giants, model).withColumn("same", F.col("decoded").eqNullSafe(F.col(f"row.`{text}`").cast("string"))).drop("decoded")
    else:
        giants = giants.withColumn("same", F.lit(True))
    both = small.unionByName(giants)
    return both.select(*(F.col(f"row.`{c}`").alias(c) for c in columns), F.col("ids").alias(out), F.col("n").alias(f"{out}_chunks"),
                       *([F.col("same").alias(exact)] if exact else []))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the text of `ids` in `out`; null ids give null."""
    columns = [c for c in rows.columns if c != out]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model).processor
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                lists = part.column("ids").to_pylist()
                texts = sp.decode([i or [] for i in lists], num_threads=1) if lists else []
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([None if i is None else t for i, t in zip(lists, texts)], pa.string())], ["row", "decoded"])

    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(ids).alias("ids"))
    return packed.mapInArrow(of, StructType([packed.schema["row"], StructField("decoded", StringType())])).select(*(F.col(f"row.`{c}`").alias(c) for c in columns), F.col("decoded").alias(out))
