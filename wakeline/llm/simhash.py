"""
SimHash near-dedup by bit-sliced comparison.

`fingerprints` takes words (runs of anything but ASCII white space, A-Z in
lower case), shingles them, and sets each of the 64 bits that more than half
of the shingles' XXH64 hashes have. `groups` links fingerprints that differ in
at most `radius` bits and returns the smallest id that links reach.

Candidates: of `radius + 2` bands of a fingerprint at least two are equal in
any link, so fingerprints meet in one block for each pair of bands. A block's
fingerprints are distinct and stored as vertical bit planes; one fingerprint
is compared with the whole block by adding plane after plane into carry-save
counters, one bit of each counter for every member, and stops once the
counters of all members exceed the radius. A block larger than `split` is
divided by the same rule on the bits that it does not fix, which loses no
link; after that a block has no more members than its free bits allow. What
leaves a block is one link per member, not one per pair.

Defined cases: a null or blank text has fingerprint zero and is linked like
any other; with fewer words than a shingle the whole sequence is the shingle.
Null ids take part; a component is named by its smallest non-null id (null if
it has none). Rows that repeat an id are rows of their own. Other columns may
have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, rows_by, text_of

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
PART = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PART):
        here = words[at:at + PART + shingle - 1]
        some = map(b" ".join, zip(*(here[j:] for j in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(digest, some), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, digest) per row: the fingerprint as a signed long, and the text's XXH64."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), shingle, seed) for x in batch.column("body")), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64)), batch.column("digest")], ["id", "fp", "digest"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("body"), F.xxhash64(text_of(text)).alias("digest"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(of, f"id {kind}, fp long, digest long")


def within(values: list[int], radius: int, bits: int = 64) -> Iterator[tuple[int, int]]:
    """
    (i, j), j > i: the pairs of one block that differ in at most `radius` bits.
    Planes are whole numbers with one bit per member; `sums` are the counters'
    bits, lowest first, `over` what ran out of them.
    """
    m = len(values)
    grid = np.array(values, dtype="<u8").view(np.uint8).reshape(m, 8)
    planes = np.packbits(np.unpackbits(grid, axis=1, bitorder="little").T, axis=1, bitorder="little")
    everyone = (1 << m) - 1
    vertical = [(b, p) for b in range(bits) if (p := int.from_bytes(planes[b].tobytes(), "little")) not in (0, everyone)]
    width = radius.bit_length()
    for i, value in enumerate(values[:-1]):
        later = everyone & ~((2 << i) - 1)
        sums, over = [0] * width, 0
        for b, plane in vertical:
            carry = plane ^ everyone if value >> b & 1 else plane
            for k in range(width):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            over |= carry
            if not later & ~(far := _above(sums, radius, over)):
                break
        else:
            far = _above(sums, radius, over)
        near = later & ~far
        while near:
            low = near & -near
            yield i, low.bit_length() - 1
            near ^= low


def _above(sums: list[int], radius: int, over: int) -> int:
    """The members whose counter is above `radius`: bits compared from the highest."""
    above, same = over, ~over
    for k in reversed(range(len(sums))):
        if radius >> k & 1:
            same &= sums[k]
        else:
            above |= same & sums[k]
            same &= ~sums[k]
    return above


def _bands(low: int, high: int, n: int) -> list[tuple[int, int]]:
    edges = [low + (high - low) * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def _key(bands: tuple[tuple[int, int], ...], of: str = "fp"):
    """The bits of these bands of a long, one band after the other."""
    key, at = F.lit(0).cast("long"), 0
    for low, high in bands:
        part = F.shiftrightunsigned(F.col(of), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        key, at = key.bitwiseOR(F.shiftleft(part, at)), at + high - low
    return key


def links(fps: DataFrame, radius: int = 2, split: int = 4096) -> DataFrame:
    """(u, v): links of distinct fingerprints `fps` (fp) that join the same ones as all pairs within `radius` bits."""
    n = radius + 2
    parts = _bands(0, 64, n)
    pairs = list(combinations(range(n), 2))
    rows = fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(c).alias("c"), _key((parts[a], parts[b])).alias("key")) for c, (a, b) in enumerate(pairs)))).alias("k")).select("fp", "k.*")
    large = rows.groupBy("c", "key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > split).select(
        F.col("c").alias("lc"), F.col("key").alias("lkey"))
    marked = rows.join(large, (F.col("c") == F.col("lc")) & (F.col("key") == F.col("lkey")), "left")

    free = F.lit(0).cast("long")
    for c, pair in enumerate(pairs):
        free = F.when(F.col("c") == c, _key(tuple(x for i, x in enumerate(parts) if i not in pair))).otherwise(free)
    marked = marked.withColumn("free", free)
    pieces = _bands(0, 64 - 64 * 2 // n, n)
    whole = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("sub")))
    divided = F.when(F.col("lkey").isNull(), whole).otherwise(F.array(*(
        F.struct(F.lit(1 + s).alias("s"), _key((pieces[a], pieces[b]), "free").alias("sub")) for s, (a, b) in enumerate(pairs))))
    blocks = marked.select("fp", "c", "key", F.explode(divided).alias("d")).select("fp", "c", "key", "d.s", "d.sub")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            if rest is not None:
                table = np.concatenate([rest, table])
            change = np.flatnonzero((table[1:, 1:] != table[:-1, 1:]).any(axis=1)) + 1
            cuts = np.concatenate([[0], change])
            yield _stars(table[:cuts[-1]], cuts, radius)
            rest = table[cuts[-1]:]
        if rest is not None and len(rest):
            yield _stars(rest, np.array([0, len(rest)]), radius)

    kept = blocks.repartition("c", "key", "s", "sub").sortWithinPartitions("c", "key", "s", "sub", "fp")
    return kept.select("fp", "c", "key", "s", "sub").mapInArrow(compare, "u long, v long")


def _stars(table: np.ndarray, cuts: np.ndarray, radius: int) -> pa.RecordBatch:
    """One link per member of every block's components to the component's first member."""
    u, v = [], []
    sizes = np.diff(cuts)
    for at, size in zip(cuts[:-1][sizes > 1], sizes[sizes > 1]):
        values = table[at:at + size, 0].view(np.uint64).tolist() if size else []
        values = [int(x) for x in values]
        root = list(range(size))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in within(values, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
        for i in range(size):
            if (top := find(i)) != i:
                u.append(table[at + i, 0])
                v.append(table[at + top, 0])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def groups(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, digest, component): one row per row of `docs`, component the smallest id reachable over links."""
    prints, _ = cut(fingerprints(docs, shingle, seed, id_col, text), "simhash-prints")
    classes, _ = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    found = components(links(classes.select("fp"), radius), "simhash-links")
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named, _ = cut(rooted.join(least, "root").select("fp", "component"), "simhash-named")
    return prints.join(named, "fp").select("id", "fp", "digest", "component")


#: Minima of a sketch, of which each band takes a few in full; the others count by their lowest byte.
MINIMA, BANDS, IN_BAND = 256, 24, 4
#: Candidates: bits that a pair may differ in, and the share of equal minima that it has at least. Two texts of a similarity of 0.8 differ
#: in 10 bits (deviation 3) and agree in 0.8 of the minima (deviation 0.025), so both leave out no more than a few in a million.
SPREAD, LEAST = 26, 0.6
#: What the orders multiply by: odd, and without a rule between them, which would let orders agree or differ together.
TURNS = np.array([xxhash.xxh64_intdigest(i.to_bytes(2, "little")) | 1 for i in range(MINIMA)], np.uint64)
#: Members of a block that are compared at once, by sketches and by whole sets.
MEMBERS, WHOLE = 2048, 256
#: Bytes of digests that are broadcast.
FEW_BYTES = 64 << 20


def shingles(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of a text's distinct shingles, sorted."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    some = map(b" ".join, zip(*(words[j:] for j in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.sort(np.fromiter(set(map(partial(xxhash.xxh64_intdigest, seed=seed), some)), dtype="<u8"))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity; two empty ones are equal."""
    least, most = sorted((len(a), len(b)))
    if not most:
        return True
    if least / most < similarity:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (least + most - both) >= similarity


def sketch(text: bytes, shingle: int, seed: int = 42) -> tuple[int, np.ndarray]:
    """The fingerprint over a text's distinct shingles, and the minima of as many orders of them."""
    hashes = shingles(text, shingle, seed)
    if not len(hashes):
        return 0, np.zeros(MINIMA, np.uint64)
    ones = np.zeros(64, np.int64)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        here = hashes[at:at + (1 << 12)]
        ones += np.unpackbits(here.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        least = np.minimum(least, ((here ^ (here >> np.uint64(29)))[:, None] * TURNS).min(axis=0))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]), least


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, seed: int, text: str) -> DataFrame:
    """(digest, shingles): the whole sorted sets of the texts whose digest is in `wanted`."""
    wanted, n = cut(wanted, "near-wanted")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_buffer().to_pybytes(), shingle, seed).tobytes() for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.binary())], ["digest", "shingles"])

    rows = docs.select(F.xxhash64(text_of(text)).alias("digest"), text_of(text).alias("body"))
    rows = rows.join(F.broadcast(wanted) if 16 * n <= FEW_BYTES else wanted, "digest", "left_semi")
    return cut(rows.mapInArrow(of, "digest long, shingles binary").dropDuplicates(["digest"]), "near-sets")[0]


def _dealt(blocks: DataFrame, by: list[str], members: int) -> DataFrame:
    """`blocks` (digest, n and the columns `by`) with parts a and b: every two members of a block of n meet in one pair of parts."""
    parts = F.ceil(F.col("n") / F.lit(members)).cast("long")
    return blocks.withColumn("own", F.pmod("digest", parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(
        "digest", *by, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def _linked(stream: DataFrame, by: list[str], similarity: float | None) -> DataFrame:
    """(u, v): links that join the members of each block; by sketches alone, or with `similarity` those of other roots by their whole sets."""
    values = ["digest", "fp", "lows"] if similarity is None else ["digest", "fp", "lows", "root", "shingles"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members = None, []
        for batch in batches:
            names = zip(*(batch.column(x).to_pylist() for x in by))
            for name, member in zip(names, zip(*(batch.column(x).to_pylist() for x in values))):
                if name != block:
                    yield _near(members, similarity)
                    block, members = name, []
                members.append(member)
        yield _near(members, similarity)

    return stream.repartition(*by).sortWithinPartitions(*by, "digest").select(*by, *values).mapInArrow(compare, "u long, v long")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """
    (id, fp, digest, component, root) where texts whose sets of shingles have a
    Jaccard similarity of `similarity` or more are linked.

    Sketches only find candidates, the whole sets decide. So many bits differ
    at such a similarity that bands of the fingerprint find no candidates;
    blocks are therefore equal bands of minima, and inside a block the
    bit-sliced comparison and the share of equal minima leave candidates with
    room on both (`SPREAD`, `LEAST`). At a similarity of 0.8 a pair misses all
    blocks three times in a million.

    Of the candidates first the links that would join them are decided by the
    whole sets. Where that leaves a block's candidates in more than one group,
    every pair of candidates of different groups in it is decided too, in the
    block, which hands on no more links than it has members. A block of more
    than `MEMBERS` (`WHOLE` with sets) is compared by pairs of parts, each pair
    a task of its own. Sets are made again of the candidates' texts only.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, lows, keys = [], [], []
            for body in batch.column("body"):
                fp, least = sketch(body.as_buffer().to_pybytes(), shingle, seed)
                fps.append(fp)
                lows.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
                keys.append([xxhash.xxh64_intdigest(least[i * IN_BAND:(i + 1) * IN_BAND].tobytes()) for i in range(BANDS)])
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64)), batch.column("digest"), pa.array(lows, pa.binary()),
                pa.array([np.array(k, np.uint64).view(np.int64).tolist() for k in keys], pa.list_(pa.int64()))], ["id", "fp", "digest", "lows", "keys"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(c)] for c in ("one", "two"))
            hit = pa.array([alike(a, b, similarity) for a, b in zip(*sets)], pa.bool_())
            yield batch.select(["u", "v"]).filter(hit)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("body"), F.xxhash64(text_of(text)).alias("digest"))
    kind = rows.schema["id"].dataType.simpleString()
    prints, _ = cut(rows.mapInArrow(of, f"id {kind}, fp long, digest long, lows binary, keys array<long>"), "near-prints")
    keyed = prints.select("digest", F.posexplode("keys").alias("c", "key")).distinct()
    shared = keyed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found, _ = cut(keyed.join(shared, ["c", "key"]), "near-blocks")
    once = prints.join(found.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("fp").alias("fp"), F.first("lows").alias("lows"))
    by = ["c", "key", "a", "b"]
    drawn, _ = cut(_linked(_dealt(found, ["c", "key"], MEMBERS).join(once, "digest"), by, None).distinct(), "near-drawn")
    sets = _sets(docs, drawn.select(F.explode(F.array("u", "v")).alias("digest")).distinct(), shingle, seed, text)
    both = drawn.join(sets.select(F.col("digest").alias("u"), F.col("shingles").alias("one")), "u").join(
        sets.select(F.col("digest").alias("v"), F.col("shingles").alias("two")), "v")
    edges, _ = cut(both.select("u", "v", "one", "two").mapInArrow(decide, "u long, v long"), "near-edges")

    may = components(drawn, "near-may").select(F.col("node").alias("digest"), F.col("root").alias("may"))
    so_far = components(edges, "near-so-far").select(F.col("node").alias("digest"), "root")
    state, _ = cut(may.join(so_far, "digest", "left").select("digest", "may", F.coalesce("root", "digest").alias("root")), "near-state")
    split = state.groupBy("may").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("may")
    state = state.join(split, "may", "left_semi")
    apart = found.select("digest", "c", "key").join(state, "digest")
    mixed = apart.groupBy("c", "key", "may").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    blocks = apart.select("digest", "c", "key", "may").join(mixed.select("c", "key", "may", "n"), ["c", "key", "may"])
    stream = _dealt(blocks, ["c", "key", "may"], WHOLE).join(once, "digest").join(state.select("digest", "root"), "digest").join(sets, "digest")
    edges = edges.unionByName(_linked(stream, ["c", "key", "may", "a", "b"], similarity))

    roots = components(edges, "near-links").withColumnRenamed("node", "digest")
    classes = prints.groupBy("digest").agg(F.min("id").alias("least"))
    named = classes.join(roots, "digest", "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    named, _ = cut(named, "near-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named, _ = cut(named.join(least, "root").select("digest", "component", "root"), "near-named")
    return prints.select("id", "fp", "digest").join(named, "digest").select("id", "fp", "digest", "component", "root")


def _near(members: list[tuple], similarity: float | None) -> pa.RecordBatch:
    """Links that join the candidates of a block (digest, fp, lows), or with a similarity those (with root, shingles) whose sets have it."""
    u, v = [], []
    if len(members) > 1:
        lows = np.stack([np.frombuffer(m[2], np.uint8) for m in members])
        root = list(range(len(members)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if similarity is not None:
            sets, first = [np.frombuffer(m[4], "<u8") for m in members], {}
            for i, m in enumerate(members):
                root[i] = first.setdefault(m[3], i)
        for i, pairs in groupby(within([m[1] & (1 << 64) - 1 for m in members], SPREAD), lambda pair: pair[0]):
            others = [j for _, j in pairs if find(i) != find(j)]
            if others:
                agree = ((lows[others] == lows[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                for j in np.array(others)[agree >= LEAST].tolist():
                    a, b = find(i), find(j)
                    if a != b and (similarity is None or alike(sets[i], sets[j], similarity)):
                        root[max(a, b)] = min(a, b)
                        u.append(members[i][0])
                        v.append(members[j][0])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def survivors(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """
    The rows of `docs` that stay: of each near group the row with the smallest
    id, in a group without ids the text with the smallest digest; of texts that
    repeat that id in one group the one with the smallest digest. Rows that
    repeat id and text count as one document and all stay.
    """
    groups_ = near_groups(docs, shingle, similarity, seed, id_col, text)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    return rows_by(docs, groups_.groupBy("root").agg(first).select("first.*"), "left_semi", id_col, text)
