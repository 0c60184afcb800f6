"""
Reachability over edges recorded backwards, consumer to producer.

Everything is keyed by run, so one job answers for many runs and many
subjects. Tasks are numbered once (`numbered`), in the order of their names,
and the loops see nothing but numbers. A closure keeps one row per task with
its subjects as a set of bits; a round moves the rows whose bits changed along
the edges, joins what arrives by bitwise OR, and drops what the task had. Each
round's rows are written once to the shared folder, so the plan stays short
and no round depends on an executor that may be gone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.session import RoundLog, cut, grown, sent

EXTERNAL = "EXTERNAL"
NODE = ["run_id", "task"]
#: Subjects that share a row of a task: 64 bits in each of so many words.
WORDS = 16
#: A round is narrow when this many times its rows are fewer than all rows so far.
NARROW = 16
#: Rows that one task numbers.
NUMBERED = 1 << 20
#: Levels of a path whose order is kept by names before it is made a number again.
LEVELS = 8


def forward_edges(edges: DataFrame) -> DataFrame:
    """(run_id, task, next): one row per producer and consumer that differ. EXTERNAL is no node."""
    return (
        edges.where(F.col("producer").isNotNull() & (F.col("producer") != EXTERNAL)
                    & (F.col("producer") != F.col("consumer")))
        .select("run_id", F.col("producer").alias("task"), F.col("consumer").alias("next"))
        .distinct()
    )


@dataclass
class Numbered:
    """`nodes` (run_id, task, node) numbers the ends of all forward edges by their names' order; `forward` (node, next) are the edges."""

    nodes: DataFrame
    forward: DataFrame

    def entered(self, entries: DataFrame) -> DataFrame:
        """`entries` with the number of their task; tasks without a forward edge have none, and stay alone."""
        return entries.join(grown(self.nodes), NODE, "left")


def numbered(edges: DataFrame) -> Numbered:
    """The graph of `edges` as numbers, written once, for several closures over it."""
    followed = edges.where(F.col("producer").isNotNull() & (F.col("producer") != EXTERNAL) & (F.col("producer") != F.col("consumer")))
    ends = followed.select("run_id", F.explode(F.array("producer", "consumer")).alias("task")).distinct()
    ordered = ends.repartitionByRange("task", "run_id").sortWithinPartitions("task", "run_id")
    nodes, _ = cut(ordered.withColumn("node", F.monotonically_increasing_id()), "nodes")
    to = nodes.select("run_id", F.col("task").alias("consumer"), F.col("node").alias("next"))
    by = nodes.select("run_id", F.col("task").alias("producer"), "node")
    forward, _ = cut(followed.select("run_id", "producer", "consumer").join(grown(by), ["run_id", "producer"]).join(grown(to), ["run_id", "consumer"]).select("node", "next").distinct(), "edges")
    return Numbered(nodes, forward)


def _numbers(rows: DataFrame, name: str, label: str) -> tuple[DataFrame, int]:
    """(name, no) for each distinct value of a column, dense but for the ends of runs of `NUMBERED`; and how many there are."""
    distinct, n = cut(rows.select(name).distinct(), label)
    tasks = -(-n // NUMBERED) or 1
    return cut(distinct.repartition(tasks).withColumn("no", F.monotonically_increasing_id()), label)[0], n


class Closure:
    """
    Which subjects reach which tasks. `bits` has a row (node, block, w0, w1, ..)
    for a task and a block of 64 * `words` subjects of which any reach it.
    """

    def __init__(self, entries: DataFrame, graph: Numbered):
        entries = entries.select("subject", *NODE).distinct()
        self.graph = graph
        self.subjects, n = _numbers(entries, "subject", "subjects")
        self.words = min(WORDS, max(1, -(-n // 64)))
        starts, _ = cut(graph.entered(entries).join(self.subjects, "subject"), "starts")
        self.entered, self.alone = starts, starts.where("node IS NULL").select("subject", *NODE)
        size = 64 * self.words
        names = [f"w{j}" for j in range(self.words)]
        place = F.col("no") % size
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
        log = RoundLog(entries.sparkSession, "closure")
        fresh, rows = log.add(self._joined(starts.where("node IS NOT NULL").select(
            "node", F.floor(F.col("no") / size).alias("block"), *(F.when(F.floor(place / 64) == j, one).otherwise(F.lit(0).cast("long")).alias(w) for j, w in enumerate(names)))))
        self.rounds = [rows]
        while rows:
            moved = sent(fresh, rows).join(graph.forward, "node").drop("node").withColumnRenamed("next", "node")
            if rows * NARROW < sum(self.rounds):
                # What few tasks had is looked up for them alone. They are written, so that their number is known and they go to the log, not the log to them.
                arriving, n_arriving = cut(self._joined(moved), "arriving")
                had = self._joined(log.rows().join(sent(arriving.select("node", "block"), n_arriving), ["node", "block"], "left_semi"))
                both = arriving.join(sent(had.select("node", "block", *(F.col(w).alias(f"had {w}") for w in names)), n_arriving), ["node", "block"], "left")
            else:
                none = F.lit(0).cast("long")
                both = moved.select("node", "block", *names, *(none.alias(f"had {w}") for w in names)).unionByName(
                    log.rows().select("node", "block", *(none.alias(w) for w in names), *(F.col(w).alias(f"had {w}") for w in names)))
                both = both.groupBy("node", "block").agg(*(F.bit_or(c).alias(c) for c in (*names, *(f"had {w}" for w in names))))
            new = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"had {w}"), F.lit(0).cast("long")))).alias(w) for w in names]
            fresh, rows = log.add(both.select("node", "block", *new).where(" OR ".join(f"{w} <> 0" for w in names)))
            self.rounds.append(rows)
        self.one_block = n <= size
        self.bits, _ = cut(self._joined(log.rows()), "bits")

    def _joined(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("node", "block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(self.words)))

    def _listed(self, rows: DataFrame, *more: str) -> DataFrame:
        """(no, node, ..) of the bits of `rows`, no the subject's number."""
        word = rows.select("node", "block", *more, F.posexplode(F.array(*(f"w{j}" for j in range(self.words)))).alias("j", "w")).where("w <> 0")
        here = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("w"), i).bitwiseAND(F.lit(1)) != 0)
        return word.select("node", *more, (F.col("block") * (64 * self.words) + F.col("j") * 64).alias("first"), F.explode(here).alias("i")).select(
            (F.col("first") + F.col("i")).alias("no"), "node", *more)

    def _judged(self) -> DataFrame:
        """The bits with `exclusive`: whether only one subject reaches the task."""
        held = sum((F.bit_count(f"w{j}") for j in range(self.words)), F.lit(0)).cast("long")
        if self.one_block:
            return self.bits.withColumn("exclusive", held == 1)
        total = self.bits.groupBy("node").agg(F.sum(held).alias("total")).select("node", (F.col("total") == 1).alias("exclusive"))
        return self.bits.join(total, "node")

    def _named(self, listed: DataFrame) -> DataFrame:
        return listed.join(self.subjects, "no").join(grown(self.graph.nodes), "node").drop("no", "node")

    def reached(self) -> DataFrame:
        """(subject, run_id, task), entries included."""
        return self._named(self._listed(self.bits)).select("subject", *NODE).unionByName(self.alone)

    def radius(self) -> DataFrame:
        """(subject, run_id, task, exclusive): a task is exclusive when only one subject reaches it, which its bits say before any subject is listed."""
        named = self._named(self._listed(self._judged(), "exclusive")).select("subject", *NODE, "exclusive")
        return named.unionByName(blast_radius(self.alone).select("subject", *NODE, "exclusive"))

    def summary(self) -> DataFrame:
        """(subject, entry, affected, exclusive, shared): counted from the bits, no task is named."""
        counts = self._listed(self._judged(), "exclusive").groupBy("no").agg(
            F.count("*").alias("affected"), F.count_if("exclusive").alias("exclusive")).join(self.subjects, "no").drop("no")
        alone = blast_radius(self.alone).groupBy("subject").agg(F.count("*").alias("affected"), F.count_if("exclusive").alias("exclusive"))
        counts = counts.unionByName(alone).groupBy("subject").agg(F.sum("affected").alias("affected"), F.sum("exclusive").alias("exclusive"))
        starts = self.entered.groupBy("subject").agg(F.count("*").alias("entry"))
        return starts.join(counts, "subject").select("subject", "entry", "affected", "exclusive", (F.col("affected") - F.col("exclusive")).alias("shared"))


def reach(entries: DataFrame, edges: DataFrame, graph: Numbered | None = None) -> DataFrame:
    """
    Every (subject, run_id, task) reachable from `entries` of the same shape,
    entries included. `graph` is `numbered` of the edges, if at hand.
    """
    return Closure(entries, graph or numbered(edges)).reached()


def _bytes(number):
    """A number of eight bytes whose order is the number's."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


class Evidence:
    """
    One shortest chain from an entry to each reached task, the smallest in
    element order among the shortest. `rows` says who reached what, and after
    how many hops; `paths` puts the chains together, for those who show them.

    The smallest path to a task extends the smallest path to its predecessor,
    so a round needs no path but its rank among those of its level: `key`, the
    rank of the path `LEVELS` levels ago and the numbers of the tasks since,
    which are in the order of their names. Every `LEVELS` levels a distributed
    sort makes the keys ranks again. A round adds (level, task, predecessor);
    paths are put together once at the end, level by level.
    """

    def __init__(self, entries: DataFrame, graph: Numbered):
        keys = ["subject", *NODE]
        self.graph = graph
        entries = entries.select(keys).distinct()
        self.subjects, _ = _numbers(entries, "subject", "subjects")
        starts, _ = cut(graph.entered(entries).join(self.subjects, "subject"), "starts")
        log, level = RoundLog(entries.sparkSession, "levels", RoundLog.FOLD ** 2), 0
        fresh, rows = log.add(starts.where("node IS NOT NULL").select(
            "no", "node", F.lit(0).alias("hops"), F.lit(None).cast("long").alias("before"), _bytes("node").alias("key")))
        seen = rows
        while rows:
            level += 1
            moved = sent(fresh, rows).join(graph.forward, "node").groupBy("no", "next").agg(F.min(F.struct("key", "node")).alias("best"))
            moved, met = moved.withColumnRenamed("next", "node"), log.rows().select("no", "node")
            if rows * NARROW < seen:
                # Whether few tasks were met before is looked up for them alone, as in a closure.
                moved, n_moved = cut(moved, "moved")
                met = sent(met.join(sent(moved.select("no", "node"), n_moved), ["no", "node"], "left_semi"), n_moved)
            else:
                met = grown(met)
            moved = moved.join(met, ["no", "node"], "left_anti")
            moved = moved.select("no", "node", F.lit(level).alias("hops"), F.col("best.node").alias("before"), F.concat("best.key", _bytes("node")).alias("key"))
            if level % LEVELS == 0:
                moved, _ = cut(moved, "ranked")
                moved = moved.repartitionByRange("key").sortWithinPartitions("key").withColumn("key", _bytes(F.monotonically_increasing_id()))
            fresh, rows = log.add(moved)
            seen += rows
        self.levels, self.steps = level, log.rows().drop("key")
        self.alone = starts.where("node IS NULL").select("no", *NODE)

    @cached_property
    def _chains(self) -> DataFrame:
        return _paths(self.steps, self.graph.nodes, self.levels)

    def rows(self, paths: bool = False) -> tuple[DataFrame, DataFrame]:
        """
        (no, node, hops) of the tasks of the graph, and (no, run_id, task,
        hops) of those that stay alone, no the subject's number; both with
        their `path`, if asked.
        """
        alone = self.alone.withColumn("hops", F.lit(0))
        if not paths:
            return self.steps.select("no", "node", "hops"), alone
        return self._chains.select("no", "node", "hops", "path"), alone.withColumn("path", F.array("task"))

    def paths(self) -> DataFrame:
        """(subject, run_id, task, hops, path)"""
        columns = ["no", *NODE, "hops", "path"]
        return self._chains.select(columns).unionByName(self.rows(paths=True)[1].select(columns)).join(
            self.subjects, "no").select("subject", *columns[1:])


def evidence_paths(entries: DataFrame, edges: DataFrame, graph: Numbered | None = None) -> DataFrame:
    """
    (subject, run_id, task, hops, path): one shortest chain from an entry to
    each reached task, the smallest in element order among the shortest.
    Entries carry the path of themselves and hops 0.
    """
    return Evidence(entries, graph or numbered(edges)).paths()


def _paths(steps: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """
    (no, node, run_id, task, hops, path) of (no, node, hops, before): the paths of a level are those of the level before with a task more, so a path is
    written once and moved once, to what it leads to.
    """
    log = RoundLog(steps.sparkSession, "paths", RoundLog.FOLD ** 2)
    named = lambda level: steps.where(F.col("hops") == level).join(grown(nodes), "node")
    told, _ = log.add(named(0).select("no", "node", *NODE, "hops", F.array("task").alias("path")))
    for level in range(1, levels):
        head = told.select("no", F.col("node").alias("before"), F.col("path").alias("head"))
        told, _ = log.add(named(level).join(grown(head), ["no", "before"]).select("no", "node", *NODE, "hops", F.concat("head", F.array("task")).alias("path")))
    return log.rows()


def sole_subject(peers: DataFrame, edges: DataFrame, graph: Numbered | None = None) -> DataFrame:
    """
    (kind, run_id, task, subject) from `peers` of the same columns: which
    single subject of a kind reaches each task, NULL where several do.

    The same answer a closure over every peer would give, with one row per
    task instead of one per subject and task: a task is unreached, reached by
    one, or by several, so it changes at most twice.
    """
    keys = ["kind", "node"]
    graph = graph or numbered(edges)
    peers = peers.select("kind", *NODE, "subject").distinct()
    numbers, _ = _numbers(peers, "subject", "subjects")
    starts, _ = cut(graph.entered(peers).join(numbers, "subject"), "starts")

    def by_node(rows: DataFrame) -> DataFrame:
        # `several` is already known for some rows; otherwise two ends that differ show it.
        ends = rows.groupBy(keys).agg(F.min("no").alias("low"), F.max("no").alias("high"), F.max("several").alias("known"))
        several = F.col("known") | (F.col("low") != F.col("high"))
        return ends.select(*keys, F.when(~several, F.col("low")).alias("no"), several.alias("several"))

    log = RoundLog(edges.sparkSession, "sole")
    fresh, rows = log.add(by_node(starts.where("node IS NOT NULL").select(*keys, "no").withColumn("several", F.lit(False))))
    seen = rows
    while rows:
        arriving = by_node(sent(fresh, rows).join(graph.forward, "node").drop("node").withColumnRenamed("next", "node"))
        known, most = log.rows(), seen
        if rows * NARROW < seen:
            # What few tasks had is looked up for them alone, as in a closure.
            arriving, most = cut(arriving, "arriving")
            known = known.join(sent(arriving.select(keys), most), keys, "left_semi")
        told = by_node(known).select(
            *keys, F.col("no").alias("was"), F.col("several").alias("was_several"))
        unmet = F.col("was_several").isNull()
        changed = (
            arriving.join(sent(told, most), keys, "left")
            .where(unmet | (~F.col("was_several") & (F.col("several") | (F.col("no") != F.col("was")))))
            .select(*keys, F.when(unmet, F.col("no")).alias("no"), (~unmet | F.col("several")).alias("several"))
        )
        fresh, rows = log.add(changed)
        seen += rows
    ended = by_node(log.rows()).join(grown(graph.nodes), "node").join(numbers, "no", "left").select("kind", *NODE, "subject")
    alone = starts.where("node IS NULL").groupBy("kind", *NODE).agg(
        F.when(F.min("subject") == F.max("subject"), F.min("subject")).alias("subject"))
    return ended.unionByName(alone)


def blast_radius(reached: DataFrame) -> DataFrame:
    """
    (subject, run_id, task, exclusive) from a closure over every subject: a
    task is exclusive when only one subject reaches it. Two subjects show as a
    smallest and a largest that differ, so no set is built.
    """
    ends = reached.groupBy(NODE).agg((F.min("subject") == F.max("subject")).alias("exclusive"))
    return reached.join(ends, NODE)


def reach_summary(entries: DataFrame, radius: DataFrame) -> DataFrame:
    """Entry, affected, exclusive and shared counts per subject."""
    starts = entries.select("subject", *NODE).distinct().groupBy("subject").agg(F.count("*").alias("entry"))
    counts = radius.groupBy("subject").agg(
        F.count("*").alias("affected"), F.count_if("exclusive").alias("exclusive"),
        F.count_if(~F.col("exclusive")).alias("shared"))
    return starts.join(counts, "subject", "left").na.fill(0, ["affected", "exclusive", "shared"])


def untouched(tasks: DataFrame, reached: DataFrame) -> DataFrame:
    """Tasks no subject reached."""
    return tasks.join(reached.select(NODE).distinct(), NODE, "left_anti")


def files_of(radius: DataFrame, outputs: DataFrame) -> DataFrame:
    """(subject, scope, run_id, file): 'task/file' for everything the exclusive and shared tasks wrote."""
    return radius.join(outputs, NODE).select(
        "subject", F.when(F.col("exclusive"), "exclusive").otherwise("shared").alias("scope"),
        "run_id", F.concat_ws("/", "task", "file").alias("file"))


def first_files(files: DataFrame, most: int) -> DataFrame:
    """The first `most` files of each subject and scope in name order, for a report, beside the total."""
    from pyspark.sql import Window

    order = Window.partitionBy("subject", "scope", "run_id").orderBy("file")
    totals = files.groupBy("subject", "scope", "run_id").agg(F.count("*").alias("total"))
    return files.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).join(totals, ["subject", "scope", "run_id"])
