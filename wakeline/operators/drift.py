"""
Where two runs of a workflow part ways, and why, for many pairs of runs.

What one run says about a task (what it read, what it wrote, what fed it) is
worked out once per run, however many pairs the run is in; a pair then joins
rows of one per task. Lists of digests are compared as fixed-width bags, so a
task or a name with very many rows is summed before the shuffle and never
gathered. What a reader wants listed (changed files, changed inputs, tasks
followed) comes as rows of its own. Digests are moved as two numbers each
(`words`), never as texts, and pairs of the same two runs are compared once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.digests import bag, bag_of, recorded, words
from wakeline.functions.text import basename, ignored, short_process
from wakeline.operators.graph import EXTERNAL, NODE
from wakeline.session import cut

# Output names that are bookkeeping, and the bag of nothing.
BOOKKEEPING = ("versions.yml",)
EMPTY_BAG = "0:0:0:0:0"
UNPAIRED = "ambiguous name"

PAIR = ["pair_id", "task"]


def sides(pairs: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A run-keyed table as the before and the after side of every pair."""
    return tuple(
        table.join(pairs.select("pair_id", F.col(f"{side}_run").alias("run_id")), "run_id").drop("run_id")
        for side in ("before", "after"))


def refused_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of one resume session: both names load one graph, so comparing them says nothing."""
    return pairs.where(F.col("before_session") == F.col("after_session"))


def one_each(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """
    (pairs, members): one pair of each two runs in that order, and (pair_id,
    member) which pairs it answers for. A pair_id that comes more than once
    answers for itself alone, with all its rows.
    """
    once = pairs.groupBy("pair_id").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("before_run", "after_run"))).where("n = 1")
    first = once.groupBy("before_run", "after_run").agg(F.min("pair_id").alias("first"))
    same = once["before_run"].eqNullSafe(first["before_run"]) & once["after_run"].eqNullSafe(first["after_run"])
    others = pairs.join(once.select("pair_id"), "pair_id", "left_anti").select("pair_id").distinct()
    members, _ = cut(once.join(first, same).select(F.col("first").alias("pair_id"), F.col("pair_id").alias("member")).unionByName(
        others.withColumn("member", F.col("pair_id"))), "drift-members")
    return pairs.join(members.select("pair_id").distinct(), "pair_id", "left_semi"), members


def told_to(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of a pair for each pair it answers for."""
    return rows.join(members, "pair_id").select(*(F.col("member").alias(c) if c == "pair_id" else F.col(c) for c in rows.columns))


def _worded(digest) -> list:
    return [word.alias(name) for word, name in zip(words(digest), ("high", "low"))]


def output_digest_lookup(outputs: DataFrame) -> DataFrame:
    """
    (run_id, producer, name, high, low): a producer's digest, as its words,
    under a file's full name, else under its basename. The last record of a
    full name and the first of a basename count.
    """
    known = outputs.where(recorded(F.col("digest")))
    # One number orders them: full names below basenames, records without a place first.
    place, far = F.col("file_ix").cast("bigint"), 1 << 61
    own = ["run_id", F.col("task").alias("producer")]
    full = known.select(*own, F.col("file").alias("name"), *_worded("digest"), (F.coalesce(-place, F.lit(-far)) - far).alias("pick"))
    base = known.where(F.contains("file", F.lit("/"))).select(
        *own, basename(F.col("file")).alias("name"), *_worded("digest"), (F.coalesce(place, F.lit(-far)) + far + 1).alias("pick"))
    return full.unionByName(base).groupBy("run_id", "producer", "name").agg(*(F.min_by(c, "pick").alias(c) for c in ("high", "low")))


def input_digests(edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """
    (run_id, task, high, low): one row per input of each task, its digest as
    `words`, NULL where nobody recorded one. Inputs that bring their digest
    are not looked up, and only names with a folder are looked up twice.
    """
    lookup = output_digest_lookup(outputs)
    whose = ["run_id", F.col("consumer").alias("task")]
    brings = F.coalesce(recorded(F.col("digest")), F.lit(False))
    asks = edges.where(~brings).select(*whose, "producer", F.col("filename").alias("name"), basename(F.col("filename")).alias("base"))
    filed = F.coalesce(F.col("base") != F.col("name"), F.lit(False))
    key = ["run_id", "producer", "name"]
    found = ["run_id", "task", "high", "low"]
    rows = edges.where(brings).select(*whose, *_worded("digest")).unionByName(asks.where(~filed).join(lookup, key, "left").select(found))
    deep, n = cut(asks.where(filed), "drift-folders")
    if not n:
        return rows
    by_base = lookup.select("run_id", "producer", F.col("name").alias("base"), F.col("high").alias("high_2"), F.col("low").alias("low_2"))
    deep = deep.join(lookup, key, "left").join(by_base, ["run_id", "producer", "base"], "left")
    return rows.unionByName(deep.select("run_id", "task", *(F.coalesce(c, f"{c}_2").alias(c) for c in ("high", "low"))))


def input_signature(edges: DataFrame, outputs: DataFrame, wanted: DataFrame) -> DataFrame:
    """
    (run_id, task, inputs): the bag of digests each wanted task consumed, NULL
    when any input lacks one and the empty bag when it consumed nothing.
    """
    bags = input_digests(edges, outputs).groupBy(NODE).agg(
        F.when(F.count("high") == F.count(F.lit(1)), bag_of(F.col("high"), F.col("low"))).alias("inputs"), F.lit(True).alias("fed"))
    return wanted.select(NODE).join(bags, NODE, "left").select(
        *NODE, F.when(F.col("fed"), F.col("inputs")).otherwise(F.lit(EMPTY_BAG)).alias("inputs"))


def pair_tasks(pairs: DataFrame, tasks: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """
    (pair_id, name, before, after, note) for pairs of runs of these tables.

    Unique names pair by name. Repeated names pair where one task on each side
    has the same input signature; one leftover on each side pairs by
    elimination; the rest stays unpaired and says so.
    """
    pairs, members = one_each(pairs)
    return told_to(_paired(pairs, tasks, edges, outputs), members)


def _paired(pairs: DataFrame, tasks: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    name = ["pair_id", "name"]
    live = tasks.where(~F.coalesce(F.col("superseded"), F.lit(False))).select(*NODE, F.coalesce("name", F.lit("")).alias("name"))
    b, a = sides(pairs, live)
    nb, na = sides(pairs, live.groupBy("run_id", "name").agg(F.count("*").alias("n")))
    counts = nb.withColumnRenamed("n", "nb").join(na.withColumnRenamed("n", "na"), name, "full").na.fill(0, ["nb", "na"])
    counts, _ = cut(counts, "drift-names")
    repeated = counts.where((F.col("nb") > 1) | (F.col("na") > 1)).select(*name)

    # Which task of a run alone has a name and inputs is the run's to say, not the pair's.
    ends = pairs.select("pair_id", F.explode(F.array("before_run", "after_run")).alias("run_id")).distinct()
    asked = live.join(ends.join(repeated, "pair_id").select("run_id", "name").distinct(), ["run_id", "name"], "left_semi")
    asked, _ = cut(asked, "drift-asked")
    signed = asked.join(input_signature(edges, outputs, asked), NODE).where("inputs IS NOT NULL")
    signed = signed.select(*NODE, "name", *_worded("inputs"))
    alone, _ = cut(signed.groupBy("run_id", "name", "high", "low").agg(F.count("*").alias("n"), F.min("task").alias("task")).where("n = 1").drop("n"), "drift-alone")
    one_b, one_a = sides(pairs, alone)
    signed, _ = cut(one_b.withColumnRenamed("task", "before").join(one_a.withColumnRenamed("task", "after"), [*name, "high", "low"]).join(
        repeated, name, "left_semi").select(*name, "before", "after"), "drift-signed")

    left_b = b.join(signed.select("pair_id", F.col("before").alias("task")), PAIR, "left_anti")
    left_a = a.join(signed.select("pair_id", F.col("after").alias("task")), PAIR, "left_anti")
    left = (
        left_b.groupBy(name).agg(F.count("*").alias("lb"), F.min("task").alias("one_b"))
        .join(left_a.groupBy(name).agg(F.count("*").alias("la"), F.min("task").alias("one_a")), name, "full")
        .na.fill(0, ["lb", "la"]).join(counts, name))
    settled = (F.col("lb") == 1) & (F.col("la") == 1)
    note = F.when((F.col("nb") > 1) | (F.col("na") > 1), F.lit(UNPAIRED))
    none = F.lit(None).cast("string")
    return (
        signed.withColumn("note", none)
        .unionByName(left.where(settled).select(*name, F.col("one_b").alias("before"), F.col("one_a").alias("after"), none.alias("note")))
        .unionByName(left_b.join(left.where(~settled), name).select(*name, F.col("task").alias("before"), none.alias("after"), note.alias("note")))
        .unionByName(left_a.join(left.where(~settled), name).select(*name, none.alias("before"), F.col("task").alias("after"), note.alias("note")))
    )


def written_files(outputs: DataFrame, ignore=BOOKKEEPING) -> DataFrame:
    """
    (run_id, task, file, high, low) after ignore globs, the digest as its
    words; the last record of a file counts.
    """
    rows = outputs.where(~ignored(F.col("file"), ignore)).select(*NODE, "file", "file_ix", *_worded("digest"))
    return rows.groupBy(*NODE, "file").agg(*(F.max_by(c, "file_ix").alias(c) for c in ("high", "low")))


def output_signature(outputs: DataFrame, ignore=BOOKKEEPING) -> DataFrame:
    """(run_id, task, outputs): the bag of (file, digest) after ignore globs, NULL if any lacks a digest."""
    rows = outputs.where(~ignored(F.col("file"), ignore))
    named = [word.alias(name) for word, name in zip(words(F.concat_ws("\n", "file", "digest")), ("high", "low"))]
    rows = rows.select(*NODE, "file", "file_ix", recorded(F.col("digest")).alias("known"), *named)
    last = rows.groupBy(*NODE, "file").agg(*(F.max_by(c, "file_ix").alias(c) for c in ("known", "high", "low")))
    return last.groupBy(NODE).agg(F.when(
        F.count_if("known") == F.count(F.lit(1)), bag_of(F.col("high"), F.col("low"))).alias("outputs"), F.lit(True).alias("wrote"))


def external_inputs(edges: DataFrame) -> DataFrame:
    """(run_id, task, filename, high, low) of outside inputs, the digest as its words; the last edge of a name counts."""
    outside = edges.where(F.col("producer") == EXTERNAL).select("run_id", F.col("consumer").alias("task"), "filename", "edge_ix", *_worded("digest"))
    return outside.groupBy(*NODE, "filename").agg(*(F.max_by(c, "edge_ix").alias(c) for c in ("high", "low")))


def _by_end(rows: DataFrame, side: str, **names: str) -> DataFrame:
    """Rows of a run's tasks, as rows of a pair's one side."""
    return rows.select(F.col("run_id").alias(f"{side}_run"), F.col("task").alias(side), *(F.col(old).alias(new) for old, new in names.items()))


class Drift:
    """`items`: one row per task of either run. The rest lists what its counts count. Each is worked out when it is asked for."""

    KEYS = {side: [f"{side}_run", side] for side in ("before", "after")}

    def __init__(self, pairs: DataFrame, tasks: DataFrame, edges: DataFrame, outputs: DataFrame, ignore):
        runs = pairs.select(F.explode(F.array("before_run", "after_run")).alias("run_id")).distinct()
        self.pairs, self.members = one_each(pairs)
        self.tasks, self.edges, self.outputs = (t.join(runs, "run_id", "left_semi") for t in (tasks, edges, outputs))
        self.ignore = ignore
        self.base = self._base()

    def _base(self) -> DataFrame:
        """(pair_id, before_run, after_run, name, before, after, task, state)"""
        paired = _paired(self.pairs, self.tasks, self.edges, self.outputs).join(self.pairs.select("pair_id", "before_run", "after_run"), "pair_id")
        signed = output_signature(self.outputs, self.ignore).select(*NODE, *_worded("outputs"), "wrote")
        signed, _ = cut(signed, "drift-outputs")
        for side in ("before", "after"):
            named = {c: f"{c}_{side}" for c in ("high", "low", "wrote")}
            paired = paired.join(_by_end(signed, side, **named), self.KEYS[side], "left")
        # A task that wrote nothing has the empty bag; one that wrote something without a digest has none.
        empty = words(F.lit(EMPTY_BAG))
        was, now = ([F.when(F.col(f"wrote_{side}"), F.col(f"{c}_{side}")).otherwise(e) for c, e in zip(("high", "low"), empty)] for side in ("before", "after"))
        state = (
            F.when(F.col("note").isNotNull(), "UNPAIRED").when(F.col("before").isNull(), "ADDED")
            .when(F.col("after").isNull(), "REMOVED").when(was[0].isNull() | now[0].isNull(), "NODIGEST")
            .when((was[0] != now[0]) | (was[1] != now[1]), "DIFF").otherwise("SAME"))
        return cut(paired.select("pair_id", "before_run", "after_run", "name", "before", "after", F.coalesce("after", "before").alias("task"), state.alias("state")), "drift-base")[0]

    @property
    def _diff(self) -> DataFrame:
        return self.base.where(F.col("state") == "DIFF").select("pair_id", "before_run", "after_run", "before", "after")

    def _changed(self, rows: DataFrame, name: str) -> DataFrame:
        """(pair_id, after, `name`): what a task that differs has after, with another digest than before or none before."""
        before = _by_end(rows, "before", **{name: name, "high": "high_before", "low": "low_before"})
        same = F.col("high").eqNullSafe(F.col("high_before")) & F.col("low").eqNullSafe(F.col("low_before"))
        return (
            self._diff.join(_by_end(rows, "after", **{name: name, "high": "high", "low": "low"}), self.KEYS["after"])
            .join(before, [*self.KEYS["before"], name], "left").where(~same).select("pair_id", "after", name))

    @cached_property
    def _inputs(self) -> DataFrame:
        return self._changed(cut(external_inputs(self.edges), "drift-outside")[0], "filename")

    @cached_property
    def _upstream(self) -> DataFrame:
        """Producers of the after run that differ, or that could not be compared."""
        troubled = self.base.where(F.col("after").isNotNull() & F.col("state").isin("DIFF", "NODIGEST", "UNPAIRED")).select(
            "pair_id", "after_run", F.col("after").alias("producer"), (F.col("state") == "DIFF").alias("differs"))
        # Dealt by producer at once, so that telling edges apart and meeting their producers is one shuffle.
        fed = F.col("producer").isNotNull() & (F.col("producer") != EXTERNAL) & (F.col("producer") != F.col("consumer"))
        feeds = self.edges.where(fed).select(F.col("run_id").alias("after_run"), "producer", F.col("consumer").alias("after")).repartition("after_run", "producer").distinct()
        compared = self.base.where(F.col("state").isin("SAME", "DIFF")).select("pair_id", "after", "state")
        return cut(troubled.join(feeds, ["after_run", "producer"]).drop("after_run").join(compared, ["pair_id", "after"]), "drift-upstream")[0]

    @property
    def _met(self) -> DataFrame:
        return self._upstream.groupBy("pair_id", "after").agg(
            F.count_if("differs").alias("n_differ"), F.count_if(~F.col("differs")).alias("n_unknown"))

    def _causes(self) -> DataFrame:
        tb, ta = sides(self.pairs, self.tasks)
        changed = self._inputs.groupBy("pair_id", "after").agg(
            F.count("*").alias("inputs_changed"), F.min("filename").alias("first_input"), bag(F.col("filename")).alias("inputs_key"))
        recipe = lambda t, side: t.select(
            "pair_id", F.col("task").alias(side), *[F.coalesce(c, F.lit("")).alias(f"{c}_{side}") for c in ("container", "script")])
        causes = (
            self._diff.select("pair_id", "before", "after").join(recipe(tb, "before"), ["pair_id", "before"]).join(recipe(ta, "after"), ["pair_id", "after"])
            .join(changed, ["pair_id", "after"], "left"))
        shown = lambda c: F.when(F.col(c) == "", "?").otherwise(F.col(c))
        return causes.select(
            "pair_id", "after", "inputs_changed", "first_input", "inputs_key",
            F.when(F.col("inputs_changed") > 0, "input")
            .when(F.col("container_before") != F.col("container_after"),
                  F.concat(F.lit("container: "), shown("container_before"), F.lit(" -> "), shown("container_after")))
            .when(F.col("script_before") != F.col("script_after"), "script")
            .otherwise("unexplained").alias("why"))

    @cached_property
    def items(self) -> DataFrame:
        verdict = (
            F.when(F.col("state").isin("UNPAIRED", "NODIGEST"), "UNVERIFIED").when(F.col("state") == "SAME", "REPRODUCED")
            .when(F.col("state") != "DIFF", F.col("state")).when(F.col("n_differ") > 0, "DOWNSTREAM")
            .when(F.col("n_unknown") > 0, "UNSETTLED").otherwise("DRIFTED"))
        rooted = F.col("verdict") == "DRIFTED"
        cause = (
            F.when(rooted, F.col("why")).when(F.col("state") == "UNPAIRED", UNPAIRED)
            .when(F.col("state") == "NODIGEST", "output without digest")
            .when(F.col("verdict") == "DOWNSTREAM", "upstream drifted")
            .when(F.col("verdict") == "UNSETTLED", "upstream unverified")
            .when(F.col("verdict") == "REPRODUCED", "equal digests")
            .when(F.col("verdict") == "ADDED", "only after")
            .otherwise("only before"))
        judged = self.base.join(self._met, ["pair_id", "after"], "left").na.fill(0, ["n_differ", "n_unknown"]).join(
            self._causes(), ["pair_id", "after"], "left").withColumn("verdict", verdict)
        items = judged.select(
            *PAIR, "name", "before", "after", "verdict", cause.alias("cause"),
            F.when(F.col("state") == "DIFF", F.when(F.col("n_differ") > 0, F.col("n_differ")).otherwise(F.col("n_unknown")))
            .when(F.col("state") == "SAME", F.col("n_differ")).otherwise(F.lit(0)).alias("n_follows"),
            *[F.when(rooted, F.col(c)).alias(c) for c in ("inputs_changed", "first_input", "inputs_key")])
        tb, ta = sides(self.pairs, self.tasks)
        about = lambda t: t.select(*PAIR, "process", "target")
        after_rows = items.where("after IS NOT NULL").join(about(ta), PAIR, "left")
        before_rows = items.where("after IS NULL").join(about(tb), PAIR, "left")
        return told_to(after_rows.unionByName(before_rows), self.members)

    @cached_property
    def files(self) -> DataFrame:
        """(pair_id, task, file): outputs that differ"""
        return told_to(self._changed(written_files(self.outputs, self.ignore), "file").withColumnRenamed("after", "task"), self.members)

    @cached_property
    def follows(self) -> DataFrame:
        """(pair_id, task, producer): a task that differs follows its drifted producers, or failing those its unverified ones"""
        follows = self._upstream.join(self._met, ["pair_id", "after"]).where(
            F.col("differs") | ((F.col("state") == "DIFF") & (F.col("n_differ") == 0)))
        return told_to(follows.select("pair_id", F.col("after").alias("task"), "producer"), self.members)

    @cached_property
    def inputs(self) -> DataFrame:
        """(pair_id, task, filename): outside inputs whose digest changed"""
        return told_to(self._inputs.withColumnRenamed("after", "task"), self.members)


def drift(pairs: DataFrame, tasks: DataFrame, edges: DataFrame, outputs: DataFrame, ignore=BOOKKEEPING) -> Drift:
    """
    The verdict of every task in every pair of runs.

    No recursion is needed: a task whose outputs differ is never anything but
    drifted, downstream or unsettled, and all three weigh the same on what
    they feed, so looking at the direct producers settles it.
    """
    return Drift(pairs, tasks, edges, outputs, ignore)


def drift_summary(items: DataFrame) -> DataFrame:
    """Tasks per pair and verdict."""
    return items.groupBy("pair_id", "verdict").agg(F.count("*").alias("tasks"))


def drift_by_cause(items: DataFrame) -> DataFrame:
    """
    Tasks per verdict, cause and process. Roots with the same set of changed
    inputs share `inputs_key`, and `first_input` names one of them.
    """
    return items.groupBy("pair_id", "verdict", "cause", "inputs_key", short_process(F.col("process")).alias("process")).agg(
        F.count("*").alias("tasks"), F.min("first_input").alias("first_input"), F.min("inputs_changed").alias("inputs_changed"))


def coverage_of(coverage: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, note): every coverage note of either run, once."""
    b, a = sides(pairs, coverage.select("run_id", "note"))
    return b.unionByName(a).distinct()
