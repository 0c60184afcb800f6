"""
Which stored task directories are provably redundant.

What is on storage comes as listings, tables of paths: `work` (run_id, path,
size, links, inode, is_dir) of the work tree and `results` (run_id, path, size,
inode, link_target) of the published tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.digests import recorded, short
from wakeline.functions.text import ancestors, basename, ignored, short_process
from wakeline.operators.drift import BOOKKEEPING
from wakeline.operators.graph import EXTERNAL, NODE, forward_edges
from wakeline.operators.triggers import normalise_status
from wakeline.session import RoundLog, cut

REMOVABLE = ("REDUNDANT", "SUPERSEDED", "FAILED", "INTERMEDIATE")


# -------------------------------------------------------- placing directories

def relative_workdir(tasks: DataFrame) -> DataFrame:
    """
    (run_id, task, rel): the directory under the engine's root, NULL when the
    record cannot place it. The extractor's workpath answers; else the last two
    parts of the work directory, where they follow the hashed layout.
    """
    parts = F.filter(F.split(F.coalesce("workdir", F.lit("")), "/"), lambda p: p != "")
    head, rest = F.substring_index("task", "/", 1), F.expr("substring(task, instr(task, '/') + 1)")
    hashed = (F.instr("task", "/") > 0) & ~F.contains(rest, F.lit("/")) & (F.size(parts) >= 2) & (
        F.try_element_at(parts, F.lit(-2)) == head) & F.startswith(F.try_element_at(parts, F.lit(-1)), rest)
    placed = F.when(F.coalesce("workpath", F.lit("")) != "", F.col("workpath")).when(
        hashed, F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))))
    return tasks.select(*NODE, placed.alias("rel"))


def resolve_workpaths(tasks: DataFrame, work: DataFrame) -> DataFrame:
    """
    (run_id, task, rel, on_disk, why): rel NULL where the directory cannot be
    told: `unplaced`, `shared` by several tasks, or `wrong root` where none of
    a run's directories exists, which says the root is wrong and not that the
    run is gone.
    """
    placed = relative_workdir(tasks)
    owners = placed.where("rel IS NOT NULL").groupBy("run_id", "rel").agg(F.count("*").alias("owners"))
    dirs = work.where("is_dir").select("run_id", F.col("path").alias("rel"), F.lit(True).alias("found")).distinct()
    seen = owners.where("owners = 1").join(dirs, ["run_id", "rel"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    runs = seen.groupBy("run_id").agg(F.max("found").alias("right_root"))
    known = placed.join(owners, ["run_id", "rel"], "left").join(dirs, ["run_id", "rel"], "left").join(runs, "run_id", "left")
    why = (F.when(F.col("rel").isNull(), "unplaced").when(F.col("owners") > 1, "shared")
           .when(~F.coalesce("right_root", F.lit(True)), "wrong root"))
    return known.withColumn("why", why).select(
        *NODE, F.when(F.col("why").isNull(), F.col("rel")).alias("rel"),
        (F.col("why").isNull() & F.coalesce("found", F.lit(False))).alias("on_disk"), "why")


def placement_warnings(tasks: DataFrame, resolved: DataFrame) -> DataFrame:
    """(run_id, why, tasks, directories) for shared directories and wrong roots."""
    named = resolved.where("why IN ('shared', 'wrong root')").select(*NODE, "why").join(relative_workdir(tasks), NODE)
    return named.groupBy("run_id", "why").agg(F.count("*").alias("tasks"), F.count_distinct("rel").alias("directories"))


def storage_state(resolved: DataFrame) -> DataFrame:
    """(run_id, task, storage): WRITABLE if found, DESTROYED if looked for and absent, NULL if not placed."""
    return resolved.select(*NODE, F.when(F.col("rel").isNull(), F.lit(None)).when(F.col("on_disk"), "WRITABLE")
                           .otherwise("DESTROYED").alias("storage"))


def folder_bytes(files: DataFrame) -> DataFrame:
    """
    (run_id, rel, bytes) of every folder that holds one of `files` (run_id,
    path, size) at any depth. Files are summed by their folder first; then, from
    the deepest level up, a folder hands its total to the one above it, so a
    folder is written once, however deep its files lie.
    """
    parent = lambda path: F.regexp_replace(path, "/[^/]*$", "")
    depth = lambda path: F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    own = files.where(F.contains("path", F.lit("/"))).groupBy("run_id", parent(F.col("path")).alias("rel")).agg(F.sum("size").alias("bytes"))
    own, n = cut(own.withColumn("depth", depth(F.col("rel"))), "folders")
    log, above = RoundLog(files.sparkSession, "folder-bytes"), None
    # One row: the deepest level.
    for level in range(own.agg(F.max("depth")).first()[0] if n else -1, -1, -1):
        here = own.where(F.col("depth") == level).select("run_id", "rel", "bytes")
        if above is not None:
            here = here.unionByName(above).groupBy("run_id", "rel").agg(F.sum("bytes").alias("bytes"))
        here, _ = log.add(here)
        above = here.select("run_id", parent(F.col("rel")).alias("rel"), "bytes")
    return log.rows() if n else own.select("run_id", "rel", "bytes")


def dir_bytes(resolved: DataFrame, work: DataFrame, object_store: bool = False) -> DataFrame:
    """
    (run_id, task, bytes) freed by removing each directory: files with one
    link and no symlink; on an object store every object. A file counts for
    every directory above it.
    """
    files = work.where("NOT is_dir")
    if not object_store:
        files = files.where((F.col("links") == 1) & F.col("link_target").isNull())
    sizes = folder_bytes(files.select("run_id", "path", "size"))
    return resolved.where("on_disk").join(sizes, ["run_id", "rel"], "left").select(
        *NODE, F.coalesce("bytes", F.lit(0)).alias("bytes"))


# ------------------------------------------------------------ published copies

def published_copies_by_digest(outputs: DataFrame, published: DataFrame, resolved: DataFrame,
                               work: DataFrame, results: DataFrame | None) -> DataFrame:
    """
    (run_id, task, file, path, held): every published copy that bears on an
    output, by digest. Copies with the output's own name count before others.
    `held` is digest, hardlink, symlink, changed, missing, or unverified where
    the results were not listed.
    """
    known = outputs.where(recorded(F.col("digest"))).select(*NODE, "file", short(F.col("digest")).alias("digest"))
    copies = published.where(recorded(F.col("digest"))).select("run_id", short(F.col("digest")).alias("digest"), "path", F.col("size").alias("digested_size"))
    # Most outputs are published nowhere; what follows moves the others alone.
    by_digest = ["run_id", "digest"]
    known, _ = cut(known.join(copies.select(by_digest).distinct(), by_digest, "left_semi"), "published-outputs")
    # By digest and name first: a digest that many outputs and copies share meets itself only where no name agrees.
    known, copies = known.withColumn("name", basename(F.col("file"))), copies.withColumn("name", basename(F.col("path")))
    met, _ = cut(known.join(copies.withColumn("met", F.lit(True)), [*by_digest, "name"], "left").drop("name"), "copies-by-name")
    columns = [*NODE, "file", "path", "digested_size"]
    others = met.where("met IS NULL").drop("path", "digested_size").join(copies.drop("name"), by_digest)
    found, _ = cut(met.where("met").select(columns).unionByName(others.select(columns)), "copies-found")
    if results is None:
        return found.select(*NODE, "file", "path", F.lit("unverified").alias("held"))
    inodes = work.where("NOT is_dir").select("run_id", F.col("path").alias("work_path"), F.col("inode").alias("work_inode"))
    listed = results.select("run_id", "path", "size", "inode", "link_target", F.lit(True).alias("there"))
    placed = found.join(resolved.select(*NODE, "rel"), NODE).withColumn("work_path", F.concat_ws("/", "rel", "file"))
    held = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("link_target") == F.col("work_path"), "symlink")
        .when(F.col("link_target").isNull() & (F.col("inode") == F.col("work_inode")), "hardlink")
        .when(F.col("digested_size") != F.col("size"), "changed").otherwise("digest"))
    return (
        placed.join(listed, ["run_id", "path"], "left").join(inodes, ["run_id", "work_path"], "left")
        .select(*NODE, "file", "path", held.alias("held")))


def copy_verdicts(copies: DataFrame) -> DataFrame:
    """
    (run_id, task, file, verdict, copies): how the published tree holds each
    output: digest or hardlink when any copy stands, else changed, else symlink.
    """
    held = F.col("held")
    stands = held.isin("digest", "hardlink")
    verdict = (
        F.when(F.max(stands), F.min_by(F.when(stands, held), F.when(stands, F.col("path"))))
        .when(F.max(held == "changed"), "changed").when(F.max(held == "symlink"), "symlink")
        .when(F.max(held == "unverified"), "unverified").otherwise("none"))
    return copies.groupBy(*NODE, "file").agg(verdict.alias("verdict"), F.count_if(held != "missing").alias("copies"))


# ---------------------------------------------------------------- recompute

def consumed_outputs(edges: DataFrame) -> DataFrame:
    """(run_id, task, file): outputs some other task reads."""
    return edges.where(F.col("producer").isNotNull() & (F.col("producer") != EXTERNAL) & (F.col("producer") != F.col("consumer"))).select(
        "run_id", F.col("producer").alias("task"), F.col("filename").alias("file")).distinct()


def loose_outputs(outputs: DataFrame, edges: DataFrame) -> DataFrame:
    """Outputs no edge consumes."""
    return outputs.join(consumed_outputs(edges), [*NODE, "file"], "left_anti")


def recomputable(tasks: DataFrame, edges: DataFrame, resolved: DataFrame, present: DataFrame) -> DataFrame:
    """
    (run_id, task, recomputable, why): whether a task could be run again from
    what is on disk: recipe recorded, outside inputs present (`present` is
    (run_id, target) found at its recorded place), and every gone producer
    itself recomputable. A loop of gone producers is not. `why` names the
    first failing input in the order of the task's edges.

    Tasks settle from the leaves: a blocked task blocks the consumers that
    need it, and a task is good once all its gone producers are good. What
    never settles is part of a loop. A round touches only the consumers of
    what settled in the round before: each keeps a counter of the answers it
    still waits for, so earlier rounds are not read again.
    """
    local = F.regexp_replace(F.substring_index("target", "#", 1), "^file://", "")
    remote = F.contains("target", F.lit("://")) & ~F.startswith("target", F.lit("file://"))
    own = edges.where(F.coalesce("producer", F.lit(EXTERNAL)) != F.col("consumer"))
    outside = own.where(F.coalesce("producer", F.lit(EXTERNAL)) == EXTERNAL).select(
        "run_id", F.col("consumer").alias("task"), "edge_ix", F.coalesce("target", F.lit("")).alias("target"))
    outside = outside.withColumn("remote", remote).withColumn("place", local).join(
        present.select("run_id", F.col("target").alias("place"), F.lit(True).alias("there")).distinct(), ["run_id", "place"], "left")
    name = basename(F.col("place"))
    missing = outside.where(F.col("remote") | F.col("there").isNull()).select(*NODE, "edge_ix", F.when(
        F.col("remote"), F.concat(F.lit("remote-input:"), name)).otherwise(F.concat(F.lit("absent-input:"), F.when(name == "", "?").otherwise(name))).alias("code"))
    dangling = own.where(F.col("producer") != EXTERNAL).join(
        tasks.select("run_id", F.col("task").alias("producer")), ["run_id", "producer"], "left_anti").select(
        "run_id", F.col("consumer").alias("task"), "edge_ix", F.lit("unknown-producer").alias("code"))
    failing, _ = cut(missing.unionByName(dangling), "failing-inputs")
    needs = own.join(resolved.where("NOT on_disk").select("run_id", F.col("task").alias("producer")), ["run_id", "producer"]).select(
        "run_id", F.col("consumer").alias("task"), "producer", "edge_ix")
    recipe = (F.coalesce("script", F.lit("")) != "") & (F.coalesce("container", F.lit("")) != "")
    start, _ = cut(tasks.select(*NODE, recipe.alias("recipe")).join(
        failing.select(NODE).distinct().withColumn("fails", F.lit(True)), NODE, "left").select(
        *NODE, "recipe", (F.col("recipe") & F.col("fails").isNull()).alias("may")), "recompute-start")
    pairs = needs.select(*NODE, "producer").distinct().join(start.where("may").select(NODE), NODE)
    waits, _ = cut(pairs.join(pairs.groupBy(NODE).agg(F.count("*").alias("waiting")), NODE), "waits")

    log = RoundLog(edges.sparkSession, "recompute")
    idle = start.join(waits.select(NODE).distinct(), NODE, "left_anti")
    fresh, rows = log.add(idle.select(*NODE, F.col("may").alias("good")))
    waiting_on, sums = None, [F.max("waiting").alias("waiting"), F.sum("came").alias("came"), F.sum("stop").alias("stop"), F.max("done").alias("done")]
    while rows:
        arrived = fresh.select("run_id", F.col("task").alias("producer"), "good").join(waits, ["run_id", "producer"])
        step = arrived.select(*NODE, "waiting", F.col("good").cast("int").alias("came"), (~F.col("good")).cast("int").alias("stop"), F.lit(False).alias("done"))
        if waiting_on is not None:
            step = step.unionByName(waiting_on)
        step, _ = cut(step.groupBy(NODE).agg(*sums), "answers")
        settles = ~F.col("done") & ((F.col("stop") > 0) | (F.col("came") == F.col("waiting")))
        fresh, rows = log.add(step.where(settles).select(*NODE, (F.col("stop") == 0).alias("good")))
        waiting_on = step.where(F.col("came") + F.col("stop") < F.col("waiting")).withColumn("done", F.col("done") | settles)

    done = log.rows()
    blocked = needs.join(done.where("NOT good").select("run_id", F.col("task").alias("producer")), ["run_id", "producer"]).select(
        *NODE, "edge_ix", F.concat(F.lit("blocked-by:"), "producer").alias("code"))
    first = failing.unionByName(blocked).groupBy(NODE).agg(F.min(F.struct("edge_ix", "code"))["code"].alias("code"))
    why = F.when(~F.col("recipe"), "no-recipe").when(F.col("good").isNull(), "loop").when(F.col("good"), "recipe-known").otherwise(F.col("code"))
    return start.join(done, NODE, "left").join(first, NODE, "left").select(*NODE, F.coalesce("good", F.lit(False)).alias("recomputable"), why.alias("why"))


# ------------------------------------------------------------------ the plan

def reclaim_plan(tasks: DataFrame, edges: DataFrame, outputs: DataFrame, resolved: DataFrame, copies: DataFrame,
                 sizes: DataFrame, rerun: DataFrame | None = None, ignore=BOOKKEEPING, target: str | None = None) -> DataFrame:
    """
    One row per task: verdict, cause, how many files the cause concerns, and
    the bytes a removal gives back. `copies` is `copy_verdicts`, `sizes` is
    `dir_bytes`; `rerun` is `recomputable`, given where intermediates are to
    be assessed. `cause_files` lists the files behind a cause.
    """
    if target is not None:
        tasks = tasks.where(F.coalesce("target", F.lit("")) == target)
    read = consumed_outputs(edges).withColumn("read", F.lit(True))
    files = (
        outputs.where(~ignored(F.col("file"), ignore)).select(*NODE, "file", recorded(F.col("digest")).alias("known"))
        .join(copies.select(*NODE, "file", F.col("verdict").alias("held")), [*NODE, "file"], "left")
        .join(read, [*NODE, "file"], "left"))
    known = F.coalesce("known", F.lit(False))
    settled = known & F.coalesce(F.col("held").isin("digest", "hardlink"), F.lit(False))
    flags = files.groupBy(NODE).agg(
        F.count("*").alias("outputs"), F.count_if(~known).alias("nodigest"),
        *[F.count_if(known & (F.col("held") == h)).alias(h) for h in ("symlink", "changed", "unverified")],
        F.count_if(settled).alias("settled"), F.count_if(~settled & F.col("read").isNull()).alias("loose"))
    counted = ["outputs", "nodigest", "symlink", "changed", "unverified", "settled", "loose"]
    fed = forward_edges(edges).select(NODE).distinct().withColumn("fed", F.lit(True))
    rows = (
        tasks.join(resolved, NODE).join(flags, NODE, "left").join(fed, NODE, "left").join(sizes, NODE, "left")
        .na.fill(0, [*counted, "bytes"]).na.fill(False, ["fed", "superseded"])
        .withColumn("state", normalise_status(F.col("status"))))
    if rerun is None:
        rows = rows.withColumn("recomputable", F.lit(None).cast("boolean")).withColumn("rerun_why", F.lit(None).cast("string"))
    else:
        rows = rows.join(rerun.select(*NODE, "recomputable", F.col("why").alias("rerun_why")), NODE, "left")

    word = F.coalesce("status", F.lit(""))
    unpublished = F.col("outputs") - F.col("settled")
    # In order: the first that holds decides. (condition, verdict, cause, files named)
    none = F.lit(0)
    rules = [
        (F.col("rel").isNull(), "KEEP", F.lit("no-place"), none),
        (~F.col("on_disk"), "GONE", F.lit("no-directory"), none),
        (F.col("superseded") & F.col("fed"), "KEEP", F.lit("superseded-but-read"), none),
        (F.col("superseded"), "SUPERSEDED", F.lit("superseded-mark"), none),
        ((F.col("state") == "FAILED") & F.col("fed"), "KEEP", F.concat(F.lit("failed-but-read:"), word), none),
        (F.col("state") == "FAILED", "FAILED", F.concat(F.lit("failed:"), word), none),
        (F.col("state") == "UNKNOWN", "KEEP", F.concat(F.lit("unfinished:"), word), none),
        (F.col("nodigest") > 0, "KEEP", F.lit("no-digest"), F.col("nodigest")),
        (F.col("symlink") > 0, "KEEP", F.lit("copy-is-link"), F.col("symlink")),
        (F.col("changed") > 0, "KEEP", F.lit("copy-size-differs"), F.col("changed")),
        (F.col("unverified") > 0, "KEEP", F.lit("copy-unchecked"), F.col("unverified")),
        ((F.col("outputs") > 0) & (unpublished == 0), "REDUNDANT", F.lit("all-published"), none),
    ]
    if rerun is None:
        rules.append((F.lit(True), "KEEP", F.lit("unpublished"), unpublished))
    else:
        rules += [
            (F.col("loose") > 0, "KEEP", F.lit("end-unpublished"), F.col("loose")),
            (F.col("outputs") == 0, "KEEP", F.lit("no-outputs"), none),
            (F.col("recomputable"), "INTERMEDIATE", F.col("rerun_why"), none),
            (F.lit(True), "KEEP", F.col("rerun_why"), none),
        ]

    def first_rule(pick):
        chain = F.when(rules[0][0], pick(rules[0]))
        for rule in rules[1:]:
            chain = chain.when(rule[0], pick(rule))
        return chain

    return rows.select(
        *NODE, "process", "target", "rel", first_rule(lambda r: F.lit(r[1])).alias("verdict"),
        first_rule(lambda r: r[2]).alias("cause"), first_rule(lambda r: r[3]).cast("bigint").alias("files"),
        "bytes").withColumn("bytes", F.when(F.col("verdict") == "GONE", 0).otherwise(F.col("bytes")))


def cause_files(plan: DataFrame, outputs: DataFrame, copies: DataFrame, edges: DataFrame, ignore=BOOKKEEPING) -> DataFrame:
    """(run_id, task, file): the files each cause concerns, one row each."""
    read = consumed_outputs(edges).withColumn("read", F.lit(True))
    files = (
        outputs.where(~ignored(F.col("file"), ignore)).select(*NODE, "file", recorded(F.col("digest")).alias("known"))
        .join(copies.select(*NODE, "file", F.col("verdict").alias("held")), [*NODE, "file"], "left")
        .join(read, [*NODE, "file"], "left").join(plan.where("files > 0").select(*NODE, "cause"), NODE))
    known = F.coalesce("known", F.lit(False))
    open_copy = ~(known & F.coalesce(F.col("held").isin("digest", "hardlink"), F.lit(False)))
    concerned = (
        ((F.col("cause") == "no-digest") & ~known)
        | ((F.col("cause") == "copy-is-link") & known & (F.col("held") == "symlink"))
        | ((F.col("cause") == "copy-size-differs") & known & (F.col("held") == "changed"))
        | ((F.col("cause") == "copy-unchecked") & known & (F.col("held") == "unverified"))
        | ((F.col("cause") == "unpublished") & open_copy)
        | ((F.col("cause") == "end-unpublished") & open_copy & F.col("read").isNull()))
    return files.where(concerned).select(*NODE, "file")


def reclaim_summary(plan: DataFrame) -> DataFrame:
    """Tasks and bytes per verdict, and whether the verdict gives bytes back."""
    return plan.groupBy("run_id", "verdict").agg(F.count("*").alias("tasks"), F.sum("bytes").alias("bytes")).withColumn(
        "reclaimable", F.col("verdict").isin(*REMOVABLE))


def reclaim_by_cause(plan: DataFrame) -> DataFrame:
    """Tasks and bytes per verdict, cause and process."""
    return plan.groupBy("run_id", "verdict", "cause", short_process(F.col("process")).alias("process")).agg(
        F.count("*").alias("tasks"), F.sum("bytes").alias("bytes"))


def recheck_before_removal(plan: DataFrame, copies: DataFrame, published: DataFrame, fresh: DataFrame,
                           verdicts=REMOVABLE) -> DataFrame:
    """
    One row per proposed removal with `refused`: NULL when it may go ahead.
    `copies` is `published_copies_by_digest` and `fresh` (run_id, path,
    digest) the published files as they hash now. A path that leaves its root
    is refused; nothing is deleted here.
    """
    proposed = plan.where(F.col("verdict").isin(*verdicts))
    rests_on = copies.where(F.col("held").isin("digest", "hardlink")).join(
        proposed.where("verdict = 'REDUNDANT'").select(NODE), NODE, "left_semi")
    checked = (
        rests_on.join(published.select("run_id", "path", F.col("digest").alias("recorded")), ["run_id", "path"], "left")
        .join(fresh.select("run_id", "path", F.col("digest").alias("now"), F.lit(True).alias("there")), ["run_id", "path"], "left"))
    problem = (
        F.when(F.col("there").isNull(), "copy-gone")
        .when(~F.startswith(F.coalesce("recorded", F.lit("")), F.lit("sha256:")), "copy-unhashable")
        .when(~F.col("now").eqNullSafe(F.col("recorded")), "copy-changed"))
    bad = checked.withColumn("problem", problem).where("problem IS NOT NULL").groupBy(NODE).agg(
        F.min(F.struct("file", "path", "problem")).alias("first"))
    outside = F.startswith("rel", F.lit("/")) | F.col("rel").rlike(r"(^|/)\.\.(/|$)") | (F.coalesce("rel", F.lit("")) == "")
    return proposed.join(bad, NODE, "left").select(
        *NODE, "rel", "verdict", "bytes",
        F.when(outside, "outside").otherwise(F.concat_ws(": ", "first.problem", "first.path")).alias("refused")
    ).withColumn("refused", F.when(F.col("refused") != "", F.col("refused")))
