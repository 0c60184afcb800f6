"""Pairs of the same two runs are compared once, and digests are moved as fixed-width words."""

from pyspark.sql import functions as F

from wakeline.functions.digests import bag, bag_of, words
from wakeline.operators import drift

T = "run_id string, task string, name string, process string, target string, container string, script string, superseded boolean"
E = "run_id string, consumer string, producer string, filename string, digest string, edge_ix bigint"
O = "run_id string, task string, file string, file_ix int, digest string"


def tables(spark):
    tasks = [(r, f"{r}{n}", n, "P", "", "x", "s" if (r, n) != ("a", "root") else "s2", False) for r in "ba" for n in ("root", "down")]
    edges = [(r, f"{r}down", f"{r}root", "o", None, 0) for r in "ba"]
    outputs = [(r, f"{r}{n}", "o", 0, "sha256:1" if r == "b" else "sha256:2") for r in "ba" for n in ("root", "down")]
    return spark.createDataFrame(tasks, T), spark.createDataFrame(edges, E), spark.createDataFrame(outputs, O)


def test_pairs_of_the_same_runs_are_compared_once_and_all_told(spark):
    pairs = spark.createDataFrame([("p", "b", "a"), ("q", "b", "a"), ("z", "a", "b")], "pair_id string, before_run string, after_run string")
    found = drift.drift(pairs, *tables(spark))
    assert found.base.select("pair_id").distinct().count() == 2
    for rows in (found.items, found.files, found.follows):
        told = {p: sorted(tuple(r)[1:] for r in rows.where(F.col("pair_id") == p).collect()) for p in "pqz"}
        assert told["p"] == told["q"] and told["p"] and told["z"] and told["p"] != told["z"]
    paired = drift.pair_tasks(pairs, *tables(spark))
    assert paired.groupBy("pair_id").count().collect() and {r.pair_id: r["count"] for r in paired.groupBy("pair_id").count().collect()} == {"p": 2, "q": 2, "z": 2}


def test_a_pair_id_that_comes_twice_answers_for_itself(spark):
    pairs = spark.createDataFrame([("p", "b", "a"), ("q", "b", "a"), ("q", "b", "a"), (None, "b", "a")], "pair_id string, before_run string, after_run string")
    kept, members = drift.one_each(pairs)
    assert sorted(r.pair_id for r in kept.collect()) == ["p", "q", "q"]
    assert {("p", "p"), ("q", "q")} <= {tuple(r) for r in members.collect()}


def test_no_digest_text_is_shuffled(spark):
    _, edges, outputs = tables(spark)
    for rows in (drift.output_digest_lookup(outputs), drift.input_digests(edges, outputs), drift.written_files(outputs), drift.external_inputs(edges)):
        assert "digest" not in rows.columns and dict(rows.dtypes)["high"] == "bigint"


def test_bag_of_words_is_the_bag(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",)], "d string").select("d", *(w.alias(n) for w, n in zip(words(F.col("d")), ("high", "low"))))
    one = rows.agg(bag(F.col("d")).alias("x"), bag_of(F.col("high"), F.col("low")).alias("y")).first()
    assert one.x == one.y and one.x.startswith("4:")


def test_lookup_takes_last_full_name_then_first_basename(spark):
    outputs = spark.createDataFrame([("r", "t", "f", 1, "one"), ("r", "t", "f", 2, "two"), ("r", "t", "d/f", 0, "deep"), ("r", "t", "d/g", 5, "five"),
                                     ("r", "t", "e/g", 3, "three"), ("r", "t", "f", 9, "")], O)
    got = {r.name: (r.high, r.low) for r in drift.output_digest_lookup(outputs).collect()}
    said = {d: tuple(spark.range(1).select(*(words(F.lit(d)))).first()) for d in ("two", "three", "deep")}
    assert got["f"] == said["two"] and got["g"] == said["three"] and got["d/f"] == said["deep"]
    edges = spark.createDataFrame([("r", "c", "t", "x/g", None, 0), ("r", "c", "t", "f", "own", 1), ("r", "c2", "t", "none", None, 2)], E)
    inputs = {(r.task, r.high) for r in drift.input_digests(edges, outputs).collect()}
    assert inputs == {("c", said["three"][0]), ("c", spark.range(1).select(words(F.lit("own"))[0]).first()[0]), ("c2", None)}
