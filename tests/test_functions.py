import hashlib
import json

from pyspark.sql import functions as F

from wakeline.functions import canonical, instants, text
from wakeline.functions.digests import bag
from wakeline.operators import intake, reclaim, triggers


def column(spark, values, expr):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(expr(F.col("t"))).collect()]


def test_json_strings_are_ascii_and_escaped_as_json_does(spark):
    values = ["plain", 'q"b\\s', "é😀\n\t\x00\x7f ", ""]
    assert column(spark, values, canonical.json_string) == [json.dumps(v) for v in values]


def test_event_hash_is_over_the_canonical_entry(spark):
    entry = {"seq": 3, "effective_from": "2024-01-01", "recorded_at": "2024-01-02T00:00:00+00:00", "actor": "Zoë \"x\"", "event_type": "T",
             "subject": "S/1", "body": '{"a":"é😀"}', "prev_hash": "0" * 64}
    row = spark.createDataFrame([entry], "seq bigint, effective_from string, recorded_at string, actor string, event_type string, subject string, body string, prev_hash string")
    want = hashlib.sha256(json.dumps(entry, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert row.select(canonical.event_hash()).first()[0] == want


def test_instants_and_whole_days(spark):
    values = ["2024-05-01", "2024-05-01T09:00:00Z", "2024-05-01T09:00", "2024-05-01T09:00:00+05:30", " 2024-05-01 09:00:00.5-0200 ", "2024-13-01", "soon", None]
    got = column(spark, values, lambda c: instants.instant(c).cast("string"))
    assert got == ["2024-05-01 00:00:00", "2024-05-01 09:00:00", "2024-05-01 09:00:00", "2024-05-01 03:30:00", "2024-05-01 11:00:00.5", None, None, None]
    asks = lambda as_of: column(spark, values[:4], lambda c: instants.in_effect(instants.instant(c), F.lit(as_of)))
    assert asks("2024-05-01") == [True] * 4
    assert asks("2024-05-01T03:30:00Z") == [True, False, False, True]


def test_container_matching(spark):
    images = {"a": "quay.io/b/samtools:1.21--h50", "b": "docker://x/bwa_htslib_samtools:27211b8c0000aa-0", "c": "depot/galaxy-samtools-1.2.sif",
              "d": "samtools:1.210", "e": "samtools:latest", "f": ""}
    tasks = spark.createDataFrame([("r", t, i) for t, i in images.items()], "run_id string, task string, container string")
    needles = spark.createDataFrame([("1", "samtools:1.21"), ("2", "samtools"), ("3", "tool"), ("4", "samtools:1.2")], "trigger_id string, needle string")
    found = {}
    for r in triggers.match_container(tasks, needles).collect():
        found.setdefault(r.trigger_id, {})[r.task] = r.how
    assert found == {"1": {"a": "exact", "b": "name-only", "e": "name-only"}, "2": dict.fromkeys("abcde", "exact"),
                     "4": {"b": "name-only", "c": "exact", "e": "name-only"}}


def test_substrings_of_every_length_are_found(spark):
    tasks = spark.createDataFrame([("r", "a", "run prep.py now"), ("r", "b", "x"), ("r", "c", "")], "run_id string, task string, script string")
    needles = spark.createDataFrame([("1", "prep.py"), ("2", "x"), ("3", "n"), ("4", "py"), ("5", "Prep")], "trigger_id string, needle string")
    assert sorted((r.trigger_id, r.task) for r in triggers.match_field(tasks, needles, "script").collect()) == [("1", "a"), ("2", "b"), ("3", "a"), ("4", "a")]


def test_status_words(spark):
    assert column(spark, ["done", " Running ", "RetryableFailure", "", None, "skipped"], triggers.normalise_status) == [
        "COMPLETED", "UNKNOWN", "FAILED", "", "", "CACHED"]


def test_words_stand_alone(spark):
    texts = spark.createDataFrame([("r", "Use BWA-mem2, a.b and *; sample_1x é")], "run_id string, text string")
    words = spark.createDataFrame([("r", w) for w in ("bwa", "bwa-mem2", "A.B", "ab", "sample_1", "*", "é", "mem2")], "run_id string, word string")
    found = lambda whole: {r.word for r in intake.named_words(texts, words, ["run_id"], whole).collect()}
    assert found(False) == {"bwa", "bwa-mem2", "A.B", "*", "é", "mem2"}
    assert found(True) == {"bwa-mem2", "A.B", "*", "é"}


def test_bags_ignore_order_and_count_repeats(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, "a"), (3, "b"), (4, "b"), (4, "b")], "g int, v string")
    bags = {r.g: r.b for r in rows.groupBy("g").agg(bag(F.col("v")).alias("b")).collect()}
    assert bags[1] == bags[2] and len(set(bags.values())) == 3


def test_hashed_layout_places_a_task_and_nothing_else_does(spark):
    rows = [("r", "ab/cdef12", "/w/ab/cdef123456", None), ("r", "ab/cdef12", "/w/xx/cdef123456", None), ("r", "t", "/w/t", None), ("r", "u", "", "call/u")]
    df = reclaim.relative_workdir(spark.createDataFrame(rows, "run_id string, task string, workdir string, workpath string"))
    assert [r.rel for r in df.collect()] == ["ab/cdef123456", None, None, "call/u"]


def test_globs_and_basenames(spark):
    assert column(spark, ["versions.yml", "versions.yml2", "a/versions.yml"], lambda c: text.ignored(c, ("versions.yml",))) == [True, False, False]
    assert column(spark, ["a/b.txt", "a/dir/", "x"], text.basename) == ["b.txt", "dir", "x"]
