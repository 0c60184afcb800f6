"""Registered queries beside their DuckDB statements at the smallest scale."""

from collections import Counter

import pytest

import __spark_entry__ as entry

FEW = ("forward_edges", "reach_input", "match_external_input", "decide", "drift_summary", "bridges", "reclaim_summary", "gate", "verify_chain",
       "load_bundles", "check_answers", "ingest_rocrate_edges", "contract_violations")


def test_every_query_has_one_name_and_a_statement():
    names = [n for m in entry.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
    assert {n for m in entry.MODULES for n in m.ORACLES} == set(names)
    assert set(names) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FEW)
def test_same_rows_as_duckdb(spark, sf_dir, name):
    import duckdb
    from pathlib import Path
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(r) for r in df.select(columns).collect())
    theirs = Counter(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name, whole", [
    ("impact", {"action", "rule", "possible", "class_asserted_by", "evidence", "container", "script", "evidence_path"}),
    ("input_signature", {"inputs", "unknown", "tasks"})])
def test_whole_answers_are_compared(spark, sf_dir, name, whole):
    assert whole <= set(entry.queries()[name](spark, sf_dir).columns)
    test_same_rows_as_duckdb(spark, sf_dir, name)


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1
