"""The registered queries, their names and a few of them at the smallest scale."""

import os
import re
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAMPLE = ["a11_reading_agreement", "p4_clamp_boxes", "j8_cell_adjacency", "a9_union_coverage", "t2_match_score", "e6_classify_model", "st3_progress"]


def test_names():
    import __spark_entry__ as entry

    names, oracles = set(entry.queries()), set(entry.oracle_sql())
    assert oracles <= names and len(names) > 130
    numbered = [n for n in names if re.match(r"op\d+_", n)]
    assert len(numbered) == (13 if entry.corpus else 0) and ("pipeline" in names) == bool(entry.corpus)


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_against_oracle(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from check_oracle import TABLES, rows_of

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_flagship_plan_has_no_cartesian(spark):
    import __spark_entry__ as entry

    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
