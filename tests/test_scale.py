"""What keeps the driver small, inputs read once and state linear."""

from __future__ import annotations

import datetime as dt
import glob
import hashlib
import os

import pandas as pd
from pyspark.sql import functions as F

from folioframe.fixtures import VIEWS, Fixtures
from folioframe.operators import layout, templates
from folioframe.plans import graphs
from folioframe.queries import intake
from folioframe.session import checkpoint_folder, cut_lineage
from folioframe.streaming.streams import _Progress


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_that_files_shrink_is_not_planned_as_a_broadcast(spark):
    many = spark.range(400_000).select("id", F.lit(True).alias("flag"), F.lit("the same words in every row").alias("text"))
    one, other = cut_lineage(many), cut_lineage(many)
    assert "BroadcastHashJoin" not in plan_of(one.join(other, "id"))


def test_profiles_of_alike_pages_are_not_planned_as_a_broadcast(spark, monkeypatch):
    page = F.struct(F.lit("g" * 64).alias("geometry_hash"), F.lit("s" * 64).alias("structure_hash"), F.lit(600.0).alias("w"))
    template = spark.range(60).select(F.concat(F.lit("t"), "id").alias("template_id"), F.col("id").alias("ord"), F.lit(400).alias("page_count"), F.lit(0).alias("boxes"),
                                      F.col("id").cast("string").alias("fingerprint"), F.array_repeat(page, 400).alias("pages"))
    met = []

    def compared(left, right):
        met.append(plan_of(left.join(right.select("template_id", F.col("pages").alias("others")), "template_id")))
        return left.limit(0).select(F.col("template_id").alias("first_id"), F.lit("").alias("parent"), F.lit(0).alias("parent_ord"), F.lit(0.0).alias("similarity"))

    monkeypatch.setattr(templates, "_best_earlier", compared)
    assert templates.cluster_templates(template).count() == 60
    assert met and not any("BroadcastHashJoin" in p for p in met)


def test_files_are_dealt_over_tasks_however_few_read_the_pages(spark, tmp_path):
    rows = [(n, f"http://h/{n}", f"<p>{n}</p>") for n in range(230)] + [(7, "http://h/7", "<p>again</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    before = set(glob.glob(f"{checkpoint_folder(spark)}/query-*"))
    got = {r["path"]: r for r in intake.s5_files(Fixtures(spark, str(tmp_path))).collect()}
    (folder,) = set(glob.glob(f"{checkpoint_folder(spark)}/query-*")) - before
    files = glob.glob(f"{folder}/files/page_id=*/part-*")
    assert len(files) == 230 and len({os.path.basename(f)[:10] for f in files}) == 2
    # rows of one page are lines of one file, in their order, which its manifest does not list
    assert got["3"]["size"] == 9 and got["3"]["sha256"] == hashlib.sha256(b"<p>3</p>\n").hexdigest() and got["3"]["state"] == "ok"
    assert got["7"]["sha256"] == hashlib.sha256(b"<p>7</p>\n<p>again</p>\n").hexdigest() and got["7"]["state"] == "changed"


def test_shared_view_is_derived_once(spark, tmp_path):
    lines = [(o, o % 3, o % 2, 5.0, 9.0, i, dt.date(2020, 1, 1)) for i, o in enumerate([1, 2, 11, 12, 13])]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_linenumber int, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"red gear {k}") for k in range(3)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    plain = Fixtures(spark, str(tmp_path))
    shared = plain.shared("fx_token")
    for name in ("fx_token", "fx_token_b", "fx_page", "fx_field", "fx_line"):
        assert name in VIEWS
        assert "lineitem" not in plan_of(shared[name])
        assert shared[name].dtypes == plain[name].dtypes
        assert sorted(shared[name].collect()) == sorted(plain[name].collect())


def test_components_of_pages_in_one_pass_and_in_rounds(spark, monkeypatch):
    node = spark.createDataFrame([(p, n) for p in (1, 2) for n in range(12)] + [(2, 3)], "page_id long, n long")
    edge = spark.createDataFrame([(1, 1, 2), (1, 2, 7), (1, 7, 9), (1, 4, 5), (2, 11, 10), (2, 10, 0), (2, 3, 6)], "page_id long, a long, b long")
    told = {(1, 2): 1, (1, 7): 1, (1, 9): 1, (1, 5): 4, (2, 10): 0, (2, 11): 0, (2, 6): 3}

    def found():
        return sorted(tuple(r) for r in graphs.components(node, edge, ["page_id"], "n", "a", "b").select("page_id", "n", "component").collect())

    # a node given twice meets itself, as in any join on its key
    rows = [(1, n) for n in range(12)] + [(2, n) for n in range(12)] + [(2, 3)] * 3
    expected = sorted((p, n, told.get((p, n), n)) for p, n in rows)
    assert found() == expected
    monkeypatch.setattr(graphs, "_labels", None)  # pages need no rounds
    assert found() == expected
    monkeypatch.undo()
    monkeypatch.setattr(graphs, "SWEEP_LIMIT", 3)  # the first page takes rounds, the second one pass
    assert found() == expected


class _Waiting:
    def __init__(self):
        self.rows, self.read = [], 0

    def appendValue(self, r):
        self.rows.append(r)

    def appendList(self, rs):
        self.rows += rs

    def put(self, rs):
        self.rows = list(rs)

    def clear(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.read += len(self.rows)
        return iter(self.rows)


class _Top:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


class _Timers:
    def __init__(self):
        self.at = set()

    def registerTimer(self, moment):
        self.at.add(moment)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_waiting_events_are_read_once_and_not_with_every_timer():
    state, timers = _Progress(), _Timers()
    state.handle, state.waiting, state.top = timers, _Waiting(), _Top()
    start, n = dt.datetime(2024, 1, 1), 200
    ts = pd.to_datetime([start + dt.timedelta(seconds=(i * 37) % n) for i in range(n)])
    list(state.handleInputRows(("d",), iter([pd.DataFrame({"ts": ts, "event_id": range(n), "percent": [i % 50 for i in range(n)]})]), None))
    out, middle, last = [], int((start + dt.timedelta(seconds=n // 2)).timestamp() * 1000), int((start + dt.timedelta(days=1)).timestamp() * 1000)
    for watermark in (middle, last):
        while due := sorted(t for t in timers.at if t <= watermark):
            timers.at.remove(due[0])
            for piece in state.handleExpiredTimer(("d",), _Now(watermark), _Now(due[0])):
                out += piece.itertuples(index=False, name=None)
    top, expected = 0, []
    for _, e in sorted((ts[i], i) for i in range(n)):
        top = max(top, e % 50)
        expected.append(("d", e, top))
    assert out == expected
    assert not timers.at and not state.waiting.rows
    assert state.waiting.read <= 2 * n


def test_bounded_pages_are_ordered_twice_and_never_joined(spark):
    rows = [(p, i, 10.0, 20.0 * (i // 2) + p, 40.0, 9.0, 0.5 + (i % 50) / 100, "TEXT_SHORT" if i % 3 else "TEXT_LONG", "Riga" if i % 7 == 0 else "x", None) for p in (1, 2) for i in range(40 * p - 15)]
    rows += [(None, 1, 10.0, 20.0, 40.0, 9.0, 0.9, "TEXT_SHORT", "x", None)]
    field = spark.createDataFrame(rows, "page_id long, field_id long, x double, y double, w double, h double, confidence double, field_type string, label string, semantic_key string")
    judged = layout.judge_candidates(field, ["page_id"], many=30, refine_over=35, keep=32)
    plan = judged._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    prepared = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, judged._jdf.queryExecution().optimizedPlan()).toString()
    assert prepared.count("Sort [") <= 2 and prepared.count("Exchange ") == 1
    found = {(r.page_id, r.field_id): r for r in judged.collect()}
    assert len(found) == len(rows) - 1  # a row of no page is on none, as before
    assert all(found[1, i].reason is None for i in range(25))
    assert {r.reason for k, r in found.items() if k[0] == 2} == {None, "MERGED", "LOW_CONFIDENCE", "OVER_BOUND"}
    assert sum(r.reason is None for k, r in found.items() if k[0] == 2) == 32
