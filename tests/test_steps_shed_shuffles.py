"""Operators of many joins run in written steps, and what was shuffled for a step goes when it is written."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from folioframe.operators import geometry, layout, readings, structure
from folioframe.session import cut_lineage
from folioframe.sources import sinks

BY = ("page_id",)
WORD = ("page_id long, token_id long, line_id long, x double, y double, w double, h double, text string, text_key string, conf double, source string, "
        "is_label boolean, is_prompt boolean, is_instruction boolean")


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def joins(df):
    return len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString()))


def words(table, rows):
    return table([(1, i, 0, float(x), float(y), float(w), 10.0, t, t.replace(" ", ""), 50.0, "ocr", t == "label", t == "label", False) for i, x, y, w, t in rows], WORD)


def cells(table, rows):
    return table([(1, i, float(x), float(y), float(w), float(h)) for i, x, y, w, h in rows], "page_id long, cell_id long, x double, y double, w double, h double")


@pytest.fixture
def page(table):
    return table([(1, 600.0, 130.0)], "page_id long, page_w double, page_h double")


@pytest.fixture
def heights(table):
    return table([(1, 10.0)], "page_id long, typical_h double")


def test_a_written_step_keeps_no_shuffle_files(spark):
    before = shuffle_files(spark)
    step = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    ours = step.groupBy("count").agg(F.count(F.lit(1)).alias("n"))  # a caller's own rows may be asked for again
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ours.collect())) == [(142, 1), (143, 6)]


def test_fields_meet_structures_in_steps(table):
    field = table([(1, 1, 12.0, 12.0, 80.0, 20.0)], "page_id long, field_id long, x double, y double, w double, h double")
    rect = cells(table, [(1, 10, 10, 85, 25)]).withColumnRenamed("cell_id", "rect_id")
    line = table([(1, 1, 10.0, 95.0, 35.0)], "page_id long, line_id long, x1 double, x2 double, y double")
    snapped = geometry.snap_to_structure(field, rect, line, BY)
    assert joins(snapped) <= 1
    assert [tuple(r)[2:] for r in snapped.collect()] == [(10.0, 10.0, 85.0, 25.0)]


def test_neighbours_of_a_cell_are_met_once(table, page, heights):
    keys = table([("label",)], "key string")
    cell = cells(table, [(1, 0, 0, 60, 20), (2, 60, 0, 60, 20), (3, 0, 20, 60, 20), (4, 300, 80, 60, 20)])
    token = words(table, [(1, 2, 4, 30, "label"), (2, 302, 84, 20, "other")])
    found = structure.infer_region_fields(cell, token, page, heights, keys.limit(0), keys, BY)
    assert joins(found) <= 6
    rows = {r["cell_id"]: (r["outcome"], r["reason"], r["label"]) for r in found.collect()}
    assert rows == {1: ("excluded", "STATIC_LABEL_WITH_RIGHT_CELL", None), 2: ("proposed", "ADJACENT_LABEL", "label"), 3: ("proposed", "ADJACENT_LABEL", "label"),
                    4: ("excluded", "CONTENT_WITHOUT_RECOGNIZED_FIELD_RELATION", None)}


def test_cells_with_a_repeated_number_are_answered_as_before(table, page, heights):
    """Both rows of a repeated cell number meet both answers about a label nearby."""
    keys = table([("label",)], "key string")
    cell = cells(table, [(1, 0, 0, 60, 20), (1, 0, 0, 60, 20)])
    for word in ("label", "other"):
        assert structure.infer_region_fields(cell, words(table, [(1, 2, 4, 30, word)]), page, heights, keys.limit(0), keys, BY).count() == 4


def test_rules_of_a_page_are_written_one_by_one(table, page, heights):
    keys = table([("label",)], "key string")
    cell = cells(table, [(1, 0, 0, 60, 20), (2, 60, 0, 60, 20)])
    boxes = table([(1, 9, 200.0, 0.0, 14.0, 14.0)], "page_id long, box_id long, x double, y double, w double, h double")
    token = words(table, [(1, 2, 4, 30, "label"), (2, 220, 2, 20, "yes")])
    found = structure.infer_page_fields(cell, boxes, token, page, heights, keys.limit(0), keys, "hot", "small", BY)
    assert joins(found) <= 1
    assert sorted((r["kind"], r["cell_id"], r["reason"]) for r in found.collect()) == [("cell", 1, "STATIC_LABEL_WITH_RIGHT_CELL"), ("cell", 2, "ADJACENT_LABEL"), ("checkbox", 9, "CHECKBOX_CAPTION")]


def test_a_coarse_word_is_judged_in_steps(table, page):
    a = words(table, [(1, 0, 0, 400, "red")])
    local = words(table, [(5, 10, 0, 80, "red")]).withColumn("conf", F.lit(90.0))
    found = readings.recover_coarse(a, local, local, page, BY)
    assert joins(found) <= 9
    assert [(r["token_id"], r["reason"], r["local_words"], r["piece_ids"]) for r in found.collect()] == [(1, "COARSE_TOKEN_CORROBORATED_BY_TWO_READERS", 1, [5])]


def test_readings_are_compared_in_steps(table):
    a = words(table, [(1, 0, 0, 40, "red"), (2, 100, 0, 40, "hot")])
    b = words(table, [(1, 0, 0, 40, "rod"), (2, 100, 0, 40, "hot")])
    voted = readings.vote_reading(a, b, b, None, BY)
    assert joins(voted) <= 2
    assert sorted((r["token_id"], r["selected_key"], r["changed"]) for r in voted.collect()) == [(1, "rod", True), (2, "hot", False)]
    guarded = readings.vote_reading(a, b, b, b, BY)
    assert joins(guarded) <= 3
    assert sorted((r["token_id"], r["selected_key"]) for r in guarded.collect()) == [(1, "rod"), (2, "hot")]


def test_words_with_a_repeated_number_are_voted_on_as_before(table):
    """A repeated word number meets the region's reading of each of its rows, and the other reader's once."""
    a = words(table, [(1, 0, 0, 40, "red"), (1, 0, 0, 40, "red")])
    b = words(table, [(1, 0, 0, 40, "rod")])
    assert readings.vote_reading(a, b, b, None, BY).count() == 4


def test_coarse_words_are_split_in_steps(table):
    a, b = words(table, [(1, 0, 0, 100, "red gear")]), words(table, [(10, 0, 0, 40, "red"), (11, 50, 0, 45, "gear")])
    result = readings.split_coarse_tokens(a, b, None, BY)
    assert joins(result) <= 2
    assert sorted((r["part_no"], r["text"]) for r in result.collect()) == [(0, "red"), (1, "gear")]


def test_regions_are_classified_in_steps(table):
    region = table([(1, "r1", "CLOSED_CELL", 0.0, 0.0, 100.0, 20.0), (1, "l2", "UNDERLINE", 160.0, 38.0, 100.0, 20.0)], "page_id long, region_id string, kind string, x double, y double, w double, h double")
    token = words(table, [(1, 120, 35, 30, "label")])
    found = structure.classify_fields(region, token, BY)
    assert joins(found) <= 2
    assert sorted((r["region_id"], r["class"]) for r in found.collect()) == [("l2", "UNDERLINE_FIELD"), ("r1", "EMPTY_CELL")]


def test_strokes_are_judged_in_steps(table, page):
    line = table([(1, 1, 0.0, 100.0, 20.0, False), (1, 2, 0.0, 100.0, 60.0, True)], "page_id long, line_id long, x1 double, x2 double, y double, is_vertical boolean")
    rect = cells(table, [(1, 0, 0, 100, 40)]).withColumn("is_checkbox", F.lit(False))
    judged = layout.table_structure(line, rect, words(table, [(1, 300, 0, 30, "label")]), page, BY)
    assert joins(judged) <= 5
    assert sorted((r["line_id"], r["reason"]) for r in judged.collect()) == [(1, "TABLE_BOX"), (2, "VERTICAL")]


def test_header_texts_are_written_by_reader(table, heights):
    cell = cells(table, [(1, 0, 0, 60, 20), (2, 0, 20, 60, 20)])
    token = words(table, [(1, 2, 4, 30, "label")])
    dictionary = table([("label", "Label", "text", False)], "header_key string, label string, type string, is_group boolean")
    before = set(cut_lineage.__globals__["_STEPS"].get(cell.sparkSession.sparkContext.applicationId, []))
    found = structure.column_headers(cell, token, token, dictionary, heights, BY)
    steps = [p for p in cut_lineage.__globals__["_STEPS"][cell.sparkSession.sparkContext.applicationId] if p not in before]
    assert len(steps) >= 6
    assert [(r["cell_id"], r["label"], r["source"], r["conflict"]) for r in found.collect()] == [(1, "Label", "primary", False)]


def test_a_snapshot_is_printed_as_it_is_written(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("page_id"), F.rand().alias("sureness"))
    assert sinks.append_snapshot(rows, str(tmp_path), "2024-01-01")
    assert [(r["rows"], r["unchanged"]) for r in sinks.check_snapshots(spark, str(tmp_path)).collect()] == [(20, True)]


def test_captions_beside_a_cell_are_met_once(table, page, heights, monkeypatch):
    most, write = [], structure.cut_lineage
    monkeypatch.setattr(structure, "cut_lineage", lambda df, *options: most.append(joins(df)) or write(df, *options))
    cell = cells(table, [(1, 0, 0, 60, 20), (2, 60, 0, 100, 20), (3, 60, 40, 100, 20)])
    token = words(table, [(1, 2, 4, 30, "label:")])
    field = table([(1, 9, 400.0, 90.0, 20.0, 20.0, False, "PROPOSED", "TABLE_CELL")], "page_id long, field_id long, x double, y double, w double, h double, generic boolean, calibration_status string, derivation string")
    dictionary = table([("none", "None", "text", False)], "header_key string, label string, type string, is_group boolean")
    found = structure.associate_fields(cell, token, token, field, page, dictionary, table([("label",)], "key string"), heights, BY, instruction="^never")
    assert max(most) <= 14
    assert {r["cell_id"]: (r["outcome"], r["reason"], r["label"]) for r in found.collect()} == {
        1: ("static", "ROW_LABEL_STATIC", None), 2: ("proposed", "ASSOCIATED_FIELD_PROPOSED", "label"), 3: ("unmatched", "NO_MEASURED_ASSOCIATION", None)}
