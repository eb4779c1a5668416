"""Costly steps are written once, judged once and compiled."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import readings, semantics
from folioframe.plans.greedy import greedy_keep
from folioframe.plans.spatial import box

BY = ("page_id",)
WORD = "page_id long, token_id long, line_id long, x double, y double, w double, h double, text string, text_key string, conf double, source string"


def from_steps(df):
    return df.inputFiles() and all("/step-" in f for f in df.inputFiles())


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(table, rows):
    return table([(1, i, 0, float(x), 0.0, float(w), 10.0, t, t.lower().replace(" ", ""), 90.0, "ocr") for i, x, w, t in rows], WORD)


def test_no_generated_method_is_too_long_for_the_jvm(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_receipt_lines_are_judged_once(table):
    doc = table([(1, "Negozio\n05/03/24 10:00\nPane 1,50\nLatte 2,00\nTOTALE EURO\n3,50\nRESTO 1,00"), (2, "  \n \n"), (3, None), (4, "Subtotale 2,00\nPane 2,00\nTOTALE 2,00\nTOTALE 2,00")], "doc_id long, text string")
    result = semantics.receipt_reconcile(doc)
    filters = [part for part in optimized(result).split("\n") if "Filter" in part]
    assert not any("TOTALE" in part for part in filters)
    rows = {r["doc_id"]: r for r in result.collect()}
    assert set(rows) == {1, 4}
    assert (rows[1]["total"], rows[1]["items"], rows[1]["items_sum"], rows[1]["date"], rows[1]["merchant"]) == (3.5, 2, 3.5, "2024-03-05", "Negozio")
    assert (rows[4]["total"], rows[4]["items"]) == (None, 1)


def test_greedy_rows_are_written_before_they_are_counted_and_folded(table):
    df = table([(1, 1, 0.0, 0.0, 5.0, 5.0), (1, 2, 1.0, 0.0, 5.0, 5.0), (1, 3, 50.0, 0.0, 5.0, 5.0)], "page_id long, id long, x double, y double, w double, h double")
    kept = greedy_keep(df, BY, "id", [F.col("id")], lambda k, c: F.abs(k["x"] - c["x"]) < 3, box())
    assert from_steps(kept)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]


def test_groups_of_a_coarse_word_are_written_once(table):
    a, b = words(table, [(1, 0, 100, "red gear")]), words(table, [(10, 0, 40, "red"), (11, 50, 45, "gear")])
    result = readings.split_coarse_tokens(a, b, None, BY)
    assert any("/step-" in f for f in result.inputFiles())
    assert sorted((r["part_no"], r["text"], r["outcome"]) for r in result.collect()) == [(0, "red", "split"), (1, "gear", "split")]


def test_strong_local_words_are_written_once(table):
    page = table([(1, 600.0, 130.0)], "page_id long, page_w double, page_h double")
    region = page.select("page_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("page_w").alias("w"), F.col("page_h").alias("h"))
    a, local = words(table, [(1, 0, 40, "red")]), words(table, [(1, 0, 40, "red"), (2, 60, 40, "gear")])
    found = readings.recover_missing(a, local, local, region, page, BY)
    assert from_steps(found)
    assert [r["text"] for r in found.collect()] == ["gear"]


def test_b_words_travel_once_to_their_comparison(table):
    a = words(table, [(1, 0, 100, "red gear"), (2, 200, 40, "bolt"), (3, 300, 40, "ring")])
    b = words(table, [(10, 0, 40, "red"), (11, 50, 45, "gear"), (12, 201, 39, "bolt")])
    result = readings.comparable_reading(a, b, BY)
    assert "min(" not in optimized(result).lower().replace("array_min(", "")
    assert {r["token_id"]: (r["b_text"], r["b_text_key"], r["b_ids"]) for r in result.collect()} == {1: ("red gear", "redgear", [10, 11]), 2: ("bolt", "bolt", [12]), 3: (None, None, None)}


def test_kept_rows_do_not_look_up_who_claims_the_others(table):
    """Rows that repeat the number of a kept row stay, rows without a number go, as when every owner was looked up."""
    df = table([(1, 1, 0.0), (1, 2, 1.0), (1, 1, 2.0), (1, None, 90.0), (1, 3, 50.0)], "page_id long, id long, x double").withColumns({"y": F.lit(0.0), "w": F.lit(5.0), "h": F.lit(5.0)})
    kept = greedy_keep(df, BY, "id", [F.col("x")], lambda k, c: F.abs(k["x"] - c["x"]) < 3, box())
    assert "array_position" not in optimized(kept)
    assert sorted((r["id"], r["x"]) for r in kept.collect()) == [(1, 0.0), (1, 2.0), (3, 50.0)]


def test_words_of_different_lines_are_told_apart_by_their_heights(table):
    rows = words(table, [(1, 0, 40, "red"), (2, 1, 40, "red"), (3, 2, 40, "blue")]).withColumnRenamed("token_id", "word_id").drop("line_id", "text_key", "source")
    below = rows.withColumns({"y": F.lit(40.0), "word_id": F.col("word_id") + 10})
    merged = readings.merge_word_streams(rows.unionByName(below), BY)
    assert sorted(r["word_id"] for r in merged.collect()) == [1, 11]
