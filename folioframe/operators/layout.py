"""From positioned words and strokes to lines, phrases, text and writing areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.numbers import half_up, let
from folioframe.operators.readings import LETTER_OR_DIGIT, comparable_reading, overlapping_words, typical_height, valid_boxes
from folioframe.plans import folds
from folioframe.plans.folds import by_bands, fold_assign, fold_merge, sorted_rows
from folioframe.plans.greedy import greedy_keep, greedy_owner, split_by_size
from folioframe.plans.sweeps import Fused, MissingWords, MovingRows, Phrases, Regions, Stacks, Strokes, sweep
from folioframe.plans.spatial import (
    PAGE, Box, box, box_of, iou, near_join, share_either, share_of_smaller, shared_area, with_partner, without_partner,
)
from folioframe.session import cut_lineage

LETTERS = "[a-zA-ZàèìòùéÀÈÌÒÙÉ]"


def _numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], rule: type, number: str) -> DataFrame:
    """``keys``, ``columns`` and the group that the swept rule gives every row."""
    fields = T.StructType([rows.schema[c] for c in columns] + [T.StructField(number, T.IntegerType())])
    return sweep(rows, keys, order, lambda: rule(columns), fields)


def assign_lines(token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """``line_no``: words in (y, x) order join the first row whose founding centre is close enough."""
    slack = F.greatest(F.lit(3.0), F.col("h") * 0.55)
    band = Box(F.lit(0.0), F.col("y") + F.col("h") / 2 - slack, F.lit(0.0), slack * 2)

    def same_row(k: Column, c: Column) -> Column:
        a, b = box_of(k), box_of(c)
        return F.abs(b.cy - a.cy) < F.greatest(F.lit(3.0), F.least(a.h, b.h) * 0.55)

    owned = greedy_owner(token, by, "token_id", [F.col("y"), F.col("x"), F.col("token_id")], same_row, band)
    return owned.withColumnRenamed("owner_rank", "line_no").drop("owner_id")


def page_text(token: DataFrame, by: Sequence[str] = PAGE, line: str = "line_id") -> DataFrame:
    """Words joined into lines by x, lines joined into the page by their top."""
    ordered = lambda *parts: F.array_sort(F.collect_list(F.struct(*parts)))
    lines = token.groupBy(*by, line).agg(
        F.min("y").alias("top"), F.array_join(F.transform(ordered("x", "token_id", "text"), lambda e: e["text"]), " ").alias("line_text"))
    return lines.groupBy(*by).agg(
        F.array_join(F.transform(ordered("top", F.col(line), "line_text"), lambda e: e["line_text"]), "\n").alias("text"))


def document_text(page: DataFrame, doc: Sequence[str] = ("doc_id",), header: bool = False, separator: str = "\n\n") -> DataFrame:
    """Pages of a document in order, optionally each under its page header."""
    said = F.concat(F.lit("--- page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("text")) if header else F.col("text")
    parts = F.array_sort(F.collect_list(F.struct(F.col("page_no"), said.alias("text"))))
    return page.groupBy(*doc).agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"),
                                  F.count(F.lit(1)).alias("pages"))


def group_words(token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Phrases: words of one line and region whose gaps stay small; native words stay alone.

    Input has ``line_id`` and ``region_id`` (null outside regions). One row per phrase.
    """
    keys = [*by, "source", "line_id", "region_id"]
    values = ["token_id", "x", "y", "w", "h", "text"]
    native = F.col("source") == "pdf"
    usual, crowded = split_by_size(token.where(~native), keys, folds.FOLD_LIMIT)
    rows = sorted_rows(usual, keys, [F.col("x"), F.col("token_id")], values)
    at = fold_assign(
        F.col("rows"), "struct<cy:double,h:double,lx:double,lr:double>",
        new=lambda t: F.struct((t["y"] + t["h"] / 2).alias("cy"), t["h"].alias("h"), t["x"].alias("lx"), (t["x"] + t["w"]).alias("lr")),
        accepts=lambda g, t: (F.abs(g["cy"] - (t["y"] + t["h"] / 2)) < F.greatest(F.lit(3.0), F.least(g["h"], t["h"]) * 0.55))
        & (t["x"] >= g["lx"]) & (t["x"] - g["lr"] < F.greatest(F.lit(10.0), t["h"] * 2)),
        extend=lambda g, t: F.struct(g["cy"].alias("cy"), g["h"].alias("h"), t["x"].alias("lx"), (t["x"] + t["w"]).alias("lr")))
    flat = rows.select(*keys, F.inline(F.arrays_zip(F.col("rows").alias("_row"), at.alias("p"))))
    flat = flat.select(*keys, "_row.*", F.col("p").cast("bigint").alias("phrase_no"))
    if crowded is not None:
        # lines and regions without a number meet as null-safe keys
        tall = crowded.groupBy(*keys).agg(F.max("h").alias("_tallest"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}"))
        high = crowded.select(*keys, *values).alias("c").join(tall.alias("t"), same).select("c.*", "t._tallest")
        swept = _numbered(high, keys, [F.col("x"), F.col("token_id")], values, Phrases, "phrase_no")
        flat = flat.unionByName(swept.withColumn("phrase_no", F.col("phrase_no").cast("bigint")))
    flat = flat.unionByName(
        token.where(native).select(*keys, *values, F.col("token_id").cast("bigint").alias("phrase_no")))
    words = F.array_sort(F.collect_list(F.struct("x", "token_id", "text")))
    return flat.groupBy(*keys, "phrase_no").agg(
        words.alias("_w"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"),
        F.max(F.col("y") + F.col("h")).alias("_b")).select(
        *keys, F.col("_w")[0]["token_id"].alias("token_id"), F.transform("_w", lambda e: e["token_id"]).alias("fragment_ids"),
        F.array_join(F.transform("_w", lambda e: e["text"]), " ").alias("text"), "x", "y",
        (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))


def reconstruct_text(word: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Phrases from words alone: nearest moving row centre, then splits at gaps and overlaps."""
    tidy = F.trim(F.regexp_replace("text", r"\s+", " "))
    usable = word.withColumn("text", tidy).where((F.col("text") != "") & (F.col("w") > 0) & (F.col("h") > 0))
    heights = typical_height(usable.withColumn("h", F.col("h") + 5), by, pick=None).withColumn("mh", F.col("typical_h") - 5)
    sized = usable.join(heights.select(*by, "mh"), list(by))
    tol = F.greatest(F.lit(5.0), F.col("mh") * 0.42)
    cy = F.col("y") + F.col("h") / 2
    usual, crowded = by_bands(sized, by, cy - tol / 2, cy + tol / 2)
    keys, values = [*by, "_island"], ["token_id", "x", "y", "w", "h", "text", "mh"]
    order = [F.col("y"), F.col("x"), F.col("token_id")]
    rows = sorted_rows(usual, keys, order, values)

    def nearest(open_rows, t):
        away = F.transform(open_rows, lambda r: F.abs(t["y"] + t["h"] / 2 - r["sum"] / r["n"]))
        best = F.array_min(away)
        return F.when(best <= F.greatest(F.lit(5.0), t["mh"] * 0.42), F.array_position(away, best)).otherwise(0).cast("int")

    at = fold_assign(
        F.col("rows"), "struct<sum:double,n:int>",
        new=lambda t: F.struct((t["y"] + t["h"] / 2).alias("sum"), F.lit(1).alias("n")), accepts=None,
        extend=lambda r, t: F.struct((r["sum"] + (t["y"] + t["h"] / 2)).alias("sum"), (r["n"] + 1).alias("n")), position=nearest)
    flat = rows.select(*keys, F.inline(F.arrays_zip(F.col("rows").alias("_row"), at.alias("row_no"))))
    flat = flat.select(*keys, "_row.*", "row_no")
    if crowded is not None:
        flat = flat.unionByName(_numbered(crowded, keys, order, values, MovingRows, "row_no"))
    line = Window.partitionBy(*keys, "row_no").orderBy("x", "y", "token_id")
    right = F.max(F.col("x") + F.col("w")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("x") - right
    breaks = (gap < -F.greatest(F.lit(2.0), F.col("mh") * 0.12)) | (gap > F.greatest(F.lit(18.0), F.col("mh") * 1.15))
    flat = flat.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("int"))
    flat = flat.withColumn("phrase_no", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_sort(F.collect_list(F.struct("x", "y", "token_id", "text")))
    return flat.groupBy(*keys, "row_no", "phrase_no").agg(
        words.alias("_w"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"),
        F.max(F.col("y") + F.col("h")).alias("_b")).select(
        *by, F.col("_w")[0]["token_id"].alias("token_id"), F.array_join(F.transform("_w", lambda e: e["text"]), " ").alias("text"),
        "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))


def merge_colinear(line: DataFrame, token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Join horizontal segments of one height (2.5 pt from the founder) over gaps below 16 pt without words.

    One row per joined line: the first segment's ``line_id`` and ``y``, ``x1``, ``x2``, ``parts`` and the ``line_ids`` of all.
    """
    band = Box(F.lit(0.0), F.col("y") - 1.25, F.lit(0.0), F.lit(2.5))
    owned = greedy_owner(line.select(*by, "line_id", "x1", "x2", "y"), by, "line_id", [F.col("y"), F.col("x1"), F.col("line_id")],
                         lambda k, c: F.abs(k["y"] - c["y"]) <= 2.5, band)
    keys = [*by, "owner_rank"]
    levels = owned.groupBy(*keys).agg(F.min("y").alias("ya"), F.max("y").alias("yb"))
    words = token.where(F.col("text").rlike(LETTERS)).select(*by, "x", "y", "w")
    strips = levels.select(*keys, F.lit(0.0).alias("x"), F.col("ya").alias("y"), F.lit(0.0).alias("w"), (F.col("yb") - F.col("ya")).alias("h"))
    flat = words.select(*by, F.lit(0.0).alias("x"), F.col("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"), F.col("x").alias("wx"), (F.col("x") + F.col("w")).alias("wr"))
    between = near_join(strips, flat, by, reach=box().grown(0.0, 12.0, 0.0, 12.0), b_extent=box()).select(
        *by, F.col("a_owner_rank").alias("owner_rank"), F.col("b_y").alias("y"), F.col("b_wx").alias("x"), F.col("b_wr").alias("r")).distinct()
    both = owned.select(*keys, "y", "x1", "x2", F.col("line_id").cast("bigint").alias("line_id")).unionByName(between, allowMissingColumns=True)
    both = cut_lineage(both)
    usual, crowded = split_by_size(both, keys, folds.FOLD_LIMIT)
    near = usual.where(F.col("line_id").isNull()).groupBy(*keys).agg(F.collect_list(F.struct("y", "x", "r")).alias("words"))
    rows = sorted_rows(usual.where(F.col("line_id").isNotNull()), keys, [F.col("x1"), F.col("y"), F.col("line_id")], ["line_id", "y", "x1", "x2"]).join(near, keys, "left")
    seg = "struct<line_id:bigint,y:double,x1:double,x2:double,parts:int,line_ids:array<bigint>>"
    none = F.array().cast("array<struct<y:double,x:double,r:double>>")

    def step(done, t):
        cur = F.try_element_at(done, F.lit(-1))
        blocked = F.exists(F.coalesce("words", none), lambda k: (F.abs(k["y"] - cur["y"]) < 12) & (k["x"] >= cur["x2"] - 5) & (k["r"] <= t["x1"] + 5))
        grows = (F.size(done) > 0) & (t["x1"] <= cur["x2"] + 16) & ~blocked
        grown = F.struct(cur["line_id"].alias("line_id"), cur["y"].alias("y"), F.least(cur["x1"], t["x1"]).alias("x1"),
                         F.greatest(cur["x2"], t["x2"]).alias("x2"), (cur["parts"] + 1).alias("parts"),
                         F.concat(cur["line_ids"], F.array(t["line_id"])).alias("line_ids"))
        fresh = F.struct(t["line_id"].cast("bigint").alias("line_id"), t["y"].alias("y"), t["x1"].alias("x1"), t["x2"].alias("x2"), F.lit(1).alias("parts"),
                         F.array(t["line_id"]).alias("line_ids"))
        return F.when(grows, F.concat(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)), F.array(grown))).otherwise(
            F.concat(done, F.array(fresh)))

    merged = rows.select(*by, F.explode(F.aggregate("rows", F.array().cast(f"array<{seg}>"), step)).alias("_seg"))
    merged = merged.select(*by, "_seg.*")
    if crowded is not None:
        fields = merged.drop(*by).schema
        # a word comes before the segments it may stand in front of
        order = [F.coalesce(F.col("x1"), F.col("x") - 5), F.col("line_id").isNotNull(), F.col("y"), F.col("line_id")]
        merged = merged.unionByName(sweep(crowded, keys, order, Strokes, fields).drop("owner_rank"))
    return merged


def _prompts_above(line: DataFrame, token: DataFrame, by: Sequence[str]) -> DataFrame:
    """Words whose bottom lies from 2 pt below to 35 pt above each line, in any column."""
    level = line.select(*by, "line_id", F.lit(0.0).alias("x"), "y", F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    bottoms = token.select(*by, "token_id", F.lit(0.0).alias("x"), (F.col("y") + F.col("h")).alias("y"), F.lit(0.0).alias("w"),
                           F.lit(0.0).alias("h"), F.col("x").alias("wx"))
    pairs = near_join(level, bottoms, by, reach=box().grown(0.0, 35.0, 0.0, 2.0), b_extent=box())
    return pairs.groupBy(*by, F.col("a_line_id").alias("line_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("b_token_id").alias("id"), F.col("b_wx").alias("x")))).alias("above"))


def multiline_areas(line: DataFrame, token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Stacks of ruled lines: three lines, or two under a prompt, 9-36 pt apart and aligned.

    One row per area with its line ids, box and the prompt above it.
    """
    wide = line.where(F.col("x2") - F.col("x1") >= 60).select(*by, "line_id", "x1", "x2", "y")
    as_box = lambda df: df.select(*by, "line_id", F.col("x1").alias("x"), "y", (F.col("x2") - F.col("x1")).alias("w"), F.lit(0.0).alias("h"))
    A, B = box("a_"), box("b_")
    own = near_join(as_box(wide), token.select(*by, "x", "y", "w", "h"), by, reach=box().grown(55.0, 14.0, 0.0, 14.0)).where(
        (F.abs(B.bottom - A.y) < 14) & (B.right <= A.x + 12) & (A.x - B.right < 55)
    ).select(*by, F.col("a_line_id").alias("line_id")).distinct().withColumn("own", F.lit(True))
    marked = wide.join(own, [*by, "line_id"], "left").join(_prompts_above(wide, token, by), [*by, "line_id"], "left")
    marked = cut_lineage(marked.withColumn("own", F.coalesce("own", F.lit(False))))
    usual, crowded = by_bands(marked, by, F.col("y"), F.col("y") + 36)
    keys = [*by, "_island"]
    rows = sorted_rows(usual, keys, [F.col("y"), F.col("line_id")], ["line_id", "x1", "x2", "y", "own", "above"])
    rows = rows.withColumn("rows", F.transform("rows", lambda r, i: F.struct(i.alias("i"), *[r[c].alias(c) for c in ("line_id", "x1", "x2", "y", "own", "above")])))

    def grow(base, used):
        def step(s, c):
            dy = c["y"] - s["last"]
            cw, bw = c["x2"] - c["x1"], base["x2"] - base["x1"]
            aligned = ((F.abs(c["x1"] - base["x1"]) <= 30) & (F.abs(c["x2"] - base["x2"]) <= 35)) | (F.least(cw, bw) / F.greatest(cw, bw) >= 0.7)
            idle = s["stop"] | F.array_contains(used, c["i"])
            fits = ~idle & (dy <= 36) & (dy >= 9) & aligned
            stop = s["stop"] | (~idle & ((dy > 36) | (fits & c["own"])))
            add = fits & ~c["own"]
            return F.struct(F.when(add, c["y"]).otherwise(s["last"]).alias("last"),
                            F.when(add, F.concat(s["ids"], F.array(c["i"]))).otherwise(s["ids"]).alias("ids"), stop.alias("stop"))

        later = F.filter("rows", lambda c: c["i"] > base["i"])
        return F.aggregate(later, F.struct(base["y"].alias("last"), F.array(base["i"]).alias("ids"), F.lit(False).alias("stop")), step,
                           lambda s: s["ids"])

    def visit(acc, base):
        return let(grow(base, acc["used"]), lambda ids: let(
            F.transform(ids, lambda i: F.get(F.col("rows"), i)), lambda members: judge(acc, base, ids, members)))

    def judge(acc, base, ids, members):
        left = F.array_min(F.transform(members, lambda m: m["x1"]))
        right = F.array_max(F.transform(members, lambda m: m["x2"]))
        prompt = F.get(F.filter(F.coalesce(base["above"], F.array().cast("array<struct<id:bigint,x:double>>")),
                                lambda p: (p["x"] >= left - 40) & (p["x"] <= right)), 0)["id"]
        good = ~F.array_contains(acc["used"], base["i"]) & ((F.size(ids) >= 3) | ((F.size(ids) == 2) & prompt.isNotNull()))
        area = F.struct(F.transform(members, lambda m: m["line_id"].cast("bigint")).alias("line_ids"), left.alias("x"), base["y"].alias("y"),
                        (right - left).alias("w"), (F.try_element_at(members, F.lit(-1))["y"] - base["y"]).alias("h"), prompt.cast("bigint").alias("prompt_id"))
        return F.struct(F.when(good, F.concat(acc["used"], ids)).otherwise(acc["used"]).alias("used"),
                        F.when(good, F.concat(acc["areas"], F.array(area))).otherwise(acc["areas"]).alias("areas"))

    kind = "array<struct<line_ids:array<bigint>,x:double,y:double,w:double,h:double,prompt_id:bigint>>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("areas"))
    areas = rows.select(*by, F.explode(F.aggregate("rows", start, visit, lambda acc: acc["areas"])).alias("_area"))
    areas = areas.select(*by, "_area.*")
    if crowded is not None:
        areas = areas.unionByName(sweep(crowded, keys, [F.col("y"), F.col("line_id")], Stacks, areas.drop(*by).schema).drop("_island"))
    return areas


def table_structure(line: DataFrame, rect: DataFrame, token: DataFrame, page: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Decision per stroke: kept for writing, or part of the printed structure, with the reason.

    ``token`` has ``is_prompt``. Regular grids are found per snapped (x1, x2) span.
    """
    wide = line.withColumn("len", F.col("x2") - F.col("x1")).withColumn(
        "vertical", F.col("is_vertical") | (F.abs(F.col("x2") - F.col("x1")) < 4))
    flat = wide.where(~F.col("vertical")).withColumns({"s1": half_up(F.col("x1") / 15) * 15, "s2": half_up(F.col("x2") / 15) * 15})
    span = [*by, "s1", "s2"]
    order = Window.partitionBy(*span).orderBy("y", "line_id")
    stepped = flat.withColumn("dy", F.col("y") - F.lag("y").over(order)).withColumn("rank", F.row_number().over(order))
    groups = stepped.groupBy(*span).agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("y"), F.min("x1").alias("x1"), F.max("x2").alias("x2"),
        F.max(F.coalesce((F.col("dy") < 18) | (F.col("dy") > 120), F.lit(False))).alias("uneven"),
        F.max(F.when(F.col("rank") == 2, F.col("dy"))).alias("first_dy"))
    grids = groups.where((F.col("n") >= 3) & ~F.col("uneven") & (F.col("first_dy") >= 24))
    top = grids.select(*span, F.col("x1").alias("x"), F.col("y"), (F.col("x2") - F.col("x1")).alias("w"), F.lit(0.0).alias("h"))
    A, B = box("a_"), box("b_")
    titled = near_join(top, token.select(*by, "x", "y", "w", "h"), by, reach=box().grown(40.0, 35.0, 0.0, 2.0)).where(
        (A.y - B.bottom >= -2) & (A.y - B.bottom <= 35) & (B.x >= A.x - 40) & (B.x <= A.right)
    ).select(*by, F.col("a_s1").alias("s1"), F.col("a_s2").alias("s2")).distinct()
    # each test is written by itself: the files shuffled for one go before the next
    grid = cut_lineage(grids.join(titled, span, "left_anti").select(*span, F.lit(True).alias("in_grid")))
    as_box = flat.select(*by, "line_id", F.col("x1").alias("x"), "y", F.col("len").alias("w"), F.lit(0.0).alias("h"))
    prompt = token.where("is_prompt").select(*by, "x", "y", "w", "h")
    left = (F.abs(B.y + B.h * 0.8 - A.y) < 14) & (B.right <= A.x + 25) & (A.x - B.right < 80)
    above = (A.y - B.bottom >= -2) & (A.y - B.bottom < 24) & (B.x >= A.x - 30) & (B.x < A.right)
    prompted = near_join(as_box, prompt, by, reach=box().grown(80.0, 26.0, 0.0, 26.0)).where(left | above).select(
        *by, F.col("a_line_id").alias("line_id")).distinct().withColumn("prompted", F.lit(True))
    prompted = cut_lineage(prompted)
    boxes = rect.where((F.col("w") >= 30) & (F.col("h") >= 16) & ~F.col("is_checkbox")).select(*by, "x", "y", "w", "h")
    inside = near_join(as_box, boxes, by, reach=box().grown(0.0, 3.0, 0.0, 3.0)).where(
        (A.y >= B.y - 3) & (A.y <= B.bottom + 3) & (A.x >= B.x - 8) & (A.right <= B.right + 8)
    ).select(*by, F.col("a_line_id").alias("line_id")).distinct().withColumn("inside", F.lit(True))
    keys = [*by, "line_id"]
    judged = (
        wide.withColumns({"s1": half_up(F.col("x1") / 15) * 15, "s2": half_up(F.col("x2") / 15) * 15})
        .join(grid, span, "left").join(prompted, keys, "left").join(inside, keys, "left")
        .join(page.select(*by, "page_w"), list(by))
    )
    reason = (
        F.when(F.col("vertical"), "VERTICAL")
        .when((F.col("len") >= F.col("page_w") - 80) & ((F.col("y") <= 65) | (F.col("y") >= 780)), "PAGE_RULE")
        .when(F.col("prompted"), None).when(F.col("in_grid"), "TABLE_GRID").when(F.col("inside"), "TABLE_BOX")
        .when(F.col("len") < 35, "MICRO_LINE"))
    return judged.select(*line.columns, reason.alias("reason"))


def reading_order(item: DataFrame, by: Sequence[str] = PAGE, row_id: str = "field_id", band: float = 4.0) -> DataFrame:
    """``position`` on the page: bands founded by their topmost box, then x."""
    level = Box(F.lit(0.0), F.col("y") - band / 2, F.lit(0.0), F.lit(band))
    owned = greedy_owner(item, by, row_id, [F.col("y"), F.col("x"), F.col(row_id)],
                         lambda k, c: F.abs(k["y"] - c["y"]) <= band, level)
    # positions inside a band, offset by the sizes of the bands above: no page-wide sort of boxes
    inside = Window.partitionBy(*by, "owner_rank").orderBy("x", "y", row_id)
    sizes = owned.groupBy(*by, "owner_rank").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*by).orderBy("owner_rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "owner_rank", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    placed = owned.withColumn("_in", F.row_number().over(inside)).join(offsets, [*by, "owner_rank"])
    return placed.withColumn("position", F.col("_before") + F.col("_in")).drop("_in", "_before", "owner_id", "owner_rank")


def fuse_candidates(field: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Fields of the same area become one: first wins, best confidence, cell geometry and key inherited.

    ``field`` has ``ord`` (order of detection), ``label``, ``semantic_key``, ``derivation``, ``confidence``.
    """
    usual, crowded = by_bands(field, by, F.col("y") - 10, F.col("y") + F.col("h") + 10)
    cols = ["field_id", "x", "y", "w", "h", "label", "semantic_key", "derivation", "confidence"]
    pairs = usual.withColumn("merged", F.lit(0))
    keys = [*by, "_island"]
    rows = sorted_rows(pairs, keys, [F.col("ord"), F.col("field_id")], [*cols, "merged"])
    kind = dict(rows.dtypes)["rows"][len("array<"):-1]

    def same(k, c):
        a, b = box_of(k), box_of(c)
        inter = shared_area(a, b)
        small, large = F.least(a.area, b.area), F.greatest(a.area, b.area)
        away = F.sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))
        return ((inter > 0) & (inter >= 0.55 * (a.area + b.area - inter))) | (
            (small >= large * 0.5) & (inter > 0) & (inter >= small * 0.7)) | (
            (away <= 10) & (F.abs(a.w - b.w) <= 15) & (F.abs(a.h - b.h) <= 10))

    def merge(k, c):
        cell = (c["derivation"] == "TABLE_CELL") & (k["derivation"] != "TABLE_CELL")
        named = k["semantic_key"].isNull() & c["semantic_key"].isNotNull()
        pick = lambda flag, n: F.when(flag, c[n]).otherwise(k[n]).alias(n)
        return F.struct(
            k["field_id"].alias("field_id"), *[pick(cell, n) for n in ("x", "y", "w", "h")], pick(named, "label"), pick(named, "semantic_key"),
            pick(cell, "derivation"), F.greatest(F.coalesce(k["confidence"], F.lit(0.8)), F.coalesce(c["confidence"], F.lit(0.8))).alias("confidence"),
            (k["merged"] + 1).alias("merged"))

    fused = rows.select(*by, F.inline(fold_merge(F.col("rows"), kind, same, merge)))
    if crowded is not None:
        fused = fused.unionByName(sweep(crowded, keys, [F.col("ord"), F.col("field_id")], lambda: Fused(cols), fused.drop(*by).schema).drop("_island"))
    return fused


def second_pass_merge(first: DataFrame, second: DataFrame, by: Sequence[str] = PAGE, over: float = 0.55) -> DataFrame:
    """First-pass fields, then second-pass ones that overlap nothing kept before them."""
    clash = near_join(second, first.select(*by, "x", "y", "w", "h"), by).where(share_of_smaller(box("a_"), box("b_")) >= over)
    free = without_partner(second, clash, by, ["field_id"])
    added = greedy_keep(free, by, "field_id", [F.col("field_id")],
                        lambda k, c: share_of_smaller(box_of(k), box_of(c)) >= over, box())
    return first.withColumn("pass_no", F.lit(1)).unionByName(added.withColumn("pass_no", F.lit(2)))


def box_set_diff(source: DataFrame, candidate: DataFrame, by: Sequence[str] = PAGE, shift: float = 15.0,
                 size: float = 20.0) -> DataFrame:
    """One-to-one box comparison per page: equal (±1), shifted, added, removed.

    Equal pairs are matched first; in each round a source box takes its first free candidate.
    """
    keys = ["box_id", "x", "y", "w", "h"]
    A, B = box("a_"), box("b_")
    pairs = near_join(source.select(*by, *keys), candidate.select(*by, *keys), by, reach=box().grown(*(shift + 1,) * 4))
    equal = (F.abs(A.x - B.x) <= 1) & (F.abs(A.y - B.y) <= 1) & (F.abs(A.right - B.right) <= 1) & (F.abs(A.bottom - B.bottom) <= 1)
    away = F.sqrt((B.x - A.x) * (B.x - A.x) + (B.y - A.y) * (B.y - A.y))
    moved = (away <= shift) & (F.abs(B.w - A.w) <= size) & (F.abs(B.h - A.h) <= size)
    # an equal pair may also come back as a shifted pair once its partner is taken
    options = pairs.where(equal | moved).select(
        *by, F.col("a_box_id").alias("s"), F.col("b_box_id").alias("c"), *[F.col(f"a_{v}").alias(v) for v in ("x", "y", "w", "h")],
        F.explode(F.array_compact(F.array(F.when(equal, 0), F.when(moved, 1)))).alias("round"))
    pair = F.concat_ws("|", F.col("round").cast("string"), F.col("s").cast("string"), F.col("c").cast("string"))
    matched = greedy_keep(cut_lineage(options.withColumn("pair_id", pair)), by, "pair_id", [F.col("round"), F.col("s"), F.col("c")],
                          lambda k, p: (k["s"] == p["s"]) | (k["c"] == p["c"]), box().grown(*(shift + 1,) * 4), fold_limit=folds.FOLD_LIMIT)
    hit = matched.select(*by, F.col("s").alias("source_id"), F.col("c").alias("candidate_id"),
                         F.when(F.col("round") == 0, "equal").otherwise("shifted").alias("change"))
    lost = source.select(*by, F.col("box_id").alias("source_id")).join(hit.select(*by, "source_id"), [*by, "source_id"], "left_anti")
    new = candidate.select(*by, F.col("box_id").alias("candidate_id")).join(hit.select(*by, "candidate_id"), [*by, "candidate_id"], "left_anti")
    return hit.unionByName(lost.withColumn("change", F.lit("removed")), allowMissingColumns=True).unionByName(
        new.withColumn("change", F.lit("added")), allowMissingColumns=True)


def judge_candidates(field: DataFrame, by: Sequence[str] = PAGE, many: int | None = None, refine_over: int | None = None, keep: int | None = None) -> DataFrame:
    """Every proposal with ``reason``: null if it stays, else why a bounded page gives it up.

    The bounds belong to the caller; without them every proposal stays. Pages with more than ``many`` proposals: a generic line is merged
    into the one stacked above it, which becomes a long field (``MERGED``), weak generic ones go (``LOW_CONFIDENCE``). Of pages with more than
    ``refine_over`` left, the best ``keep`` by confidence stay, the others go as ``OVER_BOUND``.

    ``field``: ``field_type``, ``semantic_key``, ``label``, ``confidence``, box, ``field_id``.
    """
    none = F.lit(None).cast("string")
    if many is None:
        return field.withColumn("reason", none)
    # one order of a page serves its count, its neighbours and its runs: each further order or join is a sorted copy of the rows in the task's memory
    page = Window.partitionBy(*by).orderBy("y", "field_id")
    upto = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nxt = lambda c: F.lead(c).over(page)
    short = F.col("field_type") == "TEXT_SHORT"
    joins = F.coalesce(
        short & F.col("semantic_key").isNull() & (nxt("field_type") == "TEXT_SHORT") & (nxt("y") - F.col("y") <= 35) & (nxt("y") > F.col("y"))
        & (F.abs(nxt("x") - F.col("x")) <= 25) & (F.abs(nxt("w") - F.col("w")) <= 30), F.lit(False))
    for key in by:
        field = field.where(F.col(key).isNotNull())
    big = field.withColumns({"_j": joins, "_ny": nxt("y"), "_nh": nxt("h"), "_at": F.row_number().over(page)})
    big = big.withColumn("_big", F.count(F.lit(1)).over(Window.partitionBy(*by)) > many)
    # a run begins behind a row that does not join the next
    begins = ~F.coalesce(F.lag("_j").over(page), F.lit(False))
    big = big.withColumn("_begins", F.when(begins, F.col("_at"))).withColumn("_from", F.max("_begins").over(upto))
    # in a run of joinable neighbours every second one is absorbed by the one above it
    even = (F.col("_at") - F.col("_from")) % 2 == 0
    big = big.withColumn("_absorbs", F.col("_big") & F.col("_j") & even)
    big = big.withColumn("_gone", F.coalesce(F.lag("_absorbs").over(page), F.lit(False)))
    merged_h = F.floor((F.col("_ny") + F.col("_nh") - F.col("y")) * 10 + 0.5) / 10
    takes = F.col("_absorbs") & ~F.col("_gone")
    big = big.withColumns({
        "field_type": F.when(takes, "TEXT_LONG").otherwise(F.col("field_type")),
        "h": F.when(takes, merged_h).otherwise(F.col("h"))})
    weak = F.coalesce((F.col("confidence") > 0) & (F.col("confidence") < 0.85) & F.col("semantic_key").isNull() & F.col("label").contains("Riga"), F.lit(False))
    big = big.withColumn("reason", F.when(F.col("_gone"), "MERGED").when(F.col("_big") & weak, "LOW_CONFIDENCE"))
    if refine_over is not None:
        open_ = F.col("reason").isNull()
        whole = Window.partitionBy(*by)
        rank = F.row_number().over(Window.partitionBy(*by, open_).orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "y", "field_id"))
        over = F.col("_big") & open_ & (F.count_if(open_).over(whole) > refine_over) & (rank > (refine_over if keep is None else keep))
        big = big.withColumn("reason", F.when(over, "OVER_BOUND").otherwise(F.col("reason")))
    return big.select(*by, *[c for c in field.columns if c not in by], "reason")


def cap_candidates(field: DataFrame, by: Sequence[str] = PAGE, many: int | None = None, refine_over: int | None = None, keep: int | None = None) -> DataFrame:
    """The proposals that :func:`judge_candidates` lets stay; without bounds, all."""
    return judge_candidates(field, by, many, refine_over, keep).where(F.col("reason").isNull()).drop("reason")


def retry_plan(a: DataFrame, b: DataFrame, page: DataFrame, by: Sequence[str] = PAGE, limit: int = 6, area: float = 0.16) -> DataFrame:
    """Which places of a page to read again: ranked requests under a slot and an area budget.

    One row per request with ``selected`` and the region it went into; deferred ones stay listed.
    """
    heights = typical_height(a.select(*by, "h").unionByName(b.select(*by, "h")), by)
    sized = cut_lineage(page.select(*by, "page_w", "page_h").join(heights, list(by), "left").withColumn("th", F.coalesce("typical_h", F.lit(20.0))).drop("typical_h"))
    a_ok = valid_boxes(a, page, by).where((F.col("source") == "ocr") & F.col("text").rlike(LETTER_OR_DIGIT))
    read = comparable_reading(a_ok, b, by, touch=0.45).select(*by, *a_ok.drop(*by).columns, F.col("b_text_key").alias("bkey"), "touched")
    seen = read.join(sized, list(by))
    same = F.coalesce(F.col("bkey") == F.col("text_key"), F.lit(False))
    over = (F.col("h") > F.col("th") * 2.4) | (F.col("w") > F.greatest(F.col("page_w") * 0.45, F.col("th") * F.greatest(F.lit(3), F.length("text")) * 1.1))
    mismatch = F.col("bkey").isNull() & F.coalesce("touched", F.lit(False))
    low = F.coalesce("conf", F.lit(0.0)) < 62
    disagrees = F.col("bkey").isNotNull() & ~same
    critical = F.col("text").rlike(r"\d") & disagrees
    asked = seen.where(~(same & ~over) & (over | mismatch | disagrees | low)).select(
        *by, "x", "y", "w", "h", F.array("token_id").alias("token_ids"),
        F.when(over, "oversized-token").when(mismatch, "segmentation-mismatch").when(critical, "critical-disagreement")
        .when(low, "weak-unmatched-reading").otherwise("text-disagreement").alias("reason"),
        F.when(over, 100).when(mismatch, 90).when(critical, 85).when(low, 75).otherwise(50).alias("priority"),
        F.lit(0).alias("part"), F.col("token_id").alias("first_id"))
    b_ok = valid_boxes(b, page, by).where(F.col("text").rlike(LETTER_OR_DIGIT))
    held = overlapping_words(b_ok, a, by)
    keys = [*by, "line_id"]
    values = ["token_id", "x", "y", "w", "h", "th"]
    orphans = cut_lineage(without_partner(b_ok, held, by, ["token_id"]).join(sized.select(*by, "th"), list(by)).select(*keys, *values))
    usual, crowded = split_by_size(orphans, keys, folds.FOLD_LIMIT)
    rows = sorted_rows(usual, keys, [F.col("x"), F.col("token_id")], values)
    at = fold_assign(
        F.col("rows"), "struct<y:double,h:double,lx:double,lr:double>",
        new=lambda t: F.struct(t["y"].alias("y"), t["h"].alias("h"), t["x"].alias("lx"), (t["x"] + t["w"]).alias("lr")),
        accepts=lambda g, t: (F.greatest(F.lit(0.0), F.least(g["y"] + g["h"], t["y"] + t["h"]) - F.greatest(g["y"], t["y"]))
                              / F.greatest(F.lit(1.0), F.least(g["h"], t["h"])) > 0.6) & (t["x"] >= g["lx"]) & (t["x"] - g["lr"] < t["th"] * 3),
        extend=lambda g, t: F.struct(g["y"].alias("y"), g["h"].alias("h"), t["x"].alias("lx"), (t["x"] + t["w"]).alias("lr")))
    flat = rows.select(*keys, F.inline(F.arrays_zip(F.col("rows").alias("_row"), at.alias("g")))).select(*keys, "_row.*", "g")
    if crowded is not None:
        flat = flat.unionByName(_numbered(crowded, keys, [F.col("x"), F.col("token_id")], values, MissingWords, "g"))
    missing = flat.groupBy(*keys, "g").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("bt"),
        F.array_sort(F.collect_list("token_id")).alias("token_ids")).select(
        *by, "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("bt") - F.col("y")).alias("h"), "token_ids",
        F.lit("missing-primary-text").alias("reason"), F.lit(92).alias("priority"), F.lit(1).alias("part"), F.col("token_ids")[0].alias("first_id"))
    requests = asked.unionByName(missing).join(sized, list(by))
    budget = F.col("page_w") * F.col("page_h") * area
    cols = ["x", "y", "w", "h", "token_ids", "reason", "priority", "part", "first_id", "budget"]
    requests = cut_lineage(requests.withColumn("budget", budget).select(*by, *cols))
    order = [-F.col("priority"), F.col("y"), F.col("x"), F.col("part"), F.col("first_id")]
    usual, crowded = split_by_size(requests, by, folds.FOLD_LIMIT)
    rows = sorted_rows(usual, by, order, cols)
    region = "struct<x:double,y:double,w:double,h:double,missing:boolean>"
    any_missing = F.exists("rows", lambda r: r["part"] == 1)

    def step(acc, c):
        ratio = lambda r: share_either(box_of(r), box_of(c))
        found = F.array_position(F.transform(acc["regions"], lambda r: ratio(r) > 0.5), True).cast("int")
        return let(found, lambda at: place(acc, c, at))

    def place(acc, c, at):
        old = F.get(acc["regions"], at - 1)
        left, top = F.least(old["x"], c["x"]), F.least(old["y"], c["y"])
        w = F.greatest(old["x"] + old["w"], c["x"] + c["w"]) - left
        h = F.greatest(old["y"] + old["h"], c["y"] + c["h"]) - top
        extra = w * h - old["w"] * old["h"]
        joins = (at > 0) & (acc["used"] + extra <= c["budget"])
        is_missing = c["part"] == 1
        reserved = any_missing & ~is_missing & (F.size(F.filter(acc["regions"], lambda r: ~r["missing"])) >= max(1, limit - 2))
        opens = (at == 0) & (F.size(acc["regions"]) < limit) & ~reserved & (acc["used"] + c["w"] * c["h"] <= c["budget"])
        grown = F.transform(acc["regions"], lambda r, i: F.when(i == at - 1, F.struct(left.alias("x"), top.alias("y"), w.alias("w"), h.alias("h"), r["missing"].alias("missing"))).otherwise(r))
        fresh = F.struct(*[c[k].alias(k) for k in ("x", "y", "w", "h")], is_missing.alias("missing"))
        return F.struct(
            F.when(joins, grown).when(opens, F.concat(acc["regions"], F.array(fresh))).otherwise(acc["regions"]).alias("regions"),
            (acc["used"] + F.when(joins, extra).when(opens, c["w"] * c["h"]).otherwise(0.0)).alias("used"),
            F.concat(acc["at"], F.array(F.when(joins, at - 1).when(opens, F.size(acc["regions"])))).alias("at"))

    start = F.struct(F.array().cast(f"array<{region}>").alias("regions"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("at"))
    planned = rows.withColumn("plan", F.aggregate("rows", start, step))
    plan = planned.select(*by, F.inline(F.arrays_zip(F.col("rows").alias("_req"), F.col("plan.at").alias("region_no")))).select(
        *by, F.col("_req.first_id").alias("first_id"), F.col("_req.reason").alias("reason"), F.col("_req.priority").alias("priority"),
        F.col("_req.token_ids").alias("token_ids"), F.col("region_no").isNotNull().alias("selected"), F.col("region_no").cast("bigint").alias("region_no"))
    if crowded is not None:
        some = crowded.groupBy(*by).agg(F.max(F.col("part") == 1).alias("_any_missing"))
        plan = plan.unionByName(sweep(crowded.join(some, list(by)), by, order, lambda: Regions(limit), plan.drop(*by).schema))
    return plan
