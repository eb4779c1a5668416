"""From cells, strokes and words to form fields: labels, headers, associations, recovery."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.keys import label_key, tidy
from folioframe.functions.numbers import half_up, round_to
from folioframe.operators.geometry import (
    aligned_peers, cell_adjacency, clamp_boxes, diff_against_existing, geometry_fit, is_protected, snap_to_structure, union_coverage, validate_geometry,
)
from folioframe.operators.layout import fuse_candidates, judge_candidates, merge_colinear, multiline_areas, page_text, table_structure
from folioframe.operators.readings import typical_height
from folioframe.plans.graphs import both_ways, components
from folioframe.plans.greedy import greedy_keep, greedy_owner
from folioframe.plans.spatial import PAGE, Box, best_partner, box, box_of, near_join, share, touches, without_partner
from folioframe.plans.sweeps import Reached, sweep
from folioframe.session import cut_lineage

A, B = "a_", "b_"


def _flat(y: Column, up: float = 0.0, down: float = 0.0) -> Box:
    """A horizontal band without width: rows meet whatever their x is."""
    return Box(F.lit(0.0), y - up, F.lit(0.0), F.lit(up + down))


def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(True))


def line_boxes(line: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Strokes as boxes without height (``line_id``, x, y, w, h)."""
    return line.select(*by, "line_id", F.col("x1").alias("x"), "y", (F.col("x2") - F.col("x1")).alias("w"), F.lit(0.0).alias("h"))


# ---------------------------------------------------------------- labels near fields
def nearest_label(field: DataFrame, label: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Label on the same line to the left (up to 250), else the one directly above; left outer."""
    a, b = box(A), box(B)
    words = label.select(*by, "token_id", "x", "y", "w", "h", "text")
    pairs = near_join(field.select(*by, "field_id", "x", "y", "w", "h"), words, by, reach=box().grown(left=250.0),
                      b_extent=box().grown(0.0, F.col("h") * 1.5, 6.0, F.col("h") * 1.5))
    left = (b.right <= a.x + 6) & (a.x - b.right < 250) & (F.abs(b.cy - a.cy) < F.greatest(a.h / 2, b.h * 1.5))
    above = (b.bottom <= a.y + 4) & (a.y - b.bottom < b.h * 1.2) & (b.x < a.right) & (b.right > a.x)
    best = best_partner(pairs.where(left | above).withColumnRenamed("a_field_id", "field_id"), [*by, "field_id"],
                        [F.when(left, 0).otherwise(1), F.when(left, -b.x).otherwise(-b.y), F.col("b_token_id")],
                        {"label_text": F.col("b_text"), "label_token": F.col("b_token_id"), "label_side": F.when(left, "left").otherwise("above")})
    return field.join(best, [*by, "field_id"], "left")


def associate_label(region: DataFrame, token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Label, method and confidence per checkbox, empty cell or underline.

    ``region.kind``: checkbox, cell, underline (its ``y`` two above the stroke); ``token``: ``is_label``, ``is_prompt``.
    """
    a, b = box(A), box(B)
    far = lambda cell, checkbox, rule: F.when(F.col("kind") == "cell", cell).when(F.col("kind") == "checkbox", checkbox).otherwise(rule)
    pairs = near_join(region.select(*by, "region_id", "kind", "x", "y", "w", "h"), token.select(*by, "token_id", "x", "y", "w", "h", "text", "is_label", "is_prompt"), by,
                      reach=box().grown(far(120.0, 80.0, 140.0), far(250.0, 20.0, 26.0), far(50.0, 100.0, 60.0), 20.0))
    ok, asks, kind, rise = F.col("b_is_label"), F.col("b_is_prompt"), F.col("a_kind"), a.y - b.bottom
    box_, cell, rule = kind == "checkbox", kind == "cell", kind == "underline"
    level, stroke = F.abs(b.y - a.y) < 14, a.y + 2
    rules = [
        (box_ & ok & level & (b.x >= a.right - 5) & (b.x - a.x < 100), "RIGHT_NEIGHBOR", 0.90, b.x),
        (box_ & ok & level & (b.right <= a.x + 5) & (a.x - b.right < 80), "LEFT_NEIGHBOR", 0.90, b.right),
        (box_ & ok & (rise >= 0) & (rise < 20) & (F.abs(b.x - a.x) < 80), "TOP_HEADER", 0.90, b.bottom),
        (cell & asks & (b.right <= a.x + 8) & (a.x - b.right < 120) & (F.abs(b.y - a.y) < 20), "LEFT_NEIGHBOR", 0.88, F.lit(0.0)),
        (cell & (rise >= -2) & (rise < 30) & (F.abs(b.x - a.x) < 50), "TOP_HEADER", 0.85, F.lit(0.0)),
        (cell & (rise >= 0) & (rise < 250) & (b.x >= a.x - 10) & (b.x <= a.right), "COLUMN_HEADER", 0.80, F.lit(0.0)),
        (rule & asks & (F.abs(b.y - stroke) < 18) & (b.right <= a.x + 10) & (a.x - b.right < 140), "LEFT_NEIGHBOR", 0.88, a.x - b.right),
        (rule & asks & (stroke - b.bottom >= 0) & (stroke - b.bottom < 24) & (F.abs(b.x - a.x) < 60), "TOP_HEADER", 0.88, stroke - b.bottom),
    ]
    found = None
    for i, (test, method, sure, away) in enumerate(rules):
        row = F.struct(F.lit(i).alias("rank"), away.cast("double").alias("away"), F.lit(method).alias("method"), F.lit(sure).alias("sure"))
        found = F.when(test, row) if found is None else found.when(test, row)
    hit = pairs.withColumn("_m", found).where(F.col("_m").isNotNull()).withColumnRenamed("a_region_id", "region_id")
    best = best_partner(hit, [*by, "region_id"], [F.col("_m.rank"), F.col("_m.away"), F.col("b_token_id")],
                        {"label": F.trim(F.regexp_replace("b_text", ":$", "")), "method": F.col("_m.method"), "label_confidence": F.col("_m.sure")})
    return region.join(best, [*by, "region_id"], "left").withColumns({
        "method": F.coalesce("method", F.lit("UNASSOCIATED")), "label_confidence": F.coalesce("label_confidence", F.lit(0.0))})


def row_group_prompt(checkbox: DataFrame, token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """``group_prompt``: last valid label left of the whole group of choices on the row of a checkbox.

    ``token``: ``is_choice`` (a printed checkbox symbol), ``is_label``.
    """
    boxes = checkbox.select(*by, "region_id", "x", "y")
    words = token.select(*by, "token_id", "x", "y", "w", "text", "is_choice", "is_label")
    row = near_join(boxes, words, by, reach=_flat(F.col("y"), 14.0, 14.0), b_extent=_flat(F.col("y"))).where(F.abs(F.col("b_y") - F.col("a_y")) < 14)
    keys = [*by, "region_id"]
    row = row.withColumnRenamed("a_region_id", "region_id")
    start = row.where("b_is_choice").groupBy(*keys).agg(F.min("b_x").alias("_first"))
    right = F.col("b_x") + F.col("b_w")
    before = row.join(start, keys, "left").where(F.col("b_is_label") & ~F.col("b_is_choice") & (right <= F.coalesce("_first", "a_x") + 4))
    best = best_partner(before, keys, [-right, F.col("b_token_id")], {"group_prompt": F.col("b_text")})
    return checkbox.join(best, keys, "left")


def uncovered_labels(token: DataFrame, region: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Prompts with no cell, box or line near them."""
    a, b = box(A), box(B)
    prompts = token.where("is_prompt")
    near = near_join(prompts.select(*by, "token_id", "x", "y", "w", "h"), region.select(*by, "x", "y", "w", "h"), by, reach=box().grown(60.0, 20.0, 150.0, 40.0)).where(
        ((F.abs(b.y - a.y) < 20) & (b.right >= a.x - 30) & (b.x <= a.right + 150))
        | ((b.y >= a.bottom - 5) & (b.y <= a.bottom + 40) & (F.abs(b.x - a.x) < 60)))
    return without_partner(prompts, near, by, ["token_id"]).withColumn("reason", F.lit("NO_PHYSICAL_GEOMETRY"))


def uncovered_tokens(token: DataFrame, field: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Markers and prompts no field answers: neither over them, nor right of them, nor just below.

    ``token``: ``is_marker`` (a writing mark needs no label match) and ``is_prompt``.
    """
    a, b = box(A), box(B)
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), "[^a-zà-ù0-9]+", " "))
    wanted = token.where(F.col("is_marker") | F.col("is_prompt")).withColumn("_n", plain("text"))
    fields = field.select(*by, "x", "y", "w", "h", plain("label").alias("_n"))
    pairs = near_join(wanted.select(*by, "token_id", "x", "y", "w", "h", "is_marker", "_n"), fields, by,
                      reach=box().grown(4.0, F.col("h") * 2, F.greatest(F.lit(40.0), F.col("h") * 4), F.col("h") * 2))
    same = F.col("a_is_marker") | ((F.col("a__n") != "") & ((F.col("b__n") == F.col("a__n")) | F.col("b__n").startswith(F.concat("a__n", F.lit(" ")))))
    row = (b.x >= a.right - 4) & (b.x - a.right <= F.greatest(F.lit(40.0), a.h * 4)) & (F.abs(b.cy - a.cy) <= F.greatest(a.h, F.least(b.h, a.h * 2)) * 0.75)
    below = (b.y >= a.bottom - 4) & (b.y - a.bottom <= a.h * 2) & ((F.least(a.right, b.right) - F.greatest(a.x, b.x)) >= F.least(a.w, b.w) * 0.5)
    over = touches(a, b) & (share(a, b) >= 0.5)
    return without_partner(wanted.drop("_n"), pairs.where(over | (same & (row | below))), by, ["token_id"])


# ---------------------------------------------------------------- tables and headers
def table_components(cell: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """``component`` per cell: cells joined by measured sides form one table."""
    edges = cell_adjacency(cell, heights, by)
    return components(cell, edges, by, "cell_id", "cell_a", "cell_b")


def cell_texts(cell: DataFrame, token: DataFrame, by: Sequence[str] = PAGE, name: str = "text") -> DataFrame:
    """Text of the words inside each cell, line by line (cells without words are absent)."""
    return page_text(_words_inside(cell, token, by).drop("w"), [*by, "cell_id"]).withColumnRenamed("text", name)


def _words_inside(cell: DataFrame, token: DataFrame, by: Sequence[str]) -> DataFrame:
    inside = near_join(token.select(*by, "token_id", "line_id", "x", "y", "w", "h", "text"), cell.select(*by, "cell_id", "x", "y", "w", "h"), by).where(share(box(A), box(B)) > 0.55)
    return inside.select(*by, F.col("b_cell_id").alias("cell_id"), *[F.col("a_" + c).alias(c) for c in ("token_id", "line_id", "x", "y", "w", "text")])


def _tolerant(cell: DataFrame, heights: DataFrame, by: Sequence[str]) -> DataFrame:
    th = F.coalesce("typical_h", F.lit(20.0))
    return cell.join(heights.select(*by, "typical_h"), list(by), "left").withColumns({
        "th": th, "tol": F.greatest(F.lit(5.0), th * 0.6), "pad": F.greatest(F.lit(4.0), th * 0.2)}).drop("typical_h")


def _stacked(cell: DataFrame, by: Sequence[str], upper: DataFrame) -> DataFrame:
    """(upper, lower) pairs of cells that touch along a horizontal side, for the cells that ``upper`` names. ``cell`` has ``tol``."""
    a, b = box(A), box(B)
    slim = cell.select(*by, "cell_id", "x", "y", "w", "h", "tol")
    pairs = near_join(slim.join(upper, [*by, "cell_id"], "left_semi"), slim, by, reach=box().grown(*(F.col("tol"),) * 4), tile=512.0)
    return pairs.where((F.col("a_cell_id") != F.col("b_cell_id")) & (F.abs(a.bottom - b.y) <= F.col("a_tol"))
                       & ((F.least(a.right, b.right) - F.greatest(a.x, b.x)) >= F.least(a.w, b.w) * 0.7))


def column_headers(cell: DataFrame, token: DataFrame, second: DataFrame, dictionary: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE,
                   component: DataFrame | None = None) -> DataFrame:
    """Header cells by dictionary: a body below (or a header beside that has one); the second reader's
    header only beside another distinct header of its row and table; disagreement is flagged.

    ``dictionary(header_key, label, type, is_group)``.
    """
    keys = [*by, "cell_id"]
    member = table_components(cell, heights, by) if component is None else component
    # every later step reads the cells, and each step the candidates left by the one before: written once, not derived anew in each branch
    sized = cut_lineage(_tolerant(cell.join(member.select(*keys, "component"), keys), heights, by))
    named = dictionary.select("header_key", F.col("label").alias("_label"), "type", "is_group")
    low = sized.where(F.col("h") <= F.col("th") * 6)

    def read(words: DataFrame, p: str) -> DataFrame:
        text = cell_texts(low, words, by).withColumn("header_key", F.regexp_replace(label_key(F.col("text")), r"^\*\s*", ""))
        return cut_lineage(text.join(named, "header_key").select(*keys, F.col("_label").alias(p + "label"), F.col("type").alias(p + "type"), F.col("is_group").alias(p + "group")))

    cand = cut_lineage(low.join(read(token, "p_"), keys, "left").join(read(second, "s_"), keys, "left").where(F.coalesce("p_label", "s_label").isNotNull()))
    row = cand.select(*by, "component", "cell_id", "x", "y", "w", "h", "tol", "p_label", "s_label", F.coalesce("s_label", "p_label").alias("any_label"))
    beside = near_join(row, row, [*by, "component"], reach=_flat(F.col("y"), 0.0, 0.0).grown(0.0, F.col("tol"), 0.0, F.col("tol")), b_extent=_flat(F.col("y"))).where(
        (F.col("a_cell_id") != F.col("b_cell_id")) & (F.abs(F.col("b_y") - F.col("a_y")) < F.col("a_tol")))
    backed = beside.where(F.col("b_any_label") != F.col("a_s_label")).select(*by, F.col("a_cell_id").alias("cell_id")).distinct()
    cand = cand.join(_flag(backed, "backed"), keys, "left")
    second_only = F.col("p_label").isNull()
    cand = cand.where(~second_only | F.coalesce("backed", F.lit(False)))
    body = _stacked(sized, by, cand.select(*keys)).select(*by, F.col("a_cell_id").alias("cell_id")).distinct()
    cand = cut_lineage(cand.join(_flag(body, "has_body"), keys, "left").withColumn("has_body", F.coalesce("has_body", F.lit(False))))
    a, b = box(A), box(B)
    slim = cand.select(*by, "cell_id", "x", "y", "w", "h", "tol", "has_body")
    side = near_join(slim, slim.where("has_body"), by, reach=box().grown(*(F.col("tol"),) * 4), tile=512.0).where(
        (F.col("a_cell_id") != F.col("b_cell_id")) & (F.least(F.abs(a.right - b.x), F.abs(b.right - a.x)) <= F.col("a_tol"))
        & ((F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)) >= F.least(a.h, b.h) * 0.7)).select(*by, F.col("a_cell_id").alias("cell_id")).distinct()
    cand = cand.join(_flag(side, "has_side"), keys, "left").where(F.col("has_body") | F.col("has_side"))
    return cand.select(
        *keys, "component", "x", "y", "w", "h", F.coalesce("p_label", "s_label").alias("label"), F.coalesce("p_type", "s_type").alias("type"),
        F.coalesce("p_group", "s_group").alias("is_group"), F.when(second_only, "secondary").otherwise("primary").alias("source"),
        F.coalesce((F.col("s_label") != F.col("p_label")), F.lit(False)).alias("conflict"))


def header_ancestors(cell: DataFrame, header: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE, component: DataFrame | None = None) -> DataFrame:
    """(cell, header) pairs: headers over the column of a cell, reached through cells not below it, those of the nearest level.

    Only pairs of one table that share a column are asked for. One sweep down every table joins touching cells as they begin; a
    cell's pairs are judged when all that lies no lower than it is joined. Rounds of joins are left for cells with several nearest headers: ``steps`` is the length of
    the path to each of these, and null where there is one header only.
    """
    a, b = box(A), box(B)
    keys = [*by, "cell_id"]
    sized = _tolerant(cell, heights, by)
    member = table_components(cell, heights, by) if component is None else component
    slim = cut_lineage(sized.join(member.select(*keys, "component"), keys).select(*by, "cell_id", "component", "x", "y", "w", "h", "tol"))
    heads = header.where(~F.col("is_group")).select(*by, F.col("cell_id").alias("head_id"), "component", "x", "y", "w", "h", "label", "type", "source", "conflict")
    column = near_join(slim, heads, [*by, "component"], reach=Box(F.col("x"), F.lit(0.0), F.col("w"), F.col("y") + F.col("h")), tile=512.0).where(
        (F.col("a_cell_id") != F.col("b_head_id")) & (b.bottom <= a.y + F.col("a_tol"))
        & ((F.least(a.right, b.right) - F.greatest(a.x, b.x)) >= F.least(a.w, b.w) * 0.7))
    pending = cut_lineage(column.select(*by, "component", F.col("a_cell_id").alias("cell_id"), F.col("b_head_id").alias("head_id"), (a.y + F.col("a_tol")).alias("limit"), (b.y + b.h).alias("head_bottom"),
                                     F.col("b_w").alias("head_w"), F.col("b_label").alias("label"), F.col("b_type").alias("type"), F.col("b_source").alias("source"), F.col("b_conflict").alias("conflict"), F.col("a_tol").alias("tol")))
    # only tables with a header are swept
    live = slim.join(heads.select(*by, "component").distinct(), [*by, "component"], "left_semi")
    adjacent = cut_lineage(cell_adjacency(cell, heights, by).select(*by, "cell_a", "cell_b"))
    ends = lambda p: live.select(*by, F.col("cell_id").alias(f"cell_{p}"), "component", F.col("y").alias(f"y_{p}"))
    links = adjacent.join(ends("a"), [*by, "cell_a"]).join(ends("b").drop("component"), [*by, "cell_b"]).select(
        *by, "component", F.greatest("y_a", "y_b").alias("at"), F.lit(False).alias("ask"), F.col("cell_a").alias("one"), F.col("cell_b").alias("other"))
    asked = pending.select(*by, "component", F.col("limit").alias("at"), F.lit(True).alias("ask"), F.col("cell_id").alias("one"), F.col("head_id").alias("other"))
    kind = T.StructType([T.StructField("cell_id", cell.schema["cell_id"].dataType), T.StructField("head_id", cell.schema["cell_id"].dataType)])
    met = sweep(links.unionByName(asked), [*by, "component"], [F.col("at"), F.col("ask"), F.col("one"), F.col("other")], Reached, kind).drop("component")
    reached = cut_lineage(pending.join(met, [*keys, "head_id"]))
    nearest = reached.groupBy(*keys).agg(F.max("head_bottom").alias("_near"))
    near = reached.join(nearest, keys).where(F.col("_near") - F.col("head_bottom") <= F.col("tol")).drop("_near")
    rivals = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    near = cut_lineage(near.join(_flag(rivals, "_rival"), keys, "left"))
    steps = _path_lengths(near.where("_rival"), adjacent, cell, by)
    return near.join(steps, [*keys, "head_id"], "left").drop("_rival", "tol", "component", "limit")


def _path_lengths(pair: DataFrame, adjacent: DataFrame, cell: DataFrame, by: Sequence[str]) -> DataFrame:
    """``steps`` from a cell to each of its headers through cells that begin no lower than its limit; a round a step, until the last of them is met."""
    keys = [*by, "cell_id"]
    links = both_ways(adjacent, by, "cell_a", "cell_b")
    links = links.join(cell.select(*by, F.col("cell_id").alias("dst"), F.col("y").alias("dst_y")), [*by, "dst"])
    open_ = cut_lineage(pair.select(*keys, "head_id", "limit"))
    front = open_.select(*keys, "limit", F.col("cell_id").alias("at")).distinct()
    seen, found, step = front.select(*keys, "at"), open_.limit(0).select(*keys, "head_id", F.lit(0).alias("steps")), 0
    if not open_.isEmpty():
        links = cut_lineage(links)
    while not open_.isEmpty():
        step += 1
        nxt = front.join(links.withColumnRenamed("src", "at"), [*by, "at"]).where(F.col("dst_y") <= F.col("limit")).select(*keys, "limit", F.col("dst").alias("at")).distinct()
        front = cut_lineage(nxt.join(seen, [*keys, "at"], "left_anti"))
        hit = open_.join(front.select(*keys, F.col("at").alias("head_id")), [*keys, "head_id"], "left_semi")
        found = cut_lineage(found.unionByName(hit.select(*keys, "head_id", F.lit(step).alias("steps"))))
        open_ = cut_lineage(open_.join(found, [*keys, "head_id"], "left_anti"))
        seen = seen.unionByName(front.select(*keys, "at"))
        front = front.join(open_.select(*keys).distinct(), keys, "left_semi")
    return found


def signature_lines(line: DataFrame, token: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE, anchor: str = r"(?i)^firma(?:\b|\s)") -> DataFrame:
    """Anchor word less than three heights above a line: a field over the line."""
    a, b = box(A), box(B)
    th, pad = F.col("a_th"), F.col("a_pad")
    strokes = _tolerant(line_boxes(line, by), heights, by).where(F.col("w") >= F.col("th") * 3)
    words = token.where(tidy(F.col("text")).rlike(anchor)).select(*by, "token_id", "x", "y", "w", "h", "text")
    near = near_join(strokes, words, by, reach=box().grown(0.0, F.col("th") * 3, 0.0, F.col("pad"))).where(
        (b.bottom <= a.y + pad) & (a.y - b.bottom < th * 3) & ((F.least(a.right, b.right) - F.greatest(a.x, b.x)) > F.least(a.w, b.w) * 0.5))
    best = best_partner(near.withColumnRenamed("a_line_id", "line_id"), [*by, "line_id"], [-b.y, F.col("b_token_id")], {
        "label": tidy(F.col("b_text")), "token_id": F.col("b_token_id"), "x": a.x, "y": F.greatest(F.lit(0.0), a.y - th * 1.3), "w": a.w, "h": th * 1.25})
    return best


def _row_numbers(placed: DataFrame, below: DataFrame, by: Sequence[str]) -> DataFrame:
    """``row_no``: which body row of its table a cell stands in, counted over the distinct (rounded) tops under its header.

    One running count over the tops of a table, read at both ends of every cell's span: never a row for cell and row top.
    """
    keys = [*by, "cell_id"]
    top = placed.groupBy(*by, "component", half_up(F.col("y") / F.col("tol")).alias("_row")).agg(F.min("y").alias("at"))
    ends = placed.join(below, keys).select(*keys, "component", F.explode(F.array(
        F.struct((F.col("hb") - F.col("tol")).alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")),
        F.struct((F.col("y") + F.col("tol")).alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("sign")))).alias("e"))
    events = top.select(*by, "component", F.lit(None).cast(placed.schema["cell_id"].dataType).alias("cell_id"), "at", F.lit(1).alias("turn"), F.lit(0).alias("sign"), F.lit(1).alias("one")).unionByName(
        ends.select(*by, "component", "cell_id", "e.at", "e.turn", "e.sign", F.lit(0).alias("one")))
    upto = Window.partitionBy(*by, "component").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("_n", F.sum("one").over(upto)).where(F.col("sign") != 0)
    return counted.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("sign")).alias("row_no"))


def associate_fields(cell: DataFrame, token: DataFrame, second: DataFrame, field: DataFrame, page: DataFrame, dictionary: DataFrame, prompt_key: DataFrame,
                     heights: DataFrame, by: Sequence[str] = PAGE, checkbox: DataFrame | None = None,
                     instruction: str = r"(?i)^(?:specificare|indicare|descrivere|a cura|descrizione del servizio|tipologia di assistenza|numero di ore)\b") -> DataFrame:
    """One decision per cell: static, proposed, enriched, covered, ambiguous, blocked or unmatched.

    ``field``: ``generic`` plus the protection columns; ``cell`` may carry ``ink_ratio``;
    ``prompt_key(key)``: label keys of captions that may name the cell at their right.
    """
    keys = [*by, "cell_id"]
    a, b = box(A), box(B)
    member = cut_lineage(table_components(cell, heights, by).select(*keys, "component"))
    head = cut_lineage(column_headers(cell, token, second, dictionary, heights, by, member))
    above = cut_lineage(header_ancestors(cell, head, heights, by, member))
    sized = _tolerant(cell, heights, by).join(page.select(*by, "page_w", "page_h"), list(by))
    texts = cell_texts(cell, token, by, "own_text")
    known = _flag(prompt_key.select(F.col("key").alias("_key")).distinct(), "_known")
    said = texts.withColumn("_key", label_key(F.col("own_text"))).join(known, "_key", "left").select(
        *keys, "own_text", (F.coalesce("_known", F.lit(False)) | F.col("own_text").rlike(r"[:?]\s*$")).alias("asks"),
        tidy(F.col("own_text")).rlike(r"^\d{1,2}[.:]\d{2}\s*[-–]\s*\d{1,2}[.:]\d{2}$|(?i)^(?:mattina|pomeriggio)$").alias("axis"))
    base = cut_lineage(sized.join(said, keys, "left").withColumns({"asks": F.coalesce("asks", F.lit(False)), "axis": F.coalesce("axis", F.lit(False))}))
    slim = base.select(*by, "cell_id", "x", "y", "w", "h", "tol", "own_text", "asks", "axis")
    inner = near_join(slim, slim, by, tile=512.0).where((F.col("a_cell_id") != F.col("b_cell_id")) & (b.area < a.area * 0.8) & (share(b, a) > 0.95)).select(
        *by, F.col("a_cell_id").alias("cell_id")).distinct()
    # only cells that ask or name an axis tell their right neighbours anything; five questions read these pairs
    side = cut_lineage(near_join(slim, slim.where(F.col("asks") | F.col("axis")), by, reach=box().grown(*(F.col("tol"),) * 4), tile=512.0).where(
        (F.col("a_cell_id") != F.col("b_cell_id")) & (F.abs(b.right - a.x) <= F.col("a_tol")) & ((F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)) >= a.h * 0.75)).select(
        *by, *[F.col("a_" + c) for c in ("cell_id", "w", "tol")], *[F.col("b_" + c) for c in ("cell_id", "x", "w", "h", "own_text", "asks", "axis")]))
    caption = side.where(F.col("b_asks") & (a.w > b.w * 1.25)).select(*by, F.col("b_cell_id").alias("cell_id")).distinct()
    left = side.where((b.w < a.w * 0.8) & F.col("b_asks")).withColumnRenamed("a_cell_id", "cell_id")
    lefts = left.groupBy(*keys).agg(F.max("b_x").alias("_lx"), F.max_by(F.struct(F.col("b_own_text").alias("t"), F.col("b_h").alias("h")), F.struct(F.col("b_x"), -F.col("b_cell_id"))).alias("_l"))
    rivals = left.join(lefts.select(*keys, "_lx"), keys).where(F.abs(F.col("b_x") - F.col("_lx")) < F.col("a_tol")).groupBy(*keys).agg(F.countDistinct(label_key(F.col("b_own_text"))).alias("_labels"))
    axis = best_partner(side.where("b_axis").withColumnRenamed("a_cell_id", "cell_id"), keys, [-F.col("b_x"), F.col("b_cell_id")], {"axis_text": tidy(F.col("b_own_text"))})
    tops = above.groupBy(*keys).agg(F.countDistinct("label").alias("_heads"), F.min(F.struct("steps", "head_id", "label", "type", "source", "conflict", "head_w", "head_bottom")).alias("_h"))
    numbered = _row_numbers(base.join(member, keys), tops.select(*keys, F.col("_h.head_bottom").alias("hb")), by)
    prompts = token.where("is_prompt").select(*by, "token_id", "x", "y", "w", "h", "text")
    outside = without_partner(prompts, near_join(prompts, cell.select(*by, "cell_id", "x", "y", "w", "h"), by).where(share(a, b) > 0.55), by, ["token_id"])
    wide = base.where(F.col("w") > F.col("page_w") * 0.35).select(*by, "cell_id", "x", "y", "w", "h", "th", "pad")
    ext = near_join(wide, outside, by, reach=box().grown(0.0, F.col("th") * 2.5, 0.0, F.col("pad"))).where(
        (b.bottom <= a.y + F.col("a_pad")) & (a.y - b.bottom < F.col("a_th") * 2.5) & ((F.least(a.right, b.right) - F.greatest(a.x, b.x)) > F.least(a.w, b.w) * 0.6))
    external = best_partner(ext.withColumnRenamed("a_cell_id", "cell_id"), keys, [-b.y, F.col("b_token_id")], {"ext_text": tidy(F.col("b_text"))})
    ordered = near_join(token.where(F.col("text").rlike(instruction)).select(*by, "x", "y", "w", "h"), cell.select(*by, "cell_id", "x", "y", "w", "h"), by).where(
        (share(a, b) > 0.55) & (a.y < b.y + b.h * 0.55)).select(*by, F.col("b_cell_id").alias("cell_id")).distinct()
    j = cut_lineage(base.join(head.select(*keys, F.col("label").alias("head_label")), keys, "left").join(tops, keys, "left").join(_flag(inner, "_inner"), keys, "left")
                    .join(_flag(caption, "_caption"), keys, "left").join(lefts.drop("_lx"), keys, "left"))
    j = (j.join(rivals, keys, "left").join(axis, keys, "left").join(numbered, keys, "left").join(external, keys, "left").join(_flag(ordered, "_ordered"), keys, "left"))
    if checkbox is not None:
        ticks = near_join(checkbox.select(*by, "x", "y", "w", "h"), cell.select(*by, "cell_id", "x", "y", "w", "h"), by).where(share(a, b) > 0.9).select(*by, F.col("b_cell_id").alias("cell_id")).distinct()
        j = j.join(_flag(ticks, "_ticks"), keys, "left")
    else:
        j = j.withColumn("_ticks", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    no_head = F.col("_h").isNull()
    by_left = no_head & F.col("_l").isNotNull()
    by_ext = no_head & F.col("_l").isNull() & F.col("ext_text").isNotNull()
    relation = (F.when(~no_head, "column-header").when(by_left & (F.col("_l.h") > F.col("h") * 1.5), "merged-row-label").when(by_left, "row-label").when(by_ext, "external-prompt"))
    static = (F.when(F.col("head_label").isNotNull(), "COLUMN_HEADER_STATIC").when(F.col("_inner"), "CONTAINER_REGION_STATIC")
              .when(no_head & ((F.col("asks") & yes(F.col("_caption"))) | F.col("axis")), "ROW_LABEL_STATIC"))
    doubt = (F.when(~no_head & (F.col("_heads") > 1), "COMPETING_COLUMN_HEADERS").when(~no_head & F.col("_h.conflict"), "READER_HEADER_DISAGREEMENT")
             .when(~no_head & (F.col("_h.head_w") > F.col("w") * 1.5), "MERGED_HEADER_WITHOUT_LEAF").when(by_left & (F.col("_labels") > 1), "COMPETING_ROW_LABELS")
             .when(relation.isNotNull() & yes(F.col("_ticks")), "COMPOUND_RESPONSE_NEEDS_SPLITTING")
             .when(relation.isNotNull() & no_head & yes(F.col("_ordered")), "PRINTED_OR_FILLED_INSTRUCTION"))
    label = (F.when(~no_head & F.col("axis_text").isNotNull() & (F.col("_h.type") == "day"), F.concat_ws(" — ", F.col("_h.label"), F.col("axis_text")))
             .when(~no_head, F.concat(F.col("_h.label"), F.lit(" — riga "), F.greatest(F.lit(1), F.coalesce("row_no", F.lit(1))).cast("string")))
             .when(by_left, tidy(F.col("_l.t"))).otherwise(F.col("ext_text")))
    pad = F.col("pad")
    j = j.withColumns({"relation": relation, "_static": static, "_doubt": doubt, "label": label, "source": F.col("_h.source"), "ink": F.col("ink_ratio") if "ink_ratio" in cell.columns else F.lit(0.0)})
    j = j.withColumns({"rx": F.col("x") + pad, "ry": F.col("y") + pad, "rw": F.col("w") - pad * 2, "rh": F.col("h") - pad * 2})
    j = cut_lineage(j)
    open_ = j.where(F.col("_static").isNull() & F.col("_doubt").isNull() & F.col("relation").isNotNull())
    ask = open_.select(*by, "cell_id", F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rw").alias("w"), F.col("rh").alias("h"))
    fields = field.select(*by, "field_id", "x", "y", "w", "h", "generic", is_protected().alias("protected"), F.lit("review").alias("status"))
    hit = near_join(ask, fields, by, tile=512.0).where(touches(a, b)).withColumnRenamed("a_cell_id", "cell_id").withColumn("refinable", F.col("b_generic") & ~F.col("b_protected") & (share(b, a) > 0.8))
    flags = hit.groupBy(*keys).agg(F.max("b_protected").alias("_prot"), F.count_if("refinable").alias("_ref"), F.count_if(~F.col("refinable")).alias("_other"))
    others = hit.where(~F.col("refinable")).select(*by, *[F.col("b_" + c).alias(c) for c in ("field_id", "x", "y", "w", "h", "status")]).dropDuplicates([*by, "field_id"])
    cover = union_coverage(ask, others, by, region_id="cell_id").select(*keys, "coverage")
    j = j.join(flags, keys, "left").join(cover, keys, "left")
    small = (F.col("rx") < 0) | (F.col("ry") < 0) | (F.col("rw") < F.col("th")) | (F.col("rh") < 6) | (F.col("rx") + F.col("rw") > F.col("page_w")) | (F.col("ry") + F.col("rh") > F.col("page_h"))
    ref, other = F.coalesce("_ref", F.lit(0)), F.coalesce("_other", F.lit(0))
    result = (F.when(F.col("_static").isNotNull(), F.struct(F.lit("static").alias("o"), F.col("_static").alias("r")))
              .when(F.col("_doubt").isNotNull(), F.struct(F.lit("ambiguous").alias("o"), F.col("_doubt").alias("r")))
              .when(F.col("relation").isNull(), F.struct(F.lit("unmatched").alias("o"), F.lit("NO_MEASURED_ASSOCIATION").alias("r")))
              .when(small, F.struct(F.lit("blocked").alias("o"), F.lit("ASSOCIATED_RESPONSE_TOO_SMALL").alias("r")))
              .when(yes(F.col("_prot")), F.struct(F.lit("blocked").alias("o"), F.lit("PROTECTED_FIELD_CONFLICT").alias("r")))
              .when((other > 0) & (F.col("coverage") >= 0.65), F.struct(F.lit("covered").alias("o"), F.lit("EXISTING_FIELD_RETAINED").alias("r")))
              .when(other > 0, F.struct(F.lit("blocked").alias("o"), F.lit("PARTIAL_FIELD_CONFLICT").alias("r")))
              .when(ref > 1, F.struct(F.lit("ambiguous").alias("o"), F.lit("MULTIPLE_GENERIC_FIELDS").alias("r")))
              .when(ref == 1, F.struct(F.lit("enriched").alias("o"), F.lit("GENERIC_FIELD_ASSOCIATED").alias("r")))
              .when(F.col("own_text").isNull() & (F.coalesce("ink", F.lit(0.0)) > 0.012), F.struct(F.lit("ambiguous").alias("o"), F.lit("INK_WITHOUT_POSITIONED_TEXT").alias("r")))
              .otherwise(F.struct(F.lit("proposed").alias("o"), F.lit("ASSOCIATED_FIELD_PROPOSED").alias("r"))))
    decided = j.withColumn("_r", result).select(*keys, F.col("_r.o").alias("outcome"), F.col("_r.r").alias("reason"), "relation", "label", "source", F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rw").alias("w"), F.col("rh").alias("h"))
    decided = cut_lineage(decided)
    # proposals of overlapping cells: an earlier one holds its place
    new = greedy_owner(decided.where("outcome = 'proposed'"), by, "cell_id", [F.col("cell_id")], lambda k, c: touches(box_of(k), box_of(c)), box(), tile=512.0)
    lost = F.col("owner_id") != F.col("cell_id")
    new = new.withColumns({"outcome": F.when(lost, "blocked").otherwise(F.col("outcome")), "reason": F.when(lost, "PARTIAL_FIELD_CONFLICT").otherwise(F.col("reason"))})
    return decided.where("outcome <> 'proposed'").unionByName(new.select(*decided.columns))


def recover_uncovered(region: DataFrame, field: DataFrame, line: DataFrame, token: DataFrame, page: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Evidence per cell and writing line: covered, recovered as a weak proposal, unresolved or static.

    ``region``: cells with ``is_caption`` (a printed caption) and ``ink_ratio``; ``field.status``.
    """
    keys = [*by, "cell_id"]
    cells = _tolerant(region, heights, by).join(page.select(*by, "page_w", "page_h"), list(by))
    row, col = aligned_peers(region, heights, "row", by), aligned_peers(region, heights, "column", by)
    words = near_join(token.select(*by, "token_id", "x", "y", "w", "h"), region.select(*by, "cell_id", "x", "y", "w", "h"), by).where(share(box(A), box(B)) > 0.55)
    filled = words.groupBy(*by, F.col("b_cell_id").alias("cell_id")).agg(F.max(F.col("a_y") + F.col("a_h")).alias("_bottom"))
    peers = row.join(region.select(*keys, F.col("x").alias("_x"), F.col("w").alias("_w")), keys).join(_flag(filled.select(*by, F.col("cell_id").alias("peer_id")), "_peer_text"), [*by, "peer_id"], "left")
    rows = peers.groupBy(*keys).agg(F.max((F.col("peer_x") > F.col("_x")) & (F.col("peer_w") > F.col("_w") * 1.35)).alias("_narrow"),
                                    F.max((F.col("peer_x") < F.col("_x")) & (F.col("peer_w") < F.col("_w") * 0.85) & F.coalesce("_peer_text", F.lit(False))).alias("_side"), F.lit(True).alias("_row"))
    cols = _flag(col.select(*keys).distinct(), "_col")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    j = cells.join(rows, keys, "left").join(cols, keys, "left").join(filled, keys, "left")
    body = (F.col("w") >= F.col("page_w") * 0.32) & (F.col("h") >= F.col("th") * 3) & (yes("_row") | yes("_col"))
    open_ = ~yes("_narrow") & ~F.col("is_caption") & ((yes("_row") & yes("_col")) | yes("_side") | body)
    pad, th = F.col("pad"), F.col("th")
    top = F.when(F.col("_bottom").isNotNull(), F.greatest(F.col("y") + pad, F.col("_bottom") + pad)).otherwise(F.col("y") + pad)
    top = F.when(open_, top).otherwise(F.col("y") + pad)
    j = j.withColumns({"rx": F.col("x") + pad, "ry": top, "rw": F.col("w") - pad * 2, "rh": F.col("y") + F.col("h") - pad - top})
    roomy = F.when(F.col("_bottom").isNotNull(), F.col("rh") >= F.greatest(th * 2, F.col("h") * 0.22)).otherwise((F.col("rw") >= th * 3) & (F.col("rh") >= th))
    why = F.when(open_ & F.col("_bottom").isNotNull(), "MEASURED_FREE_AREA_BELOW_PRINT").when(open_, "EMPTY_MEASURED_TABLE_RESPONSE").otherwise("NO_WRITABLE_STRUCTURE")
    cell_rows = j.select(*by, F.concat(F.lit("cell-"), F.col("cell_id").cast("string")).alias("evidence_id"), F.lit("cell").alias("kind"), F.lit(0).alias("_part"), F.col("cell_id").alias("_ord"),
                         F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rw").alias("w"), F.col("rh").alias("h"), (open_ & roomy).alias("plausible"), why.alias("reason"),
                         F.coalesce("ink_ratio", F.lit(0.0)).alias("ink"), "th", "page_w", "page_h")
    strokes = _tolerant(line_boxes(line, by), heights, by).join(page.select(*by, "page_w", "page_h"), list(by))
    a, b = box(A), box(B)
    near = near_join(strokes.select(*by, "line_id", "x", "y", "w", "h", "th"), strokes.select(*by, "line_id", "x", "y", "w", "h"), by, reach=box().grown(0.0, F.col("th") * 4, 0.0, F.col("th") * 4).grown(F.col("th"), 0.0, F.col("th"), 0.0)).where(
        (F.col("a_line_id") != F.col("b_line_id")) & (F.abs(a.x - b.x) < F.col("a_th")) & (F.abs(a.w - b.w) < F.col("a_th") * 2) & (F.abs(a.y - b.y) >= F.col("a_th") * 0.8) & (F.abs(a.y - b.y) <= F.col("a_th") * 4))
    parallel = near.select(*by, F.col("a_line_id").alias("line_id")).distinct()
    lines = strokes.join(_flag(parallel, "_par"), [*by, "line_id"], "left").select(
        *by, F.concat(F.lit("line-"), F.col("line_id").cast("string")).alias("evidence_id"), F.lit("line").alias("kind"), F.lit(1).alias("_part"), F.col("line_id").alias("_ord"), "x",
        F.greatest(F.lit(0.0), F.col("y") - F.col("th") * 1.3).alias("y"), "w", (F.col("th") * 1.25).alias("h"), (F.coalesce("_par", F.lit(False)) & (F.col("w") > F.col("page_w") * 0.2)).alias("plausible"),
        F.lit("REPEATED_MEASURED_WRITING_LINES").alias("reason"), F.lit(0.0).alias("ink"), "th", "page_w", "page_h")
    everything = cut_lineage(cell_rows.unionByName(lines))
    cover = union_coverage(everything.select(*by, "evidence_id", "x", "y", "w", "h"), field, by, region_id="evidence_id").select(*by, "evidence_id", "coverage")
    clash = near_join(everything.select(*by, "evidence_id", "x", "y", "w", "h"), field.select(*by, "x", "y", "w", "h"), by).where(touches(a, b)).select(*by, F.col("a_evidence_id").alias("evidence_id")).distinct()
    e = everything.join(cover, [*by, "evidence_id"]).join(_flag(clash, "_clash"), [*by, "evidence_id"], "left")
    small = (F.col("w") < th) | (F.col("h") < F.greatest(F.lit(6.0), th * 0.6)) | (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("page_w")) | (F.col("y") + F.col("h") > F.col("page_h"))
    state = (F.when(F.col("coverage") >= 0.65, F.struct(F.lit("covered").alias("o"), F.col("reason").alias("r"))).when(~F.col("plausible"), F.struct(F.lit("static").alias("o"), F.col("reason").alias("r")))
             .when(small, F.struct(F.lit("unresolved").alias("o"), F.lit("RESPONSE_AREA_TOO_SMALL").alias("r"))).when(F.col("_clash"), F.struct(F.lit("unresolved").alias("o"), F.lit("PARTIAL_FIELD_CONFLICT").alias("r")))
             .when(F.col("ink") > 0.012, F.struct(F.lit("unresolved").alias("o"), F.lit("UNPOSITIONED_OR_PRINTED_INK").alias("r"))).otherwise(F.struct(F.lit("recovered").alias("o"), F.col("reason").alias("r"))))
    e = e.withColumn("_s", state).withColumns({"outcome": F.col("_s.o"), "reason": F.col("_s.r"), "covered_before": F.col("coverage") >= 0.65}).drop("_s", "_clash")
    e = cut_lineage(e)
    # a recovered area blocks later ones that overlap it
    new = greedy_owner(e.where("outcome = 'recovered'"), by, "evidence_id", [F.col("_part"), F.col("_ord")], lambda k, c: touches(box_of(k), box_of(c)), box())
    lost = F.col("owner_id") != F.col("evidence_id")
    new = new.withColumns({"outcome": F.when(lost, "unresolved").otherwise(F.col("outcome")), "reason": F.when(lost, "PARTIAL_FIELD_CONFLICT").otherwise(F.col("reason"))})
    return e.where("outcome <> 'recovered'").unionByName(new.select(*e.columns)).drop("_part", "_ord", "th", "page_w", "page_h", "ink")


# ---------------------------------------------------------------- physical regions and their class
def recover_checkboxes(checkbox: DataFrame, field: DataFrame, token: DataFrame, page: DataFrame, heights: DataFrame, choice: str, by: Sequence[str] = PAGE) -> DataFrame:
    """Evidence per measured checkbox: covered, recovered as a weak proposal, unresolved or static, with ``checked`` where the ink tells it.

    A box is plausible if it is one of several of its size in a row or column, words beside it match ``choice``, and it is not smaller than 0.55 text heights.
    ``checkbox``: box_id, box, ``ink_ratio`` inside the box: more than 0.1 is checked, less than 0.025 is not, between them nobody knows.
    ``field``: what is there, with ``status``.
    """
    keys = [*by, "box_id"]
    a, b = box(A), box(B)
    th, tol = F.col("a_th"), F.col("a_tol")
    sized = _tolerant(checkbox, heights, by).join(page.select(*by, "page_w", "page_h"), list(by))
    slim = sized.select(*keys, "x", "y", "w", "h", "th", "tol")
    size = (F.abs(b.w - a.w) < tol) & (F.abs(b.h - a.h) < tol)
    lined = ((F.abs(b.x - a.x) < tol) & (F.abs(b.y - a.y) < th * 7)) | ((F.abs(b.y - a.y) < tol) & (F.abs(b.x - a.x) < th * 20))
    siblings = near_join(slim, slim.select(*keys, "x", "y", "w", "h"), by, reach=box().grown(F.col("th") * 20, F.col("th") * 7, F.col("th") * 20, F.col("th") * 7), tile=512.0).where(
        (F.col("a_box_id") != F.col("b_box_id")) & size & lined).select(*by, F.col("a_box_id").alias("box_id")).distinct()
    beside = near_join(slim, token.select(*by, "token_id", "x", "y", "w", "h", "text"), by, reach=box().grown(F.col("th") * 4, F.col("th"), F.col("th") * 4, F.col("th")), tile=512.0).where(
        (F.abs(b.y - a.y) < th * 0.7) & (F.least(F.abs(b.right - a.x), F.abs(a.right - b.x)) < th * 4))
    caption = beside.groupBy(*by, F.col("a_box_id").alias("box_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("b_x").alias("x"), F.col("b_token_id").alias("t"), F.col("b_text").alias("s")))), lambda e: e["s"]), " ").alias("caption"))
    cover = union_coverage(slim, field.select(*by, "field_id", "x", "y", "w", "h", "status"), by, region_id="box_id").select(*keys, "coverage")
    clash = near_join(slim, field.select(*by, "x", "y", "w", "h"), by).where(touches(a, b)).select(*by, F.col("a_box_id").alias("box_id")).distinct()
    j = sized.join(_flag(siblings, "_siblings"), keys, "left").join(caption, keys, "left").join(cover, keys, "left").join(_flag(clash, "_clash"), keys, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    least = F.least("w", "h")
    plausible = yes("_siblings") & F.coalesce(F.col("caption").rlike(rf"(?i)(?:^|\s)(?:{choice})(?=\s|$|[.,:])"), F.lit(False)) & (least >= F.col("th") * 0.55)
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("page_w")) | (F.col("y") + F.col("h") > F.col("page_h"))
    small = (F.col("w") < F.greatest(F.lit(6.0), F.col("th") * 0.55)) | (F.col("h") < F.greatest(F.lit(6.0), F.col("th") * 0.55))
    ink = F.coalesce("ink_ratio", F.lit(0.0))
    r = lambda outcome, reason: F.struct(F.lit(outcome).alias("o"), F.lit(reason).alias("r"))
    result = (F.when(F.coalesce("coverage", F.lit(0.0)) >= 0.65, r("covered", "EXISTING_FIELD")).when(~plausible, r("static", "NO_WRITABLE_STRUCTURE"))
              .when(outside | small, r("unresolved", "RESPONSE_TOO_SMALL_OR_OUTSIDE")).when(yes("_clash"), r("unresolved", "PARTIAL_FIELD_CONFLICT"))
              .when((ink >= 0.025) & (ink <= 0.1), r("unresolved", "CHECKBOX_STATE_AMBIGUOUS")).otherwise(r("recovered", "REPEATED_MEASURED_CHECKBOX")))
    return j.withColumn("_r", result).select(*keys, F.col("_r.o").alias("outcome"), F.col("_r.r").alias("reason"), F.when(F.col("_r.o") == "recovered", ink > 0.1).alias("checked"),
                                             "caption", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def classify_regions(rect: DataFrame, line: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Physical regions: checkbox, graphic, cell, multiline cell, open structure, underline.

    ``rect``: ``rect_id``, ``is_checkbox``, ``is_graphic``; ``line``: ``line_id``, x1, x2, y, ``is_vertical``.
    """
    ratio = F.col("w") / F.col("h")
    kind = (F.when(F.col("is_checkbox") | (F.col("w").between(8, 28) & F.col("h").between(8, 28)), "CHECKBOX")
            .when(F.col("w").between(35, 200) & F.col("h").between(35, 200) & ratio.between(0.85, 1.15) & F.col("is_graphic"), "NON_FILLABLE_SHAPE")
            .when((F.col("w") >= 30) & (F.col("h") >= 14), F.when(F.col("h") >= 45, "MULTILINE_STRUCTURE").otherwise("CLOSED_CELL")))
    rects = rect.select(*by, F.concat(F.lit("r"), F.col("rect_id").cast("string")).alias("region_id"), kind.alias("kind"), "x", "y", "w", "h").where(F.col("kind").isNotNull())
    level = line.where(~F.col("is_vertical") & (F.col("x2") - F.col("x1") >= 25))
    nxt = Window.partitionBy(*by).orderBy("line_id")
    lead = lambda c: F.lead(c).over(nxt)
    pair = level.select(*by, "line_id", "x1", "x2", "y", lead("x1").alias("n1"), lead("x2").alias("n2"), lead("y").alias("ny"))
    left, right = F.greatest("x1", "n1"), F.least("x2", "n2")
    dy = F.abs(F.col("ny") - F.col("y"))
    spans = pair.where((dy >= 18) & (dy <= 120) & (right - left >= 60)).select(
        *by, "line_id", left.alias("x"), F.least("y", "ny").alias("y"), (right - left).alias("w"), dy.alias("h"), F.col("y").alias("l1"), F.col("ny").alias("l2"))
    a, b = box(A), box(B)
    held = near_join(spans, rect.select(*by, "x", "y", "w", "h"), by, reach=box().grown(12.0, 4.0, 12.0, 4.0)).where(
        ((F.abs(b.x - a.x) < 12) | (F.abs(b.right - a.right) < 12)) & (b.y <= F.col("a_l1") + 4) & (b.bottom >= F.col("a_l2") - 4))
    opened = without_partner(spans, held, by, ["line_id"]).select(*by, F.concat(F.lit("o"), F.col("line_id").cast("string")).alias("region_id"), F.lit("OPEN_STRUCTURE").alias("kind"), "x", "y", "w", "h")
    strokes = line_boxes(level, by).where(F.col("w") >= 30)
    inside = near_join(strokes, rect.select(*by, "x", "y", "w", "h"), by, reach=box().grown(0.0, 2.0, 0.0, 2.0)).where(
        (a.y >= b.y - 2) & (a.y <= b.bottom + 2) & (a.x >= b.x - 4) & (a.right <= b.right + 4))
    under = without_partner(strokes, inside, by, ["line_id"]).select(
        *by, F.concat(F.lit("l"), F.col("line_id").cast("string")).alias("region_id"), F.lit("UNDERLINE").alias("kind"), "x", (F.col("y") - 2).alias("y"), "w", F.lit(20.0).alias("h"))
    return rects.unionByName(opened).unionByName(under)


def classify_fields(region: DataFrame, token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Class per physical region with its label and confidences: empty, partial or header cell, underline, checkbox, structural, graphic.

    ``region`` from :func:`classify_regions`; ``token``: ``is_label``, ``is_prompt``.
    """
    keys = [*by, "region_id"]
    a, b = box(A), box(B)
    # read by three joins
    region = cut_lineage(region)
    cells = region.where(F.col("kind").isin("CLOSED_CELL", "MULTILINE_STRUCTURE")).select(*keys, "x", "y", "w", "h")
    inside = near_join(cells, token.select(*by, "token_id", "x", "y", "w", "h", "text"), by, reach=box().grown(2.0, 2.0, 4.0, 4.0)).where(
        (b.x >= a.x - 2) & (b.right <= a.right + 4) & (b.y >= a.y - 2) & (b.bottom <= a.bottom + 4)).withColumnRenamed("a_region_id", "region_id")
    words = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("b_token_id").alias("i"), F.col("b_text").alias("t")))).alias("_w"), F.max(b.right).alias("_right")).select(
        *keys, F.trim(F.array_join(F.transform("_w", lambda e: e["t"]), " ")).alias("inner_text"), "_right")
    simple = F.when(F.col("kind") == "CHECKBOX", "checkbox").when(F.col("kind") == "UNDERLINE", "underline").otherwise("cell")
    named = associate_label(region.withColumn("_k", F.col("kind")).withColumn("kind", simple), token, by).withColumn("kind", F.col("_k")).drop("_k")
    j = cut_lineage(named).join(words, keys, "left")
    asks = F.col("inner_text").rlike(r"[:?]\s*$") | F.col("inner_text").rlike(r"(?i)^(?:[1-9]\.|[a-e]\))")
    header = F.col("inner_text").rlike(r"(?i)^(SEZIONE|ALLEGATO|PROFILO|TABELLA|ISTRUZIONI|PARTE\s+\d|QUADRO|NOTE\s+GENERALI)")
    room = (F.floor((F.col("x") + F.col("w") - 4) * 10 + 0.5) - F.floor((F.col("_right") + 4) * 10 + 0.5)) / 10
    aspect = F.col("w") / F.greatest(F.lit(1.0), F.col("h"))
    cellish, lined = F.col("kind").isin("CLOSED_CELL", "MULTILINE_STRUCTURE"), F.col("kind") == "UNDERLINE"
    labelled = F.col("method") != "UNASSOCIATED"
    cls = (F.when(F.col("kind") == "NON_FILLABLE_SHAPE", "NON_FILLABLE_GRAPHIC").when(F.col("kind") == "OPEN_STRUCTURE", "STRUCTURAL_ONLY")
           .when((F.col("kind") == "CHECKBOX") & ((aspect < 0.75) | (aspect > 1.35)), "STRUCTURAL_ONLY").when((F.col("kind") == "CHECKBOX") & ~labelled, "NON_FILLABLE_GRAPHIC").when(F.col("kind") == "CHECKBOX", "CHECKBOX")
           .when(cellish & F.col("inner_text").isNotNull() & asks & ~header & (room >= 25), "PARTIAL_CELL").when(cellish & F.col("inner_text").isNotNull(), "HEADER_CELL").when(cellish, "EMPTY_CELL")
           .when(lined & labelled, "UNDERLINE_FIELD").when(lined, "STRUCTURAL_ONLY").otherwise("UNRESOLVED"))
    sure = (F.when(F.col("kind") == "CHECKBOX", 0.95).when(F.col("kind") == "NON_FILLABLE_SHAPE", 0.9).when(cellish, 0.92).when(F.col("kind") == "OPEN_STRUCTURE", 0.85).otherwise(0.88))
    contained = F.col("class").isin("PARTIAL_CELL", "HEADER_CELL")
    none = F.col("class").isin("STRUCTURAL_ONLY", "NON_FILLABLE_GRAPHIC", "UNRESOLVED")
    return j.withColumn("class", cls).withColumns({
        "label": F.when(contained, F.trim(F.regexp_replace("inner_text", ":$", ""))).when(none, None).otherwise(F.col("label")),
        "method": F.when(contained, "CONTAINED_PROMPT").when(none, "UNASSOCIATED").otherwise(F.col("method")),
        "label_confidence": F.when(contained, 0.9).when(none, 0.0).otherwise(F.col("label_confidence")), "geometric_confidence": sure}).drop("inner_text", "_right")


def class_counts(classified: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    of = lambda n: F.count_if(F.col("class") == n)
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("regions"), of("EMPTY_CELL").alias("empty_cells"), of("PARTIAL_CELL").alias("partial_cells"), of("HEADER_CELL").alias("header_cells"),
        of("UNDERLINE_FIELD").alias("underlines"), of("CHECKBOX").alias("checkboxes"), of("STRUCTURAL_ONLY").alias("structural"), of("NON_FILLABLE_GRAPHIC").alias("graphics"))


def writing_lines(line: DataFrame, region: DataFrame, token: DataFrame, by: Sequence[str] = PAGE, shortest: float = 30.0, most: int | None = None) -> DataFrame:
    """Strokes to write on: no table edges, not through letters, near-duplicates out.

    With a bound of the caller's own, only the longest ``most`` of a page stay.
    """
    a, b = box(A), box(B)
    long = line_boxes(line.where(~F.col("is_vertical")), by).where(F.col("w") >= shortest)
    edge = near_join(long, region.select(*by, "x", "y", "w", "h"), by, reach=box().grown(0.0, 8.0, 0.0, 8.0), tile=512.0).where(
        ((F.least(a.right, b.right) - F.greatest(a.x, b.x)) > 8) & ((F.abs(a.y - b.y) < 8) | (F.abs(a.y - b.bottom) < 8)))
    words = token.where(~F.col("text").rlike(r"^[_.\s]+$")).select(*by, "x", "y", "w", "h", F.length("text").alias("n"))
    big = b.w > b.h * F.greatest(F.lit(2.0), F.col("b_n") * 0.85)
    through = near_join(long, words, by, reach=box().grown(0.0, 3.0, 0.0, 3.0)).where(
        (a.y > b.y - 3) & (a.y < b.y + b.h * F.when(big, 0.72).otherwise(1.0) + 3) & ((F.least(a.right, b.right) - F.greatest(a.x, b.x)) > F.least(a.w, b.w) * 0.25))
    free = without_partner(without_partner(long, edge, by, ["line_id"]), through, by, ["line_id"])
    kept = greedy_keep(free, by, "line_id", [-F.col("w"), F.col("line_id")], lambda k, c: (F.abs(k["y"] - c["y"]) < 6) & (F.abs(k["x"] - c["x"]) < 10),
                       Box(F.col("x") - 5, F.col("y") - 3, F.lit(10.0), F.lit(6.0)))
    if most is None:
        return kept
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("w"), "line_id"))
    return kept.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def suppress_fields(field: DataFrame, page: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Every attempt with its outcome: clipped to the page, too small, duplicate of a kept one, or proposed."""
    joined = field.join(page.select(*by, "page_w", "page_h"), list(by))
    x, y = F.greatest(F.lit(0.0), F.col("x")), F.greatest(F.lit(0.0), F.col("y"))
    clipped = joined.withColumns({"_x": x, "_y": y}).withColumns({"_w": F.least(F.col("w"), F.col("page_w") - F.col("_x")), "_h": F.least(F.col("h"), F.col("page_h") - F.col("_y"))})
    clipped = clipped.select(*[F.col("_" + c).alias(c) if c in "xywh" else F.col(c) for c in field.columns])
    small = (F.col("w") < 6) | (F.col("h") < 6)
    fits = clipped.where(~small)
    owned = greedy_owner(fits, by, "field_id", [F.col("ord"), F.col("field_id")],
                         lambda k, c: (share(box_of(c), box_of(k)) > 0.6) | (share(box_of(k), box_of(c)) > 0.8), box())
    dup = F.col("owner_id") != F.col("field_id")
    kept = owned.withColumns({"outcome": F.when(dup, "excluded").otherwise("proposed"), "reason": F.when(dup, "DUPLICATE_FIELD").otherwise("FIELD_PROPOSED"),
                              "duplicate_of": F.when(dup, F.col("owner_id"))}).drop("owner_id", "owner_rank")
    tiny = clipped.where(small).withColumns({"outcome": F.lit("excluded"), "reason": F.lit("FIELD_TOO_SMALL_AFTER_CLAMP"), "duplicate_of": F.lit(None).cast("bigint")})
    return kept.unionByName(tiny.select(*kept.columns))


# ---------------------------------------------------------------- inference rules
def infer_region_fields(cell: DataFrame, token: DataFrame, page: DataFrame, heights: DataFrame, header_key: DataFrame, label_keys: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Per cell one proposal or one refusal: label left or above, column header, nearby label, rest of a label cell.

    ``header_key(key)``: texts that head a column; ``label_keys(key)``: texts that are labels; ``token``: ``is_label``,
    ``is_instruction``; ``cell`` may carry ``ink_ratio``.
    """
    keys = [*by, "cell_id"]
    a, b = box(A), box(B)
    sized = _tolerant(cell, heights, by).join(page.select(*by, "page_w", "page_h"), list(by))
    # words inside cells give the cells' texts and their last word: met once
    held = cut_lineage(_words_inside(cell, token, by))
    texts = page_text(held, [*by, "cell_id"]).withColumnRenamed("text", "own_text")
    last = held.groupBy(*keys).agg(F.max(F.col("x") + F.col("w")).alias("_last"))
    mark = lambda df, name: _flag(df.select(F.col("key").alias("_key")).distinct(), name)
    said = texts.withColumn("_key", label_key(F.col("own_text"))).join(mark(label_keys, "is_label"), "_key", "left").join(mark(header_key, "is_header"), "_key", "left").drop("_key")
    base = sized.join(said, keys, "left").join(last, keys, "left").withColumns({"is_label": F.coalesce("is_label", F.lit(False)), "is_header": F.coalesce("is_header", F.lit(False))})
    base = cut_lineage(base)
    slim = base.select(*by, "cell_id", "x", "y", "w", "h", "th", "own_text", "is_label", "is_header")
    margin = F.greatest(F.lit(4.0), F.col("th") * 0.18)
    pairs = near_join(slim, slim, by, reach=box().grown(*(F.greatest(F.lit(15.0), F.col("th") * 2),) * 4), tile=512.0).where(F.col("a_cell_id") != F.col("b_cell_id")).withColumnRenamed("a_cell_id", "cell_id")
    to_left = F.col("b_is_label") & (b.right <= a.x + 8) & (a.x - b.right < 15) & (F.abs(b.y - a.y) < 10)
    over = F.col("b_is_label") & (b.bottom <= a.y + 8) & (a.y - b.bottom < 15) & (F.abs(b.x - a.x) < 15) & (b.h < F.col("a_th") * 4)
    body = F.col("a_is_header") & (b.y >= a.bottom - 4) & (b.y - a.bottom < F.col("a_th") * 2) & (F.abs(b.x - a.x) < F.col("a_th")) & (F.abs(b.w - a.w) < F.col("a_th") * 2)
    right = (F.abs(b.x - a.right) < 10) & (F.abs(b.y - a.y) < 10)
    # one meeting of the neighbours answers all four questions
    met = pairs.where(to_left | over | body | right).groupBy(*keys).agg(
        F.min(F.when(to_left, F.struct((-b.x).alias("r0"), F.col("b_cell_id").alias("r1"), F.col("b_own_text").alias("t"))))["t"].alias("left_text"),
        F.min(F.when(over, F.struct((-b.y).alias("r0"), F.col("b_cell_id").alias("r1"), F.col("b_own_text").alias("t"))))["t"].alias("above_text"),
        F.max(F.when(body, True)).alias("_body"), F.max(F.when(right, True)).alias("_right"))
    heads = slim.where("is_header").select(*by, "cell_id", "x", "y", "w", "h", "own_text")
    reach_up = base.select(*by, "cell_id", "x", "y", "w", "h", "th", (F.col("page_h") * 0.18).alias("up"))
    column = near_join(reach_up, heads, by, reach=box().grown(F.col("th"), F.col("up"), F.col("th"), 0.0), tile=512.0).where(
        (F.col("a_cell_id") != F.col("b_cell_id")) & (b.bottom <= a.y + 4) & (a.y - b.y < F.col("a_up")) & (F.abs(b.x - a.x) < F.col("a_th")) & (F.abs(b.w - a.w) < F.col("a_th") * 2)).withColumnRenamed("a_cell_id", "cell_id")
    column = best_partner(column, keys, [-b.y, F.col("b_cell_id")], {"column_text": F.col("b_own_text")})
    told = near_join(token.where("is_instruction").select(*by, "x", "y", "w", "h"), cell.select(*by, "cell_id", "x", "y", "w", "h"), by).where(share(a, b) > 0.1).select(*by, F.col("b_cell_id").alias("cell_id")).distinct()
    # only cells without words ask for a label nearby
    asked = base.where(F.col("own_text").isNull()).select(*by, F.col("cell_id").alias("field_id"), "x", "y", "w", "h")
    near = nearest_label(asked, token.where("is_label"), by).where(F.col("label_text").isNotNull()).groupBy(*by, F.col("field_id").alias("cell_id")).agg(F.min("label_text").alias("near_text"))
    nearby = cell.select(*keys).join(near, keys, "left")
    j = cut_lineage(base.join(met, keys, "left").join(column, keys, "left")).join(_flag(told, "_told"), keys, "left").join(nearby, keys, "left")
    ink = F.coalesce("ink_ratio", F.lit(0.0)) if "ink_ratio" in cell.columns else F.lit(0.0)
    beside = F.coalesce("left_text", "above_text")
    rest = F.col("x") + F.col("w") - margin - F.col("_last")
    empty = F.col("own_text").isNull()
    r = lambda outcome, reason, label=None: F.struct(F.lit(outcome).alias("o"), F.lit(reason).alias("r"), (label if label is not None else F.lit(None).cast("string")).alias("l"))
    result = (F.when(F.col("_told"), r("excluded", "PRINTED_INSTRUCTION_IN_REGION")).when(empty & (ink > 0.015), r("excluded", "INK_WITHOUT_POSITIONED_TEXT"))
              .when(F.col("is_header") & F.col("_body"), r("excluded", "COLUMN_HEADER_STATIC")).when(F.col("column_text").isNotNull(), r("proposed", "COLUMN_HEADER", tidy(F.col("column_text"))))
              .when(beside.isNotNull() & F.col("is_label"), r("excluded", "LABEL_CELL_WITH_ADJACENT_LABEL")).when(beside.isNotNull(), r("proposed", "ADJACENT_LABEL", tidy(beside)))
              .when(empty & F.col("near_text").isNotNull(), r("proposed", "NEARBY_LABEL", tidy(F.col("near_text")))).when(empty, r("excluded", "EMPTY_CELL_WITHOUT_RECOGNIZED_LABEL"))
              .when(F.col("is_label") & F.col("_right"), r("excluded", "STATIC_LABEL_WITH_RIGHT_CELL")).when(F.col("is_label") & (rest > F.col("th") * 3), r("proposed", "REST_OF_LABEL_CELL", tidy(F.col("own_text"))))
              .when(F.col("is_label"), r("excluded", "INLINE_RESPONSE_SPACE_TOO_SHORT")).otherwise(r("excluded", "CONTENT_WITHOUT_RECOGNIZED_FIELD_RELATION")))
    inline = F.col("reason") == "REST_OF_LABEL_CELL"
    return j.withColumn("_r", result).withColumns({"outcome": F.col("_r.o"), "reason": F.col("_r.r"), "label": F.col("_r.l")}).select(
        *keys, "outcome", "reason", "label", F.when(inline, F.col("_last") + margin).otherwise(F.col("x") + margin).alias("x"), (F.col("y") + margin).alias("y"),
        F.when(inline, rest - margin).otherwise(F.greatest(F.lit(6.0), F.col("w") - margin * 2)).alias("w"), F.greatest(F.lit(6.0), F.col("h") - margin * 2).alias("h"),
        F.when(inline, None).otherwise(F.col("own_text")).alias("value"))


# Headings beside which a mark is no choice, alone and together; what a box without words is called; remains of a printed square at the end of a caption.
BOX_HEADING = r"(?i)^(?:data|firma|verbale)\b"
BOX_HEADINGS = r"(?i)^data\s+firma\b"
UNREAD_CAPTION = "Selezione da verificare"
SQUARE_AT_END = r"\s*[C(\[\]]?\s*$"


def checkbox_captions(checkbox: DataFrame, token: DataFrame, page: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE,
                      heading: str = BOX_HEADING, combined: str = BOX_HEADINGS, unknown: str = UNREAD_CAPTION) -> DataFrame:
    """Per checkbox its caption, or one refusal: the words from the next one on its row up to the next box, in order of x.

    ``checkbox``: ``box_id`` and box; ``token``: ``line_id``. The next word stands at most 250 pt to the right and less than a text height higher or lower; the caption is
    the rest of that word's line before the next box of the row. Boxes beside a ``heading``, smaller than 0.75 text heights, or with a ``combined`` heading
    as caption are refused; a box without words is called ``unknown``.
    """
    keys = [*by, "box_id"]
    a, b = box(A), box(B)
    th = F.col("a_th")
    sized = _tolerant(checkbox.select(*by, "box_id", "x", "y", "w", "h"), heights, by).join(page.select(*by, "page_w"), list(by)).select(*keys, "x", "y", "w", "h", "th", "page_w")
    # a strip from the box to the right border of the page
    strip = Box(F.col("x"), F.col("y") - F.col("th"), F.greatest(F.col("w"), F.col("page_w") - F.col("x")), F.col("th") * 2)
    corner = Box(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0))
    boxes = near_join(sized, checkbox.select(*by, "box_id", "x", "y"), by, reach=strip, b_extent=corner, tile=512.0).where((F.col("b_x") > a.right) & (F.abs(F.col("b_y") - a.y) < th))
    stops = boxes.groupBy(*by, F.col("a_box_id").alias("box_id")).agg(F.min("b_x").alias("stop"))
    words = token.select(*by, "token_id", "line_id", "x", "y", "text")
    right = near_join(sized, words, by, reach=strip, b_extent=corner, tile=512.0).where((F.col("b_x") >= a.right - 2) & (F.abs(F.col("b_y") - a.y) < th)).withColumnRenamed("a_box_id", "box_id")
    first = best_partner(right.where(F.col("b_x") - a.right < 250), keys, [F.col("b_x"), F.col("b_token_id")], {"next_line": F.col("b_line_id"), "next_x": F.col("b_x"), "next_text": F.col("b_text")})
    # the line of the next word, whatever the height of its words
    row = sized.join(first, keys).join(stops, keys, "left").select(*keys, F.coalesce("stop", "page_w").alias("stop"), F.col("next_line").alias("line_id"), "next_x")
    caption = row.join(words, [*by, "line_id"]).where((F.col("x") >= F.col("next_x")) & (F.col("x") < F.col("stop"))).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "token_id", "text"))), lambda e: e["text"]), " ").alias("caption"))
    j = sized.join(first.select(*keys, "next_text"), keys, "left").join(caption, keys, "left")
    label = F.coalesce("caption", F.lit(unknown))
    reason = (F.when(F.col("next_text").rlike(heading), "CHECKBOX_NEXT_TO_STATIC_HEADING").when(F.least("w", "h") < F.col("th") * 0.75, "CHECKBOX_BELOW_TEXT_SCALE")
              .when(label.rlike(combined), "CHECKBOX_COMBINED_HEADING"))
    shown = F.trim(F.regexp_replace(label, SQUARE_AT_END, ""))
    return j.select(*keys, F.when(reason.isNull(), "proposed").otherwise("excluded").alias("outcome"), F.coalesce(reason, F.when(F.col("caption").isNull(), "CHECKBOX_WITHOUT_CAPTION").otherwise("CHECKBOX_CAPTION")).alias("reason"),
                    F.when(reason.isNull(), shown).alias("label"), "x", "y", "w", "h")


def narrative_fields(cell: DataFrame, token: DataFrame, heights: DataFrame, caption: str, by: Sequence[str] = PAGE) -> DataFrame:
    """Cells with a printed narrative caption at the top: the response area below it, with what already stands there.

    ``token``: words with ``line_id`` and ``is_instruction``; ``caption``: pattern of a caption from the start of its row. Cells of at most three text heights and cells
    without such a caption are not here. Printed instructions in the upper 45 % belong to the caption. If the response begins on the caption's row, the whole
    cell is the area (``shares_row``). Areas lower than a text height are refused.
    """
    keys = [*by, "cell_id"]
    b = box(B)
    sized = _tolerant(cell.select(*by, "cell_id", "x", "y", "w", "h"), heights, by).select(*keys, "x", "y", "w", "h", "th", F.greatest(F.lit(4.0), F.col("th") * 0.18).alias("margin")).where(F.col("h") > F.col("th") * 3)
    words = token.where(F.col("text").rlike("(?i)[a-zà-ù0-9]")).select(*by, "token_id", "line_id", "x", "y", "w", "h", "text", "is_instruction")
    near = near_join(sized, words, by, reach=box().grown(0.0, F.col("margin") * 2, 0.0, 0.0), tile=512.0)
    cellbox = box(A)
    edge = (b.x >= cellbox.x) & (b.right <= cellbox.right) & (b.y < cellbox.y + F.col("a_th")) & (b.bottom > cellbox.y - F.col("a_margin") * 2)
    held = near.where((share(b, cellbox) > 0.55) | edge).select(
        *by, F.col("a_cell_id").alias("cell_id"), F.col("a_th").alias("th"), F.col("a_margin").alias("margin"), *[F.col(f"a_{v}").alias(f"c{v}") for v in ("x", "y", "w", "h")],
        *[F.col(f"b_{v}").alias(v) for v in ("token_id", "line_id", "x", "y", "h", "text", "is_instruction")])
    held = cut_lineage(held)
    opens = held.where((F.col("x") < F.col("cx") + F.col("th") * 4) & (F.abs(F.col("y") - F.col("cy")) < F.col("th") * 1.8) & F.col("text").rlike(f"(?i)^(?:{caption})(?=\\s|$|[:.,])"))
    start = opens.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("y") - F.col("cy")).alias("away"), "x", "token_id", "line_id", "y")).alias("s")).select(*keys, F.col("s.line_id").alias("s_line"), F.col("s.y").alias("s_y"))
    told = held.where(F.col("is_instruction") & (F.col("y") < F.col("cy") + F.col("ch") * 0.45)).select(*keys, F.col("line_id")).distinct()
    j = held.join(start, keys).join(told.withColumn("_told", F.lit(True)), [*keys, "line_id"], "left")
    top = (F.col("line_id") == F.col("s_line")) & (F.abs(F.col("y") - F.col("s_y")) < F.col("th") * 0.65)
    instructed = F.coalesce("_told", F.lit(False))
    part = F.when(top, "caption").when(instructed, "instruction").when(F.col("y") >= F.col("s_y") + F.col("th") * 0.3, "response")
    j = cut_lineage(j.withColumn("part", part))
    texts = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("y", "x", "token_id", "text")))), lambda e: e["text"]), " ")
    row = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("x", "token_id", "text")))), lambda e: e["text"]), " ")
    bottom = F.max(F.when(F.col("part").isin("caption", "instruction"), F.col("y") + F.col("h")))
    found = j.groupBy(*keys).agg(row("caption").alias("label"), texts("response").alias("value"), bottom.alias("bottom"), F.min(F.when(F.col("part") == "response", F.col("y"))).alias("top"),
                                 *[F.any_value(v).alias(v) for v in ("cx", "cy", "cw", "ch", "th", "margin")])
    shares = F.coalesce(F.col("top") < F.col("bottom") + F.col("margin"), F.lit(False))
    y = F.when(shares, F.col("cy")).otherwise(F.col("bottom")) + F.col("margin")
    height = F.col("cy") + F.col("ch") - F.col("margin") - y
    short = height < F.col("th")
    return found.select(*keys, F.when(short, "excluded").otherwise("proposed").alias("outcome"), F.when(short, "NARRATIVE_RESPONSE_TOO_SHORT").otherwise("NARRATIVE_CAPTION").alias("reason"),
                        tidy(F.col("label")).alias("label"), (F.col("cx") + F.col("margin")).alias("x"), y.alias("y"), (F.col("cw") - F.col("margin") * 2).alias("w"), height.alias("h"),
                        F.when(F.col("value") != "", F.col("value")).alias("value"), shares.alias("shares_row"))


def right_hand_roles(cell: DataFrame, token: DataFrame, heights: DataFrame, role: str, by: Sequence[str] = PAGE) -> DataFrame:
    """Cells whose right-hand neighbour names a role (numbers before it aside): ``cell_id``, ``role``, the first neighbour by id."""
    keys = [*by, "cell_id"]
    a, b = box(A), box(B)
    sized = _tolerant(cell.select(*by, "cell_id", "x", "y", "w", "h"), heights, by).select(*keys, "x", "y", "w", "h", "th")
    told = F.trim(F.regexp_replace(tidy(F.col("text")), r"^\d+[.)]?\s*", ""))
    named = cell_texts(cell, token, by).withColumn("role", told)
    pairs = near_join(sized, cell.select(*by, "cell_id", "x", "y", "w", "h"), by, reach=box().grown(F.col("th"), F.col("th"), F.col("th"), F.col("th")), tile=512.0).where(
        (F.col("a_cell_id") != F.col("b_cell_id")) & (F.abs(b.x - a.right) < F.col("a_th")) & (F.abs(b.y - a.y) < F.col("a_th"))).withColumnRenamed("a_cell_id", "cell_id")
    beside = pairs.groupBy(*keys).agg(F.min("b_cell_id").alias("_right"))
    return beside.join(named.select(*by, F.col("cell_id").alias("_right"), "role"), [*by, "_right"]).where(F.col("role").rlike(f"(?i)^(?:{role})\\b")).select(*keys, "role")


# Decisions that come before a role in the right-hand cell.
_BEFORE_ROLES = ("PRINTED_INSTRUCTION_IN_REGION", "INK_WITHOUT_POSITIONED_TEXT", "COLUMN_HEADER_STATIC", "COLUMN_HEADER")


def infer_page_fields(cell: DataFrame, checkbox: DataFrame, token: DataFrame, page: DataFrame, heights: DataFrame, header_key: DataFrame, label_keys: DataFrame,
                      caption: str, role: str, by: Sequence[str] = PAGE, role_label: str = "Nome e Cognome — ") -> DataFrame:
    """One decision for every cell and checkbox, rules in order: checkbox captions, narrative captions, then :func:`infer_region_fields`, in which a role in the
    right-hand cell names a cell that no instruction, ink or column header has decided. ``kind``: cell or checkbox."""
    keys = [*by, "cell_id"]
    shown = [*keys, "outcome", "reason", "label", "x", "y", "w", "h", "value"]
    # each rule is written by itself, so that the files shuffled for one go before the next
    ticks = cut_lineage(checkbox_captions(checkbox, token, page, heights, by).withColumnRenamed("box_id", "cell_id").withColumn("value", F.lit(None).cast("string")))
    told = cut_lineage(narrative_fields(cell, token, heights, caption, by))
    rest = cut_lineage(infer_region_fields(cell, token, page, heights, header_key, label_keys, by).join(told.select(*keys), keys, "left_anti"))
    roles = cut_lineage(right_hand_roles(cell, token, heights, role, by))
    rest = rest.join(roles, keys, "left")
    named = F.col("role").isNotNull() & ~F.col("reason").isin(*_BEFORE_ROLES)
    rest = rest.withColumns({"outcome": F.when(named, "proposed").otherwise(F.col("outcome")), "label": F.when(named, F.concat(F.lit(role_label), "role")).otherwise(F.col("label")),
                             "reason": F.when(named, "RIGHT_HAND_ROLE").otherwise(F.col("reason"))})
    cells = told.select(*shown).unionByName(rest.select(*shown)).withColumn("kind", F.lit("cell"))
    return cells.unionByName(ticks.select(*shown).withColumn("kind", F.lit("checkbox")))


def infer_line_fields(line: DataFrame, token: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Writing line with a label on its row or above it: a field over the line; a date on it is its value.

    ``line``: ``line_id``, x, y, w, h from :func:`writing_lines`; ``token``: ``is_label``.
    """
    keys = [*by, "line_id"]
    a, b, th = box(A), box(B), F.col("a_th")
    strokes = _tolerant(line.select(*by, "line_id", "x", "y", "w", "h"), heights, by)
    words = token.where("is_label").select(*by, "token_id", "x", "y", "w", "h", "text")
    pairs = near_join(strokes, words, by, reach=box().grown(F.col("th") * 4, F.col("th") * 3, 0.0, F.col("th") * 1.5)).withColumnRenamed("a_line_id", "line_id")
    row = (b.x < a.x) & (a.x - b.right < th * 4) & (F.abs(b.bottom - a.y) < th * 1.2)
    above = (b.bottom <= a.y + 4) & (a.y - b.bottom < th * 2) & ((F.least(a.right, b.right) - F.greatest(a.x, b.x)) > F.least(a.w, b.w) * 0.5)
    best = best_partner(pairs.where(row | above), keys, [F.when(row, 0).otherwise(1), F.when(row, -b.x).otherwise(-b.y), F.col("b_token_id")],
                        {"label": tidy(F.col("b_text")), "side": F.when(row, "row").otherwise("above"), "_end": F.when(row, b.right).otherwise(F.lit(0.0))})
    margin = F.greatest(F.lit(4.0), F.col("th") * 0.18)
    start = F.when(F.col("_end") > F.col("x"), F.col("_end") + margin).otherwise(F.col("x"))
    fields = strokes.join(best, keys).withColumn("_sx", start).withColumn("_sw", F.col("x") + F.col("w") - F.col("_sx")).where((F.col("_sx") == F.col("x")) | (F.col("_sw") >= F.col("th"))).select(
        *keys, "label", "side", F.col("_sx").alias("x"), F.greatest(F.lit(0.0), F.col("y") - F.col("th") * 1.3).alias("y"), F.col("_sw").alias("w"), (F.col("th") * 1.3).alias("h"))
    dates = token.where(F.col("text").rlike(r"^(?:[_ ]*)\d{1,2}[/.]\d{1,2}[/.]\d{2,4}$")).select(*by, "token_id", "x", "y", "w", "h", "text")
    on = near_join(dates, fields.select(*keys, "x", "y", "w", "h"), by).where(share(a, b) > 0.5).groupBy(*by, F.col("b_line_id").alias("line_id")).agg(
        F.min(F.struct(F.col("a_token_id").alias("i"), F.regexp_replace("a_text", "^[_ ]+", "").alias("v"))).alias("_v"))
    return fields.join(on.select(*keys, F.col("_v.v").alias("value")), keys, "left")


def unboxed_values(token: DataFrame, region: DataFrame, heights: DataFrame, label_keys: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """``label: value`` outside every cell: value in the same word, or in the next words of the row.

    A label completed by the next word is no value. ``token``: ``is_label``.
    """
    keys = [*by, "token_id"]
    a, b = box(A), box(B)
    boxed = near_join(token.select(*by, "token_id", "x", "y", "w", "h"), region.select(*by, "x", "y", "w", "h"), by).where(share(a, b) > 0.5)
    free = without_partner(token, boxed, by, ["token_id"])
    known = _flag(label_keys.select(F.col("key").alias("_key")).distinct(), "_known")
    inline = r"^(.{1,70}?:)\s*(.+)$"
    own = free.withColumns({"_l": tidy(F.regexp_extract("text", inline, 1)), "_v": F.trim(F.regexp_extract("text", inline, 2))}).withColumn("_key", label_key(F.col("_l"))).join(known, "_key", "left")
    split = own.where(F.col("_known") & (F.col("_v") != "") & ~F.col("_v").rlike(r"^[\[(\])\s0-9]*$"))
    first = split.select(*keys, F.col("_l").alias("label"), F.col("_v").alias("value"), F.lit("same_word").alias("how"))
    asks = free.where(F.col("is_label")).join(split.select(*keys), keys, "left_anti").join(heights.select(*by, "typical_h"), list(by), "left").withColumn("th", F.coalesce("typical_h", F.lit(20.0)))
    others = token.select(*by, F.col("token_id"), "x", "y", "w", "h", "text", "is_label")
    row = near_join(asks.select(*by, "token_id", "x", "y", "w", "h", "text", "th"), others, by, reach=box().grown(0.0, F.col("th"), F.col("th") * 3, F.col("th"))).where(
        (F.col("a_token_id") != F.col("b_token_id")) & ~F.col("b_is_label") & (b.x >= a.right - 2) & (b.x - a.right < F.col("a_th") * 3) & (F.abs(b.y - a.y) < F.col("a_th") * 0.7)).withColumnRenamed("a_token_id", "token_id")
    nxt = best_partner(row, keys, [b.x, F.col("b_token_id")], {"n_x": b.x, "n_y": b.y, "n_text": F.col("b_text"), "l_text": F.col("a_text"), "n_th": F.col("a_th")})
    joined = nxt.withColumn("_key", label_key(F.concat_ws(" ", F.trim("l_text"), F.trim("n_text")))).join(known, "_key", "left")
    open_ = joined.where(F.col("_known").isNull() & F.col("l_text").rlike(r"[:?]\s*$")).select(*keys, "n_x", "n_y", "l_text", "n_th")
    band = open_.select(*keys, F.col("n_x").alias("x"), F.col("n_y").alias("y"), F.col("n_th").alias("th"), "l_text", F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    rest = near_join(band, others.where(~F.col("is_label")), by, reach=_flat(F.col("y")).grown(0.0, F.col("th") * 0.7, 0.0, F.col("th") * 0.7), b_extent=_flat(F.col("y"))).where(
        (F.col("b_x") >= F.col("a_x")) & (F.abs(F.col("b_y") - F.col("a_y")) < F.col("a_th") * 0.7))
    values = rest.groupBy(*by, F.col("a_token_id").alias("token_id")).agg(F.first("a_l_text").alias("_l"), F.array_sort(F.collect_list(F.struct(F.col("b_token_id").alias("i"), F.col("b_text").alias("t")))).alias("_w"))
    second = values.select(*keys, tidy(F.col("_l")).alias("label"), F.array_join(F.transform("_w", lambda e: e["t"]), " ").alias("value"), F.lit("next_words").alias("how"))
    return first.unionByName(second)


def free_space_fields(token: DataFrame, region: DataFrame, page: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Label without a box: the room to the next word of its row, at least three heights, nearly free of ink.

    ``token``: ``is_label`` and optionally ``ink_ratio`` of the space behind it.
    """
    a, b = box(A), box(B)
    boxed = near_join(token.where("is_label").select(*by, "token_id", "x", "y", "w", "h"), region.select(*by, "x", "y", "w", "h"), by).where(share(a, b) > 0.5)
    labels = without_partner(token.where("is_label"), boxed, by, ["token_id"]).join(page.select(*by, "page_w", "page_h"), list(by)).join(heights.select(*by, "typical_h"), list(by), "left").withColumn("th", F.coalesce("typical_h", F.lit(20.0)))
    row = near_join(labels.select(*by, "token_id", "x", "y", "w", "h", "th"), token.select(*by, "token_id", "x", "y"), by, reach=_flat(F.col("y")).grown(0.0, F.col("th") * 0.6, 0.0, F.col("th") * 0.6), b_extent=_flat(F.col("y"))).where(
        (F.col("a_token_id") != F.col("b_token_id")) & (F.col("b_x") > a.right) & (F.abs(F.col("b_y") - a.y) < F.col("a_th") * 0.6))
    nxt = row.groupBy(*by, F.col("a_token_id").alias("token_id")).agg(F.min("b_x").alias("_next"))
    margin = F.greatest(F.lit(4.0), F.col("th") * 0.18)
    x = F.col("x") + F.col("w") + margin
    end = F.coalesce(F.col("_next") - margin, F.least(F.col("page_w") * 0.92, x + F.col("page_w") * 0.35))
    ink = F.coalesce("ink_ratio", F.lit(0.0)) if "ink_ratio" in token.columns else F.lit(0.0)
    out = labels.join(nxt, [*by, "token_id"], "left").withColumns({"fx": x, "fy": F.col("y") - margin, "fw": end - x, "fh": F.col("th") * 1.7, "_ink": ink})
    return out.where((F.col("fw") >= F.col("th") * 3) & (F.col("fy") >= 0) & (F.col("fy") + F.col("fh") <= F.col("page_h")) & (F.col("_ink") <= 0.008)).select(
        *by, "token_id", tidy(F.col("text")).alias("label"), F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fw").alias("w"), F.col("fh").alias("h"))


class Candidates(NamedTuple):
    """``kept``: proposals with ``item`` and ``recovered``; ``dropped``: ``by``, ``stage``, ``item_id``, ``reason`` of every input that led to none;
    ``expected``: places of a page where a field is likely (``by``, ``expected``)."""

    kept: DataFrame
    dropped: DataFrame
    expected: DataFrame


# What a field number means: the kind of input it comes from is its remainder by 8.
_KINDS = ("line", "rect", "rect", "line", "text", "line")


def _item(field_id: Column) -> Column:
    kinds = F.array(*map(F.lit, _KINDS))
    return F.concat(F.get(kinds, F.pmod(field_id, F.lit(8)).cast("int")), F.lit(":"), F.floor(field_id / 8).cast("bigint").cast("string"))


def _recovered_lines(line: DataFrame, pool: DataFrame, prompts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lines of 45 pt or more that no proposal stands on, with a prompt up to 70 pt to the left or 32 pt above: the first in order names them."""
    a, b = box(A), box(B)
    strokes = line_boxes(line.where(F.col("x2") - F.col("x1") >= 45), by)
    held = near_join(strokes, pool.select(*by, "x", "y", "w", "h"), by, reach=box().grown(0.0, 9.0, 0.0, 9.0)).where(
        (F.abs(b.bottom - a.y) <= 8) & (a.right > b.x) & (a.x < b.right))
    free = without_partner(strokes, held, by, ["line_id"])
    beside = (F.abs(b.bottom - a.y) < 20) & (b.right <= a.x + 25) & (a.x - b.right < 70)
    above = (a.y - b.bottom >= 0) & (a.y - b.bottom < 32) & (F.abs(b.x - a.x) < 60)
    near = near_join(free, prompts, by, reach=box().grown(75.0, 35.0, 65.0, 25.0)).where(beside | above)
    named = near.groupBy(*by, F.col("a_line_id").alias("line_id")).agg(
        F.min(F.struct(F.col("b_token_id").alias("t"), F.col("b_text").alias("label"), (F.col("b_x") + F.col("b_w")).alias("end"))).alias("p"))
    found = free.join(named, [*by, "line_id"])
    start = F.greatest(F.col("x"), round_to(F.col("p.end") + 4, 1))
    return found.select(*by, "line_id", start.alias("x"), F.greatest(F.lit(0.0), F.col("y") - 18).alias("y"), F.greatest(F.lit(30.0), F.col("x") + F.col("w") - start).alias("w"),
                        F.lit(20.0).alias("h"), F.col("p.label").alias("label"))


def field_candidates(line: DataFrame, rect: DataFrame, token: DataFrame, text_field: DataFrame, stored: DataFrame, page: DataFrame, by: Sequence[str] = PAGE,
                     **bounds: int | None) -> Candidates:
    """All candidates of a page: strokes cleaned and joined, writing areas, cells, single lines and given text fields, lines recovered under a relaxed reach of prompts,
    then snapped, clipped, checked, fused and compared with stored fields.

    ``token``: ``is_prompt``; ``text_field``: field_id, box, label, confidence. Every horizontal line, every rectangle and every text field leaves
    either as the ``item`` of a kept proposal or with one stage and reason; ``discard_trace`` and ``discard_funnel`` read ``dropped`` as they are.
    ``bounds`` (``many``, ``refine_over``, ``keep``) go to :func:`judge_candidates`; by default no page is bounded.
    """
    dropped: list[DataFrame] = []

    def drop(stage: str, rows: DataFrame, item: Column, reason: str | Column) -> None:
        told = F.lit(reason) if isinstance(reason, str) else reason
        dropped.append(rows.select(*by, F.lit(stage).alias("stage"), item.alias("item_id"), told.alias("reason")))

    named_item = lambda kind, number: F.concat(F.lit(f"{kind}:"), F.col(number).cast("bigint").cast("string"))
    # one written table per stage: every later stage reads several earlier ones
    joined = cut_lineage(merge_colinear(line.where(~F.col("is_vertical")), token, by).withColumn("is_vertical", F.lit(False)))
    drop("strokes", joined.select(*by, F.explode(F.slice("line_ids", 2, F.greatest(F.lit(1), F.size("line_ids")))).alias("line_id")), named_item("line", "line_id"), "MERGED")
    judged = cut_lineage(table_structure(joined.select(*by, "line_id", "x1", "x2", "y", "is_vertical"), rect, token, page, by))
    drop("structure", judged.where(F.col("reason").isNotNull()), named_item("line", "line_id"), "TABLE_STRUCTURE")
    usable = cut_lineage(judged.where(F.col("reason").isNull()).drop("reason"))
    areas = cut_lineage(multiline_areas(usable, token, by))
    used = areas.select(*by, F.explode("line_ids").alias("line_id"))
    drop("areas", areas.select(*by, F.explode(F.slice("line_ids", 2, F.size("line_ids"))).alias("line_id")), named_item("line", "line_id"), "MERGED")
    single = usable.join(used, [*by, "line_id"], "left_anti")
    prompts = token.where("is_prompt").select(*by, "token_id", "x", "y", "w", "h", "text")
    raised = line_boxes(single, by).withColumnRenamed("line_id", "field_id").withColumns({"y": F.col("y") - 18, "h": F.lit(18.0)})
    named = cut_lineage(nearest_label(raised, prompts, by).where(F.col("label_text").isNotNull()))
    large = (F.col("w") >= 30) & (F.col("h") >= 16)
    drop("boxes", rect.where(~F.col("is_checkbox") & ~large), named_item("rect", "rect_id"), "TOO_SMALL")

    def proposal(rows: DataFrame, part: int, number: Column, label, kind, derivation: str, confidence) -> DataFrame:
        column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return rows.select(*by, (number.cast("bigint") * 8 + part).alias("field_id"), (F.lit(part) * F.lit(1_000_000_000).cast("bigint") + number.cast("bigint")).alias("ord"),
                           *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], column(label).alias("label"), column(kind).alias("field_type"),
                           F.lit(derivation).alias("derivation"), column(confidence).cast("double").alias("confidence"))

    stacked = areas.select(*by, F.col("line_ids")[0].alias("n"), "x", (F.col("y") - 14).alias("y"), "w", (F.col("h") + 14).alias("h"))
    inner = rect.where(~F.col("is_checkbox") & large).select(*by, "rect_id", (F.col("x") + 2).alias("x"), (F.col("y") + 2).alias("y"), (F.col("w") - 4).alias("w"), (F.col("h") - 4).alias("h"), F.col("h").alias("tall"))
    kinds = [
        proposal(stacked, 0, F.col("n"), "Area di testo", "TEXT_LONG", "VECTOR_LINE", 0.9),
        proposal(inner, 1, F.col("rect_id"), "Cella", F.when(F.col("tall") >= 45, "TEXT_LONG").otherwise("TEXT_SHORT"), "TABLE_CELL", 0.88),
        proposal(rect.where("is_checkbox"), 2, F.col("rect_id"), "Scelta", "CHECKBOX", "CHECKBOX_BOX", 0.9),
        proposal(named, 3, F.col("field_id"), F.col("label_text"), "TEXT_SHORT", "VECTOR_LINE", 0.85),
        proposal(text_field, 4, F.col("field_id"), F.col("label"), "TEXT_SHORT", "TEXT_ANCHOR", F.col("confidence")),
    ]
    pool = kinds[0]
    for k in kinds[1:]:
        pool = pool.unionByName(k)
    pool = cut_lineage(pool)
    left = single.join(named.select(*by, F.col("field_id").alias("line_id")), [*by, "line_id"], "left_anti")
    back = cut_lineage(_recovered_lines(left, pool, prompts, by))
    drop("labels", left.join(back.select(*by, "line_id"), [*by, "line_id"], "left_anti"), named_item("line", "line_id"), "NO_LABEL")
    pool = pool.unionByName(proposal(back, 5, F.col("line_id"), F.col("label"), F.when(F.lower("label").rlike("data|nato il|lì"), "DATE").otherwise("TEXT_SHORT"), "VECTOR_LINE", 0.86))
    snapped = cut_lineage(snap_to_structure(cut_lineage(pool), rect, usable, by))
    clipped = cut_lineage(clamp_boxes(snapped, page, by))
    from_field = _item(F.col("field_id"))
    drop("bounds", snapped.join(clipped.select(*by, "field_id"), [*by, "field_id"], "left_anti"), from_field, "OUT_OF_BOUNDS")
    checked = cut_lineage(validate_geometry(clipped, page, by))
    why = F.when(F.col("reason") == "OUT_OF_BOUNDS", F.col("reason")).when(F.col("reason").isin("FIELD_TOO_SMALL", "MULTILINE_TOO_SMALL"), "TOO_SMALL").otherwise("GEOMETRY_SUSPECT")
    drop("geometry", checked.where(F.col("reason").isNotNull()), from_field, why)
    cells = rect.withColumnRenamed("rect_id", "cell_id")
    fit = cut_lineage(geometry_fit(checked.where(F.col("reason").isNull()).drop("reason"), prompts, cells, page, by))
    suspect = F.coalesce(F.col("suspect") & (F.col("fit_score") < 0.45), F.lit(False))
    drop("fit", fit.where(suspect), from_field, "GEOMETRY_SUSPECT")
    fitting = fit.where(~suspect).drop("fit_score", "suspect", "fit_reason")
    fused = cut_lineage(fuse_candidates(fitting.withColumn("semantic_key", F.lit(None).cast("string")), by))
    drop("fusion", fitting.join(fused.select(*by, "field_id"), [*by, "field_id"], "left_anti"), from_field, "DUPLICATE")
    typed = fused.join(fitting.select(*by, "field_id", "field_type"), [*by, "field_id"])
    compared = cut_lineage(diff_against_existing(cut_lineage(typed).withColumn("generic", F.lit(False)), stored, by))
    drop("stored", compared.where(F.col("class") != "new"), from_field, "DUPLICATE")
    last = cut_lineage(judge_candidates(compared.where(F.col("class") == "new").drop("class", "generic", "merged"), by, **bounds))
    drop("refinement", last.where(F.col("reason").isNotNull()), from_field, F.col("reason"))
    gone = dropped[0]
    for d in dropped[1:]:
        gone = gone.unionByName(d)
    kept = last.where(F.col("reason").isNull()).drop("reason").withColumns({"item": from_field, "recovered": F.pmod(F.col("field_id"), F.lit(8)) == 5})
    likely = (rect.where(~F.col("is_checkbox") & (F.col("w") >= 40) & (F.col("h") >= 18)).select(*by).unionByName(areas.select(*by)).unionByName(text_field.select(*by))
              .groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("expected")))
    expected = page.select(*by).join(likely, list(by), "left").na.fill(0.0, ["expected"])
    return Candidates(kept, gone, expected)


def detection_flags(final: DataFrame, uncovered: DataFrame, expected: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Over- and under-detection per page: more than 30 proposals, or few beside three or more places that only the recovery pass found."""
    joined = expected.join(final.groupBy(*by).agg(F.count(F.lit(1)).alias("fields")), list(by), "left").join(uncovered.groupBy(*by).agg(F.count(F.lit(1)).alias("open")), list(by), "left").na.fill(0)
    return joined.withColumns({"over_detection": F.col("fields") > 30, "under_detection": (F.col("open") >= 3) & (F.col("fields") < F.greatest(F.lit(6.0), F.col("expected") * 0.6))})
