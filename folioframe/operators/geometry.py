"""Box arithmetic over whole corpora: spaces, limits, overlaps, containment and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.numbers import half_up, let, round_to
from folioframe.plans.spatial import (
    PAGE, Box, best_partner, box, iou, near_join, share, share_either, share_of_smaller, shared_area,
    shared_width, touches, with_partner, without_partner,
)
from folioframe.session import cut_lineage

MEASURES = {"share": share, "either": share_either, "smaller": share_of_smaller, "iou": iou}


# ---------------------------------------------------------------- spaces and limits
def clamp_boxes(field: DataFrame, page: DataFrame, by: Sequence[str] = PAGE, smallest: float = 6.0,
                slack: float = 1.0) -> DataFrame:
    """Drop boxes outside the page or degenerate, clip the rest, drop what is left below 6 pt."""
    b, pw, ph = box(), F.col("page_w"), F.col("page_h")
    sized = field.join(page.select(*by, "page_w", "page_h"), list(by)).where(
        (b.right >= -slack) & (b.bottom >= -slack) & (b.x <= pw + slack) & (b.y <= ph + slack) & (b.w > 0) & (b.h > 0))
    x, y = F.greatest(F.lit(0.0), b.x), F.greatest(F.lit(0.0), b.y)
    w, h = F.least(b.w - (x - b.x), pw - x), F.least(b.h - (y - b.y), ph - y)
    new = {"x": x, "y": y, "w": w, "h": h}
    clipped = sized.withColumns({f"_{k}": v for k, v in new.items()})
    clipped = clipped.where((F.col("_w") >= smallest) & (F.col("_h") >= smallest))
    return clipped.select(*[round_to(F.col(f"_{c}"), 2).alias(c) if c in new else F.col(c) for c in field.columns])


def validate_geometry(field: DataFrame, page: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """``reason`` per field: null when its box is plausible for its type."""
    b, pw, ph = box(), F.col("page_w"), F.col("page_h")
    kind = F.coalesce("field_type", F.lit("TEXT_SHORT"))
    is_check, is_long = kind.isin("SINGLE_CHOICE", "CHECKBOX"), kind == "TEXT_LONG"
    is_short = ~is_check & ~is_long
    reason = (
        F.when((b.x < 0) | (b.y < 0) | (b.w <= 0) | (b.h <= 0) | (b.right > pw + 2) | (b.bottom > ph + 2), "OUT_OF_BOUNDS")
        .when(is_check & ((b.w < 6) | (b.w > 40) | (b.h < 6) | (b.h > 40)), "INVALID_CHECKBOX_SIZE")
        .when(is_check & ((b.w / b.h < 0.5) | (b.w / b.h > 2.0)), "CHECKBOX_ASPECT_RATIO_DISPROPORTIONATE")
        .when(is_long & ((b.w < 40) | (b.h < 18)), "MULTILINE_TOO_SMALL")
        .when(is_long & ((b.h > ph * 0.95) | (b.w > pw * 0.98)), "MULTILINE_DISPROPORTIONATELY_LARGE")
        .when(is_short & ((b.w < 20) | (b.h < 8)), "FIELD_TOO_SMALL")
        .when(is_short & (b.h > 60) & (b.w < 100), "SHORT_FIELD_TOO_TALL")
        .when(is_short & (b.w > pw * 0.98) & (b.h < 10), "DEGENERATE_LINE_RECT")
    )
    return field.join(page.select(*by, "page_w", "page_h"), list(by)).withColumn("reason", reason).drop("page_w", "page_h")


def geometry_fit(field: DataFrame, prompt: DataFrame, cell: DataFrame, page: DataFrame,
                 by: Sequence[str] = PAGE) -> DataFrame:
    """Fit score of a field: bounds 0.3, size 0.25, prompt kept clear 0.25, inside its cell 0.2."""
    A, B = box("a_"), box("b_")
    keys = [*by, "field_id"]
    slim = field.select(*keys, "x", "y", "w", "h")
    collides = near_join(slim, prompt.select(*by, "x", "y", "w", "h"), by).where(
        (B.area > 0) & (shared_area(A, B) / B.area > 0.15)
    ).select(*by, F.col("a_field_id").alias("field_id")).distinct().withColumn("collides", F.lit(True))
    inside = near_join(slim, cell.select(*by, "cell_id", "x", "y", "w", "h"), by).where(shared_area(A, B) > 0)
    overflow = (A.x < B.x - 2) | (A.y < B.y - 2) | (A.right > B.right + 2) | (A.bottom > B.bottom + 2)
    home = best_partner(inside.withColumnRenamed("a_field_id", "field_id"), keys,
                        [-shared_area(A, B), F.col("b_cell_id")], {"overflows": overflow})
    b, pw, ph = box(), F.col("page_w"), F.col("page_h")
    kind = F.coalesce("field_type", F.lit("TEXT_SHORT"))
    is_check, is_long = kind.isin("SINGLE_CHOICE", "CHECKBOX"), kind == "TEXT_LONG"
    size = (
        F.when(is_check & ((b.w < 6) | (b.w > 35) | (b.h < 6) | (b.h > 35)), 0.3)
        .when(is_long & ((b.h < 18) | (b.w < 40)), 0.4)
        .when(~is_check & ~is_long & ((b.h < 8) | (b.h > 60) | (b.w < 18)), 0.4).otherwise(1.0)
    )
    label = F.when(F.col("collides"), 0.2).otherwise(1.0)
    held = F.when(F.col("overflows"), 0.5).otherwise(1.0)
    raw = F.lit(0.3) + size * 0.25 + label * 0.25 + held * 0.2
    raw = F.when(label < 0.5, F.least(F.lit(0.4), raw * label)).otherwise(raw)
    outside = (b.x < 0) | (b.y < 0) | (b.w <= 0) | (b.h <= 0) | (b.right > pw + 2) | (b.bottom > ph + 2)
    scored = (
        field.join(page.select(*by, "page_w", "page_h"), list(by))
        .join(collides, keys, "left").join(home, keys, "left")
        .withColumn("fit_score", F.when(outside, 0.1).otherwise(round_to(raw, 2)))
        .withColumn("suspect", F.col("fit_score") < 0.6)
        .withColumn("fit_reason", F.when(outside, "OUT_OF_PAGE_BOUNDS").when(~F.col("suspect"), None)
                    .when(label < 0.5, "LABEL_COLLISION").when(size < 0.5, "SIZE_DISPROPORTIONATE")
                    .otherwise("ALIGNMENT_SUSPECT"))
    )
    return scored.select(*field.columns, "fit_score", "suspect", "fit_reason")


def rebase_boxes(field: DataFrame, transform: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Move boxes to the normalised page, always from their original bounds.

    ``field`` may carry ``orig_x .. orig_h`` (null: the box itself) and ``adjusted``; ``transform``
    has ``affine ARRAY<DOUBLE>`` per page (null: nothing to do) with x' = a·x + c·y + e.
    """
    moved = field.join(transform.select(*by, "affine"), list(by), "left")
    x, y, w, h = (F.coalesce(F.col(f"orig_{c}"), F.col(c)) for c in "xywh")
    m = [F.col("affine")[i] for i in range(6)]
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    xs = [m[0] * px + m[2] * py + m[4] for px, py in corners]
    ys = [m[1] * px + m[3] * py + m[5] for px, py in corners]
    new = {"x": F.least(*xs), "y": F.least(*ys), "w": F.greatest(*xs) - F.least(*xs), "h": F.greatest(*ys) - F.least(*ys)}
    kept = (F.coalesce("adjusted", F.lit(False)) & F.col("orig_x").isNotNull()) | F.col("affine").isNull()
    orig = {f"orig_{c}": v for c, v in zip("xywh", (x, y, w, h))}
    return moved.select(*[
        F.when(kept, F.col(c)).otherwise(round_to(new[c], 2)).alias(c) if c in new
        else F.when(kept, F.col(c)).otherwise(orig[c]).alias(c) if c in orig else F.col(c)
        for c in field.columns])


def to_bottom_left(b: Box, page_h: Column) -> Box:
    return Box(round_to(b.x, 2), round_to(page_h - b.y - b.h, 2), round_to(b.w, 2), round_to(b.h, 2))


def to_top_left(b: Box, page_h: Column) -> Box:
    """Inverse of :func:`to_bottom_left`; the reflection is its own inverse."""
    return to_bottom_left(b, page_h)


def scaled(b: Box, scale_x: Column, scale_y: Column, dx: float | Column = 0.0, dy: float | Column = 0.0) -> Box:
    return Box(b.x * scale_x + dx, b.y * scale_y + dy, b.w * scale_x, b.h * scale_y)


def rotated(b: Box, page_w: Column, page_h: Column, angle: Column) -> Box:
    """Box after turning the page clockwise by 90, 180 or 270 degrees."""
    turn = lambda q, half, three, same: F.when(angle == 90, q).when(angle == 180, half).when(angle == 270, three).otherwise(same)
    return Box(
        turn(page_h - b.y - b.h, page_w - b.x - b.w, b.y, b.x), turn(b.x, page_h - b.y - b.h, page_w - b.x - b.w, b.y),
        turn(b.h, b.w, b.h, b.w), turn(b.w, b.h, b.w, b.h))


def normalised(b: Box, page_w: Column, page_h: Column) -> Box:
    return Box(b.x / page_w, b.y / page_h, b.w / page_w, b.h / page_h)


def convert_space(df: DataFrame, page: DataFrame, convert, by: Sequence[str] = PAGE) -> DataFrame:
    """Apply one of the conversions above; ``convert(box, page_row)`` sees the page columns."""
    joined = df.join(page, list(by))
    new = convert(box(), F.col)
    return joined.select(*[getattr(new, c).alias(c) if c in "xywh" else F.col(c) for c in df.columns])


def presentation_override(field: DataFrame, override: DataFrame, page: DataFrame,
                          by: Sequence[str] = PAGE) -> DataFrame:
    """Per-document size and font overrides, clamped; fields without an override pass through."""
    joined = field.join(override, [*by, "field_id"], "left").join(page.select(*by, "page_w", "page_h"), list(by))
    some = F.coalesce("o_w", "o_h", "o_font").isNotNull()

    def bounded(value: Column, fallback: Column, low: float, high: Column) -> Column:
        usable = F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(fallback)
        return F.least(high, F.greatest(F.least(F.lit(low), high), usable))

    default = F.when(F.col("field_type") == "TEXT_LONG", 10.0).otherwise(
        F.least(F.lit(11.0), F.greatest(F.lit(8.0), F.col("h") * 0.55)))
    room_w = F.greatest(F.lit(1.0), F.col("page_w") - F.col("x"))
    room_h = F.greatest(F.lit(1.0), F.col("page_h") - F.col("y"))
    new = {"w": bounded(F.col("o_w"), F.col("w"), 6.0, room_w), "h": bounded(F.col("o_h"), F.col("h"), 6.0, room_h)}
    return joined.select(
        *[F.when(some, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in field.columns],
        F.when(some, bounded(F.col("o_font"), default, 6.0, F.lit(72.0))).alias("font_size"))


# ---------------------------------------------------------------- joins
def overlap_join(a: DataFrame, b: DataFrame, by: Sequence[str] = PAGE, *, over: float = 0.0,
                 measure: str = "share") -> DataFrame:
    """Pairs on a page whose overlap ``measure`` exceeds ``over``; the measure is a column."""
    pairs = near_join(a, b, by).withColumn("overlap", MEASURES[measure](box("a_"), box("b_")))
    return pairs.where(F.col("overlap") > over)


def tokens_in_region(token: DataFrame, region: DataFrame, by: Sequence[str] = PAGE, over: float = 0.55) -> DataFrame:
    return overlap_join(token, region, by, over=over)


def smallest_container(token: DataFrame, region: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Smallest region that holds the whole word (two pixels of slack on the far sides)."""
    A, B = box("a_"), box("b_")
    pairs = near_join(token.select(*by, "token_id", "x", "y", "w", "h"),
                      region.select(*by, "region_id", "x", "y", "w", "h"), by).where(
        (A.x >= B.x) & (A.y >= B.y) & (A.right <= B.right + 2) & (A.bottom <= B.bottom + 2))
    best = best_partner(pairs.withColumnRenamed("a_token_id", "token_id"), [*by, "token_id"],
                        [B.area, F.col("b_region_id")], {"region_id": F.col("b_region_id")})
    return token.join(best, [*by, "token_id"], "left")


def background_mode(field: DataFrame, token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Opaque where a printed word overlaps the inset field by more than a quarter of the smaller area."""
    b = box()
    mx, my = F.least(F.lit(8.0), b.w * 0.1), F.least(F.lit(4.0), b.h * 0.1)
    inset = field.select(*by, "field_id", (b.x + mx).alias("x"), (b.y + my).alias("y"),
                         F.greatest(F.lit(1.0), b.w - mx * 2).alias("w"), F.greatest(F.lit(1.0), b.h - my * 2).alias("h"))
    hit = near_join(inset, token.select(*by, "x", "y", "w", "h"), by).where(
        share_of_smaller(box("a_"), box("b_")) > 0.25
    ).select(*by, F.col("a_field_id").alias("field_id")).distinct()
    return field.join(hit.withColumn("_hit", F.lit(True)), [*by, "field_id"], "left").withColumn(
        "background_mode", F.when(F.col("_hit"), "OPAQUE_WHITE").otherwise("TRANSPARENT")).drop("_hit")


def cell_adjacency(cell: DataFrame, heights: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Undirected edges between cells that share a measured side, with their direction."""
    sized = cell.select(*by, "cell_id", "x", "y", "w", "h").join(heights.select(*by, "typical_h"), list(by), "left")
    sized = sized.withColumn("tol", F.greatest(F.lit(5.0), F.coalesce("typical_h", F.lit(20.0)) * 0.6)).drop("typical_h")
    A, B, tol = box("a_"), box("b_"), F.col("a_tol")
    pairs = near_join(sized, sized, by, reach=box().grown(*(F.col("tol"),) * 4), tile=512.0).where(
        F.col("a_cell_id") < F.col("b_cell_id"))
    xo = F.least(A.right, B.right) - F.greatest(A.x, B.x)
    yo = F.least(A.bottom, B.bottom) - F.greatest(A.y, B.y)
    stacked = (F.least(F.abs(A.bottom - B.y), F.abs(B.bottom - A.y)) <= tol) & (xo >= F.least(A.w, B.w) * 0.7)
    beside = (F.least(F.abs(A.right - B.x), F.abs(B.right - A.x)) <= tol) & (yo >= F.least(A.h, B.h) * 0.7)
    return pairs.where(stacked | beside).select(
        *by, F.col("a_cell_id").alias("cell_a"), F.col("b_cell_id").alias("cell_b"),
        F.when(stacked, "vertical").otherwise("horizontal").alias("direction"))


def aligned_peers(cell: DataFrame, heights: DataFrame, direction: str, by: Sequence[str] = PAGE) -> DataFrame:
    """Row or column neighbours of the same size, as (cell_id, peer_id, peer box)."""
    sized = cell.select(*by, "cell_id", "x", "y", "w", "h").join(heights.select(*by, "typical_h"), list(by), "left")
    sized = sized.withColumn("tol", F.greatest(F.lit(5.0), F.coalesce("typical_h", F.lit(20.0)) * 0.6)).drop("typical_h")
    A, B, tol = box("a_"), box("b_"), F.col("a_tol")
    pairs = near_join(sized, sized, by, reach=box().grown(*(F.col("tol"),) * 4), tile=512.0).where(
        F.col("a_cell_id") != F.col("b_cell_id"))
    if direction == "row":
        near = (F.abs(A.y - B.y) < tol) & (F.abs(A.h - B.h) < tol) & (
            F.least(F.abs(B.right - A.x), F.abs(A.right - B.x)) < tol)
    else:
        near = (F.abs(A.x - B.x) < tol) & (F.abs(A.w - B.w) < tol * 2) & (
            F.least(F.abs(B.bottom - A.y), F.abs(A.bottom - B.y)) < tol)
    return pairs.where(near).select(*by, F.col("a_cell_id").alias("cell_id"), F.col("b_cell_id").alias("peer_id"),
                                    B.x.alias("peer_x"), B.y.alias("peer_y"), B.w.alias("peer_w"), B.h.alias("peer_h"))


def explicit_over_inferred(explicit: DataFrame, inferred: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Explicit fields, and the inferred ones that overlap none of them by more than half."""
    hit = near_join(inferred, explicit.select(*by, "x", "y", "w", "h"), by).where(
        share_either(box("a_"), box("b_")) > 0.5)
    return explicit.unionByName(without_partner(inferred, hit, by, ["field_id"]))


def is_protected() -> Column:
    """Fields that automatic reconstruction must not touch."""
    return (
        F.coalesce("derivation", F.lit("")).isin("MANUAL", "USER_CREATED", "ACROFORM", "MANUAL_VERIFIED")
        | F.coalesce("calibration_status", F.lit("")).isin("CONFIRMED", "MODIFIED", "REJECTED")
    )


def substantial_duplicate(cand: DataFrame, stored: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Candidate and stored field pairs that mean the same area, with the rule that found them."""
    A, B = box("a_"), box("b_")
    pairs = near_join(cand, stored, by, reach=box().grown(50.0, 18.0, 50.0, 18.0))
    inter = shared_area(A, B)
    small, large = F.least(A.area, B.area), F.greatest(A.area, B.area)
    wide = F.greatest(A.w, B.w)
    width_ratio = F.when(wide > 0, F.least(A.w, B.w) / wide).otherwise(1.0)
    high = F.greatest(A.h, B.h)
    centre = F.sqrt((A.cx - B.cx) * (A.cx - B.cx) + (A.cy - B.cy) * (A.cy - B.cy))
    la, lb = F.lower(F.trim(F.coalesce("a_label", F.lit("")))), F.lower(F.trim(F.coalesce("b_label", F.lit(""))))
    named = (la != "") & (lb != "") & (la.contains(lb) | lb.contains(la))
    rule = (
        F.when(share_of_smaller(A, B) >= 0.45, "OVERLAP")
        .when((inter > 0) & (((width_ratio >= 0.6) & (small > 0) & (inter >= small * 0.55)) | ((large > 0) & (inter >= large * 0.5))),
              "CONTAINMENT")
        .when((centre <= 18) & (width_ratio > 0.35) & (F.least(A.h, B.h) > high * 0.35), "CENTRE")
        .when((F.abs(A.y - B.y) <= 8) & (width_ratio >= 0.6) & (F.least(A.w, B.w) > 0)
              & (shared_width(A, B) >= F.least(A.w, B.w) * 0.5), "BAND")
        .when(named & (F.abs(A.y - B.y) <= 16) & (F.abs(A.x - B.x) <= 50), "LABEL")
    )
    return pairs.withColumn("rule", rule).where(F.col("rule").isNotNull())


def protected_conflict(cand: DataFrame, stored: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Candidates that duplicate a protected field, or (``generic`` ones) merely touch it."""
    kept = stored.where(is_protected()).select(*by, "field_id", "x", "y", "w", "h", "label")
    slim = cand.select(*by, "field_id", "x", "y", "w", "h", "label", "generic")
    dup = substantial_duplicate(slim, kept, by).select(*by, F.col("a_field_id").alias("field_id"))
    touching = near_join(slim.where("generic"), kept, by).where(touches(box("a_"), box("b_"))).select(
        *by, F.col("a_field_id").alias("field_id"))
    return cand.join(dup.union(touching).distinct(), [*by, "field_id"], "left_semi")


def diff_against_existing(cand: DataFrame, stored: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Class of every candidate: protected_duplicate, matched_automatic or new."""
    slim = stored.select(*by, "x", "y", "w", "h", "label", is_protected().alias("protected"))
    dup = substantial_duplicate(cand.select(*by, "field_id", "x", "y", "w", "h", "label"), slim, by)
    flags = dup.groupBy(*by, F.col("a_field_id").alias("field_id")).agg(
        F.max("b_protected").alias("_protected"), F.max(~F.col("b_protected")).alias("_automatic"))
    touching = near_join(cand.where("generic").select(*by, "field_id", "x", "y", "w", "h"), slim.where("protected"), by).where(
        touches(box("a_"), box("b_"))).select(*by, F.col("a_field_id").alias("field_id")).distinct()
    judged = cand.join(flags, [*by, "field_id"], "left").join(
        touching.withColumn("_touch", F.lit(True)), [*by, "field_id"], "left")
    return judged.withColumn(
        "class", F.when(F.col("_protected") | F.col("_touch"), "protected_duplicate")
        .when(F.col("_automatic"), "matched_automatic").otherwise("new")).drop("_protected", "_automatic", "_touch")


def rebuild_page(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Protected stored fields stay; every automatic one is replaced by the new proposals."""
    return stored.where(is_protected()).unionByName(proposed, allowMissingColumns=True)


# ---------------------------------------------------------------- coverage
def _union_area(clips: Column) -> Column:
    """Area of a union of rectangles given as structs (x0, y0, x1, y1)."""
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform(clips, lambda c: F.array(c["x0"], c["x1"])))))
    return let(edges, lambda xs: _strips(clips, xs))


def _strips(clips: Column, xs: Column) -> Column:
    def strip(right: Column, i: Column) -> Column:
        left = F.get(xs, i - 1)
        spans = F.array_sort(F.transform(
            F.filter(clips, lambda c: (c["x0"] < right) & (c["x1"] > left)),
            lambda c: F.struct(c["y0"].alias("y0"), c["y1"].alias("y1"))))
        height = F.aggregate(
            spans, F.struct(F.lit(float("-inf")).alias("end"), F.lit(0.0).alias("sum")),
            lambda acc, s: F.struct(
                F.greatest(acc["end"], s["y1"]).alias("end"),
                (acc["sum"] + F.greatest(F.lit(0.0), s["y1"] - F.greatest(acc["end"], s["y0"]))).alias("sum")),
            lambda acc: acc["sum"])
        return F.when(i == 0, 0.0).otherwise((right - left) * height)

    return F.aggregate(F.transform(xs, strip), F.lit(0.0), lambda acc, v: acc + v)


def union_coverage(region: DataFrame, field: DataFrame, by: Sequence[str] = PAGE, *, region_id: str = "region_id",
                   strip: float = 256.0) -> DataFrame:
    """Share of each region covered by the union of the fields that are not ignored.

    Regions are cut into vertical strips whose covered areas add up, so that no single row gathers
    all the fields of a huge region; equal clips inside a strip are kept once.
    """
    A, B = box("a_"), box("b_")
    live = field.where(F.coalesce("status", F.lit("review")) != "ignored").select(*by, "x", "y", "w", "h")
    pairs = near_join(region.select(*by, region_id, "x", "y", "w", "h"), live, by).where(touches(A, B))
    x0, x1 = F.greatest(A.x, B.x), F.least(A.right, B.right)
    clips = pairs.select(
        *by, F.col(f"a_{region_id}").alias(region_id), x0.alias("x0"), x1.alias("x1"),
        F.greatest(A.y, B.y).alias("y0"), F.least(A.bottom, B.bottom).alias("y1"),
        F.explode(F.sequence(F.floor(x0 / strip), F.floor(x1 / strip))).alias("strip"))
    cut = F.struct(F.greatest("x0", F.col("strip") * strip).alias("x0"), F.col("y0"),
                   F.least("x1", (F.col("strip") + 1) * strip).alias("x1"), F.col("y1"))
    areas = clips.groupBy(*by, region_id, "strip").agg(F.collect_set(cut).alias("clips")).select(
        *by, region_id, _union_area(F.col("clips")).alias("area"))
    covered = areas.groupBy(*by, region_id).agg(F.sum("area").alias("_covered"))
    size = F.col("w") * F.col("h")
    ratio = F.when(size > 0, F.least(F.lit(1.0), F.coalesce("_covered", F.lit(0.0)) / size)).otherwise(0.0)
    return region.join(covered, [*by, region_id], "left").withColumn("coverage", ratio).withColumn(
        "covered", F.col("coverage") >= 0.65).drop("_covered")


def coverage_summary(evidence: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Measured, plausible, uncovered before and after, recovered; page, document and corpus rows."""
    plausible = F.col("plausible")
    return evidence.rollup(*by).agg(
        F.count(F.lit(1)).alias("measured"), F.count_if(plausible).alias("plausible"),
        F.count_if(plausible & ~F.col("covered_before")).alias("uncovered_before"),
        F.count_if(F.col("outcome") == "recovered").alias("recovered"),
        F.count_if(plausible & ~F.col("covered_after")).alias("uncovered_after"),
        *[F.count_if(plausible & (F.col("kind") == k)).alias(n) for k, n in
          (("cell", "cells"), ("checkbox", "checkboxes"), ("line", "lines"))])


def overlap_audit(region: DataFrame, token: DataFrame, field: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Per region: words inside it and fields overlapping it either way by more than 0.55."""
    A, B = box("a_"), box("b_")
    slim = region.select(*by, "region_id", "x", "y", "w", "h")
    words = near_join(slim, token.select(*by, "x", "y", "w", "h"), by).where(share(B, A) > 0.55).groupBy(
        *by, F.col("a_region_id").alias("region_id")).agg(F.count(F.lit(1)).alias("words"))
    fields = near_join(slim, field.select(*by, "field_id", "x", "y", "w", "h"), by).where(share_either(A, B) > 0.55).groupBy(
        *by, F.col("a_region_id").alias("region_id")).agg(F.array_sort(F.collect_list("b_field_id")).alias("field_ids"))
    audit = region.join(words, [*by, "region_id"], "left").join(fields, [*by, "region_id"], "left")
    empty = F.array().cast("array<bigint>")
    return audit.withColumns({
        "words": F.coalesce("words", F.lit(0)), "field_ids": F.coalesce("field_ids", empty),
        "outcome": F.when(F.size(F.coalesce("field_ids", empty)) > 0, "proposed").otherwise("excluded"),
        "reason": F.when(F.size(F.coalesce("field_ids", empty)) > 0, "FIELD_PROPOSED").otherwise("NO_MATCHING_FIELD_RULE")})


def _edge_reach(slim: DataFrame, rects: DataFrame, line: DataFrame, by: Sequence[str], tol: float) -> DataFrame:
    """``slim`` with how far each edge may move: ``l0 l1 t0 t1 r0 r1 b0 b1``.

    An edge moves from one structure edge to the next within ``tol``, so it stays inside the chains of
    structure edges (no gap wider than ``tol``) that it starts next to, however long they are.
    """
    at = lambda df, x, y: df.select(*by, F.explode(F.array(
        *[F.struct(F.lit("x").alias("axis"), v.alias("v")) for v in x], *[F.struct(F.lit("y").alias("axis"), v.alias("v")) for v in y])).alias("_p")).select(*by, "_p.*")
    b = box()
    places = at(rects, (b.x, b.right), (b.y, b.bottom)).unionByName(at(line, (F.col("x1"), F.col("x2")), (F.col("y"),))).where(F.col("v").isNotNull()).distinct()
    order = Window.partitionBy(*by, "axis").orderBy("v")
    chained = places.withColumn("_new", F.coalesce((F.col("v") - F.lag("v").over(order) > tol).cast("int"), F.lit(0))).withColumn("_chain", F.sum("_new").over(order))
    chains = cut_lineage(chained.groupBy(*by, "axis", "_chain").agg(F.min("v").alias("low"), F.max("v").alias("high")))
    edges = slim.select(*by, "field_id", F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(name).alias("edge"), v.alias("v")) for axis, name, v in (
        ("x", "l", b.x), ("y", "t", b.y), ("x", "r", b.right), ("y", "b", b.bottom))])).alias("_p")).select(*by, "field_id", "_p.*")
    zero = F.lit(0.0)
    met = near_join(edges, chains, [*by, "axis"], reach=Box(F.col("v") - tol, zero, F.lit(2 * tol), zero), b_extent=Box(F.col("low"), zero, F.col("high") - F.col("low"), zero), tile=1024.0)
    of = lambda name, value: F.when(F.col("a_edge") == name, value)
    far = met.groupBy(*by, F.col("a_field_id").alias("field_id")).agg(
        *[F.min(of(n, F.col("b_low"))).alias(f"{n}0") for n in "ltrb"], *[F.max(of(n, F.col("b_high"))).alias(f"{n}1") for n in "ltrb"])
    start = {"l": b.x, "t": b.y, "r": b.right, "b": b.bottom}
    return slim.join(far, [*by, "field_id"], "left").withColumns({
        **{f"{n}0": F.least(v - tol, F.coalesce(f"{n}0", v) - tol) for n, v in start.items()}, **{f"{n}1": F.greatest(v + tol, F.coalesce(f"{n}1", v) + tol) for n, v in start.items()}})


def snap_to_structure(field: DataFrame, rect: DataFrame, line: DataFrame, by: Sequence[str] = PAGE,
                      tol: float = 6.0) -> DataFrame:
    """Move box edges that lie within ``tol`` of a rectangle or line edge onto it.

    Edges change while rectangles, then lines, are visited in id order, so each field folds over the
    structures along the chains its edges can follow, without a limit on their length.
    """
    rects = rect.select(*by, "rect_id", "x", "y", "w", "h")
    # read by four joins, and written so that the files shuffled for it go before the structures are met
    slim = cut_lineage(_edge_reach(field.select(*by, "field_id", "x", "y", "w", "h"), rects, line, by, tol))
    b, zero, span = box(), F.lit(0.0), lambda low, high: (F.col(low), F.col(high) - F.col(low))
    left, top = F.least("l0", "r0"), F.least("t0", "b0") - 12  # a line's ends count up to 12 pt from the bottom edge
    reach = Box(left, top, F.greatest("l1", "r1") - left, F.greatest("t1", "b1") + 12 - top)
    # a right or bottom edge snaps to any rectangle edge of that height or position, however far away
    across, down = span("r0", "r1"), span("b0", "b1")
    at_right = near_join(slim, rects, by, reach=Box(across[0], zero, across[1], zero), b_extent=Box(b.right, zero, zero, zero))
    at_bottom = near_join(slim, rects, by, reach=Box(zero, down[0], zero, down[1]), b_extent=Box(zero, b.bottom, zero, zero))
    around = near_join(slim, rects, by, reach=reach)
    r = around.unionByName(at_right).unionByName(at_bottom).select(
        *by, F.col("a_field_id").alias("field_id"), F.struct(
            F.lit(0).alias("step"), F.col("b_rect_id").cast("bigint").alias("ord"), F.col("b_x").alias("x0"),
            F.col("b_y").alias("y0"), (F.col("b_x") + F.col("b_w")).alias("x1"), (F.col("b_y") + F.col("b_h")).alias("y1")).alias("s"))
    spans = line.select(*by, "line_id", F.col("x1").alias("x"), "y", (F.col("x2") - F.col("x1")).alias("w"), F.lit(0.0).alias("h"))
    n = near_join(slim, spans, by, reach=reach).select(
        *by, F.col("a_field_id").alias("field_id"), F.struct(
            F.lit(1).alias("step"), F.col("b_line_id").cast("bigint").alias("ord"), F.col("b_x").alias("x0"),
            F.col("b_y").alias("y0"), (F.col("b_x") + F.col("b_w")).alias("x1"), F.col("b_y").alias("y1")).alias("s"))
    near = cut_lineage(r.unionByName(n)).groupBy(*by, "field_id").agg(F.array_sort(F.collect_set("s")).alias("edges"))
    joined = field.join(near, [*by, "field_id"], "left")

    def close(p, q):
        return F.abs(p - q) <= tol

    def step(e, s):
        rectangle = s["step"] == 0
        corner = rectangle & close(e["l"], s["x0"]) & close(e["t"], s["y0"])
        l0, t0 = F.when(corner, s["x0"]).otherwise(e["l"]), F.when(corner, s["y0"]).otherwise(e["t"])
        r0 = F.when(rectangle & close(e["r"], s["x1"]), s["x1"]).otherwise(e["r"])
        b0 = F.when(rectangle & close(e["b"], s["y1"]), s["y1"]).otherwise(e["b"])
        across = ~rectangle & (s["x1"] > e["l"]) & (s["x0"] < e["r"])
        b1 = F.when(across & close(e["b"], s["y0"]), s["y0"]).otherwise(b0)
        t1 = F.when(across & close(e["t"], s["y0"]), s["y0"]).otherwise(t0)
        level = ~rectangle & (F.abs(b1 - s["y0"]) <= 12)
        return F.struct(
            F.when(level & close(e["l"], s["x0"]), s["x0"]).otherwise(l0).alias("l"), t1.alias("t"),
            F.when(level & close(e["r"], s["x1"]), s["x1"]).otherwise(r0).alias("r"), b1.alias("b"))

    start = F.struct(F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b"))
    none = F.array().cast("array<struct<step:int,ord:bigint,x0:double,y0:double,x1:double,y1:double>>")
    joined = joined.withColumn("_e", F.aggregate(F.coalesce("edges", none), start, step))
    e = F.col("_e")
    new = {"x": e["l"], "y": e["t"], "w": F.greatest(F.lit(10.0), e["r"] - e["l"]), "h": F.greatest(F.lit(10.0), e["b"] - e["t"])}
    return joined.select(*[round_to(new[c], 1).alias(c) if c in new else F.col(c) for c in field.columns])


def cell_interior(cell: DataFrame, prompt: DataFrame, by: Sequence[str] = PAGE, pad: float = 2.0) -> DataFrame:
    """Writable rest of each cell after its prompt (the first word in it, if any) is taken out.

    ``prompt`` has ``token_id``, box, ``is_prompt``. Adds ``header_only`` and the interior box.
    """
    A, B = box("a_"), box("b_")
    pairs = near_join(cell.select(*by, "cell_id", "x", "y", "w", "h"),
                      prompt.select(*by, "token_id", "x", "y", "w", "h", "is_prompt"), by).where(share(B, A) > 0.55)
    first = best_partner(pairs.withColumnRenamed("a_cell_id", "cell_id"), [*by, "cell_id"], [F.col("b_token_id")],
                         {"p_x": B.x, "p_y": B.y, "p_w": B.w, "p_h": B.h, "p_prompt": F.col("b_is_prompt")})
    joined = cell.join(first, [*by, "cell_id"], "left")
    c, p = box(), Box(*(F.col("p_" + k) for k in "xywh"))
    none, said = F.col("p_x").isNull(), F.coalesce("p_prompt", F.lit(False))
    rest_w, rest_h = c.right - p.right - pad, c.bottom - p.bottom - pad
    inside = p.y >= c.y - 2
    header = ~none & (
        (inside & ~said & ((c.h < 50) | (rest_h < 30))) | ((rest_h < 18) & (rest_w < 28))
        | (~said & (rest_h < 30)) | ((c.w > 0) & (p.w >= c.w * 0.55) & (rest_h < 18)))
    below = ((c.h >= 50) & (rest_h >= 30))
    beside = ~below & said & (rest_w >= 25)
    lower = ~below & ~beside & (said | ~inside) & (rest_h >= 16)
    whole = none | (~below & ~beside & ~lower & ~inside)
    static = header | ~(whole | below | beside | lower)
    r1 = lambda v: round_to(v, 1)
    under = r1(F.greatest(c.y + pad, p.bottom + 2))
    aside = r1(F.greatest(c.x + pad, p.right + 4))
    return joined.select(
        *cell.columns, static.alias("header_only"),
        F.when(static, c.x).when(beside, aside).otherwise(r1(c.x + pad)).alias("in_x"),
        F.when(static, c.y).when(whole | beside, r1(c.y + pad)).otherwise(under).alias("in_y"),
        F.when(static, c.w).when(beside, F.greatest(F.lit(25.0), r1(c.right - pad - aside)))
        .otherwise(F.greatest(F.lit(20.0), r1(c.w - pad * 2))).alias("in_w"),
        F.when(static, c.h).when(whole | beside, F.greatest(F.lit(16.0), r1(c.h - pad * 2)))
        .otherwise(F.greatest(F.lit(16.0), r1(c.bottom - pad - under))).alias("in_h"))
