"""Counts, reports and invariants over the results of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.numbers import half_up, let, round_to
from folioframe.operators.geometry import is_protected
from folioframe.plans.spatial import PAGE


def reason_counts(decision: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Decisions by outcome, category and reason; long form, so that new reasons need no new columns."""
    return decision.groupBy(*by, "outcome", "category", "reason").agg(F.count(F.lit(1)).alias("decisions"))


def reading_observations(token: DataFrame, page: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Positioned, low-confidence and oversized words per page."""
    sized = token.join(page.select(*by, "page_w"), list(by))
    oversized = (F.col("w") > F.col("page_w") * 0.65) & (F.col("w") > F.col("h") * F.greatest(F.lit(2.0), F.length("text") * 0.85))
    return sized.groupBy(*by).agg(
        F.count(F.lit(1)).alias("words"), F.count_if(F.col("conf") < 45).alias("low_confidence"), F.count_if(oversized).alias("oversized"))


def status_counts(field: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    status = F.col("calibration_status")
    confirmed = (status == "CONFIRMED") | (status.isNull() & (F.col("derivation") == "MANUAL_VERIFIED"))
    return field.groupBy(*by).agg(
        F.count_if(status == "PROPOSED").alias("proposed"), F.count_if(confirmed).alias("confirmed"),
        F.count_if(status == "MODIFIED").alias("modified"), F.count_if(status == "REJECTED").alias("rejected"))


def section_completion(document: DataFrame, section_field: DataFrame, value: DataFrame) -> DataFrame:
    """complete / partial / empty for every section that applies to the model of a document.

    ``document(doc_id, model)``, ``section_field(model, section_id, field_id)``,
    ``value(doc_id, field_id, status)``. The sections of a model come from an equi-join.
    """
    sizes = section_field.groupBy("model", "section_id").agg(F.count("field_id").alias("fields"))
    done = (
        value.where(F.col("status") == "compilato").select("doc_id", "field_id").distinct()
        .join(document, "doc_id").join(section_field, ["model", "field_id"])
        .groupBy("doc_id", "section_id").agg(F.count(F.lit(1)).alias("completed"))
    )
    every = document.join(sizes, "model").join(done, ["doc_id", "section_id"], "left")
    completed = F.coalesce("completed", F.lit(0))
    return every.select("doc_id", "section_id", "fields", completed.alias("completed"),
                        F.when(F.col("fields") == 0, "empty").when(completed == F.col("fields"), "complete")
                        .when(completed > 0, "partial").otherwise("empty").alias("state"))


def calculated_fields(definition: DataFrame, value: DataFrame) -> DataFrame:
    """Sums over source fields (what is not a number counts as 0) per document and definition."""
    source = definition.select("target_id", F.explode("source_field_ids").alias("field_id"))
    number = F.coalesce(F.expr("try_cast(value AS double)"), F.lit(0.0))
    return value.join(source, "field_id").groupBy("doc_id", "target_id").agg(F.sum(number).alias("total"))


def progress_share(value: DataFrame) -> DataFrame:
    """Completed fields over max(total, 12), in percent, at most 100."""
    done = F.count_if(F.col("status") == "compilato")
    total = F.greatest(F.count(F.lit(1)), F.lit(12))
    return value.groupBy("doc_id").agg(done.alias("completed"), total.alias("monitored"),
                                       F.least(F.lit(100), half_up(done / total * 100)).alias("percent"))


def best_variant(reading: DataFrame, doc: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Variant of highest quality per document; the earliest wins ties."""
    best = F.max_by(F.struct("variant", "quality"), F.struct(F.col("quality"), -F.col("variant")))
    return reading.groupBy(*doc).agg(best.alias("_b")).select(*doc, "_b.variant", "_b.quality")


def page_confidence(token: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Mean word confidence; an unread confidence counts as 0, a page without words has none."""
    return token.groupBy(*by).agg(F.avg(F.coalesce("conf", F.lit(0.0))).alias("confidence"))


def page_scores(page: DataFrame) -> DataFrame:
    """Alignment, margin, distortion and overall scores of a page from its measured geometry.

    Input: width, height, skew, perspective, margin_left/right/top/bottom, sampled.
    """
    r2 = lambda v: round_to(v, 2)
    c = F.col
    hd, vd = F.abs(c("margin_left") - c("margin_right")), F.abs(c("margin_top") - c("margin_bottom"))
    zero = F.lit(0.0)
    with_parts = page.withColumns({
        "perspective_score": F.greatest(zero, r2(100 - c("perspective") * 20)),
        "_h": F.greatest(zero, r2(100 - hd / F.greatest(c("width"), F.lit(1.0)) * 150)),
        "_v": F.greatest(zero, r2(100 - vd / F.greatest(c("height"), F.lit(1.0)) * 120)),
        "symmetry": round_to(F.greatest(zero, 100 - hd / F.greatest(c("margin_left") + c("margin_right"), F.lit(1.0)) * 100), 1),
        "margin_score": F.greatest(zero, r2(100 - (
            F.greatest(zero, 15 - F.least("margin_left", "margin_right")) + F.greatest(zero, F.greatest("margin_left", "margin_right") - 85)) * 0.8)),
        "distortion_score": F.greatest(zero, r2(100 - (F.abs(c("skew")) * 6 + c("perspective") * 12))),
        "confidence": r2(F.greatest(F.lit(0.75), 0.75 + F.least(F.lit(1.0), (c("sampled") + 5) / 20) * 0.24)),
    }).withColumn("alignment_score", r2(c("_h") * 0.55 + c("_v") * 0.45))
    overall = (F.greatest(zero, 100 - F.abs(c("skew")) * 10) * 0.3 + c("perspective_score") * 0.2 + c("alignment_score") * 0.2
               + c("margin_score") * 0.15 + c("distortion_score") * 0.15)
    return with_parts.withColumn("geometry_score", r2(overall)).drop("_h", "_v")


def geometry_rollup(page: DataFrame, doc: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Document means of skew, score and confidence from :func:`page_scores`."""
    return page_scores(page).groupBy(*doc).agg(
        F.count(F.lit(1)).alias("pages"), round_to(F.avg("skew"), 2).alias("skew"),
        round_to(F.avg("geometry_score"), 2).alias("geometry_score"), round_to(F.avg("confidence"), 2).alias("confidence"))


def baseline_delta(measured: DataFrame, baseline: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Measured against baseline counts per page; a missing measurement stays null, never zero."""
    joined = baseline.join(measured, list(by), "left")
    return joined.select(*by, "baseline_fields", "measured_fields", (F.col("measured_fields") - F.col("baseline_fields")).alias("delta"),
                         F.col("measured_fields").isNull().alias("missing"))


def run_invariants(before: DataFrame, after: DataFrame, page: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Per page: protected fields retained and unchanged, nothing lost, bounds valid after a run.

    ``before``/``after`` share ``field_id``, box and ``label``; ``before`` has the protection columns.
    """
    keys = [*by, "field_id"]
    b = before.select(*keys, is_protected().alias("protected"), F.struct("x", "y", "w", "h", "label").alias("was"))
    a = after.join(page.select(*by, "page_w", "page_h"), list(by), "left").select(
        *keys, F.struct("x", "y", "w", "h", "label").alias("now"),
        ((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= F.col("page_w") + 2)
         & (F.col("y") + F.col("h") <= F.col("page_h") + 2)).alias("inside"))
    both = b.join(a, keys, "full_outer")
    guarded = F.coalesce("protected", F.lit(False))
    return both.groupBy(*by).agg(
        F.bool_and(~guarded | F.col("now").isNotNull()).alias("retained"),
        F.bool_and(~guarded | (F.col("was").eqNullSafe(F.col("now")))).alias("preserved"),
        F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"),
        F.bool_and(F.coalesce("inside", F.lit(True))).alias("valid_bounds"))


def same_result(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two runs that differ, with the run they come from: empty when a step is idempotent."""
    return first.exceptAll(second).withColumn("run", F.lit(1)).unionByName(second.exceptAll(first).withColumn("run", F.lit(2)))


def stage_timings(stage: DataFrame, doc: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """Time per stage in columns, with the total and the share of the slowest stage."""
    wide = stage.groupBy(*doc).pivot("stage", list(stages)).agg(F.sum("ms"))
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages[1:]), F.coalesce(F.col(stages[0]), F.lit(0.0)))
    slowest = F.greatest(*[F.coalesce(F.col(s), F.lit(0.0)) for s in stages])
    return wide.withColumn("total", total).withColumn("slowest_share", slowest / F.col("total"))


def discard_trace(stages: dict[str, DataFrame], by: Sequence[str] = PAGE) -> DataFrame:
    """One row per dropped item: where it was dropped and why. Inputs: ``by``, ``item_id``, ``reason``."""
    trace = None
    for name, dropped in stages.items():
        rows = dropped.select(*by, F.lit(name).alias("stage"), "item_id", "reason")
        trace = rows if trace is None else trace.unionByName(rows)
    return trace


def discard_funnel(trace: DataFrame) -> DataFrame:
    """Dropped items by stage and reason with totals per stage and overall."""
    return trace.rollup("stage", "reason").agg(F.count(F.lit(1)).alias("dropped"))


def classify_page(raw_page: DataFrame) -> DataFrame:
    """native text, image only, or both."""
    kind = (F.when((F.col("native_chars") > 0) & (F.col("raster_count") == 0), "TEXT_NATIVE")
            .when(F.col("native_chars") == 0, "IMAGE_ONLY").otherwise("MIXED_UNRESOLVED"))
    return raw_page.withColumn("page_type", kind)


def page_type_counts(raw_page: DataFrame, doc: Sequence[str] = ("doc_id",)) -> DataFrame:
    of = lambda name: F.count_if(F.col("page_type") == name)
    return classify_page(raw_page).groupBy(*doc).agg(
        F.count(F.lit(1)).alias("pages"), of("TEXT_NATIVE").alias("native"), of("IMAGE_ONLY").alias("image_only"),
        of("MIXED_UNRESOLVED").alias("mixed"))


# Recognised file endings and media types per format, in the order they are tried.
FORMATS = (
    ("PDF", (".pdf",), ("application/pdf",)),
    ("IMAGE_JPEG", (".jpg", ".jpeg"), ("image/jpeg",)),
    ("IMAGE_PNG", (".png",), ("image/png",)),
    ("IMAGE_TIFF", (".tiff", ".tif"), ("image/tiff", "image/tif")),
    ("DOCX", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    ("UNSUPPORTED_LEGACY_DOC", (".doc",), ("application/msword",)),
)


def detect_format(file: DataFrame, name: str = "name", mime: str = "mime") -> DataFrame:
    lower = F.lower(F.col(name))
    kind = None
    for label, endings, types in FORMATS:
        hit = F.coalesce(F.col(mime).isin(*types), F.lit(False))
        for ending in endings:
            hit = hit | lower.endswith(ending)
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
    return file.withColumn("format", kind.otherwise("UNKNOWN"))


def concat_inputs(page: DataFrame, doc: Sequence[str] = ("doc_id",), file_order: str = "file_no", number: str = "page_no") -> DataFrame:
    """Several files form one document: page numbers continue across them.

    Offsets come from one row per file, so no window ever runs over the pages of a document.
    """
    sizes = page.groupBy(*doc, file_order).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*doc).orderBy(file_order).rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*doc, file_order, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return page.join(offset, [*doc, file_order]).withColumn("doc_page_no", F.col(number) + F.col("_offset")).drop("_offset")


def text_quality(document: DataFrame, text: str = "text", conf: str = "conf") -> DataFrame:
    """Confidence (55) + useful lines (25) + words (20) - noise (25), over the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    lines = F.filter(F.split(body, r"\r?\n"), lambda s: F.regexp_count(s, F.lit("[A-Za-zÀ-ÿ0-9]")) >= 4)
    singles = F.size(F.filter(F.split(body, r"\s+"), lambda s: s.rlike("^[A-Za-z0-9]$")))
    confidence = half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(conf))) * 0.55)
    density = F.least(F.lit(25), F.size(lines) * 2)
    structure = F.least(F.lit(20), half_up(F.sqrt(count("[A-Za-zÀ-ÿ]{3,}")) * 2))
    noise = F.least(F.lit(25), F.greatest(F.lit(0), singles - 10) + F.greatest(F.lit(0), count(r"[~|\\{}_^<>]") - 4))
    return document.withColumns({"confidence_score": confidence, "density_score": density, "structure_score": structure, "noise": noise}).withColumn(
        "quality", F.greatest(F.lit(0), F.least(F.lit(100), F.col("confidence_score") + F.col("density_score") + F.col("structure_score") - F.col("noise"))))


# ---------------------------------------------------------------- the 60 steps of the text fit
# Font sizes, tracking and line heights in the order in which they are tried.
FONT_SIZES = (12, 11, 10, 9, 8)
TRACKING = (0.0, -0.5, -1.0, -1.5)
LINE_HEIGHTS = (1.50, 1.35, 1.20)
GLYPH_WIDTH = 0.52


def overflow_audit(value: DataFrame) -> DataFrame:
    """First step of the fixed sequence at which the whole text fits its box, else the policy action.

    ``value``: ``text``, ``w``, ``h``, ``policy``. Text is wrapped once per distinct line capacity.
    """
    grid = [(f, t, lh) for f in FONT_SIZES for t in TRACKING for lh in LINE_HEIGHTS]
    step_type = "array<struct<step:int,font:double,tracking:double,lh:double>>"
    steps = F.from_json(F.lit("[" + ",".join(
        f'{{"step":{i},"font":{f},"tracking":{t},"lh":{lh}}}' for i, (f, t, lh) in enumerate(grid)) + "]"), step_type)
    capacity = lambda s: F.greatest(F.lit(1), F.floor((F.col("w") - 4) / F.greatest(F.lit(2.0), s["font"] * GLYPH_WIDTH + s["tracking"]))).cast("int")
    # word lengths per paragraph; -1 opens a paragraph
    lengths = F.flatten(F.transform(F.split("text", "\n"), lambda p: F.concat(
        F.array(F.lit(-1)), F.transform(F.split(p, " "), lambda w: F.length(w)))))

    def wrapped(lens: Column, limit: Column) -> Column:
        def step(acc: Column, n: Column) -> Column:
            fits = (acc["at"] > 0) & (acc["at"] + 1 + n <= limit)
            first = acc["at"] == 0
            return (F.when(n < 0, F.struct((acc["lines"] + (acc["at"] > 0).cast("int") + (acc["empty"]).cast("int")).alias("lines"), F.lit(0).alias("at"), F.lit(True).alias("empty")))
                    .when(first, F.struct(acc["lines"].alias("lines"), n.alias("at"), (acc["empty"] & (n == 0)).alias("empty")))
                    .when(fits, F.struct(acc["lines"].alias("lines"), (acc["at"] + 1 + n).alias("at"), F.lit(False).alias("empty")))
                    .otherwise(F.struct((acc["lines"] + 1).alias("lines"), n.alias("at"), F.lit(False).alias("empty"))))

        start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("at"), F.lit(False).alias("empty"))
        return F.aggregate(lens, start, step, lambda a: F.greatest(F.lit(1), a["lines"] + (a["at"] > 0).cast("int") + a["empty"].cast("int")))

    usable = (F.col("w") > 0) & (F.col("h") > 0) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    # what does not fit at the tightest step fits at none: most long texts need this one wrap only
    tightest = F.get(steps, len(grid) - 1)
    first_fit = lambda lines: F.get(F.filter(
        steps, lambda s: F.try_element_at(lines, capacity(s)) * (s["font"] * s["lh"]) <= F.col("h") + 1), 0)
    wraps = lambda lens: let(F.array_distinct(F.transform(steps, capacity)), lambda caps: let(
        F.map_from_arrays(caps, F.transform(caps, lambda cap: wrapped(lens, cap))), first_fit))
    possible = lambda lens: wrapped(lens, capacity(tightest)) * (tightest["font"] * tightest["lh"]) <= F.col("h") + 1
    search = lambda lens: F.when(possible(lens), wraps(lens))
    laid = value.withColumn("_usable", usable).withColumn("_fit", F.when(usable, let(lengths, search)))
    over = F.col("_usable") & F.col("_fit").isNull()
    pick = lambda name, idle, last: F.when(~F.col("_usable"), idle).when(over, last).otherwise(F.col("_fit")[name])
    return laid.select(
        *value.columns, pick("font", 10.0, 8.0).alias("font_size"), pick("tracking", 0.0, -1.5).alias("tracking"),
        pick("lh", 1.35, 1.2).alias("line_height"), over.alias("overflows"),
        F.when(~over, "NONE").when(F.col("policy") == "CONTINUABLE", "CONTINUATION_BLOCK")
        .when(F.col("policy") == "EXPANDABLE_OR_TABULAR", "TABULAR_EXPANSION").otherwise("TEACHER_SYNTHESIS_REQUIRED").alias("action"))


def overflow_shares(audited: DataFrame, template_field: Sequence[str]) -> DataFrame:
    """Share of values that overflow, per template field."""
    return audited.groupBy(*template_field).agg(
        F.count(F.lit(1)).alias("values"), F.count_if("overflows").alias("overflowing"),
        round_to(F.avg(F.col("overflows").cast("double")), 4).alias("overflow_share"))
