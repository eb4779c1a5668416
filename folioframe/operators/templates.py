"""Templates: structural fingerprints, matching, difference, clustering, decisions and upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.numbers import half_up, let, round_to
from folioframe.plans.candidates import Classed, PageRange, Range, best_of, class_pairs, classed, mean_bound, meet, page_ratio
from folioframe.plans.spatial import PAGE
from folioframe.session import cut_lineage


# ---------------------------------------------------------------- fingerprints
def legacy_hash(text: Column) -> Column:
    """The older 16-digit hash (two 32-bit lanes, the second fed with the high byte): compatibility only."""
    prime, mask = F.lit(16777619), F.lit(0xFFFFFFFF)
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("bigint")
        mix = lambda lane, value: (lane.bitwiseXOR(value) * prime).bitwiseAND(mask)
        return F.struct(mix(acc["a"], code).alias("a"), mix(acc["b"], F.shiftright(code, 8)).alias("b"))

    start = F.struct(F.lit(0x811C9DC5).cast("bigint").alias("a"), F.lit(0xCBF29CE4).cast("bigint").alias("b"))
    hexed = lambda lane: F.lower(F.lpad(F.hex(lane), 8, "0"))
    return F.aggregate(chars, start, step, lambda acc: F.concat(hexed(acc["a"]), hexed(acc["b"])))


def fingerprint(primitive: DataFrame, page: DataFrame, by: Sequence[str] = PAGE, tile: int = 128) -> DataFrame:
    """Geometry and structure hash per page; the text of a page is never used.

    ``primitive``: ``kind`` (R, CB, L, M, C), x, y, w, h. Equal primitives are counted first, the sorted
    tokens are hashed per tile and the tile hashes per page, so no row ever gathers a whole crowded page.
    ``page``: page_width, page_height, rotation, raster_count, text_count, fonts.
    """
    number = lambda c: half_up(F.col(c)).cast("bigint").cast("string")
    token = F.when(F.col("kind").isin("R", "CB"), F.concat_ws(":", "kind", number("x"), number("y"), number("w"), number("h"))).otherwise(
        F.concat_ws(":", "kind", number("x"), number("y")))
    size = page.select(*by, "page_width", "page_height")
    quad = lambda right, low: F.count_if(((F.col("x") >= F.col("page_width") / 2) == right) & ((F.col("y") >= F.col("page_height") / 2) == low))
    counts = primitive.join(size, list(by)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("vector_count"), quad(False, False).alias("q1"), quad(True, False).alias("q2"), quad(False, True).alias("q3"), quad(True, True).alias("q4"))
    tiles = primitive.select(*by, token.alias("t"), F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).groupBy(
        *by, "tx", "ty", "t").agg(F.count(F.lit(1)).alias("n")).groupBy(*by, "tx", "ty").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("*", "t", F.col("n").cast("string")))), ";").alias("tokens"))
    part = F.concat_ws(":", F.col("tx").cast("string"), F.col("ty").cast("string"), F.sha2("tokens", 256))
    geometry = tiles.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ";"), 256).alias("_g"))
    joined = page.join(counts, list(by), "left").join(geometry, list(by), "left").na.fill(0, ["vector_count", "q1", "q2", "q3", "q4"])
    dim = F.concat(half_up(F.col("page_width")).cast("string"), F.lit("x"), half_up(F.col("page_height")).cast("string"))
    blank = F.when(F.col("raster_count") > 0, F.concat(F.lit("RASTER_SURFACE:"), dim, F.lit(":COUNT="), F.col("raster_count").cast("string"))).otherwise(F.concat(F.lit("EMPTY_PAGE:"), dim))
    text = lambda c: F.col(c).cast("string")
    structure = F.concat_ws("|", dim, text("rotation"), text("vector_count"), text("raster_count"), F.concat_ws(",", *[text(f"q{i}") for i in range(1, 5)]),
                            F.array_join(F.array_sort(F.array_distinct("fonts")), ","))
    sure = (F.when((F.col("vector_count") == 0) & (F.col("raster_count") == 0) & (F.col("text_count") == 0), 0.5)
            .when((F.col("vector_count") > 0) & (F.size("fonts") > 0), 1.0).when((F.col("vector_count") > 0) | (F.col("raster_count") > 0), 0.95).otherwise(1.0))
    return joined.withColumns({"geometry_hash": F.coalesce("_g", F.sha2(blank, 256)), "structure_hash": F.sha2(structure, 256), "confidence": sure}).drop("_g", "q1", "q2", "q3", "q4")


def profiles(page_fp: DataFrame, doc: str, order: str, page_limit: int | None = None, chunk: int = 256) -> DataFrame:
    """One row per document: page count, chained hashes, box total and the pages a match may look at.

    Hashes chain per ``chunk`` pages and then over the chunks; with ``page_limit`` (the longest template)
    only pages that can take part in a comparison are gathered.
    """
    sizes = page_fp.groupBy(doc, F.floor((F.col(order)) / chunk).alias("_c")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "geometry_hash", "structure_hash"))).alias("_h"),
        F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_s"), F.sum(_box_count(F.col("vector_count"), F.col("text_count"))).alias("_b"))
    chain = lambda f: F.sha2(F.array_join(F.transform("_h", lambda e: e[f]), ";"), 256)
    parts = sizes.select(doc, "_c", "_n", "_s", "_b", chain("geometry_hash").alias("g"), chain("structure_hash").alias("s"))
    head = parts.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_c", "g", "s"))).alias("_p"), F.sum("_n").alias("page_count"),
                                  (F.sum("_s") / F.sum("_n")).alias("confidence"), F.sum("_b").alias("boxes"))
    head = head.select(doc, "page_count", "confidence", "boxes", *[
        F.sha2(F.array_join(F.transform("_p", lambda e: e[k]), ";"), 256).alias(n) for k, n in (("g", "geometry_hash"), ("s", "structure_hash"))])
    shown = page_fp if page_limit is None else page_fp.where(F.col(order) < page_limit)
    page = F.struct("geometry_hash", "structure_hash", F.col("page_width").alias("w"), F.col("page_height").alias("h"), F.col("rotation").alias("rot"),
                    F.col("vector_count").alias("vec"), F.col("raster_count").alias("ras"), F.col("text_count").alias("txt"), F.col("fonts").alias("fonts"))
    pages = shown.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), page.alias("p")))).alias("_p"))
    return head.join(pages.select(doc, F.transform("_p", lambda e: e["p"]).alias("pages")), doc).withColumn(
        "fingerprint", F.sha2(F.concat_ws("|", "geometry_hash", "structure_hash", F.col("page_count").cast("string")), 256))


# ---------------------------------------------------------------- matching
def _likeness(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1)))


def _page_geometry(p: Column, q: Column) -> Column:
    apart = F.abs(p["w"] - q["w"]) + F.abs(p["h"] - q["h"])
    score = (F.greatest(F.lit(0.0), 1 - apart / 100) * 0.35 + _likeness(p["vec"], q["vec"]) * 0.4
             + F.when(p["rot"] == q["rot"], 1.0).otherwise(0.5) * 0.15 + F.greatest(F.lit(0.0), 1 - apart / 200) * 0.1) * 100
    return F.when(p["geometry_hash"] == q["geometry_hash"], 100.0).otherwise(F.least(F.lit(98.5), round_to(score, 2)))


def _page_structure(p: Column, q: Column) -> Column:
    union = F.size(F.array_union(p["fonts"], q["fonts"]))
    fonts = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(p["fonts"], q["fonts"])) / union)
    score = (_likeness(p["vec"], q["vec"]) * 0.3 + _likeness(p["ras"], q["ras"]) * 0.2 + _likeness(p["txt"], q["txt"]) * 0.2 + fonts * 0.3) * 100
    return F.when(p["structure_hash"] == q["structure_hash"], 100.0).otherwise(F.least(F.lit(98.5), round_to(score, 2)))


def _cents(score: Column) -> Column:
    """Page scores have two digits: summed as integers, the result does not depend on the order."""
    return half_up(score * 100)


def match_band(score: Column) -> Column:
    return F.when(score >= 99, "IDENTICAL").when(score >= 95, "COMPATIBLE").when(score >= 85, "DERIVED").otherwise("DIFFERENT")


# Rounding of page scores and of the total lifts a score above its bound by less than this.
_ROUNDED = 0.02


def _score_bound() -> Column:
    """Upper bound of :func:`match_score` for a pair of profile classes."""
    def page(a: PageRange, b: PageRange) -> Column:
        apart, v = a.w.apart(b.w) + a.h.apart(b.h), a.vec.likeness(b.vec)
        turned = F.when(a.rot.meets(b.rot), 1.0).otherwise(0.5)
        geometry = (F.greatest(F.lit(0.0), 1 - apart / 100) * 0.35 + v * 0.4 + turned * 0.15 + F.greatest(F.lit(0.0), 1 - apart / 200) * 0.1) * 100
        structure = (v * 0.3 + a.ras.likeness(b.ras) * 0.2 + a.txt.likeness(b.txt) * 0.2 + 0.3) * 100
        # equal hashes score 100, and only pages of equal size and counts have them
        equal_g = a.vec.meets(b.vec) & a.w.meets(b.w) & a.h.meets(b.h) & a.rot.meets(b.rot)
        equal_s = a.vec.meets(b.vec) & a.ras.meets(b.ras)
        return (F.when(equal_g, 100.0).otherwise(F.least(F.lit(98.5), geometry)) + F.when(equal_s, 100.0).otherwise(F.least(F.lit(98.5), structure))) / 2

    return F.least(F.lit(100.0), mean_bound(page) + _ROUNDED)


def _classes(shape: DataFrame, template: DataFrame) -> Classed:
    """Classes of document shapes (by fingerprint) and of templates, whose columns come back with ``t_``."""
    sides = classed(shape, template, "fingerprint", "template_id")
    renamed = sides.right.select(*[F.col(c).alias("t_" + c) for c in template.columns], "_class")
    return sides._replace(right=renamed)


def _scored(pairs: DataFrame, more: Sequence[str]) -> DataFrame:
    """Scores of document shapes and templates that stand in one row."""
    most, least = F.greatest("page_count", "t_page_count"), F.least("page_count", "t_page_count")
    both = F.transform(F.sequence(F.lit(0), F.least(F.size("pages"), F.size("t_pages")) - 1), lambda i: let(F.get("pages", i), lambda p: let(
        F.get("t_pages", i), lambda q: F.struct(_page_geometry(p, q).alias("g"), _page_structure(p, q).alias("s")))))
    sums = F.aggregate(both, F.struct(_cents(F.lit(0.0)).alias("g"), _cents(F.lit(0.0)).alias("s"), F.lit(0).alias("n")), lambda acc, e: F.struct(
        (acc["g"] + _cents(e["g"])).alias("g"), (acc["s"] + _cents(e["s"])).alias("s"), (acc["n"] + ((e["g"] + e["s"]) / 2 >= 95).cast("int")).alias("n")))
    same = F.col("fingerprint") == F.col("t_fingerprint")
    scored = pairs.withColumn("_s", F.when(~same, sums)).withColumns({
        "geometry_score": F.when(same, 100.0).otherwise(round_to(F.col("_s.g") / 100 / most, 2)),
        "structure_score": F.when(same, 100.0).otherwise(round_to(F.col("_s.s") / 100 / most, 2))})
    scored = scored.withColumn("score", F.when(same, 100.0).otherwise(round_to(F.col("geometry_score") * 0.5 + F.col("structure_score") * 0.5, 2)))
    return scored.select(
        "fingerprint", F.col("t_template_id").alias("template_id"), "score", "geometry_score", "structure_score",
        F.when(same, F.col("page_count")).otherwise(F.col("_s.n")).cast("bigint").alias("matched_pages"), most.alias("total_pages"),
        F.when(same, 1.0).otherwise(round_to(F.least("confidence", "t_confidence") * (least / most), 2)).alias("match_confidence"),
        match_band(F.col("score")).alias("band"), *[F.col("t_" + c).alias(c) for c in more])


def _shapes(document: DataFrame) -> DataFrame:
    """Documents with one and the same profile are scored once."""
    return document.dropDuplicates(["fingerprint"]).select("fingerprint", "page_count", "confidence", "pages")


_MORE = ("ord", "status", "school_order", "validity_year")


def match_score(document: DataFrame, template: DataFrame, doc: str = "doc_id", ratio: float = 0.85, least: float = 0.0) -> DataFrame:
    """Similarity of documents and templates.

    Gives every pair that scores ``least`` or more and whose page counts (smaller over larger) allow ``ratio``. A score can't exceed 100 times the ratio of
    the page counts, so with ``ratio=0`` and ``least=85`` no pair of 85 or more is missing; 0 and 0 give all pairs. Pairs meet by classes
    of profiles whose upper bound reaches ``least``: their number grows with what can score that high.
    """
    sides = _classes(_shapes(document), template)
    pairs = class_pairs(sides, F.when(page_ratio() >= ratio, _score_bound()), least)
    met = meet(sides.left, sides.right, pairs, "fingerprint").drop("bound")
    met = met.where(F.least("page_count", "t_page_count") >= F.greatest("page_count", "t_page_count") * F.lit(ratio))
    scored = _scored(met, [c for c in _MORE if c in template.columns]).where(F.col("score") >= least)
    return document.select(doc, "fingerprint").join(scored, "fingerprint").drop("fingerprint")


def best_template(document: DataFrame, registry: DataFrame, doc: str = "doc_id", *, statuses: Sequence[str] = ("active",),
                  preferred_year: int | None = None, school_order: str | None = None) -> DataFrame:
    """Best template per document (earliest registration wins ties), exact without comparing everything.

    Identical fingerprints are settled by an equi-join, and precede what only rounds to the same score. The others
    meet classes of templates in the order of their bounds (:func:`best_of`).
    """
    usable = registry.where(F.col("status").isin(*statuses))
    if school_order is not None:
        usable = usable.where(F.lower("school_order") == school_order.lower())
    extra = F.lit(0.0)
    if preferred_year is not None:
        year, wanted = F.col("validity_year").cast("string"), F.lit(str(preferred_year))
        extra = F.coalesce(F.when(year.contains(wanted) | wanted.contains(year), 5.0), F.lit(0.0))
    bonus = 0.0 if preferred_year is None else 5.0
    payload = ["template_id", "score", "geometry_score", "structure_score", "matched_pages", "total_pages", "match_confidence", "band", "ranking"]
    # no other template can rank higher than an identical one that has the whole bonus
    first = usable.where(extra == bonus).groupBy("fingerprint").agg(F.min_by("template_id", "ord").alias("template_id"))
    full = F.lit(100.0)
    done = cut_lineage(document.select(doc, "fingerprint", "page_count").join(first, "fingerprint").select(
        doc, "fingerprint", "template_id", full.alias("score"), full.alias("geometry_score"), full.alias("structure_score"), F.col("page_count").cast("bigint").alias("matched_pages"),
        F.col("page_count").alias("total_pages"), F.lit(1.0).alias("match_confidence"), match_band(full).alias("band"), (full + bonus).alias("ranking")))
    shape = cut_lineage(_shapes(document).join(done.select("fingerprint").distinct(), "fingerprint", "left_anti"), plain=True)
    sides = _classes(shape, usable.select("template_id", "ord", "page_count", "confidence", "pages", "fingerprint", extra.alias("extra")))
    score = lambda pairs: _scored(pairs, ["ord", "extra"]).withColumn("ranking", F.col("score") + F.col("extra")).drop("extra")
    found = best_of(sides, class_pairs(sides, _score_bound(), 0.0), "fingerprint", score, bonus=bonus)
    top = found.groupBy("fingerprint").agg(F.min(F.struct((-F.col("ranking")).alias("_r"), F.col("ord").alias("_o"), *payload)).alias("_b")).select(
        "fingerprint", *[F.col(f"_b.{c}").alias(c) for c in payload])
    return done.drop("fingerprint").unionByName(document.select(doc, "fingerprint").join(top, "fingerprint").drop("fingerprint"))


def top_templates(document: DataFrame, registry: DataFrame, k: int = 3, doc: str = "doc_id") -> DataFrame:
    """The k best templates of every document by similarity.

    Templates with one and the same fingerprint score alike, so only the k earliest of each are compared, and a
    document sees no more than k of them: copies in the registry add no pairs. Classes of templates are met in the order of their bounds.
    """
    copies = Window.partitionBy("fingerprint").orderBy("ord")
    early = cut_lineage(registry.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy"), plain=True)
    sides = _classes(cut_lineage(_shapes(document), plain=True), early)
    more = [c for c in _MORE if c in early.columns]
    found = best_of(sides, class_pairs(sides, _score_bound(), 0.0), "fingerprint", lambda pairs: _scored(pairs, more).withColumn("ranking", F.col("score")), k)
    order = Window.partitionBy("fingerprint").orderBy(F.desc("score"), "ord")
    top = found.drop("ranking").withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return document.select(doc, "fingerprint").join(top, "fingerprint").drop("fingerprint")


# ---------------------------------------------------------------- structural difference
def _sections(vec: Column, txt: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(1), F.floor((vec + txt) / 5))).cast("int")


def _box_count(vec: Column, txt: Column) -> Column:
    return _sections(vec, txt).cast("bigint") + 1


def _boxes(p: Column) -> Column:
    """Page frame and evenly stacked sections derived from the object counts of a page profile."""
    n = _sections(p["vec"], p["txt"])
    step = (p["h"] - 100) / n
    frame = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), p["w"].cast("double").alias("x1"), p["h"].cast("double").alias("y1"))
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.lit(50.0).alias("x0"), (50 + i * step).alias("y0"), (p["w"] - 50).cast("double").alias("x1"), (50 + i * step + step - 10).alias("y1")))
    return F.concat(F.array(frame), rows)


def _match_boxes(source: Column, cand: Column) -> Column:
    """(equal, shifted) counts of a one-to-one matching: first free candidate, equal boxes first."""
    def equal(a, b):
        return (F.abs(a["x0"] - b["x0"]) <= 1) & (F.abs(a["y0"] - b["y0"]) <= 1) & (F.abs(a["x1"] - b["x1"]) <= 1) & (F.abs(a["y1"] - b["y1"]) <= 1)

    def moved(a, b):
        dx, dy = b["x0"] - a["x0"], b["y0"] - a["y0"]
        return (F.sqrt(dx * dx + dy * dy) <= 15) & (F.abs((b["x1"] - b["x0"]) - (a["x1"] - a["x0"])) <= 20) & (F.abs((b["y1"] - b["y0"]) - (a["y1"] - a["y0"])) <= 20)

    def round_of(test):
        def step(acc, s):
            free = F.transform(cand, lambda c, i: test(s, c) & ~F.array_contains(acc["c"], i))
            return let(F.array_position(free, True).cast("int"), lambda at: F.when((at == 0) | F.array_contains(acc["s"], s["i"]), acc).otherwise(
                F.struct(F.concat(acc["s"], F.array(s["i"])).alias("s"), F.concat(acc["c"], F.array(at - 1)).alias("c"))))
        return step

    numbered = F.transform(source, lambda b, i: F.struct(i.alias("i"), *[b[k].alias(k) for k in ("x0", "y0", "x1", "y1")]))
    none = F.array().cast("array<int>")
    first = F.aggregate(numbered, F.struct(none.alias("s"), none.alias("c")), round_of(equal))
    return let(first, lambda e: F.struct(F.size(e["s"]).alias("equal"), F.aggregate(
        numbered, e, round_of(moved), lambda acc: F.size(acc["s"]) - F.size(e["s"])).alias("shifted")))


def _page_difference(p: Column, q: Column) -> Column:
    """added, removed, shifted and similarity of one page pair (source p, candidate q)."""
    same = (p["geometry_hash"] == q["geometry_hash"]) & (p["structure_hash"] == q["structure_hash"])
    np_, nq = _box_count(p["vec"], p["txt"]), _box_count(q["vec"], q["txt"])

    def judge(m: Column) -> Column:
        hit = m["equal"] + m["shifted"]
        added, removed = nq - hit, np_ - hit
        boxes = F.greatest(F.lit(0.0), 1 - (added + removed + m["shifted"] * 0.5) / F.greatest(np_, nq, F.lit(1)))
        dims = F.greatest(F.lit(0.0), 1 - (F.abs(q["w"] - p["w"]) + F.abs(q["h"] - p["h"])) / 200)
        score = dims * 0.2 + _likeness(p["vec"], q["vec"]) * 0.25 + _likeness(p["txt"], q["txt"]) * 0.25 + boxes * 0.3
        return F.struct(added.cast("bigint").alias("added"), removed.cast("bigint").alias("removed"), m["shifted"].cast("bigint").alias("shifted"),
                        F.least(F.lit(100.0), half_up(score * 10000) / 100).alias("sim"))

    zero = F.lit(0).cast("bigint")
    return F.when(same, F.struct(zero.alias("added"), zero.alias("removed"), zero.alias("shifted"), F.lit(100.0).alias("sim"))).otherwise(
        let(_match_boxes(_boxes(p), _boxes(q)), judge))


def similarity_class(score: Column, differs: Column) -> Column:
    return F.when((score >= 99.5) & ~differs, "EXACT").when(score >= 80, "SIMILAR").when(score >= 50, "DERIVED").otherwise("UNKNOWN")


def structural_diff(pairs: DataFrame) -> DataFrame:
    """Difference of source and candidate profiles standing in one row (``s_`` and ``c_`` columns).

    Adds added / removed / shifted boxes, similarity, class, layout shift and preservation scores.
    """
    c = F.col
    both = F.transform(F.sequence(F.lit(0), F.least(F.size("s_pages"), F.size("c_pages")) - 1), lambda i: let(F.get("s_pages", i), lambda p: let(
        F.get("c_pages", i), lambda q: F.struct(_page_difference(p, q).alias("d"), _box_count(p["vec"], p["txt"]).alias("np"), _box_count(q["vec"], q["txt"]).alias("nq")))))
    long = lambda: F.lit(0).cast("bigint")
    total = F.aggregate(both, F.struct(long().alias("added"), long().alias("removed"), long().alias("shifted"), long().alias("sim"), long().alias("np"), long().alias("nq")), lambda acc, e: F.struct(
        *[(acc[k] + e["d"][k]).alias(k) for k in ("added", "removed", "shifted")], (acc["sim"] + _cents(e["d"]["sim"])).alias("sim"), (acc["np"] + e["np"]).alias("np"), (acc["nq"] + e["nq"]).alias("nq")))
    d = pairs.withColumn("_d", total)
    # pages that only one side has count with all their boxes and no similarity
    d = d.withColumns({"added": c("_d.added") + c("c_boxes") - c("_d.nq"), "removed": c("_d.removed") + c("s_boxes") - c("_d.np"), "shifted": c("_d.shifted"),
                       "page_count_delta": c("c_page_count") - c("s_page_count")})
    uneven = c("page_count_delta") != 0
    penalty = F.when(uneven, F.least(F.lit(40.0), F.abs("page_count_delta") / F.greatest(c("s_page_count"), F.lit(1)) * 40)).otherwise(0.0)
    differs = (c("added") > 0) | (c("removed") > 0) | (c("shifted") > 0) | uneven
    exact = (c("s_fingerprint") == c("c_fingerprint"))
    raw = F.greatest(F.lit(0.0), c("_d.sim") / 100 / F.greatest("s_page_count", "c_page_count") - penalty)
    d = d.withColumns({"_differs": differs, "_penalty": penalty,
                       "similarity": round_to(F.when(exact & ~differs, 100.0).when(differs, F.least(F.lit(98.0), raw)).otherwise(raw), 2)})
    shift = F.least(F.lit(100.0), round_to(c("added") * 3 + c("removed") * 3 + c("shifted") * 1.5 + c("_penalty"), 1))
    return d.withColumns({"class": similarity_class(c("similarity"), c("_differs")), "layout_shift": shift,
                          "preservation": F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_to(100 - shift, 1)))}).drop("_d", "_differs", "_penalty")


def paired(source: DataFrame, candidate: DataFrame, pair: DataFrame, source_id: str, candidate_id: str) -> DataFrame:
    """Profiles of listed pairs side by side for :func:`structural_diff`."""
    side = lambda df, key, p: df.select(F.col(key).alias(p + "id"), *[F.col(k).alias(p + k) for k in ("page_count", "boxes", "fingerprint", "pages")])
    return pair.select(F.col(source_id).alias("s_id"), F.col(candidate_id).alias("c_id")).join(side(source, source_id, "s_"), "s_id").join(
        side(candidate, candidate_id, "c_"), "c_id")


def evolution_report(diff: DataFrame) -> DataFrame:
    """Class to action, with the notes that apply."""
    note = lambda flag, *parts: F.when(flag, F.concat(*parts))
    n = lambda name: F.col(name).cast("string")
    notes = F.array_compact(F.array(
        F.col("class"), note(F.col("added") > 0, F.lit("added="), n("added")), note(F.col("removed") > 0, F.lit("removed="), n("removed")),
        note(F.col("shifted") > 0, F.lit("shifted="), n("shifted")), note(F.col("page_count_delta") != 0, F.lit("pages="), n("page_count_delta"))))
    action = F.when(F.col("class") == "EXACT", "BIND_EXISTING").when(F.col("class").isin("SIMILAR", "DERIVED"), "CREATE_VARIANT_IN_CLUSTER").otherwise("CREATE_NEW_CLUSTER")
    return diff.withColumns({"action": action, "is_variant": F.col("class").isin("SIMILAR", "DERIVED"), "notes": notes})


# ---------------------------------------------------------------- clustering
def roots(parent: DataFrame, node: str = "node", up: str = "parent") -> DataFrame:
    """Root of every node of a forest by pointer jumping; each round is checkpointed."""
    state = cut_lineage(parent.select(F.col(node).alias("node"), F.coalesce(F.col(up), F.col(node)).alias("root")))
    while True:
        jump = state.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = state.join(jump, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved"))
        moved = cut_lineage(moved)
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return state.withColumnRenamed("node", node)


def _similarity_bound() -> Column:
    """Upper bound of the similarity of :func:`structural_diff` for a pair of profile classes (a: candidate, b: source)."""
    def page(a: PageRange, b: PageRange) -> Column:
        apart, v = a.w.apart(b.w) + a.h.apart(b.h), a.vec.likeness(b.vec)
        boxes = lambda r: Range(_box_count(r.vec.low, r.txt.low), _box_count(r.vec.high, r.txt.high))
        score = (F.greatest(F.lit(0.0), 1 - apart / 200) * 0.2 + v * 0.25 + a.txt.likeness(b.txt) * 0.25 + boxes(a).likeness(boxes(b)) * 0.3) * 100
        return F.when(a.vec.meets(b.vec) & a.w.meets(b.w) & a.h.meets(b.h), 100.0).otherwise(score)

    apart = Range(F.col("a_pages_low"), F.col("a_pages_high")).apart(Range(F.col("b_pages_low"), F.col("b_pages_high")))
    return F.greatest(F.lit(0.0), mean_bound(page) - F.least(F.lit(40.0), apart / F.greatest(F.col("b_pages_high"), F.lit(1)) * 40) + _ROUNDED)


def candidate_diffs(template: DataFrame, least: float = 50.0) -> DataFrame:
    """:func:`structural_diff` of every template and every earlier one with a similarity of ``least`` or more.

    ``template``: template_id, ord and the profile columns. Columns of the later template begin with ``c_``, of the earlier with ``s_``.
    """
    sides = _earlier_classes(template)
    met = meet(sides.left, sides.right, class_pairs(sides, _similarity_bound(), least), "template_id").drop("bound")
    return _diffs(met).where(F.col("similarity") >= least)


_PROFILE = ["template_id", "ord", "page_count", "boxes", "fingerprint", "pages"]


def _earlier_classes(template: DataFrame) -> Classed:
    rows = template.select(*_PROFILE)
    sides = classed(rows, rows, "template_id", "template_id")
    return sides._replace(right=sides.right.select(*[F.col(c).alias("s_" + c) for c in _PROFILE], "_class"))


def _diffs(pairs: DataFrame) -> DataFrame:
    pairs = pairs.where(F.col("s_ord") < F.col("ord")).select(*[F.col(c).alias("c_" + c) for c in _PROFILE], *["s_" + c for c in _PROFILE])
    return structural_diff(pairs)


def _best_earlier(left: DataFrame, right: DataFrame) -> DataFrame:
    """The most similar earlier row of ``right`` for every template of ``left``, if that has 50 or more: ``first_id``, ``parent``, ``parent_ord``, ``similarity``."""
    sides = classed(left.select(*_PROFILE), right.select(*_PROFILE), "template_id", "template_id")
    sides = sides._replace(right=sides.right.select(*[F.col(c).alias("s_" + c) for c in _PROFILE], "_class"))
    score = lambda pairs: _diffs(pairs).select(F.col("c_template_id").alias("template_id"), F.col("similarity").alias("ranking"), "c_template_id", "s_template_id", "s_ord", "similarity", "class")
    found = best_of(sides, class_pairs(sides, _similarity_bound(), 50.0), "template_id", score)
    best = found.groupBy("c_template_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("s_ord").alias("o"), F.col("s_template_id").alias("parent"), F.col("class").alias("class"))).alias("_b"))
    return best.where(F.col("_b.class") != "UNKNOWN").select(
        F.col("c_template_id").alias("first_id"), F.col("_b.parent").alias("parent"), F.col("_b.o").alias("parent_ord"), (-F.col("_b.s")).alias("similarity"))


def _earliest(template: DataFrame) -> DataFrame:
    return template.groupBy("fingerprint").agg(F.min_by("template_id", "ord").alias("first_id"))


def _links(template: DataFrame, earliest: DataFrame, related: DataFrame) -> DataFrame:
    """Parent of every template: copies follow the earliest of their fingerprint, or what it follows if that is just as similar."""
    placed = template.select("template_id", "fingerprint").join(earliest, "fingerprint").join(related.select("first_id", "parent", "parent_ord", "similarity"), "first_id", "left")
    follows = (F.col("template_id") != F.col("first_id")) & (F.coalesce("similarity", F.lit(0.0)) < 100)
    return placed.select("template_id", "first_id", F.when(follows, F.col("first_id")).otherwise(F.col("parent")).alias("parent"),
                         F.when(follows, 100.0).otherwise(F.col("similarity")).alias("similarity"))


def cluster_templates(template: DataFrame) -> DataFrame:
    """Families: every template joins its most similar earlier one if they are related, else starts its own.

    Related templates have a similarity of 50 or more; classes of templates whose bound is below are not compared. Only the earliest
    template of each fingerprint is compared; its copies follow it, or what it follows if that is just as similar.
    ``template``: template_id, ord and the profile columns. Gives ``template_id``, ``cluster_id`` (the family's first template), ``first_id``, ``parent``, ``similarity``.
    """
    earliest = _earliest(template)
    first = cut_lineage(template.join(earliest.select(F.col("first_id").alias("template_id")), "template_id").select(*_PROFILE), plain=True)
    forest = cut_lineage(_links(template, earliest, _best_earlier(first, first)))
    return roots(forest.select("template_id", "parent"), "template_id", "parent").withColumnRenamed("root", "cluster_id").join(forest, "template_id")


def update_families(family: DataFrame, template: DataFrame, known: DataFrame) -> DataFrame:
    """Families after templates were added or removed, equal to :func:`cluster_templates` of all that ``template`` now holds.

    ``family`` is the result so far for the profiles ``known``. Templates that lost the one they follow, and those that are the earliest of their
    fingerprint for the first time, are compared with all earlier ones; the others only with the added. Only families in which a link changed get new roots.
    """
    earliest = cut_lineage(_earliest(template))
    first = cut_lineage(template.join(earliest.select(F.col("first_id").alias("template_id")), "template_id").select(*_PROFILE), plain=True)
    ids = first.select(F.col("template_id").alias("first_id"))
    stays = ids.withColumnRenamed("first_id", "parent")
    # what a template that is still the earliest of its fingerprint followed, if that still is one as well
    was = family.where(F.col("template_id") == F.col("first_id")).select("first_id", "parent", "similarity").join(ids, "first_id", "left_semi")
    sound = cut_lineage(was.where(F.col("parent").isNull()).unionByName(was.join(stays, "parent", "left_semi").select("first_id", "parent", "similarity")))
    order = first.select(F.col("template_id").alias("parent"), F.col("ord").alias("parent_ord"))
    held = sound.where(F.col("parent").isNotNull()).join(order, "parent").select("first_id", "parent", "parent_ord", "similarity")
    new = cut_lineage(first.join(known.select("template_id"), "template_id", "left_anti").select(*_PROFILE), plain=True)
    # an earlier copy that was compared through another one counts as added, too
    moved = first.join(family.where(F.col("template_id") == F.col("first_id")).select("template_id"), "template_id", "left_anti").join(new.select("template_id"), "template_id", "left_anti").select(*_PROFILE)
    added = cut_lineage(new.unionByName(moved), plain=True)
    judged = first.join(sound.select(F.col("first_id").alias("template_id")), "template_id", "left_semi").select(*_PROFILE)
    open_ = first.join(sound.select(F.col("first_id").alias("template_id")), "template_id", "left_anti").select(*_PROFILE)
    options = held.unionByName(_best_earlier(judged, added)).unionByName(_best_earlier(cut_lineage(open_, plain=True), first))
    best = options.groupBy("first_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("parent_ord").alias("o"), "parent")).alias("_b")).select(
        "first_id", F.col("_b.parent").alias("parent"), F.col("_b.o").alias("parent_ord"), (-F.col("_b.s")).alias("similarity"))
    forest = cut_lineage(_links(template, earliest, best))
    before = family.select("template_id", F.col("parent").alias("_was"), F.col("cluster_id").alias("_family"))
    joined = cut_lineage(forest.join(before, "template_id", "full_outer"))
    changed = F.col("_family").isNull() | F.col("first_id").isNull() | ~F.col("parent").eqNullSafe(F.col("_was"))
    touched = joined.where(changed & F.col("_family").isNotNull()).select("_family").distinct()
    there = joined.where(F.col("first_id").isNotNull())
    loose = there.where(F.col("_family").isNull()).unionByName(there.join(touched, "_family", "left_semi").select(*there.columns))
    rerooted = roots(_within(loose), "template_id", "parent").withColumnRenamed("root", "_top")
    quiet = there.where(F.col("_family").isNotNull()).join(touched, "_family", "left_anti").select("template_id", F.col("_family").alias("cluster_id"))
    quiet = cut_lineage(quiet)
    # a root that follows a template of an untouched family belongs to that family
    above = forest.select(F.col("template_id").alias("_top"), F.col("parent").alias("_up")).join(quiet.select(F.col("template_id").alias("_up"), F.col("cluster_id").alias("_there")), "_up", "left")
    settled = rerooted.join(above, "_top", "left").select("template_id", F.coalesce("_there", "_top").alias("cluster_id"))
    return quiet.unionByName(settled).join(forest, "template_id")


def _within(loose: DataFrame) -> DataFrame:
    """Links of these templates among themselves; a link that leads elsewhere ends here."""
    inside = loose.select(F.col("template_id").alias("parent"), F.lit(True).alias("_in"))
    return loose.select("template_id", "parent").join(inside, "parent", "left").select("template_id", F.when(F.col("_in"), F.col("parent")).alias("parent"))


def family_of(member: DataFrame, template_id: DataFrame) -> DataFrame:
    """Families by one of their templates: the wanted ``template_id`` with ``cluster_id`` (null if it is in none) and all ``members`` of the family, counted."""
    sizes = member.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    return template_id.select("template_id").join(member.select("template_id", "cluster_id"), "template_id", "left").join(sizes, "cluster_id", "left").select("template_id", "cluster_id", "members")


def families_of_order(registry: DataFrame, school_order: str) -> DataFrame:
    """Rows of :func:`cluster_registry` for one school order, upper or lower case."""
    return registry.where(F.lower("school_order") == school_order.lower())


def cluster_registry(member: DataFrame, template: DataFrame) -> DataFrame:
    """Per cluster: base template, its order, number of members."""
    sizes = member.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.max("template_id").alias("latest_template"))
    return sizes.join(template.select(F.col("template_id").alias("cluster_id"), "school_order"), "cluster_id")


# ---------------------------------------------------------------- registry
def validate_template(candidate: DataFrame, registry: DataFrame) -> DataFrame:
    """Issue rows per candidate. Flags: readable, page_count, pages_listed, has_geometry, has_schema, fingerprint."""
    known = registry.groupBy("fingerprint").agg(F.min("template_id").alias("_first"), F.max("template_id").alias("_last"))
    other = (F.col("_first") != F.col("template_id")) | (F.col("_last") != F.col("template_id"))
    good = (F.col("page_count") > 0) & (F.col("page_count") == F.col("pages_listed")) & F.col("fingerprint").isNotNull()
    joined = candidate.join(known, "fingerprint", "left").withColumn("_good", F.coalesce(good, F.lit(False)))
    code = lambda flag, name: F.when(flag, name)
    issues = F.array_compact(F.array(
        code(~F.col("readable"), "MISSING_REQUIRED_FIELDS"), code(~F.col("_good"), "INVALID_FINGERPRINT"), code(~F.col("has_geometry"), "INCOHERENT_GEOMETRY"),
        code(~F.col("has_schema"), "INCOHERENT_SCHEMA"), code(F.col("_good") & F.col("_first").isNotNull() & other, "DUPLICATE_FINGERPRINT")))
    return joined.select("template_id", "fingerprint", issues.alias("issues"), (F.size(issues) == 0).alias("is_valid"))


def register(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of a batch that may enter: new fingerprints only, the first of equal ones (by ``ord``)."""
    fresh = batch.join(registry.select("fingerprint").distinct(), "fingerprint", "left_anti")
    first = fresh.groupBy("fingerprint").agg(F.min(F.struct("ord", "template_id")).alias("_f")).select("fingerprint", "_f.ord", "_f.template_id")
    return fresh.join(first, ["fingerprint", "ord", "template_id"], "left_semi")


def register_valid(batch: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows of a batch, and one row with ``issues`` for each other one.

    ``batch`` has ``ord`` and the flags of :func:`validate_template`. Invalid rows never enter and never stand in the way of a later copy; of equal
    fingerprints of valid rows the first enters, the others are ``DUPLICATE_IN_BATCH``.
    """
    judged = cut_lineage(batch.join(validate_template(batch, registry).select("template_id", "issues", "is_valid"), "template_id"))
    valid = judged.where("is_valid").drop("issues", "is_valid")
    accepted = cut_lineage(register(valid, registry))
    late = valid.join(accepted.select("template_id"), "template_id", "left_anti").select("template_id", F.array(F.lit("DUPLICATE_IN_BATCH")).alias("issues"))
    return accepted, judged.where(~F.col("is_valid")).select("template_id", "issues").unionByName(late)


# Statuses of templates that are out of use.
ARCHIVE = ("deprecated", "archived")


def status_periods(event: DataFrame) -> DataFrame:
    """How long every status of a template held: ``valid_from``, ``valid_to`` (null: still), in the order of event times and ids.

    Built from the whole log, so a late event takes its place in time. Of events at one moment the last by id holds; a repeated status does not begin a new period.
    """
    last = event.groupBy("template_id", "ts").agg(F.max_by("status", "event_id").alias("status"))
    own = Window.partitionBy("template_id").orderBy("ts")
    begins = last.withColumn("_before", F.lag("status").over(own)).where(F.col("_before").isNull() | (F.col("_before") != F.col("status")))
    return begins.select("template_id", "status", F.col("ts").alias("valid_from"), F.lead("ts").over(own).alias("valid_to"))


def status_as_of(event: DataFrame, moment) -> DataFrame:
    """Status of every template at a moment; templates without an event up to then are absent."""
    return registry_status(event.where(F.col("ts") <= F.lit(moment)))


def registry_views(event: DataFrame) -> DataFrame:
    """Current status of every template and the ``view`` it belongs to: active, archive or other."""
    view = F.when(F.col("status") == "active", "active").when(F.col("status").isin(*ARCHIVE), "archive").otherwise("other")
    return registry_status(event).withColumn("view", view)


def status_history(period: DataFrame, moment: DataFrame) -> DataFrame:
    """How many templates had each status at every given ``moment`` (a list of moments with column ``moment``).

    Periods are counted at the first moment they reach and taken off at the first after their end; running sums over the moments do
    the rest, so no period meets every moment.
    """
    moments = [r[0] for r in moment.select("moment").distinct().orderBy("moment").limit(100_001).collect()]
    if len(moments) > 100_000:
        raise ValueError("more than 100,000 moments")
    if not moments:
        return period.select("status", F.lit(None).cast("timestamp").alias("moment"), F.lit(0).cast("bigint").alias("templates")).limit(0)
    spark = period.sparkSession
    listed = spark.createDataFrame(list(enumerate(moments)), f"at int, moment {moment.schema['moment'].dataType.simpleString()}")
    reach = lambda ts: F.size(F.filter(F.lit(moments), lambda m: m < ts))
    change = period.select("status", F.explode(F.array(F.struct(reach(F.col("valid_from")).alias("at"), F.lit(1).alias("n")), F.struct(
        F.when(F.col("valid_to").isNotNull(), reach(F.col("valid_to"))).alias("at"), F.lit(-1).alias("n")))).alias("c")).select("status", "c.at", "c.n").where(F.col("at").isNotNull())
    steps = change.groupBy("status", "at").agg(F.sum("n").alias("n"))
    grid = period.select("status").distinct().join(listed)
    own = Window.partitionBy("status").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = grid.join(steps, ["status", "at"], "left").withColumn("templates", F.sum(F.coalesce("n", F.lit(0))).over(own))
    return counted.select("status", "moment", F.col("templates").cast("bigint").alias("templates"))


def registry_status(event: DataFrame) -> DataFrame:
    """Current status per template from its event log: latest event wins, event id breaks ties."""
    return event.groupBy("template_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("since"), F.count(F.lit(1)).alias("events"))


# Thresholds of the decision policy.
DEFAULT_POLICY = {"bind": 99.0, "normalise": 90.0, "variant": 75.0, "min_confidence": 0.40, "min_geometry": 30.0, "min_pages": 1}


def decide(document: DataFrame, policy: dict[str, float] | None = None) -> DataFrame:
    """Decision per document from page_count, geometry_score, confidence and similarity, with its reason."""
    p = {**DEFAULT_POLICY, **(policy or {})}
    pages, geo = F.coalesce("page_count", F.lit(0)), F.coalesce("geometry_score", F.lit(100.0))
    sure, sim = F.coalesce("confidence", F.lit(0.95)), F.coalesce("similarity", F.lit(0.0))
    few, bent, unsure = pages < p["min_pages"], geo < p["min_geometry"], sure < p["min_confidence"]
    reject = few | bent | unsure
    decision = (F.when(reject, "REJECT").when(sim >= p["bind"], "BIND_CANONICAL").when(sim >= p["normalise"], "NORMALIZE_TO_TEMPLATE")
                .when(sim >= p["variant"], "REGISTER_VARIANT").otherwise("CREATE_NEW_CLUSTER"))
    reason = F.when(few, "TOO_FEW_PAGES").when(bent, "GEOMETRY_BELOW_THRESHOLD").when(unsure, "CONFIDENCE_BELOW_THRESHOLD").otherwise(F.concat_ws("_", F.lit("SIMILARITY"), F.when(
        sim >= p["bind"], "BIND").when(sim >= p["normalise"], "NORMALISE").when(sim >= p["variant"], "VARIANT").otherwise("NEW")))
    return document.withColumns({
        "decision": decision, "decision_reason": reason, "decided_similarity": F.when(reject, 0.0).otherwise(sim),
        "decided_confidence": F.when(few, 0.0).when(bent, 0.1).otherwise(sure)})


# The ordered steps of every decision and the module that takes them.
ACTION_STEPS = (
    ("BIND_CANONICAL", ("OPEN_CANONICAL_TEMPLATE", "CATALOG"), ("BIND_DIRECT_LAYOUT", "EXECUTION_R10"), ("HANDOVER_TO_R10", "EXECUTION_R10")),
    ("NORMALIZE_TO_TEMPLATE", ("LOAD_TARGET_TEMPLATE", "CATALOG"), ("BUILD_NORMALIZATION_PLAN", "PLANNER"),
     ("PREPARE_NORMALIZATION_EXECUTION", "NORMALIZER"), ("HANDOVER_TO_R10", "EXECUTION_R10")),
    ("REGISTER_VARIANT", ("LOCATE_ANCESTOR_CLUSTER", "CLUSTER_REGISTRY"), ("CREATE_STRUCTURAL_VARIANT_SPEC", "CLUSTER_REGISTRY"),
     ("REGISTER_VARIANT_IN_CATALOG", "CATALOG"), ("HANDOVER_TO_R10", "EXECUTION_R10")),
    ("CREATE_NEW_CLUSTER", ("INITIALIZE_NEW_CLUSTER", "CLUSTER_REGISTRY"), ("REGISTER_CANONICAL_ROOT_TEMPLATE", "CATALOG"), ("HANDOVER_TO_R10", "EXECUTION_R10")),
    ("REJECT", ("HALT_PROCESSING_PIPELINE", "EXECUTION_R10"), ("GENERATE_DIAGNOSTIC_REJECTION_REPORT", "CATALOG")),
)


def action_plan(decision: DataFrame) -> DataFrame:
    """Ordered steps per decision row."""
    rows = [(d, i + 1, code, module) for d, *steps in ACTION_STEPS for i, (code, module) in enumerate(steps)]
    table = decision.sparkSession.createDataFrame(rows, "decision string, step_no int, code string, module string")
    return decision.join(table, "decision")


def normalisation_plan(page: DataFrame, target_w: float = 595.32, target_h: float = 841.92) -> DataFrame:
    """Operation rows per page in fixed order: rotate, deskew, perspective, translate, scale, margins.

    ``page``: width, height, rotation, skew, perspective, perspective_score, shift_x, shift_y, symmetry, margins.
    """
    c = F.col
    turn = F.pmod(-c("rotation"), F.lit(360))
    turn = F.when(turn > 180, turn - 360).otherwise(turn)
    scale = round_to(F.least(F.lit(target_w) / c("width"), F.lit(target_h) / c("height")), 4)
    dx = F.when(F.abs("shift_x") >= 0.5, round_to(-c("shift_x"), 2)).otherwise(0.0)
    dy = F.when(F.abs("shift_y") >= 0.5, round_to(-c("shift_y"), 2)).otherwise(0.0)
    off = (c("symmetry") < 85) | (F.abs(c("margin_left") - c("margin_right")) >= 5) | (F.abs(c("margin_top") - c("margin_bottom")) >= 5)
    number = lambda v: v.cast("double")
    step = lambda flag, name, a, b: F.when(flag, F.struct(F.lit(name).alias("operation"), number(a).alias("value"), number(b).alias("value2")))
    steps = F.array_compact(F.array(
        step(turn != 0, "rotate", turn, F.lit(None)), step(F.abs("skew") >= 0.05, "deskew", round_to(-c("skew"), 2), F.lit(None)),
        step((c("perspective") >= 0.1) | (c("perspective_score") < 98), "perspective", c("perspective"), F.lit(None)),
        step((dx != 0) | (dy != 0), "translate", dx, dy), step(F.abs(scale - 1) >= 0.005, "scale", scale, scale),
        step(off, "margin_adjustment", round_to(36 - c("margin_left"), 1), round_to(36 - c("margin_right"), 1))))
    keys = [k for k in page.columns if k not in ("width", "height", "rotation", "skew", "perspective", "perspective_score", "shift_x", "shift_y", "symmetry",
                                                 "margin_left", "margin_right", "margin_top", "margin_bottom")]
    planned = page.select(*keys, steps.alias("_s"))
    return planned.select(*keys, F.size("_s").cast("bigint").alias("operations"), F.posexplode("_s").alias("_i", "_o")).select(
        *keys, "operations", (F.col("_i") + 1).cast("bigint").alias("step_no"), "_o.operation", "_o.value", "_o.value2")


def expected_scores(page: DataFrame, plan: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """What a page should score after its planned operations: ``operations``, ``requires_correction``, ``expected_geometry``, ``estimated_confidence``.

    ``page``: ``geometry_score``, ``confidence``; ``plan``: rows of :func:`normalisation_plan`. A page without operations keeps its confidence and scores at least 98.
    """
    n = plan.groupBy(*by).agg(F.count(F.lit(1)).alias("operations"))
    joined = page.join(n, list(by), "left").withColumn("operations", F.coalesce("operations", F.lit(0)).cast("bigint"))
    due = F.col("operations") > 0
    return joined.select(*by, "operations", due.alias("requires_correction"), F.when(due, 99.0).otherwise(F.greatest(F.col("geometry_score"), F.lit(98.0))).alias("expected_geometry"),
                         F.when(due, round_to(F.least(F.lit(0.99), F.col("confidence") + 0.03), 2)).otherwise(F.col("confidence")).alias("estimated_confidence"))


def readiness(template: DataFrame, schema: DataFrame) -> DataFrame:
    """Why a template cannot be compiled yet; built-in ones always can."""
    joined = template.join(schema.select("template_id", F.col("calibration_status").alias("_s"), F.col("sha256").alias("_sha"), F.lit(True).alias("_has")), "template_id", "left")
    status = F.coalesce("_s", "calibration_status")
    code = (F.when(F.col("built_in"), None).when(F.col("_has").isNull() & F.col("calibration_status").isNull(), "TEMPLATE_SOURCE_MISSING")
            .when(F.coalesce(status, F.lit("")) != "CALIBRATED", "MODEL_CALIBRATION_REQUIRED")
            .when(F.col("sha256").isNotNull() & F.col("_sha").isNotNull() & (F.col("sha256") != F.col("_sha")), "TEMPLATE_INTEGRITY_MISMATCH"))
    return joined.withColumn("error_code", code).withColumn("ready", F.col("error_code").isNull()).drop("_s", "_sha", "_has")


# Component and input names and the field type they stand for.
FIELD_TYPES = {
    "CMP-01": "TEXT_SHORT", "TEXT_SHORT": "TEXT_SHORT", "text": "TEXT_SHORT", "CMP-02": "TEXT_LONG", "TEXT_LONG": "TEXT_LONG", "textarea": "TEXT_LONG",
    "CMP-03": "SINGLE_CHOICE", "SINGLE_CHOICE": "SINGLE_CHOICE", "radio": "SINGLE_CHOICE", "select": "SINGLE_CHOICE",
    "CMP-04": "MULTI_CHOICE", "MULTI_CHOICE": "MULTI_CHOICE", "checkbox": "MULTI_CHOICE", "CMP-05": "TABLE", "TABLE": "TABLE", "table": "TABLE",
    "CMP-08": "DATE", "DATE": "DATE", "date": "DATE",
}


def schema_from_candidates(cand: DataFrame, calibrated: bool = False) -> DataFrame:
    """Schema fields of a template from reviewed candidates: rejected ones out, types and policies mapped."""
    table = F.create_map(*[F.lit(v) for pair in FIELD_TYPES.items() for v in pair])
    named = F.coalesce("field_type", F.lit(""))
    kind = F.when(named == "", F.when(F.col("h") > 40, "TEXT_LONG").otherwise("TEXT_SHORT")).otherwise(
        F.coalesce(F.try_element_at(table, named), F.when(F.col("h") > 45, "TEXT_LONG").otherwise("TEXT_SHORT")))
    policy = F.when(F.col("overflow_policy").isin("CONTINUABLE", "EXPANDABLE_OR_TABULAR", "RIGID"), F.col("overflow_policy")).when(F.col("_t") == "TABLE", "EXPANDABLE_OR_TABULAR").otherwise("RIGID")
    return cand.where(F.coalesce("calibration_status", F.lit("")) != "REJECTED").withColumn("_t", kind).withColumns({
        "overflow_policy": policy, "field_type": F.col("_t"), "status": F.lit("MANUAL_VERIFIED" if calibrated else "CANDIDATE")}).drop("_t")


def exact_dedupe(document: DataFrame, known: DataFrame, doc: str = "doc_id", content: str = "content") -> DataFrame:
    """SHA-256 of the whole content: known hash (fast path to its template), copy of an earlier document, or new."""
    hashed = document.select(doc, F.sha2(F.col(content), 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min(doc).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    joined = hashed.join(first, "sha256").join(known.select("sha256", "template_id").dropDuplicates(["sha256"]), "sha256", "left")
    return joined.withColumn("route", F.when(F.col("template_id").isNotNull(), "known").when(F.col("first_id") != F.col(doc), "copy").otherwise("new"))


def corpus_integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against their manifest: ok, changed, missing or extra. Both: path, sha256, size."""
    f = files.select("path", F.col("sha256").alias("_sha"), F.col("size").alias("_size"))
    joined = manifest.join(f, "path", "full_outer")
    state = (F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "extra")
             .when((F.col("_sha") == F.col("sha256")) & (F.col("_size") == F.col("size")), "ok").otherwise("changed"))
    return joined.select("path", state.alias("state"))


def corpus_report(decided: DataFrame) -> DataFrame:
    """Documents, pages and time by decision and final status, with totals."""
    status = F.when(F.col("decision") == "REJECT", "rejected").when(F.col("warnings") > 0, "warning").otherwise("success")
    return decided.withColumn("status", status).rollup("decision", "status").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("page_count").alias("pages"), round_to(F.sum("elapsed_ms"), 2).alias("elapsed_ms"))


def phase_report(decided: DataFrame, phase: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Time by decision and phase: ``documents``, ``ms``, ``mean_ms`` and the ``share`` of the decision's time; a null phase is the decision's total.

    ``phase``: one row for each document and phase with ``ms``. Documents count once for each phase; decisions without any time are absent.
    """
    rows = decided.select(doc, "decision").join(phase.select(doc, "phase", "ms"), doc)
    by_phase = rows.groupBy("decision", "phase").agg(F.countDistinct(doc).alias("documents"), F.sum("ms").alias("ms"))
    total = rows.groupBy("decision").agg(F.countDistinct(doc).alias("documents"), F.sum("ms").alias("ms")).withColumn("phase", F.lit(None).cast("string"))
    whole = total.select("decision", F.col("ms").alias("_all"))
    shown = by_phase.unionByName(total).join(whole, "decision")
    return shown.select("decision", "phase", "documents", round_to(F.col("ms"), 2).alias("ms"), round_to(F.col("ms") / F.col("documents"), 2).alias("mean_ms"),
                        F.when(F.col("_all") > 0, round_to(F.col("ms") / F.col("_all"), 4)).alias("share"))
