from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions.keys import grid_fingerprint
from folioframe.functions.numbers import round_to
from folioframe.operators import geometry as op
from folioframe.operators.readings import typical_height
from folioframe.queries.common import BY, PROMPT_WORDS, Catalogue, r4, sql_inter, sql_r4, sql_share

CATALOGUE = Catalogue()
add = CATALOGUE.add

# median word height per page, upper and lower
SQL_HEIGHTS = """heights AS (SELECT page_id, h, row_number() OVER (PARTITION BY page_id ORDER BY h) AS rn, count(*) OVER (PARTITION BY page_id) AS n
  FROM {fx_token} WHERE h > 5),
typical AS (SELECT page_id, h AS typical_h FROM heights WHERE rn = floor(n / 2) + 1)"""
SQL_TOL = "greatest(5.0, coalesce(y.typical_h, 20.0) * 0.6)"
LABEL = PROMPT_WORDS


def upper_heights(fx):
    return typical_height(fx.fx_token, BY, pick=None)


def region_cells(fx):
    return fx.fx_cell.withColumnRenamed("cell_id", "region_id")


@add("a20_median_height", """WITH ranked AS (SELECT page_id, h, row_number() OVER (PARTITION BY page_id ORDER BY h) AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM {fx_token} WHERE h > 5)
SELECT page_id, max(CASE WHEN rn = floor((n - 1) / 2) + 1 THEN h END) AS lower_h, max(CASE WHEN rn = floor(n / 2) + 1 THEN h END) AS upper_h FROM ranked GROUP BY page_id""")
def a20(fx):
    low = typical_height(fx.fx_token, BY, name="lower_h")
    return low.join(typical_height(fx.fx_token, BY, pick=None, name="upper_h"), list(BY))


CHECK = "({t}.field_type = 'CHECKBOX')"


@add("p3_validate_geometry", """SELECT f.page_id, f.field_id, CASE WHEN f.x < 0 OR f.y < 0 OR f.w <= 0 OR f.h <= 0 OR f.x + f.w > p.page_w + 2 OR f.y + f.h > p.page_h + 2 THEN 'OUT_OF_BOUNDS'
 WHEN field_type = 'CHECKBOX' AND (f.w < 6 OR f.w > 40 OR f.h < 6 OR f.h > 40) THEN 'INVALID_CHECKBOX_SIZE'
 WHEN field_type = 'CHECKBOX' AND (f.w / f.h < 0.5 OR f.w / f.h > 2.0) THEN 'CHECKBOX_ASPECT_RATIO_DISPROPORTIONATE'
 WHEN field_type = 'TEXT_LONG' AND (f.w < 40 OR f.h < 18) THEN 'MULTILINE_TOO_SMALL'
 WHEN field_type = 'TEXT_LONG' AND (f.h > p.page_h * 0.95 OR f.w > p.page_w * 0.98) THEN 'MULTILINE_DISPROPORTIONATELY_LARGE'
 WHEN field_type = 'TEXT_SHORT' AND (f.w < 20 OR f.h < 8) THEN 'FIELD_TOO_SMALL'
 WHEN field_type = 'TEXT_SHORT' AND f.h > 60 AND f.w < 100 THEN 'SHORT_FIELD_TOO_TALL'
 WHEN field_type = 'TEXT_SHORT' AND f.w > p.page_w * 0.98 AND f.h < 10 THEN 'DEGENERATE_LINE_RECT' END AS reason
FROM {fx_field} f JOIN {fx_page} p ON p.page_id = f.page_id""")
def p3(fx):
    return op.validate_geometry(fx.fx_field, fx.fx_page, BY).select("page_id", "field_id", "reason")


@add("p4_clamp_boxes", """WITH m AS (SELECT f.page_id, f.field_id, f.x - 30 AS x, f.y - 20 AS y, f.w, f.h, p.page_w AS pw, p.page_h - 40 AS ph FROM {fx_field} f JOIN {fx_page} p ON p.page_id = f.page_id),
k AS (SELECT *, greatest(0.0, x) AS nx, greatest(0.0, y) AS ny FROM m WHERE x + w >= -1 AND y + h >= -1 AND x <= pw + 1 AND y <= ph + 1 AND w > 0 AND h > 0),
c AS (SELECT page_id, field_id, nx AS x, ny AS y, least(w - (nx - x), pw - nx) AS w, least(h - (ny - y), ph - ny) AS h FROM k)
SELECT * FROM c WHERE w >= 6 AND h >= 6""")
def p4(fx):
    moved = fx.fx_field.select("page_id", "field_id", (F.col("x") - 30).alias("x"), (F.col("y") - 20).alias("y"), "w", "h")
    return op.clamp_boxes(moved, fx.fx_page.withColumn("page_h", F.col("page_h") - 40), BY)


@add("p5_geometry_fit", f"""WITH coll AS (SELECT DISTINCT f.page_id, f.field_id FROM {{fx_field}} f JOIN (SELECT * FROM {{fx_token}} WHERE {LABEL}) t ON t.page_id = f.page_id
  WHERE t.w * t.h > 0 AND {sql_inter('f', 't')} / (t.w * t.h) > 0.15),
home AS (SELECT * FROM (SELECT f.page_id, f.field_id, f.x < c.x - 2 OR f.y < c.y - 2 OR f.x + f.w > c.x + c.w + 2 OR f.y + f.h > c.y + c.h + 2 AS overflows,
    row_number() OVER (PARTITION BY f.page_id, f.field_id ORDER BY {sql_inter('f', 'c')} DESC, c.cell_id) AS rn
  FROM {{fx_field}} f JOIN {{fx_cell}} c ON c.page_id = f.page_id WHERE {sql_inter('f', 'c')} > 0) s WHERE rn = 1),
s AS (SELECT f.*, p.page_w, p.page_h, CASE WHEN c.field_id IS NOT NULL THEN 0.2 ELSE 1.0 END::DOUBLE AS lab, CASE WHEN h.overflows THEN 0.5 ELSE 1.0 END::DOUBLE AS held,
    CASE WHEN field_type = 'CHECKBOX' AND (f.w < 6 OR f.w > 35 OR f.h < 6 OR f.h > 35) THEN 0.3
      WHEN field_type = 'TEXT_LONG' AND (f.h < 18 OR f.w < 40) THEN 0.4
      WHEN field_type = 'TEXT_SHORT' AND (f.h < 8 OR f.h > 60 OR f.w < 18) THEN 0.4 ELSE 1.0 END::DOUBLE AS size,
    f.x < 0 OR f.y < 0 OR f.w <= 0 OR f.h <= 0 OR f.x + f.w > p.page_w + 2 OR f.y + f.h > p.page_h + 2 AS outside
  FROM {{fx_field}} f JOIN {{fx_page}} p ON p.page_id = f.page_id LEFT JOIN coll c ON c.page_id = f.page_id AND c.field_id = f.field_id
  LEFT JOIN home h ON h.page_id = f.page_id AND h.field_id = f.field_id),
r AS (SELECT *, 0.3::DOUBLE + size * 0.25::DOUBLE + lab * 0.25::DOUBLE + held * 0.2::DOUBLE AS raw FROM s),
q AS (SELECT *, CASE WHEN outside THEN 0.1::DOUBLE ELSE floor((CASE WHEN lab < 0.5 THEN least(0.4::DOUBLE, raw * lab) ELSE raw END) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS fit_score FROM r)
SELECT page_id, field_id, fit_score, fit_score < 0.6::DOUBLE AS suspect, CASE WHEN outside THEN 'OUT_OF_PAGE_BOUNDS' WHEN fit_score >= 0.6::DOUBLE THEN NULL
  WHEN lab < 0.5 THEN 'LABEL_COLLISION' WHEN size < 0.5 THEN 'SIZE_DISPROPORTIONATE' ELSE 'ALIGNMENT_SUSPECT' END AS fit_reason FROM q""")
def p5(fx):
    return op.geometry_fit(fx.fx_field, fx.fx_token.where(LABEL), fx.fx_cell, fx.fx_page, BY).select(
        "page_id", "field_id", "fit_score", "suspect", "fit_reason")


@add("p6_rebase_boxes", """WITH f AS (SELECT *, field_id % 7 = 0 AS adjusted, CASE WHEN field_id % 5 = 0 OR field_id % 7 = 0 THEN x - 1 END AS ox FROM {fx_field}),
b AS (SELECT *, coalesce(ox, x) AS x0, page_id % 3 AS k FROM f),
m AS (SELECT *, CASE k WHEN 0 THEN 2.0 ELSE 0.0 END AS a, CASE k WHEN 0 THEN 0.0 ELSE 1.0 END AS b, CASE k WHEN 0 THEN 0.0 ELSE -1.0 END AS c, CASE k WHEN 0 THEN 0.5 ELSE 0.0 END AS d, 10.0 AS e, 3.0 AS ff FROM b),
t AS (SELECT *, least(a*x0+c*y, a*(x0+w)+c*y, a*(x0+w)+c*(y+h), a*x0+c*(y+h)) + e AS nx, greatest(a*x0+c*y, a*(x0+w)+c*y, a*(x0+w)+c*(y+h), a*x0+c*(y+h)) + e AS mx,
  least(b*x0+d*y, b*(x0+w)+d*y, b*(x0+w)+d*(y+h), b*x0+d*(y+h)) + ff AS ny, greatest(b*x0+d*y, b*(x0+w)+d*y, b*(x0+w)+d*(y+h), b*x0+d*(y+h)) + ff AS my FROM m),
u AS (SELECT *, k = 2 OR (adjusted AND ox IS NOT NULL) AS kept FROM t)
SELECT page_id, field_id, CASE WHEN kept THEN x ELSE nx END AS x, CASE WHEN kept THEN y ELSE ny END AS y, CASE WHEN kept THEN w ELSE mx - nx END AS w, CASE WHEN kept THEN h ELSE my - ny END AS h FROM u""")
def p6(fx):
    moved = (F.col("field_id") % 5 == 0) | (F.col("field_id") % 7 == 0)
    orig = lambda c, d=0: F.when(moved, F.col(c) - d)
    field = fx.fx_field.select("page_id", "field_id", "x", "y", "w", "h", (F.col("field_id") % 7 == 0).alias("adjusted"),
                               orig("x", 1).alias("orig_x"), orig("y").alias("orig_y"), orig("w").alias("orig_w"), orig("h").alias("orig_h"))
    mats = F.when(F.col("page_id") % 3 == 0, F.array(*map(F.lit, (2.0, 0.0, 0.0, 0.5, 10.0, 3.0)))).when(
        F.col("page_id") % 3 == 1, F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 10.0, 3.0))))
    return op.rebase_boxes(field, fx.fx_page.select("page_id", mats.alias("affine")), BY).select("page_id", "field_id", "x", "y", "w", "h")


@add("p7_convert_space", f"""WITH t AS (SELECT f.page_id, f.field_id, f.x, f.y, f.w, f.h, p.page_w AS pw, p.page_h AS ph, (f.page_id % 4) * 90 AS a FROM {{fx_field}} f JOIN {{fx_page}} p ON p.page_id = f.page_id),
r AS (SELECT page_id, field_id, pw, ph, CASE a WHEN 90 THEN ph - y - h WHEN 180 THEN pw - x - w WHEN 270 THEN y ELSE x END AS x, CASE a WHEN 90 THEN x WHEN 180 THEN ph - y - h WHEN 270 THEN pw - x - w ELSE y END AS y,
  CASE WHEN a IN (90, 270) THEN h ELSE w END AS w, CASE WHEN a IN (90, 270) THEN w ELSE h END AS h FROM t)
SELECT page_id, field_id, {sql_r4('x * 0.5 / pw')} AS x, {sql_r4('(ph - y * 0.5 - h * 0.5) / ph')} AS y, {sql_r4('w * 0.5 / pw')} AS w, {sql_r4('h * 0.5 / ph')} AS h FROM r""")
def p7(fx):
    field = fx.fx_field.select("page_id", "field_id", "x", "y", "w", "h")

    def convert(b, col):
        turned = op.rotated(b, col("page_w"), col("page_h"), (col("page_id") % 4) * 90)
        lower = op.to_bottom_left(op.scaled(turned, F.lit(0.5), F.lit(0.5)), col("page_h"))
        return op.normalised(lower, col("page_w"), col("page_h"))

    out = op.convert_space(field, fx.fx_page, convert, BY)
    return out.select("page_id", "field_id", *[r4(c, c) for c in "xywh"])


@add("p13_background_mode", f"""WITH i AS (SELECT page_id, field_id, x + least(8.0, w * 0.1) AS x, y + least(4.0, h * 0.1) AS y, greatest(1.0, w - least(8.0, w * 0.1) * 2) AS w, greatest(1.0, h - least(4.0, h * 0.1) * 2) AS h FROM {{fx_field}}),
hit AS (SELECT DISTINCT i.page_id, i.field_id FROM i JOIN {{fx_token_b}} t ON t.page_id = i.page_id
  WHERE {sql_inter('i', 't')} / least(i.w * i.h, t.w * t.h) > 0.25)
SELECT f.page_id, f.field_id, CASE WHEN hit.field_id IS NULL THEN 'TRANSPARENT' ELSE 'OPAQUE_WHITE' END AS background_mode
FROM {{fx_field}} f LEFT JOIN hit ON hit.page_id = f.page_id AND hit.field_id = f.field_id""")
def p13(fx):
    return op.background_mode(fx.fx_field, fx.fx_token_b, BY).select("page_id", "field_id", "background_mode")


@add("p15_presentation_override", """SELECT f.page_id, f.field_id, CASE WHEN f.field_id % 4 = 0 THEN least(greatest(1.0, p.page_w - f.x), greatest(least(6.0, greatest(1.0, p.page_w - f.x)), CASE WHEN f.field_id % 8 = 0 THEN 900.0 ELSE f.w END)) ELSE f.w END AS w,
 CASE WHEN f.field_id % 4 = 0 THEN least(greatest(1.0, p.page_h - f.y), greatest(least(6.0, greatest(1.0, p.page_h - f.y)), f.h)) ELSE f.h END AS h,
 CASE WHEN f.field_id % 4 = 0 THEN least(72.0, greatest(6.0, CAST(f.field_id % 90 AS DOUBLE))) END AS font_size
FROM {fx_field} f JOIN {fx_page} p ON p.page_id = f.page_id""")
def p15(fx):
    f = F.col("field_id")
    override = fx.fx_field.where(f % 4 == 0).select(
        "page_id", "field_id", F.when(f % 8 == 0, 900.0).alias("o_w"), F.lit(None).cast("double").alias("o_h"),
        (f % 90).cast("double").alias("o_font"))
    return op.presentation_override(fx.fx_field, override, fx.fx_page, BY).select("page_id", "field_id", "w", "h", "font_size")


@add("j1_overlap_join", f"""SELECT t.page_id, t.token_id, c.cell_id, {sql_r4(sql_share('t', 'c'))} AS overlap FROM {{fx_token}} t JOIN {{fx_cell}} c ON c.page_id = t.page_id WHERE {sql_share('t', 'c')} > 0.3""")
def j1(fx):
    return op.overlap_join(fx.fx_token, fx.fx_cell, BY, over=0.3).select(
        "page_id", F.col("a_token_id").alias("token_id"), F.col("b_cell_id").alias("cell_id"), r4("overlap", "overlap"))


@add("j2_tokens_in_region", f"""SELECT c.page_id, c.cell_id, count(*) AS words FROM {{fx_token}} t JOIN {{fx_cell}} c ON c.page_id = t.page_id WHERE {sql_share('t', 'c')} > 0.55 GROUP BY c.page_id, c.cell_id""")
def j2(fx):
    return op.tokens_in_region(fx.fx_token, fx.fx_cell, BY).groupBy("page_id", F.col("b_cell_id").alias("cell_id")).agg(
        F.count(F.lit(1)).alias("words"))


@add("j3_smallest_container", """WITH r AS (SELECT page_id, cell_id AS region_id, x, y, w, h FROM {fx_cell} UNION ALL SELECT page_id, 100 + page_id % 7, 0.0, 0.0, 600.0, 200.0 FROM {fx_page}),
best AS (SELECT * FROM (SELECT t.page_id, t.token_id, r.region_id, row_number() OVER (PARTITION BY t.page_id, t.token_id ORDER BY r.w * r.h, r.region_id) AS rn
  FROM {fx_token} t JOIN r ON r.page_id = t.page_id WHERE t.x >= r.x AND t.y >= r.y AND t.x + t.w <= r.x + r.w + 2 AND t.y + t.h <= r.y + r.h + 2) s WHERE rn = 1)
SELECT t.page_id, t.token_id, b.region_id FROM {fx_token} t LEFT JOIN best b ON b.page_id = t.page_id AND b.token_id = t.token_id""")
def j3(fx):
    frame = fx.fx_page.select("page_id", (F.col("page_id") % 7 + 100).alias("region_id"), F.lit(0.0).alias("x"),
                              F.lit(0.0).alias("y"), F.lit(600.0).alias("w"), F.lit(200.0).alias("h"))
    regions = region_cells(fx).select("page_id", "region_id", "x", "y", "w", "h").unionByName(frame)
    return op.smallest_container(fx.fx_token, regions, BY).select("page_id", "token_id", "region_id")


ADJ = f"""a AS (SELECT c.*, {SQL_TOL} AS tol FROM {{fx_cell}} c LEFT JOIN typical y ON y.page_id = c.page_id),
pair AS (SELECT a.page_id, a.cell_id AS ca, b.cell_id AS cb, a.tol, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS xo, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS yo,
    least(abs(a.y + a.h - b.y), abs(b.y + b.h - a.y)) AS vgap, least(abs(a.x + a.w - b.x), abs(b.x + b.w - a.x)) AS hgap, least(a.w, b.w) AS mw, least(a.h, b.h) AS mh
  FROM a JOIN a b ON b.page_id = a.page_id AND a.cell_id < b.cell_id),
edge AS (SELECT page_id, ca AS cell_a, cb AS cell_b, CASE WHEN vgap <= tol AND xo >= mw * 0.7 THEN 'vertical' ELSE 'horizontal' END AS direction FROM pair
  WHERE (vgap <= tol AND xo >= mw * 0.7) OR (hgap <= tol AND yo >= mh * 0.7))"""


@add("j8_cell_adjacency", f"WITH {SQL_HEIGHTS}, {ADJ} SELECT * FROM edge")
def j8(fx):
    return op.cell_adjacency(fx.fx_cell, upper_heights(fx), BY)


@add("j9_aligned_peers", f"""WITH {SQL_HEIGHTS}, a AS (SELECT c.*, {SQL_TOL} AS tol FROM {{fx_cell}} c LEFT JOIN typical y ON y.page_id = c.page_id)
SELECT a.page_id, a.cell_id, b.cell_id AS peer_id, 'row' AS direction FROM a JOIN a b ON a.page_id = b.page_id AND a.cell_id <> b.cell_id
WHERE abs(a.y - b.y) < a.tol AND abs(a.h - b.h) < a.tol AND least(abs(b.x + b.w - a.x), abs(a.x + a.w - b.x)) < a.tol
UNION ALL SELECT a.page_id, a.cell_id, b.cell_id, 'column' FROM a JOIN a b ON a.page_id = b.page_id AND a.cell_id <> b.cell_id
WHERE abs(a.x - b.x) < a.tol AND abs(a.w - b.w) < a.tol * 2 AND least(abs(b.y + b.h - a.y), abs(a.y + a.h - b.y)) < a.tol""")
def j9(fx):
    heights = upper_heights(fx)
    side = lambda d: op.aligned_peers(fx.fx_cell, heights, d, BY).select("page_id", "cell_id", "peer_id", F.lit(d).alias("direction"))
    return side("row").unionByName(side("column"))


@add("j13_explicit_over_inferred", f"""WITH e AS (SELECT page_id, field_id, x, y, w, h, 'explicit' AS origin FROM {{fx_field_prev}} WHERE derivation = 'ACROFORM'), i AS (SELECT page_id, field_id, x, y, w, h, 'inferred' AS origin FROM {{fx_field}})
SELECT page_id, field_id, origin FROM e UNION ALL SELECT page_id, field_id, origin FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = i.page_id AND ({sql_share('i', 'e')} > 0.5 OR {sql_share('e', 'i')} > 0.5))""")
def j13(fx):
    cols = ["page_id", "field_id", "x", "y", "w", "h"]
    explicit = fx.fx_field_prev.where("derivation = 'ACROFORM'").select(*cols, F.lit("explicit").alias("origin"))
    return op.explicit_over_inferred(explicit, fx.fx_field.select(*cols, F.lit("inferred").alias("origin")), BY).select(
        "page_id", "field_id", "origin")


PROTECTED = "(derivation IN ('MANUAL', 'USER_CREATED', 'ACROFORM', 'MANUAL_VERIFIED') OR calibration_status IN ('CONFIRMED', 'MODIFIED', 'REJECTED'))"
DUPES = f"""pr AS (SELECT f.page_id, f.field_id, p.field_id AS prev_id, {PROTECTED.replace('derivation', 'p.derivation')} AS protected, f.label AS la, p.label AS lb, f.derivation = 'TEXT_ANCHOR' AS generic,
    f.x AS ax, f.y AS ay, f.w AS aw, f.h AS ah, p.x AS bx, p.y AS b_y, p.w AS bw, p.h AS bh, {sql_inter('f', 'p')} AS inter,
    greatest(0.0, least(f.x + f.w, p.x + p.w) - greatest(f.x, p.x)) AS xo FROM {{fx_field}} f JOIN {{fx_field_prev}} p ON p.page_id = f.page_id),
dup AS (SELECT *, CASE WHEN inter / least(aw * ah, bw * bh) >= 0.45 THEN 'OVERLAP'
   WHEN inter > 0 AND ((least(aw, bw) / greatest(aw, bw) >= 0.6 AND inter >= least(aw * ah, bw * bh) * 0.55) OR inter >= greatest(aw * ah, bw * bh) * 0.5) THEN 'CONTAINMENT'
   WHEN sqrt((ax + aw / 2 - bx - bw / 2) * (ax + aw / 2 - bx - bw / 2) + (ay + ah / 2 - b_y - bh / 2) * (ay + ah / 2 - b_y - bh / 2)) <= 18 AND least(aw, bw) / greatest(aw, bw) > 0.35 AND least(ah, bh) > greatest(ah, bh) * 0.35 THEN 'CENTRE'
   WHEN abs(ay - b_y) <= 8 AND least(aw, bw) / greatest(aw, bw) >= 0.6 AND xo >= least(aw, bw) * 0.5 THEN 'BAND'
   WHEN (contains(la, lb) OR contains(lb, la)) AND abs(ay - b_y) <= 16 AND abs(ax - bx) <= 50 THEN 'LABEL' END AS rule FROM pr)"""


def candidates(fx):
    return fx.fx_field.withColumn("generic", F.col("derivation") == "TEXT_ANCHOR")


@add("j14_protected_conflict", f"WITH {DUPES} SELECT DISTINCT page_id, field_id FROM dup WHERE protected AND (rule IS NOT NULL OR (generic AND inter > 0))")
def j14(fx):
    return op.protected_conflict(candidates(fx), fx.fx_field_prev, BY).select("page_id", "field_id")


@add("j15_substantial_duplicate", f"WITH {DUPES} SELECT page_id, field_id, prev_id, rule FROM dup WHERE rule IS NOT NULL")
def j15(fx):
    return op.substantial_duplicate(fx.fx_field, fx.fx_field_prev, BY).select(
        "page_id", F.col("a_field_id").alias("field_id"), F.col("b_field_id").alias("prev_id"), "rule")


@add("u3_diff_against_existing", f"""WITH {DUPES}, g AS (SELECT page_id, field_id, bool_or(protected AND (rule IS NOT NULL OR (generic AND inter > 0))) AS p, bool_or(NOT protected AND rule IS NOT NULL) AS m FROM dup GROUP BY page_id, field_id)
SELECT f.page_id, f.field_id, CASE WHEN g.p THEN 'protected_duplicate' WHEN g.m THEN 'matched_automatic' ELSE 'new' END AS class FROM {{fx_field}} f LEFT JOIN g ON g.page_id = f.page_id AND g.field_id = f.field_id""")
def u3(fx):
    return op.diff_against_existing(candidates(fx), fx.fx_field_prev, BY).select("page_id", "field_id", "class")


@add("u4_rebuild_page", f"""SELECT page_id, field_id, derivation, 'stored' AS stage FROM {{fx_field_prev}} WHERE {PROTECTED} UNION ALL SELECT page_id, field_id, derivation, 'proposed' FROM {{fx_field}}""")
def u4(fx):
    return op.rebuild_page(fx.fx_field_prev.withColumn("stage", F.lit("stored")), fx.fx_field.withColumn("stage", F.lit("proposed"))).select(
        "page_id", "field_id", "derivation", "stage")


COVERAGE = """f AS (SELECT * FROM {fx_field} WHERE derivation <> 'VECTOR_LINE'),
clip AS (SELECT c.page_id, c.cell_id, greatest(c.x, f.x) AS x0, least(c.x + c.w, f.x + f.w) AS x1, greatest(c.y, f.y) AS y0, least(c.y + c.h, f.y + f.h) AS y1
  FROM {fx_cell} c JOIN f ON f.page_id = c.page_id WHERE least(c.x + c.w, f.x + f.w) > greatest(c.x, f.x) AND least(c.y + c.h, f.y + f.h) > greatest(c.y, f.y)),
brk AS (SELECT DISTINCT page_id, cell_id, x0 AS b FROM clip UNION SELECT page_id, cell_id, x1 FROM clip),
strip AS (SELECT page_id, cell_id, b AS sl, lead(b) OVER (PARTITION BY page_id, cell_id ORDER BY b) AS sr FROM brk),
span AS (SELECT s.page_id, s.cell_id, sl, sr, y0, y1, max(y1) OVER (PARTITION BY s.page_id, s.cell_id, sl ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e
  FROM strip s JOIN clip c ON c.page_id = s.page_id AND c.cell_id = s.cell_id AND c.x0 < s.sr AND c.x1 > s.sl),
area AS (SELECT page_id, cell_id, sum((sr - sl) * greatest(0.0, y1 - greatest(coalesce(e, y0), y0))) AS covered FROM span GROUP BY page_id, cell_id),
cov AS (SELECT c.page_id, c.cell_id, c.x, c.y, c.w, c.h, least(1.0, coalesce(covered, 0.0) / (c.w * c.h)) AS coverage FROM {fx_cell} c LEFT JOIN area a ON a.page_id = c.page_id AND a.cell_id = c.cell_id)"""


def with_status(fx):
    return fx.fx_field.withColumn("status", F.when(F.col("derivation") == "VECTOR_LINE", "ignored").otherwise("review"))


@add("a9_union_coverage", f"WITH {COVERAGE} SELECT page_id, cell_id, {sql_r4('coverage')} AS coverage, coverage >= 0.65 AS covered FROM cov")
def a9(fx):
    return op.union_coverage(fx.fx_cell, with_status(fx), BY, region_id="cell_id").select(
        "page_id", "cell_id", r4("coverage", "coverage"), "covered")


@add("a10_coverage_summary", f"""WITH {COVERAGE}, e AS (SELECT page_id, coverage >= 0.65 AS cb, coverage >= 0.4 AS ca, cell_id % 4 <> 0 AS plausible, CASE WHEN cell_id % 3 = 0 THEN 'checkbox' ELSE 'cell' END AS kind FROM cov)
SELECT page_id, count(*) AS measured, count(*) FILTER (WHERE plausible) AS plausible, count(*) FILTER (WHERE plausible AND NOT cb) AS uncovered_before, count(*) FILTER (WHERE ca AND NOT cb) AS recovered,
 count(*) FILTER (WHERE plausible AND NOT ca) AS uncovered_after, count(*) FILTER (WHERE plausible AND kind = 'cell') AS cells, count(*) FILTER (WHERE plausible AND kind = 'checkbox') AS checkboxes, CAST(0 AS BIGINT) AS lines
FROM e GROUP BY ROLLUP (page_id)""")
def a10(fx):
    cov = op.union_coverage(fx.fx_cell, with_status(fx), BY, region_id="cell_id")
    before, after = F.col("coverage") >= 0.65, F.col("coverage") >= 0.4
    evidence = cov.select("page_id", before.alias("covered_before"), after.alias("covered_after"), (F.col("cell_id") % 4 != 0).alias("plausible"),
                          F.when(F.col("cell_id") % 3 == 0, "checkbox").otherwise("cell").alias("kind"),
                          F.when(after & ~before, "recovered").otherwise("static").alias("outcome"))
    return op.coverage_summary(evidence, BY)


@add("a26_overlap_audit", f"""WITH wrd AS (SELECT c.page_id, c.cell_id, count(*) AS n FROM {{fx_cell}} c JOIN {{fx_token}} t ON t.page_id = c.page_id WHERE {sql_share('t', 'c')} > 0.55 GROUP BY ALL),
fld AS (SELECT c.page_id, c.cell_id, string_agg(f.field_id, ',' ORDER BY f.field_id) AS ids FROM {{fx_cell}} c JOIN {{fx_field}} f ON f.page_id = c.page_id WHERE {sql_share('c', 'f')} > 0.55 OR {sql_share('f', 'c')} > 0.55 GROUP BY ALL)
SELECT c.page_id, c.cell_id AS region_id, coalesce(w.n, 0) AS words, coalesce(f.ids, '') AS field_ids, CASE WHEN f.ids IS NULL THEN 'excluded' ELSE 'proposed' END AS outcome
FROM {{fx_cell}} c LEFT JOIN wrd w ON w.page_id = c.page_id AND w.cell_id = c.cell_id LEFT JOIN fld f ON f.page_id = c.page_id AND f.cell_id = c.cell_id""")
def a26(fx):
    return op.overlap_audit(region_cells(fx), fx.fx_token, fx.fx_field, BY).select(
        "page_id", "region_id", "words", F.concat_ws(",", F.col("field_ids").cast("array<string>")).alias("field_ids"), "outcome")


@add("j19_snap_to_structure", shared="fx_token")
def j19(fx):
    rects = fx.fx_cell.withColumnRenamed("cell_id", "rect_id")
    return op.snap_to_structure(fx.fx_field, rects, fx.fx_line, BY).select("page_id", "field_id", "x", "y", "w", "h")


@add("f9_cell_interior", f"""WITH pr AS (SELECT * FROM (SELECT c.page_id, c.cell_id, t.x AS px, t.y AS py, t.w AS pw, t.h AS ph, {LABEL} AS said, row_number() OVER (PARTITION BY c.page_id, c.cell_id ORDER BY t.token_id) AS rn
   FROM (SELECT * REPLACE (CASE WHEN cell_id % 3 = 0 THEN 70.0 ELSE h END AS h) FROM {{fx_cell}}) c JOIN {{fx_token}} t ON t.page_id = c.page_id WHERE {sql_share('t', 'c')} > 0.55) s WHERE rn = 1),
j AS (SELECT c.*, px, py, pw, ph, coalesce(said, false) AS said, px IS NULL AS none, c.x + c.w - (px + pw) - 2 AS rw, c.y + c.h - (py + ph) - 2 AS rh, py >= c.y - 2 AS inside
  FROM (SELECT * REPLACE (CASE WHEN cell_id % 3 = 0 THEN 70.0 ELSE h END AS h) FROM {{fx_cell}}) c LEFT JOIN pr ON pr.page_id = c.page_id AND pr.cell_id = c.cell_id),
k AS (SELECT *, NOT none AND ((inside AND NOT said AND (h < 50 OR rh < 30)) OR (rh < 18 AND rw < 28) OR (NOT said AND rh < 30) OR (pw / w >= 0.55 AND rh < 18)) AS header,
  CASE WHEN none THEN 'whole' WHEN h >= 50 AND rh >= 30 THEN 'below' WHEN said AND rw >= 25 THEN 'beside' WHEN (said OR NOT inside) AND rh >= 16 THEN 'below' WHEN NOT inside THEN 'whole' ELSE 'static' END AS way FROM j),
m AS (SELECT *, CASE WHEN header THEN 'static' ELSE way END AS z FROM k)
SELECT page_id, cell_id, z = 'static' AS header_only, CASE z WHEN 'static' THEN x WHEN 'beside' THEN greatest(x + 2, px + pw + 4) ELSE x + 2 END AS in_x,
 CASE WHEN z = 'static' THEN y WHEN z IN ('whole', 'beside') THEN y + 2 ELSE greatest(y + 2, py + ph + 2) END AS in_y,
 CASE z WHEN 'static' THEN w WHEN 'beside' THEN greatest(25.0, x + w - 2 - greatest(x + 2, px + pw + 4)) ELSE greatest(20.0, w - 4) END AS in_w,
 CASE WHEN z = 'static' THEN h WHEN z IN ('whole', 'beside') THEN greatest(16.0, h - 4) ELSE greatest(16.0, y + h - 2 - greatest(y + 2, py + ph + 2)) END AS in_h FROM m""")
def f9(fx):
    cells = fx.fx_cell.withColumn("h", F.when(F.col("cell_id") % 3 == 0, 70.0).otherwise(F.col("h")))
    prompts = fx.fx_token.withColumn("is_prompt", F.expr(LABEL))
    return op.cell_interior(cells, prompts, BY).select("page_id", "cell_id", "header_only", "in_x", "in_y", "in_w", "in_h")


@add("f12_field_fingerprint", """SELECT page_id, field_id, concat('p', page_id, '_', CAST(floor(x / 5 + 0.5) * 5 AS BIGINT), '_', CAST(floor(y / 5 + 0.5) * 5 AS BIGINT), '_', CAST(floor(w / 10 + 0.5) * 10 AS BIGINT), '_', CAST(floor(h / 5 + 0.5) * 5 AS BIGINT), '_',
 left(regexp_replace(lower(label), '[^a-z0-9]', '', 'g'), 16), '_', field_type) AS fingerprint FROM {fx_field}""")
def f12(fx):
    return fx.fx_field.select("page_id", "field_id", grid_fingerprint(
        F.col("page_id"), *[F.col(c) for c in ("x", "y", "w", "h", "label", "field_type")]).alias("fingerprint"))
