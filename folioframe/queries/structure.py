from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import structure as op
from folioframe.queries.common import BY, PROMPT_WORDS, Catalogue, r4, sql_inter, sql_r4, sql_share
from folioframe.queries.geometry import SQL_HEIGHTS, upper_heights
from folioframe.session import cut_lineage

CATALOGUE = Catalogue()
add = CATALOGUE.add
c = F.col
TH = "coalesce(y.typical_h, 20.0)"


@add("j5_nearest_label", """WITH k AS (SELECT f.page_id, f.field_id, t.text, t.token_id, t.x + t.w <= f.x + 6 AND f.x - t.x - t.w < 250 AND abs((t.y + t.h / 2) - (f.y + f.h / 2)) < greatest(f.h / 2, t.h * 1.5) AS lf,
  t.y + t.h <= f.y + 4 AND f.y - t.y - t.h < t.h * 1.2 AND t.x < f.x + f.w AND t.x + t.w > f.x AS ab, t.x AS tx, t.y AS ty FROM {fx_field} f JOIN {fx_word} t ON t.page_id = f.page_id AND t.is_label),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, field_id ORDER BY CASE WHEN lf THEN 0 ELSE 1 END, CASE WHEN lf THEN -tx ELSE -ty END, token_id) AS rn FROM k WHERE lf OR ab) s WHERE rn = 1)
SELECT f.page_id, f.field_id, b.token_id AS label_token, b.text AS label_text, CASE WHEN b.lf THEN 'left' WHEN b.ab THEN 'above' END AS label_side FROM {fx_field} f LEFT JOIN b ON b.page_id = f.page_id AND b.field_id = f.field_id""")
def j5(fx):
    return op.nearest_label(fx.fx_field, fx.fx_word.where("is_label"), BY).select("page_id", "field_id", "label_token", "label_text", "label_side")


# label association of region table {r} (page_id, region_id, kind) with the marked words
def associate_sql(r: str, p: str = "") -> str:
    return f"""{p}cand AS (SELECT r.page_id, r.region_id, t.text, t.token_id, CASE
   WHEN kind = 'checkbox' AND t.is_label AND abs(t.y - r.y) < 14 AND t.x >= r.x + r.w - 5 AND t.x - r.x < 100 THEN 0 WHEN kind = 'checkbox' AND t.is_label AND abs(t.y - r.y) < 14 AND t.x + t.w <= r.x + 5 AND r.x - t.x - t.w < 80 THEN 1
   WHEN kind = 'checkbox' AND t.is_label AND r.y - t.y - t.h >= 0 AND r.y - t.y - t.h < 20 AND abs(t.x - r.x) < 80 THEN 2 WHEN kind = 'cell' AND t.is_prompt AND t.x + t.w <= r.x + 8 AND r.x - t.x - t.w < 120 AND abs(t.y - r.y) < 20 THEN 3
   WHEN kind = 'cell' AND r.y - t.y - t.h >= -2 AND r.y - t.y - t.h < 30 AND abs(t.x - r.x) < 50 THEN 4 WHEN kind = 'cell' AND r.y - t.y - t.h >= 0 AND r.y - t.y - t.h < 250 AND t.x >= r.x - 10 AND t.x <= r.x + r.w THEN 5
   WHEN kind = 'underline' AND t.is_prompt AND abs(t.y - r.y - 2) < 18 AND t.x + t.w <= r.x + 10 AND r.x - t.x - t.w < 140 THEN 6 WHEN kind = 'underline' AND t.is_prompt AND r.y + 2 - t.y - t.h >= 0 AND r.y + 2 - t.y - t.h < 24 AND abs(t.x - r.x) < 60 THEN 7 END AS rk,
   t.x AS tx, t.x + t.w AS tr, t.y + t.h AS tb, r.x AS rx, r.y AS ry FROM {r} r JOIN {{fx_word}} t ON t.page_id = r.page_id),
{p}lab AS (SELECT page_id, region_id, text AS label, CASE rk WHEN 0 THEN 'RIGHT_NEIGHBOR' WHEN 1 THEN 'LEFT_NEIGHBOR' WHEN 2 THEN 'TOP_HEADER' WHEN 3 THEN 'LEFT_NEIGHBOR' WHEN 4 THEN 'TOP_HEADER' WHEN 5 THEN 'COLUMN_HEADER' WHEN 6 THEN 'LEFT_NEIGHBOR' ELSE 'TOP_HEADER' END AS method
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, region_id ORDER BY rk, CASE rk WHEN 0 THEN tx WHEN 1 THEN tr WHEN 2 THEN tb WHEN 6 THEN rx - tr WHEN 7 THEN ry + 2 - tb ELSE 0 END, token_id) AS rn FROM {p}cand WHERE rk IS NOT NULL) s WHERE rn = 1)"""


J6_REGION = "reg AS (SELECT page_id, cell_id AS region_id, CASE cell_id % 3 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'cell' ELSE 'underline' END AS kind, x + 100 AS x, y + 20 AS y, 30.0 AS w, h FROM {fx_cell})"


@add("j6_associate_label", f"WITH {J6_REGION}, {associate_sql('reg')} SELECT r.page_id, r.region_id, l.label, coalesce(l.method, 'UNASSOCIATED') AS method FROM reg r LEFT JOIN lab l ON l.page_id = r.page_id AND l.region_id = r.region_id")
def j6(fx):
    k = c("cell_id") % 3
    region = fx.fx_cell.select("page_id", c("cell_id").alias("region_id"), F.when(k == 0, "checkbox").when(k == 1, "cell").otherwise("underline").alias("kind"), (c("x") + 100).alias("x"), (c("y") + 20).alias("y"), F.lit(30.0).alias("w"), "h")
    return op.associate_label(region, fx.fx_word, BY).select("page_id", "region_id", "label", "method")


@add("j7_row_group_prompt", """WITH bx AS (SELECT page_id, cell_id AS region_id, x + 200 AS x, y FROM {fx_cell}), rw AS (SELECT b.page_id, b.region_id, b.x AS bx, t.* EXCLUDE (page_id) FROM bx b JOIN {fx_word} t ON t.page_id = b.page_id WHERE abs(t.y - b.y) < 14),
st AS (SELECT page_id, region_id, min(x) AS f FROM rw WHERE is_choice GROUP BY ALL),
b AS (SELECT * FROM (SELECT r.page_id, r.region_id, r.text, row_number() OVER (PARTITION BY r.page_id, r.region_id ORDER BY r.x + r.w DESC, token_id) AS rn FROM rw r LEFT JOIN st ON st.page_id = r.page_id AND st.region_id = r.region_id WHERE is_label AND NOT is_choice AND r.x + r.w <= coalesce(f, bx) + 4) s WHERE rn = 1)
SELECT bx.page_id, bx.region_id, b.text AS group_prompt FROM bx LEFT JOIN b ON b.page_id = bx.page_id AND b.region_id = bx.region_id""")
def j7(fx):
    boxes = fx.fx_cell.select("page_id", c("cell_id").alias("region_id"), (c("x") + 200).alias("x"), "y")
    return op.row_group_prompt(boxes, fx.fx_word, BY).select("page_id", "region_id", "group_prompt")


@add("j10_uncovered_labels", """SELECT t.page_id, t.token_id, 'NO_PHYSICAL_GEOMETRY' AS reason FROM {fx_word} t WHERE is_prompt AND NOT EXISTS (SELECT 1 FROM {fx_rect} r WHERE r.page_id = t.page_id
 AND ((abs(r.y - t.y) < 20 AND r.x + r.w >= t.x - 30 AND r.x <= t.x + t.w + 150) OR (r.y >= t.y + t.h - 5 AND r.y <= t.y + t.h + 40 AND abs(r.x - t.x) < 60)))""")
def j10(fx):
    return op.uncovered_labels(fx.fx_word, fx.fx_rect, BY).select("page_id", "token_id", "reason")


@add("j11_uncovered_tokens", f"""SELECT t.page_id, t.token_id FROM {{fx_word}} t WHERE (is_marker OR is_prompt) AND NOT EXISTS (SELECT 1 FROM {{fx_field_prev}} f WHERE f.page_id = t.page_id AND ({sql_share('t', 'f')} >= 0.5
 OR ((is_marker OR f.label = t.text OR starts_with(f.label, concat(t.text, ' '))) AND ((f.x >= t.x + t.w - 4 AND f.x - t.x - t.w <= greatest(40.0, t.h * 4) AND abs((f.y + f.h / 2) - (t.y + t.h / 2)) <= greatest(t.h, least(f.h, t.h * 2)) * 0.75)
  OR (f.y >= t.y + t.h - 4 AND f.y - t.y - t.h <= t.h * 2 AND least(f.x + f.w, t.x + t.w) - greatest(f.x, t.x) >= least(t.w, f.w) * 0.5)))))""")
def j11(fx):
    return op.uncovered_tokens(fx.fx_word, fx.fx_field_prev, BY).select("page_id", "token_id")


SQL_GRID = f"""{SQL_HEIGHTS}, g AS (SELECT c.*, {TH} AS th, greatest(5.0, {TH} * 0.6) AS tol FROM {{fx_grid}} c LEFT JOIN typical y ON y.page_id = c.page_id),
gp AS (SELECT a.page_id, a.cell_id AS ca, b.cell_id AS cb FROM g a JOIN g b ON b.page_id = a.page_id AND a.cell_id < b.cell_id
  WHERE (least(abs(a.y + a.h - b.y), abs(b.y + b.h - a.y)) <= a.tol AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= least(a.w, b.w) * 0.7) OR (least(abs(a.x + a.w - b.x), abs(b.x + b.w - a.x)) <= a.tol AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= least(a.h, b.h) * 0.7)),
bw AS (SELECT page_id, ca, cb FROM gp UNION ALL SELECT page_id, cb, ca FROM gp),
reach AS (SELECT page_id, cell_id AS src, cell_id AS dst FROM g UNION SELECT r.page_id, r.src, b.cb FROM reach r JOIN bw b ON b.page_id = r.page_id AND b.ca = r.dst),
comp AS (SELECT page_id, src AS cell_id, min(dst) AS component FROM reach GROUP BY page_id, src)"""


@add("f1_table_components", f"WITH RECURSIVE {SQL_GRID} SELECT page_id, cell_id, component FROM comp", shared="fx_token")
def f1(fx):
    return op.table_components(fx.stored("fx_grid"), stored_heights(fx), BY).select("page_id", "cell_id", "component")


def readers(fx):
    return fx.stored("fx_reader"), fx.stored("fx_token_b")


def stored_heights(fx):
    return cut_lineage(upper_heights(fx))


SQL_HEAD = SQL_GRID + f""",
ta AS (SELECT g.page_id, g.cell_id, string_agg(t.text, ' ' ORDER BY t.line_id, t.x) AS k FROM g JOIN {{fx_reader}} t ON t.page_id = g.page_id WHERE g.h <= g.th * 6 AND {sql_share('t', 'g')} > 0.55 GROUP BY ALL),
tb AS (SELECT g.page_id, g.cell_id, string_agg(t.text, ' ' ORDER BY t.line_id, t.x) AS k FROM g JOIN {{fx_token_b}} t ON t.page_id = g.page_id WHERE g.h <= g.th * 6 AND {sql_share('t', 'g')} > 0.55 GROUP BY ALL),
cd AS (SELECT g.*, m.component, d.label AS pl, d.is_group AS pg, e.label AS sl, e.is_group AS sg FROM g JOIN comp m ON m.page_id = g.page_id AND m.cell_id = g.cell_id LEFT JOIN ta ON ta.page_id = g.page_id AND ta.cell_id = g.cell_id LEFT JOIN {{fx_header}} d ON d.header_key = lower(ta.k)
  LEFT JOIN tb ON tb.page_id = g.page_id AND tb.cell_id = g.cell_id LEFT JOIN {{fx_header}} e ON e.header_key = lower(tb.k) WHERE d.label IS NOT NULL OR e.label IS NOT NULL),
ok AS (SELECT *, pl IS NULL AS second_only FROM cd a WHERE pl IS NOT NULL OR EXISTS (SELECT 1 FROM cd b WHERE b.page_id = a.page_id AND b.component = a.component AND b.cell_id <> a.cell_id AND abs(b.y - a.y) < a.tol AND coalesce(b.sl, b.pl) <> a.sl)),
hb AS (SELECT *, EXISTS (SELECT 1 FROM g b WHERE b.page_id = o.page_id AND b.cell_id <> o.cell_id AND abs(o.y + o.h - b.y) <= o.tol AND least(o.x + o.w, b.x + b.w) - greatest(o.x, b.x) >= least(o.w, b.w) * 0.7) AS body FROM ok o),
hd AS (SELECT * FROM hb a WHERE body OR EXISTS (SELECT 1 FROM hb b WHERE b.page_id = a.page_id AND b.cell_id <> a.cell_id AND b.body AND least(abs(a.x + a.w - b.x), abs(b.x + b.w - a.x)) <= a.tol AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= least(a.h, b.h) * 0.7))"""


@add("f2_column_headers", f"WITH RECURSIVE {SQL_HEAD} SELECT page_id, cell_id, coalesce(pl, sl) AS label, coalesce(pg, sg) AS is_group, CASE WHEN second_only THEN 'secondary' ELSE 'primary' END AS source, coalesce(sl <> pl, false) AS conflict FROM hd", shared="fx_token")
def f2(fx):
    a, b = readers(fx)
    return op.column_headers(fx.stored("fx_grid"), a, b, fx.fx_header, stored_heights(fx), BY).select("page_id", "cell_id", "label", "is_group", "source", "conflict")


@add("f3_header_ancestors", shared="fx_token")
def f3(fx):
    a, b = readers(fx)
    heights, grid = stored_heights(fx), fx.stored("fx_grid")
    member = cut_lineage(op.table_components(grid, heights, BY).select("page_id", "cell_id", "component"))
    head = cut_lineage(op.column_headers(grid, a, b, fx.fx_header, heights, BY, member))
    return op.header_ancestors(grid, head, heights, BY, member).select("page_id", "cell_id", "head_id", "label", "steps")


def prompt_keys(fx):
    return fx.part.where("p_name LIKE '%gear' OR p_name LIKE '%ring'").select(c("p_name").alias("key")).distinct()


@add("f4_associate_fields", shared="fx_token")
def f4(fx):
    a, b = readers(fx)
    field = fx.stored("fx_field_prev").withColumn("generic", c("derivation") == "TABLE_CELL")
    token = a.withColumn("is_prompt", F.expr(PROMPT_WORDS))
    return op.associate_fields(fx.stored("fx_grid"), token, b, field, fx.fx_page, fx.fx_header, prompt_keys(fx), stored_heights(fx), BY, instruction=r"(?i)^cold\b").select(
        "page_id", "cell_id", "outcome", "reason", "relation", "label")


@add("f5_signature_lines", f"""WITH {SQL_HEIGHTS}, l AS (SELECT n.*, x2 - x1 AS w, {TH} AS th, greatest(4.0, {TH} * 0.2) AS pad FROM {{fx_line}} n LEFT JOIN typical y ON y.page_id = n.page_id),
k AS (SELECT l.page_id, l.line_id, t.text AS label, t.token_id, l.x1 AS x, greatest(0.0, l.y - th * 1.3) AS y, l.w, th * 1.25 AS h, row_number() OVER (PARTITION BY l.page_id, l.line_id ORDER BY t.y DESC, t.token_id) AS rn
 FROM l JOIN {{fx_token}} t ON t.page_id = l.page_id AND t.text LIKE 'red%' WHERE l.w >= th * 3 AND t.y + t.h <= l.y + pad AND l.y - t.y - t.h < th * 3 AND least(t.x + t.w, l.x2) - greatest(t.x, l.x1) > least(t.w, l.w) * 0.5)
SELECT page_id, line_id, label, token_id, {sql_r4('y')} AS y, {sql_r4('h')} AS h FROM k WHERE rn = 1""")
def f5(fx):
    return op.signature_lines(fx.fx_line, fx.fx_token, upper_heights(fx), BY, anchor=r"^red\b").select("page_id", "line_id", "label", "token_id", r4("y", "y"), r4("h", "h"))


@add("f6_recover_uncovered", shared="fx_token")
def f6(fx):
    cells = fx.stored("fx_cell").select("page_id", "cell_id", "x", "y", "w", "h", (c("cell_id") == 3).alias("is_caption"), ((c("page_id") % 11) / 500).alias("ink_ratio"))
    fields = fx.stored("fx_field_prev").withColumn("status", F.when(c("calibration_status") == "REJECTED", "ignored").otherwise("review"))
    return op.recover_uncovered(cells, fields, fx.stored("fx_line"), fx.stored("fx_word").where("is_label"), fx.fx_page, stored_heights(fx), BY).select(
        "page_id", "evidence_id", "kind", "plausible", "outcome", "reason")


SQL_REGION = """lv AS (SELECT *, x2 - x1 AS w FROM {fx_rule} WHERE NOT is_vertical AND x2 - x1 >= 25),
nx AS (SELECT *, lead(x1) OVER q AS n1, lead(x2) OVER q AS n2, lead(y) OVER q AS ny FROM lv WINDOW q AS (PARTITION BY page_id ORDER BY line_id)),
sp AS (SELECT *, greatest(x1, n1) AS sx, least(x2, n2) AS se FROM nx WHERE abs(ny - y) BETWEEN 18 AND 120 AND least(x2, n2) - greatest(x1, n1) >= 60),
ry AS (SELECT page_id, concat('r', rect_id) AS region_id, CASE WHEN w BETWEEN 8 AND 28 AND h BETWEEN 8 AND 28 THEN 'CHECKBOX' WHEN w >= 30 AND h >= 45 THEN 'MULTILINE_STRUCTURE' WHEN w >= 30 AND h >= 14 THEN 'CLOSED_CELL' END AS kd, x, y, w, h FROM {fx_rect}),
rg AS (SELECT * FROM ry WHERE kd IS NOT NULL UNION ALL SELECT page_id, concat('o', line_id), 'OPEN_STRUCTURE', sx, least(y, ny), se - sx, abs(ny - y) FROM sp s WHERE NOT EXISTS (SELECT 1 FROM {fx_rect} r WHERE r.page_id = s.page_id AND (abs(r.x - sx) < 12 OR abs(r.x + r.w - se) < 12) AND r.y <= s.y + 4 AND r.y + r.h >= ny - 4)
 UNION ALL SELECT page_id, concat('l', line_id), 'UNDERLINE', x1, y - 2, w, 20.0 FROM lv l WHERE w >= 30 AND NOT EXISTS (SELECT 1 FROM {fx_rect} r WHERE r.page_id = l.page_id AND l.y >= r.y - 2 AND l.y <= r.y + r.h + 2 AND l.x1 >= r.x - 4 AND l.x2 <= r.x + r.w + 4))"""


@add("f7_classify_regions", f"WITH {SQL_REGION} SELECT page_id, region_id, kd AS kind, x, y, w, h FROM rg")
def f7(fx):
    return op.classify_regions(fx.fx_rect, fx.fx_rule, BY).select("page_id", "region_id", "kind", "x", "y", "w", "h")


SQL_CLASS = SQL_REGION + f""",
reg AS (SELECT page_id, region_id, kd, CASE kd WHEN 'CHECKBOX' THEN 'checkbox' WHEN 'UNDERLINE' THEN 'underline' ELSE 'cell' END AS kind, x, y, w, h FROM rg), {associate_sql('reg')},
ins AS (SELECT r.page_id, r.region_id, trim(string_agg(t.text, ' ' ORDER BY t.token_id)) AS tx, max(t.x + t.w) AS rt FROM rg r JOIN {{fx_word}} t ON t.page_id = r.page_id WHERE kd IN ('CLOSED_CELL', 'MULTILINE_STRUCTURE') AND t.x >= r.x - 2 AND t.x + t.w <= r.x + r.w + 4 AND t.y >= r.y - 2 AND t.y + t.h <= r.y + r.h + 4 GROUP BY ALL),
cls AS (SELECT r.page_id, r.region_id, l.method AS m, CASE WHEN kd = 'OPEN_STRUCTURE' THEN 'STRUCTURAL_ONLY' WHEN kd = 'CHECKBOX' AND l.method IS NULL THEN 'NON_FILLABLE_GRAPHIC' WHEN kd = 'CHECKBOX' THEN 'CHECKBOX' WHEN kd = 'UNDERLINE' AND l.method IS NOT NULL THEN 'UNDERLINE_FIELD' WHEN kd = 'UNDERLINE' THEN 'STRUCTURAL_ONLY'
  WHEN i.tx IS NULL THEN 'EMPTY_CELL' ELSE 'HEADER_CELL' END AS class FROM rg r LEFT JOIN lab l ON l.page_id = r.page_id AND l.region_id = r.region_id LEFT JOIN ins i ON i.page_id = r.page_id AND i.region_id = r.region_id)"""


@add("f8_classify_fields", f"""WITH {SQL_CLASS} SELECT page_id, count(*) AS regions, count(*) FILTER (WHERE class = 'EMPTY_CELL') AS empty_cells, count(*) FILTER (WHERE class = 'PARTIAL_CELL') AS partial_cells, count(*) FILTER (WHERE class = 'HEADER_CELL') AS header_cells, count(*) FILTER (WHERE class = 'UNDERLINE_FIELD') AS underlines,
 count(*) FILTER (WHERE class = 'CHECKBOX') AS checkboxes, count(*) FILTER (WHERE class = 'STRUCTURAL_ONLY') AS structural, count(*) FILTER (WHERE class = 'NON_FILLABLE_GRAPHIC') AS graphics FROM cls GROUP BY page_id""", shared="fx_token")
def f8(fx):
    return op.class_counts(op.classify_fields(op.classify_regions(fx.fx_rect, fx.fx_rule, BY), fx.fx_word, BY), BY)


@add("f10_writing_lines", shared="fx_token")
def f10(fx):
    # strokes a little below the words, beside the ruled rectangles
    lines = fx.fx_line.withColumn("y", c("y") + 5)
    return op.writing_lines(lines, fx.fx_rect, fx.fx_token, BY).select("page_id", "line_id", "x", "y", "w")


def candidates(fx):
    rects = fx.stored("fx_rect").withColumn("is_checkbox", c("rect_id") % 5 == 0)
    return op.field_candidates(fx.stored("fx_line"), rects, fx.stored("fx_word"), fx.stored("fx_field"), fx.stored("fx_field_prev"), fx.fx_page, BY)


@add("f11_field_candidates", shared="fx_token")
def f11(fx):
    return candidates(fx).kept.select("page_id", "field_id", "item", "field_type", "derivation", "label", "confidence", "recovered")


@add("f11_discarded", shared="fx_token")
def f11_discarded(fx):
    return candidates(fx).dropped


@add("f11_detection_flags", shared="fx_token")
def f11_flags(fx):
    found = candidates(fx)
    return op.detection_flags(found.kept, found.kept.where("recovered"), found.expected, BY)


@add("f14_infer_region_fields", shared="fx_token")
def f14(fx):
    header = fx.fx_header.select(c("header_key").alias("key"))
    return op.infer_region_fields(fx.stored("fx_grid"), fx.stored("fx_word"), fx.fx_page, stored_heights(fx), header, prompt_keys(fx), BY).select("page_id", "cell_id", "outcome", "reason", "label", "value")


def ticks(fx):
    """Every third rectangle as a checkbox of at most 14 by 14."""
    return fx.stored("fx_rect").where(c("rect_id") % 3 == 0).select("page_id", c("rect_id").alias("box_id"), "x", "y", F.least("w", F.lit(14.0)).alias("w"), F.least("h", F.lit(14.0)).alias("h"))


@add("f14_checkbox_captions", f"""WITH {SQL_HEIGHTS}, bx AS (SELECT r.page_id, rect_id AS box_id, r.x, r.y, least(r.w, 14.0::DOUBLE) AS w, least(r.h, 14.0::DOUBLE) AS h, {TH} AS th FROM {{fx_rect}} r LEFT JOIN typical y ON y.page_id = r.page_id WHERE rect_id % 3 = 0),
st AS (SELECT a.page_id, a.box_id, min(b.x) AS stop FROM bx a JOIN bx b ON b.page_id = a.page_id AND b.x > a.x + a.w AND abs(b.y - a.y) < a.th AND b.x <= 600 GROUP BY ALL),
nx AS (SELECT * FROM (SELECT a.page_id, a.box_id, t.line_id, t.x AS nx, t.text AS nt, row_number() OVER (PARTITION BY a.page_id, a.box_id ORDER BY t.x, t.token_id) AS rn FROM bx a JOIN {{fx_word}} t ON t.page_id = a.page_id AND t.x >= a.x + a.w - 2 AND abs(t.y - a.y) < a.th AND t.x - a.x - a.w < 250 AND t.x <= 600) q WHERE rn = 1),
cp AS (SELECT n.page_id, n.box_id, string_agg(t.text, ' ' ORDER BY t.x, t.token_id) AS cap FROM nx n LEFT JOIN st s ON s.page_id = n.page_id AND s.box_id = n.box_id JOIN {{fx_word}} t ON t.page_id = n.page_id AND t.line_id = n.line_id AND t.x >= n.nx AND t.x < coalesce(s.stop, 600) GROUP BY n.page_id, n.box_id)
SELECT b.page_id, b.box_id, CASE WHEN n.nt LIKE 'hot%' OR least(b.w, b.h) < b.th * 0.75 THEN 'excluded' ELSE 'proposed' END AS outcome,
 CASE WHEN n.nt LIKE 'hot%' THEN 'CHECKBOX_NEXT_TO_STATIC_HEADING' WHEN least(b.w, b.h) < b.th * 0.75 THEN 'CHECKBOX_BELOW_TEXT_SCALE' WHEN cap IS NULL THEN 'CHECKBOX_WITHOUT_CAPTION' ELSE 'CHECKBOX_CAPTION' END AS reason,
 CASE WHEN NOT (coalesce(n.nt LIKE 'hot%', false) OR least(b.w, b.h) < b.th * 0.75) THEN coalesce(cap, 'none') END AS label
FROM bx b LEFT JOIN nx n ON n.page_id = b.page_id AND n.box_id = b.box_id LEFT JOIN cp c ON c.page_id = b.page_id AND c.box_id = b.box_id""")
def f14_boxes(fx):
    return op.checkbox_captions(ticks(fx), fx.stored("fx_word"), fx.fx_page, stored_heights(fx), BY, heading="^hot", combined="^never", unknown="none").select("page_id", "box_id", "outcome", "reason", "label")


@add("f14_page_fields", shared="fx_token")
def f14_page(fx):
    header = fx.fx_header.select(c("header_key").alias("key"))
    found = op.infer_page_fields(fx.stored("fx_grid"), ticks(fx), fx.stored("fx_word"), fx.fx_page, stored_heights(fx), header, prompt_keys(fx), "hot[a-z ]*|large[a-z ]*", "small", BY)
    return found.groupBy("page_id", "kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@add("f6_recover_checkboxes", f"""WITH {SQL_HEIGHTS}, bx AS (SELECT r.page_id, rect_id AS box_id, r.x, r.y, least(r.w, 14.0::DOUBLE) AS w, least(r.h, 14.0::DOUBLE) AS h, {TH} AS th, greatest(5.0::DOUBLE, {TH} * 0.6::DOUBLE) AS tol, (rect_id % 7) * 0.02::DOUBLE AS ink FROM {{fx_rect}} r LEFT JOIN typical y ON y.page_id = r.page_id WHERE rect_id % 3 = 0),
sb AS (SELECT DISTINCT a.page_id, a.box_id FROM bx a JOIN bx b ON b.page_id = a.page_id AND b.box_id <> a.box_id AND abs(b.w - a.w) < a.tol AND abs(b.h - a.h) < a.tol AND ((abs(b.x - a.x) < a.tol AND abs(b.y - a.y) < a.th * 7) OR (abs(b.y - a.y) < a.tol AND abs(b.x - a.x) < a.th * 20))),
cp AS (SELECT a.page_id, a.box_id, string_agg(t.text, ' ' ORDER BY t.x, t.token_id) AS cap FROM bx a JOIN {{fx_word}} t ON t.page_id = a.page_id AND abs(t.y - a.y) < a.th * 0.7 AND least(abs(t.x + t.w - a.x), abs(a.x + a.w - t.x)) < a.th * 4 GROUP BY a.page_id, a.box_id),
pl AS (SELECT a.*, cap, sb.box_id IS NOT NULL AND coalesce(regexp_matches(cap, '(?i)(^|\\s)(small|hot)($|[\\s.,:])'), false) AND least(w, h) >= th * 0.55 AS ok FROM bx a LEFT JOIN sb ON sb.page_id = a.page_id AND sb.box_id = a.box_id LEFT JOIN cp ON cp.page_id = a.page_id AND cp.box_id = a.box_id)
SELECT page_id, box_id, CASE WHEN NOT ok THEN 'static' WHEN x < 0 OR y < 0 OR x + w > 600 OR y + h > 130 OR w < greatest(6.0, th * 0.55) OR h < greatest(6.0, th * 0.55) THEN 'unresolved' WHEN ink >= 0.025 AND ink <= 0.1 THEN 'unresolved' ELSE 'recovered' END AS outcome,
 CASE WHEN NOT ok THEN 'NO_WRITABLE_STRUCTURE' WHEN x < 0 OR y < 0 OR x + w > 600 OR y + h > 130 OR w < greatest(6.0, th * 0.55) OR h < greatest(6.0, th * 0.55) THEN 'RESPONSE_TOO_SMALL_OR_OUTSIDE' WHEN ink >= 0.025 AND ink <= 0.1 THEN 'CHECKBOX_STATE_AMBIGUOUS' ELSE 'REPEATED_MEASURED_CHECKBOX' END AS reason,
 CASE WHEN ok AND NOT (x < 0 OR y < 0 OR x + w > 600 OR y + h > 130 OR w < greatest(6.0, th * 0.55) OR h < greatest(6.0, th * 0.55) OR (ink >= 0.025 AND ink <= 0.1)) THEN ink > 0.1 END AS checked FROM pl""")
def f6_boxes(fx):
    """Pages without fields; the ink of a box follows its number."""
    inked = ticks(fx).withColumn("ink_ratio", (c("box_id") % 7) * F.lit(0.02))
    nothing = fx.stored("fx_field").select("page_id", "field_id", "x", "y", "w", "h", F.lit("review").alias("status")).limit(0)
    return op.recover_checkboxes(inked, nothing, fx.stored("fx_word"), fx.fx_page, stored_heights(fx), "small|hot", BY).select("page_id", "box_id", "outcome", "reason", "checked")


@add("f15_infer_line_fields", shared="fx_token")
def f15(fx):
    lines = cut_lineage(op.writing_lines(fx.fx_line.withColumn("y", c("y") + 5), fx.fx_rect, fx.fx_token, BY))
    dated = fx.stored("fx_word").withColumn("text", F.when(c("text").like("small%"), "12/03/2020").otherwise(c("text")))
    return op.infer_line_fields(lines, dated, stored_heights(fx), BY).select("page_id", "line_id", "label", "side", "value", r4("x", "x"), r4("w", "w"))


ASKING = "CASE WHEN text LIKE '%gear' THEN concat(text, ':') WHEN text LIKE '%bolt' THEN concat(text, ': val ', text) ELSE text END"


@add("f16_unboxed_values", f"""WITH {SQL_HEIGHTS}, t AS (SELECT * EXCLUDE (text), {ASKING} AS text, is_label AND text NOT LIKE '%bolt' AS lb FROM {{fx_word}}), fr AS (SELECT t.*, {TH} AS th FROM t LEFT JOIN typical y ON y.page_id = t.page_id WHERE NOT EXISTS (SELECT 1 FROM {{fx_rect}} r WHERE r.page_id = t.page_id AND {sql_share('t', 'r')} > 0.5)),
s1 AS (SELECT page_id, token_id, regexp_extract(text, '^(.{{1,70}}?):', 1) AS label, regexp_extract(text, ': (.+)$', 1) AS value FROM fr WHERE text LIKE '%: val %'),
nx AS (SELECT * FROM (SELECT f.page_id, f.token_id, f.text AS lt, f.th, o.x AS nx, o.y AS ny, o.text AS nt, row_number() OVER (PARTITION BY f.page_id, f.token_id ORDER BY o.x, o.token_id) AS rn FROM fr f JOIN t o ON o.page_id = f.page_id AND o.token_id <> f.token_id WHERE f.lb AND NOT o.lb AND o.x >= f.x + f.w - 2 AND o.x - f.x - f.w < f.th * 3 AND abs(o.y - f.y) < f.th * 0.7) q WHERE rn = 1),
s2 AS (SELECT n.page_id, n.token_id, rtrim(any_value(n.lt), ':') AS label, string_agg(o.text, ' ' ORDER BY o.token_id) AS value FROM nx n JOIN t o ON o.page_id = n.page_id AND NOT o.lb AND o.x >= n.nx AND abs(o.y - n.ny) < n.th * 0.7 WHERE n.lt LIKE '%:' GROUP BY n.page_id, n.token_id)
SELECT page_id, token_id, label, value, 'same_word' AS how FROM s1 UNION ALL SELECT page_id, token_id, label, value, 'next_words' FROM s2""")
def f16(fx):
    token = fx.fx_word.withColumns({"is_label": c("is_label") & ~c("text").like("%bolt"), "text": F.expr(ASKING)})
    known = fx.part.where("p_name LIKE '%bolt'").select(c("p_name").alias("key")).distinct()
    return op.unboxed_values(token, fx.fx_rect, upper_heights(fx), known, BY)


@add("f17_free_space_fields", f"""WITH {SQL_HEIGHTS}, f AS (SELECT t.*, {TH} AS th, greatest(4.0, {TH} * 0.18) AS mg FROM {{fx_word}} t LEFT JOIN typical y ON y.page_id = t.page_id WHERE is_label AND NOT EXISTS (SELECT 1 FROM {{fx_rect}} r WHERE r.page_id = t.page_id AND {sql_share('t', 'r')} > 0.5)),
n AS (SELECT f.*, (SELECT min(o.x) FROM {{fx_word}} o WHERE o.page_id = f.page_id AND o.token_id <> f.token_id AND o.x > f.x + f.w AND abs(o.y - f.y) < f.th * 0.6) AS nxt FROM f),
k AS (SELECT *, x + w + mg AS fx, y - mg AS fy, coalesce(nxt - mg, least(600 * 0.92, x + w + mg + 600 * 0.35)) - (x + w + mg) AS fw, th * 1.7 AS fh FROM n)
SELECT page_id, token_id, {sql_r4('fx')} AS x, {sql_r4('fw')} AS w FROM k WHERE fw >= th * 3 AND fy >= 0 AND fy + fh <= 130""")
def f17(fx):
    return op.free_space_fields(fx.fx_word, fx.fx_rect, fx.fx_page, upper_heights(fx), BY).select("page_id", "token_id", r4("x", "x"), r4("w", "w"))


@add("f18_suppress_fields", shared="fx_token")
def f18(fx):
    prev = fx.fx_field_prev.select("page_id", (c("field_id") + 1000).alias("field_id"), "x", "y", "w", "h")
    both = fx.fx_field.select("page_id", "field_id", (c("x") - 8).alias("x"), "y", "w", "h").unionByName(prev).withColumn("ord", c("field_id") % 1000)
    return op.suppress_fields(both, fx.fx_page, BY).select("page_id", "field_id", "outcome", "reason", "duplicate_of")
