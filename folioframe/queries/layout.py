from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import layout as op
from folioframe.queries.common import BY, Catalogue, r4, sql_inter, sql_r4, sql_share

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("a1_assign_lines")
def a1(fx):
    return op.assign_lines(fx.fx_token.select("page_id", "token_id", "x", "y", "w", "h"), BY).select("page_id", "token_id", "line_no")


@add("a2_page_text", """WITH l AS (SELECT page_id, line_id, min(y) AS top, string_agg(text, ' ' ORDER BY x, token_id) AS t FROM {fx_token} GROUP BY page_id, line_id)
SELECT page_id, string_agg(t, chr(10) ORDER BY top, line_id) AS text FROM l GROUP BY page_id""")
def a2(fx):
    return op.page_text(fx.fx_token, BY)


@add("a3_document_text", """SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no, text) AS text, count(*) AS pages FROM {fx_doc_page} GROUP BY doc_id""")
def a3(fx):
    return op.document_text(fx.fx_doc_page)


@add("a4_group_words")
def a4(fx):
    token = fx.fx_token.withColumn("region_id", F.floor(F.col("x") / 290))
    return op.group_words(token, BY).select("page_id", "line_id", "region_id", "token_id", "text", "x", "w", F.size("fragment_ids").alias("words"))


@add("a5_reconstruct_text")
def a5(fx):
    return op.reconstruct_text(fx.fx_token, BY)


@add("a6_merge_colinear", shared="fx_token")
def a6(fx):
    return op.merge_colinear(fx.fx_line, fx.fx_token, BY).drop("line_ids")


@add("a7_multiline_areas", shared="fx_token")
def a7(fx):
    return op.multiline_areas(fx.fx_line, fx.fx_token, BY).withColumn("lines", F.size("line_ids")).drop("line_ids")


@add("a8_table_structure", """WITH ln AS (SELECT *, x2 - x1 AS len, is_vertical OR abs(x2 - x1) < 4 AS vertical, floor(x1 / 15 + 0.5) * 15 AS s1, floor(x2 / 15 + 0.5) * 15 AS s2 FROM {fx_line}),
tok AS (SELECT *, l_partkey % 4 = 0 AS is_prompt FROM {fx_token}),
st AS (SELECT *, y - lag(y) OVER w AS dy, row_number() OVER w AS rk FROM ln WHERE NOT vertical WINDOW w AS (PARTITION BY page_id, s1, s2 ORDER BY y, line_id)),
gr AS (SELECT page_id, s1, s2, count(*) AS n, min(y) AS y, min(x1) AS x1, max(x2) AS x2, bool_or(coalesce(dy < 18 OR dy > 120, false)) AS uneven, max(CASE WHEN rk = 2 THEN dy END) AS fdy FROM st GROUP BY page_id, s1, s2),
grid AS (SELECT * FROM gr g WHERE n >= 3 AND NOT uneven AND fdy >= 24 AND NOT EXISTS (SELECT 1 FROM tok t WHERE t.page_id = g.page_id AND g.y - (t.y + t.h) >= -2 AND g.y - (t.y + t.h) <= 35 AND t.x >= g.x1 - 40 AND t.x <= g.x2)),
pro AS (SELECT DISTINCT l.page_id, l.line_id FROM ln l JOIN tok t ON t.page_id = l.page_id AND t.is_prompt WHERE (abs(t.y + t.h * 0.8 - l.y) < 14 AND t.x + t.w <= l.x1 + 25 AND l.x1 - (t.x + t.w) < 80)
  OR (l.y - (t.y + t.h) >= -2 AND l.y - (t.y + t.h) < 24 AND t.x >= l.x1 - 30 AND t.x < l.x2)),
ins AS (SELECT DISTINCT l.page_id, l.line_id FROM ln l JOIN {fx_cell} c ON c.page_id = l.page_id WHERE c.w >= 30 AND c.h >= 16 AND l.y >= c.y - 3 AND l.y <= c.y + c.h + 3 AND l.x1 >= c.x - 8 AND l.x2 <= c.x + c.w + 8)
SELECT l.page_id, l.line_id, CASE WHEN vertical THEN 'VERTICAL' WHEN len >= p.page_w - 80 AND (l.y <= 65 OR l.y >= 780) THEN 'PAGE_RULE' WHEN pro.line_id IS NOT NULL THEN NULL WHEN grid.s1 IS NOT NULL THEN 'TABLE_GRID'
  WHEN ins.line_id IS NOT NULL THEN 'TABLE_BOX' WHEN len < 35 THEN 'MICRO_LINE' END AS reason
FROM ln l JOIN {fx_page} p ON p.page_id = l.page_id LEFT JOIN grid ON grid.page_id = l.page_id AND grid.s1 = l.s1 AND grid.s2 = l.s2
LEFT JOIN pro ON pro.page_id = l.page_id AND pro.line_id = l.line_id LEFT JOIN ins ON ins.page_id = l.page_id AND ins.line_id = l.line_id""", shared="fx_token")
def a8(fx):
    token = fx.fx_token.withColumn("is_prompt", F.col("l_partkey") % 4 == 0)
    rects = fx.fx_cell.withColumn("is_checkbox", F.lit(False))
    return op.table_structure(fx.fx_line, rects, token, fx.fx_page, BY).select("page_id", "line_id", "reason")


@add("k1_reading_order")
def k1(fx):
    return op.reading_order(fx.fx_field, BY).select("page_id", "field_id", "position")


@add("k2_retry_plan", shared="fx_token")
def k2(fx):
    return op.retry_plan(fx.fx_reader, fx.fx_token_b, fx.fx_page, BY).select(
        "page_id", "first_id", "reason", "priority", "selected", "region_no")


# bounds as the caller of a crowded form would set them; every proposal comes back, with a reason if it goes
@add("k3_cap_candidates", """WITH f AS (SELECT page_id, field_id, x, y, w, h, confidence, field_type, CASE WHEN field_id % 4 = 0 THEN concat('Riga ', label) ELSE label END AS label, field_id % 5 = 0 AS keyed FROM {fx_field}),
t AS (SELECT * FROM f UNION ALL SELECT page_id, field_id + 1000, x, y + 24, w, h, confidence, field_type, label, keyed FROM f),
m AS (SELECT *, count(*) OVER (PARTITION BY page_id) > 30 AS big, lead(field_type) OVER p AS nt, lead(y) OVER p AS ny, lead(h) OVER p AS nh, lead(x) OVER p AS nx, lead(w) OVER p AS nw FROM t WINDOW p AS (PARTITION BY page_id ORDER BY y, field_id)),
j AS (SELECT *, coalesce(field_type = 'TEXT_SHORT' AND NOT keyed AND nt = 'TEXT_SHORT' AND ny - y <= 35 AND ny > y AND abs(nx - x) <= 25 AND abs(nw - w) <= 30, false) AS jn FROM m WHERE big),
r AS (SELECT *, coalesce(sum(CASE WHEN jn THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY y, field_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM j),
a AS (SELECT *, jn AND row_number() OVER (PARTITION BY page_id, run ORDER BY y, field_id) % 2 = 1 AS absorbs FROM r),
g AS (SELECT *, coalesce(lag(absorbs) OVER (PARTITION BY page_id ORDER BY y, field_id), false) AS gone FROM a),
z AS (SELECT page_id, field_id, y, confidence, CASE WHEN absorbs AND NOT gone THEN 'TEXT_LONG' ELSE field_type END AS field_type, CASE WHEN absorbs AND NOT gone THEN floor((ny + nh - y) * 10 + 0.5) / 10 ELSE h END AS h,
  CASE WHEN gone THEN 'MERGED' WHEN confidence > 0 AND confidence < 0.85::DOUBLE AND NOT keyed AND contains(label, 'Riga') THEN 'LOW_CONFIDENCE' END AS why FROM g),
q AS (SELECT *, count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id, why IS NULL ORDER BY coalesce(confidence, 0) DESC, y, field_id) AS rn FROM z)
SELECT page_id, field_id, field_type, """ + sql_r4("h") + """ AS h, CASE WHEN why IS NULL AND n > 35 AND rn > 32 THEN 'OVER_BOUND' ELSE why END AS reason FROM q
UNION ALL SELECT page_id, field_id, field_type, """ + sql_r4("h") + """, NULL FROM m WHERE NOT big""", shared="fx_token")
def k3(fx):
    # two proposals per word, so that many pages pass the limit
    field = fx.fx_field.select("page_id", "field_id", "x", "y", "w", "h", "confidence", "field_type",
                               F.when(F.col("field_id") % 4 == 0, F.concat(F.lit("Riga "), "label")).otherwise(F.col("label")).alias("label"),
                               F.when(F.col("field_id") % 5 == 0, F.lit("key")).alias("semantic_key"))
    twice = field.unionByName(field.withColumns({"field_id": F.col("field_id") + 1000, "y": F.col("y") + 24}))
    return op.judge_candidates(twice, BY, many=30, refine_over=35, keep=32).select("page_id", "field_id", "field_type", r4("h", "h"), "reason")


@add("u2_fuse_candidates")
def u2(fx):
    field = fx.fx_field.withColumns({"ord": F.col("field_id"), "semantic_key": F.when(F.col("field_id") % 2 == 0, F.col("label"))})
    return op.fuse_candidates(field, BY)


@add("u5_second_pass_merge")
def u5(fx):
    cols = ["page_id", "field_id", "x", "y", "w", "h", "label"]
    second = fx.fx_field.select(*cols).withColumns({"field_id": F.col("field_id") + 1000, "w": F.col("w") + 20})
    return op.second_pass_merge(fx.fx_field_prev.select(*cols), second, BY).select("page_id", "field_id", "pass_no")


@add("u6_box_set_diff", shared="fx_token")
def u6(fx):
    boxes = lambda df, key: df.select("page_id", F.col(key).alias("box_id"), "x", "y", "w", "h")
    moved = fx.fx_token.where("text NOT LIKE '%bolt'").withColumn("x", F.col("x") + F.col("l_partkey") % 20)
    return op.box_set_diff(boxes(fx.fx_token.where("text NOT LIKE '%ring'"), "token_id"), boxes(moved, "token_id"), BY)
