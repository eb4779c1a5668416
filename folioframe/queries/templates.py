from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.operators import templates as op
from folioframe.operators.audit import page_scores
from folioframe.queries.audit import GEO, page_geometry
from folioframe.queries.common import BY, Catalogue
from folioframe.session import cut_lineage

CATALOGUE = Catalogue()
add = CATALOGUE.add
c = F.col

FONTS = "CASE WHEN page_id % 3 = 0 THEN 'A' WHEN page_id % 3 = 1 THEN 'A,B' ELSE 'B,C' END"


def page_fp(fx):
    """Page profiles of web hosts with hashes made from their profile columns."""
    text = lambda n: c(n).cast("bigint").cast("string")
    page = fx.fx_page_fp.withColumns({"o": F.row_number().over(Window.partitionBy("doc_key").orderBy("page_id")) - 1, "fonts": F.split(F.expr(FONTS), ","), "confidence": F.lit(1.0)})
    geometry = F.concat_ws("|", text("page_width"), text("rotation"), text("vector_count"))
    return page.withColumns({"geometry_hash": F.sha2(geometry, 256), "structure_hash": F.sha2(F.concat_ws("|", geometry, text("raster_count"), text("text_count"), F.expr(FONTS)), 256)})


def both(fx):
    """Document profiles, and the registry: every host, registered by its lowest page."""
    fp = page_fp(fx)
    doc = op.profiles(fp, "doc_key", "o")
    first = fp.groupBy("doc_key").agg(F.min("page_id").alias("ord"))
    registry = doc.join(first, "doc_key").withColumnRenamed("doc_key", "template_id").withColumns({
        "status": F.when(c("ord") % 4 == 0, "deprecated").otherwise("active"), "validity_year": 2018 + c("ord") % 7, "school_order": F.lit("A1")})
    return doc, registry


SQL_FP = f"""fp AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY page_id) - 1 AS o, {FONTS} AS fonts, concat(CAST(page_width AS BIGINT), '|', rotation, '|', vector_count) AS gh FROM {{fx_page_fp}}),
fq AS (SELECT *, concat(gh, '|', raster_count, '|', text_count, '|', fonts) AS sh FROM fp),
pc AS (SELECT doc_key, count(*) AS n, min(page_id) AS ord, string_agg(gh, ';' ORDER BY o) || '#' || string_agg(sh, ';' ORDER BY o) AS fingerprint FROM fq GROUP BY doc_key),
pp AS (SELECT a.doc_key AS d, b.doc_key AS t, abs(a.page_width - b.page_width) + abs(a.page_height - b.page_height) AS apart, a.gh = b.gh AS ge, a.sh = b.sh AS se, a.rotation = b.rotation AS ro,
  greatest(0.0, 1 - abs(a.vector_count - b.vector_count) / greatest(a.vector_count, b.vector_count, 1)) AS v, 1 - abs(a.raster_count - b.raster_count) / greatest(a.raster_count, b.raster_count, 1) AS r, 1 - abs(a.text_count - b.text_count) / greatest(a.text_count, b.text_count, 1) AS x,
  len(list_intersect(string_split(a.fonts, ','), string_split(b.fonts, ','))) / len(list_distinct(list_concat(string_split(a.fonts, ','), string_split(b.fonts, ',')))) AS f
  FROM fq a JOIN fq b ON a.o = b.o),
ps AS (SELECT d, t, CASE WHEN ge THEN 100.0::DOUBLE ELSE least(98.5::DOUBLE, floor((greatest(0.0, 1 - apart / 100) * 0.35::DOUBLE + v * 0.4::DOUBLE + CASE WHEN ro THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.15::DOUBLE + greatest(0.0, 1 - apart / 200) * 0.1::DOUBLE) * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) END AS g,
  CASE WHEN se THEN 100.0::DOUBLE ELSE least(98.5::DOUBLE, floor((v * 0.3::DOUBLE + r * 0.2::DOUBLE + x * 0.2::DOUBLE + f * 0.3::DOUBLE) * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) END AS s FROM pp),
ds AS (SELECT d, t, sum(CAST(floor(g * 100 + 0.5::DOUBLE) AS BIGINT)) AS g, sum(CAST(floor(s * 100 + 0.5::DOUBLE) AS BIGINT)) AS s, count(*) FILTER (WHERE (g + s) / 2 >= 95) AS m FROM ps GROUP BY d, t),
sc AS (SELECT ds.d AS doc_key, ds.t AS template_id, b.ord, CASE WHEN a.fingerprint = b.fingerprint THEN 100.0::DOUBLE ELSE floor((floor(ds.g / 100 / greatest(a.n, b.n) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE * 0.5::DOUBLE + floor(ds.s / 100 / greatest(a.n, b.n) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE * 0.5::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS score,
  CASE WHEN a.fingerprint = b.fingerprint THEN a.n ELSE m END AS matched_pages, greatest(a.n, b.n) AS total_pages, a.n AS an, b.n AS bn FROM ds JOIN pc a ON a.doc_key = ds.d JOIN pc b ON b.doc_key = ds.t)"""
BAND = "CASE WHEN score >= 99 THEN 'IDENTICAL' WHEN score >= 95 THEN 'COMPATIBLE' WHEN score >= 85 THEN 'DERIVED' ELSE 'DIFFERENT' END"


@add("t1_fingerprint", """WITH pr AS (SELECT page_id, 'R' AS kind, x, y, w, h FROM {fx_cell} UNION ALL SELECT page_id, 'L', x1, y, 0, 0 FROM {fx_line}),
tk AS (SELECT page_id, floor(x / 128)::BIGINT AS tx, floor(y / 128)::BIGINT AS ty, CASE WHEN kind = 'R' THEN concat_ws(':', kind, floor(x + 0.5)::BIGINT, floor(y + 0.5)::BIGINT, floor(w + 0.5)::BIGINT, floor(h + 0.5)::BIGINT) ELSE concat_ws(':', kind, floor(x + 0.5)::BIGINT, floor(y + 0.5)::BIGINT) END AS t FROM pr),
ct AS (SELECT page_id, tx, ty, t, count(*) AS n FROM tk GROUP BY ALL), tl AS (SELECT page_id, concat_ws(':', tx, ty, sha256(string_agg(concat(t, '*', n), ';' ORDER BY concat(t, '*', n)))) AS part FROM ct GROUP BY page_id, tx, ty),
g AS (SELECT page_id, sha256(string_agg(part, ';' ORDER BY part)) AS gh FROM tl GROUP BY page_id),
q AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE x < 300 AND y < 65) AS q1, count(*) FILTER (WHERE x >= 300 AND y < 65) AS q2, count(*) FILTER (WHERE x < 300 AND y >= 65) AS q3, count(*) FILTER (WHERE x >= 300 AND y >= 65) AS q4 FROM pr GROUP BY page_id)
SELECT p.page_id, coalesce(gh, sha256('EMPTY_PAGE:600x130')) AS geometry_hash, sha256(concat('600x130|0|', coalesce(n, 0), '|0|', concat_ws(',', coalesce(q1, 0), coalesce(q2, 0), coalesce(q3, 0), coalesce(q4, 0)), '|Arial')) AS structure_hash FROM {fx_page} p LEFT JOIN g ON g.page_id = p.page_id LEFT JOIN q ON q.page_id = p.page_id""")
def t1(fx):
    rect = fx.fx_cell.select("page_id", F.lit("R").alias("kind"), "x", "y", "w", "h")
    line = fx.fx_line.select("page_id", F.lit("L").alias("kind"), c("x1").alias("x"), "y", F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    page = fx.fx_page.select("page_id", c("page_w").alias("page_width"), c("page_h").alias("page_height"), F.lit(0).alias("rotation"), F.lit(0).alias("raster_count"), c("words").alias("text_count"), F.array(F.lit("Arial")).alias("fonts"))
    return op.fingerprint(rect.unionByName(line), page, BY).select("page_id", "geometry_hash", "structure_hash")


@add("t2_match_score", f"WITH {SQL_FP} SELECT doc_key, template_id, score, matched_pages, total_pages, {BAND} AS band FROM sc WHERE least(an, bn) >= greatest(an, bn) * 0.85::DOUBLE")
def t2(fx):
    doc, registry = both(fx)
    return op.match_score(doc, registry, "doc_key").select("doc_key", "template_id", "score", "matched_pages", "total_pages", "band")


@add("t3_best_template", f"""WITH {SQL_FP}, k AS (SELECT *, score + CASE WHEN 2018 + ord % 7 = 2020 THEN 5.0::DOUBLE ELSE 0.0 END AS ranking FROM sc WHERE ord % 4 <> 0)
SELECT doc_key, template_id, score, ranking FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY ranking DESC, ord) AS rn FROM k) s WHERE rn = 1""")
def t3(fx):
    doc, registry = both(fx)
    return op.best_template(doc, registry, "doc_key", preferred_year=2020).select("doc_key", "template_id", "score", "ranking")


@add("k4_top_templates", f"WITH {SQL_FP} SELECT doc_key, template_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY score DESC, ord) AS position FROM sc) s WHERE position <= 3")
def k4(fx):
    doc, registry = both(fx)
    return op.top_templates(doc, registry, 3, "doc_key").select("doc_key", "template_id", "score", c("position").cast("bigint").alias("position"))


SQL_DIFF = SQL_FP + """,
bx AS (SELECT *, CAST(least(10, greatest(1, floor((text_count + vector_count) / 5))) AS BIGINT) AS ns FROM fq),
box AS (SELECT doc_key, o, page_width, 0 AS i, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, page_width AS x1, page_height AS y1 FROM bx UNION ALL SELECT doc_key, o, page_width, i + 1, 50.0, 50 + i * ((page_height - 100) / ns), page_width - 50, 50 + i * ((page_height - 100) / ns) + (page_height - 100) / ns - 10 FROM (SELECT *, unnest(range(ns)) AS i FROM bx) q),
pq AS (SELECT a.doc_key AS s, b.doc_key AS c, a.o, a.ns + 1 AS na, b.ns + 1 AS nb, a.gh = b.gh AND a.sh = b.sh AS same, abs(a.page_width - b.page_width) + abs(a.page_height - b.page_height) AS apart,
  greatest(0.0, 1 - abs(a.vector_count - b.vector_count) / greatest(a.vector_count, b.vector_count, 1)) AS v, greatest(0.0, 1 - abs(a.text_count - b.text_count) / greatest(a.text_count, b.text_count, 1)) AS x
  FROM bx a JOIN bx b ON a.o = b.o JOIN pc ca ON ca.doc_key = a.doc_key JOIN pc cb ON cb.doc_key = b.doc_key WHERE ca.ord < cb.ord AND least(ca.n, cb.n) >= greatest(ca.n, cb.n) * 0.5),
hit AS (SELECT p.s, p.c, p.o, count(*) FILTER (WHERE abs(a.x0 - b.x0) <= 1 AND abs(a.y0 - b.y0) <= 1 AND abs(a.x1 - b.x1) <= 1 AND abs(a.y1 - b.y1) <= 1) AS eq,
  count(*) FILTER (WHERE sqrt((b.x0 - a.x0) * (b.x0 - a.x0) + (b.y0 - a.y0) * (b.y0 - a.y0)) <= 15 AND abs((b.x1 - b.x0) - (a.x1 - a.x0)) <= 20 AND abs((b.y1 - b.y0) - (a.y1 - a.y0)) <= 20 AND NOT (abs(a.x0 - b.x0) <= 1 AND abs(a.y0 - b.y0) <= 1 AND abs(a.x1 - b.x1) <= 1 AND abs(a.y1 - b.y1) <= 1)) AS sf
  FROM pq p JOIN box a ON a.doc_key = p.s AND a.o = p.o JOIN box b ON b.doc_key = p.c AND b.o = p.o AND (a.i = 0) = (b.i = 0) GROUP BY p.s, p.c, p.o),
pd AS (SELECT p.s, p.c, CASE WHEN same THEN 0 ELSE nb - eq - sf END AS added, CASE WHEN same THEN 0 ELSE na - eq - sf END AS removed, CASE WHEN same THEN 0 ELSE sf END AS shifted, na, nb,
  CASE WHEN same THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE, floor((greatest(0.0, 1 - apart / 200) * 0.2::DOUBLE + v * 0.25::DOUBLE + x * 0.25::DOUBLE + greatest(0.0, 1 - ((nb - eq - sf) + (na - eq - sf) + sf * 0.5::DOUBLE) / greatest(na, nb, 1)) * 0.3::DOUBLE) * 10000 + 0.5::DOUBLE) / 100) END AS sim
  FROM pq p JOIN hit h ON h.s = p.s AND h.c = p.c AND h.o = p.o),
tb AS (SELECT doc_key, sum(ns + 1) AS boxes FROM bx GROUP BY doc_key),
dd AS (SELECT s, c, sum(added) AS ad, sum(removed) AS rm, sum(shifted) AS sf, sum(CAST(floor(sim * 100 + 0.5::DOUBLE) AS BIGINT)) AS sim, sum(na) AS na, sum(nb) AS nb FROM pd GROUP BY s, c),
de AS (SELECT s, c, ca.ord AS s_ord, CAST(ad + tb2.boxes - nb AS BIGINT) AS added, CAST(rm + tb1.boxes - na AS BIGINT) AS removed, CAST(sf AS BIGINT) AS shifted, cb.n - ca.n AS page_count_delta, sim / 100 / greatest(ca.n, cb.n) AS avg_sim,
  CASE WHEN ca.n = cb.n THEN 0.0 ELSE least(40.0::DOUBLE, abs(cb.n - ca.n) / ca.n * 40) END AS pen, ca.fingerprint = cb.fingerprint AS exact FROM dd JOIN pc ca ON ca.doc_key = s JOIN pc cb ON cb.doc_key = c JOIN tb tb1 ON tb1.doc_key = s JOIN tb tb2 ON tb2.doc_key = c),
df AS (SELECT *, added > 0 OR removed > 0 OR shifted > 0 OR page_count_delta <> 0 AS differs FROM de),
dg AS (SELECT *, floor(CASE WHEN exact AND NOT differs THEN 100.0::DOUBLE WHEN differs THEN least(98.0::DOUBLE, greatest(0.0, avg_sim - pen)) ELSE greatest(0.0, avg_sim - pen) END * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS similarity FROM df),
dh AS (SELECT *, CASE WHEN similarity >= 99.5::DOUBLE AND NOT differs THEN 'EXACT' WHEN similarity >= 80 THEN 'SIMILAR' WHEN similarity >= 50 THEN 'DERIVED' ELSE 'UNKNOWN' END AS class, least(100.0::DOUBLE, floor((added * 3 + removed * 3 + shifted * 1.5::DOUBLE + pen) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE) AS layout_shift FROM dg)"""


def diffs(fx):
    """Difference of every earlier and later template of comparable length."""
    found = op.candidate_diffs(both(fx)[1], 0.0)
    return found.where(F.least("c_page_count", "s_page_count") >= F.greatest("c_page_count", "s_page_count") * 0.5)


@add("t4_structural_diff", f"WITH {SQL_DIFF} SELECT s AS source_id, c AS candidate_id, added, removed, shifted, page_count_delta, similarity, class, layout_shift FROM dh")
def t4(fx):
    return diffs(fx).select(c("s_template_id").alias("source_id"), c("c_template_id").alias("candidate_id"), "added", "removed", "shifted", "page_count_delta", "similarity", "class", "layout_shift")


@add("t5_evolution_report", f"""WITH {SQL_DIFF} SELECT s AS source_id, c AS candidate_id, CASE class WHEN 'EXACT' THEN 'BIND_EXISTING' WHEN 'UNKNOWN' THEN 'CREATE_NEW_CLUSTER' ELSE 'CREATE_VARIANT_IN_CLUSTER' END AS action, class IN ('SIMILAR', 'DERIVED') AS is_variant,
 concat_ws(' ', class, CASE WHEN added > 0 THEN concat('added=', added) END, CASE WHEN removed > 0 THEN concat('removed=', removed) END, CASE WHEN shifted > 0 THEN concat('shifted=', shifted) END, CASE WHEN page_count_delta <> 0 THEN concat('pages=', page_count_delta) END) AS notes FROM dh""")
def t5(fx):
    return op.evolution_report(diffs(fx)).select(c("s_template_id").alias("source_id"), c("c_template_id").alias("candidate_id"), "action", "is_variant", F.array_join("notes", " ").alias("notes"))


SQL_CLUSTER = SQL_DIFF + """,
bp AS (SELECT c, s, class FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY similarity DESC, s_ord) AS rn FROM dh) q WHERE rn = 1),
par AS (SELECT p.doc_key AS node, CASE WHEN b.class <> 'UNKNOWN' THEN b.s END AS parent FROM pc p LEFT JOIN bp b ON b.c = p.doc_key),
walk AS (SELECT node, node AS root FROM par WHERE parent IS NULL UNION ALL SELECT p.node, w.root FROM par p JOIN walk w ON w.node = p.parent)"""


@add("t6_cluster_templates", f"WITH RECURSIVE {SQL_CLUSTER} SELECT w.node AS template_id, w.root AS cluster_id, p.parent FROM walk w JOIN par p ON p.node = w.node")
def t6(fx):
    return op.cluster_templates(both(fx)[1]).select("template_id", "cluster_id", "parent")


@add("t7_cluster_registry", f"WITH RECURSIVE {SQL_CLUSTER} SELECT root AS cluster_id, count(*) AS members, max(node) AS latest_template, 'A1' AS school_order FROM walk GROUP BY root")
def t7(fx):
    registry = both(fx)[1]
    return op.cluster_registry(op.cluster_templates(registry), registry)


@add("t8_validate_template", """WITH k AS (SELECT s_suppkey AS template_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 60 AS VARCHAR) END AS fingerprint, s_suppkey % 5 AS page_count FROM supplier), r AS (SELECT fingerprint, min(template_id) AS a, max(template_id) AS b FROM k GROUP BY fingerprint)
SELECT k.template_id, concat_ws(',', CASE WHEN k.template_id % 11 = 0 THEN 'MISSING_REQUIRED_FIELDS' END, CASE WHEN page_count = 0 OR k.fingerprint IS NULL THEN 'INVALID_FINGERPRINT' END, CASE WHEN k.template_id % 7 = 0 THEN 'INCOHERENT_GEOMETRY' END, CASE WHEN k.template_id % 13 = 0 THEN 'INCOHERENT_SCHEMA' END,
 CASE WHEN page_count > 0 AND k.fingerprint IS NOT NULL AND a <> b THEN 'DUPLICATE_FINGERPRINT' END) AS issues FROM k LEFT JOIN r ON r.fingerprint = k.fingerprint""")
def t8(fx):
    k = c("s_suppkey")
    cand = fx.supplier.select(k.alias("template_id"), F.when(k % 9 != 0, (k % 60).cast("string")).alias("fingerprint"), (k % 5).alias("page_count"), (k % 5).alias("pages_listed"),
                              (k % 11 != 0).alias("readable"), (k % 7 != 0).alias("has_geometry"), (k % 13 != 0).alias("has_schema"))
    return op.validate_template(cand, cand.select("template_id", "fingerprint")).select("template_id", F.array_join("issues", ",").alias("issues"))


@add("t9_register", """WITH b AS (SELECT c_custkey AS template_id, c_custkey AS ord, c_custkey % 700 AS fingerprint FROM customer), r AS (SELECT DISTINCT fingerprint FROM {fx_registry})
SELECT template_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS rn FROM b WHERE fingerprint NOT IN (SELECT fingerprint FROM r)) s WHERE rn = 1""")
def t9(fx):
    batch = fx.customer.select(c("c_custkey").alias("template_id"), c("c_custkey").alias("ord"), (c("c_custkey") % 700).alias("fingerprint"))
    return op.register(batch, fx.fx_registry).select("template_id", "fingerprint")


STATUS = "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'active' WHEN 'error' THEN 'deprecated' WHEN 'signup' THEN 'archived' ELSE 'active' END"


@add("t10_registry_status", f"""SELECT template_id, status, events FROM (SELECT user_id AS template_id, {STATUS} AS status, count(*) OVER (PARTITION BY user_id) AS events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) s WHERE rn = 1""")
def t10(fx):
    log = fx.events.select(c("user_id").alias("template_id"), F.expr(STATUS).alias("status"), "ts", "event_id")
    return op.registry_status(log).select("template_id", "status", "events")


def status_log(fx):
    return fx.events.select(c("user_id").alias("template_id"), F.expr(STATUS).alias("status"), c("ts").cast("timestamp").alias("ts"), "event_id")


SQL_PERIODS = f"""lg AS (SELECT user_id AS template_id, {STATUS} AS status, CAST(ts AS TIMESTAMP) AS ts, event_id FROM events),
one AS (SELECT template_id, ts, status FROM (SELECT *, row_number() OVER (PARTITION BY template_id, ts ORDER BY event_id DESC) AS rn FROM lg) q WHERE rn = 1),
bg AS (SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY template_id ORDER BY ts) AS before FROM one) q WHERE before IS NULL OR before <> status),
pd AS (SELECT template_id, status, ts AS valid_from, lead(ts) OVER (PARTITION BY template_id ORDER BY ts) AS valid_to FROM bg)"""


@add("t10_status_periods", f"WITH {SQL_PERIODS} SELECT template_id, status, CAST(epoch_us(valid_from) AS BIGINT) AS valid_from, CAST(epoch_us(valid_to) AS BIGINT) AS valid_to FROM pd")
def t10_periods(fx):
    micros = lambda n: F.unix_micros(n).alias(n)
    return op.status_periods(status_log(fx)).select("template_id", "status", micros("valid_from"), micros("valid_to"))


@add("t10_registry_views", f"""WITH k AS (SELECT * FROM (SELECT user_id AS template_id, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) s WHERE rn = 1)
SELECT template_id, status, CASE status WHEN 'active' THEN 'active' WHEN 'deprecated' THEN 'archive' WHEN 'archived' THEN 'archive' ELSE 'other' END AS view FROM k""")
def t10_views(fx):
    return op.registry_views(status_log(fx)).select("template_id", "status", "view")


@add("t10_status_history", f"""WITH {SQL_PERIODS}, mo AS (SELECT DISTINCT date_trunc('day', CAST(ts AS TIMESTAMP)) AS moment FROM events), st AS (SELECT DISTINCT status FROM pd)
SELECT st.status, CAST(epoch_us(mo.moment) AS BIGINT) AS moment, count(pd.template_id) AS templates FROM st CROSS JOIN mo LEFT JOIN pd ON pd.status = st.status AND pd.valid_from <= mo.moment AND (pd.valid_to IS NULL OR pd.valid_to > mo.moment) GROUP BY ALL""")
def t10_history(fx):
    """Counts by status at the beginning of every day with an event."""
    log = status_log(fx)
    days = log.select(F.date_trunc("day", "ts").alias("moment"))
    return op.status_history(op.status_periods(log), days).select("status", F.unix_micros("moment").alias("moment"), "templates")


@add("t9_register_valid", """WITH b AS (SELECT c_custkey AS template_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 700 AS VARCHAR) END AS fingerprint, c_custkey % 5 AS pages, c_custkey % 11 <> 0 AS readable FROM customer), r AS (SELECT DISTINCT CAST(fingerprint AS VARCHAR) AS fingerprint FROM {fx_registry}),
k AS (SELECT b.*, concat_ws(',', CASE WHEN NOT readable THEN 'MISSING_REQUIRED_FIELDS' END, CASE WHEN pages = 0 OR b.fingerprint IS NULL THEN 'INVALID_FINGERPRINT' END, CASE WHEN pages > 0 AND r.fingerprint IS NOT NULL THEN 'DUPLICATE_FINGERPRINT' END) AS issues FROM b LEFT JOIN r USING (fingerprint)),
v AS (SELECT *, CASE WHEN issues = '' THEN row_number() OVER (PARTITION BY issues = '', fingerprint ORDER BY template_id) END AS rn FROM k)
SELECT template_id, CASE WHEN rn > 1 THEN 'DUPLICATE_IN_BATCH' WHEN rn = 1 THEN 'accepted' ELSE issues END AS outcome FROM v""")
def t9_valid(fx):
    k = c("c_custkey")
    batch = fx.customer.select(k.alias("template_id"), k.alias("ord"), F.when(k % 9 != 0, (k % 700).cast("string")).alias("fingerprint"), (k % 5).alias("page_count"), (k % 5).alias("pages_listed"),
                               (k % 11 != 0).alias("readable"), F.lit(True).alias("has_geometry"), F.lit(True).alias("has_schema"))
    known = fx.fx_registry.select((-c("template_id").cast("bigint")).alias("template_id"), c("fingerprint").cast("string").alias("fingerprint"))
    accepted, refused = op.register_valid(batch, known)
    return accepted.select("template_id", F.lit("accepted").alias("outcome")).unionByName(refused.select("template_id", F.array_join("issues", ",").alias("outcome")))


@add("t7_families_after_changes", f"WITH RECURSIVE {SQL_CLUSTER} SELECT root AS cluster_id, count(*) AS members, max(node) AS latest_template FROM walk GROUP BY root")
def t7_changes(fx):
    """Families of two thirds of the templates, after which another third came and one third had gone and come back: those of all."""
    registry = cut_lineage(both(fx)[1], plain=True)
    third = F.pmod(F.crc32("template_id"), F.lit(3))
    some, others = registry.where(third < 2), registry.where(third > 0)
    family = op.update_families(op.cluster_templates(some), others, some)
    family = op.update_families(cut_lineage(family), registry, others)
    return op.cluster_registry(family, registry).select("cluster_id", "members", "latest_template")


SQL_DECIDE = """d AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS page_count, 20 + o_custkey % 81 AS geo, (o_orderkey % 50) / 50 AS sure, 60.0::DOUBLE + o_custkey % 41 AS sim, o_totalprice AS ms FROM orders),
k AS (SELECT *, CASE WHEN page_count < 1 OR geo < 30 OR sure < 0.4::DOUBLE THEN 'REJECT' WHEN sim >= 99 THEN 'BIND_CANONICAL' WHEN sim >= 90 THEN 'NORMALIZE_TO_TEMPLATE' WHEN sim >= 75 THEN 'REGISTER_VARIANT' ELSE 'CREATE_NEW_CLUSTER' END AS decision,
 CASE WHEN page_count < 1 THEN 'TOO_FEW_PAGES' WHEN geo < 30 THEN 'GEOMETRY_BELOW_THRESHOLD' WHEN sure < 0.4::DOUBLE THEN 'CONFIDENCE_BELOW_THRESHOLD' WHEN sim >= 99 THEN 'SIMILARITY_BIND' WHEN sim >= 90 THEN 'SIMILARITY_NORMALISE' WHEN sim >= 75 THEN 'SIMILARITY_VARIANT' ELSE 'SIMILARITY_NEW' END AS decision_reason FROM d)"""


def decided(fx):
    o = fx.orders.select(c("o_orderkey").alias("doc_id"), (c("o_orderkey") % 6).alias("page_count"), (20 + c("o_custkey") % 81).cast("double").alias("geometry_score"), ((c("o_orderkey") % 50) / 50).alias("confidence"),
                         (60.0 + c("o_custkey") % 41).alias("similarity"), c("o_totalprice").alias("elapsed_ms"), (c("o_orderkey") % 3).alias("warnings"))
    return op.decide(o)


@add("t11_decide", f"WITH {SQL_DECIDE} SELECT doc_id, decision, decision_reason, CASE WHEN decision = 'REJECT' THEN 0.0 ELSE sim END AS decided_similarity FROM k")
def t11(fx):
    return decided(fx).select("doc_id", "decision", "decision_reason", "decided_similarity")


@add("t12_action_plan", f"""WITH {SQL_DECIDE}, st AS (SELECT * FROM (VALUES ('BIND_CANONICAL', 1, 'OPEN_CANONICAL_TEMPLATE'), ('BIND_CANONICAL', 2, 'BIND_DIRECT_LAYOUT'), ('BIND_CANONICAL', 3, 'HANDOVER_TO_R10'), ('NORMALIZE_TO_TEMPLATE', 1, 'LOAD_TARGET_TEMPLATE'), ('NORMALIZE_TO_TEMPLATE', 2, 'BUILD_NORMALIZATION_PLAN'),
 ('NORMALIZE_TO_TEMPLATE', 3, 'PREPARE_NORMALIZATION_EXECUTION'), ('NORMALIZE_TO_TEMPLATE', 4, 'HANDOVER_TO_R10'), ('REGISTER_VARIANT', 1, 'LOCATE_ANCESTOR_CLUSTER'), ('REGISTER_VARIANT', 2, 'CREATE_STRUCTURAL_VARIANT_SPEC'), ('REGISTER_VARIANT', 3, 'REGISTER_VARIANT_IN_CATALOG'), ('REGISTER_VARIANT', 4, 'HANDOVER_TO_R10'),
 ('CREATE_NEW_CLUSTER', 1, 'INITIALIZE_NEW_CLUSTER'), ('CREATE_NEW_CLUSTER', 2, 'REGISTER_CANONICAL_ROOT_TEMPLATE'), ('CREATE_NEW_CLUSTER', 3, 'HANDOVER_TO_R10'), ('REJECT', 1, 'HALT_PROCESSING_PIPELINE'), ('REJECT', 2, 'GENERATE_DIAGNOSTIC_REJECTION_REPORT')) t(decision, step_no, code))
SELECT doc_id, decision, step_no, code FROM k JOIN st USING (decision)""")
def t12(fx):
    return op.action_plan(decided(fx)).select("doc_id", "decision", "step_no", "code")


@add("t13_normalisation_plan", f"""WITH {GEO}, n AS (SELECT o.page_id, CASE WHEN o.page_id % 11 = 0 THEN 90 ELSE 0 END AS rot, skew, persp, ps, width, height, (o.page_id % 3 - 1) * 0.75::DOUBLE AS dx, (o.page_id % 2) * 0.25::DOUBLE AS dy, ml, mr, mt, mb, greatest(0.0, 100 - abs(ml - mr) / greatest(ml + mr, 1.0) * 100) AS sym FROM o),
sc AS (SELECT *, floor(least(595.32::DOUBLE / width, 841.92::DOUBLE / height) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS scale FROM n),
l AS (SELECT page_id, 1 AS k, 'rotate' AS operation, -90.0 AS value FROM sc WHERE rot <> 0 UNION ALL SELECT page_id, 2, 'deskew', floor(-skew * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE FROM sc WHERE abs(skew) >= 0.05::DOUBLE UNION ALL SELECT page_id, 3, 'perspective', persp FROM sc WHERE persp >= 0.1::DOUBLE OR ps < 98
 UNION ALL SELECT page_id, 4, 'translate', CASE WHEN abs(dx) >= 0.5 THEN floor(-dx * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE ELSE 0 END FROM sc WHERE abs(dx) >= 0.5 OR abs(dy) >= 0.5 UNION ALL SELECT page_id, 5, 'scale', scale FROM sc WHERE abs(scale - 1) >= 0.005::DOUBLE UNION ALL SELECT page_id, 6, 'margin_adjustment', 36 - ml FROM sc WHERE floor(sym * 10 + 0.5) / 10 < 85 OR abs(ml - mr) >= 5 OR abs(mt - mb) >= 5)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS step_no, operation, value::DOUBLE AS value FROM l""")
def t13(fx):
    return planned(fx)[0].select("page_id", "step_no", "operation", "value")


def planned(fx):
    """Operations of every page, and the pages."""
    p = c("page_id")
    page = page_scores(page_geometry(fx)).select(
        "page_id", "width", "height", F.when(p % 11 == 0, 90).otherwise(0).alias("rotation"), "skew", "perspective", "perspective_score", ((p % 3 - 1) * 0.75).alias("shift_x"), ((p % 2) * 0.25).alias("shift_y"),
        "symmetry", "margin_left", "margin_right", "margin_top", "margin_bottom")
    return op.normalisation_plan(page), page


@add("t13_expected_scores", f"""WITH {GEO}, n AS (SELECT o.page_id, CASE WHEN o.page_id % 11 = 0 THEN 90 ELSE 0 END AS rot, skew, persp, ps, width, height, (o.page_id % 3 - 1) * 0.75::DOUBLE AS dx, (o.page_id % 2) * 0.25::DOUBLE AS dy, ml, mr, mt, mb, greatest(0.0, 100 - abs(ml - mr) / greatest(ml + mr, 1.0) * 100) AS sym FROM o),
sc AS (SELECT *, floor(least(595.32::DOUBLE / width, 841.92::DOUBLE / height) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS scale FROM n),
l AS (SELECT page_id, 1 AS k, 'rotate' AS operation, -90.0 AS value FROM sc WHERE rot <> 0 UNION ALL SELECT page_id, 2, 'deskew', floor(-skew * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE FROM sc WHERE abs(skew) >= 0.05::DOUBLE UNION ALL SELECT page_id, 3, 'perspective', persp FROM sc WHERE persp >= 0.1::DOUBLE OR ps < 98
 UNION ALL SELECT page_id, 4, 'translate', CASE WHEN abs(dx) >= 0.5 THEN floor(-dx * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE ELSE 0 END FROM sc WHERE abs(dx) >= 0.5 OR abs(dy) >= 0.5 UNION ALL SELECT page_id, 5, 'scale', scale FROM sc WHERE abs(scale - 1) >= 0.005::DOUBLE UNION ALL SELECT page_id, 6, 'margin_adjustment', 36 - ml FROM sc WHERE floor(sym * 10 + 0.5) / 10 < 85 OR abs(ml - mr) >= 5 OR abs(mt - mb) >= 5),
k AS (SELECT page_id, count(*) AS n FROM l GROUP BY page_id), pg AS (SELECT page_id, 60.0::DOUBLE + page_id % 41 AS g, (page_id % 50) / 50.0::DOUBLE AS c FROM sc)
SELECT pg.page_id, CAST(coalesce(n, 0) AS BIGINT) AS operations, n IS NOT NULL AS requires_correction, CASE WHEN n IS NOT NULL THEN 99.0::DOUBLE ELSE greatest(g, 98.0::DOUBLE) END AS expected_geometry,
 CASE WHEN n IS NOT NULL THEN floor(least(0.99::DOUBLE, c + 0.03::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE ELSE c END AS estimated_confidence FROM pg LEFT JOIN k ON k.page_id = pg.page_id""")
def t13_scores(fx):
    plan, page = planned(fx)
    scored = page.select("page_id", (F.lit(60.0) + c("page_id") % 41).alias("geometry_score"), ((c("page_id") % 50) / F.lit(50.0)).alias("confidence"))
    return op.expected_scores(scored, plan, BY)


@add("t14_readiness", """WITH t AS (SELECT s_suppkey AS template_id, s_suppkey % 6 = 0 AS built_in, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'REVIEW_REQUIRED' ELSE 'CALIBRATED' END AS cs, CAST(s_suppkey % 10 AS VARCHAR) AS sha FROM supplier),
s AS (SELECT 2 * s_suppkey AS template_id, CASE WHEN s_suppkey % 3 = 0 THEN 'REVIEW_REQUIRED' ELSE 'CALIBRATED' END AS ss, CAST(s_suppkey % 20 AS VARCHAR) AS sha2 FROM supplier)
SELECT template_id, CASE WHEN built_in THEN NULL WHEN ss IS NULL AND cs IS NULL THEN 'TEMPLATE_SOURCE_MISSING' WHEN coalesce(ss, cs) <> 'CALIBRATED' THEN 'MODEL_CALIBRATION_REQUIRED' WHEN sha <> sha2 THEN 'TEMPLATE_INTEGRITY_MISMATCH' END AS error_code FROM t LEFT JOIN s USING (template_id)""")
def t14(fx):
    k = c("s_suppkey")
    t = fx.supplier.select(k.alias("template_id"), (k % 6 == 0).alias("built_in"), F.when(k % 4 == 0, None).when(k % 4 == 1, "REVIEW_REQUIRED").otherwise("CALIBRATED").alias("calibration_status"), (k % 10).cast("string").alias("sha256"))
    s = fx.supplier.select((2 * k).alias("template_id"), F.when(k % 3 == 0, "REVIEW_REQUIRED").otherwise("CALIBRATED").alias("calibration_status"), (k % 20).cast("string").alias("sha256"))
    return op.readiness(t, s).select("template_id", "error_code")


@add("t15_schema_from_candidates", """WITH f AS (SELECT *, field_id % 8 AS k, h + 30 AS h2 FROM {fx_field_prev} WHERE calibration_status <> 'REJECTED'), t AS (SELECT *, CASE k WHEN 0 THEN 'TEXT_SHORT' WHEN 1 THEN 'TABLE' WHEN 2 THEN 'DATE' WHEN 3 THEN 'MULTI_CHOICE' WHEN 4 THEN CASE WHEN h2 > 45 THEN 'TEXT_LONG' ELSE 'TEXT_SHORT' END ELSE CASE WHEN h2 > 40 THEN 'TEXT_LONG' ELSE 'TEXT_SHORT' END END AS ft FROM f)
SELECT page_id, field_id, ft AS field_type, CASE WHEN field_id % 5 = 0 THEN 'CONTINUABLE' WHEN ft = 'TABLE' THEN 'EXPANDABLE_OR_TABULAR' ELSE 'RIGID' END AS overflow_policy FROM t""")
def t15(fx):
    k = c("field_id") % 8
    cand = fx.fx_field_prev.withColumns({"h": c("h") + 30, "field_type": F.when(k == 0, "CMP-01").when(k == 1, "table").when(k == 2, "DATE").when(k == 3, "checkbox").when(k == 4, "other"), "overflow_policy": F.when(c("field_id") % 5 == 0, "CONTINUABLE").otherwise("CLIP")})
    return op.schema_from_candidates(cand).select("page_id", "field_id", "field_type", "overflow_policy")


@add("t16_exact_dedupe", """WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), f AS (SELECT sha, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY sha), kn AS (SELECT sha256(text) AS sha, min(item_id) AS template_id FROM (SELECT text, doc_id AS item_id FROM documents WHERE n_chars > 15000) q GROUP BY sha256(text))
SELECT h.doc_id, f.first_id, f.copies, CASE WHEN kn.sha IS NOT NULL THEN 'known' WHEN f.first_id <> h.doc_id THEN 'copy' ELSE 'new' END AS route FROM h JOIN f USING (sha) LEFT JOIN kn USING (sha)""")
def t16(fx):
    known = fx.documents.where("n_chars > 15000").select(F.sha2("text", 256).alias("sha256"), c("doc_id").alias("template_id"))
    return op.exact_dedupe(fx.documents, known, "doc_id", "text").select("doc_id", "first_id", "copies", "route")


@add("t17_corpus_integrity", """WITH f AS (SELECT CASE WHEN url LIKE '%#top' THEN concat('new-', page_id) ELSE CAST(page_id AS VARCHAR) END AS path, sha256(html) AS sha, length(html) AS size FROM pages), m AS (SELECT CASE WHEN url LIKE '%page=%' THEN concat('old-', page_id) ELSE CAST(page_id AS VARCHAR) END AS path, sha256(CASE WHEN url LIKE 'http://%' THEN html || ' ' ELSE html END) AS sha, length(html) AS size FROM pages)
SELECT coalesce(m.path, f.path) AS path, CASE WHEN f.sha IS NULL THEN 'missing' WHEN m.sha IS NULL THEN 'extra' WHEN f.sha = m.sha AND f.size = m.size THEN 'ok' ELSE 'changed' END AS state FROM m FULL OUTER JOIN f ON f.path = m.path""")
def t17(fx):
    """Some pages lie under a new name, some are listed under an old one, and pages served without encryption were changed after they were listed."""
    name = lambda moved, prefix: F.when(moved, F.concat(F.lit(prefix), c("page_id").cast("string"))).otherwise(c("page_id").cast("string"))
    rows = lambda df, path, content: df.select(path.alias("path"), F.sha2(content, 256).alias("sha256"), F.length("html").alias("size"))
    files = rows(fx.pages, name(c("url").like("%#top"), "new-"), c("html"))
    listed = rows(fx.pages, name(c("url").like("%page=%"), "old-"), F.when(c("url").like("http://%"), F.concat("html", F.lit(" "))).otherwise(c("html")))
    return op.corpus_integrity(files, listed)


@add("t18_corpus_report", f"""WITH {SQL_DECIDE}, s AS (SELECT *, CASE WHEN decision = 'REJECT' THEN 'rejected' WHEN doc_id % 3 > 0 THEN 'warning' ELSE 'success' END AS status FROM k)
SELECT decision, status, count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages FROM s GROUP BY ROLLUP (decision, status)""")
def t18(fx):
    return op.corpus_report(decided(fx)).drop("elapsed_ms")


@add("t18_phase_report", f"""WITH {SQL_DECIDE}, ph AS (SELECT o_orderkey AS doc_id, CASE n WHEN 0 THEN 'analysis' WHEN 1 THEN 'matching' ELSE 'execution' END AS phase, CAST((o_custkey * (n + 1)) % 500 AS DOUBLE) AS ms FROM orders, (VALUES (0), (1), (2)) v(n)),
r AS (SELECT k.doc_id, decision, phase, ms FROM (SELECT DISTINCT doc_id, decision FROM k) k JOIN (SELECT DISTINCT doc_id, phase, ms FROM ph) ph USING (doc_id)),
g AS (SELECT decision, phase, count(DISTINCT doc_id) AS documents, sum(ms) AS ms FROM r GROUP BY decision, phase UNION ALL SELECT decision, NULL, count(DISTINCT doc_id), sum(ms) FROM r GROUP BY decision), w AS (SELECT decision, sum(ms) AS a FROM r GROUP BY decision)
SELECT decision, phase, documents, floor(ms * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS ms, floor(ms / documents * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS mean_ms, CASE WHEN a > 0 THEN floor(ms / a * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS share FROM g JOIN w USING (decision)""")
def t18_phases(fx):
    names = F.array(*map(F.lit, ("analysis", "matching", "execution")))
    phase = fx.orders.select(c("o_orderkey").alias("doc_id"), "o_custkey", F.posexplode(names).alias("n", "phase")).select("doc_id", "phase", ((c("o_custkey") * (c("n") + 1)) % 500).cast("double").alias("ms")).distinct()
    return op.phase_report(decided(fx).select("doc_id", "decision").distinct(), phase)
