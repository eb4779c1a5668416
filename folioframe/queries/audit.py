from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import audit as op
from folioframe.operators import registry as reg
from folioframe.operators.geometry import is_protected, rebuild_page, validate_geometry
from folioframe.queries.common import BY, Catalogue, r4, sql_r4
from folioframe.queries.geometry import CATALOGUE as GEOMETRY
from folioframe.queries.geometry import PROTECTED

CATALOGUE = Catalogue()
add = CATALOGUE.add
c = F.col


@add("p1_classify_page", """SELECT doc_key, count(*) AS pages, count(*) FILTER (WHERE k = 'n') AS native, count(*) FILTER (WHERE k = 'i') AS image_only, count(*) FILTER (WHERE k = 'm') AS mixed FROM (
SELECT doc_key, CASE WHEN nc > 0 AND raster_count = 0 THEN 'n' WHEN nc = 0 THEN 'i' ELSE 'm' END AS k FROM (SELECT *, CASE WHEN page_id % 5 = 0 THEN 0 ELSE text_count END AS nc FROM {fx_page_fp}) t) s GROUP BY doc_key""")
def p1(fx):
    raw = fx.fx_page_fp.withColumn("native_chars", F.when(c("page_id") % 5 == 0, 0).otherwise(c("text_count")))
    return op.page_type_counts(raw, ("doc_key",))


@add("s5_detect_format", """SELECT format, count(*) AS files FROM (SELECT CASE WHEN n LIKE '%.pdf' THEN 'PDF' WHEN n LIKE '%.jpg' OR n LIKE '%.jpeg' THEN 'IMAGE_JPEG' WHEN n LIKE '%.png' OR mime = 'image/png' THEN 'IMAGE_PNG' WHEN n LIKE '%.tif' OR n LIKE '%.tiff' THEN 'IMAGE_TIFF'
 WHEN n LIKE '%.docx' THEN 'DOCX' WHEN n LIKE '%.doc' THEN 'UNSUPPORTED_LEGACY_DOC' ELSE 'UNKNOWN' END AS format FROM (
 SELECT lower(concat(url, CASE page_id % 9 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.tif' WHEN 3 THEN '.docx' WHEN 4 THEN '.doc' WHEN 5 THEN '.jpg' ELSE '' END)) AS n, CASE WHEN page_id % 9 = 6 THEN 'image/png' END AS mime FROM pages) t) s GROUP BY format""")
def s5(fx):
    k = c("page_id") % 9
    ending = F.when(k == 0, ".PDF").when(k == 1, ".jpeg").when(k == 2, ".tif").when(k == 3, ".docx").when(k == 4, ".doc").when(k == 5, ".jpg").otherwise("")
    files = fx.pages.select(F.concat("url", ending).alias("name"), F.when(k == 6, "image/png").alias("mime"))
    return op.detect_format(files).groupBy("format").agg(F.count(F.lit(1)).alias("files"))


@add("s9_concat_inputs", """WITH f AS (SELECT doc_key, page_id, page_id % 3 AS file_no, row_number() OVER (PARTITION BY doc_key, page_id % 3 ORDER BY page_id) AS page_no FROM {fx_page_fp})
SELECT doc_key, page_id, row_number() OVER (PARTITION BY doc_key ORDER BY file_no, page_no) AS doc_page_no FROM f""")
def s9(fx):
    from pyspark.sql import Window
    w = Window.partitionBy("doc_key", "file_no").orderBy("page_id")
    files = fx.fx_page_fp.withColumn("file_no", c("page_id") % 3).withColumn("page_no", F.row_number().over(w))
    return op.concat_inputs(files, ("doc_key",)).select("doc_key", "page_id", "doc_page_no")


@add("a12_reason_counts", "WITH d AS (" + GEOMETRY.oracles["p3_validate_geometry"] + """) SELECT page_id, CASE WHEN reason IS NULL THEN 'proposed' ELSE 'excluded' END AS outcome, CASE WHEN reason IS NULL THEN 'proposal' ELSE 'geometry' END AS category, reason, count(*) AS decisions FROM d GROUP BY page_id, reason""")
def a12(fx):
    d = validate_geometry(fx.fx_field, fx.fx_page, BY)
    ok = c("reason").isNull()
    return op.reason_counts(d.withColumn("outcome", F.when(ok, "proposed").otherwise("excluded")).withColumn(
        "category", F.when(ok, "proposal").otherwise("geometry")), BY)


@add("a12_reading_observations", """SELECT page_id, count(*) AS words, count(*) FILTER (WHERE conf < 45) AS low_confidence, count(*) FILTER (WHERE w * 6 > 600 * 0.65 AND w * 6 > h * greatest(2.0, length(text) * 0.85)) AS oversized FROM {fx_token} GROUP BY page_id""")
def a12b(fx):
    return op.reading_observations(fx.fx_token.withColumn("w", c("w") * 6), fx.fx_page, BY)


@add("a13_status_counts", """WITH f AS (SELECT page_id, CASE WHEN field_id % 3 = 0 THEN NULL ELSE calibration_status END AS s, CASE WHEN field_id % 3 = 0 THEN 'MANUAL_VERIFIED' ELSE derivation END AS d FROM {fx_field_prev})
SELECT page_id, count(*) FILTER (WHERE s = 'PROPOSED') AS proposed, count(*) FILTER (WHERE s = 'CONFIRMED' OR (s IS NULL AND d = 'MANUAL_VERIFIED')) AS confirmed, count(*) FILTER (WHERE s = 'MODIFIED') AS modified, count(*) FILTER (WHERE s = 'REJECTED') AS rejected FROM f GROUP BY page_id""")
def a13(fx):
    third = c("field_id") % 3 == 0
    f = fx.fx_field_prev.withColumns({"calibration_status": F.when(~third, c("calibration_status")),
                                      "derivation": F.when(third, "MANUAL_VERIFIED").otherwise(c("derivation"))})
    return op.status_counts(f, BY)


@add("a14_section_completion", """WITH doc AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS model FROM orders), sec AS (SELECT p_partkey % 3 AS model, p_partkey % 20 AS section_id, p_partkey AS field_id FROM part),
sz AS (SELECT model, section_id, count(*) AS fields FROM sec GROUP BY model, section_id), v AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS field_id FROM lineitem WHERE l_returnflag = 'A'),
done AS (SELECT v.doc_id, s.section_id, count(*) AS n FROM v JOIN doc d ON d.doc_id = v.doc_id JOIN sec s ON s.model = d.model AND s.field_id = v.field_id GROUP BY v.doc_id, s.section_id)
SELECT d.doc_id, z.section_id, z.fields, coalesce(n, 0) AS completed, CASE WHEN n = z.fields THEN 'complete' WHEN n > 0 THEN 'partial' ELSE 'empty' END AS state
FROM doc d JOIN sz z ON z.model = d.model LEFT JOIN done x ON x.doc_id = d.doc_id AND x.section_id = z.section_id""")
def a14(fx):
    document = fx.orders.select(c("o_orderkey").alias("doc_id"), (c("o_orderkey") % 3).alias("model"))
    section = fx.part.select((c("p_partkey") % 3).alias("model"), (c("p_partkey") % 20).alias("section_id"), c("p_partkey").alias("field_id"))
    value = fx.lineitem.select(c("l_orderkey").alias("doc_id"), c("l_partkey").alias("field_id"), F.when(c("l_returnflag") == "A", "compilato").alias("status"))
    return op.section_completion(document, section, value)


@add("a15_calculated_fields", """WITH def AS (SELECT * FROM (VALUES ('sum_a', 'p1'), ('sum_a', 'p2'), ('sum_a', 'p3'), ('sum_b', 'p2'), ('sum_b', 'p4'), ('sum_b', 'p6')) AS t(target_id, field_id)),
v AS (SELECT doc_id, concat('p', page_no) AS field_id, CASE WHEN role = 'user' THEN CAST(length(text) AS VARCHAR) ELSE text END AS value FROM {fx_doc_page})
SELECT doc_id, target_id, sum(coalesce(try_cast(value AS DOUBLE), 0.0)) AS total FROM v JOIN def USING (field_id) GROUP BY doc_id, target_id""")
def a15(fx):
    defs = fx.spark.createDataFrame([("sum_a", ["p1", "p2", "p3"]), ("sum_b", ["p2", "p4", "p6"])], "target_id string, source_field_ids array<string>")
    v = fx.fx_doc_page.select("doc_id", F.concat(F.lit("p"), c("page_no").cast("string")).alias("field_id"),
                              F.when(c("role") == "user", F.length("text").cast("string")).otherwise(c("text")).alias("value"))
    return op.calculated_fields(defs, v)


@add("a15_progress_share", """SELECT doc_id, count(*) FILTER (WHERE role = 'user') AS completed, greatest(count(*), 12) AS monitored, least(100, CAST(floor(count(*) FILTER (WHERE role = 'user') / greatest(count(*), 12) * 100 + 0.5) AS BIGINT)) AS percent FROM {fx_doc_page} GROUP BY doc_id""")
def a15b(fx):
    return op.progress_share(fx.fx_doc_page.withColumn("status", F.when(c("role") == "user", "compilato").otherwise("vuoto")))


QUALITY = """q AS (SELECT doc_id, CAST(floor((40 + doc_id % 60) * 0.55::DOUBLE + 0.5) AS BIGINT) AS confidence_score,
 least(25, 2 * len(list_filter(string_split_regex(text, '\\r?\\n'), lambda s: length(regexp_replace(s, '[^A-Za-zÀ-ÿ0-9]', '', 'g')) >= 4))) AS density_score,
 least(20, CAST(floor(sqrt(len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{3,}'))) * 2 + 0.5) AS BIGINT)) AS structure_score,
 least(25, greatest(0, len(list_filter(string_split_regex(text, '\\s+'), lambda s: regexp_matches(s, '^[A-Za-z0-9]$'))) - 10) + greatest(0, length(regexp_replace(text, '[^~|\\\\{}_^<>]', '', 'g')) - 4)) AS noise FROM documents),
g AS (SELECT *, greatest(0, least(100, confidence_score + density_score + structure_score - noise)) AS quality FROM q)"""


@add("a16_text_quality", f"WITH {QUALITY.replace('{3,}', '{{3,}}').replace('{}_', '{{}}_')} SELECT * FROM g".replace("{{", "{").replace("}}", "}"))
def a16(fx):
    d = fx.documents.withColumn("conf", (40 + c("doc_id") % 60).cast("double"))
    q = op.text_quality(d)
    return q.select("doc_id", *[c(k).cast("bigint").alias(k) for k in ("confidence_score", "density_score", "structure_score", "noise", "quality")])


@add("a17_best_variant", """WITH r AS (SELECT doc_id, v AS variant, (coalesce(length(text), 0) * 7 + v * 13) % 50 AS quality FROM documents, (VALUES (0), (1), (2), (3)) t(v))
SELECT doc_id, variant, quality FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, variant) AS rn FROM r) s WHERE rn = 1""")
def a17(fx):
    r = fx.documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.explode(F.array(*map(F.lit, range(4)))).alias("variant"))
    return op.best_variant(r.withColumn("quality", (c("n") * 7 + c("variant") * 13) % 50).drop("n"))


@add("a18_page_confidence", f"""SELECT page_id, {sql_r4('avg(CASE WHEN l_partkey % 11 = 0 THEN 0.0 ELSE conf END)')} AS confidence FROM {{fx_token}} GROUP BY page_id""")
def a18(fx):
    t = fx.fx_token.withColumn("conf", F.when(c("l_partkey") % 11 != 0, c("conf")))
    return op.page_confidence(t, BY).select("page_id", r4("confidence", "confidence"))


def page_geometry(fx):
    p = c("page_id")
    return fx.fx_page_fp.select(
        "doc_key", "page_id", c("page_width").alias("width"), c("page_height").alias("height"), ((p % 7 - 3) / 8).alias("skew"), ((p % 5) / 4).alias("perspective"),
        (30 + p % 9).cast("double").alias("margin_left"), (36 + p % 4 * 16).cast("double").alias("margin_right"), F.lit(40.0).alias("margin_top"), (36 + p % 6 * 2).cast("double").alias("margin_bottom"), (p % 30).alias("sampled"))


GEO = """g AS (SELECT doc_key, page_id, page_width AS width, page_height AS height, (page_id % 7 - 3) / 8 AS skew, (page_id % 5) / 4 AS persp, 30.0::DOUBLE + page_id % 9 AS ml, 36.0::DOUBLE + page_id % 4 * 16 AS mr, 40.0::DOUBLE AS mt, 36.0::DOUBLE + page_id % 6 * 2 AS mb, page_id % 30 AS sampled FROM {fx_page_fp}),
s AS (SELECT *, greatest(0.0, floor((100 - persp * 20) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS ps, greatest(0.0, floor((100 - abs(ml - mr) / width * 150) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS ha, greatest(0.0, floor((100 - abs(mt - mb) / height * 120) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS va,
 greatest(0.0, floor((100 - (greatest(0.0, 15 - least(ml, mr)) + greatest(0.0, greatest(ml, mr) - 85)) * 0.8::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS ms, greatest(0.0, floor((100 - (abs(skew) * 6 + persp * 12)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS ds,
 floor(greatest(0.75::DOUBLE, 0.75::DOUBLE + least(1.0::DOUBLE, (sampled + 5) / 20) * 0.24::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS confidence FROM g),
a AS (SELECT *, floor((ha * 0.55::DOUBLE + va * 0.45::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS al FROM s),
o AS (SELECT *, floor((greatest(0.0, 100 - abs(skew) * 10) * 0.3::DOUBLE + ps * 0.2::DOUBLE + al * 0.2::DOUBLE + ms * 0.15::DOUBLE + ds * 0.15::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS geometry_score FROM a)"""
R2 = "floor({0} * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE".format


@add("a19_geometry_rollup", f"WITH {GEO} SELECT doc_key, count(*) AS pages, {R2('avg(skew)')} AS skew, {R2('avg(geometry_score)')} AS geometry_score, {R2('avg(confidence)')} AS confidence FROM o GROUP BY doc_key")
def a19(fx):
    return op.geometry_rollup(page_geometry(fx), ("doc_key",))


@add("a22_baseline_delta", """WITH b AS (SELECT page_id, count(*) AS baseline_fields FROM {fx_cell} GROUP BY page_id), m AS (SELECT page_id, count(*) AS measured_fields FROM {fx_field} GROUP BY page_id)
SELECT b.page_id, baseline_fields, measured_fields, measured_fields - baseline_fields AS delta, measured_fields IS NULL AS missing FROM b LEFT JOIN m ON m.page_id = b.page_id""")
def a22(fx):
    base = fx.fx_cell.groupBy("page_id").agg(F.count(F.lit(1)).alias("baseline_fields"))
    return op.baseline_delta(fx.fx_field.groupBy("page_id").agg(F.count(F.lit(1)).alias("measured_fields")), base, BY)


@add("a23_run_invariants", f"""WITH af AS (SELECT page_id, field_id, x, y, w, CASE WHEN field_id % 13 = 1 THEN h + 1 ELSE h END AS h, label FROM {{fx_field_prev}} WHERE {PROTECTED} AND label NOT LIKE 'cold%' UNION ALL SELECT page_id, field_id + 1000, x, y, w, h, label FROM {{fx_field}}),
j AS (SELECT coalesce(b.page_id, a.page_id) AS page_id, b.field_id IS NULL AS fresh, a.field_id IS NULL AS lost, coalesce({PROTECTED}, false) AS prot, a.x >= 0 AND a.y >= 0 AND a.x + a.w <= p.page_w + 2 AND a.y + a.h <= p.page_h + 2 AS inside, b.h = a.h AS same
 FROM {{fx_field_prev}} b FULL OUTER JOIN af a ON a.page_id = b.page_id AND a.field_id = b.field_id LEFT JOIN {{fx_page}} p ON p.page_id = a.page_id)
SELECT page_id, bool_and(NOT prot OR NOT lost) AS retained, bool_and(NOT prot OR coalesce(same, false)) AS preserved, count(*) FILTER (WHERE fresh) AS added, count(*) FILTER (WHERE lost) AS removed, bool_and(coalesce(inside, true)) AS valid_bounds FROM j GROUP BY page_id""")
def a23(fx):
    cols = ["page_id", "field_id", "x", "y", "w", "h", "label"]
    kept = fx.fx_field_prev.where(is_protected()).where("label NOT LIKE 'cold%'").withColumn("h", F.when(c("field_id") % 13 == 1, c("h") + 1).otherwise(c("h"))).select(*cols)
    after = kept.unionByName(fx.fx_field.withColumn("field_id", c("field_id") + 1000).select(*cols))
    return op.run_invariants(fx.fx_field_prev, after, fx.fx_page, BY)


STAGES = ("click", "error", "purchase", "signup", "view")


@add("a24_stage_timings", "SELECT user_id, " + ", ".join(f"{sql_r4(f'''sum(value) FILTER (WHERE event_type = '{s}')''')} AS {s}" for s in STAGES) + f", {sql_r4('sum(value)')} AS total FROM events GROUP BY user_id")
def a24(fx):
    stage = fx.events.select("user_id", c("event_type").alias("stage"), c("value").alias("ms"))
    wide = op.stage_timings(stage, ("user_id",), STAGES)
    return wide.select("user_id", *[r4(s, s) for s in (*STAGES, "total")])


@add("a25_discard_trace", f"""WITH t AS (SELECT 'geometry' AS stage, reason FROM ({GEOMETRY.oracles['p3_validate_geometry'].replace('{', '{{').replace('}', '}}')}) g WHERE reason IS NOT NULL UNION ALL SELECT 'review', calibration_status FROM {{fx_field_prev}} WHERE calibration_status = 'REJECTED' UNION ALL SELECT 'protect', 'PROTECTED_EXISTING_FIELD' FROM {{fx_field_prev}} WHERE derivation IN ('ACROFORM', 'MANUAL'))
SELECT stage, reason, count(*) AS dropped FROM t GROUP BY ROLLUP (stage, reason)""")
def a25(fx):
    item = lambda df, reason: df.select("page_id", c("field_id").alias("item_id"), reason.alias("reason"))
    geometry = validate_geometry(fx.fx_field, fx.fx_page, BY).where(c("reason").isNotNull())
    prev = fx.fx_field_prev
    trace = op.discard_trace({
        "geometry": item(geometry, c("reason")), "review": item(prev.where("calibration_status = 'REJECTED'"), c("calibration_status")),
        "protect": item(prev.where("derivation IN ('ACROFORM', 'MANUAL')"), F.lit("PROTECTED_EXISTING_FIELD"))}, BY)
    return op.discard_funnel(trace)


@add("p14_overflow_audit")
def p14(fx):
    v = fx.documents.select("doc_id", "text", "source", (200 + c("doc_id") % 7 * 60).cast("double").alias("w"), (20 + c("n_chars") % 400).cast("double").alias("h"),
                            F.when(c("doc_id") % 3 == 0, "RIGID").when(c("doc_id") % 3 == 1, "CONTINUABLE").otherwise("EXPANDABLE_OR_TABULAR").alias("policy"))
    return op.overflow_audit(v).select("doc_id", "source", "font_size", "tracking", "line_height", "overflows", "action")


# ---------------------------------------------------------------- registry upkeep
@add("p10_field_search", """SELECT page_id, field_id FROM {fx_field_prev} WHERE calibration_status = 'CONFIRMED' AND (contains(CAST(field_id AS VARCHAR), 'red') OR contains(lower(label), 'red'))""")
def p10(fx):
    return reg.field_search(fx.fx_field_prev, "RED", "CONFIRMED").select("page_id", "field_id")


@add("p11_section_search", """SELECT r_regionkey AS section_id, r_name AS title FROM region WHERE contains(lower(r_name), '_1') OR r_regionkey IN (SELECT n_regionkey FROM nation WHERE contains(lower(n_name), '_1'))""")
def p11(fx):
    section = fx.region.select(c("r_regionkey").alias("section_id"), c("r_name").alias("title"))
    field = fx.nation.select(c("n_regionkey").alias("section_id"), c("n_name").alias("label"))
    return reg.section_search(section, field, "_1")


@add("p12_applicable_sections", """SELECT p_partkey AS section_id FROM part WHERE 'A2' IN (concat('A', p_size % 4 + 1), concat('A', p_partkey % 4 + 1))""")
def p12(fx):
    model = lambda n: F.concat(F.lit("A"), (n % 4 + 1).cast("string"))
    return reg.applicable_sections(fx.part.select(c("p_partkey").alias("section_id"), F.array(model(c("p_size")), model(c("p_partkey"))).alias("applicable_models")), "A2").select("section_id")


@add("j16_resolve_alias", """WITH al AS (SELECT * FROM (VALUES ('view', 'page.view'), ('click', 'page.click')) t(alias, canonical_key)), en AS (SELECT * FROM (VALUES ('page.view', 'View'), ('error', 'Error')) t(key, label))
SELECT e.event_id, e.event_type AS key, coalesce(al.canonical_key, e.event_type) AS canonical_key, en.label FROM events e LEFT JOIN al ON al.alias = e.event_type LEFT JOIN en ON en.key = coalesce(al.canonical_key, e.event_type)""")
def j16(fx):
    alias = fx.spark.createDataFrame([("view", "page.view"), ("click", "page.click")], "alias string, canonical_key string")
    entry = fx.spark.createDataFrame([("page.view", "View"), ("error", "Error")], "key string, label string")
    return reg.resolve_alias(fx.events.select("event_id", c("event_type").alias("key")), alias, entry).select("event_id", "key", "canonical_key", "label")


@add("j17_resolve_model", """WITH rq AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('Supplier#', lpad(CAST(o_custkey % 120 AS VARCHAR), 9, '0')) WHEN 1 THEN concat('custom_', o_custkey % 50) WHEN 2 THEN lower(n_name) ELSE concat('B', o_custkey % 40) END AS identifier
  FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 25),
cu AS (SELECT DISTINCT name AS model_id FROM {fx_registry} WHERE template_id % 2 = 0 UNION SELECT concat('custom_', template_id) FROM {fx_registry} WHERE template_id % 5 = 0), bu AS (SELECT concat('B', template_id) AS model_id FROM {fx_registry}), al AS (SELECT upper(school_order) AS u, concat('M', min(template_id)) AS model_id FROM {fx_registry} GROUP BY school_order)
SELECT o_orderkey, coalesce(cu.model_id, bu.model_id, al.model_id) AS model_id, CASE WHEN cu.model_id IS NOT NULL THEN 'custom' WHEN bu.model_id IS NOT NULL THEN 'builtin' WHEN al.model_id IS NOT NULL THEN 'alias' END AS resolved_by
FROM rq LEFT JOIN cu ON cu.model_id = rq.identifier LEFT JOIN bu ON bu.model_id = rq.identifier LEFT JOIN al ON al.u = upper(trim(rq.identifier)) AND NOT starts_with(rq.identifier, 'custom_')""")
def j17(fx):
    k, cust, text = c("o_orderkey") % 4, c("o_custkey"), lambda n: n.cast("string")
    nation = fx.nation.select((c("n_nationkey")).cast("bigint").alias("nk"), "n_name")
    request = fx.orders.withColumn("nk", cust % 25).join(nation, "nk", "left").select("o_orderkey", F.when(k == 0, F.concat(F.lit("Supplier#"), F.lpad(text(cust % 120), 9, "0")))
        .when(k == 1, F.concat(F.lit("custom_"), text(cust % 50))).when(k == 2, F.lower("n_name")).otherwise(F.concat(F.lit("B"), text(cust % 40))).alias("identifier"))
    r = fx.fx_registry
    custom = r.where("template_id % 2 = 0").select(c("name").alias("model_id")).unionByName(r.where("template_id % 5 = 0").select(F.concat(F.lit("custom_"), text(c("template_id"))).alias("model_id")))
    builtin = r.select(F.concat(F.lit("B"), text(c("template_id"))).alias("model_id"))
    alias = r.groupBy(c("school_order").alias("alias")).agg(F.concat(F.lit("M"), text(F.min("template_id"))).alias("model_id"))
    return reg.resolve_model(request, custom, builtin, alias).select("o_orderkey", "model_id", "resolved_by")


@add("j18_referenced_binaries", """WITH t AS (SELECT template_id, CAST(template_id % 90 AS VARCHAR) AS sha256 FROM {fx_registry}), d AS (SELECT DISTINCT CAST(o_custkey % 25 AS VARCHAR) AS sha256 FROM orders)
SELECT template_id, sha256 FROM t WHERE template_id % 3 = 0 AND sha256 NOT IN (SELECT sha256 FROM d) AND sha256 NOT IN (SELECT sha256 FROM t WHERE template_id % 3 <> 0)""")
def j18(fx):
    template = fx.fx_registry.select("template_id", (c("template_id") % 90).cast("string").alias("sha256"))
    document = fx.orders.select((c("o_custkey") % 25).cast("string").alias("sha256"))
    return reg.removable_binaries(template.where("template_id % 3 = 0"), template, document)


@add("k5_versions_of", """SELECT template_id, school_order, validity_year AS year, row_number() OVER (PARTITION BY school_order ORDER BY validity_year DESC, template_id) AS position FROM {fx_registry} WHERE contains(lower(school_order), '1') OR contains(lower(name), '1') OR contains(CAST(template_id AS VARCHAR), '1')""")
def k5(fx):
    return reg.versions_of(fx.fx_registry, "1").select("template_id", "school_order", c("year").cast("bigint").alias("year"), c("position").cast("bigint").alias("position"))


@add("u7_apply_review", """SELECT page_id, field_id, CASE WHEN calibration_status = 'PROPOSED' THEN CASE WHEN field_id % 5 = 0 THEN 'MODIFIED' ELSE 'CONFIRMED' END ELSE calibration_status END AS calibration_status,
 CASE WHEN calibration_status = 'PROPOSED' THEN 'MANUAL_VERIFIED' ELSE derivation END AS derivation, calibration_status = 'PROPOSED' AND field_id % 3 <> 0 AS unassigned FROM {fx_field_prev}""")
def u7(fx):
    f = fx.fx_field_prev.withColumns({"modified": c("field_id") % 5 == 0, "status": F.lit("REVIEW_REQUIRED"), "semantic_key": F.when(c("field_id") % 3 == 0, c("label"))})
    return reg.apply_review(f).select("page_id", "field_id", "calibration_status", "derivation", "unassigned")


RUN_COLUMNS = "page_id, field_id, x, y, w, h, label"


@add("a23_same_result", f"""WITH a AS (SELECT {RUN_COLUMNS} FROM {{fx_field_prev}}), b AS (SELECT {RUN_COLUMNS} FROM {{fx_field}})
SELECT *, 1 AS run FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) p UNION ALL SELECT *, 2 AS run FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) q""")
def a23_same(fx):
    """What two runs disagree on."""
    cols = RUN_COLUMNS.split(", ")
    return op.same_result(fx.fx_field_prev.select(*cols), fx.fx_field.select(*cols))


@add("p14_overflow_shares")
def p14_shares(fx):
    """How many values of each template field, here a source and language, do not fit."""
    v = fx.documents.select("source", "lang", "text", F.lit(320.0).alias("w"), (20 + c("n_chars") % 400).cast("double").alias("h"), F.lit("RIGID").alias("policy"))
    return op.overflow_shares(op.overflow_audit(v), ["source", "lang"])


@add("u8_model_catalogue", """SELECT template_id, name, CASE WHEN template_id % 3 = 0 THEN 'builtin' ELSE 'other' END AS "group", template_id IN (SELECT DISTINCT o_custkey % 50 FROM orders) AS is_default FROM {fx_registry} WHERE status = 'active'""")
def u8(fx):
    r = fx.fx_registry.select("template_id", "name", "status")
    preferred = fx.orders.select((c("o_custkey") % 50).alias("template_id"))
    return reg.model_catalogue(r.where("template_id % 3 = 0"), r.where("template_id % 3 <> 0"), preferred).select("template_id", "name", "group", "is_default")


@add("u9_sync_stored_geometry", """SELECT coalesce(s.page_id, f.page_id) AS page_id, coalesce(s.field_id, f.field_id) AS field_id, CASE WHEN f.field_id IS NOT NULL THEN f.x ELSE s.x END AS x, CASE WHEN f.field_id IS NOT NULL THEN f.label ELSE s.label END AS label, s.calibration_status, f.field_id IS NOT NULL AS from_schema
FROM {fx_field_prev} s FULL OUTER JOIN {fx_field} f ON f.page_id = s.page_id AND f.field_id = s.field_id""")
def u9(fx):
    schema = fx.fx_field.select("page_id", "field_id", "x", "y", "w", "h", "label")
    return reg.sync_stored_geometry(fx.fx_field_prev, schema, BY).select("page_id", "field_id", "x", "label", "calibration_status", "from_schema")
