from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import semantics as op
from folioframe.queries.geometry import SQL_HEIGHTS, upper_heights
from folioframe.queries.common import BY, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add
c = F.col

# variations of the stored labels, so that every kind of defect occurs
VARIED = ("CASE field_id % 8 WHEN 0 THEN left(label, 2) WHEN 1 THEN '12 / 3' WHEN 2 THEN 'L]' WHEN 3 THEN 'La' WHEN 4 THEN concat('Linee guida ', label) "
          "WHEN 5 THEN 'data' WHEN 6 THEN ' ' ELSE label END")


def varied(fx):
    return fx.fx_field.withColumn("label", F.expr(VARIED))


@add("p8_label_quality", f"""WITH f AS (SELECT page_id, field_id, trim({VARIED}) AS l FROM {{fx_field}})
SELECT page_id, field_id, CASE WHEN l = '' THEN 'EMPTY' WHEN NOT regexp_matches(l, '[a-zA-Z]') THEN 'NO_LETTERS' WHEN length(l) <= 2 AND regexp_matches(l, '^[a-zA-Z0-9][\\]\\)\\|/\\\\_]+$') THEN 'SHORT_GARBAGE'
 WHEN lower(l) IN ('di', 'da', 'del', 'al', 'il', 'la', 'i', 'gli', 'le', 'un', 'una') THEN 'STOP_WORD' WHEN contains(lower(l), 'linee guida') THEN 'STATIC_HEADER' WHEN l = 'data' THEN 'LOWERCASE_IN_SENTENCE' END AS label_issue FROM f""")
def p8(fx):
    return op.label_quality(varied(fx)).select("page_id", "field_id", "label_issue")


SENTENCE = "CASE WHEN (turn + i) % 3 = 0 THEN replace(s, '.', ':') WHEN (turn + i) % 7 = 0 THEN concat('[', s, ']') ELSE s END"


@add("p9_is_prompt", f"""WITH s AS (SELECT conv_id, turn, i, string_split(text, chr(10))[i + 1] AS s FROM (SELECT *, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations) q),
t AS (SELECT conv_id, turn, i, {SENTENCE} AS text FROM s), k AS (SELECT *, trim(regexp_replace(text, '[_\\.\\s]+$', '')) AS cl FROM t), d AS (SELECT DISTINCT lower(regexp_replace(text, '[_\\.\\s]+$', '')) AS phrase FROM conversations WHERE role = 'user')
SELECT conv_id, turn, i, length(cl) BETWEEN 2 AND 80 AND (regexp_matches(cl, '^\\[.+\\]$') OR (regexp_matches(cl, '[:?]\\s*$') AND len(string_split_regex(cl, '\\s+')) <= 8) OR (NOT regexp_matches(cl, '[:?]\\s*$') AND lower(cl) IN (SELECT phrase FROM d))) AS is_prompt FROM k""".replace("{", "{{").replace("}", "}}").replace("{{{{", "{{").replace("}}}}", "}}"))
def p9(fx):
    token = fx.conversations.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "s")).withColumn("text", F.expr(SENTENCE))
    known = fx.conversations.where("role = 'user'").select(F.lower(F.regexp_replace("text", r"[_\.\s]+$", "")).alias("phrase"))
    return op.mark_prompts(token, known).select("conv_id", "turn", c("i").cast("bigint").alias("i"), "is_prompt")


PATTERNS = [(r"red|blue", "colour.warm", "TEXT_SHORT", 0.9), (r"\bhot\b", "state.hot", "TEXT_LONG", 0.85), (r"gear$", "part.gear", "NUMBER", 0.8)]
KINDS = [("ring", "DATE"), ("bolt|nut", "NUMBER"), ("small", "TEXT_LONG")]


@add("e1_suggest_key", """SELECT page_id, field_id, CASE WHEN regexp_matches(label, 'red|blue') THEN 'colour.warm' WHEN regexp_matches(label, '\\bhot\\b') THEN 'state.hot' WHEN regexp_matches(label, 'gear$') THEN 'part.gear' END AS suggested_key,
 CASE WHEN regexp_matches(label, 'red|blue') THEN 0.9::DOUBLE WHEN regexp_matches(label, '\\bhot\\b') THEN 0.85::DOUBLE WHEN regexp_matches(label, 'gear$') THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS key_confidence,
 CASE WHEN regexp_matches(label, 'red|blue') THEN 'TEXT_SHORT' WHEN regexp_matches(label, '\\bhot\\b') THEN 'TEXT_LONG' WHEN regexp_matches(label, 'gear$') THEN 'NUMBER'
  WHEN regexp_matches(label, 'ring') THEN 'DATE' WHEN regexp_matches(label, 'bolt|nut') THEN 'NUMBER' WHEN regexp_matches(label, 'small') THEN 'TEXT_LONG' ELSE 'TEXT_SHORT' END AS suggested_type FROM {fx_field}""")
def e1(fx):
    return op.suggest_key(fx.fx_field, PATTERNS, KINDS).select("page_id", "field_id", "suggested_key", "key_confidence", "suggested_type")


def bound(fx):
    """Stored fields of every page as one template each, with evidence from the other reader."""
    f = op.suggest_key(fx.fx_field_prev, PATTERNS, KINDS).select(
        c("page_id").alias("template_id"), c("field_id").cast("string").alias("field_id"),
        F.when(c("field_id") % 9 == 0, "Riga").when(c("field_id") % 11 == 0, F.concat(F.lit("["), "label", F.lit("]"))).otherwise(c("label")).alias("label"),
        "suggested_key", F.when(c("field_id") % 5 == 0, "own.key").alias("semantic_key"), F.lit(None).cast("string").alias("field_type"), F.lit(None).cast("string").alias("background_mode"),
        "calibration_status", F.lit("GEOMETRY").alias("detection_source"), "derivation", F.when(c("field_id") % 2 == 0, 90.0).when(c("field_id") % 3 == 0, 0.5).alias("confidence"))
    baseline = fx.spark.createDataFrame([("warm",), ("part.gear",)], "semantic_key string")
    alias = fx.spark.createDataFrame([("warm", "colour.warm")], "alias string, canonical_key string")
    evidence = fx.fx_token_b.select(c("page_id").alias("template_id"), c("token_id").cast("string").alias("ref"),
                                    F.when(c("token_id") % 4 == 0, "12/03/2020").when(c("token_id") % 4 == 1, "no").otherwise(c("text")).alias("value"))
    return op.bind_semantics(f, baseline, alias, evidence)


BIND = """f AS (SELECT page_id AS template_id, CAST(field_id AS VARCHAR) AS field_id, field_id AS n, CASE WHEN field_id % 9 = 0 THEN 'Riga' WHEN field_id % 11 = 0 THEN concat('[', label, ']') ELSE label END AS label,
  CASE WHEN regexp_matches(label, 'red|blue') THEN 'warm' WHEN regexp_matches(label, '\\bhot\\b') THEN 'state.hot' WHEN regexp_matches(label, 'gear$') THEN 'part.gear' END AS mk,
  CASE WHEN field_id % 5 = 0 THEN 'own.key' END AS sk, calibration_status AS cs, CASE WHEN field_id % 2 = 0 THEN 90.0::DOUBLE WHEN field_id % 3 = 0 THEN 0.5::DOUBLE END AS conf FROM {fx_field_prev}),
h AS (SELECT *, CASE WHEN cs = 'REJECTED' THEN 'rejected' WHEN cs IN ('CONFIRMED', 'MODIFIED') THEN 'user' WHEN label = 'Riga' THEN 'noise' ELSE 'automatic' END AS handling FROM f),
v AS (SELECT page_id, CAST(token_id AS VARCHAR) AS ref, min(CASE WHEN token_id % 4 = 0 THEN '12/03/2020' WHEN token_id % 4 = 1 THEN 'no' ELSE text END) AS value FROM {fx_token_b} GROUP BY page_id, token_id),
b AS (SELECT h.template_id, h.field_id, CASE handling WHEN 'automatic' THEN coalesce(sk, mk) WHEN 'noise' THEN NULL ELSE sk END AS semantic_key, CASE WHEN handling IN ('user', 'automatic') THEN mk END AS suggested_key,
  CASE WHEN handling = 'user' THEN 'TEXT_SHORT' WHEN handling = 'automatic' AND v.value IS NOT NULL THEN CASE WHEN v.value = '12/03/2020' THEN 'DATE' WHEN v.value = 'no' THEN 'MULTI_CHOICE' ELSE 'TEXT_SHORT' END END AS field_type,
  CASE WHEN handling = 'automatic' THEN CASE WHEN contains(label, '[') THEN 'OPAQUE_WHITE' ELSE 'TRANSPARENT' END WHEN handling = 'user' THEN 'TRANSPARENT' END AS background_mode,
  CASE WHEN handling = 'automatic' AND v.value IS NOT NULL THEN CASE WHEN conf = 90 THEN 1.0::DOUBLE WHEN conf = 0.5 THEN 0.65::DOUBLE END ELSE conf END AS confidence, handling = 'automatic' AND v.value IS NOT NULL AS has_evidence, handling
  FROM h LEFT JOIN v ON v.page_id = h.template_id AND v.ref = h.field_id)"""


@add("e2_bind_semantics", f"WITH {BIND} SELECT * FROM b")
def e2(fx):
    return bound(fx).select("template_id", "field_id", "semantic_key", "suggested_key", "field_type", "background_mode", "confidence", "has_evidence", "handling")


@add("e2_binding_counters", f"""WITH {BIND} SELECT template_id, count(*) FILTER (WHERE suggested_key IS NOT NULL) AS mappings, count(*) FILTER (WHERE handling = 'user' OR (handling = 'automatic' AND suggested_key IS NULL)) AS local_fields,
 count(*) FILTER (WHERE has_evidence) AS evidence_confirmed, count(*) FILTER (WHERE handling = 'automatic' AND background_mode = 'OPAQUE_WHITE') AS opaque, count(*) FILTER (WHERE handling = 'automatic' AND background_mode = 'TRANSPARENT') AS transparent FROM b GROUP BY template_id""")
def e2b(fx):
    return op.binding_counters(bound(fx))


LABELLED = "SELECT doc_id AS template_id, n AS field_id, CASE n WHEN 0 THEN 'the' WHEN 1 THEN 'Der' WHEN 2 THEN '' ELSE 'con.' END AS label FROM documents, (VALUES (0), (1), (2), (3)) v(n)"


@add("e2_discovered_evidence", f"""WITH f AS ({LABELLED}) SELECT template_id, field_id, trim(regexp_extract(text, '(?i)' || replace(label, '.', '\\.') || '[ \\t\\n\\f\\r\\v]*[:\\-]?[ \\t\\n\\f\\r\\v]*([^\\n\\r_]{{2,100}})', 1)) AS value FROM f JOIN documents d ON d.doc_id = f.template_id WHERE label <> ''
 AND trim(regexp_extract(text, '(?i)' || replace(label, '.', '\\.') || '[ \\t\\n\\f\\r\\v]*[:\\-]?[ \\t\\n\\f\\r\\v]*([^\\n\\r_]{{2,100}})', 1)) <> ''""")
def e2_found(fx):
    """What follows four labels in every document."""
    labels = F.array(*map(F.lit, ("the", "Der", "", "con.")))
    field = fx.documents.select(c("doc_id").alias("template_id"), F.posexplode(labels).alias("field_id", "label"))
    return op.discover_evidence(field, fx.documents.select(c("doc_id").alias("template_id"), "text"))


@add("e2_binding_state", "SELECT s_suppkey AS template_id, true AS baseline_present, CASE WHEN s_suppkey % 3 = 0 THEN 'CUSTOM' ELSE 'DERIVED' END AS calibration_source, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = s_suppkey) THEN 'PRESENT' ELSE 'ABSENT' END AS evidence_source FROM supplier")
def e2_state(fx):
    template = fx.supplier.select(c("s_suppkey").alias("template_id"), F.when(c("s_suppkey") % 3 != 0, "A1").alias("school_order"))
    return op.binding_state(template, fx.part.select(c("p_name").alias("semantic_key")), fx.documents.select(c("doc_id").alias("template_id")))


EXTRACTORS = [("f1", [r"\bder\s+([a-z]{4,})", r"\bthe\s+([a-z]{4,})"], 92), ("f2", [r"\bpour\s+([a-z]{3,})", r"\bpara\s+([a-z]{3,})", r"\bwith\s+([a-z]{3,})"], 90), ("f3", [r"[0-9]{3,}"], 70)]


def hits_sql(field, patterns, sure):
    got = [f"nullif(regexp_extract(text, '(?i){p}', {1 if '(' in p else 0}), '')" for p in patterns]
    no = " ".join(f"WHEN {g} IS NOT NULL THEN {i}" for i, g in enumerate(got))
    return f"SELECT doc_id, page_no, '{field}' AS field_id, trim(coalesce({', '.join(got)})) AS value, CASE {no} END AS pattern_no, CAST(least(100, floor({sure} * confidence / 100 + 0.5)) AS BIGINT) AS confidence FROM {{fx_doc_page}}"


@add("e3_extract_evidence", ("WITH e AS (" + " UNION ALL ".join(hits_sql(*e) for e in EXTRACTORS) + ") SELECT doc_id, field_id, page_no, value, pattern_no, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY page_no, value) AS rn FROM e WHERE value IS NOT NULL) s WHERE rn = 1"))
def e3(fx):
    return op.extract_evidence(fx.fx_doc_page, EXTRACTORS).select("doc_id", "field_id", "page_no", "value", "pattern_no", "confidence")


YEAR_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN concat('Anno scolastico: ', yr, '/', lpad(CAST(yr % 100 AS STRING), 2, '0')) WHEN 1 THEN concat(yr, ' - ', yr + 1, ' a.s.') WHEN 2 THEN concat('a.s. ', yr) WHEN 3 THEN concat('verbale di dicembre ', yr) WHEN 4 THEN concat('gennaio ', yr, ' incontro') ELSE 'senza data' END"


@add("e4_school_year", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(yr, '/', yr) WHEN 1 THEN concat(yr, '/', yr + 1) WHEN 2 THEN concat(yr, '/', yr + 1) WHEN 3 THEN concat(yr, '/', yr + 1) WHEN 4 THEN concat(yr - 1, '/', yr) END AS school_year FROM (SELECT *, year(o_orderdate) AS yr FROM orders) t""")
def e4(fx):
    text = fx.orders.withColumn("yr", F.year("o_orderdate")).withColumn("text", F.expr(YEAR_TEXT))
    return text.select("o_orderkey", op.school_year(c("text")).alias("school_year"))


SCORES = """hit AS (SELECT d.doc_id, m.model_id, count(*) AS hits FROM documents d JOIN {fx_model} m ON contains(lower(d.text), m.token) GROUP BY ALL),
sc AS (SELECT doc_id, model_id, hits, CAST(least(100, floor(hits / 3 * 55 + 0.5)) AS BIGINT) AS score FROM hit)"""


@add("e5_model_score", f"WITH {SCORES} SELECT * FROM sc")
def e5(fx):
    return op.model_score(fx.documents, fx.fx_model)


MARKERS = [("en", ["the "], 20), ("en", [" with ", " that "], 30), ("de", [" und "], 50), ("fr", [" dans ", " pour "], 30), ("es", [" para "], 30), ("es", [" los "], 20)]


def families(fx):
    return fx.fx_model.groupBy("model_id", "family").agg(F.min("token").alias("_t")).select(
        "model_id", "family", F.lit(2000).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), F.ascii(F.substring("family", 1, 1)).alias("ord"))


CLASSIFY = SCORES + """,
fam AS (SELECT doc_id, CASE WHEN contains(lower(text), 'the ') THEN 20 ELSE 0 END + CASE WHEN contains(lower(text), ' with ') OR contains(lower(text), ' that ') THEN 30 ELSE 0 END AS en, CASE WHEN contains(lower(text), ' und ') THEN 50 ELSE 0 END AS de,
  CASE WHEN contains(lower(text), ' dans ') OR contains(lower(text), ' pour ') THEN 30 ELSE 0 END AS fr, CASE WHEN contains(lower(text), ' para ') THEN 30 ELSE 0 END + CASE WHEN contains(lower(text), ' los ') THEN 20 ELSE 0 END AS es FROM documents),
bf AS (SELECT doc_id, greatest(en, de, fr, es) AS points, CASE greatest(en, de, fr, es) WHEN en THEN 'en' WHEN de THEN 'de' WHEN fr THEN 'fr' ELSE 'es' END AS f FROM fam),
df AS (SELECT doc_id, points, CASE WHEN points >= 30 THEN f END AS family FROM bf),
md AS (SELECT DISTINCT model_id, family FROM {fx_model}),
top AS (SELECT * FROM (SELECT s.doc_id, s.model_id, s.score, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, ascii(m.family), s.model_id) AS rn FROM sc s JOIN md m ON m.model_id = s.model_id JOIN df d ON d.doc_id = s.doc_id WHERE s.score >= 40 AND (d.family IS NULL OR d.family = m.family)) q WHERE rn = 1),
cl AS (SELECT d.doc_id, d.family, coalesce(t.model_id, CASE WHEN d.family IS NOT NULL THEN concat('BUILTIN_', d.family) END) AS model_id, CASE WHEN t.model_id IS NOT NULL THEN 'custom' WHEN d.family IS NOT NULL THEN 'family' ELSE 'unrecognised' END AS recognised_by,
  CAST(CASE WHEN t.model_id IS NOT NULL THEN least(99, t.score + 60) WHEN d.family IS NOT NULL THEN least(95, d.points + 60) ELSE 0 END AS BIGINT) AS confidence FROM df d LEFT JOIN top t ON t.doc_id = d.doc_id)"""


def classified(fx):
    return op.classify_model(fx.documents, MARKERS, op.model_score(fx.documents, fx.fx_model), families(fx))


@add("e6_classify_model", f"WITH {CLASSIFY} SELECT * FROM cl")
def e6(fx):
    return classified(fx).drop("school_year")


@add("e7_structural_fallback", f"""WITH {CLASSIFY}, bm AS (SELECT doc_id, doc_id % 13 AS t, 90.0 + coalesce(length(text), 0) % 11 AS score FROM documents)
SELECT c.doc_id, CASE WHEN recognised_by = 'unrecognised' AND score >= 95 THEN CAST(t AS VARCHAR) ELSE model_id END AS model_id, CASE WHEN recognised_by = 'unrecognised' AND score >= 95 THEN 'structure' ELSE recognised_by END AS recognised_by,
 CASE WHEN recognised_by = 'unrecognised' AND score >= 95 THEN CAST(floor(score + 0.5) AS BIGINT) ELSE confidence END AS confidence FROM cl c LEFT JOIN bm ON bm.doc_id = c.doc_id""")
def e7(fx):
    match = fx.documents.select("doc_id", (c("doc_id") % 13).alias("template_id"), (90.0 + F.coalesce(F.length("text"), F.lit(0)) % 11).alias("score"))
    return op.structural_fallback(classified(fx), match).select("doc_id", "model_id", "recognised_by", "confidence")


@add("e8_header_fields", """WITH e AS (SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'student' WHEN 2 THEN 'school' WHEN 3 THEN 'section' WHEN 4 THEN 'site' WHEN 5 THEN 'date' WHEN 6 THEN 'class' ELSE 'student_code' END AS f, CASE WHEN l_linenumber = 1 AND l_partkey % 4 = 0 THEN concat('alu-', l_partkey) ELSE concat('v', l_partkey) END AS value FROM lineitem),
w AS (SELECT doc_id, min(value) FILTER (WHERE f = 'student') AS s, min(value) FILTER (WHERE f = 'student_code') AS sc, min(value) FILTER (WHERE f = 'school') AS school, min(value) FILTER (WHERE f = 'class') AS cls, min(value) FILTER (WHERE f = 'section') AS sec, min(value) FILTER (WHERE f = 'site') AS site, min(value) FILTER (WHERE f = 'date') AS date FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(starts_with(s, 'alu-'), false) THEN NULL ELSE s END AS student, coalesce(sc, CASE WHEN starts_with(s, 'alu-') THEN s END) AS student_code, school,
 coalesce(cls, CASE WHEN sec IS NOT NULL AND site IS NOT NULL THEN 'Sez. ' || sec || ' - ' || site WHEN sec IS NOT NULL THEN 'Sez. ' || sec ELSE site END) AS class_or_section, date FROM w""")
def e8(fx):
    n = c("l_linenumber")
    name = F.when(n == 1, "student").when(n == 2, "school").when(n == 3, "section").when(n == 4, "site").when(n == 5, "date").when(n == 6, "class").otherwise("student_code")
    value = F.when((n == 1) & (c("l_partkey") % 4 == 0), F.concat(F.lit("alu-"), c("l_partkey").cast("string"))).otherwise(F.concat(F.lit("v"), c("l_partkey").cast("string")))
    return op.header_fields(fx.lineitem.select(c("l_orderkey").alias("doc_id"), name.alias("field_id"), value.alias("value")))


@add("e9_parse_amounts_dates", """WITH t AS (SELECT DISTINCT o_orderkey, o_totalprice, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, o_orderdate, o_orderkey % 40 AS d, o_orderkey % 14 AS m FROM orders)
SELECT o_orderkey, cents / 100 AS amount, CASE WHEN d BETWEEN 1 AND 28 AND m BETWEEN 1 AND 12 OR (d IN (29, 30) AND m IN (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)) OR (d = 31 AND m IN (1, 3, 5, 7, 8, 10, 12)) THEN concat('2023-', lpad(CAST(m AS VARCHAR), 2, '0'), '-', lpad(CAST(d AS VARCHAR), 2, '0')) END AS day FROM t""")
def e9(fx):
    cents = F.floor(c("o_totalprice") * 100 + 0.5)
    written = F.concat((F.floor(cents / 100000)).cast("string"), F.lit("."), F.lpad((F.floor(cents / 100) % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    day = F.concat_ws("/", (c("o_orderkey") % 40).cast("string"), (c("o_orderkey") % 14).cast("string"), F.lit("23"))
    return fx.orders.select("o_orderkey", op.money(written).alias("amount"), op.iso_date(day).alias("day")).distinct()


@add("e10_custom_key", """SELECT event_id, concat('custom.', regexp_replace(regexp_replace(lower(concat('Tpl-', event_type)), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), '.', regexp_replace(regexp_replace(lower(props), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')) AS key,
 concat('Campo Personalizzato: ', regexp_replace(regexp_replace(lower(props), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')) AS display FROM events""")
def e10(fx):
    keyed = fx.events.select("event_id", op.custom_key(F.concat(F.lit("Tpl-"), "event_type"), c("props")).alias("key"))
    entry = fx.spark.createDataFrame([("school.name", "Scuola", "Nome")], "key string, category string, label string")
    return op.key_label(keyed, entry).select("event_id", "key", "display")


@add("a21_receipt_reconcile", """WITH it AS (SELECT l_orderkey AS doc_id, count(*) AS items, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS cents FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (cents + doc_id % 3 * 100) / 100 END AS total, items, cents / 100 AS items_sum, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 3)::DOUBLE END AS difference, '2024-03-05' AS date, concat('Negozio ', doc_id) AS merchant FROM it""")
def a21(fx):
    """Receipts written out from the orders: shop, date, one line per item, total on its own line."""
    cents = F.floor(c("l_extendedprice") * 100 + 0.5)
    written = lambda v: F.concat(F.floor(v / 100).cast("string"), F.lit(","), F.lpad((v % 100).cast("string"), 2, "0"))
    lines = fx.lineitem.join(fx.part, c("p_partkey") == c("l_partkey")).select(c("l_orderkey").alias("doc_id"), cents.alias("cents"), F.concat_ws(" ", "p_name", written(cents)).alias("line"))
    doc = c("doc_id")
    receipts = lines.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"), F.sum("cents").alias("cents"))
    total = F.concat(F.lit("TOTALE EURO\n"), written(c("cents") + doc % 3 * 100))
    twice = F.when(doc % 5 == 0, F.concat_ws("\n", total, total)).otherwise(total)
    text = F.concat_ws("\n", F.concat(F.lit("Negozio "), doc.cast("string")), F.lit("05/03/24 10:00"), "body", twice, F.lit("RESTO 1,00"))
    return op.receipt_reconcile(receipts.select("doc_id", text.alias("text")))


NAMED = "CASE l_partkey % 6 WHEN 0 THEN concat('Data di nascita: ', 1 + l_partkey % 28, '/0', 1 + l_suppkey % 9, '/2015') WHEN 1 THEN concat('Classe ', text) WHEN 2 THEN '[Nome e Cognome]' WHEN 3 THEN 'Scuola: ________' WHEN 4 THEN concat('[x] ', text) ELSE text END"


@add("f13_inline_values", """SELECT page_id, token_id, CASE l_partkey % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'value' WHEN 2 THEN 'placeholder' WHEN 3 THEN 'underscore' ELSE 'choice' END AS kind, CASE l_partkey % 6 WHEN 0 THEN 'Data di nascita' WHEN 1 THEN 'Classe' WHEN 2 THEN 'Nome e Cognome' WHEN 3 THEN 'Scuola' ELSE text END AS label,
 CASE l_partkey % 6 WHEN 0 THEN concat(1 + l_partkey % 28, '/0', 1 + l_suppkey % 9, '/2015') WHEN 1 THEN text WHEN 4 THEN 'true' ELSE '' END AS value FROM {fx_token} WHERE l_partkey % 6 <> 5""")
def f13(fx):
    token = fx.fx_token.withColumn("text", F.expr(NAMED))
    prompts = ["data(?: di nascita)?", "classe", "nome(?: e cognome)?", "scuola"]
    return op.inline_values(token, prompts, BY).select("page_id", "token_id", "kind", "label", "value")


MARKED = "CASE l_suppkey % 5 WHEN 0 THEN '[x]' WHEN 1 THEN '( )' WHEN 2 THEN 'Q]' ELSE text END"


@add("f13_mark_choices", f"""WITH {SQL_HEIGHTS}, t AS (SELECT t.* EXCLUDE (text), {MARKED} AS text, coalesce(y.typical_h, 20.0) AS th FROM {{fx_token}} t LEFT JOIN typical y ON y.page_id = t.page_id),
m AS (SELECT * FROM t WHERE text IN ('[x]', '( )', 'Q]')),
n AS (SELECT m.page_id, m.token_id, m.text AS mark, m.th, b.x AS bx, b.y AS b_y, b.token_id AS bt, b.text AS bs, b.x - m.x - m.w AS gap FROM m JOIN t b ON b.page_id = m.page_id AND b.token_id <> m.token_id AND b.x >= m.x + m.w - 2 AND abs(b.y - m.y) < m.th),
f AS (SELECT page_id, token_id, bx AS fx, b_y AS fy FROM (SELECT *, row_number() OVER (PARTITION BY page_id, token_id ORDER BY bx, bt) AS rn FROM n WHERE gap < th * 3) q WHERE rn = 1),
c AS (SELECT n.page_id, n.token_id, any_value(mark) AS mark, string_agg(bs, ' ' ORDER BY bx, bt) AS label FROM n JOIN f ON f.page_id = n.page_id AND f.token_id = n.token_id AND abs(b_y - fy) < th * 0.65 AND bx >= fx AND bx < fx + th * 10 GROUP BY n.page_id, n.token_id)
SELECT page_id, token_id, label, mark = '[x]' AS value FROM c WHERE regexp_matches(label, '^(small|hot|large)([^a-z]|$)')""")
def f13_marks(fx):
    return op.mark_choices(fx.fx_token.withColumn("text", F.expr(MARKED)), upper_heights(fx), "small|hot|large", BY).select("page_id", "token_id", "label", "value")


@add("f19_normalise_dates", """SELECT page_id, token_id, CASE WHEN l_partkey % 3 = 0 THEN 'date' ELSE 'text' END AS field_type, CASE WHEN l_partkey % 3 = 0 AND l_partkey % 31 BETWEEN 1 AND 28 AND l_suppkey % 15 BETWEEN 1 AND 12 OR (l_partkey % 3 = 0 AND l_partkey % 31 IN (29, 30) AND l_suppkey % 15 IN (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)) OR (l_partkey % 3 = 0 AND l_partkey % 31 = 29 AND l_suppkey % 15 = 2 AND l_suppkey % 4 = 0)
 THEN concat(CASE WHEN l_suppkey % 100 < 50 THEN '20' ELSE '19' END, lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0'), '-', lpad(CAST(l_suppkey % 15 AS VARCHAR), 2, '0'), '-', lpad(CAST(l_partkey % 31 AS VARCHAR), 2, '0')) ELSE concat(l_partkey % 31, '/', l_suppkey % 15, '/', lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0')) END AS value FROM {fx_token}""")
def f19(fx):
    written = F.concat_ws("/", (c("l_partkey") % 31).cast("string"), (c("l_suppkey") % 15).cast("string"), F.lpad((c("l_suppkey") % 100).cast("string"), 2, "0"))
    token = fx.fx_token.select("page_id", "token_id", F.when(c("l_partkey") % 3 == 0, "date").otherwise("text").alias("field_type"), written.alias("value"))
    return op.normalise_dates(token)
