from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import readings as op
from folioframe.queries.common import BY, Catalogue, r4, sql_inter, sql_r4, sql_share, sql_vertical

CATALOGUE = Catalogue()
add = CATALOGUE.add

VALID = "trim({t}.text) <> '' AND {t}.x >= 0 AND {t}.y >= 0 AND {t}.w > 0 AND {t}.h > 0 AND {t}.x + {t}.w <= p.page_w + 1 AND {t}.y + {t}.h <= p.page_h + 1"


def valid(t: str) -> str:
    return VALID.replace("{t}", t)


# comparable readings of A (table a) among B (table b): page, word, key, text, confidence
def comparable_sql(a: str, b: str, prefix: str = "") -> str:
    return f"""
{prefix}near AS (SELECT a.page_id, a.token_id, a.w AS aw, a.h AS ah, a.text_key AS akey, b.token_id AS bid, b.line_id AS bl,
    b.x AS bx, b.y AS b_y, b.w AS bw, b.h AS bh, b.text AS btext, b.text_key AS bkey, b.conf AS bconf, {sql_share('b', 'a')} AS sh
  FROM {a} a JOIN {b} b ON a.page_id = b.page_id
  WHERE {sql_vertical('a', 'b')} > 0.6 AND {sql_share('b', 'a')} > 0.55),
{prefix}topped AS (SELECT *, min(b_y) OVER (PARTITION BY page_id, token_id, bl) AS top FROM {prefix}near),
{prefix}grp AS (SELECT page_id, token_id, count(*) AS n, min(bx) AS gx, min(b_y) AS gy, max(bx + bw) - min(bx) AS gw,
    max(b_y + bh) - min(b_y) AS gh, any_value(aw) AS aw, any_value(ah) AS ah, min(bconf) AS gconf,
    string_agg(bkey, '' ORDER BY top, bl, bx, bid) AS gkey
  FROM {prefix}topped GROUP BY page_id, token_id),
{prefix}united AS (SELECT * FROM {prefix}grp WHERE n > 1 AND gw >= aw * 0.5 AND gw <= aw * 1.6 AND gh <= ah * 1.6),
{prefix}one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, token_id
      ORDER BY CASE WHEN bkey = akey THEN 0 ELSE 1 END, -sh, bid) AS rn FROM {prefix}near
    WHERE bw >= aw * 0.45 AND bw <= aw * 2.2 AND bh >= ah * 0.45 AND bh <= ah * 2.2) s WHERE rn = 1),
{prefix}reading AS (SELECT page_id, token_id, gkey AS b_text_key, gconf AS b_conf, gx AS b_x, gw AS b_w FROM {prefix}united
  UNION ALL SELECT o.page_id, o.token_id, o.bkey, o.bconf, o.bx, o.bw FROM {prefix}one o
  WHERE NOT EXISTS (SELECT 1 FROM {prefix}united u WHERE u.page_id = o.page_id AND u.token_id = o.token_id))"""


OUTCOMES = comparable_sql("{fx_token}", "{fx_token_b}") + f""",
touched AS (SELECT DISTINCT a.page_id, a.token_id FROM {{fx_token}} a JOIN {{fx_token_b}} b ON a.page_id = b.page_id
  WHERE {sql_share('a', 'b')} > 0.45 OR {sql_share('b', 'a')} > 0.45),
judged AS (SELECT a.*, r.b_text_key, CASE WHEN r.b_text_key = a.text_key THEN 'agreement' WHEN r.b_text_key IS NOT NULL THEN 'disagreement'
    WHEN t.token_id IS NOT NULL THEN 'segmentation_mismatch' ELSE 'unmatched' END AS outcome
  FROM {{fx_token}} a LEFT JOIN reading r ON r.page_id = a.page_id AND r.token_id = a.token_id
  LEFT JOIN touched t ON t.page_id = a.page_id AND t.token_id = a.token_id)"""


@add("p2_valid_boxes", f"SELECT t.page_id, t.token_id FROM {{fx_token}} t JOIN {{fx_page}} p ON p.page_id = t.page_id WHERE {valid('t')}")
def p2(fx):
    return op.valid_boxes(fx.fx_token, fx.fx_page, BY).select("page_id", "token_id")


@add("j4_comparable_reading", "WITH " + comparable_sql("{fx_token}", "{fx_token_b}") + f"""
SELECT a.page_id, a.token_id, r.b_text_key, r.b_conf, r.b_x, r.b_w FROM {{fx_token}} a
LEFT JOIN reading r ON r.page_id = a.page_id AND r.token_id = a.token_id""")
def j4(fx):
    return op.comparable_reading(fx.fx_token, fx.fx_token_b, BY).select(
        "page_id", "token_id", "b_text_key", "b_conf", "b_x", "b_w")


@add("a11_reading_agreement", f"WITH {OUTCOMES} SELECT page_id, count(*) FILTER (WHERE outcome = 'agreement') AS agreements, count(*) FILTER (WHERE outcome = 'disagreement') AS disagreements, count(*) FILTER (WHERE outcome = 'segmentation_mismatch') AS segmentation_mismatches, count(*) FILTER (WHERE outcome = 'unmatched') AS unmatched FROM judged GROUP BY page_id")
def a11(fx):
    return op.reading_agreement(fx.fx_token, fx.fx_token_b, BY)


@add("r4_segmentation_mismatch", f"WITH {OUTCOMES} SELECT page_id, token_id, text FROM judged WHERE outcome = 'segmentation_mismatch'")
def r4_mismatch(fx):
    return op.segmentation_mismatch(fx.fx_token, fx.fx_token_b, BY).select("page_id", "token_id", "text")


@add("r1_split_coarse_tokens", shared="fx_token")
def r1(fx):
    # reader B sees the two words of every name apart; A reads them as one coarse word
    a = fx.fx_token.withColumn("text_key", F.lower(F.regexp_replace("text", " ", "")))
    part = F.split("text", " ")
    halves = a.select(*a.columns, F.posexplode(part).alias("k", "word")).select(
        "page_id", (F.col("token_id") * 10 + F.col("k")).alias("token_id"), "line_id",
        (F.col("x") + F.col("k") * F.col("w") / 2).alias("x"), "y", (F.col("w") / 2 - 1).alias("w"), "h",
        F.col("word").alias("text"), F.lower("word").alias("text_key"))
    return op.split_coarse_tokens(a, halves, None, BY).select(
        "page_id", "raw_token_id", "part_no", "token_id", "text", "x", "w", "outcome")


R2_COARSE = f"""
heights AS (SELECT page_id, h FROM {{fx_token}} WHERE h > 5 UNION ALL SELECT page_id, h FROM {{fx_token_b}} WHERE h > 5),
med AS (SELECT page_id, quantile_disc(h, 0.5) AS h0 FROM heights GROUP BY page_id),
weak AS (SELECT a.* FROM {{fx_token}} a JOIN {{fx_page}} p ON p.page_id = a.page_id JOIN med ON med.page_id = a.page_id
  WHERE a.source = 'ocr' AND a.conf < 62 AND (a.h > h0 * 2.4 OR a.w > greatest(p.page_w * 0.25, h0 * greatest(3, length(a.text)) * 1.1))),
"""


def _wide(fx):
    """A's words stretched so that a share of them counts as coarse."""
    return fx.fx_token.withColumn("w", F.when(F.col("token_id") % 5 == 0, F.col("w") * 4).otherwise(F.col("w")))


@add("r2_recover_coarse", """
WITH a AS (SELECT * REPLACE (CASE WHEN token_id % 5 = 0 THEN w * 4 ELSE w END AS w) FROM {fx_token}),
heights AS (SELECT page_id, h FROM a WHERE h > 5 UNION ALL SELECT page_id, h FROM {fx_token_b} WHERE h > 5),
ranked AS (SELECT page_id, h, row_number() OVER (PARTITION BY page_id ORDER BY h) AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM heights),
med AS (SELECT page_id, h AS h0 FROM ranked WHERE rn = floor((n - 1) / 2) + 1),
weak AS (SELECT a.* FROM a JOIN {fx_page} p ON p.page_id = a.page_id JOIN med ON med.page_id = a.page_id
  WHERE a.source = 'ocr' AND a.conf < 62 AND (a.h > h0 * 2.4 OR a.w > greatest(p.page_w * 0.25, h0 * greatest(3, length(a.text)) * 1.1))),
loc AS (SELECT t.* FROM {fx_local} t JOIN {fx_page} p ON p.page_id = t.page_id WHERE """ + valid("t") + """),
bok AS (SELECT t.* FROM {fx_token_b} t JOIN {fx_page} p ON p.page_id = t.page_id WHERE """ + valid("t") + f"""),
pieces AS (SELECT w.token_id AS raw_id, l.* FROM weak w JOIN loc l ON l.page_id = w.page_id WHERE {sql_share('l', 'w')} > 0.8),
witness AS (SELECT DISTINCT p.page_id, p.raw_id, p.token_id FROM pieces p JOIN bok b ON b.page_id = p.page_id AND b.text_key = p.text_key
  WHERE {sql_share('p', 'b')} > 0.55 AND {sql_share('b', 'p')} > 0.55),
per_raw AS (SELECT p.page_id, p.raw_id, count(*) AS n, bool_or(p.conf < CASE WHEN regexp_matches(p.text, '[0-9]') THEN 85 ELSE 70 END) AS low,
    bool_or(w.token_id IS NULL) AS unwitnessed FROM pieces p
  LEFT JOIN witness w ON w.page_id = p.page_id AND w.raw_id = p.raw_id AND w.token_id = p.token_id GROUP BY p.page_id, p.raw_id),
among AS (SELECT DISTINCT p.page_id, p.raw_id FROM pieces p JOIN pieces q ON q.page_id = p.page_id AND q.raw_id = p.raw_id AND p.token_id < q.token_id
  WHERE {sql_share('p', 'q')} > 0.15 OR {sql_share('q', 'p')} > 0.15),
other AS (SELECT DISTINCT p.page_id, p.raw_id FROM pieces p JOIN a ON a.page_id = p.page_id AND a.token_id <> p.raw_id
  WHERE {sql_share('p', 'a')} > 0.3 OR {sql_share('a', 'p')} > 0.3),
expected AS (SELECT w.token_id AS raw_id, b.* FROM weak w JOIN bok b ON b.page_id = w.page_id WHERE {sql_share('b', 'w')} > 0.8),
missed AS (SELECT DISTINCT e.page_id, e.raw_id FROM expected e WHERE NOT EXISTS (SELECT 1 FROM pieces p WHERE p.page_id = e.page_id AND p.raw_id = e.raw_id
  AND p.text_key = e.text_key AND {sql_share('p', 'e')} > 0.55 AND {sql_share('e', 'p')} > 0.55)),
judged AS (SELECT w.page_id, w.token_id, coalesce(r.n, 0) AS local_words,
  CASE WHEN r.n IS NULL OR r.n > 60 THEN 'NO_COMPLETE_LOCAL_READING' WHEN r.low THEN 'LOW_LOCAL_CONFIDENCE'
       WHEN m.raw_id IS NOT NULL THEN 'OVERLAPPING_LOCAL_WORDS' WHEN r.unwitnessed THEN 'INDEPENDENT_TEXT_OR_GEOMETRY_DISAGREEMENT'
       WHEN s.raw_id IS NOT NULL THEN 'INCOMPLETE_LOCAL_COVERAGE' WHEN o.raw_id IS NOT NULL THEN 'OTHER_PRIMARY_TOKEN_CONFLICT'
       ELSE 'COARSE_TOKEN_CORROBORATED_BY_TWO_READERS' END AS reason
  FROM weak w LEFT JOIN per_raw r ON r.page_id = w.page_id AND r.raw_id = w.token_id
  LEFT JOIN among m ON m.page_id = w.page_id AND m.raw_id = w.token_id
  LEFT JOIN missed s ON s.page_id = w.page_id AND s.raw_id = w.token_id
  LEFT JOIN other o ON o.page_id = w.page_id AND o.raw_id = w.token_id)
SELECT *, CASE WHEN reason = 'COARSE_TOKEN_CORROBORATED_BY_TWO_READERS' THEN 'recovered' ELSE 'retained' END AS outcome FROM judged""", shared="fx_token")
def r2(fx):
    return op.recover_coarse(_wide(fx), fx.fx_local, fx.fx_token_b, fx.fx_page, BY).select(
        "page_id", "token_id", "local_words", "reason", "outcome")


def _gaps(fx):
    """A without the words it missed, and the whole page as the region to look in."""
    return fx.fx_reader, fx.fx_page.select(
        "page_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("page_w").alias("w"), F.col("page_h").alias("h"))


@add("r3_recover_missing", shared="fx_token")
def r3(fx):
    a, region = _gaps(fx)
    return op.recover_missing(a, fx.fx_local, fx.fx_token_b, region, fx.fx_page, BY).select(
        "page_id", "token_id", "b_token_id", "text")


def _digits(df):
    """Every fourth name carries a number, so that digits are at stake."""
    return df.withColumn("text", F.when(F.col("token_id") % 4 == 0, F.concat("text", F.lit(" 7"))).otherwise(F.col("text"))
                         ).withColumn("text_key", F.when(F.col("token_id") % 4 == 0, F.concat("text_key", F.lit("7"))).otherwise(F.col("text_key")))


def numbered(view: str) -> str:
    return ("(SELECT * REPLACE (CASE WHEN token_id % 4 = 0 THEN concat(text, ' 7') ELSE text END AS text, "
            f"CASE WHEN token_id % 4 = 0 THEN concat(text_key, '7') ELSE text_key END AS text_key) FROM {{{view}}})")


VOTE = f"""a AS (SELECT * FROM {numbered('fx_token')}), fullb AS (SELECT * FROM {numbered('fx_token_b')}),
{comparable_sql('a', 'fullb', 'f_')}, regb AS (SELECT * FROM {numbered('fx_local')}), {comparable_sql('a', 'regb', 'g_')},
vote AS (SELECT a.*, f.b_text_key AS fkey, coalesce(f.b_text_key = g.b_text_key AND f.b_text_key <> a.text_key AND a.conf < 80, false) AS changed
  FROM a LEFT JOIN f_reading f ON f.page_id = a.page_id AND f.token_id = a.token_id
  LEFT JOIN g_reading g ON g.page_id = a.page_id AND g.token_id = a.token_id)"""


@add("r6_vote_reading", f"WITH {VOTE} SELECT page_id, token_id, CASE WHEN changed THEN fkey ELSE text_key END AS selected_key, changed, CASE WHEN changed THEN 'TWO_OBSERVATIONS_AGREE' ELSE 'PRIMARY_KEPT' END AS reason FROM vote", shared="fx_token")
def r6(fx):
    b = _digits(fx.fx_token_b)
    return op.vote_reading(_digits(fx.fx_token), b, _digits(fx.fx_local), None, BY).select(
        "page_id", "token_id", "selected_key", "changed", "reason")


@add("r5_critical_guard", f"""WITH {VOTE}, loc AS (SELECT * REPLACE (CASE WHEN page_id % 2 = 0 THEN 90.0 ELSE 60.0 END AS conf) FROM fullb),
changed_a AS (SELECT * FROM vote WHERE changed), {comparable_sql('changed_a', 'loc', 'l_')},
guarded AS (SELECT v.page_id, v.token_id, v.changed AND (regexp_matches(v.text_key || v.fkey, '[0-9]')) AND NOT coalesce(l.b_conf >= 85 AND l.b_text_key = v.fkey, false) AS stopped, v.changed AS ch
  FROM vote v LEFT JOIN l_reading l ON l.page_id = v.page_id AND l.token_id = v.token_id)
SELECT page_id, token_id, ch AND NOT coalesce(stopped, false) AS changed, CASE WHEN stopped THEN 'CRITICAL_VALUE_NEEDS_PRIMARY_LOCAL_AGREEMENT' WHEN ch THEN 'TWO_OBSERVATIONS_AGREE' ELSE 'PRIMARY_KEPT' END AS reason FROM guarded""", shared="fx_token")
def r5(fx):
    b = _digits(fx.fx_token_b)
    local = b.withColumn("conf", F.when(F.col("page_id") % 2 == 0, 90.0).otherwise(60.0))
    return op.vote_reading(_digits(fx.fx_token), b, _digits(fx.fx_local), local, BY).select(
        "page_id", "token_id", "changed", "reason")


@add("r7_reader_state", """
WITH s AS (SELECT p.page_id, p.page_id % 5 = 0 AS native, p.page_id % 7 <> 0 AS enabled, p.page_id % 11 = 0 AS custom_reader,
  CASE WHEN p.page_id % 13 = 0 THEN 0 ELSE count(b.token_id) END AS sw, p.page_id % 26 AS wn
  FROM {fx_page} p LEFT JOIN {fx_token_b} b ON b.page_id = p.page_id GROUP BY p.page_id)
SELECT page_id,
 CASE WHEN NOT enabled THEN 'disabled' WHEN custom_reader OR native THEN 'not-needed' WHEN sw = 0 AND wn > 0 THEN 'fallback-primary' ELSE 'completed' END AS execution,
 CASE WHEN NOT enabled OR custom_reader THEN 'not-configured' WHEN native THEN 'provided-unverified' WHEN sw = 0 AND wn > 0 THEN 'unavailable' ELSE 'available' END AS availability,
 CASE WHEN NOT enabled THEN 'INDEPENDENT_READING_DISABLED' WHEN custom_reader THEN 'CUSTOM_OCR_RUNNER' WHEN native THEN 'NATIVE_PDF_TEXT'
   WHEN sw = 0 AND wn > 0 THEN 'RECOGNIZER_B_UNAVAILABLE' WHEN sw = 0 THEN 'RECOGNIZER_B_EMPTY' ELSE 'DUAL_READING_COMPLETED' END AS reason,
 CASE WHEN enabled AND NOT custom_reader AND NOT native THEN sw END AS returned_words FROM s""")
def r7(fx):
    counts = fx.fx_token_b.groupBy("page_id").agg(F.count("*").alias("n"))
    p = F.col("page_id")
    state = fx.fx_page.join(counts, "page_id", "left").select(
        "page_id", (p % 5 == 0).alias("native"), (p % 7 != 0).alias("enabled"), (p % 11 == 0).alias("custom_reader"),
        F.when(p % 13 == 0, F.lit(0).cast("bigint")).otherwise(F.coalesce("n", F.lit(0))).alias("secondary_words"),
        (p % 26).alias("warnings_n"))
    return op.reader_state(state, BY)


@add("j12_merge_native_and_ocr", f"""
WITH n AS (SELECT * FROM {{fx_token}} WHERE source = 'pdf'), o AS (SELECT * FROM {{fx_token_b}})
SELECT page_id, token_id, text, 'pdf' AS source FROM n
UNION ALL SELECT o.page_id, o.token_id, o.text, 'ocr' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.page_id = o.page_id AND {sql_share('o', 'n')} > 0.55)""")
def j12(fx):
    native = fx.fx_token.where("source = 'pdf'").select("page_id", "token_id", "x", "y", "w", "h", "text", "source")
    ocr = fx.fx_token_b.select("page_id", "token_id", "x", "y", "w", "h", "text", F.lit("ocr").alias("source"))
    return op.merge_native_and_ocr(native, ocr, BY).select("page_id", "token_id", "text", "source")


@add("u1_merge_word_streams", shared="fx_token")
def u1(fx):
    cols = ["page_id", "x", "y", "w", "h", "text", "conf"]
    a = fx.fx_token.select(*cols, (F.col("token_id") * 2).alias("word_id"))
    b = fx.fx_token_b.select(*cols, (F.col("token_id") * 2 + 1).alias("word_id"))
    return op.merge_word_streams(a.unionByName(b), BY).select("page_id", "word_id", "text", "conf")
