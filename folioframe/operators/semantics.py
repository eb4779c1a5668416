"""Dictionary-driven text work: prompts, keys, evidence, model classification, amounts and dates."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.keys import strip_accents, tidy
from folioframe.functions.numbers import half_up, let
from folioframe.plans.spatial import PAGE, Box, best_partner, box, near_join
from folioframe.session import cut_lineage

LETTERS = "[a-zA-ZàèìòùéÀÈÌÒÙÉ]"

# Fragments that are never a label of their own, and printed headings of the forms.
STOP_LABELS = ("di", "da", "del", "al", "il", "la", "i", "gli", "le", "un", "una", "personale", "rivedibilità")
STATIC_HEADERS = (
    "scuola dell'infanzia", "scuola dell infanzia", "scuola primaria", "scuola secondaria di i grado",
    "scuola secondaria di ii grado", "allegato a1", "allegato a2", "allegato a3", "allegato a4",
    "ministero dell'istruzione", "ministero dell'istruzione e del merito", "piano educativo individualizzato", "linee guida",
)

# Month names in calendar order; the school year turns in September.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto",
          "settembre", "ottobre", "novembre", "dicembre")


def _any(tests) -> Column:
    hit = F.lit(False)
    for t in tests:
        hit = hit | t
    return hit


def label_quality(field: DataFrame, stop: Sequence[str] = STOP_LABELS, headers: Sequence[str] = STATIC_HEADERS,
                  label: str = "label") -> DataFrame:
    """``label_issue``: why a label cannot stand on its own, null if it can."""
    clean = F.trim(F.coalesce(F.col(label), F.lit("")))
    lower = F.lower(clean)
    garbage = clean.rlike(r"^[a-zA-Z\d][\]\)\|/\\_]+$") | clean.rlike(r"^[^a-zA-Z\d]+$") | clean.rlike(r"^[\]\)\|/\\_]+[a-zA-Z\d]$")
    issue = (
        F.when(clean == "", "EMPTY").when(~clean.rlike(LETTERS), "NO_LETTERS")
        .when((F.length(clean) <= 2) & garbage, "SHORT_GARBAGE").when(lower.isin(*stop), "STOP_WORD")
        .when(_any(lower.contains(h) for h in headers), "STATIC_HEADER").when(clean == "data", "LOWERCASE_IN_SENTENCE"))
    return field.withColumn("label_issue", issue)


def mark_prompts(token: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """``is_prompt``: bracketed placeholder, short text ending in a colon or question mark, or a known phrase.

    ``dictionary(phrase)`` holds lower-case phrases; the match is an equi-join, so it may be of any size.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[_\.\s]+$", ""))
    phrases = dictionary.select(F.col("phrase").alias("_phrase")).distinct().withColumn("_known", F.lit(True))
    joined = token.withColumn("_clean", clean).withColumn("_phrase", F.lower("_clean")).join(phrases, "_phrase", "left")
    sized = (F.length("_clean") >= 2) & (F.length("_clean") <= 80)
    asks = F.col("_clean").rlike(r"[:?]\s*$")
    prompt = sized & (F.col("_clean").rlike(r"^\[.+\]$") | (asks & (F.size(F.split("_clean", r"\s+")) <= 8))
                      | (~asks & F.coalesce("_known", F.lit(False))))
    return joined.withColumn("is_prompt", prompt).drop("_clean", "_phrase", "_known")


def suggest_key(field: DataFrame, patterns: Sequence[tuple[str, str, str, float]], kinds: Sequence[tuple[str, str]],
                label: str = "label", context: str | None = None) -> DataFrame:
    """First matching pattern in order gives key, type and confidence; else the type by word class at 0.65.

    ``patterns``: (regex, key, field type, confidence); ``kinds``: (regex, field type). Both are bounded
    dictionaries and become one CASE over the text, so the table is never joined or shuffled.
    """
    text = F.trim(F.concat_ws(" ", F.coalesce(F.col(label), F.lit("")), *([F.coalesce(F.col(context), F.lit(""))] if context else [])))
    found = kind = None
    for i, (regex, *_rest) in enumerate(patterns):
        test = text.rlike("(?i)" + regex)
        found = F.when(test, i) if found is None else found.when(test, i)
    for regex, name in kinds:
        test = text.rlike("(?i)" + regex)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), F.lit(float(c)).alias("conf")) for _, k, t, c in patterns])
    hit = F.get(rows, F.col("_hit"))
    return field.withColumn("_hit", found).withColumns({
        "suggested_key": hit["key"], "key_confidence": F.when(text == "", 0.5).otherwise(F.coalesce(hit["conf"], F.lit(0.65))),
        "suggested_type": F.coalesce(hit["type"], F.when(text != "", kind), F.lit("TEXT_SHORT"))}).drop("_hit")


def bind_semantics(field: DataFrame, baseline: DataFrame, alias: DataFrame, evidence: DataFrame) -> DataFrame:
    """Record suggestions apart, bind unreviewed fields, and infer type and background from evidence.

    ``field``: template_id, field_id, label, suggested_key, semantic_key, field_type, background_mode,
    calibration_status, detection_source, derivation, confidence (0-1 or 0-100), default_value.
    ``baseline(semantic_key)``, ``alias(alias, canonical_key)``, ``evidence(template_id, ref, value)``
    where ``ref`` is a field id or a key. Personal values never leave this operator.
    """
    canon = lambda df, col, name: df.join(
        alias.select(F.col("alias").alias(col), F.col("canonical_key").alias("_ck")), col, "left").withColumn(
        name, F.coalesce("_ck", F.col(col))).drop("_ck")
    base = canon(baseline.select(F.col("semantic_key").alias("_bk")).distinct(), "_bk", "_canon").groupBy("_canon").agg(F.min("_bk").alias("_bk"))
    f = canon(field, "suggested_key", "_canon").join(base, "_canon", "left").withColumn("_matched", F.coalesce("_bk", "suggested_key"))
    rejected = F.coalesce("calibration_status", F.lit("")) == "REJECTED"
    user = (F.coalesce("calibration_status", F.lit("")).isin("CONFIRMED", "MODIFIED") | F.coalesce("detection_source", F.lit("")).isin("MANUAL_ENTRY", "MANUAL_CREATED")
            | (F.coalesce("derivation", F.lit("")) == "MANUAL_VERIFIED"))
    f = label_quality(f, stop=(*STOP_LABELS, "data", "scelta opzione", "campo da identificare", "riga", "opzione"), headers=()).withColumns({
        "_rejected": rejected, "_user": user & ~rejected})
    f = f.withColumn("_noise", F.col("label_issue").isNotNull() & ~F.col("_rejected") & ~F.col("_user"))
    free = ~F.col("_rejected") & ~F.col("_user") & ~F.col("_noise")
    f = f.withColumns({"_free": free, "_bound": F.when(free, F.coalesce("semantic_key", "_matched")).when(F.col("_noise"), None).otherwise(F.col("semantic_key"))})
    ev = evidence.groupBy("template_id", "ref").agg(F.min("value").alias("value"))
    by_id = ev.select("template_id", F.col("ref").alias("field_id"), F.col("value").alias("_v1"))
    by_key = ev.select("template_id", F.col("ref").alias("_bound"), F.col("value").alias("_v2"))
    f = f.join(by_id, ["template_id", "field_id"], "left").join(by_key, ["template_id", "_bound"], "left")
    value = F.when(F.col("_free"), F.coalesce("_v1", "_v2"))
    seen = F.coalesce(F.length(value) > 0, F.lit(False))
    kind = (F.when(F.length(value) > 120, "TEXT_LONG").when(value.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$"), "DATE")
            .when(F.lower(value).isin("x", "si", "no"), "MULTI_CHOICE").otherwise("TEXT_SHORT"))
    placeholder = _any(F.lower("label").contains(w) for w in ("[", "]", "intestazione", "placeholder"))
    unit = F.when(F.col("confidence") <= 1.0, F.col("confidence")).otherwise(F.col("confidence") / 100)
    return f.withColumns({"_seen": seen, "_conf": F.when(seen & F.col("confidence").isNotNull(), F.least(F.lit(1.0), half_up((unit + 0.15) * 100) / 100)).otherwise(F.col("confidence")),
                          "_kind": F.when(seen & F.col("field_type").isNull(), kind).otherwise(F.col("field_type")),
                          "_back": F.when(F.col("_free") & F.col("background_mode").isNull(), F.when(placeholder, "OPAQUE_WHITE").otherwise("TRANSPARENT"))
                          .when(F.col("_user"), F.coalesce("background_mode", F.lit("TRANSPARENT"))).otherwise(F.col("background_mode"))}).select(
        "template_id", "field_id", "label", F.col("_bound").alias("semantic_key"),
        F.when(F.col("_rejected") | F.col("_noise"), None).otherwise(F.col("_matched")).alias("suggested_key"),
        F.when(F.col("_user"), F.coalesce("field_type", F.lit("TEXT_SHORT"))).otherwise(F.col("_kind")).alias("field_type"),
        F.col("_back").alias("background_mode"), "calibration_status", F.col("_conf").alias("confidence"), F.col("_seen").alias("has_evidence"),
        F.when(F.col("_rejected"), "rejected").when(F.col("_user"), "user").when(F.col("_noise"), "noise").otherwise("automatic").alias("handling"))


def binding_counters(bound: DataFrame) -> DataFrame:
    """One row per template: how many suggestions, local fields, confirmations and background hints."""
    auto = F.col("handling") == "automatic"
    return bound.groupBy("template_id").agg(
        F.count_if(F.col("suggested_key").isNotNull()).alias("mappings"),
        F.count_if((F.col("handling") == "user") | (auto & F.col("suggested_key").isNull())).alias("local_fields"),
        F.count_if("has_evidence").alias("evidence_confirmed"),
        F.count_if(auto & (F.col("background_mode") == "OPAQUE_WHITE")).alias("opaque"),
        F.count_if(auto & (F.col("background_mode") == "TRANSPARENT")).alias("transparent"))


def discover_evidence(field: DataFrame, text: DataFrame) -> DataFrame:
    """Values that stand after a field's label in the text of its template: ``template_id``, ``field_id``, ``value``.

    ``field``: template_id, field_id, label; ``text``: template_id, text. The first place counts where the label (any case) is followed, after a colon or hyphen or
    none, by 2 to 100 characters of the same line without underscores. Null and empty labels find nothing.
    """
    quoted = F.concat(F.lit("(?i)\\Q"), F.replace("label", F.lit("\\E"), F.lit("")), F.lit("\\E\\s*[:\\-]?\\s*([^\\n\\r_]{2,100})"))
    asked = field.where("label <> ''").select("template_id", "field_id", quoted.alias("_pattern"))
    found = asked.join(text.select("template_id", "text"), "template_id").withColumn("value", F.trim(F.expr("regexp_extract(text, _pattern, 1)")))
    return found.where("value <> ''").select("template_id", "field_id", "value")


def binding_state(template: DataFrame, baseline: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a binding could rest on, per template: ``baseline_present``, ``calibration_source`` (DERIVED with a school order, else CUSTOM), ``evidence_source``.

    ``baseline`` applies to all templates; ``evidence`` has a template_id.
    """
    present = not baseline.isEmpty()
    seen = evidence.select("template_id").distinct().withColumn("_seen", F.lit(True))
    has = F.coalesce(F.col("_seen"), F.lit(False))
    return template.join(seen, "template_id", "left").select("template_id", F.lit(present).alias("baseline_present"),
        F.when(F.coalesce("school_order", F.lit("")) != "", "DERIVED").otherwise("CUSTOM").alias("calibration_source"), F.when(has, "PRESENT").otherwise("ABSENT").alias("evidence_source"))


def has_group(pattern: str) -> bool:
    """Whether a pattern captures anything."""
    bare = re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", pattern)  # without escapes and character classes
    return re.search(r"\((?!\?(?!<[A-Za-z]))", bare) is not None


def extract_evidence(raw_page: DataFrame, extractors: Sequence[tuple[str, Sequence[str], float]],
                     remove: Sequence[str] = (), doc: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document and field: the first page, and on it the first pattern, with a non-empty value.

    ``extractors``: (field id, patterns in order, confidence); group 1 is the value where the pattern has one and it matched.
    ``remove``: boilerplate patterns taken out of a value. Snippets keep 30 characters around it.
    """
    def cleaned(value: Column) -> Column:
        for pattern in remove:
            value = F.regexp_replace(value, "(?i)" + pattern, "")
        return F.trim(value)

    def readings(field_id: str, patterns: Sequence[str], confidence: float) -> Column:
        tries = []
        for i, pattern in enumerate(patterns):
            p = "(?i)" + pattern
            whole = F.regexp_extract("text", p, 0)
            group = F.regexp_extract("text", p, 1) if has_group(pattern) else F.lit("")
            raw = F.when(group != "", group).otherwise(whole)
            tries.append(F.struct(F.lit(i).alias("pattern_no"), raw.alias("raw"), whole.alias("whole"), cleaned(raw).alias("value")))
        first = F.get(F.filter(F.array(*tries), lambda t: t["value"] != ""), 0)
        return F.struct(F.lit(field_id).alias("field_id"), F.lit(float(confidence)).alias("sure"), first.alias("hit"))

    pages = raw_page.where(F.trim("text") != "")
    found = pages.select(*doc, "page_no", "text", "confidence", F.explode(F.array(*[readings(*e) for e in extractors])).alias("_e")).where(F.col("_e.hit").isNotNull())
    at = F.expr("locate(_e.hit.whole, text)")
    around = F.substring("text", F.greatest(F.lit(1), at - 30), F.length("_e.hit.raw") + F.least(F.lit(30), at - 1) + 30)
    hit = F.struct(F.col("page_no"), F.col("_e.hit.value").alias("value"), F.col("_e.hit.pattern_no").alias("pattern_no"),
                   F.trim(F.regexp_replace(around, r"\s+", " ")).alias("snippet"),
                   F.least(F.lit(100), half_up(F.col("_e.sure") * F.coalesce("confidence", F.lit(80.0)) / 100)).alias("confidence"))
    return found.groupBy(*doc, F.col("_e.field_id").alias("field_id")).agg(F.min(hit).alias("_hit")).select(*doc, "field_id", "_hit.*")


def school_year(text: Column) -> Column:
    """Explicit year range, else month and year: September to December open a year, the rest close it."""
    get = lambda p, g: F.regexp_extract(text, "(?i)" + p, g)
    ranged = (r"(?:anno\s+scolastico|a\.s\.)\s*[:\-]?\s*(\d{4})[\s/\\\-]+\s*(\d{2,4})",
              r"(\d{4})[\s/\\\-]+\s*(\d{2,4})\s*(?:anno\s+scolastico|a\.s\.)")
    year = lambda s: s.cast("int")

    def span(start: Column, end: Column) -> Column:
        full = F.when(F.length(end) == 2, F.concat(F.substring(start, 1, 2), end)).otherwise(end)
        return F.when(start != "", F.concat_ws("/", start, full))

    alone = get(r"a\.s\.\s*(\d{4})", 1)
    month = r"(" + "|".join(MONTHS) + r")\s+(\d{4})"
    name, at = F.lower(get(month, 1)), get(month, 2)
    opens = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name) >= 9
    first = F.when(opens, year(at)).otherwise(year(at) - 1)
    dated = F.when(name != "", F.concat_ws("/", first.cast("string"), (first + 1).cast("string")))
    return F.coalesce(*[span(get(p, 1), get(p, 2)) for p in ranged],
                      F.when(alone != "", F.concat_ws("/", alone, (year(alone) + 1).cast("string"))), dated)


# Characters of tokens that one automaton holds (about 200 MB in a worker); larger dictionaries are dealt to several.
AUTOMATON_CHARS = 4_000_000
_AUTOMATA: dict[str, object] = {}


def matched_signatures(document: DataFrame, signature: DataFrame, doc: str = "doc_id", inline_limit: int = 256, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(document, token) pairs where the lower-cased text contains the token as a substring.

    A dictionary of up to ``inline_limit`` tokens becomes a literal array and one pass over the text in the JVM.
    A larger one becomes an automaton that finds all tokens in one pass, however many there are; every worker builds it once.
    Dictionaries of more than ``most_chars`` characters are dealt to several automata, brought to the driver one after the other; each reads the texts once.
    Texts are not shuffled, and no document gathers candidates. Null texts contain nothing.
    """
    tokens = signature.select(F.lower("token").alias("token")).where("token <> ''").distinct()
    few = tokens.limit(inline_limit + 1).collect()
    lower = F.lower("text")
    if len(few) <= inline_limit:
        words = F.array(*[F.lit(r["token"]) for r in few]) if few else F.array().cast("array<string>")
        return document.select(doc, F.explode(let(lower, lambda t: F.filter(words, lambda w: t.contains(w)))).alias("token"))
    tokens = cut_lineage(tokens)
    portions = -(-tokens.agg(F.sum(F.length("token"))).first()[0] // most_chars)
    texts = document.select(doc, lower.alias("_text")).where("_text IS NOT NULL")
    schema = T.StructType([document.schema[doc], T.StructField("token", T.StringType())])
    found = None
    for number in range(portions):
        dealt = tokens.where(F.pmod(F.xxhash64("token"), F.lit(portions)) == number)
        part = texts.mapInArrow(_finder([r["token"] for r in dealt.collect()], doc), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _finder(words: list[str], doc: str):
    """Reads batches of (document, text) and gives the words each text contains."""
    name = uuid.uuid4().hex

    def run(batches):
        automaton = _AUTOMATA.get(name)
        if automaton is None:
            automaton = ahocorasick.Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            _AUTOMATA.clear()  # a worker keeps the last one
            _AUTOMATA[name] = automaton
        for batch in batches:
            rows, tokens = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                met = sorted({word for _, word in automaton.iter(text)}) if words else []
                rows.extend([at] * len(met))
                tokens.extend(met)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(tokens, pa.string())], names=[doc, "token"])

    return run


def model_score(document: DataFrame, signature: DataFrame, model: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Score of each document against each model that shares at least one token, name or origin.

    ``signature(model_id, token)``; ``model(model_id, name, origin_name, source_hash)`` adds 50 / 40 / 60.
    """
    sig = signature.select("model_id", F.lower("token").alias("token")).distinct()
    sizes = sig.groupBy("model_id").agg(F.count(F.lit(1)).alias("size"))
    hits = matched_signatures(document, sig, doc).join(sig, "token").groupBy(doc, "model_id").agg(F.count(F.lit(1)).alias("hits"))
    scored = hits.join(sizes, "model_id").withColumn("bonus", F.lit(0.0))
    if model is not None:
        named = None
        for column, worth in (("name", 50.0), ("origin_name", 40.0), ("source_hash", 60.0)):
            terms = model.select("model_id", F.lower(column).alias("token")).where(F.length("token") > 0)
            part = matched_signatures(document, terms, doc).join(terms, "token").select(doc, "model_id", F.lit(worth).alias("bonus"))
            named = part if named is None else named.unionByName(part)
        bonus = named.groupBy(doc, "model_id").agg(F.sum("bonus").alias("bonus"))
        scored = scored.drop("bonus").join(bonus, [doc, "model_id"], "full_outer").na.fill({"hits": 0, "size": 1, "bonus": 0.0})
    return scored.select(doc, "model_id", "hits", F.least(F.lit(100), half_up(F.col("bonus") + F.col("hits") / F.col("size") * 55)).alias("score"))


def classify_model(document: DataFrame, markers: Sequence[tuple[str, Sequence[str], int]], scores: DataFrame,
                   model: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Family by markers (>=30), then the best custom model of that family and year (>=40), then the family.

    ``markers``: (family, alternatives, points); ``scores`` from :func:`model_score`;
    ``model(model_id, family, valid_from, valid_to, ord)`` with years as integers or null.
    """
    lower = F.lower("text")
    families = list(dict.fromkeys(f for f, _, _ in markers))
    points = {f: sum((F.when(_any(lower.contains(w) for w in words), p).otherwise(0) for g, words, p in markers if g == f), F.lit(0)) for f in families}
    best = F.array_max(F.array(*[F.struct(points[f].alias("points"), F.lit(-i).alias("pref"), F.lit(f).alias("family")) for i, f in enumerate(families)]))
    d = document.select(doc, best.alias("_f"), school_year(F.col("text")).alias("school_year"))
    d = d.withColumns({"family": F.when(F.col("_f.points") >= 30, F.col("_f.family")), "points": F.col("_f.points"),
                       "_year": F.expr("try_cast(substring(school_year, 1, 4) AS int)")}).drop("_f")
    own = model.withColumnRenamed("family", "_model_family")
    cand = scores.where("score >= 40").join(own, "model_id").join(d, doc).where(
        (F.col("family").isNull() | (F.col("_model_family") == F.col("family")))
        & (F.col("_year").isNull() | ((F.coalesce("valid_from", F.lit(0)) <= F.col("_year")) & (F.coalesce("valid_to", F.lit(9999)) >= F.col("_year")))))
    top = cand.groupBy(doc).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("ord"), F.col("model_id"))).alias("_m")).select(
        doc, F.col("_m.model_id").alias("_model"), (-F.col("_m.s")).alias("_score"))
    out = d.join(top, doc, "left")
    return out.select(
        doc, "family", "school_year",
        F.coalesce("_model", F.when(F.col("family").isNotNull(), F.concat(F.lit("BUILTIN_"), "family"))).alias("model_id"),
        F.when(F.col("_model").isNotNull(), "custom").when(F.col("family").isNotNull(), "family").otherwise("unrecognised").alias("recognised_by"),
        F.when(F.col("_model").isNotNull(), F.least(F.lit(99), F.col("_score") + 60)).when(F.col("family").isNotNull(), F.least(F.lit(95), F.col("points") + 60))
        .otherwise(0).cast("bigint").alias("confidence"))


def structural_fallback(classified: DataFrame, best_match: DataFrame, doc: str = "doc_id", at_least: float = 95.0) -> DataFrame:
    """Unrecognised documents take the best structural match of 95 or more."""
    strong = best_match.where(F.col("score") >= at_least).select(doc, F.col("template_id").cast("string").alias("_t"), F.col("score").alias("_s"))
    joined = classified.join(strong, doc, "left")
    use = (F.col("recognised_by") == "unrecognised") & F.col("_t").isNotNull()
    return joined.select(
        *[F.when(use, F.col("_t")).otherwise(F.col(c)).alias(c) if c == "model_id" else
          F.when(use, "structure").otherwise(F.col(c)).alias(c) if c == "recognised_by" else
          F.when(use, half_up(F.col("_s"))).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in classified.columns])


def header_fields(evidence: DataFrame, doc: Sequence[str] = ("doc_id",), code_pattern: str = r"^ALU-[A-Z0-9_-]+$") -> DataFrame:
    """One row per document: a code read as a name is moved, section and site are combined."""
    names = ["student", "student_code", "school", "class", "section", "site", "date"]
    wide = evidence.groupBy(*doc).pivot("field_id", names).agg(F.min("value"))
    is_code = F.coalesce(F.col("student").rlike("(?i)" + code_pattern), F.lit(False))
    group = F.coalesce("class", F.when(F.col("section").isNotNull() & F.col("site").isNotNull(), F.concat(F.lit("Sez. "), "section", F.lit(" - "), "site"))
                       .when(F.col("section").isNotNull(), F.concat(F.lit("Sez. "), "section")).otherwise(F.col("site")))
    return wide.select(*doc, F.when(~is_code, F.col("student")).alias("student"),
                       F.coalesce("student_code", F.when(is_code, F.col("student"))).alias("student_code"), "school", group.alias("class_or_section"), "date")


def money(text: Column) -> Column:
    """Amount with mixed separators: the last one is the decimal mark; null when it is no amount."""
    bare = F.regexp_replace(text, r"[\s€]", "")
    valid = bare.rlike(r"^-?\d+(?:[.,]\d{3})*[.,]\d{2}$")
    digits = F.regexp_replace(bare, "[.,]", "")
    return F.when(valid, digits.cast("double") / 100.0)


def iso_date(text: Column, pattern: str = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})$", pivot: int = 50) -> Column:
    """d/m/y as yyyy-mm-dd where the calendar has that day; two-digit years turn at ``pivot``."""
    d, m, y = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") < pivot, "20").otherwise("19"), y)).otherwise(y)
    text_iso = F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    day, month, num = d.cast("int"), m.cast("int"), year.cast("int")
    leap = ((num % 4 == 0) & (num % 100 != 0)) | (num % 400 == 0)
    longest = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when((d != "") & (month >= 1) & (month <= 12) & (day >= 1) & (day <= longest), text_iso)


def normalise_dates(field: DataFrame) -> DataFrame:
    """Date values to ISO; what is no calendar day stays as written."""
    return field.withColumn("value", F.when(F.col("field_type") == "date", F.coalesce(iso_date(F.col("value")), F.col("value"))).otherwise(F.col("value")))


def custom_key(template: Column, raw: Column) -> Column:
    clean = lambda v, default: F.regexp_replace(F.regexp_replace(F.lower(F.when(F.coalesce(v, F.lit("")) == "", default).otherwise(v)), "[^a-z0-9_]", "_"), "^_+|_+$", "")
    return F.concat(F.lit("custom."), clean(template, "template"), F.lit("."), clean(raw, "field"))


def key_label(keyed: DataFrame, entry: DataFrame, key: str = "key") -> DataFrame:
    """Display label of a key: catalogue entry, custom field name, or the key itself."""
    e = entry.select(F.col("key").alias(key), F.concat_ws(" > ", "category", "label").alias("_label"))
    parts = F.split(key, r"\.")
    tail = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), ".")
    custom = F.concat(F.lit("Campo Personalizzato: "), F.when(tail != "", tail).otherwise(F.coalesce(F.get(parts, 1), F.lit("campo"))))
    return keyed.join(e, key, "left").withColumn(
        "display", F.coalesce("_label", F.when(F.col(key).startswith("custom."), custom), F.col(key), F.lit("Nessuna associazione (Non assegnata)"))).drop("_label")


# ---------------------------------------------------------------- receipts
# Words that mark a total, fragments and whole words that no item line has, and how amounts and days are written.
TOTAL_WORDS = ("TOTALE",)
BARRED_PARTS = ("SUBTOTALE", "SUB TOTALE", "TOTALE IMPOSTA", "TOTALE CONTANTE", "TOTALE PAGATO", "RESTO", "BANCOMAT", "CARTA", "PAGAMENTO", "CONTANTI", "IVA",
                "IMPONIBILE", "SCONTO")
BARRED_WORDS = ("TEL", "CASSA", "DOCUMENTO", "EURO", "EUR")
CURRENCY_WORDS = ("EURO", "EUR")
AMOUNT = r"(-?\d+(?:[.,]\d{3})*[.,]\d{2})"
DATE = r"\b(\d{2})[/.\-](\d{2})[/.\-](\d{4}|\d{2})\b"


def _words(words: Sequence[str]) -> str:
    return "(?:" + "|".join(r"\s+".join(re.escape(part) for part in w.split()) for w in words) + ")"


def _with_lines(document: DataFrame, total: Sequence[str], parts: Sequence[str], words: Sequence[str]) -> DataFrame:
    """``_lines``: one struct for each line that is not empty, in order."""
    is_sum = rf"(?i)\b{_words(total)}\b"
    # a look at the first letter spares most places the list of words
    begins = "".join(sorted({re.escape(w[0]) for w in (*parts, *words)}))
    barred = rf"(?i)(?=[{begins}])(?:{_words(parts)}|\b{_words(words)}\b)" if begins else rf"(?i){_words(parts)}|\b{_words(words)}\b"
    tail = "(?i)" + AMOUNT + r"\s*(?:€|EUR|[A-Z])?\s*$"
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")

    def tested(line: Column, i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("line_no"), line.alias("line"), F.regexp_extract(line, tail, 1).alias("own"), line.rlike(is_sum).alias("sum"), line.rlike(barred).alias("barred"),
            F.coalesce(F.get("_l", i + 1), F.lit("")).alias("next"), F.regexp_extract(line, DATE, 0).alias("day"))

    # what few lines need is looked at on those lines only, and each answer is written down before it is used twice
    def roled(t: Column) -> Column:
        is_total = t["sum"] & ~F.regexp_replace(t["line"], rf"(?i)\b{_words(CURRENCY_WORDS)}\b", "").rlike(barred)
        is_item = ~t["sum"] & ~t["barred"] & (t["own"] != "") & (t["day"] == "") & F.trim(F.regexp_replace(t["line"], tail, "")).rlike("[A-Za-zÀ-ÿ]{2}")
        return F.struct(t.alias("t"), F.when(is_total, "total").when(is_item, "item").otherwise("other").alias("role"))

    def judged(r: Column) -> Column:
        t, role = r["t"], r["role"]
        below = F.regexp_extract(t["next"], r"^\s*" + AMOUNT + r"\s*€?\s*$", 1)
        return F.struct(
            t["line_no"].alias("line_no"), t["line"].alias("line"), role.alias("role"),
            F.when(role != "other", money(F.when(t["own"] == "", below).otherwise(t["own"]))).alias("amount"),
            F.when(t["day"] != "", iso_date(t["day"], r"^(\d{2})[/.\-](\d{2})[/.\-](\d{4}|\d{2})$", pivot=100)).alias("date"),
            (t["line"].rlike("[A-Za-zÀ-ÿ]{3}") & ~t["barred"] & ~t["sum"]).alias("names"))

    split = document.withColumn("_l", lines)
    return split.withColumn("_t", F.transform("_l", tested)).withColumn("_lines", F.transform(F.transform("_t", roled), judged)).drop("_l", "_t")


def receipt_lines(document: DataFrame, doc: str = "doc_id", total: Sequence[str] = TOTAL_WORDS, parts: Sequence[str] = BARRED_PARTS,
                  words: Sequence[str] = BARRED_WORDS) -> DataFrame:
    """Non-empty lines with their role: total (amount on the line or alone on the next), item or other."""
    return _with_lines(document, total, parts, words).select(doc, F.inline("_lines"))


def receipt_reconcile(document: DataFrame, doc: str = "doc_id", total: Sequence[str] = TOTAL_WORDS, parts: Sequence[str] = BARRED_PARTS,
                      words: Sequence[str] = BARRED_WORDS) -> DataFrame:
    """Unique total (else null), sum of the items before it, difference, date and merchant, one row per receipt with a line.

    A receipt is one row, so all of it is settled inside that row, without a shuffle.
    """
    # a condition on the judged lines would be moved below them, and judge every line once more, its text split anew for each
    written = document.where(F.exists(F.split("text", r"\r?\n"), lambda s: F.trim(s) != ""))
    read = _with_lines(written, total, parts, words)
    known = F.filter("_lines", lambda e: (e["role"] == "total") & e["amount"].isNotNull())
    first = lambda test, value: F.get(F.filter("_lines", test), 0)[value]
    read = read.withColumn("_known", known).withColumn("_only", F.when(F.size("_known") == 1, F.get("_known", 0)))
    items = F.filter("_lines", lambda e: (e["role"] == "item") & (F.col("_only").isNull() | (e["line_no"] < F.col("_only.line_no"))))
    read = read.withColumn("_items", items)
    spent = F.aggregate("_items", F.lit(0.0), lambda acc, e: acc + F.coalesce(e["amount"], F.lit(0.0)))
    read = read.withColumns({"_total": F.col("_only.amount"), "_spent": half_up(spent * 100) / 100})
    return read.select(
        doc, F.col("_total").alias("total"), F.size("_items").cast("bigint").alias("items"), F.col("_spent").alias("items_sum"),
        (half_up((F.col("_total") - F.col("_spent")) * 100) / 100).alias("difference"), first(lambda e: e["date"].isNotNull(), "date").alias("date"),
        first(lambda e: e["names"], "line").alias("merchant"))


# ---------------------------------------------------------------- values written next to prompts
def inline_values(token: DataFrame, prompts: Sequence[str], by: Sequence[str] = PAGE) -> DataFrame:
    """Label and value on one line: dated prompts, known prompts, placeholders, underscore runs, choices.

    ``prompts`` are the known labels (regular expressions), tried as one alternation.
    """
    known = "(?:" + "|".join(prompts) + ")"
    dated = rf"(?i)^({known})[\s_:]+(\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}})\s*$"
    said = rf"(?i)^({known})\s*:?\s+(.+)$"
    get = lambda p, g: F.regexp_extract("text", p, g)
    bracket = tidy(F.regexp_replace(F.regexp_replace("text", r"^\s*\[", ""), r"\]\s*$", ""))
    run = rf"(?i)({known})\s*:?\s*_{{3,}}"
    choice = r"(?i)^\[\s*(x?)\s*\]\s*(.+)$"
    kind = (F.when(get(dated, 1) != "", "date").when(F.col("text").rlike(r"^\s*\[[^\]]{2,}\]\s*$") & bracket.rlike(rf"(?i)^{known}$"), "placeholder")
            .when(F.col("text").rlike(run), "underscore").when(F.col("text").rlike(choice), "choice").when(get(said, 1) != "", "value"))
    label = (F.when(F.col("kind") == "date", tidy(get(dated, 1))).when(F.col("kind") == "placeholder", bracket).when(F.col("kind") == "underscore", tidy(get(run, 1)))
             .when(F.col("kind") == "choice", tidy(get(choice, 2))).otherwise(tidy(get(said, 1))))
    value = (F.when(F.col("kind") == "date", get(dated, 2)).when(F.col("kind").isin("placeholder", "underscore"), "")
             .when(F.col("kind") == "choice", F.when(get(choice, 1) != "", "true").otherwise("false")).otherwise(tidy(get(said, 2))))
    marked = token.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return marked.withColumns({"label": label, "value": value})


# What a printed square looks like to a reader: brackets with at most one sign between them, or a sign before a closing one.
MARKS = r"^(?:[\[(]\s*[COQxX015LD]?\s*[\])]|[COQ015]\s*[\])])$"


def mark_choices(token: DataFrame, heights: DataFrame, choice: str, by: Sequence[str] = PAGE, marks: str = MARKS) -> DataFrame:
    """Marks that stand for a checkbox, with the choice beside them: ``token_id``, ``label``, ``value`` (whether the mark holds an x).

    The first word to the right, less than three text heights away and on the same row, and the words after it up to ten heights on make the
    caption; marks whose caption does not begin with ``choice`` are no choices.
    """
    keys = [*by, "token_id"]
    a, b = box("a_"), box("b_")
    th = F.col("a_th")
    sized = token.join(heights.select(*by, "typical_h"), list(by), "left").withColumn("th", F.coalesce("typical_h", F.lit(20.0)))
    mark = sized.where(F.trim("text").rlike(marks)).select(*keys, "x", "y", "w", "h", "th", "text")
    words = token.select(*by, "token_id", "x", "y", "w", "h", "text")
    reach = box().grown(F.lit(2.0), F.col("th"), F.col("th") * 13, F.col("th"))
    near = near_join(mark, words, by, reach=reach, b_extent=Box(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0)), tile=512.0).where(
        (F.col("a_token_id") != F.col("b_token_id")) & (b.x >= a.right - 2) & (F.abs(b.y - a.y) < th)).withColumnRenamed("a_token_id", "token_id")
    first = best_partner(near.where(b.x - a.right < th * 3), keys, [F.col("b_x"), F.col("b_token_id")], {"_x": F.col("b_x"), "_y": F.col("b_y")})
    row = near.join(first, keys).where((F.abs(F.col("b_y") - F.col("_y")) < th * 0.65) & (F.col("b_x") >= F.col("_x")) & (F.col("b_x") < F.col("_x") + th * 10))
    said = row.groupBy(*keys).agg(F.any_value("a_text").alias("_mark"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("b_x").alias("x"), F.col("b_token_id").alias("t"), F.col("b_text").alias("s")))), lambda e: e["s"]), " ").alias("label"))
    return said.where(F.col("label").rlike(f"(?i)^(?:{choice})\\b")).select(*keys, tidy(F.col("label")).alias("label"), F.lower("_mark").contains("x").alias("value"))
