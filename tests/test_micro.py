"""Small cases whose answers are known by hand."""

import pytest
from pyspark.sql import functions as F

from folioframe.functions.keys import corroboration_key, reading_key, slug
from folioframe.operators import audit, geometry, layout, readings, semantics, structure, templates
from folioframe.plans.graphs import components

BY = ("page_id",)
FIELD = "page_id bigint, field_id bigint, x double, y double, w double, h double, status string"
WORD = "page_id bigint, token_id bigint, line_id bigint, x double, y double, w double, h double, text string, text_key string, conf double, source string"


def coverage(table, fields):
    region = table([(1, 1, 0.0, 0.0, 100.0, 100.0)], "page_id bigint, region_id bigint, x double, y double, w double, h double")
    return geometry.union_coverage(region, table(fields, FIELD), BY).first()


def test_union_coverage_counts_overlap_once(table):
    twice = [(1, 1, 0.0, 0.0, 40.0, 100.0, "review"), (1, 2, 0.0, 0.0, 40.0, 100.0, "review")]
    assert coverage(table, twice).coverage == pytest.approx(0.4)
    full = coverage(table, twice + [(1, 3, 40.0, 0.0, 60.0, 100.0, "review")])
    assert full.coverage == pytest.approx(1.0) and full.covered
    assert coverage(table, [(1, 1, 0.0, 0.0, 40.0, 100.0, "ignored")]).coverage == 0


def test_union_coverage_across_strips(table):
    region = table([(1, 1, 0.0, 0.0, 1000.0, 10.0)], "page_id bigint, region_id bigint, x double, y double, w double, h double")
    fields = table([(1, i, i * 100.0, 0.0, 150.0, 10.0, "review") for i in range(5)], FIELD)
    assert geometry.union_coverage(region, fields, BY, strip=64.0).first().coverage == pytest.approx(0.55)


def test_split_keeps_spelling(table):
    a = table([(1, 1, 0, 0.0, 0.0, 300.0, 60.0, "Anna  Verdi", "annaverdi", 50.0, "ocr")], WORD)
    b = [(1, 10, 0, 10.0, 10.0, 100.0, 30.0, "ANNA", "anna", 80.0, "ocr"), (1, 11, 0, 150.0, 10.0, 100.0, 30.0, "VERDI", "verdi", 80.0, "ocr")]
    got = readings.split_coarse_tokens(a, table(b, WORD), None, BY).orderBy("part_no").collect()
    assert [(r.text, r.x, r.outcome) for r in got] == [("Anna", 10.0, "split"), ("Verdi", 150.0, "split")]
    alone = readings.split_coarse_tokens(a, table(b[:1], WORD), None, BY).collect()
    assert [(r.text, r.outcome) for r in alone] == [("Anna  Verdi", "kept")]


@pytest.mark.parametrize("conf,rows", [(70.0, 0), (96.0, 1)])
def test_new_number_needs_strong_local_reading(table, conf, rows):
    a = table([(1, 1, 0, 0.0, 0.0, 50.0, 20.0, "Ore", "ore", 90.0, "ocr")], WORD)
    word = lambda i, c: (1, i, 0, 100.0, 0.0, 40.0, 20.0, "30", "30", c, "ocr")
    region = table([(1, 90.0, 0.0, 100.0, 40.0)], "page_id bigint, x double, y double, w double, h double")
    page = table([(1, 600.0, 800.0)], "page_id bigint, page_w double, page_h double")
    got = readings.recover_missing(a, table([word(5, conf)], WORD), table([word(9, 85.0)], WORD), region, page, BY)
    assert got.count() == rows


def test_school_years(table):
    texts = ["anno scolastico 2025/26", "dicembre 2005", "gennaio 2006", "a.s. 2019", "nessuna"]
    got = [r[0] for r in table([(t,) for t in texts], "t string").select(semantics.school_year(F.col("t"))).collect()]
    assert got == ["2025/2026", "2005/2006", "2005/2006", "2019/2020", None]


def test_receipt_total_on_next_line_and_two_totals(table):
    text = "Bar Roma\n03/02/2024\nCaffe 1,20\nPane 2,30\nTOTALE EURO\n3,50\nRESTO 1,50"
    r = semantics.receipt_reconcile(table([(1, text), (2, text + "\nTOTALE 3,50")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert (r[0].total, r[0].items_sum, r[0].difference, r[0].date, r[0].merchant) == (3.5, 3.5, 0.0, "2024-02-03", "Bar Roma")
    assert r[1].total is None and r[1].difference is None


def test_missing_baseline_stays_null(table):
    base = table([(1, 5), (2, 7)], "page_id bigint, baseline_fields bigint")
    got = {r.page_id: (r.delta, r.missing) for r in audit.baseline_delta(table([(1, 6)], "page_id bigint, measured_fields bigint"), base, BY).collect()}
    assert got == {1: (1, False), 2: (None, True)}


def test_overflow_first_fit_and_policy(table):
    rows = [("ciao", 100.0, 30.0, "RIGID"), ("parola " * 400, 100.0, 30.0, "CONTINUABLE"), (" ", 100.0, 30.0, "RIGID"), ("uno due tre quattro cinque sei", 60.0, 45.0, "RIGID")]
    got = audit.overflow_audit(table(rows, "text string, w double, h double, policy string")).collect()
    assert (got[0].font_size, got[0].tracking, got[0].line_height, got[0].action) == (12.0, 0.0, 1.5, "NONE")
    assert got[1].overflows and got[1].action == "CONTINUATION_BLOCK"
    assert got[2].font_size == 10.0 and not got[2].overflows
    def lines(limit):
        n, at = 0, 0
        for word in rows[3][0].split(" "):
            if at == 0:
                at = len(word)
            elif at + 1 + len(word) <= limit:
                at += 1 + len(word)
            else:
                n, at = n + 1, len(word)
        return n + (at > 0)
    want = next((f, t, lh) for f in (12, 11, 10, 9, 8) for t in (0, -0.5, -1.0, -1.5) for lh in (1.5, 1.35, 1.2)
                if lines(max(1, int(56 // max(2, f * 0.52 + t)))) * f * lh <= 46)
    assert (got[3].font_size, got[3].tracking, got[3].line_height) == want


def test_hash_and_keys(table):
    df = table([("abc", "Città  n° Ⅳ")], "a string, b string")
    r = df.select(templates.legacy_hash(F.col("a")).alias("h"), reading_key("b").alias("k"), corroboration_key("b").alias("c"), slug(F.col("b")).alias("s")).first()
    assert r.h.startswith("1a47e90b") and r.k == "CITTÀN°IV" and r.c == "CITTAN°IV" and r.s == "citta_n"


def test_components_of_a_long_chain(table):
    node = table([(1, i) for i in range(40)], "page_id bigint, n bigint")
    edge = table([(1, i, i + 1) for i in range(39) if i != 19], "page_id bigint, a bigint, b bigint")
    got = {r.n: r.component for r in components(node, edge, BY, "n", "a", "b").collect()}
    assert got == {i: 0 if i < 20 else 20 for i in range(40)}


def grid(table, rows):
    return table(rows, "page_id bigint, cell_id bigint, x double, y double, w double, h double")


def test_header_is_not_inherited_across_a_gap(table):
    cells = grid(table, [(1, 1, 0.0, 0.0, 100.0, 20.0), (1, 2, 0.0, 20.0, 100.0, 20.0), (1, 3, 0.0, 80.0, 100.0, 20.0)])
    word = [(1, 1, 0, 10.0, 4.0, 40.0, 12.0, "Nome", "nome", 90.0, "ocr")]
    heights = table([(1, 12.0)], "page_id bigint, typical_h double")
    names = table([("nome", "Nome", "text", False)], "header_key string, label string, type string, is_group boolean")
    none = table([], WORD)
    head = structure.column_headers(cells, table(word, WORD), none, names, heights, BY)
    got = {r.cell_id: r.label for r in structure.header_ancestors(cells, head, heights, BY).collect()}
    assert got == {2: "Nome"}


def test_merged_header_has_no_leaf(table):
    cells = grid(table, [(1, 1, 0.0, 0.0, 200.0, 20.0), (1, 2, 0.0, 20.0, 100.0, 20.0), (1, 3, 100.0, 20.0, 100.0, 20.0)])
    word = table([(1, 1, 0, 10.0, 4.0, 40.0, 12.0, "Nome", "nome", 90.0, "ocr")], WORD).withColumn("is_prompt", F.lit(False))
    heights = table([(1, 12.0)], "page_id bigint, typical_h double")
    names = table([("nome", "Nome", "text", False)], "header_key string, label string, type string, is_group boolean")
    field = table([], "page_id bigint, field_id bigint, x double, y double, w double, h double, label string, generic boolean, derivation string, calibration_status string")
    page = table([(1, 600.0, 800.0)], "page_id bigint, page_w double, page_h double")
    keys = table([], "key string")
    got = {r.cell_id: r.reason for r in structure.associate_fields(cells, word, table([], WORD), field, page, names, keys, heights, BY).collect()}
    assert got == {1: "COLUMN_HEADER_STATIC", 2: "MERGED_HEADER_WITHOUT_LEAF", 3: "MERGED_HEADER_WITHOUT_LEAF"}


def test_personal_values_are_not_kept(table):
    schema = ("template_id bigint, field_id string, label string, suggested_key string, semantic_key string, field_type string, background_mode string, "
              "calibration_status string, detection_source string, derivation string, confidence double, default_value string")
    field = table([(1, "f1", "Nome", "student.name", None, None, None, "PROPOSED", None, None, None, "Anna Verdi")], schema)
    out = semantics.bind_semantics(field, table([], "semantic_key string"), table([], "alias string, canonical_key string"), table([(1, "f1", "Anna Verdi")], "template_id bigint, ref string, value string"))
    row = out.first()
    assert row.has_evidence and row.confidence is None and "Anna Verdi" not in str(row.asDict())


def test_large_dictionary_path_equals_small(table):
    doc = table([(1, "La casa ROSSA è qui"), (2, "mare e monti"), (3, "a")], "doc_id int, text string")
    sig = table([(t,) for t in ("casa", "rossa", "mare", "è", "e m", "zz", "a")], "token string")
    pairs = lambda limit: sorted(map(tuple, semantics.matched_signatures(doc, sig, inline_limit=limit).collect()))
    assert pairs(256) == pairs(2) and (1, "casa") in pairs(2)


def test_duplicate_registration_is_refused(table):
    cand = table([("B", "f", 2, 2, True, True, True)], "template_id string, fingerprint string, page_count int, pages_listed int, readable boolean, has_geometry boolean, has_schema boolean")
    row = templates.validate_template(cand, table([("A", "f")], "template_id string, fingerprint string")).first()
    assert row.issues == ["DUPLICATE_FINGERPRINT"] and not row.is_valid


def test_fold_over_bands_equals_whole_page(table, monkeypatch):
    from folioframe.plans import folds

    rows = [(1, i, i // 8, float(i % 8 * 40), float(i // 8 * 24 + i % 3), 30.0, 12.0, f"w{i}", f"w{i}", 80.0, "ocr") for i in range(64)]
    word = table(rows, WORD)
    whole = sorted(map(tuple, layout.reconstruct_text(word, BY).collect()))
    monkeypatch.setattr(folds, "FOLD_LIMIT", 10)
    assert sorted(map(tuple, layout.reconstruct_text(word, BY).collect())) == whole


def test_overflow_shares_and_differing_rows(table):
    value = table([("s", "a b", 100.0, 40.0, "RIGID"), ("s", "word " * 400, 60.0, 20.0, "RIGID"), ("t", None, 60.0, 20.0, "RIGID")], "source string, text string, w double, h double, policy string")
    shares = {r["source"]: (r["values"], r["overflowing"], r["overflow_share"]) for r in audit.overflow_shares(audit.overflow_audit(value), ["source"]).collect()}
    assert shares == {"s": (2, 1, 0.5), "t": (1, 0, 0.0)}
    once, twice = table([(1,), (1,), (2,)], "k int"), table([(1,), (2,), (3,)], "k int")
    assert sorted(map(tuple, audit.same_result(once, twice).collect())) == [(1, 1), (3, 2)]
    assert audit.same_result(once, once).isEmpty()
