"""Each corpus operator on page records: plain versions, and nulls, empty and long texts, repeats, empty tables, clashing columns."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioframe.llm import language, licenses, packing, pieces, quality, similar, surrogates, token_files, tokens, urls, vectors

PAGE = "doc_id long, page_no int, text string, lang string, source string, score double, node string, entities string"
BY = ("doc_id", "page_no")
WORDS = "la casa nel bosco verde con tre finestre aperte sul mare calmo di notte quando arriva il vento freddo dal nord".split()
ENGLISH = "the house in the green wood with three open windows on the calm sea at night when the cold wind comes from north".split()


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


EDGES = [(1, 1, None), (2, 1, ""), (3, 1, "  \n\t"), (4, 1, "Ä"), (None, 1, "una casa"), (5, 1, prose(5, 60)), (5, 1, prose(5, 60)), (6, 1, prose(6, 20_000)), (7, 1, "12 34 ###")]


@pytest.fixture
def pages(spark):
    # columns beside the key and text that operators name their results after
    return lambda rows: spark.createDataFrame([(d, p, t, "it", "app", 0.5, "x", "y") for d, p, t in rows], PAGE)


def by_row(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: tuple((v is None, str(type(v)), v) for v in list(r.values())[:2]))


# language


def test_language_filters_tell_languages_apart(spark, pages):
    rows = [(k, 1, prose(k, 40, WORDS if k % 2 else ENGLISH)) for k in range(80)]
    known = pages(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "it").otherwise("en"))
    filters = language.learn_filters(known.where("doc_id < 60"))
    got = by_row(language.page_language(pages(rows).where("doc_id >= 60"), filters))
    assert len(got) == 20 and all(r["lang_pred"] == ("it" if r["doc_id"] % 2 else "en") and r["score"] > 0.9 for r in got)
    # plain version: sets of n-grams instead of bits
    sets = {}
    for lang in filters.languages:
        count = collections.Counter()
        for k, _, t in rows[:60]:
            if ("it" if k % 2 else "en") == lang:
                count.update(set(language.grams([t])[0].tolist()))
        sets[lang] = {g for g, n in count.items() if n >= 2}
    for k, _, t in rows[60:]:
        h = language.grams([t])[0].tolist()
        best = max(filters.languages, key=lambda l: sum(g in sets[l] for g in h))
        assert best == filters.decide([t])[0][0]
    edge = by_row(language.page_language(pages(EDGES), filters, carry=("score", "node")))
    assert len(edge) == len(EDGES) and [r["lang_pred"] for r in edge if r["doc_id"] in (1, 2, 3, 7)] == ["und"] * 4
    assert all(r["lang_pred"] in ("it", "en") for r in edge if r["doc_id"] in (4, 5, 6, None)) and all(0 <= r["score"] <= 1 for r in edge)
    assert language.page_language(pages([]), filters).count() == 0
    nobody = language.learn_filters(pages([]))
    assert {r["lang_pred"] for r in by_row(language.page_language(pages(EDGES), nobody))} == {"und"}


def test_language_held_out_accuracy(spark):
    from folioframe.llm.queries import op1_language

    got = op1_language(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


# licenses


def test_licenses_match_plain_search():
    rng = random.Random(3)
    notices = tuple(licenses.NOTICES.items())
    for _ in range(400):
        notice, label = rng.choice(notices)
        letters = list(notice)
        for _ in range(rng.randint(0, licenses.edits_of(notice) + 1)):
            at = rng.randrange(len(letters))
            kind = rng.randrange(3)
            letters[at:at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcxyz")]
        line = " ".join(f"{prose(rng.random(), 6)} {''.join(letters)} {prose(rng.random(), 6)}".split())
        found = {s[0] for s in licenses.near_notices(line, notices)}
        plain = {l for n, l in notices if regex.search(rf"(?<![^ ])(?:{regex.escape(n, literal_spaces=True)}){{e<={licenses.edits_of(n)}}}(?![^ ])", line)}
        assert found <= plain and (not plain or found) and (label in found or label not in plain or {"gpl-2", "gpl-3"} & found)


def test_licenses_find_every_place():
    notices = tuple(licenses.NOTICES.items())
    line = "foo under the mit licence or under the mit license bar"
    assert [s[1:4] for s in licenses.near_notices(line, notices)] == [(4, 25, 1), (29, 50, 0)]
    rng = random.Random(4)
    notice, bound = "under the mit license", 2
    for _ in range(40):
        words = []
        for _ in range(12):
            letters = list(notice)
            for at in rng.sample([k for k, c in enumerate(letters) if c != " "], rng.randint(0, bound + 1)):
                letters[at] = "q"
            words += ["".join(letters), rng.choice(["or", "license", "so the mit"])]
        line = " ".join(words)
        plain = set()
        for at in range(len(line) - len(notice) + 1):  # letters are replaced only, so a place has the length of the notice
            if (at == 0 or line[at - 1] == " ") and line[at + len(notice):at + len(notice) + 1] in ("", " "):
                if sum(a != b for a, b in zip(notice, line[at:])) <= bound:
                    plain.add(at)
        found = [s for s in licenses.near_notices(line, notices) if s[0] == "mit"]
        assert all(any(s[1] < at + len(notice) and at < s[2] for s in found) for at in plain) and len(found) >= len(plain)


def test_licenses_base_and_edges(pages):
    text = "Under the MIT License. under the mit license; CC BY-NC 4.0 and the Apache License, Version 2; under the nit licence"
    rows = by_row(licenses.license_notices(pages([(1, 1, text), *EDGES[1:]])))
    assert len(rows) == len(EDGES)
    first = rows[0]
    assert (first["n_words"], first["n_base"], first["first_word"], first["last_word"]) == (23, 4, 0, 15)
    assert first["base_labels"] == "apache-2,cc-by-nc,mit" and first["labels"] == first["base_labels"] and first["score"] == 1.0
    assert any(s["edits"] == 2 and s["found"] == "under the nit licence" for s in first["spans"])
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" for r in rows[1:])
    assert licenses.license_notices(pages([])).count() == 0


# tokens, packing, token files


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_tokenizer_is_the_library(name):
    path = public_tokenizers.path(name)
    mine, library = tokens.WordTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    signs = list(" abcdeinrst.,;'\n\t0123_-()<>éüÀß漢😀\x1c\x85\xa0\xadªº½ﬁ  ") + ["'s", " 'T", "the", "ING", " {", "<|endoftext|>", "ǅ", "İ", "  ", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_differencing_balances():
    rng = random.Random(2)
    for bins in (1, 2, 5, 17):
        sizes = [rng.randint(1, 256) for _ in range(bins * 6)]
        chosen = packing.differencing(sizes, bins)
        sums = np.bincount(chosen, weights=sizes, minlength=bins)
        assert len(chosen) == len(sizes) and chosen.min() >= 0 and chosen.max() < bins and sums.max() - sums.min() <= 32
        assert np.bincount(packing.windows_of(sizes, 256), weights=sizes).max() <= 256
    assert packing.windows_of([1024, 1024, 1], 1024).tolist().count(0) >= 1


def test_packing_covers_every_id(pages):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*EDGES, *[(100 + k, 1, prose(k, 10 * k)) for k in range(80)]]
    got = packing.pack_pages(pages(rows), path, by=("doc_id",)).toPandas()
    want = collections.Counter((d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, _, t in rows)
    held = collections.Counter()
    for d, g in got.groupby("doc_id", dropna=False):
        copies = g[g.start == 0].shape[0]
        g = g.sort_values("start", kind="stable")
        whole = b"".join(x for _, x in g.drop_duplicates("start").sort_values("start").ids.items())
        held[None if np.isnan(d) else int(d), whole] += copies
    assert held == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024 and set(g.window_tokens) == {g.length.sum()}
    used = got.groupby("sequence_id").length.sum()
    assert (1024 - used).sum() <= 0.05 * used.sum() + 1024
    assert packing.pack_pages(pages([]), path).count() == 0


def test_code_is_shortest_and_limited():
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 400):
        counts = [rng.randint(1, 10 ** rng.randint(1, 6)) for _ in range(n)]
        lengths = token_files.code_lengths(counts)
        assert n == 1 or abs(sum(2.0 ** -x for x in lengths) - 1) < 1e-9
        heap = sorted(counts)
        cost = 0
        while len(heap) > 1:
            pair = heap.pop(0) + heap.pop(0)
            cost += pair
            heap = sorted([*heap, pair])
        if max(lengths) < token_files.MOST_BITS and n > 1:
            assert sum(c * x for c, x in zip(counts, lengths)) == cost
    assert max(token_files.code_lengths([2 ** k for k in range(40)], most=8)) <= 8


def test_token_files_round_trip(spark, pages):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*EDGES, *[(1000 - k, 1, prose(k, 3 * k)) for k in range(200)]]
    folder = token_files.write_token_files(pages(rows), path, token_files.new_folder(spark))
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(((d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, _, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    at = 0
    assert len(got) == len(want)
    for r, (d, ids) in zip(got, want):
        assert (r.doc_id, r.start, r.n_tokens) == (d, at, len(ids)) and zlib.crc32(r.ids) == zlib.crc32(ids.tobytes())
        at += len(ids)
    empty = token_files.write_token_files(pages([]), path, token_files.new_folder(spark))
    assert token_files.read_token_files(spark, empty).count() == 0


# pieces


def test_pieces_are_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    mine, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    signs = list(" abcdeinrst.,;'\n\t0123_-()<>▁éü漢字😀\x00ﬁ  ") + ["the", "ing", "function", " {", "});\n", "==", "  ", "<0x0A>", "<s>", "<unk>"]
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        ids = mine.encode(text)
        assert ids == library.encode(text) and mine.decode(ids) == library.decode(ids), repr(text)


def test_pieces_of_pages(pages):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode_pages(pages(EDGES), path, carry=("text",)).collect()
    assert len(got) == len(EDGES) and all(r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids) for r in got)
    assert pieces.encode_pages(pages([]), path).count() == 0


# similarity


def classes_of(rows, threshold=0.8):
    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    nodes = collections.defaultdict(list)
    for (d, _), s in zip(rows, sets):
        if s:
            nodes[s].append(d)
    links, parent = collections.Counter(), {s: s for s in nodes}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in itertools.combinations(nodes, 2):
        if 10 * len(a & b) >= 8 * len(a | b):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for s, ids in nodes.items():
        least[root(s)] = min([*ids, least.get(root(s), ids[0])])
    return {d: (least[root(s)], links[s], len(nodes[s])) if s else (d, 0, 1) for (d, _), s in zip(rows, sets)}


def test_similar_pages_match_all_pairs(spark, pages):
    rng = random.Random(6)
    rows = []
    for g in range(30):
        words = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.choice([3, 30, 90]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = "altro"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900 + k, t) for k, t in enumerate(["", None, "???", "una", "Una!"])]
    got = similar.similar_pages(pages([(d, 1, t) for d, t in rows]), by=("doc_id",)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got} == classes_of(rows)
    assert sum(r["first"] for r in got) == len({r.class_id for r in got})


def test_similar_pages_in_blocks(spark, pages, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for d in range(40):
        copy = list(base)
        for _ in range(d % 4):
            copy[rng.randrange(120)] = f"x{d}"
        rows.append((d, " ".join(copy)))
    got = similar.similar_pages(pages([(d, 1, t) for d, t in rows]), by=("doc_id",)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got} == classes_of(rows)


def test_similar_pages_edges(pages):
    got = similar.similar_pages(pages(EDGES)).collect()
    assert len(got) == len(EDGES) and [r.n_copies for r in got if r.doc_id == 5] == [2, 2] and all(r.n_links == 0 for r in got)
    assert similar.similar_pages(pages([])).count() == 0


def test_posterior_bound():
    # no pair that surely reaches the threshold is dropped; hopeless ones are at the first look
    least = similar.least_matches(0.8, 1e-4)
    assert all(a < b for a, b in zip(least, least[1:])) and least[0] >= 12 and least[-1] <= 0.8 * similar.HASHES


# vectors


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    values = rng.standard_normal((600, 24)).astype("float32")
    values[100:300] = values[7]  # one vector that a third of the rows share
    rows = [(k, v.tolist(), "x") for k, v in enumerate(values)] + [(900, None, "x"), (901, [0.0] * 24, "x"), (902, [float("nan")] * 24, "x"), (903, [None] + [1.0] * 23, "x"), (904, [1.0], "x"), (905, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in sorted(vectors.nearest_vectors(table, table.where("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    v = values.astype("float64")
    size = np.sqrt((v * v).sum(axis=1))
    hits = 0
    for q in range(0, 600, 50):
        score = v @ v[q] / (size * size[q])
        order = [k for k in np.lexsort((np.arange(600), -np.round(score, 12))) if k != q][:5]
        assert len(got[q]) == 5 and all(abs(s - score[k]) < 1e-12 for k, s in got[q])
        hits += len({k for k, _ in got[q]} & set(order))
    assert set(got) == set(range(0, 600, 50)) and hits >= 0.9 * 60 and [k for k, _ in got[150]] == [7, 100, 101, 102, 103]
    assert vectors.nearest_vectors(table.limit(0), table.limit(0)).count() == 0
    few = table.where("vec_id < 3")
    assert vectors.nearest_vectors(few, few.where("vec_id = 0")).count() == 2


def test_nearest_vectors_where_lists_exceed_probes(spark):
    rng = np.random.default_rng(5)
    n = 30_000  # 173 lists
    values = rng.standard_normal((n, 64)).astype("float32")
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(values))}))
    got = collections.defaultdict(set)
    for r in vectors.nearest_vectors(table, table.where("vec_id % 100 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    hits = sum(len(got[q] & {k for k in np.argsort(-(unit @ unit[q]))[:6].tolist() if k != q}) for q in range(0, n, 100))
    assert len(got) == 300 and hits >= 0.9 * 5 * 300


# quality


def test_quality_counts_and_lines(spark, pages):
    boiler = "Tutti i diritti  RISERVATI al sito di questa casa editrice"
    rows = [(k, 1, f"{boiler}\n{prose(k, 40)}") for k in range(60)] + [(100 + k, 1, f"{boiler}\n{boiler.upper()}\n{prose(k, 4)}") for k in range(3)]
    got = {r.doc_id: r for r in quality.page_quality(pages([*rows, *[(500 + k, 1, t) for k, (_, _, t) in enumerate(EDGES)]])).collect()}
    assert all(got[k].kept and got[k].words_left == got[k].n_words - 10 and len(got[k].removed) == 1 for k in range(60))
    assert not any(got[100 + k].kept for k in range(3)) and got[100].n_dup_lines == 0
    assert (got[500].n_words, got[500].base_failed, got[500].kept) == (0, True, False) and got[508].n_symbols == 3
    cleaned = quality.remove_lines(pages(rows[:2]).join(quality.page_quality(pages(rows)).select("doc_id", "removed"), "doc_id")).collect()
    assert all(boiler not in r.text and r.text == prose(r.doc_id, 40) for r in cleaned)
    assert quality.page_quality(pages([])).count() == 0


def test_quality_limit_is_the_same_for_big_hosts(pages):
    line = "tutti i diritti sono riservati alla casa"
    rows = [(k, 1, f"{prose(k, 40)}\n{line if k < 25 else prose(-k, 7)}") for k in range(400)]
    copy = [prose(9000 + k, 12) for k in range(20)]
    rows += [(1000 + k, 1, "\n".join([*copy, f"copia {k}"])) for k in range(50)]  # near copies of one text count once
    got = {r.doc_id: r for r in quality.page_quality(pages(rows)).collect()}
    assert all(len(got[k].removed) == (k < 25) for k in range(400))
    assert not any(got[1000 + k].removed for k in range(50)) and got[1000].kept


def test_repeated_words_match_plain_loops():
    rng = random.Random(8)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        count = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        plain = {k + j for k in range(len(words) - 7) if count[tuple(words[k:k + 8])] > 1 for j in range(8)}
        assert quality.repeated_words(words) == len(plain)


# URLs


def test_urls(spark):
    rows = [(k, f"http://{'www.' if k % 3 else ''}{'Example' if k % 2 else 'other'}.{('com', 'net')[k % 2]}/{('en', 'es', 'fr')[k % 3]}/{k}?a={k}&b=1#x") for k in range(120)]
    rows += [(200, None), (201, "no scheme"), (202, "http://a.org/en/1"), (203, "HTTP://WWW.EXAMPLE.COM/en/?q://z"), (204, "http://example.com/en/x"), (205, "http://com"), (206, "x" * 5000), (206, "x" * 5000), (207, "")]
    table = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in urls.judge_urls(table).collect()}
    assert (got[200].host, got[200].path, got[200].rule) == ("", "", None) and got[201].host == ""
    assert (got[203].host, got[203].path, got[203].rule, got[203].verdict) == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert (got[204].rule, got[204].verdict) == ("example.com/en/", "block") and got[205].rule is None and got[202].rule is None
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and urls.judge_urls(table).count() == len(rows)
    assert urls.judge_urls(table.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge_urls(table.where("page_id >= 200"), rules=(("allow", "com/"),)).collect()} == {"allow"}


# surrogates

LETTER = ("Gentile Sig.ra Anna Rossi, c.f. RSSNNA85T50A562S, scriva a anna.rossi@scuola.example.it o +39 (055) 555-1234; carta 4785 3805 9239 1139. "
          "ANNA.ROSSI@SCUOLA.EXAMPLE.IT da 152.143.123.131, versione 4.0. господин Иван Петров. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"")


def test_surrogates_keep_kind_and_identity(pages):
    rows = [(1, 1, LETTER), (2, 1, f"### {LETTER.replace('4785 3805 9239 1139', '4785380592391139')}"), *[(10 + k, p, t) for k, (_, p, t) in enumerate(EDGES)]]
    got = {r.doc_id: r for r in surrogates.replace_entities(pages(rows), b"key", carry=("lang",)).collect()}
    first, second = got[1], got[2]
    kinds = [e.kind for e in first.entities]
    assert kinds == ["person", "taxcode", "email", "phone", "card", "email", "ip", "person", "secret"]
    for e in first.entities:
        assert LETTER[e.start:e.end] not in first.text
    stand = {e.kind: e.stand_in for e in first.entities[:5]}
    assert int(stand["taxcode"][9:11]) > 40 and stand["phone"].startswith("+39 (") and surrogates.luhn(re.sub(r"\D", "", stand["card"])) == 0
    assert first.entities[5].stand_in == stand["email"].upper() and surrogates.script_of(first.entities[7].stand_in) == "cyrillic"
    assert [e.stand_in.replace(" ", "") for e in first.entities] == [e.stand_in.replace(" ", "") for e in second.entities]
    assert "versione 4.0." in first.text and got[10].text is None and got[14].text == "una casa" and got[17].text == EDGES[7][2]
    assert surrogates.replace_entities(pages([]), b"key").count() == 0


def test_surrogates_in_any_case_and_cards_within_digits():
    secret = "9233A8ECF7D04B61"
    for text in (f'TOKEN = "{secret}"', f"PASSWORD={secret}", f"Api_Key: {secret}", f"id {secret * 2} x"):
        assert [(e[2], e[4]) for e in surrogates.entities_of(text)] == [("secret", secret * (1 + text.startswith("id")))], text
    card = "4785 3805 9239 1139"
    for text in (f"{card} 12/25", f"{card.replace(' ', '')} 123", f"room 3 {card.replace(' ', '')}", f"pay {card} {card} now", f"{card.replace(' ', '')}."):
        found = [e for e in surrogates.entities_of(text) if e[2] == "card"]
        assert len(found) == 1 + text.startswith("pay") and all(e[3] == "4785380592391139" for e in found), text
        assert all(text[e[0]:e[1]] == e[4] for e in found)
    assert not surrogates.entities_of("4785 3805 9239 1138") and not surrogates.entities_of("0000 0000 0000 0000")


def test_surrogates_stay_distinct(spark, monkeypatch):
    # a generator with few results clashes all the time
    entities = spark.createDataFrame([("ssn", f"{k:09d}") for k in range(40)], "kind string, canonical string")
    moved = {r.canonical: r for r in surrogates.settled(entities, b"key").collect()}
    names = spark.createDataFrame([("person", f"f:{a} {b}") for a, b in itertools.product("abcdefgh", repeat=2)] * 1, "kind string, canonical string")
    state = {r.canonical: r.stand for r in surrogates.settled(names, b"key").collect()}
    final = [state.get(f"f:{a} {b}") or surrogates.stand_in(b"key", "person", f"f:{a} {b}") for a, b in itertools.product("abcdefgh", repeat=2)]
    assert len(set(final)) == 64 and all(r.attempt > 0 for r in moved.values())
    ips = [f"{a}.{b}.0.1" for a in range(1, 40) for b in range(40)]
    taken = {x: surrogates.stand_in(b"key", "ip", x) for x in ips}
    clash = spark.createDataFrame([("ip", x) for x in ips] + [("ip", taken[ips[0]])], "kind string, canonical string")
    over = {r.canonical: r.stand for r in surrogates.settled(clash, b"key").collect()}
    assert ips[0] in over and over[ips[0]] != taken[ips[0]]


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.limit(3).collect()]
    more = spark.createDataFrame([(10_000, None, "en", "src0", None), (10_001, "", "en", "src0", 0), (0, texts[0], "fr", "src0", len(texts[0])),
                                  (10_002, f"{texts[1]} mail anna@scuola.example.it", "en", None, 9)], docs.schema)
    docs = docs.union(more)
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = docs.collect()
        left = {r.doc_id for r in rows}
        assert left <= ids and left and 10_000 not in left
        if name == "near_duplicates":
            assert len(rows) == len(left)
            want = classes_of([(r.doc_id, r.text) for r in before])
            assert left == {c for c, _, _ in want.values()}
        ids, before = left, rows
        docs = spark.createDataFrame(rows, docs.schema)
    assert not any("anna@scuola" in r.text for r in before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").toPandas()
    assert set(packed.doc_id) == ids and packed.groupby("sequence_id").length.sum().max() <= 1024
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
