"""Centroid clustering, benchmark passages and spelling variants against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import centroids, contamination, spelling

PAGE = "doc_id long, page_no int, text string, n_words int, items string, spans string, word string, n int, cluster int"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(d, p, t, 1, "x", "y", "z", 2, 3) for d, p, t in rows], PAGE)


# centroids


def plain_clusters(rows, dims, k, rounds, seed=3, scale=1024):
    kept = [(key, [math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale for x in v]) for key, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda key: hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centers)]
    return sorted(((key, near(v)[1], near(v)[0]) for key, v in kept), key=str), centers


@pytest.mark.parametrize("dims,k", [(2, 5), (6, 8), (1, 3)])
def test_clusters_equal_plain_rounds(spark, dims, k):
    rng = random.Random(dims)
    # a coarse grid makes ties of distances and of means; copies of vectors and of keys
    rows = [(n, [rng.randrange(-3, 4) / 4 for _ in range(dims)]) for n in range(300)]
    rows += [(7, rows[7][1]), (7, [0.5] * dims), (None, [0.25] * dims), (400, None), (401, [0.1] * (dims + 1)), (402, [float("nan")] * dims), (403, [None] * dims),
             (404, [float("inf")] + [0.0] * (dims - 1)), (405, [])]
    table = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(5)
    want, centers = plain_clusters(rows, dims, k, 4)
    found = centroids.cluster_vectors(table, dims=dims, clusters=k, rounds=4)
    got = found.assigned.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert {r.cluster: [int(x) for x in r.centroid] for r in found.centroids.collect()} == dict(enumerate(centers))
    sums = collections.Counter()
    for _, c, d in want:
        sums[c] += d
    assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) for r in got)


def test_clusters_of_vectors_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = [(n, [rng.choice([1e18, -3e25, 0.5, 1e300]) * rng.random(), rng.uniform(-1, 1)]) for n in range(40)] + [(n, [n / 100, 0.0]) for n in range(40, 60)]
    want, centers = plain_clusters(rows, 2, 4, 3)
    found = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=2, clusters=4, rounds=3)
    got = sorted(((r.vec_id, r.cluster, r.distance) for r in found.assigned.collect()), key=str)
    assert got == [(key, c, d if d < 2**63 else None) for key, c, d in want]
    assert {r.cluster: [int(x) for x in r.centroid] for r in found.centroids.collect()} == dict(enumerate(centers))


def test_clusters_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.cluster, r.distance) for r in centroids.cluster_vectors(few, dims=2).assigned.collect()) == [(0, 0), (1, 0)]
    none = centroids.cluster_vectors(few.limit(0), dims=2)
    assert none.assigned.count() == 0 and none.assigned.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"] and none.centroids.count() == 0


def test_rejected_centroids_are_never_nearer():
    rng = np.random.default_rng(5)
    for dims in (3, 64):
        table = centroids.Centroids(rng.integers(-400, 400, (40, dims)))
        rows = rng.integers(-400, 400, (500, dims))
        apart = ((rows[:, None, :] - np.array(table.rows)[None]) ** 2).sum(axis=2)
        found, distance = table.nearest_rows(rows)
        assert (distance == apart.min(axis=1)).all() and (found == apart.argmin(axis=1)).all()
        assert [table.nearest(r) for r in rows[:100].tolist()] == list(zip(found[:100].tolist(), distance[:100].tolist()))


# benchmark passages


def plain_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, met = words(text), set(), set()
    for item, t in items:
        u = words(t)
        size = min(window, len(u))
        for at in range(len(u) - size + 1 if u else 0):
            for s in range(len(w) - size + 1):
                if w[s:s + size] == u[at:at + size]:
                    hit.update(range(s, s + size))
                    met.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(met)


ITEMS = [(1, "Alpha beta, gamma DELTA epsilon zeta eta theta iota kappa lambda mu?"), (2, "short one"), (3, None), (4, ""), (5, "?!"), (10, "Perché l'età è così, né più né meno; là dove."),
         (1, "another text of item one that is longer than ten words in all, yes"), (None, "nobody knows this"), (6, "short one"), (7, "a a a a a a a a a a a")]


@pytest.mark.parametrize("most_words", [200_000, 15])
def test_contamination_equals_plain_search(spark, pages, most_words):
    rng = random.Random(3)
    texts = [None, "", " \n", "short  ONE", "shortone", "xshort one", "Ünder short-one short one", "a " * 30, "nobody knows\tthis", ITEMS[0][1] * 3, ITEMS[5][1] + " x " + ITEMS[5][1].upper(),
             "Alpha beta gamma delta epsilon zeta eta theta iota" + " filler" * 5]
    parts = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu short one a nobody knows this another text of item".split()
    texts += [" ".join(rng.choice(parts) for _ in range(60)) + " " + (ITEMS[rng.randrange(10)][1] or "") + ".\n" + " ".join(rng.choice(parts) for _ in range(5)) for _ in range(40)]
    texts += [" ".join(rng.choice(parts) for _ in range(20_000)), texts[9], "\U0001F600 short one ×"]
    rows = [(n, 1, t) for n, t in enumerate(texts)] + [(3, 1, texts[3]), (None, 2, texts[6])]
    items = spark.createDataFrame([(a, b, "clash") for a, b in ITEMS], "item_id long, text string, n_words string")
    found = contamination.page_contamination(pages(rows), items, carry=("word", "text"), most_words=most_words).collect()
    assert len(found) == len(rows)
    for r in found:
        n, hit, met = plain_hits(r.text, ITEMS)
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated, r.word) == (n, len(hit), met, len(met), bool(hit), "z"), r.text
        assert [w for s in r.spans for w in range(s.first_word, s.last_word + 1)] == hit
        for s in r.spans:
            # offsets are those of the text as it was
            inside = r.text[s.start:s.end]
            assert plain_hits(inside, [])[0] == s.last_word - s.first_word + 1 and plain_hits(r.text[:s.start], [])[0] == s.first_word
            assert inside == inside.strip() and (s.end == len(r.text) or plain_hits(r.text[s.end - 1:s.end + 1], [])[0] <= 2)


def test_contamination_by_questions_and_answers_and_empty_tables(spark, pages):
    rows = [(1, 1, "what is it? it is a lamp"), (2, 1, None)]
    items = spark.createDataFrame([("q1", "What is it", "a lamp"), ("q2", "who", None)], "item_id string, question string, answer string")
    got = {r.doc_id: r for r in contamination.page_contamination(pages(rows), items, fields=("question", "answer")).collect()}
    assert got[1].n_hit == 5 and got[1]["items"] == ["q1"] and [(s.start, s.end) for s in got[1].spans] == [(0, 10), (18, 24)]
    assert got[2].n_words == 0 and not got[2].contaminated
    assert contamination.page_contamination(pages([]), items, fields=("question",)).count() == 0
    assert [r.n_hit for r in contamination.page_contamination(pages(rows), items.limit(0), fields=("question",)).collect()] == [0, 0]


# spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(counts, min_length, least, ratio):
    known = {w: n for w, n in counts.items() if n >= least and len(w) >= min_length}
    out = {}
    for w, n in known.items():
        around = [v for v in known if near(w, v)]
        best = min(around, key=lambda v: (-known[v], v), default=None)
        form = best if best is not None and known[best] >= ratio * n else None
        out[w] = [form, n, len(around), known[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("symbols", [None, 2, 30])
def test_variants_equal_all_pairs(spark, symbols):
    rng = random.Random(4)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("abcdeéà÷\U0001F600") for _ in range(rng.randrange(3, 9)))
        words[w] = rng.choice([1, 2, 3, 400, 20_000])
        for _ in range(8):
            at, c = rng.randrange(len(w)), rng.choice("abcé")
            words[rng.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])] = rng.choice([1, 2, 30, 40])
    long = "".join(rng.choice("ab") for _ in range(700))
    words |= {"aaaaaaa": 5000, "aaaaaa": 500, "aaaaaaaa": 50, long: 30, long[:300] + long[301:]: 3, long[:400] + "c" + long[401:]: 2, "": 9, "abababab": 5000, "ababababc": 400, "ababababcd": 30}
    rows = [(w, n) for w, n in words.items()] + [("aaaaaaa", 1), (None, 8), ("bbbbbb", None)]
    words["aaaaaaa"] += 1
    table = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n long, near string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(table, min_length=3, symbols=symbols).collect()}
    want = plain_variants(words, 3, 2, 10)
    assert got == want and any(v[0] and v[1] != v[0] for v in want.values())


def test_counts_of_words(spark, pages, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    texts = [None, "", "Perché PERCHÉ perchÉ", "lettera lettere LETTERA1lettera", "x" * 30_000, "corto", "Ünïcôdé×÷ÿ straße žluťoučký"] * 2
    rows = [(n % 5, 1, t) for n, t in enumerate(texts)] + [(None, 1, "lettera lettera")]
    for every in (None, 2):
        want = collections.Counter()
        for key, _, t in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if every and h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                if len(run) >= 5:
                    want[run] += 1
        got = spelling.count_words(pages(rows), min_length=5, misread_every=every).collect()
        assert {r.word: r.n for r in got} == want and len(got) == len(want)
    assert spelling.spelling_variants(spelling.count_words(pages([]))).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(pages(rows), ratio=1)
