"""Templates found by classes and bounds equal those found by scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import templates as op
from folioframe.plans import candidates

PAGE = "doc string, o int, page_width double, page_height double, rotation int, vector_count int, raster_count int, text_count int, fonts array<string>, geometry_hash string, structure_hash string, confidence double"


def page_rows(seed, names, loose=0.0):
    rng = random.Random(seed)
    rows = []
    for name in names:
        kind = rng.randrange(5)
        for o in range(rng.choice([1, 1, 2, 3, 6])):
            w, h, rot = rng.choice([(595, 842), (842, 595), (600, 840), (300, 400)]) + (rng.choice([0, 0, 90]),)
            vec, ras, txt = int(2 ** rng.uniform(kind, kind + 4)) - 1, rng.randrange(3), int(3 ** rng.uniform(0, 5)) - 1
            fonts = rng.sample(["A", "B", "C"], rng.randrange(3))
            g, s = f"{w}|{h}|{rot}|{vec}", f"{vec}|{ras}|{w}|{h}|{rot}|{fonts}"
            if rng.random() < loose:  # one hash for pages that differ
                g = s = "same"
            rows.append((name, o, float(w), float(h), rot, vec, ras, txt, fonts, g, s, rng.choice([0.5, 0.95, 1.0])))
    return rows


def profiles(spark, rows):
    return op.profiles(spark.createDataFrame(rows, PAGE), "doc", "o")


@pytest.mark.parametrize("loose,most", [(0.1, 2048)])
def test_best_and_top_templates_equal_all_pairs(spark, monkeypatch, loose, most):
    monkeypatch.setattr(candidates, "MOST_CLASSES", most)
    docs = profiles(spark, page_rows(1, [f"d{k}" for k in range(60)], loose)).withColumnRenamed("doc", "doc_id").cache()
    known = profiles(spark, page_rows(2, [f"t{k}" for k in range(50)], loose) + page_rows(1, [f"d{k}" for k in range(3)], loose))
    registry = known.withColumnRenamed("doc", "template_id").withColumns({
        "ord": F.crc32("template_id") % 1000, "status": F.when(F.crc32("template_id") % 5 == 0, "deprecated").otherwise("active"),
        "validity_year": 2018 + F.crc32("template_id") % 4, "school_order": F.lit("A")}).cache()
    every = [r.asDict() for r in op.match_score(docs, registry, ratio=0.0).collect()]
    assert len(every) == 60 * 53
    by_doc = {}
    for r in every:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for year in (2020,):
        best = {r.doc_id: (r.template_id, r.ranking) for r in op.best_template(docs, registry, preferred_year=year).collect()}
        for doc, rows in by_doc.items():
            ranked = [(-(r["score"] + (5.0 if year and str(year) in str(r["validity_year"]) else 0.0)), r["ord"], r["template_id"]) for r in rows if r["status"] == "active"]
            want = min(ranked)
            assert best[doc][1] == -want[0], doc
            assert best[doc][0] == want[2] or best[doc][1] >= 100, doc
    top = {}
    for r in op.top_templates(docs, registry, 3).collect():
        top.setdefault(r.doc_id, {})[r.position] = (r.score, r.template_id)
    for doc, rows in by_doc.items():
        assert [top[doc][p] for p in (1, 2, 3)] == [(r["score"], r["template_id"]) for r in sorted(rows, key=lambda r: (-r["score"], r["ord"]))[:3]]
    high = {(r.doc_id, r.template_id) for r in op.match_score(docs, registry, ratio=0.0, least=70.0).collect()}
    assert high == {(r["doc_id"], r["template_id"]) for r in every if r["score"] >= 70}


@pytest.mark.parametrize("loose", [0.1])
def test_families_equal_all_pairs(spark, monkeypatch, loose):
    monkeypatch.setattr(candidates, "MOST_CLASSES", 4)  # the coarsest classes do as well
    registry = profiles(spark, page_rows(3, [f"t{k}" for k in range(50)], loose)).withColumnRenamed("doc", "template_id").withColumn("ord", F.crc32("template_id") % 100_000).cache()
    every = op.candidate_diffs(registry, 0.0)
    some = {(r.c_template_id, r.s_template_id) for r in op.candidate_diffs(registry, 60.0).collect()}
    rows = every.select("c_template_id", "s_template_id", "s_ord", "similarity", "class").collect()
    assert len(rows) == 50 * 49 // 2 and some == {(r.c_template_id, r.s_template_id) for r in rows if r.similarity >= 60}
    best = {}
    for r in rows:
        key = (-r.similarity, r.s_ord, r.s_template_id, r["class"])
        best[r.c_template_id] = min(best.get(r.c_template_id, key), key)
    got = {r.template_id: r.parent for r in op.cluster_templates(registry).collect()}
    prints = {r.template_id: (r.ord, r.fingerprint) for r in registry.collect()}
    first = {}
    for t, (o, f) in sorted(prints.items(), key=lambda x: x[1]):
        first.setdefault(f, t)
    for t, (o, f) in prints.items():
        if first[f] == t:
            b = best.get(t)
            assert got[t] == (b[2] if b and b[3] != "UNKNOWN" else None)


def test_few_pairs_are_scored_and_none_meet_by_page_count(spark, monkeypatch):
    docs = profiles(spark, page_rows(4, [f"d{k}" for k in range(200)])).withColumnRenamed("doc", "doc_id")
    registry = profiles(spark, page_rows(5, [f"t{k}" for k in range(200)])).withColumnRenamed("doc", "template_id").withColumns({
        "ord": F.crc32("template_id"), "status": F.lit("active"), "validity_year": F.lit(2020), "school_order": F.lit("A")})
    scored, plain = [], op._scored

    def counted(pairs, more):
        scored.append(pairs.count())
        assert "page_count" not in "".join(x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "page_count" in x and "_class" not in x and "bound" not in x)
        return plain(pairs, more)

    monkeypatch.setattr(op, "_scored", counted)
    op.best_template(docs, registry).count()
    assert sum(scored) < 200 * 200 / 2, scored
    scored.clear()
    op.match_score(docs, registry, ratio=0.0, least=90.0).count()
    assert sum(scored) < 200 * 200 / 4, scored


def test_empty_sides(spark):
    docs = profiles(spark, page_rows(4, ["a"])).withColumnRenamed("doc", "doc_id")
    registry = docs.withColumnRenamed("doc_id", "template_id").withColumns({"ord": F.lit(1), "status": F.lit("active"), "validity_year": F.lit(1), "school_order": F.lit("A")})
    assert op.best_template(docs, registry.limit(0)).count() == 0 and op.best_template(docs.limit(0), registry).count() == 0
    assert op.top_templates(docs, registry).count() == 1 and op.cluster_templates(registry).count() == 1
