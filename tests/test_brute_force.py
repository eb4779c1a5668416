"""Order-dependent operators against plain loops over small random pages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import geometry, layout, readings, structure, templates
from folioframe.plans import greedy
from folioframe.plans.spatial import box, box_of, share_of_smaller

BY = ("page_id",)
WORD = "page_id bigint, token_id bigint, line_id bigint, x double, y double, w double, h double, text string, text_key string, conf double, source string"


def words(seed, pages=6, n=30):
    rng = random.Random(seed)
    rows = []
    for p in range(pages):
        for i in range(n):
            h = rng.choice([10, 12, 14])
            text = rng.choice(["Nome", "data", "via Roma", "x 1", "ab"])
            rows.append((p, i, i // 6, float(rng.randrange(0, 300)), float(rng.randrange(0, 90)), float(rng.randrange(10, 60)), float(h), text,
                         text.lower().replace(" ", ""), float(rng.randrange(30, 100)), rng.choice(["ocr", "ocr", "pdf"])))
    return rows


def by_page(rows):
    pages = {}
    for r in rows:
        pages.setdefault(r[0], []).append(dict(zip(["p", "id", "line", "x", "y", "w", "h", "text", "key", "conf", "source"], r)))
    return pages


def inter(a, b):
    return max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])) * max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))


def ratio(a, b):
    return inter(a, b) / max(1, a["w"] * a["h"])


def loop_lines(page):
    rows, out = [], {}
    for t in sorted(page, key=lambda t: (t["y"], t["x"], t["id"])):
        c = t["y"] + t["h"] / 2
        hit = next((i for i, (y, h) in enumerate(rows) if abs(c - y) < max(3, min(h, t["h"]) * 0.55)), None)
        if hit is None:
            rows.append((c, t["h"]))
            hit = len(rows) - 1
        out[t["id"]] = hit
    return out


@pytest.mark.parametrize("limit", [3000, 5])
def test_assign_lines(table, limit, monkeypatch):
    """The fold and, with a tiny limit, the rounds of joins give the loop's rows."""
    rows = words(1, pages=3 if limit == 5 else 6)
    monkeypatch.setattr(greedy, "FOLD_LIMIT", limit)
    token = table(rows, WORD).select("page_id", "token_id", "x", "y", "w", "h")
    slack = F.greatest(F.lit(3.0), F.col("h") * 0.55)
    if limit == 3000:
        got = layout.assign_lines(token, BY)
    else:
        from folioframe.plans.spatial import Box

        band = Box(F.lit(0.0), F.col("y") + F.col("h") / 2 - slack, F.lit(0.0), slack * 2)
        same = lambda k, c: F.abs(box_of(c).cy - box_of(k).cy) < F.greatest(F.lit(3.0), F.least(k["h"], c["h"]) * 0.55)
        got = greedy.greedy_owner(token, BY, "token_id", [F.col("y"), F.col("x"), F.col("token_id")], same, band, fold_limit=5).withColumnRenamed("owner_rank", "line_no")
    got = {(r.page_id, r.token_id): r.line_no for r in got.collect()}
    for p, page in by_page(rows).items():
        for i, line in loop_lines(page).items():
            assert got[(p, i)] == line


def test_group_words(table):
    rows = words(2)
    got = layout.group_words(table(rows, WORD).withColumn("region_id", F.floor(F.col("x") / 150)), BY).collect()
    got = sorted((r.page_id, tuple(sorted(r.fragment_ids))) for r in got)
    want = []
    for p, page in by_page(rows).items():
        groups = []
        for t in sorted(page, key=lambda t: (t["line"], t["x"], t["id"])):
            region = math.floor(t["x"] / 150)
            hit = None
            if t["source"] != "pdf":
                for g in groups:
                    f, last = g["words"][0], g["words"][-1]
                    if (f["source"] == t["source"] and f["line"] == t["line"] and g["region"] == region
                            and abs(f["y"] + f["h"] / 2 - t["y"] - t["h"] / 2) < max(3, min(f["h"], t["h"]) * 0.55)
                            and t["x"] >= last["x"] and t["x"] - last["x"] - last["w"] < max(10, t["h"] * 2)):
                        hit = g
                        break
            if hit:
                hit["words"].append(t)
            else:
                groups.append({"region": region, "words": [t]})
        want += [(p, tuple(sorted(w["id"] for w in g["words"]))) for g in groups]
    assert got == sorted(want)


def test_reconstruct_text(table):
    rows = words(3)
    got = sorted((r.page_id, r.text, r.x, r.y, r.w, r.h) for r in layout.reconstruct_text(table(rows, WORD), BY).collect())
    want = []
    for p, page in by_page(rows).items():
        usable = sorted(page, key=lambda t: (t["y"], t["x"], t["id"]))
        hs = sorted(t["h"] for t in usable)
        mh = hs[len(hs) // 2]
        tol, gap_max, over = max(5, mh * 0.42), max(18, mh * 1.15), max(2, mh * 0.12)
        lines = []
        for t in usable:
            best, away = None, math.inf
            for line in lines:
                d = abs(t["y"] + t["h"] / 2 - sum(w["y"] + w["h"] / 2 for w in line) / len(line))
                if d <= tol and d < away:
                    best, away = line, d
            (best if best is not None else lines.append([]) or lines[-1]).append(t)
        for line in lines:
            group, right = [], -math.inf
            groups = []
            for t in sorted(line, key=lambda t: t["x"]):
                gap = t["x"] - right
                if group and not (-over <= gap <= gap_max):
                    groups.append(group)
                    group = []
                group.append(t)
                right = max(right, t["x"] + t["w"])
            for g in groups + [group]:
                x, y = min(t["x"] for t in g), min(t["y"] for t in g)
                want.append((p, " ".join(t["text"] for t in g), x, y, max(t["x"] + t["w"] for t in g) - x, max(t["y"] + t["h"] for t in g) - y))
    assert got == sorted(want)


def test_merge_word_streams(table):
    rows = words(4, n=40)
    got = {(r.page_id, r.word_id) for r in readings.merge_word_streams(table(rows, WORD).withColumnRenamed("token_id", "word_id"), BY).collect()}
    want = set()
    for p, page in by_page(rows).items():
        kept = []
        for t in sorted(page, key=lambda t: (-t["conf"], t["id"])):
            def dup(k):
                scale = max(4, min(k["h"], t["h"]) * 0.55)
                cx, cy = abs(k["x"] + k["w"] / 2 - t["x"] - t["w"] / 2), abs(k["y"] + k["h"] / 2 - t["y"] - t["h"] / 2)
                i = inter(k, t)
                return (k["text"].lower() == t["text"].lower() and cx <= max(scale, min(k["w"], t["w"]) * 0.22) and cy <= scale) or i / (k["w"] * k["h"] + t["w"] * t["h"] - i) >= 0.68
            if not any(dup(k) for k in kept):
                kept.append(t)
                want.add((p, t["id"]))
    assert got == want


def test_suppress_fields(table):
    rows = words(5, n=40)
    field = table(rows, WORD).select("page_id", F.col("token_id").alias("field_id"), F.col("token_id").alias("ord"), (F.col("x") - 20).alias("x"), "y", "w", "h")
    page = table([(p, 290.0, 95.0) for p in range(6)], "page_id bigint, page_w double, page_h double")
    got = {(r.page_id, r.field_id): (r.outcome, r.reason, r.duplicate_of) for r in structure.suppress_fields(field, page, BY).collect()}
    for p, pg in by_page(rows).items():
        kept = []
        for t in pg:
            b = {"x": max(0, t["x"] - 20), "y": max(0, t["y"]), "id": t["id"]}
            b["w"], b["h"] = min(t["w"], 290 - b["x"]), min(t["h"], 95 - b["y"])
            dup = next((k for k in kept if ratio(b, k) > 0.6 or ratio(k, b) > 0.8), None)
            if b["w"] < 6 or b["h"] < 6:
                want = ("excluded", "FIELD_TOO_SMALL_AFTER_CLAMP", None)
            elif dup:
                want = ("excluded", "DUPLICATE_FIELD", dup["id"])
            else:
                kept.append(b)
                want = ("proposed", "FIELD_PROPOSED", None)
            assert got[(p, t["id"])] == want


def test_box_set_diff(table):
    rng = random.Random(6)
    src = [(p, i, float(rng.randrange(0, 120)), float(rng.randrange(0, 120)), 30.0, 20.0) for p in range(5) for i in range(15)]
    cand = [(p, i, x + rng.choice([0, 0, 1, 6, 40]), y + rng.choice([0, 1, 8]), w + rng.choice([0, 5, 30]), h) for p, i, x, y, w, h in src if rng.random() < 0.8]
    cols = "page_id bigint, box_id bigint, x double, y double, w double, h double"
    got = sorted((r.page_id, r.change, r.source_id, r.candidate_id) for r in layout.box_set_diff(table(src, cols), table(cand, cols), BY).collect() if r.change in ("equal", "shifted"))
    want = []
    for p in range(5):
        s, c = [r for r in src if r[0] == p], [r for r in cand if r[0] == p]
        us, uc = set(), set()
        for name in ("equal", "shifted"):
            for a in s:
                if a[1] in us:
                    continue
                for b in c:
                    if b[1] in uc:
                        continue
                    d = [abs(a[2] - b[2]), abs(a[3] - b[3]), abs(a[2] + a[4] - b[2] - b[4]), abs(a[3] + a[5] - b[3] - b[5])]
                    ok = max(d) <= 1 if name == "equal" else math.hypot(a[2] - b[2], a[3] - b[3]) <= 15 and abs(a[4] - b[4]) <= 20 and abs(a[5] - b[5]) <= 20
                    if ok:
                        us.add(a[1])
                        uc.add(b[1])
                        want.append((p, name, a[1], b[1]))
                        break
    assert got == sorted(want)


def test_second_pass_and_rounds_agree(table):
    rows = words(7, n=50, pages=2)
    field = table(rows, WORD).select("page_id", F.col("token_id").alias("field_id"), "x", "y", "w", "h")
    clash = lambda k, c: share_of_smaller(box_of(k), box_of(c)) >= 0.3
    keep = lambda limit: {(r.page_id, r.field_id) for r in greedy.greedy_keep(field, BY, "field_id", [F.col("field_id")], clash, box(), fold_limit=limit, tile=64.0).collect()}
    want = set()
    for p, page in by_page(rows).items():
        kept = []
        for t in page:
            if not any(inter(k, t) / min(k["w"] * k["h"], t["w"] * t["h"]) >= 0.3 for k in kept):
                kept.append(t)
                want.add((p, t["id"]))
    assert keep(3000) == want
    assert keep(10) == want


def test_reading_order_and_snap(table):
    rows = words(8)
    field = table(rows, WORD).select("page_id", F.col("token_id").alias("field_id"), "x", "y", "w", "h")
    got = {(r.page_id, r.field_id): r.position for r in layout.reading_order(field, BY).collect()}
    rects = [(p, i, float(i * 40), float(i * 20), 38.0, 18.0) for p in range(6) for i in range(6)]
    lines = [(p, i, float(i * 30), float(i * 13), float(i * 30 + 50)) for p in range(6) for i in range(7)]
    snapped = {(r.page_id, r.field_id): (r.x, r.y, r.w, r.h) for r in geometry.snap_to_structure(
        field, table(rects, "page_id bigint, rect_id bigint, x double, y double, w double, h double"), table(lines, "page_id bigint, line_id bigint, x1 double, y double, x2 double"), BY).collect()}
    for p, page in by_page(rows).items():
        bands = []
        for t in sorted(page, key=lambda t: (t["y"], t["x"], t["id"])):
            band = next((b for b in bands if abs(b[0]["y"] - t["y"]) <= 4), None)
            (band if band is not None else bands.append([]) or bands[-1]).append(t)
        order = [t["id"] for b in bands for t in sorted(b, key=lambda t: (t["x"], t["y"], t["id"]))]
        assert [got[(p, i)] for i in order] == list(range(1, len(order) + 1))
        for t in page:
            left, top, right, bottom = t["x"], t["y"], t["x"] + t["w"], t["y"] + t["h"]
            for _, _, x, y, w, h in (r for r in rects if r[0] == p):
                if abs(left - x) <= 6 and abs(top - y) <= 6:
                    left, top = x, y
                right = x + w if abs(right - x - w) <= 6 else right
                bottom = y + h if abs(bottom - y - h) <= 6 else bottom
            for _, _, x1, y, x2 in (r for r in lines if r[0] == p):
                if abs(bottom - y) <= 6 and x2 > left and x1 < right:
                    bottom = y
                if abs(top - y) <= 6 and x2 > left and x1 < right:
                    top = y
                if abs(left - x1) <= 6 and abs(bottom - y) <= 12:
                    left = x1
                if abs(right - x2) <= 6 and abs(bottom - y) <= 12:
                    right = x2
            assert snapped[(p, t["id"])] == (left, top, max(10, right - left), max(10, bottom - top))


def test_snap_follows_long_chains(table):
    field = table([(1, 1, 0.0, 100.0, 50.0, 20.0), (1, 2, 300.0, 400.0, 40.0, 20.0)], "page_id bigint, field_id bigint, x double, y double, w double, h double")
    lines = [(1, k, 0.0, 95.0 - 5 * (k - 1), 60.0) for k in range(1, 15)]
    rects = [(1, k, 300.0 - 6 * k, 400.0 - 6 * k, 40.0, 20.0) for k in range(1, 30)]
    got = {r.field_id: (r.x, r.y, r.w, r.h) for r in geometry.snap_to_structure(
        field, table(rects, "page_id bigint, rect_id bigint, x double, y double, w double, h double"), table(lines, "page_id bigint, line_id bigint, x1 double, y double, x2 double"), BY).collect()}
    assert got[1] == (0.0, 30.0, 50.0, 90.0)  # the top edge climbs all fourteen lines
    assert got[2] == (126.0, 226.0, 40.0, 20.0)  # the box follows all rectangles


def test_evidence_without_a_group(table):
    from folioframe.operators import semantics

    page = table([(1, 1, "abc 1234 (x)", 90.0)], "doc_id bigint, page_no int, text string, confidence double")
    got = semantics.extract_evidence(page, [("n", [r"[0-9]{3,}"], 70), ("p", [r"\(x\)"], 70), ("g", [r"(?<v>abc)"], 70), ("q", [r"(?:abc) ([0-9]+)"], 70)]).collect()
    assert {r.field_id: r.value for r in got} == {"n": "1234", "p": "(x)", "g": "abc", "q": "1234"}


def test_key_label_keeps_every_part(table):
    from folioframe.operators import semantics

    key = ".".join(["custom", "t", *(f"p{k}" for k in range(110))])
    got = semantics.key_label(table([(key,)], "key string"), table([], "key string, category string, label string")).first()
    assert got.display.endswith("p108.p109")


def test_row_numbers(table):
    """Tops under the header, counted in a loop; ties, cells above their header and a table of its own included."""
    rng = random.Random(5)
    cells = [(p, i, i % 2, float(rng.choice([0, 20, 21, 40, 43, 60, 80, 200])), rng.choice([5.0, 7.2])) for p in range(4) for i in range(25)]
    heads = [(p, i, float(rng.choice([20, 40, 60, 150]))) for p, i, *_ in cells if i % 5]
    placed = table(cells, "page_id bigint, cell_id bigint, component bigint, y double, tol double")
    got = {(r["page_id"], r["cell_id"]): r["row_no"] for r in structure._row_numbers(placed, table(heads, "page_id bigint, cell_id bigint, hb double"), BY).collect()}
    tops = {}
    for p, _, k, y, tol in cells:
        row = tops.setdefault((p, k), {})
        at = math.floor(y / tol + 0.5)
        row[at] = min(y, row.get(at, y))
    where = {(p, i): (k, y, tol) for p, i, k, y, tol in cells}
    assert len(got) == len(heads)
    for p, i, hb in heads:
        k, y, tol = where[p, i]
        want = sum(hb - tol <= top <= y + tol for top in tops[p, k].values())
        assert max(1, got[p, i]) == max(1, want)


def profile_rows(seed, n=24, kinds=7):
    """Page profiles of templates, most of which are copies of a few."""
    rng = random.Random(seed)
    made = [[(595.0 + rng.randrange(3), 842.0, 0, rng.randrange(0, 40), rng.randrange(0, 2), rng.randrange(0, 40)) for _ in range(rng.randrange(1, 4))] for _ in range(kinds)]
    made.append([(*p[:4], p[4] + 1, p[5]) for p in made[0]])  # differs in what a difference does not look at
    return [(f"t{t:02}", o, *page, ["A"], f"g{page[:4]}", f"s{page}", 1.0) for t in range(n) for o, page in enumerate(made[rng.randrange(len(made))])]


def templates_of(table, seed):
    pages = table(profile_rows(seed), "template_id string, o int, page_width double, page_height double, rotation int, vector_count bigint, raster_count bigint, text_count bigint,"
                                      " fonts array<string>, geometry_hash string, structure_hash string, confidence double")
    return templates.profiles(pages, "template_id", "o").withColumn("ord", F.substring("template_id", 2, 2).cast("int"))


@pytest.mark.parametrize("seed", [1, 2])
def test_families_among_copies(table, seed):
    """Comparing one copy of each fingerprint gives the parents that comparing all pairs gives."""
    made = templates_of(table, seed)
    side = lambda p: made.select(*[F.col(c).alias(p + c) for c in ("template_id", "ord", "page_count", "boxes", "fingerprint", "pages")])
    pairs = side("s_").join(side("c_"), F.col("s_ord") < F.col("c_ord"))
    best = {}
    for r in templates.structural_diff(pairs).orderBy("c_ord", F.desc("similarity"), "s_ord").collect():
        best.setdefault(r["c_template_id"], (r["s_template_id"] if r["class"] != "UNKNOWN" else None, r["similarity"]))
    got = {r["template_id"]: r["parent"] for r in templates.cluster_templates(made).collect()}
    assert len(got) == made.count() and got == {t: best.get(t, (None, 0))[0] for t in got}


def test_top_templates_among_copies(table):
    made = templates_of(table, 3)
    docs = made.withColumnRenamed("template_id", "doc_id").drop("ord")
    ranked = {}
    for r in templates.match_score(docs, made, "doc_id", 0.0).orderBy("doc_id", F.desc("score"), "ord").collect():
        ranked.setdefault(r["doc_id"], []).append((r["template_id"], r["score"]))
    got = {}
    for r in templates.top_templates(docs, made, 3).orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append((r["template_id"], r["score"]))
    assert got == {d: rows[:3] for d, rows in ranked.items()}
