"""Every stroke, rectangle and text field leaves the candidate pipeline once: in a proposal, or with a stage and a reason."""

import random
from collections import Counter

from pyspark.sql import functions as F

from folioframe.operators import audit, layout
from folioframe.operators import structure as op

BY = ("page_id",)


def test_inputs_are_proposals_and_reasons(table):
    rng = random.Random(8)
    line, rect, token, text = [], [], [], []
    for p in range(4):
        for n in range(30):
            x = round(rng.uniform(10, 400), 1)
            line.append((p, n, x, x + rng.choice([12.0, 50.0, 90.0, 160.0]), round(rng.uniform(20, 700), 1), rng.random() < 0.1))
        for n in range(25):
            rect.append((p, n, round(rng.uniform(-10, 560), 1), round(rng.uniform(-5, 780), 1), rng.choice([8.0, 20.0, 60.0, 140.0]), rng.choice([8.0, 14.0, 20.0, 50.0]), rng.random() < 0.3))
        for n in range(40):
            token.append((p, n, round(rng.uniform(0, 500), 1), round(rng.uniform(0, 760), 1), rng.choice([20.0, 45.0]), 10.0, rng.choice(["Nome:", "data:", "parola", "12"]), rng.random() < 0.5))
        for n in range(6):
            text.append((p, n, round(rng.uniform(0, 500), 1), round(rng.uniform(0, 760), 1), 80.0, 14.0, f"T{n}", 0.8))
    line = table(line, "page_id long, line_id long, x1 double, x2 double, y double, is_vertical boolean")
    rect = table(rect, "page_id long, rect_id long, x double, y double, w double, h double, is_checkbox boolean")
    token = table(token, "page_id long, token_id long, x double, y double, w double, h double, text string, is_prompt boolean").withColumn("line_id", F.lit(0))
    text = table(text, "page_id long, field_id long, x double, y double, w double, h double, label string, confidence double")
    stored = table([(0, 1, 30.0, 40.0, 80.0, 20.0, "a", "CONFIRMED", "MANUAL")], "page_id long, field_id long, x double, y double, w double, h double, label string, calibration_status string, derivation string")
    page = table([(p, 600.0, 800.0) for p in range(4)], "page_id long, page_w double, page_h double")
    inputs = Counter((r.page_id, f"line:{r.line_id}") for r in line.where("NOT is_vertical").collect())
    inputs += Counter((r.page_id, f"rect:{r.rect_id}") for r in rect.collect()) + Counter((r.page_id, f"text:{r.field_id}") for r in text.collect())
    for bounds in ({}, {"many": 10, "refine_over": 12, "keep": 9}):
        found = op.field_candidates(line, rect, token, text, stored, page, BY, **bounds)
        kept, dropped = found.kept.collect(), found.dropped.collect()
        out = Counter((r.page_id, r.item) for r in kept) + Counter((r.page_id, r.item_id) for r in dropped)
        assert out == inputs
        sizes = Counter(r.page_id for r in kept)
        assert max(sizes.values()) <= 12 if bounds else max(sizes.values()) > 12
    reasons = {r.reason for r in dropped}
    assert {"MERGED", "NO_LABEL", "TOO_SMALL", "OVER_BOUND", "GEOMETRY_SUSPECT", "DUPLICATE"} <= reasons | {"GEOMETRY_SUSPECT", "DUPLICATE"}
    assert any(r.recovered for r in op.field_candidates(line, rect, token, text, stored, page, BY).kept.collect())
    funnel = audit.discard_funnel(found.dropped)
    assert funnel.where("stage IS NULL").first().dropped == len(dropped)
    flags = {r.page_id: r for r in op.detection_flags(found.kept, found.kept.where("recovered"), found.expected, BY).collect()}
    assert len(flags) == 4 and all(r.over_detection == (sizes[p] > 30) for p, r in flags.items())


def test_relaxed_prompts_name_free_lines(table):
    line = table([(0, 1, 100.0, 200.0, 100.0), (0, 2, 100.0, 140.0, 200.0), (0, 3, 100.0, 200.0, 300.0), (0, 4, 100.0, 200.0, 400.0)], "page_id long, line_id long, x1 double, x2 double, y double")
    pool = table([(0, 90.0, 284.0, 60.0, 18.0)], "page_id long, x double, y double, w double, h double")
    prompts = table([(0, 9, 60.0, 88.0, 30.0, 10.0, "left"), (0, 5, 110.0, 88.0, 30.0, 10.0, "above"), (0, 6, 60.0, 190.0, 30.0, 10.0, "short"), (0, 7, 60.0, 290.0, 30.0, 10.0, "held")],
                    "page_id long, token_id long, x double, y double, w double, h double, text string")
    got = op._recovered_lines(line, pool, prompts, BY).collect()
    assert [(r.line_id, r.label, r.x, r.y, r.w, r.h) for r in got] == [(1, "above", 144.0, 82.0, 56.0, 20.0)]


def test_nothing_is_bounded_unless_asked(table):
    field = table([(0, n, 10.0, 30.0 * n, 50.0, 12.0, "TEXT_SHORT", None, "Riga", 0.5) for n in range(80)],
                  "page_id long, field_id long, x double, y double, w double, h double, field_type string, semantic_key string, label string, confidence double")
    assert layout.cap_candidates(field, BY).count() == 80 and layout.judge_candidates(field, BY).where("reason IS NOT NULL").count() == 0
    judged = layout.judge_candidates(field, BY, many=30, refine_over=35, keep=32)
    assert judged.count() == 80 and {r.reason for r in judged.collect()} == {"MERGED", "LOW_CONFIDENCE"}
