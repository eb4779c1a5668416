"""Captions of checkboxes, narrative captions and roles: decisions and reason counts equal those of plain loops."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioframe.operators import structure as op

BY = ("page_id",)
TH = 10.0


def scene(seed, pages=4):
    rng = random.Random(seed)
    cells, boxes, words = [], [], []
    for p in range(pages):
        n = t = 0
        for row in range(6):
            x, y, h = 20.0, 20.0 + row * 70, rng.choice([20.0, 60.0, 32.0])
            while x < 400:
                w = rng.choice([80.0, 120.0, 200.0])
                cells.append((p, n, x, y, w, h))
                kind = rng.randrange(5)
                said = {0: "attività :", 1: "situazione familiare", 2: f"{n}. docente sostegno", 3: "nome", 4: ""}[kind].split()
                wx = x + 4
                for k, word in enumerate(said):
                    words.append((p, t, p * 100 + row * 10 + 1, wx, y + rng.choice([2.0, 4.0]), 25.0, 10.0, word, False))
                    wx, t = wx + 28, t + 1
                if h > 30 and rng.random() < 0.6:
                    words.append((p, t, p * 100 + row * 10 + 2, x + 5, y + rng.choice([5.0, 16.0, 30.0]), 40.0, 10.0, rng.choice(["risposta", "specificare"]), False))
                    words[-1] = (*words[-1][:-1], words[-1][7] == "specificare")
                    t += 1
                x, n = x + w, n + 1
        for k in range(12):
            boxes.append((p, 1000 + k, round(rng.uniform(10, 450), 1), 18.0 + 70 * rng.randrange(6) + rng.choice([0.0, 3.0]), rng.choice([5.0, 10.0]), 10.0))
    return cells, boxes, words


def tables(table, cells, boxes, words):
    return (table(cells, "page_id long, cell_id long, x double, y double, w double, h double"), table(boxes, "page_id long, box_id long, x double, y double, w double, h double"),
            table(words, "page_id long, token_id long, line_id long, x double, y double, w double, h double, text string, is_instruction boolean").withColumn("is_label", F.col("text") == "nome"))


def test_checkbox_captions(table):
    cells, boxes, words = scene(1)
    _, box, token = tables(table, cells, boxes, words)
    page, heights = table([(p, 500.0, 500.0) for p in range(4)], "page_id long, page_w double, page_h double"), table([(p, TH) for p in range(4)], "page_id long, typical_h double")
    want = {}
    for p, n, x, y, w, h in boxes:
        right = sorted((wx, t, line, text) for q, t, line, wx, wy, ww, wh, text, _ in words if q == p and wx >= x + w - 2 and wx - x - w < 250 and abs(wy - y) < TH and wx <= 500)
        stop = min((bx for q, m, bx, by, *_ in boxes if q == p and bx > x + w and abs(by - y) < TH), default=500.0)
        label = None
        if right:
            label = " ".join(text for _, _, text in sorted((wx, t, text) for q, t, line, wx, *_, text, _ in words if q == p and line == right[0][2] and right[0][0] <= wx < stop)) or None
        if right and re.match(r"(?i)(?:attività)", right[0][3]):
            want[p, n] = ("CHECKBOX_NEXT_TO_STATIC_HEADING", None)
        elif min(w, h) < TH * 0.75:
            want[p, n] = ("CHECKBOX_BELOW_TEXT_SCALE", None)
        else:
            want[p, n] = ("CHECKBOX_CAPTION" if label else "CHECKBOX_WITHOUT_CAPTION", label or "?")
    got = {(r.page_id, r.box_id): (r.reason, r.label) for r in op.checkbox_captions(box, token, page, heights, BY, heading="(?i)^attività", unknown="?").collect()}
    assert got == want and len(Counter(r for r, _ in got.values())) >= 3


def test_narrative_captions_and_roles(table):
    cells, boxes, words = scene(2, pages=6)
    cell, box, token = tables(table, cells, boxes, words)
    heights = table([(p, TH) for p in range(6)], "page_id long, typical_h double")
    caption, margin = "attività|situazione familiare|situazione", max(4.0, TH * 0.18)
    want = {}
    for p, n, x, y, w, h in cells:
        if h <= TH * 3:
            continue
        held = []
        for q, t, line, wx, wy, ww, wh, text, told in words:
            if q != p or not re.search("(?i)[a-zà-ù0-9]", text):
                continue
            inter = max(0.0, min(wx + ww, x + w) - max(wx, x)) * max(0.0, min(wy + wh, y + h) - max(wy, y))
            if inter / max(1.0, ww * wh) > 0.55 or (wx >= x and wx + ww <= x + w and wy < y + TH and wy + wh > y - margin * 2):
                held.append((wy, wx, t, line, wh, text, told))
        starts = [(abs(k[0] - y), k[1], k[2], k) for k in held if k[1] < x + TH * 4 and abs(k[0] - y) < TH * 1.8 and re.match(rf"(?i)(?:{caption})(?=\s|$|[:.,])", k[5])]
        if not starts:
            continue
        start = min(starts)[3]
        top = [k for k in held if k[3] == start[3] and abs(k[0] - start[0]) < TH * 0.65]
        lines = {k[3] for k in held if k[6] and k[0] < y + h * 0.45}
        told = [k for k in held if k not in top and k[3] in lines]
        response = [k for k in held if k not in top and k not in told and k[0] >= start[0] + TH * 0.3]
        bottom = max(k[0] + k[4] for k in top + told)
        shares = any(k[0] < bottom + margin for k in response)
        fy = (y if shares else bottom) + margin
        fh = y + h - margin - fy
        reason = "NARRATIVE_RESPONSE_TOO_SHORT" if fh < TH else "NARRATIVE_CAPTION"
        want[p, n] = (reason, " ".join(k[5] for k in sorted(top, key=lambda k: (k[1], k[2]))), " ".join(k[5] for k in sorted(response)) or None, shares, round(fy, 6), round(fh, 6))
    got = {(r.page_id, r.cell_id): (r.reason, r.label, r.value, r.shares_row, round(r.y, 6), round(r.h, 6)) for r in op.narrative_fields(cell, token, heights, caption, BY).collect()}
    assert {k: (v[0], *v[2:]) for k, v in got.items()} == {k: (v[0], *v[2:]) for k, v in want.items()} and len(got) > 10
    assert {v[3] for v in got.values()} == {True, False}
    page = table([(p, 500.0, 500.0) for p in range(6)], "page_id long, page_w double, page_h double")
    header, label = table([("none",)], "key string"), table([("nome",)], "key string")
    every = op.infer_page_fields(cell, box, token, page, heights, header, label, caption, "docente", BY).collect()
    assert Counter((r.page_id, r.kind, r.cell_id) for r in every) == Counter([(p, "cell", n) for p, n, *_ in cells] + [(p, "checkbox", n) for p, n, *_ in boxes])
    roles = {(r.page_id, r.cell_id): r.role for r in op.right_hand_roles(cell, token, heights, "docente", BY).collect()}
    assert roles and all(v.startswith("docente sostegno") for v in roles.values())
    named = {(r.page_id, r.cell_id) for r in every if r.reason == "RIGHT_HAND_ROLE"}
    told = {(r.page_id, r.cell_id) for r in every if r.reason in op._BEFORE_ROLES}
    assert named == set(roles) - set(want) - told and all(r.label.startswith("Nome e Cognome — docente sostegno") for r in every if r.reason == "RIGHT_HAND_ROLE")
