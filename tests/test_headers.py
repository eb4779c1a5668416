"""Headers reached by the sweep are those a breadth-first walk from every cell reaches."""

import random

from pyspark.sql import functions as F

from folioframe.operators import structure as op
from folioframe.operators.geometry import cell_adjacency

BY = ("page_id",)


def test_headers_equal_walks(table):
    rng = random.Random(11)
    cells, heads = [], []
    for p in range(6):
        n, y = 0, 0.0
        for row in range(9):
            h = rng.choice([20.0, 30.0])
            x = 0.0
            while x < 200:
                w = rng.choice([20.0, 40.0, 60.0])
                if rng.random() < 0.85:  # gaps make walks go around
                    dy = rng.choice([0.0, 0.0, 2.0])
                    cells.append((p, n, x, y + dy, w, h))
                    if row < 5 and rng.random() < 0.35:
                        heads.append((p, n, x, y + dy, w, h, rng.choice(["A", "B"]), "text", rng.random() < 0.1, "primary", False))
                    n += 1
                x += w
            y += h
    cell = table(cells, "page_id long, cell_id long, x double, y double, w double, h double").repartition(3).cache()
    heights = table([(p, 10.0) for p in range(6)], "page_id long, typical_h double")
    member = op.table_components(cell, heights, BY).cache()
    header = table(heads, "page_id long, cell_id long, x double, y double, w double, h double, label string, type string, is_group boolean, source string, conflict boolean").join(
        member.select("page_id", "cell_id", "component"), ["page_id", "cell_id"])
    tol = max(5.0, 10.0 * 0.6)
    near = {}
    for r in cell_adjacency(cell, heights, BY).collect():
        near.setdefault((r.page_id, r.cell_a), set()).add(r.cell_b)
        near.setdefault((r.page_id, r.cell_b), set()).add(r.cell_a)
    box = {(p, n): (x, y, w, h) for p, n, x, y, w, h in cells}
    head = {(r[0], r[1]): r for r in heads if not r[8]}
    want = {}
    for (p, n), (x, y, w, h) in box.items():
        seen, queue, found = {n}, [(n, 0)], []
        while queue:
            at, steps = queue.pop(0)
            for b in near.get((p, at), ()):
                bx, by, bw, bh = box[p, b]
                if b in seen or by > y + tol:
                    continue
                seen.add(b)
                if (p, b) in head and by + bh <= y + tol and min(bx + bw, x + w) - max(bx, x) >= min(bw, w) * 0.7:
                    found.append((b, by + bh, steps + 1))
                queue.append((b, steps + 1))
        low = max((bottom for _, bottom, _ in found), default=0)
        kept = [(b, s) for b, bottom, s in found if low - bottom <= tol]
        for b, s in kept:
            want[p, n, b] = s if len(kept) > 1 else None
    got = {(r.page_id, r.cell_id, r.head_id): r.steps for r in op.header_ancestors(cell, header, heights, BY, member).collect()}
    assert got == want and sum(s is not None for s in got.values()) > 5 and len(got) > 60
    assert op.header_ancestors(cell, header.limit(0), heights, BY, member).count() == 0


def test_a_table_of_a_thousand_rows_takes_one_sweep(spark):
    cells = [(1, r * 4 + k, k * 40.0, r * 20.0, 40.0, 20.0) for r in range(1000) for k in range(4)]
    cell = spark.createDataFrame(cells, "page_id long, cell_id long, x double, y double, w double, h double")
    heights = spark.createDataFrame([(1, 10.0)], "page_id long, typical_h double")
    member = cell.select("page_id", "cell_id", F.lit(0).cast("long").alias("component"))
    header = cell.where("cell_id < 4").select("*", F.lit("H").alias("label"), F.lit("t").alias("type"), F.lit(False).alias("is_group"), F.lit("primary").alias("source"),
                                              F.lit(False).alias("conflict"), F.lit(0).cast("long").alias("component"))
    got = op.header_ancestors(cell, header, heights, BY, member)
    assert got.count() == 3996 and got.where("cell_id % 4 = head_id AND steps IS NULL").count() == 3996
