"""Sequential rules over sorted rows of crowded pages, with a small state carried from row to row.

Where a page has too many rows to be folded inside one row, its rows are dealt by page (and band), sorted inside the partition
and read in order. Only what the rule still has open is held, never the page: a lost executor repeats its partition.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT_ROWS = 4096


class Rule:
    """State of one group: ``row`` takes the next row and gives finished results, ``end`` the rest."""

    def row(self, r: dict) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def sweep(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], make: Callable[[], Rule], fields: T.StructType) -> DataFrame:
    """``keys`` and the ``fields`` that the rule of each group gives, its rows read in ``order``."""
    keys = list(keys)
    ranked = rows.withColumns({f"_o{i}": o for i, o in enumerate(order)})
    dealt = ranked.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))])
    schema = T.StructType([rows.schema[k] for k in keys] + fields.fields)
    names, width = schema.names, len(keys)

    def run(batches):
        kinds, here, rule, out = None, None, None, []

        def packed():
            columns = list(zip(*out)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            if kinds is None:
                kinds = [batch.schema.field(k).type for k in keys] + [_arrow(f.dataType) for f in fields]
            for r in batch.to_pylist():
                at = tuple(r[k] for k in keys)
                if at != here:
                    if rule is not None:
                        out.extend(here + tuple(x) for x in rule.end())
                    here, rule = at, make()
                out.extend(here + tuple(x) for x in rule.row(r))
                if len(out) >= OUT_ROWS:
                    yield packed()
                    out.clear()
        if rule is not None:
            out.extend(here + tuple(x) for x in rule.end())
            yield packed()

    assert width + len(fields) == len(names)
    return dealt.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Phrases(Rule):
    """Words in order of x join the first phrase on their height whose end is near; far phrases are closed."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.open, self.n = columns, [], 0

    def row(self, t):
        cy, x, h = t["y"] + t["h"] / 2, t["x"], t["h"]
        # nothing to come reaches a phrase that ends this far to the left
        self.open = [g for g in self.open if x - g[3] < max(10.0, t["_tallest"] * 2)]
        for g in self.open:
            if abs(g[1] - cy) < max(3.0, min(g[2], h) * 0.55) and x >= g[4] and x - g[3] < max(10.0, h * 2):
                g[3], g[4] = x + t["w"], x
                return [(*(t[c] for c in self.columns), g[0])]
        self.open.append([self.n, cy, h, x + t["w"], x])
        self.n += 1
        return [(*(t[c] for c in self.columns), self.n - 1)]


class MissingWords(Rule):
    """Words in order of x join the first group on their height that ends less than three word heights before."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.open, self.n = columns, [], 0

    def row(self, t):
        x, y, h = t["x"], t["y"], t["h"]
        self.open = [g for g in self.open if x - g[3] < t["th"] * 3]
        for g in self.open:
            if max(0.0, min(g[1] + g[2], y + h) - max(g[1], y)) / max(1.0, min(g[2], h)) > 0.6 and x >= g[4]:
                g[3], g[4] = x + t["w"], x
                return [(*(t[c] for c in self.columns), g[0])]
        self.open.append([self.n, y, h, x + t["w"], x])
        self.n += 1
        return [(*(t[c] for c in self.columns), self.n - 1)]


class MovingRows(Rule):
    """Words in order of y join the row with the nearest moving centre; rows above the reach are closed."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.open, self.n = columns, [], 0

    def row(self, t):
        cy, slack = t["y"] + t["h"] / 2, max(5.0, t["mh"] * 0.42)
        self.open = [g for g in self.open if t["y"] - g[1] / g[2] <= slack]
        best = min(self.open, key=lambda g: abs(cy - g[1] / g[2]), default=None)
        if best is None or abs(cy - best[1] / best[2]) > slack:
            best = [self.n, 0.0, 0]
            self.open.append(best)
            self.n += 1
        best[1], best[2] = best[1] + cy, best[2] + 1
        return [(*(t[c] for c in self.columns), best[0])]


class Strokes(Rule):
    """Segments of one height in order of x grow over short gaps without words; words come before segments that begin 5 to their right or later."""

    def __init__(self):
        self.current, self.words = None, deque()

    def row(self, t):
        if t["line_id"] is None:
            self.words.append((t["y"], t["x"], t["r"]))
            return []
        cur = self.current
        if cur is not None:
            # segments to come end no further left than this one begins
            while self.words and self.words[0][1] < min(cur[3], t["x1"]) - 5:
                self.words.popleft()
            blocked = any(abs(y - cur[1]) < 12 and x >= cur[3] - 5 and r <= t["x1"] + 5 for y, x, r in self.words)
            if t["x1"] <= cur[3] + 16 and not blocked:
                cur[2], cur[3], cur[4] = min(cur[2], t["x1"]), max(cur[3], t["x2"]), cur[4] + [t["line_id"]]
                return []
        done = self.end()
        self.current = [t["line_id"], t["y"], t["x1"], t["x2"], [t["line_id"]]]
        return done

    def end(self):
        if self.current is None:
            return []
        line_id, y, x1, x2, ids = self.current
        return [(line_id, y, x1, x2, len(ids), ids)]


class Fused(Rule):
    """Fields in order of detection join the first kept one of the same area; kept ones lie on a grid."""

    GRID = 64.0

    def __init__(self, columns: Sequence[str]):
        self.columns, self.kept, self.tiles = columns, [], {}

    @staticmethod
    def same(k, c):
        w = max(0.0, min(k["x"] + k["w"], c["x"] + c["w"]) - max(k["x"], c["x"]))
        h = max(0.0, min(k["y"] + k["h"], c["y"] + c["h"]) - max(k["y"], c["y"]))
        inter, a, b = w * h, k["w"] * k["h"], c["w"] * c["h"]
        if inter > 0 and (inter >= 0.55 * (a + b - inter) or (min(a, b) >= max(a, b) * 0.5 and inter >= min(a, b) * 0.7)):
            return True
        dx, dy = k["x"] + k["w"] / 2 - c["x"] - c["w"] / 2, k["y"] + k["h"] / 2 - c["y"] - c["h"] / 2
        return (dx * dx + dy * dy) ** 0.5 <= 10 and abs(k["w"] - c["w"]) <= 15 and abs(k["h"] - c["h"]) <= 10

    def _places(self, r):
        g = self.GRID
        for tx in range(int((r["x"] - 10) // g), int((r["x"] + r["w"] + 10) // g) + 1):
            for ty in range(int((r["y"] - 10) // g), int((r["y"] + r["h"] + 10) // g) + 1):
                yield tx, ty

    def row(self, c):
        near = sorted({n for place in self._places(c) for n in self.tiles.get(place, ())})
        at = next((n for n in near if self.same(self.kept[n], c)), None)
        if at is None:
            at = len(self.kept)
            self.kept.append({k: c[k] for k in self.columns} | {"merged": 0})
        else:
            k = self.kept[at]
            if c["derivation"] == "TABLE_CELL" and k["derivation"] != "TABLE_CELL":
                k.update({n: c[n] for n in ("x", "y", "w", "h", "derivation")})
            if k["semantic_key"] is None and c["semantic_key"] is not None:
                k.update(label=c["label"], semantic_key=c["semantic_key"])
            value = lambda r: 0.8 if r["confidence"] is None else r["confidence"]
            k.update(confidence=max(value(k), value(c)), merged=k["merged"] + 1)
        for place in self._places(self.kept[at]):
            self.tiles.setdefault(place, set()).add(at)
        return []

    def end(self):
        return [tuple(k[c] for c in (*self.columns, "merged")) for k in self.kept]


class Stacks(Rule):
    """Ruled lines in order of y that stand in stacks; only lines that a stack may still take are held."""

    def __init__(self):
        self.held: list[dict] = []

    def row(self, r):
        self.held.append(r | {"used": False})
        return self._settle(r["y"])

    def end(self):
        return self._settle(float("inf"))

    def _settle(self, seen: float):
        out = []
        while self.held:
            base = self.held[0]
            if base["used"]:
                self.held.pop(0)
                continue
            ids, last, closed = [base], base["y"], False
            for c in self.held[1:]:
                if c["used"]:
                    continue
                dy, cw, bw = c["y"] - last, c["x2"] - c["x1"], base["x2"] - base["x1"]
                if dy > 36:
                    closed = True
                    break
                aligned = (abs(c["x1"] - base["x1"]) <= 30 and abs(c["x2"] - base["x2"]) <= 35) or min(cw, bw) / max(cw, bw) >= 0.7
                if dy >= 9 and aligned:
                    if c["own"]:
                        closed = True
                        break
                    ids.append(c)
                    last = c["y"]
            if not closed and seen - last <= 36:
                return out  # more lines may come
            left, right = min(m["x1"] for m in ids), max(m["x2"] for m in ids)
            prompt = next((p["id"] for p in base["above"] or () if left - 40 <= p["x"] <= right), None)
            if len(ids) >= 3 or (len(ids) == 2 and prompt is not None):
                for m in ids:
                    m["used"] = True
                out.append(([m["line_id"] for m in ids], left, base["y"], right - left, ids[-1]["y"] - base["y"], prompt))
            self.held.pop(0)
        return out


class Regions(Rule):
    """Requests in order of priority go into regions under a slot and an area budget."""

    def __init__(self, limit: int):
        self.limit, self.regions, self.used = limit, [], 0.0

    def row(self, c):
        ratio = lambda r: self._share(r, c)
        at = next((n for n, r in enumerate(self.regions) if ratio(r) > 0.5), None)
        region = None
        missing = c["part"] == 1
        if at is not None:
            r = self.regions[at]
            left, top = min(r[0], c["x"]), min(r[1], c["y"])
            w, h = max(r[0] + r[2], c["x"] + c["w"]) - left, max(r[1] + r[3], c["y"] + c["h"]) - top
            extra = w * h - r[2] * r[3]
            if self.used + extra <= c["budget"]:
                self.regions[at] = (left, top, w, h, r[4])
                self.used += extra
                region = at
        else:
            reserved = c["_any_missing"] and not missing and sum(not r[4] for r in self.regions) >= max(1, self.limit - 2)
            if len(self.regions) < self.limit and not reserved and self.used + c["w"] * c["h"] <= c["budget"]:
                region = len(self.regions)
                self.regions.append((c["x"], c["y"], c["w"], c["h"], missing))
                self.used += c["w"] * c["h"]
        return [(c["first_id"], c["reason"], c["priority"], c["token_ids"], region is not None, region)]

    @staticmethod
    def _share(r, c):
        w = max(0.0, min(r[0] + r[2], c["x"] + c["w"]) - max(r[0], c["x"]))
        h = max(0.0, min(r[1] + r[3], c["y"] + c["h"]) - max(r[1], c["y"]))
        return w * h / max(1.0, min(r[2] * r[3], c["w"] * c["h"]))


class Joined(Rule):
    """The smallest node that hangs together with each node, all edges of the group in one pass; the state is one number for each node."""

    def __init__(self):
        self.up = {}

    def _root(self, n):
        up = self.up
        while (above := up.get(n, n)) != n:
            up[n] = up.get(above, above)
            n = up[n]
        return n

    def row(self, r):
        a, b = self._root(r["one"]), self._root(r["other"])
        low = min(a, b)
        self.up[a] = self.up[b] = low
        return ()

    def end(self):
        return [(n, self._root(n)) for n in list(self.up)]


class Reached(Rule):
    """Which pairs of nodes hang together through nodes that begin no lower than a limit, all limits in one pass downward.

    Rows in order of ``at``: ``link`` rows join two nodes, ``ask`` rows want to know whether two nodes are joined by now. The state is one
    number for each node of the group.
    """

    def __init__(self):
        self.up = {}

    def _root(self, n):
        up = self.up
        while (above := up.get(n, n)) != n:
            up[n] = up.get(above, above)
            n = up[n]
        return n

    def row(self, r):
        a, b = self._root(r["one"]), self._root(r["other"])
        if r["ask"]:
            return [(r["one"], r["other"])] if a == b else []
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return []
