"""Spatial joins: boxes meet through grid tiles, so one crowded page spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_no")


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2

    @property
    def area(self) -> Column:
        return self.w * self.h

    def grown(self, left=0.0, top=0.0, right=0.0, bottom=0.0) -> Box:
        return Box(self.x - left, self.y - top, self.w + left + right, self.h + top + bottom)


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in ("x", "y", "w", "h")))


def box_of(row: Column) -> Box:
    """The box inside a struct column."""
    return Box(row["x"], row["y"], row["w"], row["h"])


def shared_width(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.right, b.right) - F.greatest(a.x, b.x))


def shared_height(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def shared_area(a: Box, b: Box) -> Column:
    return shared_width(a, b) * shared_height(a, b)


def share(a: Box, b: Box) -> Column:
    """Part of ``a`` that lies in ``b``."""
    return shared_area(a, b) / F.greatest(F.lit(1.0), a.area)


def share_either(a: Box, b: Box) -> Column:
    return F.greatest(share(a, b), share(b, a))


def share_of_smaller(a: Box, b: Box) -> Column:
    smaller = F.least(a.area, b.area)
    return F.when(smaller > 0, shared_area(a, b) / smaller).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    inter = shared_area(a, b)
    union = a.area + b.area - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def vertical_share(a: Box, b: Box) -> Column:
    return shared_height(a, b) / F.greatest(F.lit(1.0), F.least(a.h, b.h))


def touches(a: Box, b: Box) -> Column:
    """Interiors intersect."""
    return (F.least(a.right, b.right) > F.greatest(a.x, b.x)) & (
        F.least(a.bottom, b.bottom) > F.greatest(a.y, b.y)
    )


def _tiled(df: DataFrame, by: Sequence[str], prefix: str, extent: Box, tile: float) -> DataFrame:
    lo_x, lo_y = extent.x, extent.y
    hi_x, hi_y = F.greatest(extent.right, lo_x), F.greatest(extent.bottom, lo_y)
    named = df.select(
        *[F.col(c) for c in by],
        *[F.col(c).alias(prefix + c) for c in df.columns if c not in by],
        lo_x.alias(f"_{prefix}x0"), lo_y.alias(f"_{prefix}y0"),
        hi_x.alias(f"_{prefix}x1"), hi_y.alias(f"_{prefix}y1"),
    )
    across = F.sequence(F.floor(F.col(f"_{prefix}x0") / tile), F.floor(F.col(f"_{prefix}x1") / tile))
    down = F.sequence(F.floor(F.col(f"_{prefix}y0") / tile), F.floor(F.col(f"_{prefix}y1") / tile))
    return named.withColumn("_tx", F.explode(across)).withColumn("_ty", F.explode(down))


def near_join(a: DataFrame, b: DataFrame, by: Sequence[str] = PAGE, *, reach: Box | None = None,
              b_extent: Box | None = None, tile: float = 256.0) -> DataFrame:
    """Pairs on one page whose extents meet, each pair exactly once.

    Both sides are placed on every tile they touch; a pair is kept only on the tile that holds
    the corner where the two extents begin to overlap, so no de-duplicating shuffle follows.
    ``reach`` is the box within which partners of a left row must lie (its own box by default).
    The result has the keys, then the columns of both sides prefixed ``a_`` and ``b_``.
    """
    left = _tiled(a, by, "a_", reach or box(), tile)
    right = _tiled(b, by, "b_", b_extent or box(), tile)
    corner_x = F.greatest(F.col("_a_x0"), F.col("_b_x0"))
    corner_y = F.greatest(F.col("_a_y0"), F.col("_b_y0"))
    joined = left.join(right, [*by, "_tx", "_ty"]).where(
        (corner_x <= F.least(F.col("_a_x1"), F.col("_b_x1")))
        & (corner_y <= F.least(F.col("_a_y1"), F.col("_b_y1")))
        & (F.floor(corner_x / tile) == F.col("_tx"))
        & (F.floor(corner_y / tile) == F.col("_ty"))
    )
    extra = ["_tx", "_ty"] + [f"_{p}_{c}" for p in "ab" for c in ("x0", "y0", "x1", "y1")]
    return joined.drop(*extra)


def best_partner(pairs: DataFrame, keys: Sequence[str], rank: Sequence[Column],
                 take: dict[str, Column]) -> DataFrame:
    """Best right row per left row: a partial aggregate, not a sort of each left row's partners."""
    candidate = F.struct(
        *[r.alias(f"r{i}") for i, r in enumerate(rank)], *[c.alias(n) for n, c in take.items()]
    )
    best = pairs.groupBy(*keys).agg(F.min(candidate).alias("_best"))
    return best.select(*keys, *[F.col("_best")[n].alias(n) for n in take])


def without_partner(a: DataFrame, pairs: DataFrame, by: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Left rows of ``a`` that have no row in ``pairs`` (pair columns carry the ``a_`` prefix)."""
    hit = pairs.select(*by, *[F.col("a_" + c).alias(c) for c in ids]).distinct()
    return a.join(hit, [*by, *ids], "left_anti")


def with_partner(a: DataFrame, pairs: DataFrame, by: Sequence[str], ids: Sequence[str]) -> DataFrame:
    hit = pairs.select(*by, *[F.col("a_" + c).alias(c) for c in ids]).distinct()
    return a.join(hit, [*by, *ids], "left_semi")
