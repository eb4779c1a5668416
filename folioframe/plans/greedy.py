"""Order-dependent selection: keep a row unless an earlier kept row conflicts with it.

Pages of ordinary size are folded inside the JVM. A group above ``fold_limit`` rows is never
gathered: its conflicts become an edge table and the same answer is reached in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.numbers import let
from folioframe.plans.spatial import Box, near_join
from folioframe.session import cut_lineage, shuffles_removed

FOLD_LIMIT = 3000

Conflict = Callable[[Column, Column], Column]


def split_by_size(df: DataFrame, by: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to ``limit``, and the rows of larger groups if there are any."""
    crowded = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*by)
    with shuffles_removed(df.sparkSession):
        found = crowded.limit(10_001).collect()
    if not found:
        return df, None
    if len(found) <= 10_000:  # a short list of keys: safe to ship to every task
        keys = F.broadcast(df.sparkSession.createDataFrame(found, crowded.schema))
    else:
        keys = crowded
    return df.join(keys, list(by), "left_anti"), df.join(keys, list(by), "left_semi")


def _fold(df: DataFrame, by: Sequence[str], row_id: str, order: Sequence[Column],
          conflict: Conflict, owned: bool = True) -> DataFrame:
    """Rows with their owners; with ``owned`` false only the rows that own themselves, for which no owner is looked up."""
    values = [c for c in df.columns if c not in by]
    row = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *values)
    kept_type = df.select(row.alias("r")).schema["r"].dataType.simpleString()
    pages = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    none = F.array().cast(f"array<{kept_type}>")
    kept = F.aggregate(
        "_rows", none,
        lambda acc, c: F.when(F.exists(acc, lambda k: conflict(k, c)), acc).otherwise(
            F.concat(acc, F.array(c))
        ),
    )

    if not owned:
        own = let(F.transform(kept, lambda r: r[row_id]), lambda ids: F.filter("_rows", lambda c: F.array_contains(ids, c[row_id])))
        return pages.select(*by, F.explode(own).alias("_e")).select(*by, *[F.col("_e")[v].alias(v) for v in values])

    def owners(chosen: Column, ids: Column) -> Column:
        def owner(c: Column) -> Column:
            own = F.array_position(ids, c[row_id])
            first = F.array_position(F.transform(chosen, lambda k: F.coalesce(conflict(k, c), F.lit(False))), True)
            return let(F.when(own > 0, own).otherwise(first).cast("int"), lambda rank: F.struct(
                c.alias("row"), F.get(ids, rank - 1).alias("owner_id"), (rank - 1).cast("bigint").alias("owner_rank")))

        return F.transform("_rows", owner)

    claimed = let(kept, lambda k: let(F.transform(k, lambda r: r[row_id]), lambda ids: owners(k, ids)))
    flat = pages.select(*by, F.explode(claimed).alias("_e"))
    return flat.select(*by, *[F.col("_e.row")[v].alias(v) for v in values],
                       F.col("_e.owner_id").alias("owner_id"), F.col("_e.owner_rank").alias("owner_rank"))


def _rounds(df: DataFrame, by: Sequence[str], row_id: str, order: Sequence[Column],
            conflict: Conflict, extent: Box, tile: float) -> DataFrame:
    values = [c for c in df.columns if c not in by]
    ranked = df.withColumn("_order", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    as_struct = lambda p: F.struct(*[F.col(p + v).alias(v) for v in values])
    pairs = near_join(ranked, ranked, by, reach=extent, b_extent=extent, tile=tile)
    earlier = F.col("a__order") < F.col("b__order")
    edges = cut_lineage(
        pairs.where(earlier & conflict(as_struct("a_"), as_struct("b_")))
        .select(*by, F.col(f"a_{row_id}").alias("_k"), F.col(f"b_{row_id}").alias("_c"),
                F.col("a__order").alias("_ko"))
    )
    node = lambda name: [*by, F.col(name).alias("_id")]
    open_rows = cut_lineage(ranked.select(*by, F.col(row_id).alias("_id")))
    live, kept = edges, None
    while not open_rows.isEmpty():
        winners = open_rows.join(live.select(*node("_c")).distinct(), [*by, "_id"], "left_anti")
        kept = cut_lineage(winners if kept is None else kept.unionByName(winners))
        losers = edges.join(kept.withColumnRenamed("_id", "_k"), [*by, "_k"], "left_semi").select(*node("_c"))
        decided = kept.unionByName(losers.distinct())
        open_rows = cut_lineage(open_rows.join(decided, [*by, "_id"], "left_anti"))
        still = open_rows.withColumnRenamed("_id", "_k")
        live = cut_lineage(
            edges.join(still, [*by, "_k"], "left_semi")
            .join(open_rows.withColumnRenamed("_id", "_c"), [*by, "_c"], "left_semi")
        )
    first = (
        edges.join(kept.withColumnRenamed("_id", "_k"), [*by, "_k"], "left_semi")
        .groupBy(*by, F.col("_c").alias(row_id)).agg(F.min(F.struct("_ko", "_k")).alias("_own"))
    )
    owned = (
        ranked.join(first, [*by, row_id], "left")
        .join(kept.select(*by, F.col("_id").alias(row_id), F.lit(True).alias("_is_kept")), [*by, row_id], "left")
        .withColumn("owner_id", F.when(F.col("_is_kept"), F.col(row_id)).otherwise(F.col("_own._k")))
    )
    from pyspark.sql import Window

    ranks = (
        owned.where("_is_kept")
        .withColumn("owner_rank", (F.row_number().over(Window.partitionBy(*by).orderBy("_order")) - 1).cast("bigint"))
        .select(*by, F.col(row_id).alias("owner_id"), "owner_rank")
    )
    return owned.join(ranks, [*by, "owner_id"], "left").select(*by, *values, "owner_id", "owner_rank")


def greedy_owner(df: DataFrame, by: Sequence[str], row_id: str, order: Sequence[Column],
                 conflict: Conflict, extent: Box, *, fold_limit: int = FOLD_LIMIT,
                 tile: float = 256.0) -> DataFrame:
    """Every row with the kept row that first claims it (itself if it was kept).

    ``order`` must be a total order. ``conflict(earlier, later)`` gets two struct columns and must
    only be true where the two extents meet. The rows are written first: they are counted, then folded.
    """
    df = cut_lineage(df)
    usual, crowded = split_by_size(df, by, fold_limit)
    result = _fold(usual, by, row_id, order, conflict)
    if crowded is not None:
        result = result.unionByName(_rounds(crowded, by, row_id, order, conflict, extent, tile))
    return result


def greedy_keep(df: DataFrame, by: Sequence[str], row_id: str, order: Sequence[Column],
                conflict: Conflict, extent: Box, *, fold_limit: int = FOLD_LIMIT,
                tile: float = 256.0) -> DataFrame:
    """The kept rows of :func:`greedy_owner`; nobody looks up who claims the others."""
    df = cut_lineage(df)
    usual, crowded = split_by_size(df, by, fold_limit)
    result = _fold(usual, by, row_id, order, conflict, owned=False)
    if crowded is not None:
        owned = _rounds(crowded, by, row_id, order, conflict, extent, tile)
        result = result.unionByName(owned.where(F.col("owner_id") == F.col(row_id)).drop("owner_id", "owner_rank"))
    return result
