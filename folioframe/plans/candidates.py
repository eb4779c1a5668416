"""Which page profiles can score high together, told from classes of profiles before any pair is scored.

Profiles fall into classes by page count, page sizes, rotation and object counts. A class is known by the ranges of
these values, and two classes by an upper bound of every score between them. Only the classes are compared with each other; they are
few whatever the number of profiles. Profiles then meet by equality on a class and a salt, in pairs of classes whose bound allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

# Leading pages whose ranges a class keeps; later pages count as equal in a bound.
POSITIONS = 4
# Classes of one side; coarser keys are taken until they fit.
MOST_CLASSES = 2048
SALTS = 8
VALUES = ("w", "h", "rot", "vec", "ras", "txt")


class Range(NamedTuple):
    low: Column
    high: Column

    def meets(self, other: Range) -> Column:
        return (self.low <= other.high) & (other.low <= self.high)

    def apart(self, other: Range) -> Column:
        """Least distance of two values, one of each range."""
        return F.greatest(F.lit(0.0), other.low - self.high, self.low - other.high)

    def likeness(self, other: Range) -> Column:
        """Largest share min/max of two counts, one of each range."""
        less = F.least(self.high, other.high)
        more = F.greatest(self.low, other.low)
        return F.when(self.meets(other), 1.0).otherwise(less / F.greatest(more, F.lit(1)))


class PageRange:
    """Ranges of the values of one page position of a class."""

    def __init__(self, side: str, position: Column):
        for k, v in enumerate(VALUES):
            at = position * len(VALUES) + k
            setattr(self, v, Range(F.get(f"{side}_low", at), F.get(f"{side}_high", at)))


class Classed(NamedTuple):
    left: DataFrame
    right: DataFrame
    left_classes: DataFrame
    right_classes: DataFrame


def _values() -> Column:
    """The values of the leading pages, one after the other."""
    page = lambda p: F.array(*[p[v].cast("double") for v in VALUES])
    return F.flatten(F.transform(F.slice("pages", 1, POSITIONS), page))


def _keys() -> list[Column]:
    """Class keys from fine to coarse; the coarsest has one value for each doubling of the page count."""
    value = lambda i, v: F.get("_values", F.lit(i * len(VALUES) + VALUES.index(v)))
    steps = lambda x, base: F.floor(F.log2(x + 1) * base)
    shape = lambda i, grid, base: [F.floor(value(i, "w") / grid), F.floor(value(i, "h") / grid), value(i, "rot"), steps(value(i, "vec"), base), steps(value(i, "txt"), base)]
    long = F.floor(F.log2(F.col("page_count").cast("double")) * 2)
    return [F.xxhash64("page_count", "_loose", *shape(0, 64, 2), *shape(1, 64, 2)), F.xxhash64("page_count", "_loose", *shape(0, 128, 1)),
            F.xxhash64(long, "_loose", steps(value(0, "vec"), 1)), F.xxhash64(long, "_loose")]


def _loose_hashes(sides: Sequence[DataFrame]) -> DataFrame:
    """Page hashes under which different sizes or counts occur: a bound from these values does not hold for their pages."""
    pages = None
    for side in sides:
        page = side.select(F.explode("pages").alias("p")).select("p.*")
        told = page.select(F.explode(F.array(F.struct(F.concat(F.lit("g"), "geometry_hash").alias("hash"), F.xxhash64("w", "h", "rot", "vec").alias("what")),
                                             F.struct(F.concat(F.lit("s"), "structure_hash").alias("hash"), F.xxhash64("vec", "ras").alias("what")))).alias("t")).select("t.*").distinct()
        pages = told if pages is None else pages.unionByName(told)
    return pages.groupBy("hash").agg(F.min("what").alias("a"), F.max("what").alias("b")).where("a != b").select("hash")


def classed(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> Classed:
    """Both sides with their ``_class``, and the ranges of every class. Both have ``page_count`` and ``pages``."""
    loose = cut_lineage(_loose_hashes((left, right)))
    tame = loose.isEmpty()
    out = []
    for side, key in ((left, left_key), (right, right_key)):
        marked = side.withColumn("_loose", F.lit(False))
        if not tame:
            held = side.select(key, F.explode("pages").alias("p")).select(key, F.explode(F.array(F.concat(F.lit("g"), "p.geometry_hash"), F.concat(F.lit("s"), "p.structure_hash"))).alias("hash"))
            known = held.join(loose, "hash", "left_semi").select(key).distinct().withColumn("_found", F.lit(True))
            marked = side.join(known, key, "left").withColumn("_loose", F.coalesce("_found", F.lit(False))).drop("_found")
        out.append(marked.withColumn("_values", _values()))
    counts = [df.agg(*[F.approx_count_distinct(k, 0.02).alias(f"n{i}") for i, k in enumerate(_keys())]).first() for df in out]
    level = next(i for i in range(len(_keys())) if i + 1 == len(_keys()) or all((c[f"n{i}"] or 0) <= MOST_CLASSES for c in counts))
    out = [df.withColumn("_class", _keys()[level]) for df in out]
    tables = []
    for df, side in zip(out, ("a", "b")):
        single = df.select("_class", "page_count", "_loose", F.posexplode("_values").alias("at", "v"))
        ranges = single.groupBy("_class", "at").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min("page_count").alias("p0"), F.max("page_count").alias("p1"), F.max("_loose").alias("loose"))
        inside = F.array_sort(F.collect_list(F.struct("at", "low", "high")))  # at most one element for each position and value
        table = ranges.groupBy("_class").agg(inside.alias("r"), F.min("p0").alias(f"{side}_pages_low"), F.max("p1").alias(f"{side}_pages_high"), F.max("loose").alias(f"{side}_loose"))
        tables.append(table.select(F.col("_class").alias(f"{side}_class"), f"{side}_pages_low", f"{side}_pages_high", f"{side}_loose",
                                   F.transform("r", lambda e: e["low"]).alias(f"{side}_low"), F.transform("r", lambda e: e["high"]).alias(f"{side}_high")))
    return Classed(*[df.drop("_loose", "_values") for df in out], *tables)


def page_ratio() -> Column:
    """Largest possible share of the shorter document's pages in the longer one's, for a pair of classes."""
    return Range(F.col("a_pages_low"), F.col("a_pages_high")).likeness(Range(F.col("b_pages_low"), F.col("b_pages_high")))


def mean_bound(page: Callable[[PageRange, PageRange], Column]) -> Column:
    """Upper bound of page scores (0 to 100) summed over common pages and divided by the pages of the longer document."""
    exact = (F.col("a_pages_low") == F.col("a_pages_high")) & (F.col("b_pages_low") == F.col("b_pages_high"))
    common = F.least("a_pages_high", "b_pages_high")
    most = F.greatest(F.col("a_pages_low"), F.col("b_pages_low"), common)
    loose = F.col("a_loose") & F.col("b_loose")

    def lost_at(i: Column) -> Column:
        # if page counts vary inside a class, the first page alone is sure to take part
        taken = ~loose & (i < common) & (exact | (i == 0))
        return F.when(taken, 100.0 - page(PageRange("a", i), PageRange("b", i))).otherwise(0.0)

    # stated once for all positions: the pairs of classes are few, their plan should be short
    lost = F.aggregate(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), F.lit(0.0), lambda total, i: total + lost_at(i))
    return (common * 100.0 - lost) / most


def class_pairs(sides: Classed, bound: Column, least: float) -> DataFrame:
    """Pairs of classes whose bound reaches ``least``: ``a_class``, ``b_class``, ``bound``. Both tables have at most a few thousand rows."""
    met = sides.left_classes.crossJoin(sides.right_classes).select("a_class", "b_class", bound.alias("bound"))
    return cut_lineage(met.where(F.col("bound") >= least))


def meet(left: DataFrame, right: DataFrame, pairs: DataFrame, left_key: str) -> DataFrame:
    """Rows of both sides in paired classes. A class with many rows on the left is dealt over salts, the right side is small enough to be repeated."""
    dealt = left.join(pairs, F.col("_class") == F.col("a_class")).drop("_class", "a_class").withColumn("_salt", F.pmod(F.xxhash64(left_key), F.lit(SALTS)))
    salted = right.withColumnRenamed("_class", "b_class").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(salted, ["b_class", "_salt"]).drop("_salt", "b_class")


def best_of(sides: Classed, pairs: DataFrame, left_key: str, score: Callable[[DataFrame], DataFrame], k: int = 1, bonus: float = 0.0) -> DataFrame:
    """Scored pairs among which are the ``k`` best of every left row, found without scoring the rest.

    Each left class first meets the right class of the highest bound. What it finds there is a lower bound for its rows;
    then only classes whose upper bound reaches a row's own ``k``-th best score are met. ``score`` turns pairs into rows with ``left_key``
    and ``ranking``, which exceeds the score of the bound by at most ``bonus``; ``bound`` holds for rows that may tie, so ties are complete.
    """
    order = F.row_number().over(Window.partitionBy("a_class").orderBy(F.desc("bound"), "b_class"))
    ranked = cut_lineage(pairs.withColumn("_turn", order))
    first = cut_lineage(score(meet(sides.left, sides.right, ranked.where("_turn = 1").drop("_turn"), left_key).drop("bound")))
    place = F.row_number().over(Window.partitionBy(left_key).orderBy(F.desc("ranking")))
    known = first.select(left_key, "ranking").withColumn("_place", place).where(F.col("_place") == k).select(left_key, F.col("ranking").alias("_least"))
    rest = sides.left.join(known, left_key, "left").withColumn("_least", F.coalesce("_least", F.lit(float("-inf"))))
    later = rest.join(ranked.where("_turn > 1").drop("_turn"), F.col("_class") == F.col("a_class")).where(F.col("bound") + bonus >= F.col("_least"))
    later = later.drop("_class", "a_class", "bound", "_least").withColumn("_salt", F.pmod(F.xxhash64(left_key), F.lit(SALTS)))
    salted = sides.right.withColumnRenamed("_class", "b_class").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return first.unionByName(score(later.join(salted, ["b_class", "_salt"]).drop("_salt", "b_class")))
