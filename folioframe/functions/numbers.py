"""Rounding and numeric helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``: Spark repeats an expression inside a lambda
    for every element, a bound lambda variable it does not."""
    return F.get(F.transform(F.array(value), body), 0)


def half_up(value: Column) -> Column:
    """Round half towards plus infinity, as the source data was rounded."""
    return F.floor(value + F.lit(0.5))


def round_to(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def upper_median(values: Column) -> Column:
    """Element at floor(n/2) of the sorted array; null for an empty array."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def lower_median(values: Column) -> Column:
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int") + 1)
