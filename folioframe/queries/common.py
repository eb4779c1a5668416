"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.fixtures import Fixtures, oracle_query
from folioframe.functions.numbers import round_to

BY = ("page_id",)

# Which words play the part of printed labels and prompts.
PROMPT_WORDS = "(text LIKE '%gear' OR text LIKE '%bolt' OR text LIKE '%ring')"


class Catalogue:
    """Queries and their oracle texts, filled by the modules of this folder."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, sql: str | None = None, shared: str | None = None):
        """``shared``: a view that several others of the query derive from; it is written once."""
        def register(build):
            self.queries[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir).shared(shared) if shared else Fixtures(spark, sf_dir))
            if sql is not None:
                self.oracles[name] = oracle_query(sql)
            return build

        return register


def r4(column, name):
    column = F.col(column) if isinstance(column, str) else column
    return round_to(column, 4).alias(name)


# Overlap formulas of the oracle texts: {a} and {b} are table aliases.
def sql_inter(a: str, b: str) -> str:
    return (f"(greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
            f" * greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))")


def sql_share(a: str, b: str) -> str:
    return f"({sql_inter(a, b)} / greatest(1.0, {a}.w * {a}.h))"


def sql_vertical(a: str, b: str) -> str:
    return (f"(greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
            f" / greatest(1.0, least({a}.h, {b}.h)))")


def sql_r4(expression: str) -> str:
    return f"floor(({expression}) * 10000.0 + 0.5) / 10000.0"
