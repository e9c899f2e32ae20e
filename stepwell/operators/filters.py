"""Filters and membership tests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.functions import is_true
from stepwell.functions.names import column, quoted


class PairRule(NamedTuple):
    """Two values that must not occur together."""

    col_a: str
    value_a: Any
    col_b: str
    value_b: Any

    @property
    def name(self) -> str:
        return f"{self.col_a}={self.value_a} & {self.col_b}={self.value_b}"

    @property
    def broken(self) -> Column:
        return (column(self.col_a) == F.lit(self.value_a)) & (column(self.col_b) == F.lit(self.value_b))


def where_equals(df: DataFrame, name: str, value: Any) -> DataFrame:
    """Rows whose column equals a value; null never matches."""
    return df.filter(column(name) == F.lit(value))


def drill_down(df: DataFrame, levels: Sequence[str], values: Sequence[Any]) -> DataFrame:
    """Rows matching a selection of the first ``len(values)`` levels."""
    if len(values) > len(levels):
        raise ValueError("more values than levels")
    for level, value in zip(levels, values):
        df = where_equals(df, level, value)
    return df


def exclude_pairs(df: DataFrame, rules: Iterable[PairRule | Sequence]) -> DataFrame:
    """Rows that break none of the rules. A row for which a rule is unknown is dropped too."""
    for rule in rules:
        df = df.filter(~PairRule(*rule).broken)
    return df


def exclude_pair_table(df: DataFrame, rules: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """``exclude_pairs`` for many rules on one pair of columns, held in a table.

    ``rules`` has the columns ``value_a`` and ``value_b``. One anti join does
    the work. To drop rows whose test is unknown as well, each rule also stands
    for its value pairs with a null on either or both sides, compared null-safely.
    """
    pairs = rules.select("value_a", "value_b").dropna()
    no_a, no_b = (F.lit(None).cast(df.schema[c].dataType) for c in (col_a, col_b))
    tests = pairs.select(
        F.inline(
            F.array(
                *[
                    F.struct(a.alias("value_a"), b.alias("value_b"))
                    for a in (F.col("value_a"), no_a)
                    for b in (F.col("value_b"), no_b)
                ]
            )
        )
    ).distinct()
    broken = df[quoted(col_a)].eqNullSafe(tests["value_a"]) & df[quoted(col_b)].eqNullSafe(tests["value_b"])
    return df.join(tests, broken, "left_anti")


def is_member(requests: DataFrame, domain: DataFrame, column: str, name: str = "ok") -> DataFrame:
    """Flag each request whose value occurs in the domain's first column; null does not."""
    known = domain.toDF(*["__value", *domain.columns[1:]]).select("__value").distinct()
    known = known.withColumn("__known", F.lit(True))
    joined = requests.join(known, requests[quoted(column)] == known["__value"], "left")
    return joined.select(*[requests[quoted(c)] for c in requests.columns], is_true(F.col("__known")).alias(name))
