"""Counts, choices and previews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.functions.names import column as col, quoted
from stepwell.operators.filters import drill_down
from stepwell.plans.index import LevelIndex, as_index


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, as one row with column ``n``."""
    return df.agg(F.count("*").alias("n"))


def root_choices(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, in no order; a null stays."""
    return df.select(col(column)).distinct()


def choices(df: DataFrame, levels: Sequence[str], values: Sequence[Any]) -> DataFrame:
    """Choices of the level below one selection: distinct, without null, ascending."""
    if len(values) >= len(levels):
        raise ValueError("the selection leaves no level to choose")
    level = levels[len(values)]
    below = drill_down(df, levels, values).select(col(level))
    return below.filter(col(level).isNotNull()).distinct().orderBy(col(level))


def choices_for(
    requests: DataFrame,
    source: DataFrame | LevelIndex,
    levels: Sequence[str] | None = None,
    request_id: str = "request_id",
) -> DataFrame:
    """Choices of the levels 2..n under the values each request holds above them.

    The rows are (request, level, position, value), one per choice. A request
    becomes one key row per level, with nulls for the levels not above it. All
    levels whose choices are small meet the requests in a single broadcast join; each
    larger level is shuffled on its own, so the few hot keys of the upper levels
    stay out of it. Positions are counted once per combination, not once per request.
    """
    index = as_index(source, levels)
    if index.depth == 1:
        nothing = "request_id bigint, level int, position int, value string"
        return requests.sparkSession.createDataFrame([], nothing).withColumnRenamed("request_id", request_id)
    above = index.levels[:-1]
    types = [index.schema[c].dataType.simpleString() for c in above]

    def only_above(k: int, names: Sequence[str], prefix: str) -> list[str]:
        """The first k-1 of the names as keys, the other keys null."""
        return [
            f"{name if i < k else f'CAST(NULL AS {kind})'} AS {prefix}_{i}"
            for i, (name, kind) in enumerate(zip(names, types), 1)
        ]

    keys = index.keys(index.depth - 1)
    names = [quoted(c) for c in above]

    def met(levels: Sequence[int]) -> DataFrame:
        offered = reduce(
            DataFrame.union,
            [
                index.choices(k).selectExpr(
                    f"{k} AS offered_level",
                    *only_above(k, keys, "offered"),
                    "position",
                    f"CAST(key_{k} AS STRING) AS value",
                )
                for k in levels
            ],
        )
        if all(index.is_small(k) for k in levels):
            offered = F.broadcast(offered)  # each level is small by its measured bytes
        asked = ", ".join(
            f"CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in names[: k - 1])} "
            f"THEN struct({k} AS level, {', '.join(only_above(k, names, 'asked'))}) END"
            for k in levels
        )
        asked = requests.selectExpr(quoted(request_id), f"inline(array_compact(array({asked})))")
        same = " AND ".join(f"asked_{i} <=> offered_{i}" for i in range(1, index.depth))
        joined = asked.join(offered, F.expr(f"level = offered_level AND {same}"))
        return joined.select(col(request_id), "level", "position", "value")

    deeper = range(2, index.depth + 1)
    small = [k for k in deeper if index.is_small(k)]
    groups = [small] * bool(small) + [[k] for k in deeper if k not in small]
    return reduce(DataFrame.union, map(met, groups))


def preview(df: DataFrame, n: int = 6, order_by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows. Without an order they are any ``n`` rows."""
    return (df.orderBy(*map(col, order_by)) if order_by else df).limit(n)
