"""Numbering rows without sorting a whole table, or a hot group, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwell.functions.names import column, quoted
from stepwell.session import stored

SLICE_ROWS = 1_000_000
GROUP_LIMIT = 1_000_000


def dense_positions(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str = "position",
    largest_group: int | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Number the values of each group 0, 1, 2, ...; values must not be null and not repeat.

    The numbers follow the order of the values whatever the size: groups known to be
    no larger than ``group_limit`` are numbered by one window, others in slices by value.
    """
    if largest_group is None:
        largest_group = group_limit + 1
    values = df.select(*map(quoted, [*group, value]))
    ranked = _ranked(values, list(group), value, name, largest_group, group_limit)
    return ranked.withColumn(name, column(name) - 1)


def positions_in_group(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str = "position",
    largest_group: int = 0,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Rank 1, 2, 3, ... of each row in its group, by ascending value; values must not repeat.

    A window sorts each group in one task. When ``largest_group`` says that a
    group is too large for that, the table is range-partitioned on group and
    value instead, so a large group is cut into slices by value: rows are ranked
    in their slice and shifted by the sizes of the slices before it. The slice
    numbers come from a sampled partitioning, so they are stored before they are used
    twice. A group has 2**31 - 1 rows at most.
    """
    ranked = _ranked(df, list(group), value, name, largest_group, group_limit)
    return ranked.withColumn(name, column(name).cast("int"))


def _ranked(df: DataFrame, group: list[str], value: str, name: str, largest_group: int, group_limit: int) -> DataFrame:
    """``df`` with the rank of each row in its group as a bigint."""
    keys, values = [quoted(c) for c in group], quoted(value)
    if largest_group <= group_limit:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(values)).cast("bigint"))
    spark = df.sparkSession
    n_slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-largest_group // SLICE_ROWS))
    sliced, _ = stored(df.repartitionByRange(n_slices, *keys, values).withColumn("__slice", F.spark_partition_id()))
    in_slice = Window.partitionBy(*keys, "__slice").orderBy(values)
    numbered = sliced.withColumn("__place", F.row_number().over(in_slice))
    sizes = sliced.groupBy(*keys, "__slice").agg(F.count("*").alias("__size"))
    shifted = _shift(numbered, sizes, group, "__slice")
    return shifted.select(*map(quoted, df.columns), (F.col("__shift") + F.col("__place")).alias(name))


def _shift(numbered: DataFrame, sizes: DataFrame, group: list[str], part: str) -> DataFrame:
    """Add to each row the number of rows in the earlier parts of its group."""
    keys = [quoted(c) for c in group]
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, part, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"))
    return numbered.join(shifts, [*group, part])
