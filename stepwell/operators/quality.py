"""Reports on a table: absent value pairs, broken rules, structure, summary."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwell.functions import size_line
from stepwell.functions.names import column
from stepwell.operators.choices import preview, row_count
from stepwell.operators.filters import PairRule
from stepwell.plans.positions import GROUP_LIMIT, dense_positions
from stepwell.session import stored
from stepwell.sources.tables import scan, storage_size

SLICE_WIDTH = 4_096
PAIR_KEYS = ["col_a", "value_a", "col_b"]
#: Shift of a place to the neighbour that it is named for.
NEXT = [(-1, "next"), (1, "previous")]


def absent_pairs(
    df: DataFrame, cols: Sequence[str], slice_width: int = SLICE_WIDTH, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Values of one column that never occur with a value of another.

    One row per (col_a, value_a, col_b, value_b), with col_a before col_b in
    ``cols``; nulls are no values. The product of the domains is never built.
    The values of each column are numbered; for each value of ``col_a`` the
    numbers seen with it leave gaps, and exactly the numbers in the gaps are
    written out. In a domain wider than ``slice_width``, gaps are looked for
    slice by slice, and slices with nothing seen are found as gaps between
    slices, so no task handles a whole domain for one value. Combinations and
    values are stored in the shared folder, as they are used several times.
    """
    known = _numbered(df, cols, group_limit)
    if known is None:
        return df.sparkSession.createDataFrame([], "col_a string, value_a string, col_b string, value_b string")
    _, seen, marks, partners, place_of_b, size, largest = known
    if largest <= slice_width:
        missing = _gaps(seen.unionByName(marks), PAIR_KEYS, "place", size)
    else:
        missing = _gaps_by_slice(seen, partners, PAIR_KEYS, size, F.lit(-1).cast("bigint"), slice_width)
    return missing.join(place_of_b, ["col_b", "place"]).select(*PAIR_KEYS, "value_b")


def absent_ranges(
    df: DataFrame, cols: Sequence[str], group_limit: int = GROUP_LIMIT, slice_width: int = SLICE_WIDTH
) -> DataFrame:
    """``absent_pairs`` as ranges: (col_a, value_a, col_b, first_value, last_value, n_values).

    A range holds consecutive values of ``col_b``, in the order of their text, none of which occurs with the
    value. There is at most one range more than values seen, so the result grows with what occurs
    and not with the product of the domains. Gaps are found in slices of ``slice_width`` values; the last place seen
    in a slice meets the first one of the next slice that holds any, so no task handles a whole domain for one value.
    """
    known = _numbered(df, cols, group_limit)
    if known is None:
        empty = "col_a string, value_a string, col_b string, first_value string, last_value string, n_values bigint"
        return df.sparkSession.createDataFrame([], empty)
    pairs, _, marks, _, place_of_b, size, _ = known
    # each place with the values before and after it, so that gaps need not look them up
    near = place_of_b.select("col_b", F.col("place").alias("own"), "value_b")
    after, before = (near.select("col_b", (F.col("own") + d).alias("place"), F.col("value_b").alias(name)) for d, name in NEXT)
    around = place_of_b
    for neighbour in (after, before):
        # files tell little of the size of a domain in memory, so it is never broadcast
        around = around.join(neighbour.hint("merge"), ["col_b", "place"], "left")
    around, _ = stored(around)
    seen = pairs.join(around, ["col_b", "value_b"])
    # a domain begins at its mark and ends behind its last place
    ends = place_of_b.groupBy("col_b").agg(F.min_by("value_b", "place").alias("next"), F.max_by("value_b", "place").alias("last"))
    domain = {row["col_b"]: (row["next"], row["last"]) for row in ends.collect()}
    first_of, last_of = (_by_column({c: x[i] for c, x in domain.items()}) for i in (0, 1))
    marks = marks.select(*PAIR_KEYS, "place", first_of.alias("next"), F.lit(None).cast("string").alias("previous"))
    # the mark at -1 is in the first slice
    placed = seen.select(*marks.columns).unionByName(marks)
    placed = placed.withColumn("slice", F.greatest(F.floor(F.col("place") / slice_width), F.lit(0)))
    in_slice = Window.partitionBy(*PAIR_KEYS, "slice").orderBy("place")
    here = F.struct("place", "previous")
    placed = placed.select("*", F.lead(here).over(in_slice).alias("until"), F.first(here).over(in_slice).alias("begin"))
    # what has no gap behind it in its slice is of no use, but for the last place of a slice
    placed, _ = stored(placed.filter("until IS NULL OR until.place > place + 1"))
    # one row per slice: the next slice that holds anything ends the gap
    border = F.lead("begin").over(Window.partitionBy(*PAIR_KEYS).orderBy("slice"))
    behind = F.struct(size.alias("place"), last_of.alias("previous"))
    borders = placed.filter("until IS NULL").withColumn("until", F.coalesce(border, behind))
    gaps = placed.filter("until IS NOT NULL").unionByName(borders).withColumn("n_values", F.expr("until.place - place - 1"))
    names = [F.col("next").alias("first_value"), F.col("until.previous").alias("last_value")]
    return gaps.filter("n_values > 0").select(*PAIR_KEYS, *names, "n_values")


def _by_column(values: dict):
    """The value that belongs to ``col_b``."""
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("col_b")]


def _numbered(df: DataFrame, cols: Sequence[str], group_limit: int):
    """Numbered values of all column pairs, None if fewer than two columns have any.

    The value pairs that occur, the places of ``col_b`` seen with each value of ``col_a``, a mark before the first place of each, the pairs of
    a value and a column, the places, the number of places by column, and the largest of these.
    """
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    combinations = df.select(*map(column, cols)).distinct()
    cells = [F.struct(F.lit(c).alias("col"), column(c).cast("string").alias("value")) for c in cols]
    combinations, _ = stored(combinations)
    values, _ = stored(combinations.select(F.inline(F.array(*cells))).dropna().distinct())
    # one row per column
    sizes = {row["col"]: row["count"] for row in values.groupBy("col").count().collect()}
    if len(sizes) < 2:
        return None
    largest = max(sizes.values())
    places, _ = stored(dense_positions(values, ["col"], "value", "place", largest, group_limit))
    place_of_b = places.withColumnsRenamed({"col": "col_b", "value": "value_b"})
    size = _by_column(sizes)

    met = _value_pairs(combinations, pairs)
    seen = met.join(place_of_b, ["col_b", "value_b"]).select(*PAIR_KEYS, "place")
    partners = F.create_map(*[x for c in cols for x in (F.lit(c), _array([b for a, b in pairs if a == c]))])
    partners = values.select(
        F.col("col").alias("col_a"), F.col("value").alias("value_a"), F.explode(partners[F.col("col")]).alias("col_b")
    )
    partners = partners.filter(F.col("col_b").isin(list(sizes)))
    # a mark before the first number also catches values that were seen with nothing
    marks = partners.withColumn("place", F.lit(-1).cast("bigint"))
    return met, seen, marks, partners, place_of_b, size, largest


def _gaps_by_slice(seen, partners, keys, size, mark, width: int) -> DataFrame:
    """Missing places, looked for in slices of ``width`` places."""
    seen = seen.withColumn("slice", F.floor(F.col("place") / width))
    slices = seen.select(*keys, "slice").distinct()
    low = F.col("slice") * width
    high = F.least(low + width, size)

    marked = slices.unionByName(partners.withColumn("slice", mark))
    empty = _gaps(marked, keys, "slice", F.ceil(size / width))
    in_empty = empty.select(*keys, F.explode(F.sequence(low, high - 1)).alias("place"))

    marked = seen.unionByName(slices.withColumn("place", low - 1))
    in_slices = _gaps(marked, [*keys, "slice"], "place", high).select(*keys, "place")
    return in_empty.unionByName(in_slices)


def _array(names: list[str]):
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _value_pairs(combinations: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Distinct non-null value pairs of all column pairs."""
    cells = [
        F.struct(
            F.lit(a).alias("col_a"),
            column(a).cast("string").alias("value_a"),
            F.lit(b).alias("col_b"),
            column(b).cast("string").alias("value_b"),
        )
        for a, b in pairs
    ]
    return combinations.select(F.inline(F.array(*cells))).dropna().distinct()


def _gaps(rows: DataFrame, keys: list[str], number: str, end) -> DataFrame:
    """Numbers missing after each number of a key, up to the next one or to ``end``."""
    after = Window.partitionBy(*keys).orderBy(number)
    until = F.coalesce(F.lead(number).over(after), end)
    gaps = rows.withColumn("__until", until).filter(F.col("__until") > F.col(number) + 1)
    missing = F.explode(F.sequence(F.col(number) + 1, F.col("__until") - 1))
    return gaps.select(*keys, missing.alias("__missing")).withColumnRenamed("__missing", number)


def check_rules(df: DataFrame, rules: Iterable[PairRule | Sequence]) -> DataFrame:
    """Number of rows that break each rule, counted for all rules in one pass."""
    rules = [PairRule(*rule) for rule in rules]
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, n_rows bigint")
    counts = df.agg(*[F.count_if(rule.broken).alias(f"n_{i}") for i, rule in enumerate(rules)])
    rows = [F.struct(F.lit(r.name).alias("rule"), F.col(f"n_{i}").alias("n_rows")) for i, r in enumerate(rules)]
    return counts.select(F.inline(F.array(*rows)))


def structure(df: DataFrame, n: int = 6, order_by: Sequence[str] = (), missing: str = "NA") -> DataFrame:
    """Name, type and first ``n`` values of each column, nulls shown as ``missing``."""
    head = preview(df, n, order_by)
    # at most n rows are left, so one task may number and list them
    in_order = Window.orderBy(*map(column, order_by)) if order_by else Window.orderBy(F.monotonically_increasing_id())
    numbered = head.withColumn("__row", F.row_number().over(in_order))
    samples = []
    for position, field in enumerate(df.schema, 1):
        shown = F.coalesce(column(field.name).cast("string"), F.lit(missing))
        listed = F.sort_array(F.collect_list(F.struct(F.col("__row").alias("row"), shown.alias("value"))))
        samples.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.concat_ws(" ", listed["value"]).alias("sample"),
            )
        )
    return numbered.agg(F.array(*samples).alias("columns")).select(F.inline("columns"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Row count, bytes on disk and the summary line of a stored table."""
    size = storage_size(spark, path).select("bytes").scalar()
    counted = row_count(scan(spark, path)).select(F.col("n").alias("n_rows"), size.alias("bytes"))
    return counted.withColumn("text", size_line(F.col("n_rows"), F.col("bytes")))
