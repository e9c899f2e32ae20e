"""Generators: label domains, combination grids, row multiplication, stacking."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.functions import label
from stepwell.functions.names import column, quoted
from stepwell.operators.filters import PairRule
from stepwell.plans.positions import dense_positions
from stepwell.session import stored

MAX_LITERAL_VALUES = 10_000
MAX_ROWS = 2**63 - 1
COPIES_PER_STEP = 65_536


@dataclass(frozen=True)
class LabelRule:
    """Domain ``prefix1 .. prefixN``, kept as a rule so that its size does not matter."""

    prefix: str
    size: int


def labels_up_to(prefix: str, size: int) -> LabelRule:
    """Domain of labels for ``combination_grid``, with no table behind it."""
    return LabelRule(prefix, size)


def label_domain(spark: SparkSession, prefix: str, n: int, column: str = "value") -> DataFrame:
    """One row per label ``prefix1 .. prefixN``."""
    return spark.range(1, n + 1).select(label(prefix, F.col("id")).alias(column))


def combination_grid(
    spark: SparkSession,
    domains: Mapping[str, Sequence | LabelRule | DataFrame],
    position: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Every combination of one value per domain; the first column varies fastest.

    Row number ``i`` is read as a number in mixed radix, one digit per column.
    Each row is therefore computed from its own number: the work splits evenly
    over ``partitions`` and no product of tables is planned. A domain given as
    a one-column DataFrame stands for its distinct non-null values: they are
    stored, numbered in their order, and joined on their digit, and so is a long list. ``position`` names a column that
    keeps the row number.
    """
    parts = [_domain(spark, name, values) for name, values in domains.items()]
    total = reduce(lambda a, b: a * b, (size for size, _, _ in parts), 1)
    if total > MAX_ROWS:
        raise ValueError(f"grid of {total} rows does not fit a 64-bit row number")
    rows = spark.range(0, total, 1, partitions)
    number = position or "__row"
    rows = rows.withColumnRenamed("id", number)
    stride = 1
    for name, (size, value_at, table) in zip(domains, parts):
        digit = F.expr(f"({quoted(number)} div {stride}L) % {max(size, 1)}L")
        if table is None:
            rows = rows.withColumn(name, value_at(digit))
        else:
            rows = rows.withColumn("__digit", digit).join(table, "__digit").drop("__digit")
        stride *= max(size, 1)
    return rows.select(*map(quoted, [*([position] if position else []), *domains]))


def _domain(spark: SparkSession, name: str, values):
    """(size, digit -> Column or None, numbered table or None) of one domain."""
    if isinstance(values, LabelRule):
        return values.size, lambda digit: label(values.prefix, digit + 1), None
    if isinstance(values, DataFrame):
        known, _ = stored(values.toDF(name).filter(column(name).isNotNull()).distinct())
        size = known.count()
        return size, None, dense_positions(known, [], name, "__digit", size)
    values = list(values)
    if len(set(values)) < len(values):
        raise ValueError(f"repeated value in the domain of {name!r}")
    if len(values) > MAX_LITERAL_VALUES:
        numbered = spark.createDataFrame(list(enumerate(values)), ["__digit", name])
        return len(values), None, numbered.withColumn(name, column(name).cast(_literal_type(spark, values)))
    literals = F.array(*[F.lit(v) for v in values])
    return len(values), lambda digit: F.get(literals, digit.cast("int")), None


def _literal_type(spark: SparkSession, values: list):
    """Type of a list of literals, which does not depend on how many there are."""
    telling: dict = {}
    for v in values:
        kind = (type(v), v.as_tuple().exponent, len(v.as_tuple().digits)) if isinstance(v, Decimal) else type(v)
        low, high = telling.get(kind, (v, v))
        telling[kind] = (min(low, v), max(high, v)) if type(v) is int else (v, v)
    literals = F.array(*[F.lit(v) for pair in telling.values() for v in pair])
    return spark.range(0).select(literals.alias("a")).schema["a"].dataType.elementType


def allowed_grid(
    spark: SparkSession,
    domains: Mapping[str, Sequence | LabelRule | DataFrame],
    rules: Iterable[PairRule | Sequence],
    position: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``exclude_pairs(combination_grid(domains), rules)``, without making the rows that go.

    The grid grows column by column. A rule is applied when the second of its columns is added, among the numbers
    of the new values and before there are rows for them, so no step makes more rows than there are allowed
    prefixes. Rows, and the row numbers in ``position``, are those of the whole grid. The first columns are few rows; as soon
    as these are enough they are dealt out to ``partitions`` tasks, once.
    """
    names = list(domains)
    parts = [_domain(spark, name, values) for name, values in domains.items()]
    total = reduce(lambda a, b: a * b, (size for size, _, _ in parts), 1)
    if total > MAX_ROWS:
        raise ValueError(f"grid of {total} rows does not fit a 64-bit row number")
    rules = [PairRule(*rule) for rule in rules]
    for rule in rules:
        for name in (rule.col_a, rule.col_b):
            if name not in domains:
                raise ValueError(f"no column {name!r}")
    unsure = {name: _digits_of(domains[name], part, name, None) for name, part in zip(names, parts) if _ruled(rules, name)}
    partitions = partitions or spark.sparkContext.defaultParallelism

    rows, made, dealt = spark.range(1).select(F.lit(0).cast("bigint").alias("__row")), 1, False
    stride = 1
    for k, (name, part) in enumerate(zip(names, parts)):
        size = part[0]
        if size > COPIES_PER_STEP:
            starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"), F.lit(COPIES_PER_STEP).cast("bigint")))
            rows = rows.select("*", starts.alias("__start")).repartition(partitions)
            last = F.least(F.col("__start") + COPIES_PER_STEP, F.lit(size)) - 1
            new, dealt = F.sequence(F.col("__start"), last), True
        elif size:
            new = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
        else:
            new = F.array().cast("array<bigint>")
        before = [f"__digit_{i}" for i in range(k)]
        kept = F.filter(new, _allowed(k, names, rules, domains, parts, unsure))
        rows = rows.select("__row", *before, F.explode(kept).alias(f"__digit_{k}"))
        rows = rows.withColumn("__row", F.col("__row") + F.col(f"__digit_{k}") * stride)
        stride *= max(size, 1)
        made *= size
        if not dealt and k + 1 < len(names) and made >= 4 * partitions:
            rows, dealt = rows.repartition(partitions), True
    for k, (name, (_, value_at, table)) in enumerate(zip(names, parts)):
        if table is None:
            rows = rows.withColumn(name, value_at(column(f"__digit_{k}")))
        else:
            rows = rows.join(table.withColumnRenamed("__digit", f"__digit_{k}"), f"__digit_{k}")
    if position:
        rows = rows.withColumn(position, F.col("__row"))
    return rows.select(*map(quoted, [*([position] if position else []), *names]))


def _allowed(k: int, names: list[str], rules: Sequence[PairRule], domains: Mapping, parts: list, unsure: Mapping):
    """Test of a digit of column ``k`` against the digits before it: no rule that ends with this column drops the row."""

    def hits(name: str, value, digit: Column) -> Column:
        # a test on a null is unknown, and an unknown row goes too
        i = names.index(name)
        return _hits(digit if i == k else F.col(f"__digit_{i}"), value, domains[name], parts[i], name, unsure)

    def test(digit: Column) -> Column:
        keep = F.lit(True)
        for rule in rules:
            if max(names.index(rule.col_a), names.index(rule.col_b)) == k:
                keep = keep & ~(hits(rule.col_a, rule.value_a, digit) & hits(rule.col_b, rule.value_b, digit))
        return keep

    return test


def _ruled(rules: Sequence[PairRule], name: str) -> bool:
    return any(name in (rule.col_a, rule.col_b) for rule in rules)


def _hits(digit: Column, value, domain, part, name: str, unsure: Mapping[str, list[int]]) -> Column:
    """Whether a test for ``value`` is true or unknown at a digit."""
    if value is None:
        return F.lit(True)
    digits = [*_digits_of(domain, part, name, value), *unsure[name]]
    return digit.isin(digits) if digits else F.lit(False)


def _digits_of(domain, part, name: str, value) -> list[int]:
    """The digit of a value, None for the null; a value outside the domain has none."""
    size, _, table = part
    if isinstance(domain, LabelRule):
        tail = value[len(domain.prefix) :] if isinstance(value, str) and value.startswith(domain.prefix) else ""
        return [int(tail) - 1] if tail.isdecimal() and str(int(tail)) == tail and 1 <= int(tail) <= size else []
    if table is not None:
        test = column(name).isNull() if value is None else column(name) == F.lit(value)
        return [row[0] for row in table.filter(test).select("__digit").collect()]
    return [i for i, v in enumerate(domain) if (v is None if value is None else v == value)]


def replicate_rows(df: DataFrame, n: int, partitions: int | None = None) -> DataFrame:
    """Every row ``n`` times.

    Copies are made where the row is, without a shuffle. A small table sits in
    few partitions, so give ``partitions`` to spread it: then blocks of copies
    are numbered first, the block numbers are shuffled, and each task makes the
    copies of its blocks.
    """
    if n <= 0:
        return df.limit(0)
    blocks = max(-(-n // COPIES_PER_STEP), 1 if partitions is None else min(4 * partitions, n))
    if blocks == 1:
        return df.select("*", _repeat(F.lit(n))).drop("__copy")
    base, extra = divmod(n, blocks)
    spread = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    if partitions is not None:
        spread = spread.repartition(partitions)
    size = F.lit(base) + (F.col("__block") < extra).cast("int")
    return spread.select("*", _repeat(size)).drop("__block", "__copy")


def _repeat(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(1), n)).alias("__copy")


def stack_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables one above the other, matched by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)
