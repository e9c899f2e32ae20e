"""The level index: everything the cascade needs to know about a table.

It holds the *combinations*: the distinct rows of the level columns, with their
counts, and for each the first level at which it differs from the combination
before it in sort order. A combination that is *fresh* at level ``k`` or above
is the least one that begins with its first ``k`` values, so its deeper values
are the *first path* below them: at every deeper level the first choice under
the first choice of the level before. Such a combination also holds the number of choices
below its own prefixes. The lookup table of any level is therefore
a filter over the combinations, with no aggregation.

A stored index is replaced as a whole, and keeps each large lookup table in buckets of its keys, too.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from stepwell.functions.names import quoted
from stepwell.plans.positions import GROUP_LIMIT, positions_in_group
from stepwell.session import remove_folder, stored
from stepwell.sources.tables import write_table
from stepwell.sources.versions import current, publish

BROADCAST_BYTES = 32 * 1024 * 1024
ONE_TASK_ROWS = 50_000
SLICE_ROWS = 1_000_000
BUCKET_BYTES = 64 * 1024 * 1024
OWN_COLUMNS = ["n_rows", "fresh"]


class LevelIndex:
    """Index of one table on an ordered list of level columns; see ``build_index`` and ``read_index``."""

    def __init__(
        self,
        levels: Sequence[str],
        combinations: DataFrame,
        group_limit: int = GROUP_LIMIT,
        measures: Sequence[int] | None = None,
        path: str | None = None,
        folders: Sequence[str] = (),
        buckets: Mapping[int, str] | None = None,
        broadcast_bytes: int | None = None,
    ):
        self.levels = tuple(levels)
        self.combinations = combinations
        self.group_limit = group_limit
        self.stored_at = path
        self._tables: dict[tuple[str, int], DataFrame] = {}
        self._opened: dict[str, DataFrame] = {}
        self._folders = list(folders)
        self._broadcast_bytes = broadcast_bytes
        #: catalog names of the nodes that are stored in buckets of their keys
        self.buckets = dict(buckets or {})
        if measures is not None:
            self.measures = tuple(measures)

    @property
    def depth(self) -> int:
        return len(self.levels)

    @property
    def schema(self) -> StructType:
        return self.combinations.schema

    @cached_property
    def measures(self) -> tuple[int, ...]:
        """Rows of each node, then the bytes of the values in each node."""
        return tuple(self.measure().first())

    @cached_property
    def top_sizes(self) -> tuple[int, int]:
        """Combinations, and those of the top value that has most."""
        return _top_sizes(self.combinations, quoted(self.levels[0]))

    def measure(self) -> DataFrame:
        each = range(1, self.depth + 1)
        width = " + ".join(f"coalesce(octet_length(CAST({quoted(c)} AS STRING)), 0)" for c in self.levels)
        rows = [f"count_if({self._in_node(k)}) AS rows_{k}" for k in each]
        size = [f"CAST(coalesce(sum(CASE WHEN {self._in_node(k)} THEN {width} END), 0) AS BIGINT) AS bytes_{k}" for k in each]
        return self.combinations.selectExpr(*rows, *size)

    def number_of(self, level: str | int) -> int:
        """1-based number of a level given by name or number."""
        number = self.levels.index(level) + 1 if isinstance(level, str) else level
        if not 1 <= number <= self.depth:
            raise ValueError(f"level {level} is outside 1..{self.depth}")
        return number

    def keys(self, k: int) -> list[str]:
        return [f"key_{i}" for i in range(1, k + 1)]

    def path(self, k: int) -> list[str]:
        """First-path columns of node ``k``."""
        return [f"first_{j}" for j in range(k + 1, self.depth + 1)]

    def numbers(self, k: int) -> list[str]:
        """Columns of node ``k`` with the number of choices of each deeper level, under the first path."""
        return [f"n_{j}" for j in range(k + 1, self.depth + 1)]

    def node(self, k: int) -> DataFrame:
        """Columns ``key_1 .. key_k``, the first path below them and the numbers of choices along it."""
        return self._table("node", k, k, self._compute_node)

    def bucketed(self, k: int) -> DataFrame:
        """Node ``k`` from its buckets if it has any, so that a join on its keys does not shuffle it."""
        return self.combinations.sparkSession.table(self.buckets[k]) if k in self.buckets else self.node(k)

    def choices(self, k: int) -> DataFrame:
        """Columns ``key_1 .. key_k`` and the ``position`` of the last among the choices under the others."""
        return self._table("choices", k, k, self._compute_choices)

    def is_small(self, k: int) -> bool:
        """Whether a table with a row per prefix of length ``k`` may be broadcast, by its measured bytes."""
        rows, size = self.measures[k - 1], self.measures[self.depth + k - 1]
        return size + rows * 32 * (self.depth + 1) <= self.broadcast_bytes

    @property
    def broadcast_bytes(self) -> int:
        """Bytes that a lookup may have to be broadcast."""
        return BROADCAST_BYTES if self._broadcast_bytes is None else self._broadcast_bytes

    def unpersist(self) -> None:
        """Delete the files that ``build_index`` has made for this index; a stored index stays."""
        spark = self.combinations.sparkSession
        for folder in self._folders:
            remove_folder(spark, folder)
        for name in self.buckets.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._folders, self.buckets = [], {}

    def _in_node(self, k: int) -> str:
        return f"fresh <= {k} AND {quoted(self.levels[k - 1])} IS NOT NULL"

    def _table(self, kind: str, k: int, prefix: int, compute) -> DataFrame:
        if (kind, k) not in self._tables:
            self._tables[kind, k] = compute(k)
        table = self._tables[kind, k]
        return F.broadcast(table) if self.is_small(prefix) else table

    def _stored(self, k: int) -> DataFrame:
        """Stored choices of one level; their table is opened when first needed."""
        if "choices" not in self._opened:
            keys = [StructField(f"key_{i}", self.schema[c].dataType) for i, c in enumerate(self.levels, 1)]
            schema = StructType([*keys, *StructType.fromDDL("position int, level int")])
            reader = self.combinations.sparkSession.read.schema(schema)
            self._opened["choices"] = reader.parquet(f"{self.stored_at}/choices")
        return self._opened["choices"].filter(f"level = {k}").select(*self.keys(k), "position")

    def _compute_node(self, k: int) -> DataFrame:
        values = [quoted(c) for c in self.levels]
        named = [f"{v} AS {'key' if i <= k else 'first'}_{i}" for i, v in enumerate(values, 1)]
        below = [f"__n_{j} AS n_{j}" for j in range(k + 1, self.depth + 1)]
        return self.combinations.filter(self._in_node(k)).selectExpr(*named, *below)

    def _compute_choices(self, k: int) -> DataFrame:
        if self.stored_at:
            return self._stored(k)
        *above, level = self.keys(k)
        largest = 0
        if self.measures[k - 1] > self.group_limit:
            largest = self.combinations.selectExpr(f"coalesce(max(__n_{k}), 0)").first()[0] if k > 1 else self.measures[0]
        choices = self._compute_node(k).select(*above, level)
        return positions_in_group(choices, above, level, "position", largest, self.group_limit)


def build_index(
    df: DataFrame,
    levels: Sequence[str],
    group_limit: int = GROUP_LIMIT,
    one_task_rows: int = ONE_TASK_ROWS,
    broadcast_bytes: int | None = None,
) -> LevelIndex:
    """Index a table on an ordered list of level columns.

    The table is read once, for its level columns only, and its rows are counted
    per combination, partly before the shuffle. Values below a null cannot be
    reached and become null. The combinations are computed here and kept as files in
    the shared folder, where a lost executor does not matter and no other call finds
    them, and their nodes are measured, so that a lookup is broadcast only if it is
    small. Every call reads the table as it is then: to share an index pass it on,
    and ``unpersist`` it in the end.

    Up to ``one_task_rows`` combinations are sorted by one task, more are dealt by their top value or, if
    some top value has many of them, sorted in slices; the result is the same.
    Choices are ranked by a window, or in slices where one combination has more
    than ``group_limit`` of them. A lookup of up to ``broadcast_bytes`` (32 MB) is broadcast.
    """
    levels = tuple(levels)
    _check_levels(df, levels)
    return _indexed(_counted(df, levels), levels, group_limit, one_task_rows, broadcast_bytes)


def refresh_index(
    index: LevelIndex, added: DataFrame | None = None, removed: DataFrame | None = None, one_task_rows: int = ONE_TASK_ROWS
) -> LevelIndex:
    """The index of the table after rows were added and removed, from these rows and the index alone.

    The rows are counted per combination, removed ones as less than nothing, and the counts are merged with those of
    the index; a combination that has no rows left goes. The result is what ``build_index`` gives for the whole table.
    Rows removed that the index never counted are an error.
    """
    names = [quoted(c) for c in index.levels]
    deltas = [(df, sign) for df, sign in ((added, ""), (removed, "-")) if df is not None]
    counts = [index.combinations.select(*names, "n_rows")]
    for df, sign in deltas:
        _check_levels(df, index.levels)
        counts.append(_counted(df, index.levels).selectExpr(*names, f"{sign}n_rows AS n_rows"))
    merged = reduce(DataFrame.unionByName, counts).groupBy(*names).agg(F.sum("n_rows").alias("n_rows"))
    merged, folder = stored(merged.filter("n_rows <> 0"))
    try:
        short = merged.filter("n_rows < 0").selectExpr("count(*)", "-sum(n_rows)").first()
        if short[0]:
            raise ValueError(f"{short[1]} rows are to be removed that the index does not hold, in {short[0]} combinations")
        return _indexed(merged, index.levels, index.group_limit, one_task_rows, index._broadcast_bytes)
    finally:
        remove_folder(merged.sparkSession, folder)


def _counted(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rows per combination; values below a null are null."""
    names = [quoted(c) for c in levels]
    reachable = [names[0]]
    for k, name in enumerate(names[1:], 1):
        above = " AND ".join(f"{c} IS NOT NULL" for c in names[:k])
        reachable.append(f"CASE WHEN {above} THEN {name} END AS {name}")
    return df.selectExpr(*reachable).groupBy(*names).agg(F.count("*").alias("n_rows"))


def _indexed(
    counted: DataFrame, levels: Sequence[str], group_limit: int, one_task_rows: int, broadcast_bytes: int | None
) -> LevelIndex:
    spark, names = counted.sparkSession, [quoted(c) for c in levels]
    counted, folder = stored(counted)
    n_rows, largest = _top_sizes(counted, names[0])
    folders = []
    if n_rows <= one_task_rows:
        compared = _compared_in_one(counted, names)
    elif is_spread(n_rows, largest, n_slices := _n_slices(spark, n_rows)):
        compared = _compared_by_top(counted, names, n_slices)
    else:
        compared, folders = _compared_in_slices(counted, names, n_rows)
    combinations, kept = stored(compared)
    for used in [folder, *folders]:
        remove_folder(spark, used)
    index = LevelIndex(levels, combinations, group_limit=group_limit, folders=[kept], broadcast_bytes=broadcast_bytes)
    index.measures  # noqa: B018 - measured once, here
    index.top_sizes = (n_rows, largest)
    return index


def _top_sizes(df: DataFrame, top: str) -> tuple[int, int]:
    """Rows, and rows of the most frequent top value."""
    counts = df.groupBy(top).count()
    return tuple(counts.selectExpr("coalesce(sum(count), 0)", "coalesce(max(count), 0)").first())


def _n_slices(spark: SparkSession, n_rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SLICE_ROWS))


def is_spread(n_rows: int, largest: int, parts: int) -> bool:
    """Whether rows dealt into so many parts by their top value come in parts of about equal size."""
    return 2 * largest * parts <= n_rows


def _by_top(df: DataFrame, names: Sequence[str], parts: int) -> DataFrame:
    """Dealt by top value, with a column per level that sorts nulls last: all windows below share one sort."""
    flags = {f"__z_{i}": F.col(c).isNull() for i, c in enumerate(names, 1)}
    return df.repartition(parts, names[0]).withColumns(flags)


def _sorted_columns(names: Sequence[str]) -> list[str]:
    return [x for i, c in enumerate(names, 1) for x in (f"__z_{i}", c)]


def _compared_by_top(counted: DataFrame, names: Sequence[str], parts: int) -> DataFrame:
    """The same as ``_compared_in_one`` for many combinations, of which no top value has many.

    The first combination of a top value is fresh at the top, so top values need not be compared with one another.
    """
    each = _sorted_columns(names)
    in_order = Window.partitionBy(*each[:2]).orderBy(*each[2:] or each)
    compared = _by_top(counted, names, parts).withColumn("before", F.lag(F.struct(*names)).over(in_order))
    fresh = f"CASE WHEN before IS NULL THEN 1 ELSE {_fresh(names)} END AS fresh"
    compared = compared.selectExpr(*each, "n_rows", fresh)
    for j in _below(names):
        number = F.sum(_new_choice(names, j)).over(Window.partitionBy(*each[: 2 * j]))
        compared = compared.withColumn(f"__n_{j + 1}", F.when(F.col("fresh") <= j, number))
    return compared.select(*names, *OWN_COLUMNS, *[f"__n_{j + 1}" for j in range(1, len(names))])


def _choices_by_top(index: LevelIndex, parts: int) -> DataFrame:
    """Choices of all levels below the top, as ``LevelIndex.choices`` has them, with their level; from one sort."""
    names = [quoted(c) for c in index.levels]
    each = _sorted_columns(names)
    ranked = _by_top(index.combinations.select(*names, "fresh"), names, parts)
    cells = []
    for j in _below(names):
        up_to = Window.partitionBy(*each[: 2 * j]).orderBy(*each[2 * j :]).rowsBetween(Window.unboundedPreceding, 0)
        ranked = ranked.withColumn(f"__r_{j + 1}", F.sum(_new_choice(names, j)).over(up_to))
        keys = [f"{c if i <= j else 'NULL'} AS key_{i + 1}" for i, c in enumerate(names)]
        cell = ", ".join([*keys, f"CAST(__r_{j + 1} AS INT) AS position", f"{j + 1} AS level"])
        cells.append(f"CASE WHEN {index._in_node(j + 1)} THEN struct({cell}) END")
    return ranked.selectExpr(f"inline(filter(array({', '.join(cells)}), cell -> cell IS NOT NULL))")


def _compared_in_one(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Combinations with the level at which each is fresh, sorted in one task: only for a few."""
    in_order = Window.orderBy(*_order(names))
    compared = counted.withColumn("before", F.lag(F.struct(*names)).over(in_order))
    compared = compared.selectExpr(*names, "n_rows", f"CASE WHEN before IS NULL THEN 1 ELSE {_fresh(names)} END AS fresh")
    for j in _below(names):
        number = F.sum(_new_choice(names, j)).over(Window.partitionBy(*names[:j]))
        compared = compared.withColumn(f"__n_{j + 1}", F.when(F.col("fresh") <= j, number))
    return compared.select(*names, *OWN_COLUMNS, *[f"__n_{j + 1}" for j in range(1, len(names))])


def _below(names: Sequence[str]) -> range:
    """Lengths of the prefixes that have choices below, longest first: each sort serves the shorter ones."""
    return range(len(names) - 1, 0, -1)


def _new_choice(names: Sequence[str], j: int) -> Column:
    """1 for a combination that is the first with its value under its first ``j`` values."""
    return F.expr(f"CAST(coalesce(fresh <= {j + 1}, false) AND {names[j]} IS NOT NULL AS BIGINT)")


def _compared_in_slices(counted: DataFrame, names: Sequence[str], n_rows: int) -> tuple[DataFrame, list[str]]:
    """The same for many combinations, sorted in slices.

    The slices come from range partitioning on all levels, so a frequent value
    is cut into several of them. Each combination is compared with the one before
    it in its slice; the first of a slice, with the last before it. Choices are counted in
    each slice, and a prefix that goes on in the next slices gets what is counted there: that takes one row per
    slice, of a million combinations or so, on the driver. Where the
    slices begin depends on a sample, so they are stored before they are
    used more than once.
    """
    spark = counted.sparkSession
    order = _order(names)
    n_slices = _n_slices(spark, n_rows)
    in_order = Window.partitionBy("slice").orderBy(*order)
    sliced = (
        counted.repartitionByRange(n_slices, *order)
        .withColumn("slice", F.spark_partition_id())
        .withColumn("before", F.lag(F.struct(*names)).over(in_order))
        .withColumn("last", F.lead("slice").over(in_order).isNull())
        .selectExpr(*names, "n_rows", "slice", "last", f"CASE WHEN before IS NOT NULL THEN {_fresh(names)} END AS fresh")
    )
    for j in _below(names):
        group = Window.partitionBy("slice", *names[:j])
        sliced = sliced.withColumns(
            {f"__p_{j}": F.sum(_new_choice(names, j)).over(group), f"__t_{j}": F.max("last").over(group)}
        )
    sliced, folder = stored(sliced)
    # one row per slice that is not empty
    lasts = sliced.filter("last").select(
        F.lead("slice").over(Window.orderBy("slice")).alias("slice"), F.struct(*names).alias("before")
    )
    firsts = sliced.filter("fresh IS NULL").drop("fresh").join(lasts, "slice", "left")
    each = range(1, len(names))
    told = firsts.selectExpr(
        "slice",
        f"CASE WHEN before IS NULL THEN 1 ELSE {_fresh(names)} END AS fresh",
        *[f"{names[j]} IS NOT NULL AS set_{j}" for j in each],
        *[f"__p_{j}" for j in each],
        *[f"__t_{j}" for j in each],
    )
    heads = sorted(told.collect(), key=lambda head: head["slice"])
    added = [[0] * len(names) for _ in heads]
    for j in each:
        owner = 0
        for i, head in enumerate(heads):
            goes_on = head["fresh"] > j
            if goes_on:
                added[owner][j] += head[f"__p_{j}"] + (head["fresh"] <= j + 1 and head[f"set_{j}"])
            if not (goes_on and head[f"__t_{j}"]):
                owner = i
    rows = [(head["slice"], head["fresh"], *more[1:]) for head, more in zip(heads, added)]
    ddl = "slice int, first int" + "".join(f", __a_{j} bigint" for j in each)
    joined = sliced.join(F.broadcast(spark.createDataFrame(rows, ddl)), "slice")
    numbers = [
        f"CASE WHEN coalesce(fresh, first) <= {j} THEN __p_{j}"
        f" + CAST(fresh IS NULL AND first <= {j + 1} AND {names[j]} IS NOT NULL AS BIGINT)"
        f" + CASE WHEN __t_{j} THEN __a_{j} ELSE 0 END END AS __n_{j + 1}"
        for j in each
    ]
    return joined.selectExpr(*names, "n_rows", "coalesce(fresh, first) AS fresh", *numbers), [folder]


def _order(names: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in names]


def _fresh(names: Sequence[str]) -> str:
    """Number of the first level that differs from ``before``."""
    tests = " ".join(f"WHEN NOT ({c} <=> before.{c}) THEN {k}" for k, c in enumerate(names, 1))
    return f"CASE {tests} END"


def _check_levels(df: DataFrame, levels: tuple[str, ...]) -> None:
    if not levels:
        raise ValueError("at least one level is needed")
    if len(set(levels)) < len(levels):
        raise ValueError("a level is named twice")
    for c in levels:
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
        if c in [*OWN_COLUMNS, "slice", "last", "before"] or c.startswith("__"):
            raise ValueError(f"{c!r} is a name the index uses itself: rename the column")


def write_index(index: LevelIndex, path: str) -> None:
    """Store an index, so that later jobs and streams only read it.

    The index at ``path`` is replaced as a whole: who opens it meanwhile, or after a write that failed, finds the old one,
    and who has opened it can go on with it while one more is written.

    Combinations are laid out by the level at which they are fresh: the lookup
    of a level reads only the folders of that level and those above it, and
    files are in order, so the lookup of a few values reads few row groups.
    Choices are laid out by level. A node too large to be broadcast is also stored in buckets of
    its keys, evenly, since each key stands in it once. The schema is stored along, so an empty index
    opens too.
    """
    publish(index.combinations.sparkSession, path, lambda folder: _write_version(index, folder))


def _write_version(index: LevelIndex, folder: str) -> None:
    spark = index.combinations.sparkSession
    n_rows, largest = index.top_sizes
    if n_rows <= ONE_TASK_ROWS:
        write_table(index.combinations, f"{folder}/combinations", ["fresh"], sort_by=index.levels, versioned=False)
    else:  # a file per task and folder is no small one then, so nothing is shuffled
        in_order = index.combinations.sortWithinPartitions("fresh", *_order([quoted(c) for c in index.levels]))
        in_order.write.partitionBy("fresh").parquet(f"{folder}/combinations")
    buckets = {}
    for k in range(1, index.depth + 1):
        if not index.is_small(k) and not any("collate" in f.dataType.simpleString() for f in index.schema):
            size = index.measures[index.depth + k - 1] + 32 * index.measures[k - 1]
            buckets[k] = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
            keys, name = index.keys(k), _bucket_table(folder, k)
            spread = index._compute_node(k).repartition(buckets[k], *keys).write.format("parquet")
            spread.option("path", f"{folder}/node_{k}").bucketBy(buckets[k], *keys).sortBy(*keys).saveAsTable(name)
            spark.sql(f"DROP TABLE {name}")  # the files stay
    own = [*OWN_COLUMNS, *[f"__n_{j}" for j in range(2, index.depth + 1)]]
    schema = index.combinations.select(*map(quoted, index.levels), *own).schema.json()
    about = json.dumps({"schema": json.loads(schema), "buckets": buckets})
    write_table(index.measure().withColumn("about", F.lit(about)), f"{folder}/measures", versioned=False)
    if index.depth == 1:
        return
    parts = _n_slices(spark, n_rows)
    if n_rows > ONE_TASK_ROWS and is_spread(n_rows, largest, parts):
        _choices_by_top(index, parts).write.partitionBy("level").parquet(f"{folder}/choices")
        return
    tables = [index.choices(k).withColumn("level", F.lit(k)) for k in range(2, index.depth + 1)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    write_table(stacked, f"{folder}/choices", ["level"], versioned=False)


def _bucket_table(folder: str, k: int) -> str:
    return f"stepwell_{hashlib.md5(folder.encode()).hexdigest()}_{k}"


def read_index(spark: SparkSession, path: str, broadcast_bytes: int | None = None) -> LevelIndex:
    """Open a stored index. A lookup of up to ``broadcast_bytes`` (32 MB) is broadcast.

    Nodes in buckets get a name in the session's catalog, since only tables there have buckets; ``unpersist`` drops it.
    """
    folder = current(spark, path)
    *measures, about = spark.read.parquet(f"{folder}/measures").first()
    about = json.loads(about)
    combinations = spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{folder}/combinations")
    levels = [c for c in combinations.columns if c not in OWN_COLUMNS and not c.startswith("__n_")]
    index = LevelIndex(levels, combinations, measures=measures, path=folder, broadcast_bytes=broadcast_bytes)
    for k, n in ((int(k), n) for k, n in about["buckets"].items()):
        name, keys = _bucket_table(folder, k), ", ".join(index.keys(k))
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index._compute_node(k).schema)
        place = f"{folder}/node_{k}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
            f" CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {n} BUCKETS LOCATION '{place}'"
        )
        index.buckets[k] = name
    return index


def update_index(
    spark: SparkSession,
    path: str,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    broadcast_bytes: int | None = None,
) -> None:
    """``refresh_index`` of a stored index, in its place; the table is not read."""
    index = read_index(spark, path, broadcast_bytes)
    fresh = refresh_index(index, added, removed)
    write_index(fresh, path)
    fresh.unpersist()
    index.unpersist()


def as_index(source: DataFrame | LevelIndex, levels: Sequence[str] | None = None) -> LevelIndex:
    """Take a ready index as it is; build one for a table."""
    if isinstance(source, LevelIndex):
        if levels is not None and tuple(levels) != source.levels:
            raise ValueError(f"the index has levels {source.levels}, not {tuple(levels)}")
        return source
    if levels is None:
        raise ValueError("levels are needed for a table that is not an index")
    return build_index(source, levels)
