"""The cascade: settle a selection level by level, from the top down."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.functions import append_entry, join_lines, update_message
from stepwell.functions.names import column, quoted
from stepwell.plans.index import LevelIndex, as_index
from stepwell.session import stored


#: So many different top values of requests are looked up by a filter on the index.
FEW_VALUES = 1_000
#: So many requests are hashed, for a join with a node in buckets, rather than the node sorted.
HASHED_REQUESTS = 100_000


def resolve_selection(
    requests: DataFrame,
    source: DataFrame | LevelIndex,
    levels: Sequence[str] | None = None,
    changed_level: str | int = 1,
    test_from: Mapping[str, str] | None = None,
    on_missing: str = "first",
) -> DataFrame:
    """Settle every request, with one refresh per level below the changed one.

    A value that is among the choices under the settled values above it is kept,
    any other is replaced by the first of those choices, or by null if there are
    none. Levels down to ``changed_level`` are taken as given.

    ``test_from`` maps a level to the level whose value is tested, and kept, in
    its place. ``on_missing="skip"`` leaves a level without a value unset, so
    that the levels below it have no choices; ``"first"`` gives it the first one.

    ``requests`` may be a stream: each request carries its whole selection.
    """
    index = as_index(source, levels)
    start = index.number_of(changed_level)
    settled = _descend(requests, index, start, index.depth, test_from, on_missing)
    return settled.select(*map(quoted, requests.columns))


def keep_or_first(
    requests: DataFrame,
    source: DataFrame | LevelIndex,
    level: str | int,
    levels: Sequence[str] | None = None,
    test_from: Mapping[str, str] | None = None,
    on_missing: str = "first",
) -> DataFrame:
    """Settle one level of every request under the values it holds above that level."""
    index = as_index(source, levels)
    k = index.number_of(level)
    if k == 1:
        raise ValueError("the top level has no choices above it to settle under")
    return _descend(requests, index, k - 1, k, test_from, on_missing).select(*map(quoted, requests.columns))


def cascade_trace(
    requests: DataFrame,
    source: DataFrame | LevelIndex,
    levels: Sequence[str] | None = None,
    changed_level: str | int = 1,
    test_from: Mapping[str, str] | None = None,
    on_missing: str = "first",
    request_id: str = "request_id",
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per refreshed level: where the refresh came from and what it did.

    Every level is refreshed once, in order, so the step numbers and the level a
    step came from follow from the level alone and need no window over requests.
    """
    index = as_index(source, levels)
    start = index.number_of(changed_level)
    settled = _descend(requests, index, start, index.depth, test_from, on_missing, traced=True)
    steps = []
    came_from = "start"
    for step, k in enumerate(range(start + 1, index.depth + 1), 1):
        level = index.levels[k - 1]
        shown = (labels or {}).get(level, level)
        steps.append(
            F.struct(
                F.lit(step),
                F.lit(shown),
                F.lit(came_from),
                F.expr(f"CAST(__old_{k} AS STRING)"),
                F.expr(f"CAST({quoted(level)} AS STRING)"),
                F.expr(f"coalesce(__choices_{k}, 0L)"),
                F.col(f"__kept_{k}").alias("kept"),
            )
        )
        came_from = shown
    schema = (
        "array<struct<step:int,level:string,came_from:string,old_value:string,"
        "new_value:string,n_choices:bigint,kept:boolean>>"
    )
    return settled.select(column(request_id), F.inline(F.array(*steps).cast(schema)))


def trace_text(trace: DataFrame, request_id: str = "request_id") -> DataFrame:
    """The order of events of each request as one text.

    Steps are collected as a set, so even a request id that many rows share
    never holds more entries than there are levels.
    """
    in_order = F.sort_array(F.collect_set(F.struct("step", "level")))
    lines = F.transform(in_order, lambda e: F.concat(F.lit("Update "), e["level"]))
    head = append_entry(F.array(F.lit("Order of events")), F.lit("Update start"))
    return trace.groupBy(column(request_id)).agg(join_lines(F.concat(head, lines)).alias("text"))


def trace_messages(trace: DataFrame, prefix: str = "", request_id: str = "request_id") -> DataFrame:
    """The log line of each step; ``prefix`` goes before the level's label."""
    level = F.concat(F.lit(prefix), F.col("level"))
    return trace.select(column(request_id), "step", update_message(level, F.col("came_from")).alias("message"))


def check_selection(
    requests: DataFrame,
    source: DataFrame | LevelIndex,
    levels: Sequence[str] | None = None,
    request_id: str = "request_id",
) -> DataFrame:
    """First level of each request that is not valid under the values above it, else null."""
    index = as_index(source, levels)
    _check_types(requests, index)
    node_of, hashed = _lookup(requests, index, 1)
    found = requests
    for k in range(1, index.depth + 1):
        known = node_of(k).selectExpr(*_keys(k, f"__key{k}"), f"TRUE AS __found_{k}")
        found = hashed(found).join(known, _match(map(quoted, index.levels[:k]), f"__key{k}"), "left")
    invalid = ", ".join(f"CASE WHEN __found_{k} IS NULL THEN {k} END" for k in range(1, index.depth + 1))
    return found.selectExpr(quoted(request_id), f"CAST(coalesce({invalid}, NULL) AS INT) AS first_invalid_level")


def default_selection(spark: SparkSession, picks: Mapping[str, Any], request_id: int = 1) -> DataFrame:
    """A one-row request from a pick per level. Pass it through ``resolve_selection``.

    A pick is a value, or a Column where its type needs a cast.
    """
    columns = [F.lit(value).alias(level) for level, value in picks.items()]
    return spark.range(1).select(F.lit(request_id).cast("bigint").alias("request_id"), *columns)


def _descend(
    requests: DataFrame,
    index: LevelIndex,
    start: int,
    stop: int,
    test_from: Mapping[str, str] | None,
    on_missing: str,
    traced: bool = False,
) -> DataFrame:
    """Settle the levels ``start + 1 .. stop``.

    The request carries the first path below its settled values. At each level
    one lookup of the tested value either finds it, and brings the path below
    it, or does not: then the value comes from the carried path, whose rest
    is still the right one, and so are the numbers of choices along it. ``traced`` adds ``__old_k``, ``__kept_k`` and
    ``__choices_k``.
    """
    if on_missing not in ("first", "skip"):
        raise ValueError(f"on_missing is 'first' or 'skip', not {on_missing!r}")
    _check_types(requests, index)
    test_from = dict(test_from or {})
    unknown = (set(test_from) | set(test_from.values())) - set(index.levels)
    if unknown:
        raise ValueError(f"not a level: {sorted(unknown)}")

    node_of, hashed = _lookup(requests, index, start)
    path = index.path(start) + (index.numbers(start) if traced else [])
    top = node_of(start).selectExpr(*_keys(start, "__top"), *[f"{c} AS __{c}" for c in path])
    state = hashed(requests).join(top, _match(map(quoted, index.levels[:start]), "__top"), "left")
    columns = {c: quoted(c) for c in requests.columns}
    trace: list[str] = []
    for k in range(start + 1, stop + 1):
        above, level = [quoted(c) for c in index.levels[: k - 1]], index.levels[k - 1]
        source = test_from.get(level, level)
        tested = quoted(source)
        if requests.schema[source].dataType != index.schema[level].dataType:
            tested = f"try_cast({tested} AS {index.schema[level].dataType.simpleString()})"
        path = index.path(k) + (index.numbers(k) if traced else [])
        node = node_of(k).selectExpr(*_keys(k), *[f"{c} AS __hit_{c}" for c in path])

        def settled(value: str, fallback: str, name: str) -> str:
            unset = f"WHEN {quoted(source)} IS NULL THEN NULL " if on_missing == "skip" else ""
            return f"CASE WHEN __key_{k} IS NOT NULL THEN {value} {unset}ELSE {fallback} END AS {name}"

        kept = columns | {level: settled(tested, f"__first_{k}", quoted(level))}
        joined = hashed(state).join(node, _match([*above, tested], "__key"), "left")
        added = []
        if traced:
            added = [f"__n_{k} AS __choices_{k}", f"{quoted(level)} AS __old_{k}", f"__key_{k} IS NOT NULL AS __kept_{k}"]
        state = joined.selectExpr(
            *kept.values(), *trace, *added, *[settled(f"__hit_{c}", f"__{c}", f"__{c}") for c in path]
        )
        if traced:
            trace += [f"__choices_{k}", f"__old_{k}", f"__kept_{k}"]
    return state


def _lookup(
    requests: DataFrame, index: LevelIndex, fixed: int
) -> tuple[Callable[[int], DataFrame], Callable[[DataFrame], DataFrame]]:
    """Nodes by level, and how requests are to be joined with them.

    The first ``fixed`` values of a request never change in the cascade, so combinations that begin otherwise match
    nothing. A large node is reduced to the top values that the requests hold, if these are few, by a filter
    that reaches the files; else to their prefixes, if these fit a broadcast, by a semi join before anything is shuffled.
    Neither is done where the requests hold most of what there is.

    A node stored in buckets stays where it is, and only the requests are shuffled, unless they are more than its rows.
    """
    large = [k for k in range(1, index.depth + 1) if not index.is_small(k)]
    if not large:
        return index.node, lambda state: state
    if requests.isStreaming:
        return index.bucketed, _hashed if index.buckets else lambda state: state
    top = index.levels[0]
    held = requests.groupBy(column(top).alias("v")).count().limit(FEW_VALUES + 1).collect()
    reduce: Callable[[DataFrame, int], DataFrame] = lambda node, k: node
    if len(held) <= FEW_VALUES:
        n_requests = sum(row["count"] for row in held)
        values = [row["v"] for row in held if row["v"] is not None]
        if 2 * len(values) <= index.measures[0]:
            reduce = lambda node, k: node.filter(F.col("key_1").isin(values))
    else:
        names = [quoted(c) for c in index.levels[:fixed]]
        prefixes, _ = stored(requests.select(*names).toDF(*index.keys(fixed)).groupBy(*index.keys(fixed)).count())
        width = " + ".join(f"coalesce(octet_length(CAST({key} AS STRING)), 0) + 24" for key in index.keys(fixed))
        n_requests, n_held, size = prefixes.selectExpr("sum(count)", "count(*)", f"sum({width})").first()
        if size <= index.broadcast_bytes and 2 * n_held <= index.measures[fixed - 1]:
            wanted = F.broadcast(prefixes.drop("count"))
            reduce = lambda node, k: node.join(wanted, index.keys(fixed), "left_semi") if k >= fixed else node

    def node_of(k: int) -> DataFrame:
        if k not in large:
            return index.node(k)
        spread = n_requests <= index.measures[k - 1]
        return reduce(index.bucketed(k) if spread else index.node(k), k)

    return node_of, _hashed if index.buckets and n_requests <= HASHED_REQUESTS else lambda state: state


def _hashed(state: DataFrame) -> DataFrame:
    return state.hint("shuffle_hash")


def _keys(k: int, name: str = "__key") -> list[str]:
    """Projection that renames the keys of a node."""
    return [f"key_{i} AS {name}_{i}" for i in range(1, k + 1)]


def _match(values: Iterable[str], name: str) -> Column:
    """Join condition between the values of a request and the renamed keys of a node."""
    return F.expr(" AND ".join(f"{value} = {name}_{i}" for i, value in enumerate(values, 1)))


def _check_types(requests: DataFrame, index: LevelIndex) -> None:
    for level in index.levels:
        if level not in requests.columns:
            raise ValueError(f"requests have no column {level!r}")
        given, wanted = requests.schema[level].dataType, index.schema[level].dataType
        if given != wanted:
            raise ValueError(
                f"column {level!r} is {given.simpleString()} in the requests, {wanted.simpleString()} in the table"
            )
