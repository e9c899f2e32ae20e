"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import Stored

#: A graph of so many links is joined up by one task; more take alternating stars.
ONE_TASK_LINKS = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first())


def components(links: DataFrame, store: Stored) -> DataFrame:
    """(node, label) of every node in ``links`` (u, v); ``label`` is the smallest node it is connected to.

    Every step halves the distance to the smallest node or better, and keeps at most one edge per edge. A node
    with very many links costs one partial minimum per task and is joined with one row.
    """
    edges = store.keep(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= ONE_TASK_LINKS:
        return edges.coalesce(1).mapInArrow(_joined_up, "node bigint, label bigint")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # larger neighbours are linked to the smallest
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # smaller neighbours, and the node itself, are linked to the smallest
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        new = store.keep(small.filter("u <> v").distinct())
        store.drop(edges)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a few links (u, v), by trees of which each root is the smallest node."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while above.setdefault(top, top) != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    columns = [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["node", "label"])


def merged(labels: DataFrame, links: DataFrame, store: Stored) -> DataFrame:
    """The components (node, label) after more links (u, v), from the components before and these links alone.

    The new links are contracted to links between labels, which are far fewer.
    """
    own = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    other = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    between = links.join(own, "u", "left").join(other, "v", "left")
    between = between.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    renamed = store.keep(components(between, store)).toDF("old", "new")
    kept = labels.join(renamed, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    added = renamed.join(labels, F.col("old") == F.col("node"), "left_anti").toDF("node", "label")
    return kept.unionByName(added)
