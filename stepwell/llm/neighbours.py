"""Approximate nearest neighbours: NN-descent graph and greedy graph search.

Rows with equal vectors are one node, so a vector that a third of the rows share is
searched once. The graph starts from windows of a few orders along random projections and is improved by NN-descent:
each round joins every node's neighbours (either direction) with one another, as far as one of the two is new to the node, and
keeps the best per node. Rounds go on until few edges change. A
node that many others point to is salted into several local joins. A query walks the graph
greedily: the best nodes found so far are expanded until none is left to expand.

Graph work uses half-precision unit vectors; the scores returned are cosines of the
original vectors in double precision. A vector shorter than others counts as filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.common import Stored, column

#: Neighbours kept per node.
DEGREE = 32
#: Orders of the first graph, and rows compared with each other along an order.
ORDERS, WINDOW = 4, 256
#: The graph is done when a round has replaced at most this share of its edges.
CHANGED = 0.1
#: Members of one local join, and new partners a member gets from it.
JOIN_SIZE, JOIN_KEEP = 64, 6
#: Nodes remembered per query and expanded per step; entry points.
BEAM, EXPAND, ENTRIES = 256, 64, 16

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float32())])
_EDGE_DDL = "a bigint, b bigint, sim float"


def _matrix(vectors: pa.Array, kind: str) -> np.ndarray:
    parts = [x.as_py() for x in vectors]
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1).astype(np.float32) if parts else np.zeros((0, 0))


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float32())], schema=_EDGE)


def _best(ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of a similarity matrix its best other columns: (row ids, column ids, similarities)."""
    keep = min(keep, len(ids) - 1)
    np.fill_diagonal(sims, -2)
    top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    return np.repeat(ids, keep), ids[top].ravel(), np.take_along_axis(sims, top, 1).ravel()


def prepare(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows that take part: vec_id, v (array of double), with equal vectors under one node.

    ``node`` is the smallest vec_id of equal vectors and ``place`` a row's rank among them.
    """
    v = column(vector).cast("array<double>")
    usable = rows.select(column(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    usable = usable.dropDuplicates(["vec_id", "v"])
    same = Window.partitionBy("v")
    return usable.select("vec_id", "v", F.row_number().over(same.orderBy("vec_id")).alias("place"))


def _unit(nodes: DataFrame, dim: int) -> DataFrame:
    """node, half-precision unit vector of ``dim`` components, and a sort key for each order."""
    schema = pa.schema([("node", pa.int64()), ("unit", pa.binary()), *[(f"o{i}", pa.float64()) for i in range(ORDERS)]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            cuts = np.split(flat, np.cumsum(sizes)[:-1])
            x = np.zeros((len(cuts), dim))
            for i, c in enumerate(cuts):
                x[i, : len(c)] = c
            x = x / np.abs(x).max(1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            keys = []
            for order in range(ORDERS):
                # signs along random directions, refined by a last projection
                axes = np.random.default_rng(order).normal(size=(dim, 11)).astype(np.float32)
                p = x @ axes
                keys.append((p[:, :10] > 0) @ (1 << np.arange(10)) + (np.tanh(p[:, 10]) + 1) / 2.001)
            units = [u.tobytes() for u in x.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(units, pa.binary()), *map(pa.array, keys)], schema=schema)

    return nodes.mapInArrow(work, "node bigint, unit binary, " + ", ".join(f"o{i} double" for i in range(ORDERS)))


def _in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best partners within windows of consecutive rows, each overlapping the next by half."""
    held: list[pa.RecordBatch] = []
    size = 0

    def compare(t: pa.Table) -> pa.RecordBatch:
        ids, x = t["node"].to_numpy(), _matrix(t["unit"].combine_chunks(), "<f2")
        return _edges(*_best(ids, x @ x.T, DEGREE // 2))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        while size >= WINDOW:
            t = pa.Table.from_batches(held).combine_chunks()
            yield compare(t.slice(0, WINDOW))
            rest = t.slice(WINDOW // 2)
            held, size = rest.to_batches(), rest.num_rows
    if size > 1:
        yield compare(pa.Table.from_batches(held).combine_chunks())


def _local_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partners that are better than the worst neighbour a member has, among members of one centre, one of them new to it."""

    def join(ids: np.ndarray, worst: np.ndarray, fresh: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        sims = x @ x.T
        sims[np.ix_(~fresh, ~fresh)] = -2  # these have met here before
        a, b, sim = _best(ids, sims, JOIN_KEEP)
        better = (sim > np.repeat(worst, len(a) // len(ids))) & (a != b)
        return _edges(a[better], b[better], sim[better])

    # rows are sorted by centre, so only the last centre of a batch may go on in the next
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        yield from _of_centres(t, join, last=False)
        ends = _starts(t)
        held = t.slice(int(ends[-1])) if len(ends) else None
    if held is not None:
        yield from _of_centres(held, join, last=True)


def _starts(t: pa.Table) -> np.ndarray:
    c, s = t["centre"].to_numpy(), t["salt"].to_numpy()
    return np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])]) if len(c) else np.zeros(0, int)


def _of_centres(t: pa.Table, join, last: bool) -> Iterator[pa.RecordBatch]:
    starts = _starts(t)
    ends = np.r_[starts[1:], t.num_rows]
    if not last:
        starts, ends = starts[:-1], ends[:-1]
    if not len(starts):
        return
    ids, worst, fresh = t["node"].to_numpy(), t["worst"].to_numpy(), t["fresh"].to_numpy()
    x = _matrix(t["unit"].combine_chunks(), "<f2")
    out = []
    for i, j in zip(starts, ends):
        for k in range(i, j, JOIN_SIZE):  # salts keep groups about this size
            own = slice(k, min(j, k + JOIN_SIZE))
            if own.stop - k > 1 and fresh[own].any():
                out.append(join(ids[own], worst[own], fresh[own], x[own]))
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def _nearest(edges: DataFrame, keep: int, by: str = "a", other: str = "b") -> DataFrame:
    """The best edges of each node; an edge met again is not fresh."""
    order = Window.partitionBy(by).orderBy(F.desc("sim"), other)
    single = edges.groupBy(by, other).agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return single.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep).drop("_r")


def build_graph(units: DataFrame, store: Stored, changed: float = CHANGED) -> DataFrame:
    """Edges (a, b, sim, fresh) to the nearest nodes found for every node."""
    first = None
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for order in range(ORDERS):
        sorted_rows = units.select("node", "unit", F.col(f"o{order}").alias("o")).repartitionByRange(parts, "o", "node")
        found = sorted_rows.sortWithinPartitions("o", "node").select("node", "unit").mapInArrow(_in_windows, _EDGE_DDL)
        first = found if first is None else first.unionByName(found)
    edges = store.keep(_nearest(first.withColumn("fresh", F.lit(True)), DEGREE))
    # every round but the last replaces edges by better ones, so the rounds end
    while True:
        total, new = edges.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if new <= changed * total:
            return edges
        pointed = edges.groupBy(F.col("b").alias("centre")).agg(F.count(F.lit(1)).alias("n"))
        reverse = (
            edges.select(F.col("b").alias("centre"), F.col("a").alias("node"), "fresh")
            .join(pointed, "centre")
            .select("centre", "node", F.expr(f"pmod(xxhash64(node), 1 + n div {JOIN_SIZE // 2})").alias("salt"), "fresh")
        )
        # forward neighbours meet the first part of the reverse ones
        forward = edges.select(
            F.col("a").alias("centre"), F.col("b").alias("node"), F.lit(0).cast("bigint").alias("salt"), "fresh"
        )
        worst = edges.groupBy(F.col("a").alias("node")).agg(
            F.when(F.count(F.lit(1)) >= DEGREE, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst")
        )
        members = reverse.union(forward).groupBy("centre", "node").agg(F.min("salt").alias("salt"), F.max("fresh").alias("fresh"))
        joined = (
            members.join(worst, "node")
            .join(units.select("node", "unit"), "node")
            .select("centre", "salt", "node", "worst", "fresh", "unit")
            .repartition(parts, "centre", "salt")
            .sortWithinPartitions("centre", "salt", "node")
            .mapInArrow(_local_joins, _EDGE_DDL)
        )
        old = edges.withColumn("fresh", F.lit(False))
        better = store.keep(_nearest(old.unionByName(joined.withColumn("fresh", F.lit(True))), DEGREE))
        store.drop(edges)
        edges = better


def search(queries: DataFrame, edges: DataFrame, units: DataFrame, store: Stored, beam: int = BEAM) -> DataFrame:
    """Nodes found near each query (query, node): queries are nodes, given as one column ``query``."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "fresh")
    # one row per node: a step reads as many rows as there are nodes
    graph = _nearest(edges.unionByName(back), 2 * DEGREE).groupBy(F.col("a").alias("node"))
    graph = store.keep(graph.agg(F.collect_list("b").alias("near")))
    entries = [r["node"] for r in units.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    start = queries.select("query", F.explode(F.array(F.col("query"), *map(F.lit, entries))).alias("node")).distinct()
    vectors = units.select("node", "unit")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = _matrix(batch.column(2), "<f2"), _matrix(batch.column(3), "<f2")
            sim = np.einsum("ij,ij->i", p, q) if len(p) else np.zeros(0)
            yield _edges(batch.column(0).to_numpy(), batch.column(1).to_numpy(), sim)

    def rated(pairs: DataFrame) -> DataFrame:
        own = vectors.select(F.col("node").alias("query"), F.col("unit").alias("own"))
        both = pairs.join(vectors, "node").join(own, "query").select("query", "node", "unit", "own")
        return both.mapInArrow(rate, _EDGE_DDL).select(F.col("a").alias("query"), F.col("b").alias("node"), "sim")

    state = store.keep(rated(start).withColumn("done", F.lit(False)))
    ranked = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    # a node is expanded once: what has left the beam comes in again only behind it
    while True:
        open_nodes = state.filter(~F.col("done")).withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= EXPAND)
        open_nodes = store.keep(open_nodes.select("query", "node"))
        if open_nodes.isEmpty():
            break
        reached = (
            open_nodes.join(graph, "node")
            .select("query", F.explode("near").alias("node"))
            .distinct()
            .join(state.select("query", "node"), ["query", "node"], "left_anti")
        )
        marked = (
            state.join(open_nodes.withColumn("_now", F.lit(True)), ["query", "node"], "left")
            .select("query", "node", "sim", (F.col("done") | F.coalesce("_now", F.lit(False))).alias("done"))
        )
        every = marked.unionByName(rated(reached).withColumn("done", F.lit(False)))
        new = store.keep(every.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= beam).drop("_r"))
        store.drop(state, open_nodes)
        state = new
    return state.select("query", "node")


def nearest(
    rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", beam: int = BEAM
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row that ``is_query`` (a condition on vec_id).

    ``beam`` is the number of nodes a search remembers. Rows whose vector is null, zero or holds a null or non-finite component take no part.
    A shorter vector counts as filled up with zeros. Repeated rows count once. Equal vectors are found together and listed by id. With
    fewer candidates than ``k`` all found are listed; no rows or queries give no rows.
    """
    store = Stored(rows.sparkSession)
    placed = prepare(rows, vec_id, vector)
    # of equal vectors only the first few ids can appear in a result
    members = store.keep(placed.filter(F.col("place") <= k + 1))
    nodes = members.filter(F.col("place") == 1).select(F.col("vec_id").alias("node"), "v")
    dim = members.agg(F.max(F.size("v"))).first()[0] or 0
    units = store.keep(_unit(nodes, dim))
    edges = build_graph(units, store)
    of_node = members.join(nodes.select("node", "v"), "v").select("node", "vec_id", "v")
    asked = rows.select(column(vec_id).cast("bigint").alias("query_id"), column(vector).cast("array<double>").alias("v"))
    asked = store.keep(
        asked.filter(is_query(F.col("query_id"))).dropDuplicates(["query_id", "v"]).join(nodes, "v").select("query_id", "node", "v")
    )
    found = search(asked.select(F.col("node").alias("query")).distinct(), edges, units, store, beam)
    # nodes found near a query's node, and that node itself, with the rows they stand for
    pairs = asked.select("query_id", F.col("node").alias("query"), F.col("v").alias("own")).join(found, "query")
    pairs = pairs.join(of_node, "node").filter(F.col("vec_id") != F.col("query_id")).select("query_id", "own", "vec_id", "v")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for p, q in zip(batch.column(1), batch.column(3)):
                x, y = p.values.to_numpy(), q.values.to_numpy()
                n = min(len(x), len(y))
                scores.append(float(x[:n] @ y[:n]) / float(np.sqrt(x @ x) * np.sqrt(y @ y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], schema=schema)

    scored = pairs.mapInArrow(cosine, "query_id bigint, vec_id bigint, score double")
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
