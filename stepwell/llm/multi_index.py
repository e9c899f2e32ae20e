"""Near-duplicate vectors by an inverted multi-index.

A unit vector is cut in two halves. Each half has a codebook of its own, and a pair of codes is a cell of the product
grid, which holds every vector. A vector walks the grid by the multi-sequence algorithm: cells come in order of a
lower bound of the distance to them, the sum of one bound per half, until the bound passes the radius at which the
target share of all neighbours is reached. What stands in the visited cells is then verified in double precision.

Each pair is met once: a vector visits only cells of a higher number than its own, and its own cell is compared
within itself. Large cells are split into blocks. A block keeps its members and streams its visitors, and answers with
a count and one edge per vector, so a cluster costs no row per pair.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from stepwell.llm.common import Stored, column
from stepwell.llm.components import components

#: Distinct vectors that the codebooks are fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
#: Codes of a half, at most. More codes make smaller cells, of which a vector visits more.
CODES = 256
#: Share of the neighbours at the threshold itself that the walk is to reach; nearer ones are reached more often.
RECALL = 0.995
#: Members of a block, and visitors compared with them at a time.
BLOCK, STREAM = 4096, 512
#: Vector lengths that get codebooks; vectors of a rarer length share one cell per length.
LENGTHS = 8


def _units(flat: np.ndarray) -> np.ndarray:
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every code."""
    out = np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ codes.T + np.einsum("ij,ij->i", codes, codes)
    return np.maximum(out, 0)


def _codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros((1, 0))
    codes = x[rng.choice(len(x), min(size, len(x)), replace=False)]
    for _ in range(10):
        near = _squares(x, codes).argmin(1)
        sums, counts = np.zeros_like(codes), np.bincount(near, minlength=len(codes))
        np.add.at(sums, near, x)
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], codes)
    return np.unique(codes, axis=0)


class Grid:
    """Codebooks of the two halves, and the radius of the walk."""

    def __init__(self, sample: np.ndarray, size: int, threshold: float, recall: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.cut = (sample.shape[1] + 1) // 2
        self.codes = [_codebook(sample[:, : self.cut], size, rng), _codebook(sample[:, self.cut :], size, rng)]
        gaps = [np.sqrt(_squares(c, c)) for c in self.codes]
        self.gaps = [np.where(g > 0, g, 1) for g in gaps]
        #: no neighbour lies in a cell of a larger bound
        self.most = 2 - 2 * threshold
        self.radius = self._calibrated(sample, threshold, recall, rng)

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half: the own code of every row, and the squared distance to the border of every other code."""
        own, out = [], []
        for half, codes, gaps in zip((x[:, : self.cut], x[:, self.cut :]), self.codes, self.gaps):
            d = _squares(half, codes)
            near = d.argmin(1)
            border = (d - d[np.arange(len(d)), near][:, None]) / (2 * gaps[near])
            own.append(near)
            out.append(np.maximum(border, 0) ** 2)
        return own, out

    def _calibrated(self, sample: np.ndarray, threshold: float, recall: float, rng: np.random.Generator) -> float:
        """Bound that ``recall`` of the neighbours at the threshold stay within, over random directions.

        A neighbour at another vector's place in the sample lies nearer and so within a smaller bound.
        """
        if recall >= 1 or sample.shape[1] < 2:
            return self.most
        x = sample[rng.choice(len(sample), 4096)]
        g = rng.normal(size=x.shape)
        g -= np.einsum("ij,ij->i", g, x)[:, None] * x
        g /= np.maximum(np.sqrt(np.einsum("ij,ij->i", g, g)), 1e-12)[:, None]
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * g
        _, bounds = self.bounds(x)
        there, _ = self.bounds(y)
        rows = np.arange(len(x))
        return float(min(self.most, np.quantile(bounds[0][rows, there[0]] + bounds[1][rows, there[1]], recall)))

    def walks(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The own cell of every row, and the cells of a higher number that its walk visits."""
        own, bounds = self.bounds(x)
        width = len(self.codes[1])
        cells = own[0] * width + own[1]
        first, second = (np.argsort(b, axis=1, kind="stable") for b in bounds)
        b0, b1 = np.take_along_axis(bounds[0], first, 1), np.take_along_axis(bounds[1], second, 1)
        out = []
        for r, cell in enumerate(cells.tolist()):
            out.append(_multi_sequence(b0[r], b1[r], first[r], second[r], width, cell, self.radius))
        return cells, out


def _multi_sequence(b0, b1, first, second, width: int, own: int, radius: float) -> list[int]:
    """Cells in order of b0[i] + b1[j], both ascending: a cell follows when its neighbours below it were visited."""
    n0, n1 = int(np.searchsorted(b0, radius, "right")), int(np.searchsorted(b1, radius, "right"))
    x, y = b0[:n0].tolist(), b1[:n1].tolist()
    i_codes, j_codes = first[:n0].tolist(), second[:n1].tolist()
    heap, reached, out = [(x[0] + y[0], 0, 0)], [0] * n0, []
    # reached[i]: cells of row i that were visited; they are always the first ones
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > radius:
            break
        reached[i] = j + 1
        cell = i_codes[i] * width + j_codes[j]
        if cell > own:
            out.append(cell)
        if i + 1 < n0 and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < n1 and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def _matrix(vectors: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(len(vectors), dim).astype(np.float64)


class _Block:
    """Members of one block of a cell, and what their comparisons found."""

    def __init__(self, dim: int, kind: str, threshold: float):
        self.dim, self.kind, self.threshold = dim, kind, threshold
        self.parts: list[pa.RecordBatch] = []
        self.ready = False

    def close(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        self.node, self.copies = t["node"].to_numpy(), t["copies"].to_numpy()
        self.raw = _matrix(t["vec"].combine_chunks(), self.dim, self.kind)
        self.unit = _units(self.raw)
        self.links = np.zeros(len(self.node), np.int64)
        self.label = np.arange(len(self.node))
        self.ready = True
        for s in range(0, len(self.node), STREAM):
            e = min(s + STREAM, len(self.node))
            near = self.near(self.raw[s:e], self.unit[s:e], s)
            near &= np.arange(s, len(self.node))[None, :] > np.arange(s, e)[:, None]
            self.links[s:e] += near @ self.copies[s:]
            self.links[s:] += self.copies[s:e] @ near
            itself = near.copy()
            itself[np.arange(e - s), np.arange(e - s)] = near.any(1)
            self.merge(itself, s)

    def near(self, raw: np.ndarray, unit: np.ndarray, start: int = 0) -> np.ndarray:
        sims = unit @ self.unit[start:].T
        near = sims >= self.threshold
        for i, j in zip(*np.nonzero(np.abs(sims - self.threshold) < 1e-12)):
            x, y = raw[i], self.raw[start + j]
            near[i, j] = float(x @ y) / float(np.sqrt(x @ x) * np.sqrt(y @ y)) >= self.threshold
        return near

    def merge(self, near: np.ndarray, start: int = 0) -> None:
        """Members that one row is linked with get one label, the smallest."""
        near = near[near.sum(1) > 1]
        used = np.flatnonzero(near.any(0))
        if not len(used):
            return
        near, used = near[:, used], used + start
        before = self.label[used]
        now, far = before.copy(), len(self.label)
        while True:
            of_row = np.where(near, now[None, :], far).min(1)
            new = np.minimum(now, np.where(near, of_row[:, None], far).min(0))
            if (new == now).all():
                break
            now = new
        to = np.arange(len(self.label))
        np.minimum.at(to, before, now)
        while ((again := to[to]) != to).any():
            to = again
        self.label = to[self.label]

    def visit(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
        raw = _matrix(batch.column("vec"), self.dim, self.kind)
        for s in range(0, len(node), STREAM):
            own = slice(s, s + STREAM)
            near = self.near(raw[own], _units(raw[own]))
            found = near.any(1)
            if found.any():
                near, seen = near[found], node[own][found]
                self.links += copies[own][found] @ near
                yield _answers(seen, near @ self.copies, self.node[near.argmax(1)])
                self.merge(near)

    def end(self) -> pa.RecordBatch:
        told = (self.links > 0) | (self.label != np.arange(len(self.label)))
        return _answers(self.node[told], self.links[told], self.node[self.label[told]])


_ANSWER = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _answers(node: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, links, other)], schema=_ANSWER)


def _verifier(kind: str, threshold: float):
    """Rows come in order of block, members first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("block_id").to_numpy()
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                part = batch.slice(s, e - s)
                if ids[s] != key:
                    if block is not None:
                        if not block.ready:
                            block.close()
                        yield block.end()
                    key, block = ids[s], _Block(part.column("dim")[0].as_py(), kind, threshold)
                if not visitor[s]:
                    block.parts.append(part)
                    continue
                if not block.ready:
                    block.close()
                yield from block.visit(part)
        if block is not None:
            if not block.ready:
                block.close()
            yield block.end()

    return work


def _assigner(grids: dict[int, Grid], kind: str, label: pa.DataType):
    schema = pa.schema(
        [("node", pa.int64()), ("label", label), ("copies", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())]
        + [("cell", pa.int64()), ("visits", pa.list_(pa.int64()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                raw = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                if dim in grids:
                    cells, visits = grids[dim].walks(_units(raw.astype(np.float64)))
                else:
                    cells, visits = np.zeros(len(raw), np.int64), [[]] * len(raw)
                columns = [part.column("node"), part.column("label"), part.column("copies")]
                columns += [pa.array([dim] * len(raw), pa.int32()), pa.array([x.tobytes() for x in raw], pa.binary())]
                columns += [pa.array(cells, pa.int64()), pa.array(visits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return work


def _grids(nodes: DataFrame, threshold: float, recall: float) -> dict[int, Grid]:
    """Codebooks for the usual vector lengths, fitted on a bounded sample."""
    sample = nodes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    n = nodes.count()
    usual = sorted(by_length, key=lambda d: (-len(by_length[d]), d))[:LENGTHS]
    # cells grow with the square root of the rows, so both their number and their size grow slower than these
    size = max(1, min(CODES, round(2 * n**0.25)))
    return {d: Grid(_units(np.array(by_length[d], np.float64)), size, threshold, recall) for d in usual}


def links(nodes: DataFrame, kind: str, store: Stored, threshold: float, recall: float) -> DataFrame:
    """(node, links, other) of linked vectors: add up ``links`` per node; (node, other) connect what is linked.

    ``nodes``: node, label, copies, v (array of numbers), each vector once per label.
    """
    spark = nodes.sparkSession
    grids = _grids(nodes, threshold, recall)
    label = nodes.schema["label"].dataType
    arrow = nodes.select("label").limit(0).toArrow().schema.field("label").type
    ddl = f"node bigint, label {label.simpleString()}, copies bigint, dim int, vec binary, cell bigint, visits array<bigint>"
    placed = store.keep(nodes.select("node", "label", "copies", "v").mapInArrow(_assigner(grids, kind, arrow), ddl))
    key = ["label", "dim", "cell"]
    blocks = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = placed.join(blocks, key).withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    carried = ["node", "copies", "dim", "vec"]
    target = F.xxhash64(*key, "block").alias("block_id")
    members = own.select(*key[:1], *carried, "cell", "block", F.lit(False).alias("visitor"))
    # members of a split cell visit its later blocks
    later = own.filter("block + 1 < blocks").select(
        *key[:1], *carried, "cell", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor")
    )
    away = (
        placed.select("label", *carried, F.explode("visits").alias("cell"))
        .join(blocks, key)
        .select(*key[:1], *carried, "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor"))
    )
    every = members.union(later).union(away).select(target, *key, "block", "visitor", "node", "copies", "vec")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*key, "block", "visitor"]
    sent = every.repartition(parts, *key, "block").sortWithinPartitions(*order)
    return sent.select("block_id", "dim", "visitor", "node", "copies", "vec").mapInArrow(
        _verifier(kind, threshold), "node bigint, links bigint, other bigint"
    )


def near_duplicates(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    recall: float = RECALL,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: links between vectors of one label with a cosine of ``threshold`` or more.

    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest vec_id reachable by links, and
    ``kept`` marks the one vector of each component that bears it. Every pair reported is verified in double
    precision on the original values; pairs at the threshold are missed at a rate of about ``1 - recall`` (1: none).

    A vector that is null, empty, zero or holds a null or non-finite component, a null label and a null vec_id link
    with nothing. Vectors of different length never link. Rows alike in vec_id, label and vector are one row of the
    result; other rows of one vec_id have a row each and share its links and component. An empty table gives no rows.
    """
    spark = rows.sparkSession
    store = Stored(spark)
    element = rows.schema[vector].dataType
    single = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    v = column(vector).cast(f"array<{'float' if single else 'double'}>")
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    every = rows.select(column(vec_id).cast("bigint").alias("vec_id"), column(label).alias("label"), v.alias("v"))
    every = store.keep(every.withColumn("sound", F.coalesce(sound, F.lit(False))).distinct())
    usable = every.filter("sound")
    nodes = store.keep(
        usable.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    )
    found = store.keep(links(nodes, kind, store, threshold, recall))
    reached = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")), store)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = (
        nodes.join(counted, "node", "left")
        .join(reached.withColumnRenamed("label", "component_id"), "node", "left")
        .select("label", "v", F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("component_id", "node"))
        .toDF("label", "v", "n_links", "component_id")
    )
    linked = usable.select("vec_id", "label", "v").join(of_node, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = every.filter("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
