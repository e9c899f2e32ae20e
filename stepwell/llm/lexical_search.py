"""Ranked lexical search on K2-treaps.

Documents are gathered into blocks. The grid of a block has a row per term and a column per document, and holds the
impact of the term in the document. A K2-treap cuts the grid into four again and again: of every cell that is
not empty it keeps which of its quarters are not, as four bits in level order, and the largest impact in it, as the
difference to that of the cell above. The place of a quarter follows from counting bits.

An item's terms are rows. Their paths descend together over ranges of documents: a range is bounded by the sum of the
largest impacts of its rows' cells, each times the term's weight. The range of the highest bound is halved next, so
documents come out in order of their scores, and the search ends as soon as enough are found or no range can reach the
best of earlier blocks.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.common import Stored, column

#: A block is closed when it holds so many bytes of text or so many documents.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 16384
#: Terms by which the documents of a block are put in order.
TELLING = 24
#: Ranges that are halved at a time.
TOGETHER = 64
#: Items that one search of a block takes at a time.
PACK = 512

#: Bytes that stand in terms, the capital letters as small ones; all others separate.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int32)
#: By bits of a cell and quarter: place of the quarter among those that are not empty, or -1.
_PLACE = np.array([[_BITS[m & ((1 << q) - 1)] if m >> q & 1 else -1 for q in range(4)] for m in range(16)], np.int32)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, kind).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    """Bits of every number moved to the even places."""
    out = np.zeros(len(x), np.int64)
    for k in range(bits):
        out |= ((x >> k) & 1) << (2 * k)
    return out


class Treap:
    """Grid of impacts, read by rows that descend together. Cells of all levels are numbered in level order."""

    def __init__(self, height: int, masks: list[np.ndarray], most: list[np.ndarray]):
        self.height, self.levels, self.maxima = height, masks, most
        self.masks, self.most = np.concatenate([*masks, np.zeros(len(most[-1]), np.uint8)]), np.concatenate(most)
        #: number of the first quarter of every cell
        counts = _BITS[self.masks]
        self.first = 1 + np.cumsum(counts, dtype=np.int32) - counts
        self.smallest = np.zeros(0, np.int64)

    def name(self, ids: np.ndarray) -> None:
        """Take the documents of the columns; of every range of columns the smallest is held, in level order."""
        far = np.full((1 << self.height) - len(ids), np.iinfo(np.int64).max)
        levels = [np.r_[ids, far]]
        for _ in range(self.height):
            levels.append(levels[-1].reshape(-1, 2).min(1))
        self.smallest = np.concatenate(levels[::-1])

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_rows: int, n_columns: int) -> Treap:
        height = max(1, int(max(n_rows, n_columns) - 1).bit_length())
        code = (_spread(rows, height) << 1) | _spread(columns, height)
        order = np.argsort(code, kind="stable")
        code, most = code[order], impacts[order].astype(np.int32)
        masks, maxima = [], [most]
        for _ in range(height):
            above = code >> 2
            cuts = np.flatnonzero(np.r_[True, above[1:] != above[:-1]]) if len(above) else np.zeros(0, np.int64)
            bits = (1 << (code & 3)).astype(np.uint8)
            masks.append(np.bitwise_or.reduceat(bits, cuts) if len(cuts) else bits)
            most = np.maximum.reduceat(most, cuts) if len(cuts) else most
            maxima.append(most)
            code = above[cuts]
        return cls(height, masks[::-1], maxima[::-1])

    def dump(self) -> dict[str, bytes]:
        """Bits of the cells and differences of the maxima, each level after the one above."""
        gaps = [self.maxima[0]]
        for level in range(self.height):
            above = np.repeat(self.maxima[level], _BITS[self.levels[level]])
            gaps.append(above - self.maxima[level + 1])
        return {"masks": _pack(np.concatenate(self.levels), "u1"), "gaps": _pack(np.concatenate(gaps), "<i4")}

    @classmethod
    def load(cls, height: int, masks: bytes, gaps: bytes) -> Treap:
        bits, gap = _unpack(masks, "u1"), _unpack(gaps, "<i4")
        levels, most = [], [gap[:1]]
        at, seen = 0, min(1, len(gap))
        for _ in range(height):
            here = bits[at : at + len(most[-1])]
            at += len(here)
            levels.append(here)
            above = np.repeat(most[-1], _BITS[here])
            most.append(above - gap[seen : seen + len(above)])
            seen += len(above)
        return cls(height, levels, most)

    def best(self, rows: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """(score, document) in falling order of the scores, equal ones by ascending document, as long as a score above 0
        and of at least ``least`` can come. The caller sends the new least score to the generator.
        """
        if not len(self.most) or not len(rows):
            return
        # bound, smallest document, level, place: of equal bounds the range of the smaller document comes first
        bound, every = int(weights.sum()) * int(self.most[0]), np.arange(len(rows))
        heap = [(-bound, int(self.smallest[0]), 0, 0, every, np.zeros(len(rows), np.int64))]
        while heap:
            # the best ranges are halved together; a document is told once nothing better is open
            taken: list[tuple] = []
            while heap and len(taken) < TOGETHER and -heap[0][0] >= max(least, 1):
                if heap[0][2] == self.height:
                    if taken:
                        break
                    told = heapq.heappop(heap)
                    least = (yield -told[0], told[1]) or least
                else:
                    taken.append(heapq.heappop(heap))
            if not taken:
                return
            for entry in self._halved(taken, rows, weights, least):
                heapq.heappush(heap, entry)

    def _halved(self, taken: list[tuple], rows: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple]:
        sizes = [len(entry[4]) for entry in taken]
        own, cells = np.concatenate([e[4] for e in taken]), np.concatenate([e[5] for e in taken])
        node = np.repeat(np.arange(len(taken)), sizes)
        levels, places = np.array([e[2] for e in taken]), np.array([e[3] for e in taken])
        ranks, firsts = _PLACE[self.masks[cells]], self.first[cells]
        side = ((rows[own] >> (self.height - 1 - levels[node])) & 1) << 1
        line = np.arange(len(own))
        for half in (0, 1):
            rank = ranks[line, side + half]
            there = np.flatnonzero(rank >= 0)
            if not len(there):
                continue
            child, mine, of = (firsts + rank)[there], own[there], node[there]
            starts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1]
            bounds = np.add.reduceat(weights[mine] * self.most[child], starts)
            ends, of = np.r_[starts[1:], len(of)], of[starts]
            at = 2 * places[of] + half
            smallest = self.smallest[(2 << levels[of]) - 1 + at]
            for i in np.flatnonzero(bounds >= least).tolist():
                s, e = starts[i], ends[i]
                yield -int(bounds[i]), int(smallest[i]), int(levels[of[i]]) + 1, int(at[i]), mine[s:e], child[s:e]


_BLOCK = pa.schema(
    [("block", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.string()))]
    + [("held", pa.list_(pa.int64())), ("ids", pa.binary()), ("sizes", pa.binary())]
    + [("rows", pa.binary()), ("columns", pa.binary()), ("counts", pa.binary())]
)
_BLOCK_DDL = (
    "block bigint, n_docs bigint, n_terms bigint, terms array<string>, held array<bigint>, ids binary, sizes binary, "
    "rows binary, columns binary, counts binary"
)


def _order(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> np.ndarray:
    """Columns with like frequent terms side by side, so that a range has few of the terms that others have."""
    held = np.bincount(rows, minlength=n_rows)
    telling = np.argsort(np.abs(held - n_columns / 4), kind="stable")[:TELLING]
    bit = np.full(n_rows, -1)
    bit[telling] = np.arange(len(telling))
    own = bit[rows] >= 0
    marks = np.zeros(n_columns, np.int64)
    np.bitwise_or.at(marks, columns[own], np.int64(1) << (TELLING - 1 - bit[rows[own]]))
    return np.argsort(marks, kind="stable")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text) as blocks of counted terms, columns in order of the frequent terms they have."""
    number = TaskContext.get().partitionId() << 32
    names: dict[bytes, int] = {}
    ids, sizes, rows, counts, widths, size = [], [], array("i"), array("i"), [], 0

    def closed() -> pa.RecordBatch:
        row = np.frombuffer(rows, np.int32) if rows else np.zeros(0, np.int32)
        order = _order(row, np.repeat(np.arange(len(ids)), widths), len(names), len(ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        values = [number, sum(s > 0 for s in sizes), sum(sizes), [t.decode() for t in names]]
        values += [np.bincount(row, minlength=len(names)).tolist(), _pack(np.array(ids)[order], "<i8"), _pack(np.array(sizes)[order], "<i8")]
        values += [_pack(row, "<i4"), _pack(np.repeat(place, widths), "<i4"), _pack(np.array(counts, np.int32), "<i4")]
        return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, values))], schema=_BLOCK)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            if ids and (size + len(text) > BLOCK_BYTES or len(ids) == BLOCK_DOCS):
                yield closed()
                number += 1
                names = {}
                ids, sizes, rows, counts, widths, size = [], [], array("i"), array("i"), [], 0
            words = terms_of(text)
            found = Counter(words)
            rows.extend([names.setdefault(t, len(names)) for t in found])
            counts.extend(found.values())
            widths.append(len(found))
            ids.append(doc_id)
            sizes.append(len(words))
            size += len(text)
    if ids:
        yield closed()


_TREAP = "block bigint, terms array<string>, held array<bigint>, ids binary, height int, masks binary, gaps binary"


def _treaps(n_docs: int, n_terms: int):
    """Blocks of counted terms as K2-treaps of impacts, given the documents with a term and the length of all."""
    schema = pa.schema(
        [_BLOCK.field("block"), _BLOCK.field("terms"), _BLOCK.field("held"), _BLOCK.field("ids")]
        + [pa.field("height", pa.int32()), pa.field("masks", pa.binary()), pa.field("gaps", pa.binary())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in ("ids", "sizes", "rows", "columns", "counts")}
                sizes, rows, cols = _unpack(r["sizes"], "<i8"), _unpack(r["rows"], "<i4"), _unpack(r["columns"], "<i4")
                tf = _unpack(r["counts"], "<i4").astype(np.int64)
                m = 10 + (90 * sizes * n_docs) // max(1, n_terms)
                impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[cols])
                n_rows = len(batch.column("terms")[i])
                treap = Treap.build(rows.astype(np.int64), cols.astype(np.int64), impacts, n_rows, len(sizes))
                made = treap.dump()
                kept = [batch.column(name).slice(i, 1) for name in ("block", "terms", "held", "ids")]
                made = [pa.array([treap.height], pa.int32()), pa.array([made["masks"]], pa.binary()), pa.array([made["gaps"]], pa.binary())]
                yield pa.RecordBatch.from_arrays(kept + made, schema=schema)

    return work


class Index:
    """K2-treaps of all documents: a row per block, and how many documents have a term."""

    def __init__(self, blocks: DataFrame, n_docs: int):
        self.blocks, self.n_docs = blocks, n_docs


def build_index(docs: DataFrame, store: Stored, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index of every document; only sums of counts leave the tasks, no row per term and document is shuffled."""
    rows = docs.select(column(doc_id).cast("bigint").alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    counted = store.keep(rows.filter(F.col("doc_id").isNotNull()).mapInArrow(_blocks, _BLOCK_DDL))
    total = counted.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks = store.keep(counted.mapInArrow(_treaps(total[0], total[1]), _TREAP))
    store.drop(counted)
    return Index(blocks, total[0])


def _searcher(k: int):
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the least of the best scores this task has seen for an item; a document below it cannot be among the best
        leasts: dict[int, list[int]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                treap = Treap.load(*(batch.column(name)[i].as_py() for name in ("height", "masks", "gaps")))
                treap.name(_unpack(batch.column("ids")[i].as_py(), "<i8"))
                asked = batch.column("asked")[i].values
                item, row, weight = (asked.field(name).to_numpy() for name in ("item", "row", "weight"))
                order = np.argsort(item, kind="stable")
                item, row, weight = item[order], row[order], weight[order]
                cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
                out = []
                for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)]):
                    own = leasts.setdefault(int(item[s]), [])
                    found = _search(treap, row[s:e], weight[s:e], own, k)
                    out += [(int(item[s]), doc, score) for score, doc in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)

    return work


def _search(treap: Treap, rows: np.ndarray, weights: np.ndarray, seen: list[int], k: int) -> list[tuple[int, int]]:
    """The ``k`` best documents of a block that can matter; ``seen`` is a heap of the best scores of other blocks so far."""
    least = seen[0] if len(seen) == k else 1
    found: list[tuple[int, int]] = []
    walk = treap.best(rows, weights, least)
    step = next(walk, None)
    while step is not None:
        score = step[0]
        found.append(step)
        if len(seen) < k:
            heapq.heappush(seen, score)
        else:
            heapq.heappushpop(seen, score)
        if len(found) == k:
            break
        try:
            step = walk.send(seen[0] if len(seen) == k else least)
        except StopIteration:
            step = None
    return found


def search(items: DataFrame, index: Index, store: Stored, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item."""
    spark = items.sparkSession
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(
        F.translate(column(text).cast("string"), letters, letters.lower()), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)
    )
    asked = items.select(column(item_id).cast("bigint").alias("item"), F.explode(F.array_distinct(words)).alias("term"))
    asked = store.keep(asked.filter(F.col("item").isNotNull()).distinct())
    named = index.blocks.select("block", F.posexplode(F.arrays_zip("terms", "held"))).select(
        "block", F.col("pos").cast("bigint").alias("row"), F.col("col.terms").alias("term"), F.col("col.held").alias("held")
    )
    met = store.keep(named.join(asked.select("term").distinct(), "term", "left_semi"))
    # floor(1000 ln((2 N + 2) / (2 df + 1)))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.sum("held") + 1)))
    weights = met.groupBy("term").agg(weight.alias("weight"))
    packs = max(1, -(-asked.select("item").distinct().count() // PACK))
    requests = (
        met.join(asked.join(weights, "term"), "term")
        .withColumn("pack", F.pmod(F.xxhash64("item"), F.lit(packs)))
        .groupBy("block", "pack")
        .agg(F.collect_list(F.struct("item", "row", "weight")).alias("asked"))
    )
    sent = requests.join(index.blocks.select("block", "ids", "height", "masks", "gaps"), "block")
    found = sent.select("asked", "ids", "height", "masks", "gaps").mapInArrow(_searcher(k), "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: of every item its ``k`` documents of the highest score above 0.

    Terms are maximal stretches of digits, letters of ASCII (capitals as small ones) and characters beyond ASCII. A term that
    is in ``df`` of ``N`` documents weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score adds weight times
    ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, each counted once, with m = 10 + (90 n N) div L. Equal
    scores rank by ascending doc_id.

    Null or empty texts have no terms, do not count in N and are never listed. Rows without doc_id or item_id take no part. Each row is a document,
    also where an id or a text repeats; the terms of all rows of an item_id are one item. Without documents, or
    without items, there are no rows.
    """
    store = Stored(docs.sparkSession)
    return search(items, build_index(docs, store, doc_id, text), store, k, item_id, item_text)
