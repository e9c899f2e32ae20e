"""Runs of repeated words: every maximal stretch of a text whose words come back after a fixed distance.

The words of many documents are sorted by suffix together, each document closed by a mark of its own, so that
common prefixes never cross documents. The tree of LCP intervals is then walked bottom up. An interval of common prefix
``l`` holds its positions in lists by the word on their left. Where two children meet, positions with different left
words are a maximal pair; one at a distance of ``p <= l`` is a run of period ``p``: the left words differ
and the common prefix ends, so it needs no extension. The smaller child looks into the larger one, in the lists of
other left words or among the positions near by, whichever are fewer.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import column

#: Least length of a run in words, and least number of periods in it.
MIN_LENGTH, MIN_PERIODS = 12, 2
#: Bytes of text whose suffixes are sorted together; a longer text is sorted alone.
GROUP_BYTES = 2 << 20


def _suffixes(text: np.ndarray, distinct: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their suffixes, and the common prefix of each with the one before it.

    Common prefixes shorter than ``least`` may be given as 0. No two suffixes of ``text`` are equal.
    """
    n = len(text)
    bits = max(1, int(distinct).bit_length())
    h = max(1, min(63 // bits, least))
    padded = np.r_[text, np.arange(distinct, distinct + h)] if h > 1 else text
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << bits) | (padded[k : k + n] & ((1 << bits) - 1))
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order[1:]] != key[order[:-1]]]
    together = ~fresh
    rank = np.empty(n + 1, np.int64)
    firsts = np.flatnonzero(fresh)
    rank[order] = np.repeat(firsts, np.diff(np.r_[firsts, n]))
    rank[n] = -1
    start = h
    # ranks by h words give ranks by 2 h; only groups of equal rank are sorted again
    while len(places := np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))):
        at = order[places]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[places] = at
        new = np.r_[True, key[1:] != key[:-1]]
        fresh[places] |= new
        rank[at] = np.repeat(places[new], np.diff(np.r_[np.flatnonzero(new), len(places)]))
        h *= 2
    before = np.full(n, -1, np.int64)
    met = np.flatnonzero(together)
    before[order[met]] = order[met - 1]
    # where the neighbour moves along, the common prefix is one shorter
    moves = np.zeros(n, bool)
    moves[1:] = (before[1:] >= 0) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1)
    compared = np.flatnonzero(~moves & (before >= 0))
    length = np.full(len(compared), start, np.int64)
    active, step = np.arange(len(compared)), 8
    ended = np.r_[text, np.full(64, -1)]
    while len(active):
        x = (compared[active] + length[active])[:, None] + np.arange(step)
        y = (before[compared[active]] + length[active])[:, None] + np.arange(step)
        differ = ended[np.minimum(x, n)] != ended[np.minimum(y, n)]
        differ |= (x >= n) | (y >= n)
        stop = differ.any(1)
        length[active] += np.where(stop, differ.argmax(1), step)
        active, step = active[~stop], 64
    here = np.arange(n)
    end = here.copy()
    end[compared] += length
    value = end[np.maximum.accumulate(np.where(moves, 0, here))] - here
    return order, np.where(before >= 0, value, 0)[order]


def _pairs(order: list[int], common: list[int], left: list[int], found: dict, min_length: int) -> None:
    """Maximal pairs at a distance of at most their length, among suffixes that share a prefix, into ``found``.

    ``found``: smallest distance by (start, end). ``common[k]`` belongs to order[k - 1] and order[k].
    """

    def merge(a: tuple, b: tuple, size: int) -> tuple:
        if len(a[0]) < len(b[0]):
            a, b = b, a
        places, classes = a
        for x in b[0]:
            lo, hi = bisect_left(places, x - size), bisect_right(places, x + size)
            if lo == hi:
                continue
            own = left[x]
            if hi - lo <= len(classes):
                near = [y for y in places[lo:hi] if left[y] != own]
            else:
                near = []
                for word, at in classes.items():
                    if word != own:
                        near += at[bisect_left(at, x - size) : bisect_right(at, x + size)]
            for y in near:
                p = abs(x - y)
                if p + size >= min_length:
                    key = (min(x, y), max(x, y) + size)
                    if found.get(key, p) >= p:
                        found[key] = p
        for x in b[0]:
            insort(places, x)
            at = classes.get(left[x])
            if at is None:
                classes[left[x]] = [x]
            else:
                insort(at, x)
        return a

    leaf = lambda x: ([x], {left[x]: [x]})
    stack: list[list] = []
    for k in range(1, len(order)):
        node, size = leaf(order[k - 1]), common[k]
        while stack and stack[-1][0] > size:
            top = stack.pop()
            node = merge(top[1], node, top[0])
        if stack and stack[-1][0] == size:
            stack[-1][1] = merge(stack[-1][1], node, size)
        else:
            stack.append([size, node])
    node = leaf(order[-1])
    while stack:
        top = stack.pop()
        node = merge(top[1], node, top[0])


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    ids: list[np.ndarray] = []
    starts, base, at = [], 0, 0
    for words in texts:
        own: dict[bytes, int] = {}
        ids.append(np.fromiter([own.setdefault(w, len(own)) for w in words], np.int64, len(words)) + base)
        base += len(own)
        # the mark at the end
        ids.append(np.array([base], np.int64))
        base += 1
        starts.append(at)
        at += len(words) + 1
    out: list[list[tuple]] = [[] for _ in texts]
    if at <= len(texts):
        return out
    text = np.concatenate(ids)
    least = max(1, -(-min_length // 2))
    order, common = _suffixes(text, base, least)
    deep = common >= least
    begins = np.flatnonzero(deep[1:] & ~deep[:-1])
    ends = np.flatnonzero(deep & ~np.r_[deep[1:], False])
    left = np.r_[-1, text[:-1]].tolist()
    found: dict[tuple[int, int], int] = {}
    for s, e in zip(begins.tolist(), ends.tolist()):
        _pairs(order[s : e + 1].tolist(), common[s : e + 1].tolist(), left, found, min_length)
    for (start, end), period in found.items():
        if end - start >= min_periods * period:
            doc = bisect_right(starts, start) - 1
            out[doc].append((start - starts[doc], end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple]) -> bytes:
    """The words joined by a space, of each run only the first period, unless an overlapping run drops that too."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change[:-1]) > 0
    return b" ".join([words[i] for i in np.flatnonzero(~dropped)])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = [("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())]
_DDL = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def detect(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """doc_id, n_words, runs, collapsed: the runs of every text, and the text without the words that repeat.

    Words are what stands between white space of ASCII. A run has at least ``min_length`` words and ``min_periods`` (two
    or more) times its smallest period, and no neighbouring word goes on with that period. ``runs`` are sorted
    by start, then period. ``collapsed`` holds the words outside runs and the first period of runs, with one space
    between them. A null text has no words: no runs and an empty ``collapsed``. Null and repeated ids keep a row for each
    row; an empty table gives no rows. A text is never cut, and needs memory for its own words only.
    """
    rows = docs.select(column(doc_id).alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).cast(pa.large_binary()).to_numpy(zero_copy_only=False) if batch.num_rows else []
            group, size = 0, 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size and size + len(sizes[i]) > GROUP_BYTES:
                    if i > group:
                        yield found(batch.slice(group, i - group), sizes[group:i])
                    group, size = i, 0
                if i < batch.num_rows:
                    size += len(sizes[i])

    def found(batch: pa.RecordBatch, texts) -> pa.RecordBatch:
        words = [x.split() for x in texts]
        runs = runs_of(words, min_length, min_periods)
        kept = [collapse(w, r).decode() for w, r in zip(words, runs)]
        told = [[dict(zip(("start", "length", "period"), r)) for r in each] for each in runs]
        ids = batch.column(0)
        schema = pa.schema([("doc_id", ids.type), *_SCHEMA])
        columns = [pa.array([len(w) for w in words], pa.int64()), pa.array(told, pa.list_(_RUN)), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays([ids, *columns], schema=schema)

    return rows.mapInArrow(work, f"doc_id {kind}, {_DDL}")
