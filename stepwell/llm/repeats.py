"""Removal of repeated passages by suffix arrays of shards.

Every byte covered by a string of ``DEPTH`` bytes that also starts elsewhere goes. Strings that are equal
must meet in one shard. Each string of ``DEPTH`` bytes holds windows of ``GRAM`` bytes, and the one of least hash (its
anchor) depends on the string alone: equal strings have equal anchors, at equal places. So

1. anchors are exchanged as hashes, and those that occur once are dropped with the strings around them;
2. documents that hold a repeated anchor send the strings around it, overlapping ones as one segment, to the
   shard of the anchor; a segment that one task meets twice is sent once;
3. every shard builds its suffix array (Larsson-Sadakane) and common prefixes (Kasai), and reports the starts
   that occur twice. An anchor with very many segments has several shards, which are merged by binary
   search of each one's sorted strings in the others';
4. the reported starts become spans of their documents.

Equal texts are one document with a count: only one of them takes part, and all their bytes go.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwell.llm.common import Stored, column
from stepwell.llm.shingles import _power_tables, mixed
from stepwell.llm.suffix_arrays import repeated_starts

DEPTH, GRAM = 200, 64
#: Bytes of text handled at once; longer texts are read in overlapping pieces.
CHUNK_BYTES = 4 << 20
#: Bytes of one suffix array, and segments of one anchor per shard.
SHARD_BYTES, SHARD_SEGMENTS = 1 << 20, 8192
#: Rows that a task hands on at once.
BATCH_ROWS = 20_000
_PLACE = np.uint64((1 << 24) - 1)

_ANCHORS = pa.schema([("kind", pa.int8()), ("fp", pa.int64()), ("node", pa.int64()), ("place", pa.int64())])
_ANCHORS_DDL = "kind tinyint, fp bigint, node bigint, place bigint"
_PARTS = pa.schema(
    [("kind", pa.int8()), ("fp", pa.int64()), ("salt", pa.int32()), ("shards", pa.int32()), ("node", pa.int64()),
     ("lo", pa.int64()), ("hi", pa.int64()), ("body", pa.binary())]
)
_PARTS_DDL = "kind tinyint, fp bigint, salt int, shards int, node bigint, lo bigint, hi bigint, body binary"
#: Kinds: a single place, a count, a known repeat; in parts: a segment, a span, a string of a merged shard.
ONE, MANY, KNOWN = 0, 1, 2


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _as_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return _batch(schema, *(zip(*rows) if rows else [[]] * len(schema)))


def _as_batches(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH_ROWS)):
        yield _as_batch(schema, some)


def _slide(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least or largest of every ``size`` consecutive values, by doubling."""
    pick, span, out = (np.minimum if least else np.maximum), 1, x
    while 2 * span <= size:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(x) - size + 1], out[size - span :]) if span < size else out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: (hash, place, first start, last start) in order of place.

    A start belongs to the anchor of the ``DEPTH`` bytes from it on; starts of one anchor are consecutive.
    """
    hashes, places, firsts, lasts = [], [], [], []
    step = CHUNK_BYTES
    for at in range(0, max(1, len(text) - DEPTH + 1), step):
        piece = np.frombuffer(text, np.uint8)[at : at + step + DEPTH - 1]
        n = len(piece)
        if n < DEPTH:
            break
        up, down = _power_tables(n + 1)
        sums = np.r_[np.uint64(0), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:n])]
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        # the last of equal hashes is the least
        here = np.arange(len(grams), dtype=np.uint64)
        keys = (grams & ~_PLACE) | (_PLACE - here)
        least = _slide(keys, DEPTH - GRAM + 1, True)
        owner = (_PLACE - (least & _PLACE)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        end = np.r_[begin[1:], len(owner)] - 1
        hashes.append(grams[owner[begin]].view(np.int64))
        places.append(owner[begin] + at)
        firsts.append(begin + at)
        lasts.append(end + at)
    if not hashes:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(x).astype(np.int64) for x in (hashes, places, firsts, lasts))


def rows_of(docs: DataFrame, doc_id: str, text: str, carry: bool) -> DataFrame:
    """Per row: row number, doc_id, node (hash of the text), size, sha256 and the compressed text.

    ``carry`` adds ``_row``, all columns of the row, with an empty text in place of one that is not null.
    """
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("sha", pa.string()),
         ("body", pa.binary())]
    )
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pyspark.TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (body.as_py() or "").encode("utf-8", "replace")
                digest = hashlib.sha256(raw).digest()
                node = int.from_bytes(digest[:8], "little", signed=True)
                packed = pa.compress(raw, codec="zstd", asbytes=True)
                out.append((number, key, node, len(raw), digest.hex(), packed))
                number += 1
            made = _as_batch(schema, out)
            if not carry:
                yield made
            else:
                yield pa.RecordBatch.from_arrays([*made.columns, batch.column(2)], names=[*schema.names, "_row"])

    picked = [column(doc_id).cast("bigint").alias("doc_id"), column(text).cast("string").alias("text")]
    out = StructType.fromDDL("row bigint, doc_id bigint, node bigint, size bigint, sha string, body binary")
    if carry:
        # the text is in the body already
        blank = F.when(column(text).isNotNull(), F.lit("")).alias(text)
        picked.append(F.struct(*[blank if c == text else column(c) for c in docs.columns]).alias("_row"))
        out = StructType([*out, docs.select(picked[-1]).schema["_row"]])
    return docs.select(*picked).mapInArrow(work, out)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their text, and ``n_chars`` (if there) as it is then."""
    cut = remove(docs, doc_id, text, with_text=True)
    own = F.col("_row")
    kept = F.when(own[text].isNotNull(), F.col("kept"))
    columns = {text: kept.alias(text)}
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        columns[n_chars] = F.when(own[n_chars].isNotNull(), F.length(F.coalesce(kept, F.lit("")))).cast(kind).alias(n_chars)
    return cut.select(*[columns.get(c, own[c].alias(c)) for c in docs.columns])


def _plain(batch: pa.RecordBatch, n: int) -> list:
    """The first ``n`` columns, value by value."""
    return [batch.column(i).to_pylist() for i in range(n)]


def _lists(column: pa.ListArray) -> list:
    """Per row the values of each field of a list of structs, as arrays; a null is an empty list."""
    ends, places = column.offsets.to_numpy(), column.values
    fields = [places.field(i).to_numpy(zero_copy_only=False) for i in range(places.type.num_fields)]
    return [[x[a:b] for a, b in zip(ends[:-1], ends[1:])] for x in fields]


def _text(body: bytes, size: int) -> bytes:
    return pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a task's texts; those met twice in a chunk as known repeats and one count each."""

    def send(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        fp = np.concatenate([f for _, f, _ in found])
        place = np.concatenate([p for _, _, p in found])
        node = np.repeat(np.array([n for n, _, _ in found], np.int64), [len(f) for _, f, _ in found])
        values, back, count = np.unique(fp, return_inverse=True, return_counts=True)
        known = (count > 1)[back]
        many = count > 1
        kind = np.r_[np.where(known, KNOWN, ONE), np.full(many.sum(), MANY)].astype(np.int8)
        zeros = np.zeros(many.sum(), np.int64)
        return _batch(_ANCHORS, kind, np.r_[fp, values[many]], np.r_[node, zeros], np.r_[place, count[many]])

    found, size, seen = [], 0, set()
    for batch in batches:
        for node, n, body in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if node in seen:
                continue
            seen.add(node)
            fp, place, _, _ = anchors(_text(body, n))
            found.append((node, fp, place))
            size += n
            if size > CHUNK_BYTES:
                yield send(found)
                found, size, seen = [], 0, set()
    if found:
        yield send(found)


def _meet(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Repeated anchors of a task's hashes (KNOWN), and the number of places of those with more than ``most`` (MANY)."""
    parts = []
    for b in batches:
        kind = b.column(0).to_numpy()
        if (kind == KNOWN).any():
            yield b.filter(pa.array(kind == KNOWN))
        parts.append(b.filter(pa.array(kind != KNOWN)))
    t = pa.Table.from_batches(parts, schema=_ANCHORS) if parts else None
    if t is None or not t.num_rows:
        return
    kind, fp, node, place = (t[c].to_numpy() for c in _ANCHORS.names)
    order = np.lexsort((place, node, kind, fp))
    kind, fp, node, place = kind[order], fp[order], node[order], place[order]
    first = np.r_[True, fp[1:] != fp[:-1]]
    fresh = first | np.r_[True, (node[1:] != node[:-1]) | (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])]
    group = np.cumsum(first) - 1
    count = np.bincount(group, weights=np.where(kind == MANY, place, fresh)).astype(np.int64)
    use = (count > 1)[group] & (kind == ONE) & fresh
    yield _batch(_ANCHORS, np.full(use.sum(), KNOWN, np.int8), fp[use], node[use], place[use])
    hot = np.flatnonzero(count > most)
    if len(hot):
        starts = np.flatnonzero(first)[hot]
        yield _batch(_ANCHORS, np.full(len(hot), MANY, np.int8), fp[starts], np.zeros(len(hot), np.int64), count[hot])


def _send_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments around repeated anchors, once per chunk; those met twice also as spans of their documents."""

    def send(met: dict[tuple[int, bytes], list[tuple[int, int, int]]], shards: dict[int, int]) -> pa.RecordBatch:
        out = []
        for (fp, body), places in met.items():
            n = shards.get(fp, 1)
            salt = zlib.crc32(body) % n if n > 1 else 0
            if len(places) > 1:
                out += [(KNOWN, zlib.crc32(b"%d" % node), 0, 0, node, lo, hi, None) for node, lo, hi in places]
            node, lo, hi = places[0]
            # of a segment met twice all starts are known; it is sent for others to meet
            out.append((MANY if len(places) > 1 else ONE, fp, salt, n, node, lo, hi, body))
        return _as_batch(_PARTS, out)

    met, size, shards = defaultdict(list), 0, {}
    for batch in batches:
        for node, n, body, places, shards_of in zip(*_plain(batch, 3), *_lists(batch.column(3))):
            text = _text(body, n)
            wanted = dict(zip(places.tolist(), shards_of.tolist()))
            for fp, place, first, last in zip(*[x.tolist() for x in anchors(text)]):
                if place in wanted:
                    if wanted[place] > 1:
                        shards[fp] = wanted[place]
                    met[fp, text[first : last + DEPTH]].append((node, first, last))
            size += n
            if size > CHUNK_BYTES:
                yield send(met, shards)
                met, size, shards = defaultdict(list), 0, {}
    if met:
        yield send(met, shards)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of every run of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _search(groups: list[list[tuple]]) -> Iterator[tuple]:
    """Parts for the segments of one suffix array; ``groups`` hold all segments of an anchor and salt."""
    # distinct segments, with the documents that hold each
    segments: dict[tuple[int, int, bytes], list[tuple]] = {}
    for rows in groups:
        for row in rows:
            segments.setdefault((row[1], row[2], row[7]), []).append(row)
    keys = list(segments)
    alone: dict[tuple[int, int], int] = defaultdict(int)
    for fp, salt, _ in keys:
        alone[fp, salt] += 1
    sorted_keys = [k for k in keys if alone[k[0], k[1]] > 1 or len(k[2]) > DEPTH]
    found: dict[tuple, np.ndarray] = {}
    if sorted_keys:
        text = np.frombuffer(b"".join(k[2] for k in sorted_keys), np.uint8)
        lengths = np.array([len(k[2]) for k in sorted_keys])
        begins = np.cumsum(lengths) - lengths
        valid = np.ones(len(text), bool)
        for b, n in zip(begins, lengths):
            valid[b + n - DEPTH + 1 : b + n] = False
        twice = repeated_starts(text, valid, DEPTH)
        found = {k: twice[b : b + n - DEPTH + 1] for k, b, n in zip(sorted_keys, begins, lengths)}
    for key in keys:
        rows, (fp, salt, body) = segments[key], key
        n = len(body) - DEPTH + 1
        flags = np.ones(n, bool) if len(rows) > 1 or rows[0][0] == MANY else found.get(key, np.zeros(n, bool))
        for kind, _, _, shards, node, lo, hi, _ in rows:
            if kind == ONE:
                yield from ((KNOWN, fp, salt, shards, node, lo + a, lo + b, None) for a, b in _runs(flags))
        kind, _, _, shards, node, lo, hi, _ = rows[0]
        if shards > 1:  # one string per start for the other shards of this anchor
            for i in range(n):
                own = (-1, -1) if flags[i] else (node, lo + i)
                yield (ONE, fp, salt, shards, own[0], own[1], own[1], hashlib.blake2b(body[i : i + DEPTH], digest_size=16).digest())


def _shard(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Spans (KNOWN) found in the segments of one task, sorted by anchor and salt."""
    groups: list[list[tuple]] = []
    size, last = 0, None
    for batch in batches:
        known: list[tuple] = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] == KNOWN:
                known.append(row)
                continue
            if row[1:3] != last:
                if size > shard_bytes:
                    yield from _as_batches(_PARTS, _search(groups))
                    groups, size = [], 0
                groups.append([])
                last = row[1:3]
            groups[-1].append(row)
            size += len(row[7])
        yield _as_batch(_PARTS, known)
    if groups:
        yield from _as_batches(_PARTS, _search(groups))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of strings that several shards of an anchor hold: each shard's strings are searched in the others'."""
    rows = [r for b in batches for r in zip(*[b.column(i).to_pylist() for i in (1, 2, 4, 5, 7)])]
    shards: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    for fp, salt, node, lo, string in rows:
        shards[fp, salt].append((string, node, lo))
    runs = {k: np.array(sorted({s for s, _, _ in v}), dtype="S16") for k, v in shards.items()}
    out = []
    for (fp, salt), own in shards.items():
        mine = np.array([s for s, _, _ in own], dtype="S16")
        hit = np.zeros(len(mine), bool)
        for (other_fp, other), run in runs.items():
            if other_fp == fp and other != salt and len(run):
                at = np.minimum(np.searchsorted(run, mine), len(run) - 1)
                hit |= run[at] == mine
        out += [(KNOWN, fp, salt, 0, n, lo, lo, None) for (_, n, lo), h in zip(own, hit) if h and lo >= 0]
    yield _as_batch(_PARTS, out)


def spans(rows: DataFrame, store: Stored, shard_segments: int, shard_bytes: int) -> DataFrame:
    """(node, lo, hi): runs of repeated starts of each text that occurs, stored."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.filter(F.col("size") >= DEPTH).select("node", "size", "body").mapInArrow(_send_anchors, _ANCHORS_DDL)
    # known repeats need no meeting; they go along with their document
    key = F.when(F.col("kind") == KNOWN, F.col("node")).otherwise(F.col("fp"))
    met = store.keep(sent.repartition(parts, key).mapInArrow(lambda b: _meet(b, shard_segments), _ANCHORS_DDL))
    hot = met.filter(F.col("kind") == MANY).select("fp", F.expr(f"int(1 + place div {shard_segments})").alias("shards"))
    repeated = met.filter(F.col("kind") == KNOWN).select("fp", "node", "place")
    repeated = repeated.join(hot, "fp", "left").select("node", "place", F.coalesce("shards", F.lit(1)).alias("shards"))
    by_node = repeated.groupBy("node").agg(F.collect_list(F.struct("place", "shards")).alias("found"))
    # one row stands for all rows of its text
    first = rows.groupBy("node").agg(F.min("row").alias("row"))
    wanted = by_node.join(first, "node").select("row", "found")
    texts = rows.select("row", "node", "size", "body").join(wanted, "row").select("node", "size", "body", "found")
    segments = texts.mapInArrow(_send_segments, _PARTS_DDL)
    spread = segments.repartition(parts, "fp", "salt").sortWithinPartitions("fp", "salt")
    searched = store.keep(spread.mapInArrow(lambda b: _shard(b, shard_bytes), _PARTS_DDL))
    strings = searched.filter(F.col("kind") == ONE).repartition(parts, "fp", F.substring("body", 1, 2))
    merged = strings.mapInArrow(_merge, _PARTS_DDL)
    found = store.keep(searched.filter(F.col("kind") == KNOWN).unionByName(merged).select("node", "lo", "hi"))
    store.drop(met, searched)
    return found


def remove(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    with_text: bool = False,
    shard_segments: int = SHARD_SEGMENTS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and ``_row``, its columns with an empty
    text, and ``kept``, the text that stays).

    A character that is removed in part is missing from ``kept``, which is text; the checksum is of the bytes. Null or empty text: no bytes, nothing removed. Rows of equal text of ``DEPTH`` bytes or more are
    removed whole, whatever their ids. Texts shorter than that stay. No rows give no rows.
    """
    store = Stored(docs.sparkSession)
    rows = store.keep(rows_of(docs, doc_id, text, with_text))
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    found = spans(rows, store, shard_segments, shard_bytes)
    # rows of a text that occurs twice go whole, so spans are joined to single rows only
    single = found.join(copies.select("node"), "node", "left_anti")
    by_node = single.groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    marked = rows.join(copies, "node", "left").join(by_node, "node", "left")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
         ("kept_sha256", pa.string()), ("kept", pa.string())]
    )
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            out = []
            for key, size, sha, copies, body, los, his in zip(*_plain(batch, 5), *_lists(batch.column(5))):
                if copies and size >= DEPTH:
                    out.append((key, size, size, 1, nothing, "" if with_text else None))
                    continue
                if not len(los):
                    out.append((key, size, 0, 0, sha, _text(body, size).decode() if with_text else None))
                    continue
                raw, kept, at, removed, runs = _text(body, size), [], 0, 0, 0
                end = -1
                for lo, hi in sorted(zip(los.tolist(), (his + DEPTH).tolist())):
                    if lo > end:
                        kept.append(raw[at:lo])
                        runs += 1
                        removed += hi - lo
                    else:
                        removed += max(0, hi - end)
                    end = at = max(end, hi)
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((key, size, removed, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
            made = _as_batch(schema, out)
            if with_text:
                yield pa.RecordBatch.from_arrays([*made.columns, batch.column(6)], names=[*schema.names, "_row"])
            else:
                yield made

    names = ["doc_id", "size", "sha", "copies", "body", "found"]
    if with_text:
        return marked.select(*names, "_row").mapInArrow(cut, StructType([*StructType.fromDDL(ddl), rows.schema["_row"]]))
    return marked.select(*names).mapInArrow(cut, ddl).drop("kept")
