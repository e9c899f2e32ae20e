"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: a class with pieces of ``s`` tokens takes
``capacity // s`` pieces per bin, a fixed count. Documents may be cut, so each one is cut
greedily into pieces of class lengths that leave at most ``WASTE`` of a bin unused;
three pieces are usual. Workers tokenise and class their documents independently. Only the
number of pieces per (worker, class) is exchanged: it gives every piece its place within
its class, and so its bin and offset, without moving a document. What the last, unfilled bin of
each class holds is repacked on the driver by counts per class, which the capacity bounds
and not the corpus.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.common import Stored, column
from stepwell.llm.pretokens import Splitter, is_latin

CAPACITY = 4096
END_ID = 2
#: Share of a bin that a class may leave unused.
WASTE = 0.01
#: Words whose ids a Python worker remembers; beyond it starts anew.
REMEMBERED = 2_000_000

# Fixed value: the tokenizer file's split pattern, applied to lower-cased text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _part int, _rank bigint, ids binary"
)


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit integers; words are encoded once per worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = Splitter(WORDS)
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        plain = word if word.isascii() and word.isprintable() else self.as_bytes.pre_tokenize_str(word)[0][0]
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(plain))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in SPECIAL):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        # in Latin texts lower() works by character and NFC changes nothing
        if is_latin(text) and "İ" not in text:
            text = text.lower()
        else:
            text = self.tokenizer.normalizer.normalize_str(text)
        words = self.split(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            return b"".join([self.known.get(w) or self._word(w) for w in words])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's tokenizer, loaded once."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def class_lengths(capacity: int) -> list[int]:
    """For each remainder, the longest class length that fits it."""
    allowed = int(capacity * WASTE)
    best, out = 0, []
    for r in range(capacity + 1):
        if r and capacity - (capacity // r) * r <= allowed:
            best = r
        out.append(best)
    return out


def cuts(n: int, longest: list[int], capacity: int) -> Iterator[int]:
    """Piece lengths of a document of ``n`` tokens."""
    for _ in range(n // capacity):
        yield capacity
    n %= capacity
    while n:
        yield longest[n]
        n -= longest[n]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str, text: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Tokenise and cut every document; ``_rank`` counts the pieces of a length within a task."""
    longest = class_lengths(capacity)
    types = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
         ("doc_tokens", pa.int64()), ("_part", pa.int32()), ("_rank", pa.int64()), ("ids", pa.binary())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(tokenizer)
        part = pyspark.TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.encode(body.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for length in cuts(n, longest, capacity):
                    own = ids[4 * start : 4 * (start + length)]
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    rows.append((key, start, length, zlib.crc32(own), n, part, rank, own if with_ids else None))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], schema=types
            )

    cols = docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text"))
    return cols.mapInArrow(work, _SCHEMA)


def repack(left: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Bins for the pieces of unfilled bins, longest first: (length, place among them, bin, offset)."""
    out, number, used = [], 0, {length: 0 for length in left}
    while any(left.values()):
        offset = 0
        for length in sorted(left, reverse=True):
            n = min(left[length], (capacity - offset) // length)
            for _ in range(n):
                out.append((length, used[length], number, offset))
                used[length] += 1
                offset += length
            left[length] -= n
        number += 1
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces with their sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null or empty text: the end id alone, one piece of one token. Repeated rows are packed each
    on their own; a null doc_id stays null. No rows give no pieces. Every id lies in exactly one piece, and
    offsets within a sequence have no gap.
    """
    spark, store = docs.sparkSession, Stored(docs.sparkSession)
    cut = store.keep(pieces(docs, tokenizer, doc_id, text, capacity, end_id, with_ids))
    counts = cut.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    # a row per class length, of which the capacity has a fixed number
    totals = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    classes, next_bin, left = [], 0, {}
    for length in sorted(totals):
        per_bin = capacity // length
        full = totals[length] // per_bin
        classes.append((length, per_bin, next_bin, full * per_bin))
        left[length] = totals[length] - full * per_bin
        next_bin += full
    rest = [(length, classes_full[length] + place, next_bin + number, offset)
            for classes_full in [{c[0]: c[3] for c in classes}]
            for length, place, number, offset in repack(left, capacity)]
    class_table = spark.createDataFrame(classes, "length bigint, _per_bin bigint, _base bigint, _in_full bigint")
    rest_table = spark.createDataFrame(rest, "length bigint, _place bigint, _bin bigint, _offset bigint")
    placed = (
        cut.join(firsts, ["_part", "length"])
        .join(F.broadcast(class_table), "length")  # at most one row per class length
        .withColumn("_place", F.col("_first") + F.col("_rank"))
        .join(F.broadcast(rest_table), ["length", "_place"], "left")  # less than a bin per class length
    )
    in_full = F.col("_place") < F.col("_in_full")
    slot = F.col("_place") % F.col("_per_bin")
    bin_of = F.col("_base") + ((F.col("_place") - slot) / F.col("_per_bin")).cast("bigint")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(in_full, bin_of).otherwise(F.col("_bin")).alias("sequence_id"),
        F.when(in_full, slot * F.col("length")).otherwise(F.col("_offset")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
