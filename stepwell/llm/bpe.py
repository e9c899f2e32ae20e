"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into blocks, and every block sends its distinct pre-tokens, once each, to the
worker that owns their hash. There each distinct word is encoded once, and its ids go back
to the blocks that asked. A block then puts the ids of its documents together in the order
of the pre-tokens, and decodes them by the token-byte table. A word that fills a third of
the corpus costs one entry per block, and long texts are never taken apart into a row per token.

A message holds all words of one block for one owner, so there are as many rows as blocks
times owners, and the number of owners is that of the shuffle partitions. A word's place within
a message is its place among the block's sorted words: the answer needs ids only.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import column
from stepwell.llm.pretokens import Splitter

#: Bytes of text in a block. A longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Distinct words an owner remembers while it answers; beyond it starts anew.
REMEMBERED = 2_000_000

_WORDS = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])
_TEXTS = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])


def _squeeze(body: bytes) -> bytes:
    return pa.compress(body, codec="zstd", asbytes=True)


def _unsqueeze(body: bytes, size: int) -> bytes:
    return pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _as_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _pack(items: list[bytes]) -> bytes:
    """Byte strings one after the other, behind their count and lengths."""
    head = [len(items), *map(len, items)]
    return b"".join([x.to_bytes(4, "little") for x in head] + items)


def _unpack(body: bytes) -> list[bytes]:
    view = memoryview(body).cast("B")
    n = int.from_bytes(view[:4], "little")
    lengths = memoryview(view[4 : 4 + 4 * n]).cast("I")
    out, at = [], 4 + 4 * n
    for length in lengths:
        out.append(bytes(view[at : at + length]))
        at += length
    return out


class ByteBpe:
    """Ranks of a tiktoken file: the encoder of single words and the token-byte table."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.split = Splitter(pattern)

    def word(self, word: bytes) -> bytes:
        ids = self.encoding._encode_single_piece(word)
        return b"".join([i.to_bytes(4, "little") for i in ids])


_loaded: dict[tuple[str, str], ByteBpe] = {}


def bpe_of(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list, list[str]]]:
    """(block, ids of documents, texts) of one task, in order of rows."""
    first = pyspark.TaskContext.get().partitionId() << 32
    keys, texts, size, number = [], [], 0, 0
    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = body.as_py() or ""
            if texts and size + len(text) > block_bytes:
                yield first + number, keys, texts
                keys, texts, size, number = [], [], 0, number + 1
            keys.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield first + number, keys, texts


def _by_owner(words: set[str], owners: int) -> dict[int, list[bytes]]:
    """A block's words, sorted, by the owner of their hash."""
    out: dict[int, list[bytes]] = defaultdict(list)
    for word in sorted(w.encode() for w in words):
        out[zlib.crc32(word) % owners].append(word)
    return out


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Ids of every whole text as little-endian unsigned 32-bit integers, decoded again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, ``decoded``). Null or empty text:
    no ids. One row per input row, repeated ones too; a null doc_id stays null. No rows give no rows.

    The words of a block are found from the same scan twice. Should a rerun ever see other
    rows in a block, the words' checksum differs and the block encodes them itself.
    """
    spark = docs.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = bpe_of(ranks, pattern).split
        for block, _, texts in _blocks(batches, block_bytes):
            words: set[str] = set()
            for body in texts:
                words.update(split(body))
            out = []
            for owner, own in _by_owner(words, owners).items():
                packed = _pack(own)
                out.append((owner, block, len(packed), _squeeze(packed)))
            yield _as_batch(_WORDS, out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = bpe_of(ranks, pattern), {}
        for batch in batches:
            for owner, block, size, body in zip(*[c.to_pylist() for c in batch.columns]):
                raw = _unsqueeze(body, size)
                out = []
                for word in _unpack(raw):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ids = known[word] = bpe.word(word)
                    out.append(ids)
                packed = zlib.crc32(raw).to_bytes(4, "little") + _pack(out)
                yield _as_batch(_WORDS, [(owner, block, len(packed), _squeeze(packed))])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, texts in _blocks(batches, block_bytes):
            marks = [b"" if k is None else k.to_bytes(8, "little", signed=True) for k in keys]
            packed = _pack([x for pair in zip(marks, (t.encode() for t in texts)) for x in pair])
            yield _as_batch(_TEXTS, [(block, len(packed), _squeeze(packed))])

    done = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        + ([("ids", pa.binary()), ("decoded", pa.binary())] if with_ids else [])
    )

    def assemble(texts: pa.Table, answers: pa.Table) -> pa.Table:
        bpe = bpe_of(ranks, pattern)
        replies = {o: (s, b) for o, s, b in zip(*[answers[c].to_pylist() for c in ("owner", "size", "body")])}
        out = []
        for size, body in zip(texts["size"].to_pylist(), texts["body"].to_pylist()):
            items = _unpack(_unsqueeze(body, size))
            keys = [int.from_bytes(k, "little", signed=True) if k else None for k in items[::2]]
            bodies = [bpe.split(t.decode()) for t in items[1::2]]
            del items
            ids_of: dict[str, bytes] = {}
            for owner, own in _by_owner({w for words in bodies for w in words}, owners).items():
                raw = _unsqueeze(replies[owner][1], replies[owner][0]) if owner in replies else b"\0" * 4
                if zlib.crc32(_pack(own)).to_bytes(4, "little") == raw[:4]:
                    ids_of.update(zip((w.decode() for w in own), _unpack(raw[4:])))
                else:
                    ids_of.update((w.decode(), bpe.word(w)) for w in own)
            for key, words in zip(keys, bodies):
                ids = b"".join(map(ids_of.__getitem__, words))
                decoded = b"".join(map(bpe.token_bytes.__getitem__, memoryview(ids).cast("I") if ids else ()))
                digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
                out.append((key, len(ids) // 4, *digests, *((ids, decoded) if with_ids else ())))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * len(done), done)], schema=done)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    words = rows.mapInArrow(ask, "owner int, block bigint, size bigint, body binary")
    ids = words.repartition(owners, "owner").mapInArrow(answer, "owner int, block bigint, size bigint, body binary")
    texts = rows.mapInArrow(carry, "block bigint, size bigint, body binary")
    grouped = texts.groupBy("block").cogroup(ids.groupBy("block"))
    return grouped.applyInArrow(assemble, schema + (", ids binary, decoded binary" if with_ids else ""))
