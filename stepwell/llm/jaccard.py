"""Exact Jaccard join of documents on word shingles, as a metric-space join with pivots.

Jaccard distance is a metric, and two documents link at a distance of 0.25 or less.

Documents with equal sets are one node. Regions come from the rare ends of the sets:
two linked sets share one of the first quarter of each other's elements, in any order that
both follow, so each element is the region of the nodes that have it there. Frequent elements are put
last in the order, so a passage that a third of the documents share makes no region unless
documents consist of such passages.

In each region the node of least hash is the pivot, and nodes are first compared with the pivots they share most
regions with. Nodes within 0.25 of one pivot are connected through it, so a large group of near
copies costs one comparison each. Large regions are joined as a whole, in blocks: first with some pivots, then with all
nodes that these leave outside the largest component. What is left joins recursively: in a region whose nodes are not yet
connected, those outside its largest component are the next pivots, and every node of
another component is compared with them, unless the triangle inequality rules it out: the distances of two linked nodes to any
third one differ by 0.25 at most. A pivot that has met all of its region leaves it. When no region
holds two unconnected nodes, every link has been tested or is implied by a path of links.

Elements are 64-bit hashes of shingles, nodes 64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.common import Stored, column
from stepwell.llm.components import components, merged
from stepwell.llm.shingles import fingerprint, prefix_length, shingle_sets, similar

DISTANCE = 0.25
#: An element in so many nodes goes to the end of the order; at most so many elements do, the most frequent ones.
FREQUENT, MOST_FREQUENT = 16, 400_000
#: A task counts an element that it meets this often itself, instead of sending each place of it.
LOCAL = 32
#: Pivots that a node is compared with at first; pivots per region and round after that.
FIRST_PIVOTS, ROUND_PIVOTS = 2, 32
#: Regions of more nodes are joined in blocks: so many nodes, and pivots, per task; pivots of the first of two passes.
SMALL_REGION, BLOCK, BLOCK_PIVOTS, SCOUTS = 64, 512, 1024, 256
CHUNK_BYTES = 1 << 20
#: Pairs whose sets a task holds at once.
PAIRS = 256

_MESSAGE = pa.schema(
    [("owner", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int8()), ("size", pa.int64()), ("h", pa.binary()),
     ("node", pa.binary())]
)
_MESSAGE_DDL = "owner int, chunk bigint, kind tinyint, size bigint, h binary, node binary"
_FREQUENT = pa.schema([("key", pa.int64()), ("n", pa.int64())])
#: Kinds of messages and findings: elements with their nodes; frequent elements with counts; nodes with counts.
PLACES, ELEMENTS, NODES = 0, 1, 2


def _zip(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(body: bytes, size: int) -> bytes:
    return pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _chunks(batches: Iterator[pa.RecordBatch], text_of) -> Iterator[tuple[list, list[str]]]:
    """First columns of the rows (as tuples) and texts, in chunks of bounded size; the text is last, or made by ``text_of``."""
    rows, texts, size = [], [], 0
    for batch in batches:
        keys = zip(*[c.to_pylist() for c in batch.columns[:-1]]) if batch.num_columns > 1 else [()] * batch.num_rows
        for key, body in zip(keys, batch.columns[-1]):
            text = text_of(key, body.as_py())
            if texts and size + len(text) > CHUNK_BYTES:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield rows, texts


def _plain(key: tuple, body: str | None) -> str:
    return body or ""


def _zipped(key: tuple, body: bytes) -> str:
    return _unzip(body, key[-1]).decode()


def _rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def sets_of(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, mark, text): doc_id, mark, node (hash of its set), n (size of it)."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _chunks(batches, _plain):
            yield _rows_of(schema, [(*k, fingerprint(h), len(h)) for k, h in zip(keys, shingle_sets(texts))])

    return docs.mapInArrow(work, "doc_id bigint, mark bigint, node bigint, n bigint")


def _first(hashes: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` elements in the order of their hashes, frequent ones last."""
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        often = frequent[place] == hashes
        hashes = np.r_[hashes[~often], hashes[often]]
    return hashes[:n]


def _sent(docs: DataFrame, text_of, frequent: np.ndarray, owners: int) -> DataFrame:
    """Messages with the first elements of every set, by the owner of their hash.

    An element that a chunk meets often goes as its count, and the nodes that hold such ones as their number. Answers go
    back to the chunk.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = pyspark.TaskContext.get().partitionId() << 32
        for _, texts in _chunks(batches, text_of):
            chunk += 1
            firsts, nodes = [], []
            for node, hashes in {fingerprint(h): h for h in shingle_sets(texts) if len(h)}.items():
                own = _first(hashes, frequent, prefix_length(len(hashes)) + spare(len(hashes)))
                firsts.append(own)
                nodes.append(np.full(len(own), node, np.int64))
            if not firsts:
                continue
            h, node = np.concatenate(firsts), np.concatenate(nodes)
            values, back, count = np.unique(h, return_inverse=True, return_counts=True)
            many = count >= LOCAL
            often = many[back]
            holders, held = np.unique(node[often], return_counts=True)
            kinds = [(PLACES, h[~often], node[~often]), (ELEMENTS, values[many], count[many]), (NODES, holders.view(np.uint64), held)]
            out = []
            for kind, keys, other in kinds:
                owner = (keys % np.uint64(owners)).astype(np.int32)
                order = np.argsort(owner, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                    if len(part):
                        body = _zip(keys[part].tobytes()), _zip(other[part].astype(np.int64).tobytes())
                        out.append((int(owner[part[0]]), chunk, kind, len(part), *body))
            yield _rows_of(_MESSAGE, out)

    return docs.mapInArrow(work, _MESSAGE_DDL)


def _shared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Per chunk its nodes with the number of their elements that others share; and the most frequent elements."""
    got: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {PLACES: [], ELEMENTS: [], NODES: []}
    for batch in batches:
        for _, chunk, kind, n, h, other in zip(*[c.to_pylist() for c in batch.columns]):
            keys, values = np.frombuffer(_unzip(h, 8 * n), np.uint64), np.frombuffer(_unzip(other, 8 * n), np.int64)
            got[kind].append((keys, values, np.full(n, chunk)))

    def columns(kind: int) -> list[np.ndarray]:
        parts = got.pop(kind)
        return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(("u8", "i8", "i8"))]

    h, node, chunk = columns(PLACES)
    element, times, _ = columns(ELEMENTS)
    order = np.lexsort((node, h))
    fresh = np.ones(len(h), bool)
    fresh[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (node[order[1:]] != node[order[:-1]])
    values, back = np.unique(np.r_[h, element], return_inverse=True)
    total = np.bincount(back, weights=np.r_[fresh, times], minlength=len(values)).astype(np.int64)
    shared = (total >= 2)[back[: len(h)]]
    more, also, of_chunk = columns(NODES)
    node = np.r_[node[shared], more.view(np.int64)]
    chunk, weight = np.r_[chunk[shared], of_chunk], np.r_[np.ones(shared.sum(), np.int64), also]
    order = np.lexsort((node, chunk))
    node, chunk, weight = node[order], chunk[order], weight[order]
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (chunk[1:] != chunk[:-1])][: len(node)])
    held = np.add.reduceat(weight, first) if len(first) else weight
    node, chunk = node[first], chunk[first]
    out = []
    for part in np.split(np.arange(len(node)), np.flatnonzero(np.diff(chunk)) + 1):
        if len(part):
            out.append((0, int(chunk[part[0]]), NODES, len(part), _zip(node[part].tobytes()), _zip(held[part].tobytes())))
    often = np.flatnonzero(total >= FREQUENT)
    often = often[np.argsort(-total[often], kind="stable")[:most]]
    if len(often):
        out.append((0, -1, ELEMENTS, len(often), _zip(values[often].tobytes()), _zip(total[often].tobytes())))
    yield _rows_of(_MESSAGE, out)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node of a chunk the number of its shared elements, from the answers of all owners."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for _, chunk, _, n, h, other in zip(*[c.to_pylist() for c in batch.columns]):
            pair = np.frombuffer(_unzip(h, 8 * n), np.int64), np.frombuffer(_unzip(other, 8 * n), np.int64)
            parts.setdefault(chunk, []).append(pair)
    for found in parts.values():
        keys, back = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([b for _, b in found])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], schema=_FREQUENT)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent elements, a row each."""
    for batch in batches:
        for _, _, _, n, h, other in zip(*[c.to_pylist() for c in batch.columns]):
            pair = np.frombuffer(_unzip(h, 8 * n), np.int64), np.frombuffer(_unzip(other, 8 * n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], schema=_FREQUENT)


def spare(n: int) -> int:
    """Elements that a set takes beyond its ``prefix_length``: linked sets then share ``n // 16`` of their first ones.

    Each shares with the other one more than its own spare ones, or than those of the smaller set; of two sizes
    that can link, these differ by less than what the larger overlap adds, but for rounding by one.
    """
    return n // 16


def regions(docs: DataFrame, rows: DataFrame, store: Stored) -> tuple[DataFrame, DataFrame]:
    """Members of the regions (h, node), and the texts of the nodes in them (node, size, body)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = np.zeros(0, np.uint64)
    # one row stands for all rows of its set
    order = F.struct("doc_id", "mark")
    nodes = store.keep(rows.filter("n > 0").groupBy("node", "n").agg(F.min(order).alias("x")).select("node", "n", "x.*"))
    texts = None
    for _ in range(2):
        source, text_of = (docs.select("text"), _plain) if texts is None else (texts.select("size", "body"), _zipped)
        sent = _sent(source, text_of, frequent, parts).repartition(parts, "owner")
        found = store.keep(sent.mapInArrow(lambda b: _shared(b, 2 * MOST_FREQUENT // parts), _MESSAGE_DDL))
        often = found.filter(F.col("kind") == ELEMENTS).mapInArrow(_listed, "key bigint, n bigint")
        top = often.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).select("key").toPandas()
        frequent = np.union1d(frequent, top["key"].to_numpy(np.int64).view(np.uint64))
        answers = found.filter(F.col("kind") == NODES).repartition(parts, "chunk").mapInArrow(_summed, "key bigint, n bigint")
        # a set that several chunks hold is counted whole in each
        shared = answers.groupBy(F.col("key").alias("node")).agg(F.max("n").alias("c"))
        nodes = store.keep(nodes.join(shared, "node").filter(F.expr("c >= greatest(1, n div 16)")).drop("c"))
        if texts is None:
            named = nodes.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("e"), "mark", "node")
            zipped = _zipped_texts(docs).select(
                F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("e"), "mark", "size", "body"
            )
            joined = zipped.join(named, ["k", "e", "mark"]).dropDuplicates(["k", "e", "mark"])
            texts = store.keep(joined.select("node", "size", "body"))
        else:
            kept = store.keep(texts.join(nodes.select("node"), "node", "left_semi"))
            store.drop(texts)
            texts = kept
        store.drop(found)
    return _members(texts, frequent), texts


def _zipped_texts(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _chunks(batches, _plain):
            raw = [t.encode("utf-8", "replace") for t in texts]
            yield _rows_of(schema, [(*k, len(r), _zip(r)) for k, r in zip(keys, raw)])

    return docs.mapInArrow(work, "doc_id bigint, mark bigint, size bigint, body binary")


def _members(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(h, node): the first elements of every node's set."""
    schema = pa.schema([("h", pa.int64()), ("node", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in _chunks(batches, _zipped):
            firsts = [_first(h, frequent, prefix_length(len(h))) for h in shingle_sets(bodies)]
            node = np.repeat(np.array([k[0] for k in keys], np.int64), [len(f) for f in firsts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(node)], schema=schema)

    return texts.select("node", "size", "body").mapInArrow(work, "h bigint, node bigint")


def _distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked, d) of every pair (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("d", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in (b.slice(i, PAIRS) for b in batches for i in range(0, b.num_rows, PAIRS)):
            a, b = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            need: dict[int, str] = {}
            for nodes, body, size in ((a, batch.column(1), batch.column(2)), (b, batch.column(4), batch.column(5))):
                for i, node in enumerate(nodes):
                    if node not in known and node not in need:
                        need[node] = _unzip(body[i].as_py(), size[i].as_py()).decode()
            known |= dict(zip(need, shingle_sets(list(need.values())))) if need else {}
            out = [(x, y, *similar(known[x], known[y])) for x, y in zip(a, b)]
            yield _rows_of(schema, out)
            last = {a[-1]} if a else set()
            known = {k: v for k, v in known.items() if k in last}

    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("body").alias(f"{name}_body"), F.col("size").alias(f"{name}_size"))

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "a_body", "a_size", "b", "b_body", "b_size").mapInArrow(work, "a bigint, b bigint, linked boolean, d double")


def _comparable(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= 75 * greatest({a}, {b})"


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null or empty text: an empty set, linked with nothing; the component is the row itself. Rows
    with equal sets are always linked, repeated rows too. A null id takes part but names
    no component unless all of it is null. No rows give no rows.
    """
    store = Stored(docs.sparkSession)
    rows, labels = _groups(docs, doc_id, text, store)
    return _with_components(rows, labels)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row of smallest id stays.

    Of a group without an id, or rows that repeat the smallest id, one text stays, once. Rows without
    a shingle belong to no group and stay.
    """
    store = Stored(docs.sparkSession)
    rows, labels = _groups(docs, doc_id, text, store)
    full = rows.filter("n > 0").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # nulls last; the hash of the text tells rows of one id apart
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("mark").alias("c"))
    best = full.groupBy("label").agg(F.min(order).alias("x")).select(F.col("x.b").alias("_b"), F.col("x.c").alias("_c"))
    body = F.col("_text")
    own = docs.select(
        F.struct("*").alias("_row"), column(doc_id).cast("bigint").alias("_id"), column(text).cast("string").alias("_text")
    ).withColumn("_mark", F.xxhash64(body))
    same = F.col("_id").eqNullSafe(F.col("_b")) & (F.col("_mark") == F.col("_c"))
    kept = own.join(best, same, "left_semi")
    times = rows.filter("n > 0").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not times.isEmpty():
        kept = kept.dropDuplicates(["_id", "_mark"])
    blank = rows.filter("n = 0").select(F.col("doc_id").alias("_b"), F.col("mark").alias("_c")).distinct()
    if not blank.isEmpty():
        kept = kept.unionByName(own.join(blank, same, "left_semi"))
    return kept.select("_row.*")


def _groups(docs: DataFrame, doc_id: str, text: str, store: Stored) -> tuple[DataFrame, DataFrame]:
    """Rows with their node, and the component (node, label) of every linked node."""
    body = column(text).cast("string")
    own = docs.select(column(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    rows = store.keep(sets_of(own))
    members, texts = regions(own, rows, store)
    members = store.keep(members)
    sizes = store.keep(rows.join(texts.select("node"), "node", "left_semi").groupBy("node").agg(F.max("n").alias("n")))
    tested, labels = None, None

    def label(links: DataFrame) -> None:
        nonlocal labels
        before = labels
        labels = store.keep(components(links, store) if before is None else merged(before, links, store))
        if before is not None:
            store.drop(before)

    def check(pairs: DataFrame) -> None:
        nonlocal tested
        found = store.keep(_distances(pairs, texts))
        tested = found if tested is None else tested.unionByName(found)
        label(found.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))

    # first round: every node with the pivots of most of its regions; nodes are hashes, so the least is any of them
    pivots = members.groupBy("h").agg(F.min("node").alias("p"), F.max("node").alias("_max")).filter("p <> _max")
    pairs = members.join(pivots.select("h", "p"), "h")
    shared = pairs.groupBy("node", "p").agg(F.count(F.lit(1)).alias("c")).filter("node <> p")
    order = Window.partitionBy("node").orderBy(F.desc("c"), "p")
    first = shared.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= FIRST_PIVOTS)
    check(first.select(F.col("p").alias("a"), F.col("node").alias("b")))
    first_tested = tested

    # large regions: all that they connect is one cluster, joined in blocks by its pivots
    sized = store.keep(members.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("p")).filter("c > 1"))
    large = members.join(sized.filter(F.col("c") > SMALL_REGION).select("h", "p"), "h")
    clusters = store.keep(components(large.select(F.col("node").alias("u"), F.col("p").alias("v")).distinct(), store))
    for scouts in (True, False) if not clusters.isEmpty() else ():
        label(store.keep(_block_links(clusters, labels, texts, scouts)))
    members = store.keep(members.join(sized.filter(F.col("c") <= SMALL_REGION).select("h"), "h"))

    while True:
        labelled = sizes.join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"))
        open_members = members.join(labelled, "node")
        spread = open_members.groupBy("h").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        spread = spread.filter("_lo <> _hi").select("h")
        open_members = store.keep(open_members.join(spread, "h").select("h", "node", "n", "label"))
        largest = open_members.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
        largest = largest.groupBy("h").agg(F.max(F.struct("c", "label")).alias("x")).select("h", F.col("x.label").alias("main"))
        outside = open_members.join(largest, "h").filter("label <> main")
        least = Window.partitionBy("h").orderBy("node")
        chosen = outside.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= ROUND_PIVOTS)
        chosen = store.keep(chosen.select("h", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl")))
        if chosen.isEmpty():
            break
        met = open_members.join(chosen, "h").filter(F.expr(f"label <> pl and {_comparable('n', 'pn')}"))
        met = met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = store.keep(met.join(done, ["a", "b"], "left_anti"))
        check(_within_windows(met, first_tested))
        members = store.keep(
            open_members.join(chosen.select("h", F.col("p").alias("node")), ["h", "node"], "left_anti").select("h", "node")
        )
        store.drop(open_members, chosen, met)
    return rows, labels


def _block_links(clusters: DataFrame, labels: DataFrame, texts: DataFrame, scouts: bool) -> DataFrame:
    """Links (u, v) that connect each cluster (node, label) as all links of its pivots do.

    Pivots are the ``SCOUTS`` least nodes of a cluster first, then all nodes outside its largest component: a pair
    without a pivot is connected already. Every task compares a block of nodes with a block of pivots, as sorted sets; what it
    returns is a spanning forest of the links it found, one row per node at most.
    """
    own = clusters.select("node", F.col("label").alias("cluster"))
    known = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = known.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    totals = sizes.groupBy("cluster").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("x"))
    totals = totals.select("cluster", "total", F.col("x.label").alias("main"))
    joined = known.join(totals, "cluster")
    if scouts:
        least = Window.partitionBy("cluster").orderBy("node")
        chosen = joined.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= SCOUTS).drop("_r")
    else:
        chosen = joined.filter("label <> main")
    counts = chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("pivots"))
    blocks, rows = F.expr(f"1 + total div {BLOCK}"), F.expr(f"1 + pivots div {BLOCK_PIVOTS}")
    bodies = texts.select("node", "size", "body")

    def spread(side: DataFrame, own_block: str, over: str) -> DataFrame:
        other = "q" if own_block == "b" else "b"
        laid = side.join(counts, "cluster").withColumns({"blocks": blocks, "rows": rows})
        laid = laid.withColumn(own_block, F.expr(f"pmod(xxhash64(node), {'blocks' if own_block == 'b' else 'rows'})"))
        laid = laid.join(bodies, "node").withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(over) - 1)))
        return laid.select(*[F.col(c).alias(c) for c in ("cluster", "b", "q", "node", "label", "size", "body")])

    links = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(nodes: pa.Table, pivots: pa.Table) -> pa.Table:
        def sets(t: pa.Table) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
            bodies = [_unzip(x, n).decode() for x, n in zip(t["body"].to_pylist(), t["size"].to_pylist())]
            return t["node"].to_pylist(), t["label"].to_numpy().copy(), shingle_sets(bodies) if bodies else []

        keys, label, own = sets(nodes)
        pivot_keys, pivot_label, others = sets(pivots)
        if not own or not others:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        sizes = np.array(list(map(len, own)))
        every, owner = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        out = []
        for i, (key, x) in enumerate(zip(pivot_keys, others)):
            lo, hi = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
            n = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(own))
            linked = np.flatnonzero((100 * both >= 75 * (len(x) + sizes - both)) & (label != pivot_label[i]))
            # one link to each component; they are one from then on
            for old, first in zip(*np.unique(label[linked], return_index=True)):
                out.append((key, keys[linked[first]]))
                label[label == old] = pivot_label[i]
                pivot_label[pivot_label == old] = pivot_label[i]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], schema=links)

    left = spread(joined.select("cluster", "node", "label", "total"), "b", "rows")
    right = spread(chosen.select("cluster", "node", "label", "total"), "q", "blocks")
    grouped = left.groupBy("cluster", "b", "q").cogroup(right.groupBy("cluster", "b", "q"))
    return grouped.applyInArrow(compare, "u bigint, v bigint").distinct()


def _within_windows(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs that the triangle inequality does not rule out by their distances to one of their first pivots.

    A node has at most ``FIRST_PIVOTS`` of these, so no pair is multiplied.
    """
    to_a = first.select(F.col("a").alias("q"), F.col("b").alias("a"), F.col("d").alias("da"))
    to_b = first.select(F.col("a").alias("q"), "b", F.col("d").alias("db"))
    far = pairs.join(to_a, "a").join(to_b, ["q", "b"]).filter(F.abs(F.col("da") - F.col("db")) > DISTANCE + 1e-9)
    return pairs.join(far.select("a", "b").distinct(), ["a", "b"], "left_anti")


def _with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = rows.select("doc_id", "node", "n").join(labels, "node", "left")
    full = named.filter("n > 0").withColumn("label", F.coalesce("label", "node"))
    least = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = full.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(
        named.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )
