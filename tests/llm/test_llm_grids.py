"""Inverted multi-index, periodic runs and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stepwell.llm import lexical_search, multi_index, periodic_runs

# --- inverted multi-index


def plain_links(rows, threshold=0.93):
    """vec_id: (links, component) by all pairs."""
    sound = [
        (i, label, np.array(v, float))
        for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    near = defaultdict(set)
    for i, a, x in sound:
        for j, b, y in sound:
            if i != j and a == b and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                near[i].add(j)
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen, default=None, key=lambda x: (x is None, x)))
    return out


def found_links(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
    df = df.selectExpr("*", "1 AS node", "'x' AS `a.b`", "2 AS links", "3 AS cell")
    got = multi_index.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}


def clusters(rng, n, dim, angles):
    """Vectors in small groups at given cosines of a centre, in random directions, so pairs lie on both sides of a threshold."""
    rows, vec_id = [], 0
    while len(rows) < n:
        x = rng.normal(size=dim)
        x /= np.linalg.norm(x)
        for c in [1.0, *rng.choice(angles, rng.integers(0, 4))]:
            g = rng.normal(size=dim)
            g -= (g @ x) * x
            y = (c * x + math.sqrt(1 - c * c) * g / np.linalg.norm(g)) * rng.uniform(0.1, 9)
            rows.append((vec_id, y.astype(np.float32).tolist(), int(rng.integers(0, 3)) if rng.random() < 0.1 else 1))
            vec_id += 1
    return rows[:n]


def test_links_equal_all_pairs_with_full_recall(spark):
    rows = clusters(np.random.default_rng(1), 500, 12, [0.94, 0.97, 0.99, 0.92])
    assert found_links(spark, rows, recall=1.0) == plain_links(rows)


def test_recall_of_neighbours_at_the_threshold(spark):
    """Hardest case: every neighbour barely reaches the threshold."""
    rows = clusters(np.random.default_rng(2), 900, 32, [0.932])
    want = plain_links(rows)
    got = found_links(spark, rows)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_a_cell_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.35).tolist(), 1) for i in range(300)]
    assert found_links(spark, rows, "double", recall=1.0) == plain_links(rows)


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], None),
        (5, [1.0, 0.0, 0.0], 2), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 0.0], 1), (9, [inf, 1.0, 0.0], 1),
        (10, [None, 1.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (13, [5.0, 0.0], 1), (14, [3.0], 1), (None, [1.0, 0.0, 0.0], 1),
        (15, [1e-30, 0.0, 0.0], 1),
    ]
    got = found_links(spark, rows + rows[:1])
    assert got == plain_links(rows)
    assert got[1] == (3, 1) and got[4] == (0, 4) and got[12] == (1, 12) and got[None] == (0, None)
    assert found_links(spark, []) == {}


def test_one_vector_that_a_third_of_the_rows_share(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [0.6, 0.8, 0.0, 0.1] if i % 3 == 0 else rng.normal(size=4).tolist(), 1) for i in range(600)]
    assert found_links(spark, rows, "double", recall=1.0) == plain_links(rows)


def test_walk_visits_cells_in_order_and_misses_none():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = (np.sort(np.r_[0, rng.random(7)]) for _ in range(2))
        i, j = rng.permutation(8), rng.permutation(8)
        got = multi_index._multi_sequence(x, y, i, j, 8, -1, 0.8)
        bound = {int(i[a] * 8 + j[b]): x[a] + y[b] for a in range(8) for b in range(8)}
        assert sorted(got) == sorted(c for c, v in bound.items() if v <= 0.8)
        assert [bound[c] for c in got] == sorted(bound[c] for c in got)


# --- periodic runs


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(12, 2 * p):
                found.setdefault((s, i + p - s), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_runs():
    rng = random.Random(1)
    docs = [[], [b"a"], [b"a"] * 11, [b"a"] * 12, [b"a"] * 40]
    for _ in range(800):
        words = [bytes([97 + rng.randrange(rng.choice([1, 2, 3, 5]))]) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // (3 + rng.randrange(8))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        docs.append(words)
    got = periodic_runs.runs_of(docs)
    assert got == [plain_runs(d) for d in docs]
    assert sum(map(len, got)) > 300


@pytest.mark.parametrize(
    "words, runs",
    [
        ([b"a"] * 20_000, [(0, 20_000, 1)]),
        ([b"w%d" % (i % 10) for i in range(50_000)], [(0, 50_000, 10)]),
        ([b"w%d" % (i % 6667) for i in range(20_000)], [(0, 20_000, 6667)]),
        # a phrase with another word before it each time
        ([w for i in range(9_000) for w in (b"u%d" % i, *b"a b c d e f g".split())], []),
    ],
)
def test_long_texts_in_reasonable_time(words, runs):
    assert periodic_runs.runs_of([words]) == [runs]


def test_runs_of_awkward_rows(spark):
    line = "one two three four five six "
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, line * 3), (4, line * 3), (None, "x " * 30), (5, "é b " * 12), (6, "y" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 AS runs", "8 AS `a.b`", "9 AS n_words")
    got = sorted(periodic_runs.detect(docs).collect(), key=str)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert len(got) == len(rows)
    assert by[1] == by[2] == by[3] == [(0, [], "")]
    assert by[4] == [(18, [(0, 18, 6)], line.strip())] * 2
    assert by[None] == [(30, [(0, 30, 1)], "x")]
    assert by[5] == [(12, [(0, 12, 1)], "é b")]
    assert by[6] == [(1, [], "y" * 300_000)]
    assert periodic_runs.detect(docs.limit(0)).collect() == []


# --- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k=10):
    terms = lambda text: TERM.findall((text or "").translate(SMALL))
    counted = [(i, Counter(terms(text))) for i, text in docs if i is not None]
    n_docs = sum(bool(c) for _, c in counted)
    length = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in counted:
            score = 0
            for t in words & set(c):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + 90 * sum(c.values()) * n_docs // length
                score += weight * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, place, i, -score) for place, (score, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found_ranks(spark, docs, items, partitions=3, **options):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(partitions)
    docs = docs.selectExpr("*", "1 AS block", "2 AS `a.b`", "3 AS item_id")
    items = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "4 AS row", "5 AS doc_id")
    return sorted(tuple(r) for r in lexical_search.rank(docs, items, **options).collect())


def test_ranks_equal_plain_ranks(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["The", "ÉTÉ", "été", "naïve"]
    text = lambda n: " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(n))
    docs = [(i * 3, text(rng.randint(1, 80))) for i in range(400)]
    # a third are copies of one text, so most places are ties
    docs += [(5000 - i, "w1 w2, w3; THE-w59") for i in range(200)]
    items = [(i, text(rng.randint(1, 20))) for i in range(40)] + [(99, "w1 w3 the w59"), (99, "w2")]
    assert found_ranks(spark, docs, items) == plain_ranks(docs, items)


def test_ranks_of_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "a b"), (4, "a b"), (None, "a a a"), (5, "a " * 50_000 + "rare"), (-6, "B")]
    items = [(1, "A"), (2, None), (3, ""), (None, "a"), (4, "nowhere"), (5, "rare b a a"), (5, "rare b a a")]
    assert found_ranks(spark, docs, items) == plain_ranks(docs, items)
    assert found_ranks(spark, docs, items, k=1) == plain_ranks(docs, items, 1)
    assert found_ranks(spark, [], items) == [] == found_ranks(spark, docs, [])


def test_blocks_and_packs_change_nothing(spark, monkeypatch):
    """Items in several packs; blocks follow from partitions."""
    rng = random.Random(8)
    docs = [(i, " ".join(f"t{int(30 * rng.random() ** 3)}" for _ in range(30))) for i in range(300)]
    items = [(i, " ".join(f"t{rng.randrange(30)}" for _ in range(6))) for i in range(50)]
    want = plain_ranks(docs, items)
    assert found_ranks(spark, docs, items, partitions=1) == want
    monkeypatch.setattr(lexical_search, "PACK", 7)
    assert found_ranks(spark, docs, items, partitions=16) == want


def test_treap_round_trip():
    rng = np.random.default_rng(0)
    rows, columns = np.unravel_index(rng.choice(70 * 40, 300, replace=False), (70, 40))
    impacts = rng.integers(1, 10**6, 300)
    built = lexical_search.Treap.build(rows, columns, impacts, 70, 40)
    read = lexical_search.Treap.load(built.height, **built.dump())
    for name in ("masks", "most", "first"):
        assert (getattr(built, name) == getattr(read, name)).all()


def test_registered_runs_equal_a_plain_version(spark):
    """Texts with planted periods, digests and all, from the contract's words alone."""
    pytest.importorskip("public_tokenizers")
    from stepwell.llm import registry

    sf_dir = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in registry.op12_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    compared = 0
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if n > 3000:
            continue  # the plain version takes the square of it
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        assert got[doc_id] == (doc_id, len(runs), *told, *digests)
        compared += 1
    assert compared > 150
