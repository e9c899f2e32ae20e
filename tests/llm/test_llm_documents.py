"""The document operators against plain versions, over tables with awkward rows."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import llm_cases as cases  # noqa: E402
import public_tokenizers  # noqa: E402
from stepwell.llm import bpe, jaccard, license_scan, packing, quality_rules, repeats, sharding  # noqa: E402
from stepwell.llm.shingles import prefix_length, shingle_sets  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).repartition(5).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_licences(docs, texts):
    got = counted(license_scan.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == Counter((key, *cases.base_licences(t)) for key, t in texts)


def test_licence_templates(spark):
    rows = [
        (1, "x " * 30 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (2, "licensed under CC BY-NC 4.0"),
        (3, "software granted person copy charge free"),
        (4, "Kelvin K mit license"),
    ]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1].labels == "mit" and found[1].base_labels == "" and found[1].score > 0.9
    assert found[2].labels == "cc-by,cc-by-nc"
    assert found[3].labels == "" and found[3].score == 0
    assert found[4].base_labels == "mit" and found[4].first_word == 2


def test_key_phrases_stand_word_for_word(spark):
    rows = [
        (1, "licensed under cc or nc 4 0"),
        (2, "licensed under cc and sa 4 0"),
        (3, "permission to use copy modify and or distribute this software for any purpose xx yy without fee"),
        (4, "you may not use this file except for compliance on a license"),
        (5, "you may not use this file except in compliance with the license"),
        (6, "released under THE BSD license"),
        (7, "released into the BSD license"),
        (None, "all rights reserved"),
        (8, "the " * 30_000 + "all rights reserved " * 10_000),
    ]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i].labels for i in (1, 2, 3, 4, 5, 6)] == ["", "", "", "", "apache", "bsd"]
    assert found[6].score == 1 and found[7].score == 0.8 and found[7].labels == "bsd"
    assert found[None].labels == "proprietary" and found[8].labels == "proprietary"


def test_licence_labels_and_score_against_brute_force(spark, docs, texts):
    extra = [t for _, t, _ in license_scan.TEMPLATES]
    # one word of each template replaced in turn, and a template cut short
    for n, (_, text, _) in enumerate(license_scan.TEMPLATES):
        words = text.split()
        extra += [" ".join([*words[: n % len(words)], "zz", *words[n % len(words) + 1 :]]), " ".join(words[: len(words) * 2 // 3])]
    rows = [*enumerate(extra), *((1000 + i, t) for i, (_, t) in enumerate(texts))]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {key: cases.licence_labels(t, license_scan.TEMPLATES, license_scan.SHARE, license_scan.COMMON, license_scan.NEAR) for key, t in rows}


def test_common_words_of_templates_stand_near_rarer_ones():
    for _, text, phrase in license_scan.TEMPLATES:
        for words in (text.split(), phrase.split()):
            rare = [i for i, w in enumerate(words) if w not in license_scan.COMMON]
            assert all(min(abs(i - r) for r in rare) <= license_scan.NEAR for i in range(len(words))), words


def test_several_licences_in_one_file(spark):
    texts = {" ".join(labels): [t for label, t, _ in license_scan.TEMPLATES if label in labels] for labels in (
        ["bsd", "mit", "proprietary"], ["apache", "mpl", "proprietary"], ["isc", "gpl", "lgpl", "unlicense", "cc0", "proprietary"],
    )}
    rows = [(i, " x y ".join(t)) for i, t in enumerate(texts.values())]
    rows.append((10, " \n".join(t for _, t, _ in license_scan.TEMPLATES)))
    rows.append((11, "copy free person charge domain distribute binary, all rights reserved"))
    rows.append((12, "rights all reserved"))
    # every other word is in fewer documents than those of "all rights reserved"
    rows += [(100 + i, "all rights reserved") for i in range(20)]
    found = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i].split(",") for i in range(3)] == [sorted(names.split()) for names in texts]
    assert found[10].split(",") == sorted({label for label, _, _ in license_scan.TEMPLATES})
    assert found[11] == "proprietary" and found[12] == ""
    assert all(found[100 + i] == "proprietary" for i in range(20))


def test_quality_measures(docs, texts):
    got = counted(quality_rules.judge(docs, carry=["doc_id"]).select("_row.doc_id", *quality_rules.MEASURES, "base_failed"), "*")
    want = Counter()
    for key, text in texts:
        m = cases.base_rules(text)
        want[(key, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want


def test_quality_thresholds_follow_the_source(spark):
    words = [f"w{i}" for i in range(80)]
    clean = [(i, " ".join(words[i % 7 :] + [str(i)]), "en", "plain") for i in range(150)]
    noisy = [(1000 + i, " ".join(w + "#" * (j % 2) for j, w in enumerate(words)) + str(i), "en", "code") for i in range(150)]
    odd = [(2000, " ".join(w + "##" for w in words), "en", "plain"), (2001, " ".join(w + "#" * (j % 2) for j, w in enumerate(words)), "en", "plain")]
    df = spark.createDataFrame(clean + noisy + odd, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.filter_documents(df).collect()}
    assert set(range(150)) <= kept and set(range(1000, 1150)) <= kept
    assert not kept & {2000, 2001}


@pytest.mark.parametrize("n_junk", [30, 80])
def test_junk_does_not_move_its_own_limit(spark, n_junk):
    words = [f"w{i}" for i in range(80)]
    clean = [(i, " ".join(words[i % 7 :] + [str(i)]), "en", "spam") for i in range(200 - n_junk)]
    symbols = [(1000 + i, " ".join(w + "#" * (j % 2) for j, w in enumerate(words)) + str(i), "en", "spam") for i in range(n_junk)]
    # three lines stand twice, and with them less than half of the words
    lines = [" ".join(words[k * 8 : k * 8 + 8]) for k in range(10)]
    repeats = [(2000 + i, "\n".join([*lines, *lines[:3]]) + f"\n{i}", "de", "spam") for i in range(n_junk)]
    german = [(3000 + i, "\n".join(lines) + f"\n{i}", "de", "spam") for i in range(200 - n_junk)]
    df = spark.createDataFrame(clean + symbols + repeats + german, "doc_id bigint, text string, lang string, source string")
    judged = {r.doc_id: r for r in quality_rules.judge(df, carry=["doc_id"]).select("_row.doc_id", "base_failed", "kept").collect()}
    assert not any(r.base_failed for r in judged.values())
    assert {key for key, r in judged.items() if r.kept} == {row[0] for row in clean + german}


def test_every_limit_follows_its_group(spark):
    """Two sources whose documents have some symbols, repeats and so on: few and small ones, or more and larger ones."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        source, share, size = ("calm", 0.6, 1) if i % 2 else ("lively", 0.8, 6)
        words = [f"w{i}x{j}" for j in range(200)]
        if rng.random() < share:
            for k in range(size):
                words[10 * k] += "#!"
                words[10 * k + 5] = f"AAAA{k}"
        lines = [" ".join(words[j : j + 10]) for j in range(0, 200, 10)]
        if rng.random() < share:
            lines[1 : 1 + size] = [lines[0]] * size
        rows.append((i, "\n".join(lines), "en", source, 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    measured = quality_rules.measures(df).select("_m", F.col("_row.lang").alias("_lang"), F.col("_row.source").alias("_source"))
    found = {r._source: r for r in quality_rules.limits(measured).collect()}
    for ratio in quality_rules.RATIOS:
        assert abs(found["calm"][f"max_{ratio}"] / found["lively"][f"max_{ratio}"] - 1) > 0.02, ratio
    assert found["calm"].max_repeat_ratio < found["lively"].max_repeat_ratio
    assert quality_rules.filter_documents(df).count() == 600


def test_kept_is_base_and_the_limits_of_the_group(spark, docs):
    """The verdict again from the limits, row by row."""
    measured = quality_rules.measures(docs).select(
        "_m", F.col("_row.doc_id").alias("doc_id"), F.col("_row.lang").alias("_lang"), F.col("_row.source").alias("_source")
    )
    cut = {(r._lang, r._source): r for r in quality_rules.limits(measured).collect()}
    want = Counter()
    for r in measured.collect():
        m, limit = r._m, cut[r._lang, r._source]
        failed = m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words
        want[r.doc_id, not failed and all(m[x] <= limit[f"max_{x}"] for x in quality_rules.RATIOS)] += 1
    assert counted(quality_rules.judge(docs, carry=["doc_id"]).select("_row.doc_id", "kept"), "*") == want


def test_quality_limits_are_tighter_where_a_source_varies_little(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]

    def text(i, n):
        return " ".join(w.capitalize() if j < n else w for j, w in enumerate(words)) + f" {i}"

    rows = [(i, text(i, 10 + i % 5), "en", "plain") for i in range(150)] + [(1000, text(1000, 60), "en", "plain")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.filter_documents(df).collect()} == set(range(150))


def test_near_copies(docs, texts):
    got = counted(jaccard.join(docs), "doc_id", "n_shingles", "component_id")
    assert got == Counter(cases.components(texts))


def test_one_of_each_group_stays(docs, texts):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    groups = cases.components(texts)
    with_words = {c for (_, n, c) in groups if n and c is not None}
    ids = [key for key, t in rows if key is not None and cases.shingles(t)]
    # a repeated id may name two groups; each keeps one text
    assert set(ids) == with_words
    sets = [cases.shingles(t) for _, t in rows if cases.shingles(t)]
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_shingles_are_whole_texts():
    one, two, few, none = shingle_sets(["A b\tc d e f", "a B c\nd e  f g", "a b", " \n"])
    assert len(one) == 2 and len(two) == 3 and set(one) <= set(two)
    assert len(few) == 1 and len(none) == 0
    assert [prefix_length(n) for n in (0, 1, 4, 8, 9)] == [0, 1, 2, 3, 3]


def test_chains_and_hot_regions(spark):
    base = [f"t{i}" for i in range(400)]
    chain = [(i, " ".join(base[i * 8 : i * 8 + 120])) for i in range(30)]
    boiler = " ".join(f"b{i}" for i in range(60))
    shared = [(100 + i, boiler + " " + " ".join(f"u{i}_{j}" for j in range(60))) for i in range(80)]
    rows = chain + shared
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert counted(jaccard.join(df), "*") == Counter(cases.components(rows))


@pytest.mark.parametrize("shard_segments", [repeats.SHARD_SEGMENTS, 1])
def test_repeated_passages(docs, texts, shard_segments):
    got = repeats.remove(docs, shard_segments=shard_segments, shard_bytes=30_000)
    assert counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(cases.removed(texts))


def test_repeated_passages_leave_the_text(docs):
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.filter("text is null").count() == docs.filter("text is null").count()
    assert cut.filter("n_chars <> length(text)").count() == 0


def test_byte_bpe(docs, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for key, text in texts:
        ids = np.array(own.encode_ordinary(text or ""), "<u4")
        want[key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert counted(bpe.encode(docs, path, public_tokenizers.PATTERN, block_bytes=20_000), "*") == want


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, with_ids=True).collect()
    sequences, of_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        of_doc[p.doc_id].append(p)
    for own_pieces in sequences.values():
        end = 0
        for offset, length in sorted(own_pieces):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    times = Counter(key for key, _ in texts)
    for key, text in texts:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        if times[key] == 1:
            got = sorted(of_doc[key], key=lambda p: p.start)
            assert b"".join(p.ids for p in got) == ids.tobytes()
            assert all(p.doc_tokens == len(ids) for p in got)
    assert sum(p.length for p in pieces) == sum(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)


def test_packing_wastes_little():
    longest = packing.class_lengths(packing.CAPACITY)
    for n in (1, 2, 41, 900, 4095, 4096, 4097, 10_000):
        cut = list(packing.cuts(n, longest, packing.CAPACITY))
        assert sum(cut) == n
        assert all(packing.CAPACITY % c <= packing.CAPACITY * packing.WASTE for c in cut)
    left = {1: 5, 1365: 2, 100: 3}
    assert len(packing.repack(dict(left), 4096)) == 10


def test_sharding(docs):
    for limit in (3_000, 50_000, 10**9):
        rows = sharding.assign(docs, limit, carry=["doc_id"]).collect()
        sizes, members = Counter(), Counter()
        for r in rows:
            assert len(r.shard) == r.depth
            sizes[r.shard] += r.n_bytes
            members[r.shard] += 1
        assert sum(members.values()) == docs.count()
        assert all(size <= limit or members[shard] == 1 for shard, size in sizes.items())
        # no shard is a prefix of another, and none could be joined with its sibling
        names = sorted(sizes)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]) if a != b)
        for shard in names:
            parent = shard[:-1]
            total = sum(s for name, s in sizes.items() if name.startswith(parent))
            assert not shard or total > limit


def test_written_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "out"), 50_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() > 1


@pytest.mark.parametrize(
    "operator",
    [
        license_scan.scan,
        quality_rules.judge,
        quality_rules.filter_documents,
        jaccard.join,
        jaccard.keep_one,
        repeats.remove,
        repeats.without_repeats,
        sharding.assign,
        lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    ],
)
def test_no_rows(spark, operator):
    assert operator(cases.empty(spark)).collect() == []
