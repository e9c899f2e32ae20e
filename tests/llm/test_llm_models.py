"""Pages, quality classifier, nearest neighbours, suffix arrays, components, pipeline."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import llm_cases as cases  # noqa: E402
from stepwell.llm import html_text, neighbours, quality_model  # noqa: E402
from stepwell.llm.common import Stored  # noqa: E402
from stepwell.llm.components import components  # noqa: E402
from stepwell.llm.suffix_arrays import eight_bytes, repeated_starts, suffix_array  # noqa: E402

PAGES = {
    "": "",
    "plain text": "plain text",
    "<p>one<p>two": "one\ntwo",
    "<p>a < b &amp; c&nbsp;d<br>e</p>": "a < b & c d e",
    "<p><b>bold start.<br><p>next &quot;one&quot;</p>": 'bold start.\nnext "one"',
    "<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>menu</a></ul></nav>"
    "<div class='ad'>buy</div><article><h1>Head</h1><p>Some text.</p><script>var t='</p>';</script><!-- c --></article>"
    "<footer>&copy; us</footer>": "Head\nSome text.",
    "<body><header><p>site</p></header><main><header><h1>Title</h1></header><section><p>First part here.</p></section>"
    "<section><p>Second part here.</p><ul><li>x<li>y</ul></section><section id='comments'><p>nice</p></section></main>"
    "<form><p>join us</p></form></body>": "Title\nFirst part here.\nSecond part here.\nx\ny",
    "<div class=sidebar>side</div><div><div><p>Hello long text here, yes.</p></div><div><p>More of long text.</p></div></div>":
        "Hello long text here, yes.\nMore of long text.",
    "<article><p>cut off &am": "cut off &am",
    "<div>" * 3000 + "deep": "deep",
    "<p title=\"a>b\">q</p><p hidden>h</p><p style='display: none'>i</p><p>r": "q\nr",
    "<nav>only menu</nav>": "",
    "<form><article><p>A page inside a form.</p></article></form>": "A page inside a form.",
}


def plain_page(links, tag, wrapped):
    """No name, role or tag tells the article from the rest, unless ``tag`` is article."""
    menu = "<div>" + "".join(f"<a href=/s{i}>Section {i}</a> " for i in range(links)) + "</div>"
    told = "The river rose by two feet on that night, and the mill by the bridge stood in the water until the next morning. "
    inner = "<h1>The title</h1>" + "".join(f"<p>{told}{told}{i}</p>" for i in range(10))
    heads = "<div>" + "".join(f"<div><a href=/h{i}>Another headline, number {i} of the day</a></div>" for i in range(6)) + "</div>"
    middle = f"<div>{menu}<{tag}>{inner}</{tag}></div>" if wrapped else f"{menu}<{tag}>{inner}</{tag}>"
    return f"<html><body>{middle}{heads}<div>Copyright 2024 Some Company, all rights reserved</div></body></html>"


@pytest.mark.parametrize("links", [8, 20, 40])
@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("wrapped", [False, True])
def test_density_alone_decides(links, tag, wrapped):
    blocks = html_text.extract(plain_page(links, tag, wrapped)).split("\n")
    assert len(blocks) == 11 and blocks[0] == "The title" and blocks[-1].endswith("morning. 9")


def test_sections_and_headings_beside_the_densest_are_kept():
    told = "The river rose by two feet on that night, and the mill by the bridge stood in the water until morning."
    sections = [f"<div><h2>Part {i}</h2>" + f"<p>{told}</p>" * (3 + i) + "</div>" for i in range(3)]
    page = "<body><div><a href=1>One</a> <a href=2>Two</a></div><h1>Title</h1><div>" + "".join(sections) + "</div></body>"
    blocks = html_text.extract(page).split("\n")
    assert blocks[0] == "Title" and len(blocks) == 1 + 3 + 12


@pytest.mark.parametrize("unit", ["</b>", "</div>", "<b><div><i></b>", "<div>", "<p><i>", "</p></i>", "<li><span>"])
def test_unmatched_tags_take_linear_time(unit):
    start = time.monotonic()
    html_text.extract("<html><body><div>" + unit * (500_000 // len(unit)))
    assert time.monotonic() - start < 2


@pytest.mark.parametrize("source", PAGES)
def test_main_text(source):
    assert html_text.extract(source) == PAGES[source]


PROSE = "<p>First long part of the article, with words.</p><p>Second long part of it, with more words.</p>"
WRAPPED = {
    f"<nav><a href=x>home</a></nav><div class='site-content has-sidebar'>{PROSE}<div class=sidebar>side</div></div>": True,
    f"<div id='with-menu'><div class=menu><a href=x>one</a><a href=y>two</a></div>{PROSE}</div>": True,
    f"<section class='share-price'>{PROSE}</section>": True,
    f"<div class='search-results related'><article>{PROSE}</article></div><p>{'other ' * 60}</p>": True,
    f"<script>{'var x;' * 200}</script><div class='page with-ads'>{PROSE}</div>": True,
    f"<article>{PROSE}<div class=share><a href=x>tell a friend</a></div></article>": True,
    f"<article>{PROSE}</article><div id=comments><article>{'nice one ' * 60}</article></div>": True,
    f"<article>{PROSE}<div id=comments><article>nice one</article></div></article>": True,
    f"<div class='hidden-gems' title='a hidden gem' data-hidden='x'>{PROSE}</div>": True,
    f"<div hidden>{PROSE}</div>": False,
    f"<div HIDDEN=until-found class=x>{PROSE}</div>": False,
    f"<nav class=content>{PROSE}</nav>": False,
}


@pytest.mark.parametrize("source", WRAPPED)
def test_wrappers_with_names_of_noise(source):
    got = html_text.extract(f"<body>{source}</body>")
    prose = "First long part of the article, with words.\nSecond long part of it, with more words."
    assert (prose in got) == WRAPPED[source]
    assert "side" not in got and "friend" not in got and "nice" not in got and "two" not in got


def test_pages_table(spark):
    rows = [(i, f"u{i}", s, "x") for i, s in enumerate(PAGES)] + [(None, None, None, "x"), (0, "u0", "<p>again", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = Counter(tuple(r) for r in html_text.main_text(df).collect())
    want = Counter((i, u, t := html_text.extract(s or ""), len(t)) for i, u, s, _ in rows)
    assert got == want
    assert html_text.main_text(df.limit(0)).collect() == []


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeioust") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        body = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        text = " ".join(w + "***" for w in body) if bad else " ".join(body) + "."
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    rows += [(9000, None), (9001, ""), (None, "null id"), (9002, "x " * 50_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, score int, _row int")
    marks = spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id bigint, quality int")
    scored = quality_model.scored(docs, marks).select("_row.doc_id", "_row.text", "score").collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [(r.score >= 0.5) == (r.doc_id % 5 != 0) for r in held]
    assert len(held) > 250 and sum(right) / len(right) > 0.97
    assert len({r.score for r in scored if r.doc_id == 3}) == 1
    assert quality_model.filter_documents(docs, marks).columns == docs.columns
    none = quality_model.scored(docs, marks.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality_model.scored(docs.limit(0), marks).collect() == []


def test_prior_is_estimated_from_the_tails():
    rng = np.random.default_rng(0)
    positive = rng.uniform(0.6, 1, 4000)
    unlabelled = np.r_[rng.uniform(0.6, 1, 7000), rng.uniform(0, 0.5, 3000)]
    cuts = quality_model.prior_cuts(positive)
    above = np.array([(unlabelled >= c).sum() for c in cuts])
    assert abs(quality_model.estimated_prior(positive, cuts, above, len(unlabelled)) - 0.7) < 0.03


def test_all_unlabelled_rows_count(spark):
    """Cells and score tails against plain sums, with fewer seeds than rows, over several tasks and an empty one."""
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (300, quality_model.N_FEATURES)), rng.normal(8, 1, (100, quality_model.N_FEATURES))]
    rows = spark.createDataFrame([(i, bytearray(v.astype("<f8").tobytes())) for i, v in enumerate(x)], "_id bigint, x binary").repartition(7)
    rows = rows.unionByName(rows.limit(0))
    seeds = x[[0, 5, 350]]
    means, counts = quality_model._gathered(rows, seeds, np.zeros(x.shape[1]), np.ones(x.shape[1]))
    nearest = ((np.clip(x, -6, 6)[:, None] - np.clip(seeds, -6, 6)[None]) ** 2).sum(2).argmin(1)
    assert counts.tolist() == np.bincount(nearest).tolist() and counts[-1] >= 100
    assert np.allclose(means, [x[nearest == i].mean(0) for i in range(3)])
    model = quality_model.fit(x[300:350], means, counts, 0.3)
    scores = model.score(x)
    cuts = np.quantile(scores, [0, 0.3, 0.9, 1])
    assert np.abs(quality_model._above(rows, model, cuts) - [(scores >= c).sum() for c in cuts]).max() <= 1


def test_repeated_ids_count_once(spark):
    """A row that is repeated thousands of times leaves the model as it is."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"Plain words {i} in a row. " * 20 if i % 3 else "### $$$ " * i, "en", "s", 0) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60, 2)], "doc_id bigint, quality int")
    once = quality_model.scored(spark.createDataFrame(rows, schema), labels)
    often = quality_model.scored(spark.createDataFrame(rows + rows[7:8] * 3000, schema), labels)
    want = {r.doc_id: r.score for r in once.select("_row.doc_id", "score").collect()}
    got = often.select("_row.doc_id", "score").collect()
    assert len(got) == 3120 and all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)


def nearest_brute(rows, k=5):
    use = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            use.setdefault((key, tuple(v)), np.array(v, float))
    out = set()
    for (key, _), q in use.items():
        if key % 50 == 0:
            near = {}
            for (other, _), v in use.items():
                if other != key:
                    score = float(q @ v) / float(np.sqrt(q @ q) * np.sqrt(v @ v))
                    near[other] = max(score, near.get(other, -2))
            for rank, (other, score) in enumerate(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.add((key, rank, other, round(score, 12)))
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + 0.5 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(700)]
    same = rng.normal(size=12).astype(np.float32).tolist()
    rows += [(1000 + i, same) for i in range(200)]
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [math.nan] * 12), (2003, [math.inf] + [1.0] * 11), (2004, [None] + [1.0] * 11)]
    rows += [(None, same), rows[0]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, node int, rank int").repartition(4)
    found = neighbours.nearest(df, lambda i: i % 50 == 0).collect()
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in found}
    want = nearest_brute(rows)
    assert len(found) == len(want)
    assert len(got & want) / len(want) > 0.95
    hot = {x for x in want if 1000 <= x[0] < 1200}
    assert hot <= got


def test_few_neighbours(spark):
    def near(rows):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        return {(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, lambda i: i % 50 == 0).collect()}

    assert near([]) == set()
    assert near([(0, [1.0, 0.0])]) == set()
    assert near([(0, [1.0, 0.0]), (7, [0.5, 0.5]), (9, [2.0, 0.0])]) == {(0, 1, 9), (0, 2, 7)}


def test_suffix_arrays():
    rng = random.Random(1)
    for trial in range(120):
        n, letters = rng.randint(1, 300), rng.choice(["a", "ab", "abcd", "abcdefghijkl"])
        text = "".join(rng.choice(letters) for _ in range(n))
        text += text[: rng.randint(0, n)]
        depth = rng.choice([1, 3, 8, 9, 17, 20, 40, 200])
        raw = np.frombuffer(text.encode(), np.uint8)
        assert list(suffix_array(raw, len(text) + 8, eight_bytes(raw))) == sorted(range(len(text)), key=lambda i: text[i:])
        valid = np.zeros(len(raw), bool)
        valid[: max(0, len(raw) - depth + 1)] = True
        valid &= np.random.default_rng(trial).random(len(raw)) < rng.choice([1, 0.5])
        seen = Counter(text[i : i + depth] for i in np.flatnonzero(valid))
        want = [bool(valid[i]) and seen[text[i : i + depth]] > 1 for i in range(len(text))]
        assert repeated_starts(raw, valid, depth).tolist() == want


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(40)] + [(500, 499), (499, 500), (7, 7)]
    got = components(spark.createDataFrame(links, "u bigint, v bigint"), Stored(spark)).collect()
    label = {r.node: r.label for r in got}
    assert len(got) == len(label)
    assert {label[i] for i in range(61)} == {0}
    assert {label[i] for i in [*range(100, 140), 200]} == {100}
    assert label[500] == label[499] == 499
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Stored(spark)).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = cases.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stage_docs, store = spark.read.parquet(str(tmp_path / "documents.parquet")), Stored(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage_docs.count()
        stage_docs = store.keep(stage(spark, stage_docs, str(tmp_path)))
        assert stage_docs.columns == docs.columns and 0 < stage_docs.count() <= before
    kept = {r.doc_id for r in stage_docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept
    assert len([i for i in range(4000, 4040) if i in kept]) == 1
    assert not kept & {5000, 5001, 5002, 5006}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    cases.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
