"""Registered queries: names, columns, SQL, and recall over a whole table."""

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as contract  # noqa: E402
from compare import compare, duck  # noqa: E402
from stepwell.llm import neighbours, registry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
             "base_labels": "string", "labels": "string", "score": "double"},
    "op3_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
             "sequence_id": "bigint", "offset": "bigint"},
    "op6_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op7_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
             "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_": {"doc_id": "bigint", "n_bytes": "bigint", "shard": "string", "depth": "int"},
    "op11_": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op12_": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
              "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13_": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_query_has_its_columns_and_rows(spark, prefix):
    names = [n for n in contract.queries() if n.startswith(prefix)]
    assert len(names) == 1
    result = contract.queries()[names[0]](spark, SF_DIR)
    assert COLUMNS[prefix].items() <= dict(result.dtypes).items()
    source = {"op1_": "pages", "op8_": None, "op11_": "embeddings", "op13_": None}.get(prefix, "documents")
    if source and prefix != "op5_":
        assert result.count() == spark.read.parquet(f"{SF_DIR}/{source}.parquet").count()


def test_pipeline_is_registered():
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", registry.ORACLE)
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF_DIR), SF_DIR, name) == []


def test_small_shards_split_unevenly(spark):
    rows = registry.sharding_in_small_shards(spark, SF_DIR).select("depth").distinct().count()
    assert rows > 1


def recall(rows, found):
    """Share of the five nearest rows by brute force that were found."""
    ids, x = rows.vec_id.to_numpy(), np.vstack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found.groupby("query_id").vec_id.apply(set)
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -2
        best = ids[np.lexsort((ids, -score))[:5]]
        hits.append(len(set(best) & got[ids[i]]) / 5)
    return np.mean(hits)


def test_recall_over_a_whole_table(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas()
    assert recall(vectors, registry.op8_nearest_neighbours(spark, SF_DIR).toPandas()) >= 0.9


def test_recall_with_a_beam_far_below_the_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(vectors.toPandas(), neighbours.nearest(vectors, lambda i: i % 50 == 0, beam=32).toPandas()) >= 0.9


def test_recall_among_near_ties(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.02 * rng.normal(size=24)).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(6)
    assert recall(df.toPandas(), neighbours.nearest(df, lambda i: i % 50 == 0, beam=48).toPandas()) >= 0.9


def test_vectors_of_different_length(spark):
    rng = np.random.default_rng(6)
    short = [(i, rng.normal(size=int(rng.integers(2, 9))).tolist()) for i in range(300)]
    filled = pd.DataFrame([(i, v + [0.0] * (8 - len(v))) for i, v in short], columns=["vec_id", "embedding"])
    df = spark.createDataFrame(short, "vec_id bigint, embedding array<double>").repartition(5)
    assert recall(filled, neighbours.nearest(df, lambda i: i % 50 == 0).toPandas()) == 1
