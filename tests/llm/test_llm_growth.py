"""Memory of a task and of the driver does not grow with the rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from stepwell.llm import quality_model, repeats, sharding


def test_directory_of_shards_is_not_broadcast(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('x', 50) AS text")
    plan = sharding.assign(docs, 400, carry=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan


def test_cells_are_gathered_in_little_memory():
    class Rows:
        def select(self, *names):
            return self

        def mapInPandas(self, partial, schema):
            self.partial = partial
            raise InterruptedError

    rng, rows = np.random.default_rng(0), Rows()
    seeds = rng.random((2048, quality_model.N_FEATURES))
    try:
        quality_model._gathered(rows, seeds, seeds.mean(0), seeds.std(0))
    except InterruptedError:
        pass
    values = rng.random((10_000, quality_model.N_FEATURES))
    batch = pd.DataFrame({"x": [v.astype("<f8").tobytes() for v in values]})
    tracemalloc.start()
    (found,) = rows.partial(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    z, v = ((x - seeds.mean(0)) / seeds.std(0) for x in (seeds, values))
    nearest = np.array([((z - one) ** 2).sum(1).argmin() for one in np.clip(v, -6, 6)[:200]])
    assert found["n"].sum() == 10_000
    assert set(nearest) <= set(found["cell"])
    assert peak < 64 << 20


def test_strings_of_a_hot_anchor_leave_in_small_batches():
    rng = np.random.default_rng(0)
    bodies = [rng.integers(0, 256, repeats.DEPTH + 100, dtype=np.uint8).tobytes() for _ in range(400)]
    rows = [(repeats.ONE, 7, 0, 2, i, 0, 100, body) for i, body in enumerate(bodies)]
    batches = list(repeats._shard(iter([repeats._as_batch(repeats._PARTS, rows)]), repeats.SHARD_BYTES))
    assert sum(b.num_rows for b in batches) == 400 * 101
    assert max(b.num_rows for b in batches) <= 20_000


def test_arrays_of_a_task_are_of_a_megabyte_or_so(monkeypatch):
    sizes = []
    monkeypatch.setattr(repeats, "repeated_starts", lambda text, valid, depth: sizes.append(len(text)) or np.zeros(len(text), bool))
    body = bytes(repeats.DEPTH + 100)
    rows = [(repeats.ONE, i, 0, 1, i, 0, 100, body) for i in range(10_000)]
    list(repeats._shard(iter([repeats._as_batch(repeats._PARTS, rows)]), repeats.SHARD_BYTES))
    assert sum(sizes) == 10_000 * len(body)
    assert max(sizes) < 2 << 20


def test_lists_of_structs_keep_their_rows():
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    column = pa.array([[{"lo": 1, "hi": 2}], None, [], [{"lo": 3, "hi": 4}, {"lo": 5, "hi": 6}]], kind)
    for rows in (column, column.slice(1)):
        lo, hi = (list(x) for x in repeats._lists(rows))
        assert [list(zip(a.tolist(), b.tolist())) for a, b in zip(lo, hi)] == [
            [(x["lo"], x["hi"]) for x in row or []] for row in rows.to_pylist()
        ]
