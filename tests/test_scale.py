"""Plans and settings that matter at scale: scans, shuffles, skew, streams, the shared folder."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import stepwell as sw
from stepwell import session

PACKAGE = Path(sw.__file__).parent
PART = "/root/testdata/sf0.001/part.parquet"
LEVELS = ["p_brand", "p_type", "p_size"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def part_requests(spark):
    return sw.scan(spark, PART).selectExpr("p_partkey AS request_id", "p_brand", "p_type", "51 - p_size AS p_size")


def test_library_has_no_udf_and_no_local_checkpoint():
    for source in PACKAGE.rglob("*.py"):
        if "llm" in source.parts:  # an optional part with rules of its own
            continue
        text = source.read_text()
        assert not re.search(r"\b(udf|pandas_udf|applyInPandas|mapInPandas|toPandas|localCheckpoint|crossJoin|rdd)\b", text)


def test_index_reads_the_table_once_and_only_its_levels(spark):
    parts = sw.scan(spark, PART)
    index = sw.build_index(parts, LEVELS)
    plan = plan_of(sw.resolve_selection(sw.default_selection(spark, {"p_brand": "x", "p_type": "y", "p_size": 1}), index))
    scans = set(re.findall(r"ReadSchema: (\S+)", plan))
    # lookups read the index's own files, never the table
    assert scans and all("fresh" in s and "p_partkey" not in s for s in scans)
    index.unpersist()


def test_lookups_of_a_ready_index_do_not_shuffle_requests(spark):
    index = sw.build_index(sw.scan(spark, PART), LEVELS)
    assert index.is_small(3)
    plan = plan_of(sw.resolve_selection(part_requests(spark), index))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_large_nodes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("stepwell.plans.index.BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = sw.build_index(sw.scan(spark, PART), LEVELS)
        settled = sw.resolve_selection(part_requests(spark), index)
        rules = sw.scan(spark, PART).selectExpr("p_brand AS value_a", "p_type AS value_b")
        for large in (
            settled,
            sw.choices_for(part_requests(spark), index),
            sw.check_selection(part_requests(spark), index),
            sw.cascade_trace(part_requests(spark), index),
            sw.exclude_pair_table(sw.scan(spark, PART), rules, "p_brand", "p_type"),
            sw.absent_pairs(sw.scan(spark, PART), LEVELS),
        ):
            plan = plan_of(large)
            assert "SortMergeJoin" in plan
            assert not re.search("Broadcast|NestedLoop|Cartesian", plan)
        shuffled = sorted(map(tuple, settled.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    index = sw.build_index(sw.scan(spark, PART), LEVELS)
    assert shuffled == sorted(map(tuple, sw.resolve_selection(part_requests(spark), index).collect()))


def test_stored_lookup_reads_only_its_folders(spark, tmp_path):
    sw.write_index(sw.build_index(sw.scan(spark, PART), LEVELS), str(tmp_path))
    index = sw.read_index(spark, str(tmp_path))
    top = index.node(1)
    files = {f.rsplit("/", 2)[-2] for f in top.inputFiles()}
    assert files == {"fresh=1", "fresh=2", "fresh=3"}
    assert "PartitionFilters: [isnotnull(fresh" in top._jdf.queryExecution().toString()


LINES = "/root/testdata/sf0.01/lineitem.parquet"
SUPPLY = ["l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber"]


def test_sliced_index_of_many_combinations(spark):
    """Enough rows that the slices come from a sample; both ways of sorting must give the same index."""
    lines = sw.scan(spark, LINES)
    exact = lines.select(*[F.count_distinct(*SUPPLY[:k]) for k in range(1, 6)]).first()
    whole = sw.build_index(lines, SUPPLY, one_task_rows=10**6)
    sliced = sw.build_index(lines.repartition(7), SUPPLY, one_task_rows=0)
    assert whole.measures == sliced.measures
    assert whole.measures[:5] == tuple(exact)
    assert whole.combinations.exceptAll(sliced.combinations).count() == 0
    assert sliced.combinations.exceptAll(whole.combinations).count() == 0
    for index in (whole, sliced):
        index.unpersist()


def test_ranks_of_a_large_group_in_slices(spark):
    """One combination with most of the choices, ranked in slices that come from a sample."""
    lines = sw.scan(spark, LINES).selectExpr("IF(l_orderkey % 3 = 0, 0, l_suppkey) AS a", "l_orderkey AS b")
    whole = sw.build_index(lines, ["a", "b"])
    sliced = sw.build_index(lines, ["a", "b"], group_limit=100)
    assert whole.choices(2).exceptAll(sliced.choices(2)).count() == 0
    assert sliced.choices(2).exceptAll(whole.choices(2)).count() == 0


@pytest.mark.parametrize("one_task_rows", [10**6, 0])
def test_an_index_follows_the_files(spark, tmp_path, one_task_rows):
    path = str(tmp_path / "t")
    ask = spark.createDataFrame([(1, "A2", "B9")], "request_id bigint, a string, b string")

    def build():
        return sw.build_index(spark.read.parquet(path), ["a", "b"], one_task_rows=one_task_rows)

    spark.createDataFrame([("A1", "B1"), ("A1", "B2")], "a string, b string").write.parquet(path)
    first = build()
    assert sw.resolve_selection(ask, first).first()["b"] is None
    spark.createDataFrame([("A2", "B8"), ("A2", "B9")], "a string, b string").write.mode("append").parquet(path)
    second = build()
    assert second.combinations.count() == 4
    assert sw.resolve_selection(ask, second).first()["b"] == "B9"
    first.unpersist()
    assert second.combinations.count() == 4
    second.unpersist()


def test_reports_and_grids_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("x1", "y1"), ("x2", "y2")], "a string, b string").write.parquet(path)

    def answers():
        df = spark.read.parquet(path)
        grid = sw.combination_grid(spark, {"a": df.select("a"), "b": df.select("b")})
        return sw.absent_pairs(df, ["a", "b"]).count(), grid.count()

    assert answers() == (2, 4)
    spark.createDataFrame([("x1", "y2"), ("x2", "y1"), ("x3", "y1")], "a string, b string").write.mode("append").parquet(path)
    assert answers() == (1, 6)


def test_numbers_follow_the_values_at_any_size(spark):
    from stepwell.plans.positions import dense_positions

    values = spark.createDataFrame([(c,) for c in "hgfedcba"], "v string")
    for limit in (100, 3):
        rows = dense_positions(values, [], "v", largest_group=8, group_limit=limit).orderBy("position").collect()
        assert [(r["v"], r["position"]) for r in rows] == [(c, i) for i, c in enumerate("abcdefgh")]


def test_long_literal_domains(spark):
    grid = sw.combination_grid(spark, {"a": list(range(10_500)), "b": ["x", "y"]}, position="place")
    assert grid.count() == 21_000
    assert grid.filter("place <> a + IF(b = 'y', 10500, 0)").count() == 0


def test_empty_and_null_indexes_are_stored(spark, tmp_path):
    ask = spark.createDataFrame([(1, "A", "B")], "request_id bigint, a string, b string")
    cases = {"empty": [], "null": [("A", None)], "one": [("A", "C")]}
    for name, rows in cases.items():
        path = str(tmp_path / name)
        index = sw.build_index(spark.createDataFrame(rows, "a string, b string"), ["a", "b"])
        sw.write_index(index, path)
        stored = sw.read_index(spark, path)
        for operator in (sw.resolve_selection, sw.cascade_trace, sw.check_selection, sw.choices_for):
            assert operator(ask, stored).collect() == operator(ask, index).collect()
        index.unpersist()


def test_few_requests_read_few_rows_of_a_large_index(spark, tmp_path, monkeypatch):
    """A request for one supplier filters the stored nodes by it, and only what is left is shuffled."""
    built = sw.build_index(sw.scan(spark, LINES), SUPPLY)
    sw.write_index(built, str(tmp_path / "index"))
    ask = sw.scan(spark, LINES).selectExpr("l_orderkey AS request_id", *SUPPLY).filter("l_suppkey = 3").limit(5)
    ask = spark.createDataFrame(ask.collect(), ask.schema)
    want = sw.resolve_selection(ask, built, changed_level=2).collect()
    monkeypatch.setattr("stepwell.plans.index.BROADCAST_BYTES", 0)
    index = sw.read_index(spark, str(tmp_path / "index"))
    settled = sw.resolve_selection(ask, index, changed_level=2)
    assert sorted(settled.collect()) == sorted(want)
    filters = re.findall(r"PushedFilters: \[([^\]]*)\]", plan_of(settled))
    assert filters and all("EqualTo(l_suppkey,3)" in f or "In(l_suppkey, [3])" in f for f in filters)
    built.unpersist()


def test_collated_levels(spark):
    df = spark.sql("SELECT 'A1' COLLATE UTF8_LCASE AS a, 'B2' COLLATE UTF8_LCASE AS b")
    ask = spark.sql("SELECT 1L AS request_id, 'a1' COLLATE UTF8_LCASE AS a, 'b2' COLLATE UTF8_LCASE AS b")
    assert sw.check_selection(ask, df, ["a", "b"]).first()["first_invalid_level"] is None


def test_names_with_dots(spark):
    df = spark.createDataFrame([("A1", "B1"), ("A1", "B2"), ("A2", "B1")], "`x.a` string, `y.b` string")
    ask = spark.createDataFrame([(1, "A2", "B2")], "`my.id` bigint, `x.a` string, `y.b` string")
    levels = ["x.a", "y.b"]
    assert sw.where_equals(df, "x.a", "A1").count() == 2
    assert sw.exclude_pairs(df, [("x.a", "A1", "y.b", "B1")]).count() == 2
    assert [r[0] for r in sw.choices(df, levels, ["A1"]).collect()] == ["B1", "B2"]
    assert sw.root_choices(df, "x.a").count() == 2
    assert sw.absent_pairs(df, levels).count() == 1
    assert sw.check_rules(df, [("x.a", "A1", "y.b", "B1")]).first()["n_rows"] == 1
    assert sw.is_member(ask, df.select("`x.a`"), "x.a").first()["ok"]
    assert sw.choices_for(ask, df, levels, request_id="my.id").count() == 1
    assert sw.check_selection(ask, df, levels, request_id="my.id").first()["first_invalid_level"] == 2
    trace = sw.cascade_trace(ask, df, levels, request_id="my.id")
    assert sw.trace_text(trace, request_id="my.id").count() == 1
    assert sw.combination_grid(spark, {"x.a": df.select("`x.a`"), "y.b": ["B1", "B2"]}).count() == 4


def test_size_of_a_catalog_table(spark):
    spark.range(5).write.mode("overwrite").saveAsTable("size_t")
    try:
        assert sw.storage_size(spark, "size_t").first()["bytes"] > 0
        assert sw.summary(spark, "size_t").first()["n_rows"] == 5
    finally:
        spark.sql("DROP TABLE size_t")


def test_hot_requests_are_split(spark):
    """A selection asked for by most requests: the large join splits its partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    levels = ["a", "b"]
    rows = spark.range(4000).selectExpr("concat('a', id % 50) AS a", "concat('b', id) AS b")
    requests = spark.range(0, 60000, 1, 8).selectExpr(
        "id AS request_id", "concat('a', IF(id % 3 = 0, 7, id % 50)) AS a", "concat('b', IF(id % 3 = 0, 7, id)) AS b"
    )
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        index = sw.build_index(rows, levels)
        index.measures = (10**9, 10**9, 10**11, 10**11)
        settled = sw.resolve_selection(requests, index)
        counted = settled.groupBy("a", "b").count()
        kept = {(r["a"], r["b"]): r["count"] for r in counted.collect()}
        plan = plan_of(counted)
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert "skew=true" in plan
    assert sum(kept.values()) == 60000
    assert kept["a7", "b7"] >= 20000


def test_stream_of_requests_equals_batch(spark, tmp_path):
    incoming, answers = tmp_path / "in", str(tmp_path / "out")
    index = sw.build_index(sw.scan(spark, PART), LEVELS)
    requests = part_requests(spark)
    stream = lambda: sw.request_stream(spark, str(incoming), requests.schema)
    for low, high in ((0, 80), (80, 200)):
        requests.filter(F.col("request_id").between(low, high - 1)).write.mode("append").parquet(str(incoming))
        # started again after each arrival, it answers only what is new
        sw.answer_requests(stream(), index, answers, "restart").awaitTermination()
        assert sw.scan(spark, answers).count() == high
    batch = sw.resolve_selection(requests, index)
    assert sorted(map(tuple, sw.scan(spark, answers).collect())) == sorted(map(tuple, batch.collect()))


class FakeContext:
    master = "yarn"

    def getCheckpointDir(self):
        return None


class FakeSession:
    sparkContext = FakeContext()

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession())


def test_shared_folder_is_the_configured_one(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
