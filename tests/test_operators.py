"""Sources, generators, filters, reports and scalar functions on small inputs."""

import os
from itertools import product

import pytest
from pyspark.sql import functions as F

import stepwell as sw

PART = "/root/testdata/sf0.001/part.parquet"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# sources


def test_write_replaces_the_whole_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sw.write_table(spark.range(10), path)
    sw.write_table(spark.range(3).withColumn("part", F.col("id") % 2), path, partition_by=["part"])
    back = sw.scan(spark, path)
    assert rows(back.select("id")) == [(0,), (1,), (2,)]
    pruned = sw.where_equals(back, "part", 1)
    assert rows(pruned.select("id")) == [(1,)]
    assert "PartitionFilters: [isnotnull(part" in pruned._jdf.queryExecution().toString()


def test_partitioned_write_makes_few_files(spark, tmp_path):
    many_tasks = spark.range(0, 1000, 1, 16).withColumn("part", F.col("id") % 4)
    sw.write_table(many_tasks, str(tmp_path / "t"), partition_by=["part"])
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 4
    assert sw.scan(spark, str(tmp_path / "t")).count() == 1000


def test_storage_size(spark, tmp_path):
    path = tmp_path / "t"
    sw.write_table(spark.range(100).withColumn("part", F.col("id") % 3), str(path), partition_by=["part"])
    files = [f for f in path.rglob("*.parquet")]
    assert rows(sw.storage_size(spark, str(path))) == [(len(files), sum(f.stat().st_size for f in files))]


def test_summary(spark):
    row = sw.summary(spark, PART).first()
    assert (row["n_rows"], row["bytes"]) == (200, os.stat(PART).st_size)
    assert row["text"] == "Dataset has 200 rows (7.07K on disk)"


def test_scan_by_name(spark):
    spark.range(4).createOrReplaceTempView("four")
    assert sw.scan(spark, "four").count() == 4


# generators


def test_label_domain(spark):
    assert rows(sw.label_domain(spark, "A", 3)) == [("A1",), ("A2",), ("A3",)]


def test_grid_of_mixed_domains(spark):
    numbers = spark.createDataFrame([(3,), (1,), (3,), (None,)], "n int")
    domains = {"x": ["p", "q"], "n": numbers, "z": sw.labels_up_to("Z", 3)}
    grid = sw.combination_grid(spark, domains, position="place", partitions=3)
    assert rows(grid.select("x", "n", "z")) == sorted(product("pq", [1, 3], ["Z1", "Z2", "Z3"]))
    first = grid.orderBy("place").limit(3).collect()
    assert [tuple(r) for r in first] == [(0, "p", 1, "Z1"), (1, "q", 1, "Z1"), (2, "p", 3, "Z1")]


def test_grid_without_values_is_empty(spark):
    assert sw.combination_grid(spark, {"x": ["p"], "y": []}).count() == 0
    assert sw.combination_grid(spark, {"x": ["p"], "y": spark.range(0)}).count() == 0


def test_grid_has_no_product_join(spark):
    domain = spark.range(5)
    plan = sw.combination_grid(spark, {"x": domain, "y": domain})._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_grid_too_large(spark):
    with pytest.raises(ValueError, match="64-bit"):
        sw.combination_grid(spark, {f"c{i}": sw.labels_up_to("x", 10**6) for i in range(4)})


@pytest.mark.parametrize("n, partitions", [(0, None), (1, None), (5, None), (5, 3), (100, 4), (70_000, None), (70_001, 2)])
def test_replicate(spark, n, partitions):
    copies = sw.replicate_rows(spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string"), n, partitions)
    expected = [(1, "a", n), (2, "b", n)] if n else []
    assert copies.columns == ["x", "y"]
    assert rows(copies.groupBy("x", "y").count()) == expected


def test_stack_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "a")], "x int, y string")
    b = spark.createDataFrame([("b", 2.0)], "y string, z double")
    assert {tuple(r) for r in sw.stack_tables(a, b, a).collect()} == {(1, "a", None), (None, "b", 2.0)}
    assert sw.stack_tables(a, b, a).count() == 3


# filters

NULL_ROWS = [(a, b) for a in ("x", "y", None) for b in ("p", "q", None)]


@pytest.fixture
def null_table(spark):
    return spark.createDataFrame(NULL_ROWS, "a string, b string")


def test_null_never_equals(null_table):
    assert sw.where_equals(null_table, "a", None).count() == 0
    assert sw.where_equals(null_table, "a", "x").count() == 3


def test_exclusion_drops_unknown(spark, null_table):
    kept = {("x", "q"), ("y", "p"), ("y", "q"), ("y", None), (None, "q")}
    rule = sw.PairRule("a", "x", "b", "p")
    assert {tuple(r) for r in sw.exclude_pairs(null_table, [rule]).collect()} == kept
    rules = spark.createDataFrame([("x", "p"), (None, "q")], "value_a string, value_b string")
    assert {tuple(r) for r in sw.exclude_pair_table(null_table, rules, "a", "b").collect()} == kept


def test_many_rules_as_list_and_as_table(spark, null_table):
    pairs = [("x", "p"), ("y", "q")]
    listed = sw.exclude_pairs(null_table, [("a", a, "b", b) for a, b in pairs])
    rules = spark.createDataFrame(pairs, "value_a string, value_b string")
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, listed.collect())) == sorted(
        map(key, sw.exclude_pair_table(null_table, rules, "a", "b").collect())
    )


def test_exclude_pair_table_on_one_source(spark):
    """The rules may come from the filtered table itself."""
    parts = sw.scan(spark, PART)
    rules = parts.filter("p_size = 1").selectExpr("p_brand AS value_a", "p_type AS value_b")
    left = sw.exclude_pair_table(parts, rules, "p_brand", "p_type")
    bad = {tuple(r) for r in rules.collect()}
    assert rows(left.select("p_partkey")) == sorted(
        (r["p_partkey"],) for r in parts.collect() if (r["p_brand"], r["p_type"]) not in bad
    )


def test_members(spark, null_table):
    domain = spark.createDataFrame([("x",), ("x",), (None,)], "v string")
    flagged = sw.is_member(null_table, domain, "a")
    assert flagged.count() == 9
    assert {(r["a"], r["ok"]) for r in flagged.collect()} == {("x", True), ("y", False), (None, False)}


def test_drill_down_is_one_pushed_filter(spark):
    parts = sw.drill_down(sw.scan(spark, PART), ["p_brand", "p_type", "p_size"], ["Brand#2", "ECONOMY"])
    plan = parts.select("p_size")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Filter (") == 1
    assert "EqualTo(p_brand,Brand#2)" in plan and "EqualTo(p_type,ECONOMY)" in plan
    assert "p_name" not in plan and "p_retailprice" not in plan


def test_root_choices_keep_null(null_table):
    assert {r[0] for r in sw.root_choices(null_table, "a").collect()} == {"x", "y", None}


def test_choices_are_sorted_without_null(null_table):
    assert [r[0] for r in sw.choices(null_table, ["a", "b"], ["x"]).collect()] == ["p", "q"]
    assert [r[0] for r in sw.choices(null_table, ["a", "b"], []).collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        sw.choices(null_table, ["a", "b"], ["x", "p"])


# reports


def test_row_count_reads_no_column(spark):
    counted = sw.row_count(sw.scan(spark, PART))
    assert counted.first()["n"] == 200
    assert "ReadSchema: struct<>" in counted._jdf.queryExecution().executedPlan().toString()


def test_rule_check(spark, null_table):
    checked = sw.check_rules(null_table, [("a", "x", "b", "p"), ("a", "x", "b", "z")])
    assert rows(checked) == [("a=x & b=p", 1), ("a=x & b=z", 0)]
    assert sw.check_rules(null_table, []).count() == 0


def test_structure(spark):
    df = spark.createDataFrame([(2, None), (1, "u"), (3, "w")], "k int, v string")
    assert rows(sw.structure(df, 2, ["k"])) == [(1, "k", "int", "1 2"), (2, "v", "string", "u NA")]
    assert rows(sw.structure(df.limit(0), 2, ["k"])) == [(1, "k", "int", ""), (2, "v", "string", "")]


# scalar functions


@pytest.mark.parametrize(
    "size, text",
    [
        (0, "0B"),
        (999, "999B"),
        (1024, "1K"),
        (1536, "1.5K"),
        (7241, "7.07K"),
        (179405, "175K"),
        (600 * 1024**2, "600M"),
        (2 * 1024**4, "2T"),
        (None, None),
    ],
)
def test_file_size_text(spark, size, text):
    df = spark.createDataFrame([(size,)], "size bigint")
    assert df.select(sw.file_size_text(F.col("size"))).first()[0] == text


def test_scalars(spark):
    df = spark.createDataFrame([(1, True), (26, None), (27, False)], "i int, b boolean")
    assert [r[0] for r in df.select(sw.letter(F.col("i"))).collect()] == ["A", "Z", None]
    assert [r[0] for r in df.select(sw.is_true(F.col("b"))).collect()] == [True, False, False]
    one = spark.range(1)
    big = one.select(sw.thousands(F.lit(214_800_000)), sw.first_entry(F.array().cast("array<string>"))).first()
    assert tuple(big) == ("214,800,000", None)
    line = one.select(sw.size_line(F.lit(214_800_000), F.lit(600 * 1024**2))).first()[0]
    assert line == "Dataset has 214,800,000 rows (600M on disk)"
