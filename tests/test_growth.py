"""What grows with the input: shuffles, sorts and joins over all rows."""

import pytest
from pyspark.sql import functions as F

import stepwell as sw
from stepwell.plans import index as plans

LEVELS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def many_tops(spark):
    """Many top values of few rows each, and nulls at every level."""
    rows = spark.range(6000).selectExpr(
        "CASE WHEN id % 97 > 0 THEN id % 400 END AS a",
        "CASE WHEN id % 13 > 0 THEN id % 7 END AS b",
        "CASE WHEN id % 11 > 0 THEN concat('c', id % 5) END AS c",
        "CAST(id % 3 AS INT) AS d",
    )
    return rows.unionByName(rows.limit(0))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(left, right) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_combinations_dealt_by_top_value_are_those_of_one_task(spark, many_tops):
    one, dealt = sw.build_index(many_tops, LEVELS), sw.build_index(many_tops, LEVELS, one_task_rows=10)
    assert plans.is_spread(*dealt.top_sizes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert same(one.combinations, dealt.combinations)
    plan = plan_of(plans._compared_by_top(plans._counted(many_tops, LEVELS), LEVELS, 8))
    # counted and dealt, sorted once for the comparison and all counts
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Sort [") == 1


def test_choices_of_all_levels_come_from_one_sort(spark, many_tops, tmp_path, monkeypatch):
    index = sw.build_index(many_tops, LEVELS)
    expected = {k: index.choices(k) for k in (2, 3, 4)}
    plan = plan_of(plans._choices_by_top(index, 8))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    monkeypatch.setattr(plans, "ONE_TASK_ROWS", 10)
    sw.write_index(index, str(tmp_path / "index"))
    read = sw.read_index(spark, str(tmp_path / "index"))
    assert same(read.combinations.select(index.combinations.columns), index.combinations)
    for k, choices in expected.items():
        assert same(read.choices(k), choices)


def test_one_frequent_top_value_is_cut_into_slices(spark, many_tops):
    hot = many_tops.withColumn("a", F.when(F.col("a") < 5, F.col("a")).otherwise(F.lit(5)))
    index = sw.build_index(hot, LEVELS, one_task_rows=10)
    assert not plans.is_spread(*index.top_sizes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert same(index.combinations, sw.build_index(hot, LEVELS).combinations)


@pytest.mark.parametrize("width", [3, 4096])
def test_gaps_are_named_without_joins(many_tops, width):
    ranges = sw.absent_ranges(many_tops, ["a", "b", "c"], slice_width=width)
    assert "Join" not in plan_of(ranges)
    spread = ranges.groupBy("col_a", "value_a", "col_b").agg(F.sum("n_values").alias("n"))
    pairs = sw.absent_pairs(many_tops, ["a", "b", "c"]).groupBy("col_a", "value_a", "col_b").agg(F.count("*").alias("n"))
    assert same(spread, pairs)
