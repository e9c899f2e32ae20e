"""Stored indexes: counts in the nodes, buckets, refresh, replacement. Pruned grids, versions, scratch folders."""

import os
import re
import threading
import time
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import brute
import stepwell as sw
from registry import queries as registered
from stepwell import session
from stepwell.sources import versions
from stepwell.sources.tables import LISTING_TASKS, _files

SF = "/root/testdata/sf0.001"
LINES = "/root/testdata/sf0.01/lineitem.parquet"
SUPPLY = ["l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def shuffled_nodes(lines):
    """Stored nodes in buckets whose rows go through an exchange before they are joined."""
    found = []
    for i, line in enumerate(lines):
        if re.match(r"[\s:|+\-*]*Exchange", line):
            for step in lines[i + 1 :]:
                if "Join" in step:
                    break
                if "FileScan" in step:
                    found += [step] * ("Bucketed: true" in step)
                    break
    return found


def metrics(df, kinds, name):
    """A metric of all steps of some kinds, of a plan that has run."""
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        elif node.nodeName() in kinds:
            found.append(node.metrics().apply(name).value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


def written(spark, df, levels, path, **options):
    index = sw.build_index(df, levels, **options)
    sw.write_index(index, path)
    index.unpersist()
    return sw.read_index(spark, path, options.get("broadcast_bytes"))


# counts in the nodes


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_numbers_of_choices_cross_the_borders_of_slices(spark, slices):
    """Few prefixes over many slices: most slices lie wholly within a prefix."""
    levels = ["a", "b", "c", "d"]
    data = brute.random_rows("borders", 700, [2, 3, 40, 5], nulls=0.15, hot=0.5)
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in levels))
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    try:
        index = sw.build_index(df, levels, one_task_rows=10**6 if slices == 1 else 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k in range(1, 4):
        want = {}
        for row in {r[: k + 1] for r in data if None not in r[:k]}:
            want[row[:k]] = want.get(row[:k], 0) + (row[k] is not None)
        got = {tuple(r[:k]): r[k] for r in index.node(k).select(*index.keys(k), f"n_{k + 1}").collect()}
        assert got == want


def test_a_trace_has_as_many_joins_as_the_cascade(spark):
    index = registered.part_index(spark, SF)
    asked = spark.createDataFrame([(1, "x", "y", 3)], "request_id bigint, p_brand string, p_type string, p_size int")
    joins = [sum("Join" in line for line in plan_lines(f(asked, index))) for f in (sw.resolve_selection, sw.cascade_trace)]
    assert joins[0] == joins[1] == 3


# buckets


def test_a_node_in_buckets_is_not_shuffled(spark, tmp_path):
    index = written(spark, sw.scan(spark, LINES), SUPPLY, str(tmp_path / "i"), broadcast_bytes=0)
    assert sorted(index.buckets) == [1, 2, 3, 4, 5]
    orders = sw.scan(spark, "/root/testdata/sf0.01/orders.parquet")
    asked = registered.order_requests(orders).drop("l_suppkey").withColumn("l_suppkey", F.expr("request_id % 120"))
    for operator in (sw.resolve_selection, sw.cascade_trace, sw.check_selection):
        answer = operator(asked, index)
        plan = "\n".join(plan_lines(answer))
        assert plan.count("stepwell_") >= 4 and "Bucketed: true" in plan and not shuffled_nodes(plan_lines(answer))
        assert rows(answer) == rows(operator(asked, sw.build_index(sw.scan(spark, LINES), SUPPLY)))
    # more requests than rows: the node is shuffled, and skew handled, as ever
    many = sw.replicate_rows(asked, 5)
    answer = sw.resolve_selection(many, index)
    assert "stepwell_" not in "\n".join(plan_lines(answer))
    assert answer.count() == 5 * orders.count()
    names = list(index.buckets.values())
    index.unpersist()
    assert not any(spark.catalog.tableExists(name) for name in names)


def test_a_stream_against_buckets(spark, tmp_path):
    """2,000 requests on the sparse index, in two arrivals."""
    index = written(spark, sw.scan(spark, LINES), SUPPLY, str(tmp_path / "i"), broadcast_bytes=0)
    asked = registered.order_requests(sw.scan(spark, "/root/testdata/sf0.01/orders.parquet")).filter("request_id <= 2000")
    (tmp_path / "in").mkdir()
    stream = sw.request_stream(spark, str(tmp_path / "in"), asked.schema)
    assert sw.resolve_selection(stream, index).isStreaming
    for part in ("request_id <= 900", "request_id > 900"):
        asked.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        query = sw.answer_requests(stream, index, str(tmp_path / "out"), "buckets")
        query.awaitTermination()
        lines = query._jsq.explainInternal(False).splitlines()
        assert sum("Bucketed: true" in line for line in lines) >= 5 and not shuffled_nodes(lines)
    batch = sw.resolve_selection(asked, sw.build_index(sw.scan(spark, LINES), SUPPLY))
    assert rows(sw.scan(spark, str(tmp_path / "out"))) == rows(batch)


def test_a_small_index_has_no_buckets(spark, tmp_path):
    index = written(spark, sw.scan(spark, f"{SF}/part.parquet"), registered.PART_LEVELS, str(tmp_path / "i"))
    assert index.buckets == {}
    assert not [f for f in os.listdir(versions.current(spark, str(tmp_path / "i"))) if f.startswith("node")]


# many top values


def test_many_top_values_shuffle_only_what_matches(spark):
    """5,000 top values out of a million: the nodes are reduced before they are shuffled."""
    table = spark.range(1_000_000).selectExpr("id AS a", "id % 7 AS b")
    index = sw.build_index(table, ["a", "b"], broadcast_bytes=1 << 20)
    assert not index.is_small(1)
    asked = spark.range(6000).selectExpr("id AS request_id", "id * 200 AS a", "3L AS b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        settled = sw.resolve_selection(asked, index)
        sent = metrics(settled, ["Exchange"], "shuffleRecordsWritten")
        got = {r["a"]: r["b"] for r in settled.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {a: (a % 7 if a < 1_000_000 else None) for a in range(0, 1_200_000, 200)}
    assert sent and max(sent) <= 6000
    index.unpersist()


def test_requests_for_most_top_values_do_not_filter(spark):
    index = sw.build_index(sw.scan(spark, LINES), SUPPLY, broadcast_bytes=0)
    asked = registered.supply_requests(spark, "/root/testdata/sf0.01")
    assert not any("PushedFilters: [In(l_suppkey" in line for line in plan_lines(sw.resolve_selection(asked, index)))
    index.unpersist()


# refresh


@pytest.mark.parametrize("one_task_rows", [10**6, 0])
def test_refresh_equals_rebuild(spark, one_task_rows):
    levels = ["a", "b", "c"]
    kind = "a string, b string, c string"
    first = brute.random_rows("refresh", 300, [5, 6, 7], nulls=0.1, hot=0.3)
    more = brute.random_rows("refresh more", 150, [7, 6, 9], nulls=0.1)
    gone, kept = first[:120], first[120:]
    table = lambda data: spark.createDataFrame(data, kind)
    old = sw.build_index(table(first), levels, one_task_rows=one_task_rows)
    for added, removed, now in ((more, None, first + more), (None, gone, kept), (more, gone, kept + more), (None, first, [])):
        fresh = sw.refresh_index(
            old, table(added) if added else None, table(removed) if removed else None, one_task_rows=one_task_rows
        )
        built = sw.build_index(table(now), levels, one_task_rows=one_task_rows)
        assert rows(fresh.combinations) == rows(built.combinations)
        assert fresh.measures == built.measures
        asked = table(first + more).withColumn("request_id", F.monotonically_increasing_id())
        assert rows(sw.cascade_trace(asked, fresh)) == rows(sw.cascade_trace(asked, built))
    with pytest.raises(ValueError, match="1 rows are to be removed"):
        sw.refresh_index(old, None, table([("never", "seen", "here")]))


def test_update_of_a_stored_index_reads_no_table(spark, tmp_path):
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string").write.parquet(table)
    sw.write_index(sw.build_index(spark.read.parquet(table), ["a", "b"]), index)
    opened = sw.read_index(spark, index)
    for f in Path(table).iterdir():
        f.write_bytes(b"")
    sw.update_index(
        spark,
        index,
        spark.createDataFrame([("y", "r")], "a string, b string"),
        spark.createDataFrame([("x", "p")], "a string, b string"),
    )
    assert rows(sw.read_index(spark, index).combinations.select("a", "b", "n_rows")) == [("x", "q", 1), ("y", "r", 1)]
    # who had opened the old one goes on with it
    assert rows(opened.combinations.select("a", "b")) == [("x", "p"), ("x", "q")]


# replacement


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sw.write_table(spark.range(5), path)
    broken = spark.range(10).select(F.expr("IF(id = 7, raise_error('no'), id)").alias("id"))
    with pytest.raises(Exception, match="no"):
        sw.write_table(broken, path)
    assert sw.scan(spark, path).count() == 5
    assert sw.storage_size(spark, path).first()["n_files"] == len(list((tmp_path / "t").rglob("*.parquet")))


def test_readers_see_the_old_or_the_new_table(spark, tmp_path):
    path, seen, stop = str(tmp_path / "t"), [], threading.Event()
    sw.write_table(spark.range(100).withColumn("v", F.lit(0)), path)

    def read():
        while not stop.is_set():
            seen.append(tuple(sw.scan(spark, path).agg(F.count("*"), F.min("v"), F.max("v")).first()))

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 6):
        sw.write_table(spark.range(100).withColumn("v", F.lit(v)), path)
        time.sleep(0.3)
    stop.set()
    reader.join()
    assert seen and all(n == 100 and low == high for n, low, high in seen)
    assert [s[1] for s in seen] == sorted(s[1] for s in seen)
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == versions.KEPT


def test_a_table_is_written_from_itself_and_over_plain_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    sw.write_table(sw.scan(spark, path).filter("id > 3"), path)
    assert rows(sw.scan(spark, path)) == [(i,) for i in range(4, 10)]
    assert {f for f in os.listdir(path) if not f.startswith((".", "v-"))} == {"_versions"}
    sw.write_table(spark.range(2), str(tmp_path / "plain"), versioned=False)
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 2


def test_abandoned_versions_go_after_a_day(spark, tmp_path):
    path = tmp_path / "t"
    sw.write_table(spark.range(1), str(path))
    for name, hours in (("v-running", 1), ("v-dead", 30)):
        (path / name).mkdir()
        os.utime(path / name, (time.time() - hours * 3600,) * 2)
    sw.write_table(spark.range(2), str(path))
    assert (path / "v-running").exists() and not (path / "v-dead").exists()


def test_dotted_names_in_writes_and_structure(spark, tmp_path):
    df = spark.createDataFrame([(2, "x"), (1, "y"), (3, "x")], "`my.id` int, `a.b` string")
    sw.write_table(df, str(tmp_path / "t"), partition_by=["a.b"], sort_by=["my.id"])
    assert rows(sw.scan(spark, str(tmp_path / "t"))) == [(1, "y"), (2, "x"), (3, "x")]
    assert sw.structure(df, order_by=["my.id"]).first()["sample"] == "1 2 3"


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"f{i}").write_bytes(b"x" * (1 + i % 3))
    assert _files(spark, str(tmp_path)).rdd.getNumPartitions() <= LISTING_TASKS
    assert tuple(sw.storage_size(spark, str(tmp_path)).first()) == (3000, 6000)


# pruned grids


def test_pruned_grid_equals_grid_and_filter(spark):
    table = spark.createDataFrame([(i,) for i in (3, 1, 7, None, 3)], "x int")
    domains = {"a": table, "b": ["u", "v", None], "c": sw.labels_up_to("c", 30), "d": [1.5, 2.5]}
    cases = [
        [],
        [("a", 3, "b", "u"), ("c", "c5", "a", 7), ("a", 99, "b", "u"), ("c", "c05", "a", 1)],
        [("b", "v", "d", 1.5), ("d", 2.5, "b", None)],
        [("b", "u", "b", "u"), ("b", None, "c", "c3")],
        [("c", "c7", "d", 2.5), ("d", 2.5, "c", "c8"), ("a", 1, "d", 1.5)],
    ]
    for rules in cases:
        want = sw.exclude_pairs(sw.combination_grid(spark, domains, position="p"), rules)
        got = sw.allowed_grid(spark, domains, rules, position="p")
        assert got.dtypes == want.dtypes
        assert rows(got) == rows(want)
    empty = sw.allowed_grid(spark, {"a": table.limit(0), "b": [1, 2]}, [("a", 1, "b", 2)])
    assert empty.columns == ["a", "b"] and empty.count() == 0
    with pytest.raises(ValueError, match="no column"):
        sw.allowed_grid(spark, {"a": [1]}, [("a", 1, "z", 2)])


def test_pruned_grid_makes_no_row_that_goes(spark):
    grid = sw.allowed_grid(spark, sw.sample.DOMAINS, sw.sample.RULES)
    assert max(metrics(grid, ["Generate", "Range"], "numOutputRows")) == 2148
    # nothing of the whole grid of 10^12 rows is made but what is left
    wide = {c: sw.labels_up_to(c, 1000) for c in "abcd"}
    rules = [("a", f"a{i}", "b", f"b{j}") for i in (1, 2) for j in (1, 2)]
    few = {"a": ["a1", "a2"], "b": ["b1", "b2"], "c": wide["c"], "d": wide["d"]}
    assert max(metrics(sw.allowed_grid(spark, few, rules), ["Generate", "Range"], "numOutputRows"), default=0) <= 2


def test_wide_domains_are_cut(spark):
    grid = sw.allowed_grid(spark, {"a": ["x", "y"], "b": sw.labels_up_to("b", 200_000)}, [("a", "x", "b", "b77")], "p")
    assert grid.count() == 399_999
    assert grid.filter("p <> IF(a = 'y', 1, 0) + 2 * (CAST(substr(b, 2) AS INT) - 1)").count() == 0


@pytest.mark.parametrize("values", [[1, 2, 3], [1, 2**40], ["x", None], [1.5, 2.0], [Decimal("1.5"), Decimal("22.25")], [True]])
def test_literal_domains_have_one_type_at_any_length(spark, values, monkeypatch):
    short = sw.combination_grid(spark, {"a": values})
    monkeypatch.setattr("stepwell.sources.generate.MAX_LITERAL_VALUES", 0)
    long = sw.combination_grid(spark, {"a": values})
    assert long.dtypes == short.dtypes
    assert rows(long) == rows(short)


# ranges


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_ranges_in_slices(spark, width):
    data = brute.random_rows("ranges", 80, [9, 8, 30], nulls=0.2, hot=0.3)
    df = spark.createDataFrame(data, "a string, b string, c string")
    got = sw.absent_ranges(df, ["a", "b", "c"], slice_width=width)
    pairs = {c: sorted({r[i] for r in data if r[i] is not None}) for i, c in enumerate("abc")}
    listed = set()
    for r in got.collect():
        values = pairs[r["col_b"]]
        i, j = values.index(r["first_value"]), values.index(r["last_value"])
        assert j - i + 1 == r["n_values"]
        listed |= {(r["col_a"], r["value_a"], r["col_b"], v) for v in values[i : j + 1]}
    assert listed == brute.absent(data, ["a", "b", "c"])
    assert got.agg(F.sum("n_values")).first()[0] == len(listed)


def test_a_wide_domain_meets_few_values_in_slices(spark):
    ranges = sw.absent_ranges(sw.scan(spark, LINES), ["l_tax", "l_partkey"], slice_width=100)
    ranges.collect()
    windows = [line for line in plan_lines(ranges) if re.search(r"Window \[lead\(place", line)]
    assert windows and all("slice" in line for line in windows)


# scratch folders


def left(spark):
    root = Path(session.shared_dir(spark)) / f"{session.SCRATCH}{spark.sparkContext.applicationId}"
    return sorted(os.listdir(root)) if root.exists() else []


def test_registered_queries_leave_no_folder(spark):
    before = left(spark)
    for query in registered.ALL:
        with sw.scratch(spark):
            query(spark, SF).write.format("noop").mode("overwrite").save()
        assert left(spark) == before, query.__name__


def test_a_block_that_fails_leaves_no_folder(spark):
    before = left(spark)
    with pytest.raises(RuntimeError), sw.scratch(spark):
        sw.build_index(sw.scan(spark, f"{SF}/part.parquet"), registered.PART_LEVELS)
        with sw.scratch(spark):
            session.stored(spark.range(3))
        assert len(left(spark)) == len(before) + 1
        raise RuntimeError
    assert left(spark) == before


def test_sweep_removes_what_killed_applications_left(spark):
    shared = Path(session.shared_dir(spark))
    for name, hours in (("app-1", 100), ("app-2", 1)):
        folder = shared / f"{session.SCRATCH}{name}"
        (folder / "x").mkdir(parents=True)
        os.utime(folder, (time.time() - hours * 3600,) * 2)
    session.stored(spark.range(3))
    assert sw.sweep(spark, older_than_hours=24) == 1
    assert not (shared / f"{session.SCRATCH}app-1").exists() and (shared / f"{session.SCRATCH}app-2").exists()
    assert left(spark)
