"""The cascade and its reports against brute force, with nulls, hot values and all sorting paths."""

import random

import pytest

import brute
import stepwell as sw

LEVELS = ["a", "b", "c", "d"]
SCHEMA = ", ".join(f"{c} string" for c in LEVELS)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def request_rows(seed, n, nulls):
    pick = random.Random(seed)
    return [
        tuple(f"v{pick.randrange(6)}" if pick.random() >= nulls else None for _ in LEVELS) for _ in range(n)
    ]


def request_table(spark, requests):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], f"request_id bigint, {SCHEMA}")


def by_id(df, *columns):
    return {r["request_id"]: tuple(r[c] for c in columns) for r in df.collect()}


CASES = {
    "plain": dict(nulls=0.0, hot=0.0),
    "nulls": dict(nulls=0.2, hot=0.0),
    "hot": dict(nulls=0.05, hot=0.5),
}


@pytest.fixture(scope="module", params=[(case, tasks) for case in CASES for tasks in ("one task", "slices")], ids=" ".join)
def case(request, spark):
    name, tasks = request.param
    rows = brute.random_rows(name, 150, [4, 4, 5, 5], **CASES[name])
    requests = request_rows(name + "r", 120, 0.15 if name != "plain" else 0.0)
    limits = {} if tasks == "one task" else {"one_task_rows": 0, "group_limit": 1}
    index = sw.build_index(table(spark, rows), LEVELS, **limits)
    yield rows, requests, request_table(spark, requests), index
    index.unpersist()


@pytest.mark.parametrize("on_missing", ["first", "skip"])
@pytest.mark.parametrize("start", [1, 3])
@pytest.mark.parametrize("test_from", [None, {"c": "b", "d": "b"}])
def test_resolve(case, on_missing, start, test_from):
    rows, requests, asked, index = case
    options = dict(test_from=test_from, on_missing=on_missing)
    got = by_id(sw.resolve_selection(asked, index, changed_level=start, **options), *LEVELS)
    for i, request in enumerate(requests):
        assert got[i] == brute.resolve(rows, LEVELS, request, start, **options)[0], request


def test_keep_or_first(case):
    rows, requests, asked, index = case
    got = by_id(sw.keep_or_first(asked, index, "c"), *LEVELS)
    for i, request in enumerate(requests):
        assert got[i] == brute.resolve(rows, LEVELS, request, start=2, stop=3)[0]


def test_trace(case):
    rows, requests, asked, index = case
    got = {
        (r["request_id"], r["step"]): (r["level"], r["old_value"], r["new_value"], r["n_choices"], r["kept"])
        for r in sw.cascade_trace(asked, index).collect()
    }
    for i, request in enumerate(requests):
        for step, expected in enumerate(brute.resolve(rows, LEVELS, request)[1], 1):
            assert got[i, step] == expected
    assert len(got) == 3 * len(requests)


def test_check_and_choices(case):
    rows, requests, asked, index = case
    got = by_id(sw.check_selection(asked, index), "first_invalid_level")
    offered = sorted(tuple(r) for r in sw.choices_for(asked, index).collect())
    expected = []
    for i, request in enumerate(requests):
        assert got[i][0] == brute.first_invalid(rows, request)
        for k in range(2, 5):
            found = brute.choices(rows, k, request[: k - 1])
            expected += [(i, k, place, value) for place, value in enumerate(found, 1)]
    assert offered == sorted(expected)


def test_properties(case):
    _, _, asked, index = case
    once = sw.resolve_selection(asked, index)
    twice = sw.resolve_selection(once, index)
    assert by_id(once, *LEVELS) == by_id(twice, *LEVELS)


@pytest.mark.parametrize("width", [1, 2, 4096])
@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_absent_pairs(spark, width, limit):
    rows = brute.random_rows("absent", 60, [9, 8, 7, 1], nulls=0.2, hot=0.3)
    rows.append(("only", None, None, None))
    found = sw.absent_pairs(table(spark, rows), LEVELS, slice_width=width, group_limit=limit)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute.absent(rows, LEVELS)


def test_stored_index_gives_the_same(spark, case, tmp_path):
    _, _, asked, index = case
    sw.write_index(index, str(tmp_path))
    stored = sw.read_index(spark, str(tmp_path))
    assert stored.levels == tuple(LEVELS)
    assert by_id(sw.resolve_selection(asked, index), *LEVELS) == by_id(sw.resolve_selection(asked, stored), *LEVELS)
    assert sorted(sw.cascade_trace(asked, index).collect()) == sorted(sw.cascade_trace(asked, stored).collect())
    assert sorted(sw.choices_for(asked, index).collect()) == sorted(sw.choices_for(asked, stored).collect())


def test_duplicate_request_ids_stay(spark):
    index = sw.build_index(table(spark, [("x", "y", "z", "w")]), LEVELS)
    asked = spark.createDataFrame([(1, "x", "n", "n", "n"), (1, "x", "n", "n", "n")], f"request_id bigint, {SCHEMA}")
    assert [tuple(r) for r in sw.resolve_selection(asked, index).collect()] == [(1, "x", "y", "z", "w")] * 2


def test_empty_inputs(spark):
    empty = table(spark, [])
    asked = request_table(spark, [("v0", "v1", "v2", "v3")])
    assert by_id(sw.resolve_selection(asked, empty, LEVELS), *LEVELS) == {0: ("v0", None, None, None)}
    assert by_id(sw.check_selection(asked, empty, LEVELS), "first_invalid_level") == {0: (1,)}
    assert sw.choices_for(asked, empty, LEVELS).count() == 0
    assert sw.absent_pairs(empty, LEVELS).count() == 0
    full = table(spark, [("v0", "v1", "v2", "v3")])
    assert sw.resolve_selection(asked.limit(0), full, LEVELS).count() == 0


def test_single_level(spark):
    one = spark.createDataFrame([("x",), ("y",)], "a string")
    asked = spark.createDataFrame([(1, "x"), (2, "n")], "request_id bigint, a string")
    assert by_id(sw.resolve_selection(asked, one, ["a"]), "a") == {1: ("x",), 2: ("n",)}
    assert by_id(sw.check_selection(asked, one, ["a"]), "first_invalid_level") == {1: (None,), 2: (1,)}
    assert sw.choices_for(asked, one, ["a"]).count() == 0


def test_numbers_sort_as_numbers(spark):
    rows = spark.createDataFrame([(1.5, 10), (1.5, 9), (0.0, 7)], "rate double, size int")
    asked = spark.createDataFrame([(1, 1.5, 3), (2, -0.0, 3)], "request_id bigint, rate double, size int")
    assert by_id(sw.resolve_selection(asked, rows, ["rate", "size"]), "size") == {1: (9,), 2: (7,)}
    offered = sw.choices_for(asked, rows, ["rate", "size"]).orderBy("request_id", "position").collect()
    assert [r["value"] for r in offered] == ["9", "10", "7"]


def test_test_from_another_type(spark):
    rows = spark.createDataFrame([("7", 3), ("7", 7), ("x", 5)], "name string, size int")
    asked = spark.createDataFrame([(1, "7", 3), (2, "x", 5)], "request_id bigint, name string, size int")
    got = sw.resolve_selection(asked, rows, ["name", "size"], test_from={"size": "name"})
    assert by_id(got, "size") == {1: (7,), 2: (5,)}


@pytest.mark.parametrize(
    "change",
    [dict(on_missing="never"), dict(test_from={"d": "e"}), dict(changed_level="e"), dict(changed_level=9)],
)
def test_wrong_options(spark, change):
    index = sw.build_index(table(spark, [("x", "y", "z", "w")]), LEVELS)
    with pytest.raises(ValueError):
        sw.resolve_selection(request_table(spark, [("x", "y", "z", "w")]), index, **change)


def test_wrong_types_and_names(spark):
    rows = spark.createDataFrame([("x", 1)], "a string, n_rows int")
    with pytest.raises(ValueError, match="rename"):
        sw.build_index(rows, ["a", "n_rows"])
    asked = spark.createDataFrame([(1, 5)], "request_id bigint, a int")
    with pytest.raises(ValueError, match="int in the requests"):
        sw.resolve_selection(asked, rows, ["a"])


def test_odd_names_and_types(spark):
    """Names that need quoting, a decimal, a date and a timestamp as levels."""
    levels = ["a, b", "c.d", "e{f}", "g`h"]
    rows = spark.sql("SELECT 1.50BD, DATE'2020-01-02', TIMESTAMP'2020-01-02 03:04:05', TRUE").toDF(*levels)
    rows = rows.union(spark.sql("SELECT 2.25BD, DATE'2020-01-01', TIMESTAMP'2020-01-02 03:04:05', FALSE"))
    index = sw.build_index(rows, levels)
    asked = spark.sql("SELECT 7, 2.25BD, DATE'2020-01-02', NULL :: TIMESTAMP, TRUE").toDF("request_id", *levels)
    settled = sw.resolve_selection(asked, index)
    assert [str(v) for v in settled.first()] == ["7", "2.25", "2020-01-01", "2020-01-02 03:04:05", "False"]
    offered = sw.choices_for(settled, index).orderBy("level").collect()
    assert [tuple(r) for r in offered] == [
        (7, 2, 1, "2020-01-01"),
        (7, 3, 1, "2020-01-02 03:04:05"),
        (7, 4, 1, "false"),
    ]
    assert sw.check_selection(asked, index).first()["first_invalid_level"] == 2
    assert sw.cascade_trace(asked, index).count() == 3


def test_default_pick_with_a_cast(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("x", 5)], "a string, b bigint")
    asked = sw.default_selection(spark, {"a": "x", "b": F.lit(4).cast("bigint")})
    assert sw.resolve_selection(asked, rows, ["a", "b"]).first()["b"] == 5


def test_absent_ranges_hold_the_absent_pairs(spark):
    rows = brute.random_rows("ranges", 60, [9, 8, 7, 1], nulls=0.2, hot=0.3)
    rows.append(("only", None, None, None))
    df = table(spark, rows)
    places = {}
    for i, c in enumerate(LEVELS):
        places[c] = sorted({str(r[i]) for r in rows if r[i] is not None})
    got = set()
    for r in sw.absent_ranges(df, LEVELS).collect():
        values = places[r["col_b"]]
        own = values[values.index(r["first_value"]) : values.index(r["last_value"]) + 1]
        assert len(own) == r["n_values"]
        got |= {(r["col_a"], r["value_a"], r["col_b"], v) for v in own}
    assert got == brute.absent(rows, LEVELS)
