"""The five-level sample table: exact values, worked out from its rules."""

from itertools import product

import pytest

import brute
import stepwell as sw
from stepwell.sample import DEFAULTS, LABELS, LEVELS, RULES, STATEMENTS, TEST_FROM


def expected_rows():
    """All combinations that break no rule, first column fastest."""
    rows = []
    for values in product(range(1, 6), repeat=5):
        row = dict(zip(LEVELS, (f"{c}{v}" for c, v in zip("ABCDE", reversed(values)))))
        if not any(row[r.col_a] == r.value_a and row[r.col_b] == r.value_b for r in RULES):
            rows.append(tuple(row.values()))
    return rows


def request_table(spark, rows):
    schema = "request_id bigint, " + ", ".join(f"{c} string" for c in LEVELS)
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)


def answers(df):
    return [tuple(row[c] for c in LEVELS) for row in df.orderBy("request_id").collect()]


def test_grid_is_whole(spark):
    grid = sw.combination_grid(spark, sw.sample.DOMAINS)
    assert grid.count() == 3125
    assert grid.distinct().count() == 3125


def test_rows_after_rules(grid):
    rows = [tuple(r) for r in grid.orderBy("place").select(*LEVELS).collect()]
    assert rows == expected_rows()
    assert len(rows) == 2148


def test_first_rows(grid):
    head = sw.preview(grid, order_by=["place"]).select(*LEVELS).collect()
    assert [tuple(r) for r in head] == [
        *[(f"A{i}", "B3", "C1", "D2", "E1") for i in range(1, 6)],
        ("A1", "B4", "C1", "D2", "E1"),
    ]


def test_prefixes_per_level(grid_index):
    assert grid_index.measures[:5] == (5, 24, 111, 487, 2148)


def test_statements_hold_but_one(grid):
    counts = {r["rule"]: r["n_rows"] for r in sw.check_rules(grid, STATEMENTS).collect()}
    assert {rule: n for rule, n in counts.items() if n} == {"colA=A4 & colE=E4": 111}
    assert sum(r["n_rows"] for r in sw.check_rules(grid, RULES).collect()) == 0


def test_absent_pairs_are_the_rules_that_bite(grid):
    found = {tuple(r) for r in sw.absent_pairs(grid, LEVELS).collect()}
    assert found == {tuple(r) for r in RULES if r.value_b != "E4"}


@pytest.mark.parametrize(
    "request_, own, literal",
    [
        ("A1 B2 C3 D4 E5", "A1 B2 C3 D4 E5", "A1 B2 C3 D1 E2"),
        ("A2 B2 C3 D4 E5", "A2 B2 C3 D4 E5", "A2 B2 C3 D1 E2"),
        ("A5 B2 C3 D4 E5", "A5 B2 C3 D4 E5", "A5 B2 C3 D1 E2"),
        ("A1 B1 C1 D1 E1", "A1 B2 C1 D3 E1", "A1 B2 C1 D3 E1"),
        ("A2 B1 C2 D2 E2", "A2 B1 C3 D2 E2", "A2 B1 C3 D1 E2"),
        ("A4 B3 C2 D1 E4", "A4 B3 C2 D1 E4", "A4 B3 C2 D1 E4"),
        ("A4 B3 C2 D1 E1", "A4 B3 C2 D1 E4", "A4 B3 C2 D1 E4"),
    ],
)
def test_resolved_selections(spark, grid_index, request_, own, literal):
    requests = request_table(spark, [request_.split()])
    assert answers(sw.resolve_selection(requests, grid_index)) == [tuple(own.split())]
    assert answers(sw.resolve_selection(requests, grid_index, test_from=TEST_FROM)) == [tuple(literal.split())]


def test_unknown_top_value_empties_the_rest(spark, grid_index):
    requests = request_table(spark, ["A9 B2 C3 D4 E5".split()])
    assert answers(sw.resolve_selection(requests, grid_index)) == [("A9", None, None, None, None)]


def test_default_choices(spark, grid_index):
    defaults = sw.default_selection(spark, DEFAULTS)
    offered = {}
    for row in sw.choices_for(defaults, grid_index).orderBy("position").collect():
        offered.setdefault(row["level"], []).append(row["value"])
    assert offered == {
        2: ["B2", "B3", "B4", "B5"],
        3: ["C1", "C2", "C3", "C4", "C5"],
        4: ["D1", "D3", "D4", "D5"],
        5: ["E1", "E2", "E3", "E4", "E5"],
    }


def test_choices_under_one_selection(grid):
    below = sw.choices(grid, LEVELS, ["A4", "B3", "C2", "D1"])
    assert [r[0] for r in below.collect()] == ["E4", "E5"]


def test_start_up_takes_one_refresh_per_level(spark, grid_index):
    trace = sw.cascade_trace(sw.default_selection(spark, DEFAULTS), grid_index, labels=LABELS)
    steps = [(r["step"], r["level"], r["came_from"], r["kept"]) for r in trace.orderBy("step").collect()]
    assert steps == [(1, "B", "start", True), (2, "C", "B", True), (3, "D", "C", True), (4, "E", "D", True)]
    assert sw.trace_text(trace).first()["text"].split("\n") == [
        "Order of events",
        "Update start",
        "Update B",
        "Update C",
        "Update D",
        "Update E",
    ]
    messages = sw.trace_messages(trace, prefix="col").orderBy("step").collect()
    assert messages[1]["message"] == "Getting unique colC to set selectInput choices: coming from B"


def test_all_selections_against_brute_force(spark, grid_index):
    rows = expected_rows()
    wanted = [tuple(f"{c}{v}" for c, v in zip("ABCDE", values)) for values in product(range(1, 6), repeat=5)]
    got = answers(sw.resolve_selection(request_table(spark, wanted), grid_index))
    by_prefix = {}
    for row in rows:
        for k in range(1, 6):
            by_prefix.setdefault(row[: k - 1], set()).add(row[k - 1])
    for request_, answer in zip(wanted, got):
        settled = request_[:1]
        for k in range(2, 6):
            offered = by_prefix[settled]
            settled += (request_[k - 1] if request_[k - 1] in offered else min(offered),)
        assert answer == settled


def test_copies_change_counts_only(spark, grid):
    many = sw.replicate_rows(grid, 3, partitions=4)
    assert many.count() == 3 * 2148
    assert sw.build_index(many, LEVELS).measures == sw.build_index(grid, LEVELS).measures
    assert sw.row_count(many).first()["n"] == 6444


def test_brute_force_agrees_on_defaults():
    settled, _ = brute.resolve(expected_rows(), LEVELS, tuple(DEFAULTS.values()))
    assert settled == tuple(DEFAULTS.values())
