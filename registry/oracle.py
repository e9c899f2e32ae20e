"""DuckDB SQL for each registered query, written from the meaning of the operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from registry.queries import (
    COPIES,
    CUSTOMER_LEVELS,
    DEFAULT_PICKS,
    ORDER_RULES,
    PART_LEVELS,
    PART_RULES,
    RATE_LEVELS,
    SUPPLY_LEVELS,
)

PART_REQUESTS = """
SELECT a.p_partkey AS request_id, a.p_brand, b.p_type, c.p_size
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 LEFT JOIN part c ON c.p_partkey = a.p_partkey + 2"""

PART_REQUESTS_WITH_GAPS = f"""
SELECT request_id, p_brand,
       CASE WHEN p_size > 10 THEN p_type END AS p_type,
       CASE WHEN p_type <> 'PROMO' THEN p_size END AS p_size
FROM ({PART_REQUESTS})"""

SUPPLY_REQUESTS = """
SELECT l_orderkey AS request_id, l_suppkey, l_partkey + 1 AS l_partkey, l_returnflag, l_linestatus,
       CAST(l_linenumber % 7 + 1 AS INTEGER) AS l_linenumber
FROM lineitem"""

RATE_REQUESTS = """
SELECT l_orderkey AS request_id, l_returnflag, l_linestatus,
       CAST(l_linenumber % 7 + 1 AS INTEGER) AS l_linenumber, l_discount, l_tax
FROM lineitem"""

STREAM_REQUESTS = """
SELECT p_partkey AS request_id, p_brand, p_type, CAST(51 - p_size AS INTEGER) AS p_size FROM part"""

ORDER_REQUESTS = """
SELECT o_orderkey AS request_id, o_custkey % 120 AS l_suppkey, o_orderkey % 2000 AS l_partkey, 'R' AS l_returnflag,
       o_orderstatus AS l_linestatus, CAST(o_orderkey % 7 + 1 AS INTEGER) AS l_linenumber
FROM orders"""

LINES_NOW = """(
SELECT l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax FROM lineitem
WHERE NOT (l_linestatus = 'F' AND l_discount > CAST(0.04 AS DOUBLE))
UNION ALL
SELECT l_returnflag, l_linestatus, CAST(l_linenumber + 4 AS INTEGER), l_discount, l_tax + 1 FROM lineitem
WHERE l_returnflag = 'A')"""

SUPPLIER_REQUESTS = """
SELECT s_suppkey AS request_id, s_nationkey AS c_nationkey, 'BUILDING' AS c_mktsegment
FROM supplier"""


def literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def known(levels: Sequence[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in levels)


def cascade_steps(
    requests: str,
    table: str,
    levels: Sequence[str],
    start: int = 1,
    test_from: Mapping[str, str] | None = None,
    on_missing: str = "first",
    only: int | None = None,
) -> str:
    """WITH list that settles one level after the other; ends in ``settled``."""
    test_from = test_from or {}
    parts = [f"settled_{start} AS ({requests})"]
    stop = only or len(levels)
    extra: list[str] = []
    for k in range(start + 1, stop + 1):
        above, level = levels[: k - 1], levels[k - 1]
        keys = ", ".join(above)
        parts.append(
            f"choice_{k} AS (SELECT DISTINCT {keys}, {level} FROM {table} WHERE {known(levels[:k])})"
        )
        parts.append(f"first_{k} AS (SELECT {keys}, min({level}) AS f, count(*) AS n FROM choice_{k} GROUP BY {keys})")
        tested = f"r.{test_from.get(level, level)}"
        same = " AND ".join(f"r.{c} = {{t}}.{c}" for c in above)
        chosen = f"CASE WHEN e.{level} IS NOT NULL THEN {tested} ELSE f.f END"
        if on_missing == "skip":
            chosen = f"CASE WHEN {tested} IS NULL THEN NULL WHEN e.{level} IS NOT NULL THEN {tested} ELSE f.f END"
        others = [f"r.{c}" for c in levels if c != level] + [f"r.{c}" for c in extra]
        parts.append(
            f"settled_{k} AS (SELECT r.request_id, {', '.join(others)}, {chosen} AS {level}, "
            f"r.{level} AS old_{k}, coalesce(f.n, 0) AS n_{k}, e.{level} IS NOT NULL AS kept_{k} "
            f"FROM settled_{k - 1} r "
            f"LEFT JOIN choice_{k} e ON {same.format(t='e')} AND {tested} = e.{level} "
            f"LEFT JOIN first_{k} f ON {same.format(t='f')})"
        )
        extra += [f"old_{k}", f"n_{k}", f"kept_{k}"]
    parts.append(f"settled AS (SELECT * FROM settled_{stop})")
    return "WITH " + ",\n".join(parts)


def cascade(requests: str, table: str, levels: Sequence[str], **options) -> str:
    return f"{cascade_steps(requests, table, levels, **options)}\nSELECT request_id, {', '.join(levels)} FROM settled"


def trace(requests: str, table: str, levels: Sequence[str]) -> str:
    rows = []
    came_from = "start"
    for k in range(2, len(levels) + 1):
        level = levels[k - 1]
        rows.append(
            f"SELECT request_id, CAST({k - 1} AS INTEGER) AS step, '{level}' AS level, '{came_from}' AS came_from, "
            f"CAST(old_{k} AS VARCHAR) AS old_value, CAST({level} AS VARCHAR) AS new_value, "
            f"CAST(n_{k} AS BIGINT) AS n_choices, kept_{k} AS kept FROM settled"
        )
        came_from = level
    return f"{cascade_steps(requests, table, levels)}\n" + "\nUNION ALL ".join(rows)


def all_choices(requests: str, table: str, levels: Sequence[str]) -> str:
    rows = []
    for k in range(2, len(levels) + 1):
        above, level = levels[: k - 1], levels[k - 1]
        keys = ", ".join(above)
        same = " AND ".join(f"r.{c} = c.{c}" for c in above)
        rows.append(
            f"SELECT r.request_id, CAST({k} AS INTEGER) AS level, CAST(c.place AS INTEGER) AS position, "
            f"CAST(c.{level} AS VARCHAR) AS value FROM requests r JOIN "
            f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {level}) AS place FROM "
            f"(SELECT DISTINCT {keys}, {level} FROM {table} WHERE {level} IS NOT NULL)) c ON {same}"
        )
    return f"WITH requests AS ({requests})\n" + "\nUNION ALL ".join(rows)


def ranges_missing(table: str, cols: Sequence[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    values = "\nUNION ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {table} WHERE {c} IS NOT NULL" for c in cols)
    seen = "\nUNION ".join(
        f"SELECT '{a}' AS col_a, CAST({a} AS VARCHAR) AS value_a, '{b}' AS col_b, CAST({b} AS VARCHAR) AS value_b "
        f"FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in pairs
    )
    marks = "\nUNION ALL ".join(f"SELECT col, value, '{b}', -1 FROM places WHERE col = '{a}'" for a, b in pairs)
    return f"""WITH domain_values AS ({values}),
places AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS place,
           count(*) OVER (PARTITION BY col) AS size FROM domain_values),
seen AS ({seen}),
marked AS (SELECT col_a, value_a, col_b, place FROM seen JOIN places ON col = col_b AND value = value_b
           UNION ALL {marks}),
gaps AS (SELECT col_a, value_a, col_b, place + 1 AS lo, coalesce(
           lead(place) OVER (PARTITION BY col_a, value_a, col_b ORDER BY place),
           (SELECT max(size) FROM places WHERE col = col_b)) - 1 AS hi FROM marked)
SELECT g.col_a, g.value_a, g.col_b, f.value AS first_value, l.value AS last_value,
       CAST(hi - lo + 1 AS BIGINT) AS n_values
FROM gaps g JOIN places f ON f.col = g.col_b AND f.place = lo JOIN places l ON l.col = g.col_b AND l.place = hi
WHERE hi >= lo"""


def first_invalid(requests: str, table: str, levels: Sequence[str]) -> str:
    tests = []
    for k in range(1, len(levels) + 1):
        same = " AND ".join(f"t.{c} = r.{c}" for c in levels[:k])
        tests.append(f"WHEN NOT EXISTS (SELECT 1 FROM {table} t WHERE {same}) THEN {k}")
    return (
        f"SELECT request_id, CAST(CASE {' '.join(tests)} END AS INTEGER) AS first_invalid_level "
        f"FROM ({requests}) r"
    )


def pairs_missing(table: str, cols: Sequence[str]) -> str:
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(
            f"SELECT '{a}' AS col_a, CAST(x.v AS VARCHAR) AS value_a, '{b}' AS col_b, CAST(y.v AS VARCHAR) AS value_b "
            f"FROM (SELECT DISTINCT {a} AS v FROM {table} WHERE {a} IS NOT NULL) x "
            f"CROSS JOIN (SELECT DISTINCT {b} AS v FROM {table} WHERE {b} IS NOT NULL) y "
            f"ANTI JOIN (SELECT DISTINCT {a} AS a, {b} AS b FROM {table}) s ON s.a = x.v AND s.b = y.v"
        )
    return "\nUNION ALL ".join(parts)


def rules_hold(rules) -> str:
    return " AND ".join(
        f"NOT ({r.col_a} = {literal(r.value_a)} AND {r.col_b} = {literal(r.value_b)})" for r in rules
    )


def broken_counts(table: str, rules) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{r.name}' AS rule, count(*) FILTER (WHERE {r.col_a} = {literal(r.value_a)} "
        f"AND {r.col_b} = {literal(r.value_b)}) AS n_rows FROM {table}"
        for r in rules
    )


def columns_of(table: str, order_by: str, columns: Mapping[str, str], n: int = 6) -> str:
    head = f"(SELECT * FROM {table} ORDER BY {order_by} LIMIT {n})"
    return "\nUNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type, "
        f"string_agg(coalesce(CAST({c} AS VARCHAR), 'NA'), ' ' ORDER BY {order_by}) AS sample FROM {head}"
        for i, (c, t) in enumerate(columns.items(), 1)
    )


def size_text(size: str) -> str:
    """Byte count in binary units, three significant digits, no zeros after the point."""
    cases = []
    for power, unit in reversed(list(enumerate("BKMGTPE"))):
        scaled = f"round(({size}) / {float(1024**power)}, 2)"
        digits = f"CASE WHEN {scaled} >= 100 THEN round({scaled}, 0) WHEN {scaled} >= 10 THEN round({scaled}, 1) ELSE {scaled} END"
        shown = f"regexp_replace(CAST(CAST({digits} AS DECIMAL(20, 2)) AS VARCHAR), '\\.?0+$', '')"
        cases.append(f"WHEN ({size}) >= {1024**power if power else 0} THEN {shown} || '{unit}'")
    return f"CASE {' '.join(cases)} END"


# the stored file behind the view ``part`` is the one with as many rows
PART_FILE = """
SELECT f.size FROM read_blob('/root/testdata/*/part.parquet') f
JOIN parquet_file_metadata('/root/testdata/*/part.parquet') m ON m.file_name = f.filename
WHERE m.num_rows = (SELECT count(*) FROM part)"""

PART_GRID = """
SELECT * FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)
CROSS JOIN (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)
CROSS JOIN (SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL)"""

MESSAGE = "'Getting unique ' || {level} || ' to set selectInput choices: coming from ' || {came_from}"

ORACLE = {
    "scan": "SELECT * FROM supplier",
    "write_table": "SELECT * FROM part",
    "write_table_again": "SELECT *, 'before' AS state FROM part UNION ALL "
    "SELECT *, 'after' AS state FROM part WHERE p_size > 25",
    "storage_size": f"SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM ({PART_FILE})",
    "label_domain": "SELECT 'O' || CAST(i AS VARCHAR) AS label "
    "FROM (SELECT unnest(range(1, (SELECT count(*) FROM orders) + 1)) AS i)",
    "combination_grid": PART_GRID,
    "allowed_grid": f"""
WITH b AS (SELECT *, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS n
           FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)),
t AS (SELECT *, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)),
s AS (SELECT *, row_number() OVER (ORDER BY p_size) - 1 AS i
      FROM (SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL))
SELECT CAST(b.i + b.n * (t.i + t.n * s.i) AS BIGINT) AS position, p_brand, p_type, p_size
FROM b CROSS JOIN t CROSS JOIN s WHERE {rules_hold(PART_RULES)}""",
    "replicate_rows": f"SELECT c.* FROM customer c CROSS JOIN range({COPIES})",
    "stack_tables": "SELECT c_custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal, c_mktsegment, "
    "CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer UNION ALL "
    "SELECT NULL, s_name, s_nationkey, NULL, NULL, s_suppkey, s_acctbal FROM supplier",
    "build_table": f"SELECT g.* FROM ({PART_GRID}) g CROSS JOIN range({COPIES}) WHERE {rules_hold(PART_RULES)}",
    "where_equals": "SELECT * FROM part WHERE p_brand = 'Brand#17'",
    "drill_down": f"SELECT l_orderkey, l_partkey, {', '.join(RATE_LEVELS)} FROM lineitem "
    "WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 3 AND l_discount = CAST(0.05 AS DOUBLE)",
    "exclude_pairs": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders "
    f"WHERE {rules_hold(ORDER_RULES)}",
    "exclude_pair_table": "SELECT * FROM part p WHERE NOT EXISTS (SELECT 1 FROM part s "
    "WHERE s.p_size = 1 AND s.p_brand = p.p_brand AND s.p_type = p.p_type)",
    "is_member": "SELECT c_custkey, c_nationkey, c_nationkey IN "
    "(SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS ok FROM customer",
    "row_count": "SELECT count(*) AS n FROM lineitem",
    "root_choices": "SELECT DISTINCT p_brand FROM part",
    "choices": "SELECT DISTINCT p_size FROM part WHERE p_brand = 'Brand#17' AND p_type = 'ECONOMY' "
    "AND p_size IS NOT NULL",
    "choices_for": all_choices(PART_REQUESTS, "part", PART_LEVELS),
    "choices_for_customers": all_choices(SUPPLIER_REQUESTS, "customer", CUSTOMER_LEVELS),
    "preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 6",
    "resolve_selection": cascade(PART_REQUESTS, "part", PART_LEVELS),
    "keep_or_first": cascade(PART_REQUESTS, "part", PART_LEVELS, start=1, only=2),
    "resolve_changed_level": cascade(PART_REQUESTS, "part", PART_LEVELS, start=2),
    "resolve_literal": cascade(RATE_REQUESTS, "lineitem", RATE_LEVELS, test_from={"l_tax": "l_discount"}),
    "resolve_skip_missing": cascade(PART_REQUESTS_WITH_GAPS, "part", PART_LEVELS, on_missing="skip"),
    "resolve_fill_missing": cascade(PART_REQUESTS_WITH_GAPS, "part", PART_LEVELS),
    "resolve_sparse": cascade(SUPPLY_REQUESTS, "lineitem", SUPPLY_LEVELS),
    "resolve_stored_index": cascade(PART_REQUESTS, "part", PART_LEVELS),
    "resolve_buckets": cascade(ORDER_REQUESTS, "lineitem", SUPPLY_LEVELS),
    "resolve_stream_buckets": cascade(ORDER_REQUESTS, "lineitem", SUPPLY_LEVELS),
    "refresh_index": trace(RATE_REQUESTS, LINES_NOW, RATE_LEVELS),
    "update_index": f"SELECT {', '.join(RATE_LEVELS)}, count(*) AS n_rows FROM {LINES_NOW} GROUP BY ALL",
    "resolve_stream": cascade(STREAM_REQUESTS, "part", PART_LEVELS),
    "cascade_trace": trace(PART_REQUESTS, "part", PART_LEVELS),
    "cascade_trace_sparse": trace(SUPPLY_REQUESTS, "lineitem", SUPPLY_LEVELS),
    "trace_text": "SELECT request_id, array_to_string(['Order of events', 'Update start', "
    f"'Update p_type', 'Update p_size'], chr(10)) AS text FROM ({PART_REQUESTS})",
    "trace_messages": f"SELECT request_id, step, {MESSAGE.format(level='level', came_from='came_from')} AS message "
    f"FROM ({trace(PART_REQUESTS, 'part', PART_LEVELS)})",
    "check_selection": first_invalid(PART_REQUESTS_WITH_GAPS, "part", PART_LEVELS),
    "default_selection": cascade(
        "SELECT CAST(1 AS BIGINT) AS request_id, "
        + ", ".join(f"{literal(v)} AS {c}" for c, v in DEFAULT_PICKS.items()),
        "part",
        PART_LEVELS,
    ),
    "absent_pairs": pairs_missing("part", PART_LEVELS),
    "absent_ranges": ranges_missing("lineitem", ["l_suppkey", "l_partkey", "l_tax"]),
    "absent_ranges_wide": ranges_missing("lineitem", ["l_tax", "l_partkey"]),
    "absent_pairs_lines": pairs_missing("lineitem", ["l_partkey", "l_tax", "l_discount"]),
    "check_rules": broken_counts("part", PART_RULES),
    "structure": columns_of(
        "part",
        "p_partkey",
        {
            "p_partkey": "bigint",
            "p_name": "string",
            "p_brand": "string",
            "p_type": "string",
            "p_size": "int",
            "p_retailprice": "double",
        },
    ),
    "summary": f"""
SELECT n_rows, bytes, 'Dataset has ' || format('{{:,}}', n_rows) || ' rows (' || {size_text('bytes')} || ' on disk)' AS text
FROM (SELECT (SELECT count(*) FROM part) AS n_rows, (SELECT CAST(sum(size) AS BIGINT) FROM ({PART_FILE})) AS bytes)""",
    "scalar_functions": f"""
SELECT p_partkey,
       'P' || CAST(p_partkey AS VARCHAR) AS label,
       p_brand || chr(10) || p_type AS lines,
       CASE WHEN p_size BETWEEN 1 AND 26 THEN chr(64 + p_size) END AS letter,
       format('{{:,}}', p_partkey * 1001) AS thousands,
       {MESSAGE.format(level='p_brand', came_from='p_type')} AS message,
       NOT (p_brand = 'Brand#1' AND p_size = 1) AS allowed,
       coalesce(nullif(p_size, 1) > 25, FALSE) AS large,
       CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS class,
       p_brand || '|' || p_type AS trail,
       p_brand AS first,
       {size_text('p_partkey * p_size')} AS bytes_text
FROM part""",
}
