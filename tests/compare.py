"""Run every registered query next to its SQL: python tests/compare.py [scale folder] [names...]."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain_type(kind: pa.DataType) -> str:
    return "string" if pa.types.is_large_string(kind) else str(kind).split("[")[0]


def as_rows(table: pa.Table) -> tuple[list, Counter]:
    names = sorted(table.column_names)
    types = [(n, plain_type(table.schema.field(n).type)) for n in names]
    columns = [[repr(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v for v in table[n].to_pylist()] for n in names]
    return types, Counter(zip(*columns))


def compare(spark, con, sf_dir: str, name: str) -> list[str]:
    """Differences between a query and its SQL, none if they agree."""
    got_types, got = as_rows(contract.queries()[name](spark, sf_dir).toArrow())
    result = con.sql(contract.oracle_sql()[name]).to_arrow_table()
    want_types, want = as_rows(result)
    problems = []
    if got_types != want_types:
        problems.append(f"types {got_types} != {want_types}")
    if got != want:
        problems.append(
            f"rows {got.total()} / {want.total()}, only here {list((got - want).items())[:3]}, "
            f"missing {list((want - got).items())[:3]}"
        )
    if not want.total():
        problems.append("no rows")
    return problems


if __name__ == "__main__":
    from stepwell import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.oracle_sql())
    spark = local_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    for name in names:
        began = time.perf_counter()
        try:
            problems = compare(spark, con, sf_dir, name)
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{name:24s} {time.perf_counter() - began:6.2f} s  {'; '.join(problems) or 'equal'}", flush=True)
