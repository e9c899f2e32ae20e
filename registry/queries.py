"""One query per operator, each over whole tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import stepwell as sw
from stepwell.session import shared_dir

PART_LEVELS = ["p_brand", "p_type", "p_size"]
SUPPLY_LEVELS = ["l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber"]
RATE_LEVELS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]
CUSTOMER_LEVELS = ["c_nationkey", "c_mktsegment"]
DEFAULT_PICKS = {"p_brand": "Brand#17", "p_type": "SMALL", "p_size": 50}
ORDER_RULES = [
    sw.PairRule("o_orderstatus", "F", "o_orderpriority", "1-URGENT"),
    sw.PairRule("o_orderstatus", "O", "o_orderpriority", "2-HIGH"),
    sw.PairRule("o_orderstatus", "P", "o_orderpriority", "3-MEDIUM"),
]
PART_RULES = [
    sw.PairRule("p_brand", "Brand#1", "p_type", "PROMO"),
    sw.PairRule("p_brand", "Brand#2", "p_size", 2),
    sw.PairRule("p_type", "LARGE", "p_size", 1),
    sw.PairRule("p_type", "SMALL", "p_size", 50),
]
COPIES = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sw.scan(spark, f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A path of its own per application, scale and query, in the shared folder."""
    scale = sf_dir.rstrip("/").split("/")[-1]
    return f"{shared_dir(spark)}/registry/{spark.sparkContext.applicationId}/{scale}/{name}"


# requests


def part_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: its own brand, the type of the next part, the size of the one after; null where there is none."""
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("request_id"), "p_brand")
    next_type = part.select((F.col("p_partkey") - 1).alias("request_id"), "p_type")
    later_size = part.select((F.col("p_partkey") - 2).alias("request_id"), "p_size")
    return own.join(next_type, "request_id", "left").join(later_size, "request_id", "left")


def part_requests_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part_requests`` with some types and sizes not set."""
    return part_requests(spark, sf_dir).select(
        "request_id",
        "p_brand",
        F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"),
        F.when(F.col("p_type") != "PROMO", F.col("p_size")).alias("p_size"),
    )


def supply_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line: its supplier, the part after its own, and its other values, the line number moved on."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        "l_suppkey",
        (F.col("l_partkey") + 1).alias("l_partkey"),
        "l_returnflag",
        "l_linestatus",
        (F.col("l_linenumber") % 7 + 1).alias("l_linenumber"),
    )


def rate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line: its own values, the line number moved on."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        "l_returnflag",
        "l_linestatus",
        (F.col("l_linenumber") % 7 + 1).alias("l_linenumber"),
        "l_discount",
        "l_tax",
    )


def order_requests(orders: DataFrame) -> DataFrame:
    """Per order: values that follow from its keys; some suppliers, parts and states do not occur."""
    return orders.selectExpr(
        "o_orderkey AS request_id",
        "o_custkey % 120 AS l_suppkey",
        "o_orderkey % 2000 AS l_partkey",
        "'R' AS l_returnflag",
        "o_orderstatus AS l_linestatus",
        "CAST(o_orderkey % 7 + 1 AS INT) AS l_linenumber",
    )


def changed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that come, with another line number and tax, and lines that go."""
    added = lines.filter("l_returnflag = 'A'").select(
        *[c for c in RATE_LEVELS if c not in ("l_linenumber", "l_tax")],
        (F.col("l_linenumber") + 4).alias("l_linenumber"),
        (F.col("l_tax") + 1).alias("l_tax"),
    )
    return added, lines.filter("l_linestatus = 'F' AND l_discount > 0.04")


def supplier_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: its nation and one market segment."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.lit("BUILDING").alias("c_mktsegment"),
    )


def part_index(spark: SparkSession, sf_dir: str) -> sw.LevelIndex:
    return sw.build_index(table(spark, sf_dir, "part"), PART_LEVELS)


# sources and sinks


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier")


def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, sf_dir, "write_table")
    sw.write_table(table(spark, sf_dir, "part"), path, partition_by=["p_type"])
    return sw.scan(spark, path)


def write_table_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is replaced by some of its own rows, under a reader."""
    path = scratch(spark, sf_dir, f"write_table_again-{uuid4().hex}")
    sw.write_table(table(spark, sf_dir, "part"), path)
    before = sw.scan(spark, path)
    sw.write_table(before.filter("p_size > 25"), path, partition_by=["p_type"])
    after = sw.scan(spark, path).withColumn("state", F.lit("after"))
    return before.withColumn("state", F.lit("before")).unionByName(after)


def storage_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.storage_size(spark, f"{sf_dir}/part.parquet")


# generators and row multiplication


def label_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per order."""
    return sw.label_domain(spark, "O", table(spark, sf_dir, "orders").count(), "label")


def combination_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return sw.combination_grid(spark, {c: part.select(c) for c in PART_LEVELS})


def allowed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid without what the rules exclude, numbered as the whole grid."""
    part = table(spark, sf_dir, "part")
    return sw.allowed_grid(spark, {c: part.select(c) for c in PART_LEVELS}, PART_RULES, position="position")


def replicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.replicate_rows(table(spark, sf_dir, "customer"), COPIES, partitions=8)


def stack_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumnsRenamed({"c_name": "name", "c_nationkey": "nationkey"})
    supplier = table(spark, sf_dir, "supplier").withColumnsRenamed({"s_name": "name", "s_nationkey": "nationkey"})
    return sw.stack_tables(customer, supplier)


def build_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid, exclusion, replication and write, as the sample table is built."""
    path = scratch(spark, sf_dir, "build_table")
    part = table(spark, sf_dir, "part")
    allowed = sw.allowed_grid(spark, {c: part.select(c) for c in PART_LEVELS}, PART_RULES)
    sw.write_table(sw.replicate_rows(allowed, COPIES), path)
    return sw.scan(spark, path)


# filters


def where_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.where_equals(table(spark, sf_dir, "part"), "p_brand", "Brand#17")


def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *RATE_LEVELS)
    return sw.drill_down(lines, RATE_LEVELS, ["R", "F", 3, 0.05])


def exclude_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sw.exclude_pairs(orders, ORDER_RULES)


def exclude_pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose brand and type never occur together with size 1."""
    part = table(spark, sf_dir, "part")
    rules = part.filter("p_size = 1").select(F.col("p_brand").alias("value_a"), F.col("p_type").alias("value_b"))
    return sw.exclude_pair_table(part, rules, "p_brand", "p_type")


def is_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer lives in a nation with a supplier in debt."""
    in_debt = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return sw.is_member(customers, in_debt, "c_nationkey")


# counts, choices, previews


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.row_count(table(spark, sf_dir, "lineitem"))


def root_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.root_choices(table(spark, sf_dir, "part"), "p_brand")


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.choices(table(spark, sf_dir, "part"), PART_LEVELS, ["Brand#17", "ECONOMY"])


def choices_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.choices_for(part_requests(spark, sf_dir), part_index(spark, sf_dir))


def choices_for_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.choices_for(supplier_requests(spark, sf_dir), table(spark, sf_dir, "customer"), CUSTOMER_LEVELS)


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.preview(table(spark, sf_dir, "orders"), order_by=["o_orderkey"])


# cascade


def resolve_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.resolve_selection(part_requests(spark, sf_dir), part_index(spark, sf_dir))


def keep_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.keep_or_first(part_requests(spark, sf_dir), part_index(spark, sf_dir), "p_type")


def resolve_changed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.resolve_selection(part_requests(spark, sf_dir), part_index(spark, sf_dir), changed_level="p_type")


def resolve_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last level tests, and keeps, the value of the level above it."""
    lines = table(spark, sf_dir, "lineitem")
    return sw.resolve_selection(
        rate_requests(spark, sf_dir), lines, RATE_LEVELS, test_from={"l_tax": "l_discount"}
    )


def resolve_skip_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = part_requests_with_gaps(spark, sf_dir)
    return sw.resolve_selection(requests, part_index(spark, sf_dir), on_missing="skip")


def resolve_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.resolve_selection(part_requests_with_gaps(spark, sf_dir), part_index(spark, sf_dir))


def resolve_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of high cardinality: nearly every line is a combination of its own."""
    return sw.resolve_selection(supply_requests(spark, sf_dir), table(spark, sf_dir, "lineitem"), SUPPLY_LEVELS)


def resolve_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is written once and read back."""
    path = scratch(spark, sf_dir, "part_index")
    sw.write_index(part_index(spark, sf_dir), path)
    return sw.resolve_selection(part_requests(spark, sf_dir), sw.read_index(spark, path))


def supply_index_in_buckets(spark: SparkSession, sf_dir: str) -> sw.LevelIndex:
    """Stored, with every level in buckets and none to be broadcast."""
    path = scratch(spark, sf_dir, f"supply_index-{uuid4().hex}")
    built = sw.build_index(table(spark, sf_dir, "lineitem"), SUPPLY_LEVELS, broadcast_bytes=0)
    sw.write_index(built, path)
    built.unpersist()
    return sw.read_index(spark, path, broadcast_bytes=0)


def resolve_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index too large to be broadcast stays where it is stored."""
    requests = order_requests(table(spark, sf_dir, "orders"))
    return sw.resolve_selection(requests, supply_index_in_buckets(spark, sf_dir))


def resolve_stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for requests that arrive as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    requests = order_requests(sw.request_stream(spark, sf_dir, schema, "orders.parquet"))
    name = f"resolve_stream_buckets-{uuid4().hex}"
    answers = scratch(spark, sf_dir, name)
    sw.answer_requests(requests, supply_index_in_buckets(spark, sf_dir), answers, name).awaitTermination()
    return sw.scan(spark, answers)


def refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps under an index that has followed lines that came and lines that went."""
    lines = table(spark, sf_dir, "lineitem")
    index = sw.refresh_index(sw.build_index(lines, RATE_LEVELS), *changed_lines(lines))
    return sw.cascade_trace(rate_requests(spark, sf_dir), index)


def update_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per combination in a stored index that was brought up to date in its place."""
    lines = table(spark, sf_dir, "lineitem")
    path = scratch(spark, sf_dir, f"update_index-{uuid4().hex}")
    sw.write_index(sw.build_index(lines, RATE_LEVELS), path)
    sw.update_index(spark, path, *changed_lines(lines))
    return sw.read_index(spark, path).combinations.select(*RATE_LEVELS, "n_rows")


def resolve_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests read as a stream of files: each part asks for its brand and type, the size turned round."""
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    parts = sw.request_stream(spark, sf_dir, schema, "part.parquet")
    requests = parts.select(
        F.col("p_partkey").alias("request_id"),
        "p_brand",
        "p_type",
        (F.lit(51) - F.col("p_size")).alias("p_size"),
    )
    name = f"resolve_stream-{uuid4().hex}"
    answers = scratch(spark, sf_dir, name)
    sw.answer_requests(requests, part_index(spark, sf_dir), answers, name).awaitTermination()
    return sw.scan(spark, answers)


def cascade_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.cascade_trace(part_requests(spark, sf_dir), part_index(spark, sf_dir))


def cascade_trace_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many combinations that choices are counted in slices."""
    return sw.cascade_trace(supply_requests(spark, sf_dir), table(spark, sf_dir, "lineitem"), SUPPLY_LEVELS)


def trace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.trace_text(cascade_trace(spark, sf_dir))


def trace_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.trace_messages(cascade_trace(spark, sf_dir))


def check_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.check_selection(part_requests_with_gaps(spark, sf_dir), part_index(spark, sf_dir))


def default_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.resolve_selection(sw.default_selection(spark, DEFAULT_PICKS), part_index(spark, sf_dir))


# reports


def absent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.absent_pairs(table(spark, sf_dir, "part"), PART_LEVELS)


def absent_pairs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.absent_pairs(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_tax", "l_discount"])


def absent_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.absent_ranges(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_tax"])


def absent_ranges_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few values against a wide domain, whose gaps are found in slices."""
    return sw.absent_ranges(table(spark, sf_dir, "lineitem"), ["l_tax", "l_partkey"], slice_width=256)


def check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.check_rules(table(spark, sf_dir, "part"), PART_RULES)


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.structure(table(spark, sf_dir, "part"), order_by=["p_partkey"])


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.summary(spark, f"{sf_dir}/part.parquet")


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, kind, size = F.col("p_brand"), F.col("p_type"), F.col("p_size")
    trail = sw.append_entry(F.array(brand), kind)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        sw.label("P", F.col("p_partkey")).alias("label"),
        sw.join_lines(F.array(brand, kind)).alias("lines"),
        sw.letter(size).alias("letter"),
        sw.thousands(F.col("p_partkey") * 1001).alias("thousands"),
        sw.update_message(brand, kind).alias("message"),
        (~((brand == "Brand#1") & (size == 1))).alias("allowed"),
        sw.is_true(F.nullif(size, F.lit(1)) > 25).alias("large"),
        F.when(size > 25, "big").otherwise("small").alias("class"),
        F.array_join(trail, "|").alias("trail"),
        sw.first_entry(trail).alias("first"),
        sw.file_size_text(F.col("p_partkey") * size).alias("bytes_text"),
    )


ALL = [
    scan,
    write_table,
    write_table_again,
    storage_size,
    label_domain,
    combination_grid,
    allowed_grid,
    replicate_rows,
    stack_tables,
    build_table,
    where_equals,
    drill_down,
    exclude_pairs,
    exclude_pair_table,
    is_member,
    row_count,
    root_choices,
    choices,
    choices_for,
    choices_for_customers,
    preview,
    resolve_selection,
    keep_or_first,
    resolve_changed_level,
    resolve_literal,
    resolve_skip_missing,
    resolve_fill_missing,
    resolve_sparse,
    resolve_stored_index,
    resolve_buckets,
    resolve_stream_buckets,
    refresh_index,
    update_index,
    resolve_stream,
    cascade_trace,
    cascade_trace_sparse,
    trace_text,
    trace_messages,
    check_selection,
    default_selection,
    absent_pairs,
    absent_pairs_lines,
    absent_ranges,
    absent_ranges_wide,
    check_rules,
    structure,
    summary,
    scalar_functions,
]
