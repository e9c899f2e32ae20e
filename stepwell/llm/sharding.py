"""Sharding by extendible hashing.

Every row has a path of hash bits: first those of its id, then those of its row number, so
that rows of one id can be told apart too. A shard is a prefix of the path. Bytes are summed
once per prefix of a depth that the total suggests; shorter prefixes are sums of those. Every cell
then belongs to the shortest prefix that fits the limit, so only oversized buckets are
split on another bit. Cells that exceed the limit at this depth are split further, for
their rows alone. The directory has one entry per cell and is joined to the rows.

Column expressions, aggregates and joins only. Work and directory grow with the rows and the
shards; the hash spreads a hot source over all shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import Stored, column

SHARD_BYTES = 4 << 20
ID_BITS, ROW_BITS = 40, 20
PATH_BITS = ID_BITS + ROW_BITS
#: Bits beyond those that equal shards would need.
SPARE_BITS = 3
STEP_BITS = 8


def _path(doc_id: Column, row: Column) -> Column:
    """Hash bits of a row as a number of ``PATH_BITS`` bits."""
    own = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, ID_BITS // 4)
    number = F.substring(F.md5(row.cast("string").cast("binary")), 1, ROW_BITS // 4)
    return F.conv(F.concat(own, number), 16, 10).cast("bigint")


def _cell(depth: int) -> Column:
    return F.shiftright(F.col("_path"), PATH_BITS - depth)


def _split(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Per cell of ``high`` bits the shortest depth from ``low`` that fits, else ``high`` and ``_over``."""
    cells = rows.groupBy(_cell(high).alias("_cell")).agg(F.sum("n_bytes").alias("_b"), F.count(F.lit(1)).alias("_n"))
    depths = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_depth"))
    prefix = F.expr(f"shiftright(_cell, {high} - _depth)")
    sums = depths.groupBy("_depth", prefix.alias("_prefix")).agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n"))
    # a single row cannot be split
    fits = (F.col("_b") <= limit) | (F.col("_n") == 1)
    chosen = (
        depths.select("_cell", "_depth", prefix.alias("_prefix"))
        .join(sums.hint("merge"), ["_depth", "_prefix"])
        .groupBy("_cell")
        .agg(F.min(F.when(fits, F.col("_depth"))).alias("_fit"))
    )
    return chosen.select(
        "_cell", F.coalesce("_fit", F.lit(high)).alias("_depth"), F.col("_fit").isNull().alias("_over")
    )


def assign(
    docs: DataFrame, limit_bytes: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Shard of every row: struct ``_row`` (columns in ``carry``; all if None), n_bytes, shard, depth.

    ``shard`` is the prefix as a string of bits, empty while one shard holds everything. Null text counts
    as zero bytes; a null id is hashed as such. Rows that repeat an id are told apart by their row number. A row
    larger than the limit gets a shard of its own. No rows give no rows.
    """
    store = Stored(docs.sparkSession)
    own = F.struct("*") if carry is None else F.struct(*[column(c) for c in carry])
    numbered = docs.select(
        own.alias("_row"),
        column(doc_id).alias("_id"),
        F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.monotonically_increasing_id().alias("_number"),
    )
    # stored before the row numbers are used, so that they stay as they are
    rows = store.keep(numbered).withColumn("_path", _path(F.col("_id"), F.col("_number")))
    total = rows.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    low, high = 0, min(PATH_BITS, max(1, (2 * total // limit_bytes).bit_length()) + SPARE_BITS)
    parts, open_rows = [], rows
    while True:
        # files tell little of the size of a directory in memory, so it is never broadcast
        cells = store.keep(_split(open_rows, low, high, limit_bytes)).hint("merge")
        keyed = open_rows.withColumn("_cell", _cell(high)).join(cells, "_cell").drop("_cell")
        deepest = high == PATH_BITS or cells.filter("_over").isEmpty()
        parts.append(keyed if deepest else keyed.filter(~F.col("_over")))
        if deepest:
            break
        open_rows = keyed.filter("_over").drop("_depth", "_over")
        low, high = high + 1, min(PATH_BITS, high + STEP_BITS)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    bits = F.lpad(F.bin(F.expr(f"shiftright(_path, {PATH_BITS} - _depth)")), PATH_BITS, "0")
    return whole.select(
        "_row",
        "n_bytes",
        F.substring(bits, F.lit(PATH_BITS + 1) - F.col("_depth"), F.col("_depth")).alias("shard"),
        F.col("_depth").alias("depth"),
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int = SHARD_BYTES, **names: str) -> None:
    """Write the rows below ``path``, one folder per shard (``shard=0``, ``shard=10`` and so on)."""
    rows = assign(docs, limit_bytes, **names).select("_row.*", F.concat(F.lit("s"), "shard").alias("shard"))
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
