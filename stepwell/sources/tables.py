"""Reading, writing and measuring stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.functions.names import column, quoted
from stepwell.sources.versions import current, publish

#: Tasks that list the files of a table, about.
LISTING_TASKS = 200


def scan(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Lazy table: a storage path, or a catalog name when it has no slash.

    Of a table that ``write_table`` has written, the version that is the last one now is read; a later write does not
    disturb it.
    """
    if "/" not in path:
        return spark.table(path)
    return spark.read.format(format).load(current(spark, path))


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    format: str = "parquet",
    sort_by: Sequence[str] = (),
    versioned: bool = True,
) -> None:
    """Write a whole table, replacing what the path holds.

    The replacement is atomic: ``scan`` finds the old table or the new one, and a write that
    fails leaves the old one. So a table may also be written from itself. ``versioned=False`` writes plain files for
    readers that know nothing of versions; Spark then deletes the old ones first.

    ``partition_by`` lays the files out by column value, so an equality filter
    on that column reads only its folder. Rows of a value are then brought
    together first, or every task would write a small file per value; a value
    that holds much of the table is split over several tasks again. ``sort_by``
    puts the rows of each file in order, so that readers can skip row groups.
    """
    if partition_by:
        df = df.hint("rebalance", *map(quoted, partition_by))
    if sort_by:
        df = df.sortWithinPartitions(*[column(c).asc_nulls_last() for c in [*partition_by, *sort_by]])
    writer = df.write.mode("overwrite").format(format).partitionBy(*partition_by)
    if versioned:
        publish(df.sparkSession, path, writer.save)
    else:
        writer.save(path)


def storage_size(spark: SparkSession, path: str) -> DataFrame:
    """Number of files of a table and their total bytes, as one row, measured now.

    Of a table written in versions the last one counts. A name without a
    slash is a catalog table, as in ``scan``.
    """
    if "/" not in path:
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {path}")
        path = described.filter("col_name = 'Location'").first()["data_type"]
    n_files, size = _files(spark, current(spark, path)).agg(F.count("path"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return spark.range(1).select(F.lit(n_files).cast("bigint").alias("n_files"), F.lit(size).cast("bigint").alias("bytes"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of every file that is not empty; no content is read.

    Files count for a task by their size, whether they are opened or not, so a task would list a few or even one. A
    session of its own asks for few tasks, without touching the caller's settings.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionNum", str(LISTING_TASKS))
    return own.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
