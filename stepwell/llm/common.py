"""Helpers shared by the operators: stored intermediate tables and safe column access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.session import new_folder, remove_folder


def quoted(name: str) -> str:
    """A column name that may hold dots or quotes, for use in ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stored:
    """Intermediate tables of one call, as Parquet in the shared folder.

    A table that is used more than once is written once and read again: that cuts
    its lineage, and a lost executor costs only the tasks it was running. The folder goes when the application ends, or
    with the ``stepwell.scratch`` block around the call.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = new_folder(spark, "llm")
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables that no later step reads."""
        for df in tables:
            for name in df.inputFiles():
                remove_folder(self.spark, name.rsplit("/", 1)[0])
                break
