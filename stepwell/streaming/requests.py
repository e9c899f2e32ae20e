"""Selection requests that keep arriving.

A user who changes a selection sends a request that holds the whole selection.
Requests need nothing of one another, so the batch cascade runs on a stream as
it is: each micro-batch is joined to the stored or cached index, without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stepwell.operators.cascade import resolve_selection
from stepwell.plans.index import LevelIndex
from stepwell.session import shared_dir


def request_stream(
    spark: SparkSession, folder: str, schema: StructType | str, file_pattern: str | None = None
) -> DataFrame:
    """Requests from Parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    if file_pattern:
        reader = reader.option("pathGlobFilter", file_pattern)
    return reader.parquet(folder)


def answer_requests(
    requests: DataFrame,
    index: LevelIndex,
    answers: str,
    name: str,
    **options,
) -> StreamingQuery:
    """Resolve all requests waiting in a stream and append the answers to a Parquet folder.

    Progress is kept in the shared folder, under ``name``: started again after a
    stop or a failure, the query goes on with the first request it has not
    answered, and no answer is written twice.
    """
    spark = requests.sparkSession
    return (
        resolve_selection(requests, index, **options)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{shared_dir(spark)}/answers-{name}")
        .trigger(availableNow=True)
        .start(answers)
    )
