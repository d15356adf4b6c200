"""Incremental rule checks over growing shard folders with Structured Streaming.

The source is a folder of generation records; every new file is checked once. The check itself has no state, so the
stream is a map over rows, and its result equals the batch job on the same files. Each run processes what is new
(``availableNow``) and stops; progress is kept in the checkpoint location.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rulespan.operators.checks import check_rows, run_checks


def read_shards(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_checks(stream: DataFrame, output: str, progress: str, rules: Sequence[str] | None = None) -> StreamingQuery:
    """Append checked rows (verdicts and strict columns, without the text) for every new input row."""
    checked = check_rows(run_checks(stream, rules=rules)).drop("response_text", "constraints")
    return (
        checked.writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )


def start_pass_rates(
    checked: DataFrame, facets: Sequence[str], partials: str, progress: str, passed: str = "strict_pass"
) -> StreamingQuery:
    """Append partial sums per facet and micro-batch.

    A batch writes into its own folder and replaces it when it is run again, so a repeated batch does not count twice.
    ``pass_rates`` adds the partial sums up; their number grows with batches and facet values, not with rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(*facets).agg(
            F.count("*").alias("row_count"), F.count_if(passed).alias("pass_count")
        )
        sums.write.mode("overwrite").parquet(f"{partials}/batch={batch_id}")

    return (
        checked.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def pass_rates(spark: SparkSession, facets: Sequence[str], partials: str) -> DataFrame:
    """Current pass rates from all partial sums."""
    return (
        spark.read.parquet(partials).groupBy(*facets)
        .agg(F.sum("row_count").alias("row_count"), F.sum("pass_count").alias("pass_count"))
        .withColumn("pass_rate", F.try_divide("pass_count", "row_count"))
    )
