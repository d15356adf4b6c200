"""Streaming queries: growing shard folders, each file checked once, equal to the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.plans.catalog import query
from rulespan.plans.q_profile import cif
from rulespan.plans.testbed import Testbed
from rulespan.session import shared_folder
from rulespan.streaming import check_job

RULES = ("punctuation:no_comma", "length_constraints:number_words", "keywords:existence")
CONSTRAINTS = """array(named_struct('instruction_id', 'punctuation:no_comma', 'kwargs_json', '{}'),
 named_struct('instruction_id', 'length_constraints:number_words', 'kwargs_json', '{"num_words": ' || (doc_id % 300) || ', "relation": "at least"}'),
 named_struct('instruction_id', 'keywords:existence', 'kwargs_json', '{"keywords": ["the"]}'))"""
VERDICT = "(NOT contains(text, ',')) AND len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= doc_id % 300 AND contains(lower(text), 'the')"


def _files_per_batch(t: Testbed) -> int:
    """A file is read by one task: a batch of fewer files than cores leaves the others idle, and each batch has a fixed cost."""
    return max(2, t.spark.sparkContext.defaultParallelism)


def _feed(t: Testbed):
    """Write the documents as four shard folders and stream them back, as many files at a time as there are cores."""
    folder = shared_folder(t.spark, "growing")
    rows = t.table("documents").select(
        "doc_id", (F.col("doc_id") % 5).alias("facet"), F.col("text").alias("response_text"), F.expr(CONSTRAINTS).alias("constraints"),
    )
    # One pass: every task adds its rows to the four shard folders.
    rows.withColumn("shard", F.col("doc_id") % 4).write.partitionBy("shard").parquet(folder)
    return check_job.read_shards(t.spark, folder, rows.schema, files_per_batch=_files_per_batch(t))


def _checked(t: Testbed) -> str:
    output = shared_folder(t.spark, "checked")
    check_job.start_checks(_feed(t), output, shared_folder(t.spark, "progress"), RULES).awaitTermination()
    return output


@query("stream_checks", f"SELECT doc_id, doc_id % 5 AS facet, {VERDICT} AS strict_pass FROM documents")
def stream_checks(t: Testbed):
    return t.spark.read.parquet(_checked(t)).select("doc_id", "facet", "strict_pass")


@query("stream_pass_rate", f"""SELECT doc_id % 5 AS facet, count(*) AS row_count, {cif(VERDICT)} AS pass_count, round(count_if({VERDICT})::DOUBLE / count(*), 9) AS pass_rate FROM documents GROUP BY ALL""")
def stream_pass_rate(t: Testbed):
    output = _checked(t)
    schema = t.spark.read.parquet(output).schema
    partials = shared_folder(t.spark, "partials")
    stream = check_job.read_shards(t.spark, output, schema, files_per_batch=_files_per_batch(t))
    check_job.start_pass_rates(stream, ["facet"], partials, shared_folder(t.spark, "progress")).awaitTermination()
    return check_job.pass_rates(t.spark, ["facet"], partials).withColumn("pass_rate", F.round("pass_rate", 9))
