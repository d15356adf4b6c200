"""A streaming batch is wide enough for all cores, and batches still add up."""

from pyspark.sql import functions as F

from rulespan.plans import q_streaming
from rulespan.plans.testbed import Testbed
from rulespan.streaming import check_job


def test_batches_are_as_wide_as_the_cluster(spark, monkeypatch):
    asked, read = [], check_job.read_shards
    monkeypatch.setattr(check_job, "read_shards", lambda *a, **b: asked.append(b["files_per_batch"]) or read(*a, **b))
    t = Testbed(spark, "/root/testdata/sf0.001")
    got = q_streaming.stream_pass_rate(t).agg(F.sum("row_count")).first()[0]
    assert got == t.table("documents").count()
    assert len(asked) == 2 and min(asked) >= spark.sparkContext.defaultParallelism
