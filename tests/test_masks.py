"""Masks of long texts."""

import hashlib

from pyspark.sql import functions as F

from rulespan.operators import features as f
from rulespan.plans import q_features
from rulespan.plans.testbed import Testbed


def test_masks_are_linear_and_positions_are_drawn_once(spark, tmp_path):
    texts = [(1, "<mask> a1 the b of " + "c " * 30000), (2, "the of"), (3, None), (4, "one")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = q_features.mlm_mask(Testbed(spark, str(tmp_path)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("drawn(") == 1 and "array_contains" not in plan
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 4} and got[4].positions == "1"
    words = texts[0][1].split()

    def hit(i: int) -> bool:
        rate = 0.3 if any(c in "0123456789" for c in words[i]) else 0.15
        return words[i] not in ("the", "of") and hashlib.md5(f"7:1:{i}".encode()).hexdigest()[:8] < f"{int(rate * 16**8):08x}"

    want = [i + 1 for i in range(len(words)) if hit(i)]
    assert got[1].positions == ",".join(map(str, want))
    assert got[1].masked_count == len(want)


def test_labels_stand_only_at_positions(spark):
    df = spark.createDataFrame([(["a", None, "c", "d"], [4, 2, 9]), (["a"], []), (["a"], None)], "t array<string>, p array<int>")
    masked, labels = f.apply_mask(F.col("t"), F.col("p"), "<m>")
    got = [(r.m, r.l) for r in df.select(masked.alias("m"), labels.alias("l")).collect()]
    assert got == [(["a", "<m>", "c", "<m>"], [None, None, None, "d"]), (["a"], [None]), (["a"], [None])]
    assert "array_contains" not in str(masked)
