"""Metrics against brute force on small inputs with ties, single classes and empty bins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespan.operators import metrics as m
from rulespan.operators.ranking import ranged, score_rank

SCHEMA = "k string, prompt_id string, label int, p_pred double"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [("a", f"{i:03x}", rnd.randint(0, 1), rnd.choice([0.0, 0.1, 0.25, 0.5, 0.5, 0.9, 1.0])) for i in range(200)]
    out += [("one_class", f"{i:03x}", 1, i / 10) for i in range(5)]
    out += [("one_row", "0", 0, 0.3)]
    return out


def of(rows, key):
    return [r for r in rows if r[0] == key]


def brute_auroc(part):
    pos, neg = [r[3] for r in part if r[2]], [r[3] for r in part if not r[2]]
    if not pos or not neg:
        return None
    return sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))


def brute_ap(part):
    total = sum(r[2] for r in part)
    if total in (0, len(part)):
        return None
    ap = 0.0
    for s in sorted({r[3] for r in part}, reverse=True):
        top = [r for r in part if r[3] >= s]
        ap += sum(r[2] for r in part if r[3] == s) / total * sum(r[2] for r in top) / len(top)
    return ap


def test_ranking_metrics(spark, rows):
    counts = m.score_counts(spark.createDataFrame(rows, SCHEMA), ["k"])
    got = {r.k: r for r in m.area_metrics(m.curve(counts, ["k"]), ["k"]).collect()}
    for key in ("a", "one_class", "one_row"):
        for name, brute in (("auroc", brute_auroc), ("auprc", brute_ap)):
            want = brute(of(rows, key))
            assert (got[key][name] is None) if want is None else math.isclose(got[key][name], want, rel_tol=1e-12)


def test_calibration_edges_differ(spark):
    df = spark.createDataFrame([("a", "0", 1, 0.1), ("a", "1", 0, 0.0), ("a", "2", 1, 1.0), ("a", "3", 0, 0.30000000000000004)], SCHEMA)
    bins = {
        closed: [r.row_count for r in m.reliability_bins(m.score_counts(df, ["k"]), ["k"], closed).orderBy("bin").collect()]
        for closed in ("left", "right")
    }
    assert bins["left"] == [1, 1, 0, 1, 0, 0, 0, 0, 0, 1]
    assert bins["right"] == [2, 0, 0, 1, 0, 0, 0, 0, 0, 1]


def test_best_f1_takes_lowest_threshold(spark):
    df = spark.createDataFrame([("a", "0", 1, 0.7), ("a", "1", 0, 0.2)], SCHEMA)
    best = m.best_f1(m.score_counts(df, ["k"]), ["k"]).first()
    assert (best.threshold, best.f1) == (0.5, 1.0)


@pytest.mark.parametrize("rounding", ["ceil", "half_even"])
def test_selective(spark, rows, rounding):
    part = of(rows, "a")
    conf = (lambda p: abs(p - 0.5)) if rounding == "ceil" else (lambda p: max(p, 1 - p))
    ordered = sorted(part, key=lambda r: (-conf(r[3]), r[1]))
    got = {r.coverage: r for r in m.selective(spark.createDataFrame(part, SCHEMA), ["k"], rounding=rounding).collect()}
    for c in m.COVERAGES:
        n = max(1, math.ceil(len(part) * c) if rounding == "ceil" else round(len(part) * c))
        top = ordered[:n]
        assert got[c].selected_rows == n
        assert math.isclose(got[c].selective_accuracy, sum((r[3] >= 0.5) == (r[2] == 1) for r in top) / n)


def test_precision_at_k_caps_at_the_rows(spark, rows):
    df = spark.createDataFrame(of(rows, "a"), SCHEMA).withColumnRenamed("k", "run")
    got = m.precision_at_k(df, ["run"], ks=(10, 500)).collect()
    assert {r.k: r.selected_rows for r in got} == {10: 10, 500: 200}


def test_poisson_weights_have_mean_one():
    w = m.poisson_weights(np.arange(2000) * 7919, 50)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and w.max() > 4
    assert (w[:, :10] == m.poisson_weights(np.arange(2000) * 7919, 10)).all()


def test_bootstrap_interval_holds_the_point(spark, rows):
    df = spark.createDataFrame(of(rows, "a"), SCHEMA).withColumn("base_key", F.substring("prompt_id", 2, 2))
    r = m.bootstrap_ci(df, ["k"], reps=60).first()
    assert r.auroc_ci_low <= r.auroc <= r.auroc_ci_high and r.reps_used == 60


def test_bootstrap_equals_a_loop_over_the_replicates(spark, monkeypatch):
    """Scores that reach over the edges of parts, one hot score, a missing group, null keys, and a key of one class."""
    monkeypatch.setattr(m, "BLOCK_ROWS", 16)
    rnd = random.Random(5)
    data = [(rnd.choice(["a", "b", None]), rnd.choice(["g1", "g2", "g3", "g4", "g5", None]) if i % 3 else f"own{i}", rnd.randint(0, 1), rnd.choice([0.5, 0.5, 0.5, round(rnd.random(), 2)])) for i in range(900)]
    data += [("one", "g1", 1, 0.25), ("one", "g2", 1, 0.5), ("single", "g1", 0, 0.1)]
    df = spark.createDataFrame(data, "k string, base_key string, label int, p_pred double")
    got = {r.k: r for r in m.bootstrap_replicates(df, ["k"], reps=40).collect()}
    hashes = {r.g: r.h for r in df.select(F.coalesce("base_key", F.lit("__missing__")).alias("g")).distinct().select("g", F.xxhash64(F.lit(42), "g").alias("h")).collect()}
    weights = {g: m.poisson_weights(np.array([h]), 40)[0] for g, h in hashes.items()}
    for key in {d[0] for d in data}:
        auroc, auprc = [], []
        for rep in range(40):
            part = [(g, y, s, int(weights[g or "__missing__"][rep])) for k, g, y, s in data if k == key]
            copies = [("", "", y, s) for _, y, s, w in part for _ in range(w)]
            if brute_auroc(copies) is not None:
                auroc.append(brute_auroc(copies))
                auprc.append(brute_ap(copies))
        assert np.allclose(got[key].auroc, auroc) and np.allclose(got[key].auprc, auprc)
    assert m.bootstrap_ci(df, ["k"], reps=40).count() == 5
    assert m.bootstrap_replicates(df, [], reps=3).count() == 1 and m.bootstrap_replicates(df.limit(0), ["k"], reps=3).count() == 0


def test_parts_of_crowded_scores_are_even(spark):
    """99 % of the scores lie under 0.001: no part holds over twice the mean, and the areas stay exact."""
    rnd = random.Random(7)
    data = [("a", f"{i:05x}", int(rnd.random() < 0.3), rnd.random() * (1e-3 if i % 100 else 1.0)) for i in range(40_000)]
    df = spark.createDataFrame(data, SCHEMA)
    counts = m.score_counts(df, ["k"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in ranged(counts, ["k"], [F.col("score").desc()]).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = m.area_metrics(m.curve(counts, ["k"]), ["k"]).first()
    order = sorted(data, key=lambda r: r[3])
    pos = sum(r[2] for r in order)
    rank_sum = sum(i + 1 for i, r in enumerate(order) if r[2])
    assert math.isclose(got.auroc, (rank_sum - pos * (pos + 1) / 2) / (pos * (len(order) - pos)), rel_tol=1e-12)
    placed = score_rank(df.select("k", "prompt_id", "p_pred"), ["k"], "p_pred").collect()
    want = {r[1]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (-r[3], r[1])))}
    assert {r.prompt_id: r.position for r in placed} == want
