"""Invariants of splits and samples on small frames."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from rulespan.operators import sampling as s
from rulespan.operators import splits as sp
from rulespan.operators.joins import looked_up
from rulespan.operators.ranking import dense_index, exact_quantiles, hash_rank, running_totals, score_rank, stable_sample


@pytest.fixture(scope="module")
def prompts(spark):
    rows = []
    for i in range(60):
        family = "keywords" if i % 2 == 0 else "detectable_format"
        rule = f"{family}:rule_{i % 6}"
        rows.append((f"prompt-{i:03d}", f"base-{i // 2:03d}", i % 5 + 1, rule, family, "set", "multi", [rule]))
    return spark.createDataFrame(
        rows,
        "prompt_id string, base_key string, num_constraints int, constraint_signature string,"
        "constraint_family_signature string, source_dataset string, constraint_type string, instruction_ids array<string>",
    )


def parts(split):
    return {r.prompt_id: r for r in split.collect()}


def test_iid_assigns_every_row_once(prompts):
    rows = sp.split_iid(prompts).collect()
    assert len(rows) == 60 and len({r.prompt_id for r in rows}) == 60
    counts = {p: sum(r.split == p for r in rows) for p in ("train", "val", "test")}
    assert counts == {"train": 48, "val": 6, "test": 6}


def test_group_keeps_keys_together(prompts):
    rows = sp.split_group(prompts).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.base_key, set()).add(r.split)
    assert len(rows) == 60 and all(len(v) == 1 for v in seen.values())


def test_composition_splits(prompts):
    c1 = parts(sp.split_composition_c1(prompts)).values()
    assert {(r.num_constraints, r.split) for r in c1} == {(1, "train"), (2, "train"), (3, "train"), (4, "val"), (5, "test")}
    c2 = [r for r in parts(sp.split_composition_c2(prompts)).values() if r.num_constraints == 5]
    assert sum(r.split == "test" for r in c2) == 10 and sum(r.split == "val" for r in c2) == 2


def test_atomic_keeps_held_out_rules_in_test(prompts):
    held = sp.heldout_ids(prompts, 1, 1.0, 1, 0.2)
    names = [r.instruction_id for r in held.collect()]
    rows = sp.split_atomic(prompts, names).collect()
    assert len(rows) == 60
    for r in rows:
        assert (r.split == "test") == bool(set(r.instruction_ids) & set(names))
    bad = sp.validate(sp.split_atomic(prompts, names), 60, names).first()
    assert bad.heldout_leak_rows == bad.unassigned_rows == bad.duplicate_prompt_ids == bad.row_count_gap == 0


def test_ratios_must_sum_to_one(prompts):
    with pytest.raises(ValueError):
        sp.split_iid(prompts, train=0.5)


def test_hash_sample_is_nested_and_seeded(spark):
    df = spark.createDataFrame([(f"p{i}", i) for i in range(10)], "prompt_id string, value int")

    def ids(n, seed):
        return {r.prompt_id for r in stable_sample(df, n, seed).collect()}

    wanted = sorted((hashlib.sha256(f"42:p{i}".encode()).hexdigest(), f"p{i}") for i in range(10))
    assert ids(3, 42) == {p for _, p in wanted[:3]} and ids(3, 42) < ids(6, 42)
    assert ids(3, 42) != ids(3, 43) and len(ids(50, 42)) == 10
    with pytest.raises(ValueError):
        stable_sample(df, 0, 42)


def test_running_totals_equal_brute_force_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else None, (i * 37 % 11) / 10, f"{i * 7919 % 4096:03x}{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, p double, prompt_id string")
    got = {r.prompt_id: r.position for r in score_rank(df, ["k"], "p").collect()}
    for key in ("hot", None):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_hash_rank_and_dense_index(spark):
    df = spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(), i % 2) for i in range(200)], "prompt_id string, g int")
    assert [r.row_index for r in dense_index(df).orderBy("prompt_id").collect()] == list(range(200))
    ranks = sorted(r.hash_rank for r in hash_rank(df, ["g"]).filter("g = 1").collect())
    assert ranks == list(range(1, 101))


def test_running_totals_without_keys(spark):
    df = spark.range(1, 101).withColumn("v", F.col("id").cast("double"))
    out = running_totals(df, [], [[(F.floor(F.col("v") / 10), True)]], [F.col("v")], {"t": F.col("v")})
    assert {r.id: r.t for r in out.collect()} == {i: i * (i + 1) / 2 for i in range(1, 101)}


def test_exact_quantiles(spark):
    df = spark.range(0, 101).select((F.col("id") * 2.5).alias("x"))
    q = exact_quantiles(df, [], "x", {"a": 0.5, "b": 0.905}, F.floor(F.col("x"))).first()
    assert q.a == 125.0 and abs(q.b - 226.25) < 1e-9


def test_allocation_is_exact_and_positive(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1000, 1, 1, 1, 400, 2])], "cluster int, n int")
    for size in (7, 20, 101):
        rows = s.allocate_sqrt(counts, "cluster", size).collect()
        assert sum(r.allocation for r in rows) == size and min(r.allocation for r in rows) >= 1


def test_size_ladder_labels(spark):
    df = spark.createDataFrame([(f"{i:03x}",) for i in range(30)], "prompt_id string")
    got = {r.size_label: r["count"] for r in s.size_ladder(df, [10, 2000, None], 1).groupBy("size_label").count().collect()}
    assert got == {"10": 10, "2k/full": 30, "full": 30}


def test_one_single_row_stratum_leaves_the_others_stratified(spark):
    rows = [(f"p{i:03d}", "a" if i < 60 else "b") for i in range(100)] + [("odd", "c")]
    df = spark.createDataFrame(rows, "prompt_id string, strat_label string")
    taken = sp.take_stratified(df, "strat_label", 7, 0.25).filter("taken").groupBy("strat_label").count().collect()
    counts = {r["strat_label"]: r["count"] for r in taken}
    assert abs(counts["a"] - 15) <= 1 and abs(counts["b"] - 10) <= 1 and sum(counts.values()) == 26


def greedy_allocation(sizes, size):
    """The loop: one unit at a time where the share is furthest off, ties by name."""
    weight = sum(math.sqrt(n) for n in sizes.values())
    raw = {c: math.sqrt(n) / weight * size for c, n in sizes.items()}
    a = {c: max(math.floor(r), 1) for c, r in raw.items()}
    while sum(a.values()) < size:
        a[min(a, key=lambda c: (a[c] - raw[c], c))] += 1
    while sum(a.values()) > size and max(a.values()) > 1:
        a[min((c for c in a if a[c] > 1), key=lambda c: (raw[c] - a[c], c))] -= 1
    return a


@pytest.mark.parametrize("size", [3, 40, 55, 150, 1_000])
def test_allocation_equals_a_greedy_loop(spark, size):
    rnd = random.Random(size)
    sizes = {f"c{i:02d}": rnd.choice([1, 1, 2, 3, 50, 400, 9_000]) for i in range(40)}
    counts = spark.createDataFrame(list(sizes.items()), "cluster string, n bigint").repartition(3)
    got = {r.cluster: r.allocation for r in s.allocate_sqrt(counts, "cluster", size).collect()}
    assert got == greedy_allocation(sizes, size)
    assert s.allocate_sqrt(counts.limit(0), "cluster", size).count() == 0


def test_one_stratum_of_nearly_all_rows(spark):
    """99 % of the rows have one label: no task gets them all, and quotas and the part of the others stay exact."""
    rows = [(f"{hashlib.sha256(str(i).encode()).hexdigest()}", 1 if i % 100 else 2, "hot" if i % 100 else f"cold{i % 700}") for i in range(8_000)]
    df = spark.createDataFrame(rows, "prompt_id string, num_constraints int, constraint_family_signature string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labelled = sp.stratify_labels(df, 2)
        sizes = [r.n for r in labelled.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
        taken = sp.take_stratified(labelled, "strat_label", 42, 0.25)
        per = {r.strat_label: (r.n, r.t) for r in taken.groupBy("strat_label").agg(F.count("*").alias("n"), F.count_if("taken").alias("t")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert per["1::hot"] == (7_920, 1_980) and sum(t for _, t in per.values()) == 2_000 and sum(n for n, _ in per.values()) == 8_000


def test_looked_up_rows_keep_nulls_and_strangers(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)] + [("hot", i) for i in range(5, 40)], "k string, i int")
    table = spark.createDataFrame([("a", 1, 10), ("b", 1, None), ("hot", 35, 7)], "k string, n int, v int")
    got = {r.i: (r.n, r.v) for r in looked_up(rows, table, "k", "n", "i").collect()}
    assert got == {1: (1, 10), 2: (1, None), 3: (None, None), 4: (None, None), **{i: (35, 7) for i in range(5, 40)}}
