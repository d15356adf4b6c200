"""Train/val/test splits: stratified, grouped, by composition and by held-out rules.

Random choice is the seeded SHA-256 order of ids, so a split is the same on every run and cluster size. Quotas per
stratum follow the largest remainder, so the total equals ``ceil(rows * fraction)`` exactly. Ranks inside a stratum
are running counts over digest buckets: a stratum may hold most of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rulespan.operators.joins import ids_within, looked_up
from rulespan.operators.ranking import group_mode, hash_rank, ordered_totals
from rulespan.operators.profile import id_frequency
from rulespan.session import checkpointed

# Columns of a split table, and the names of rare and missing strata.
SPLIT_COLUMNS = (
    "prompt_id", "base_key", "split", "split_name", "split_type", "seed", "num_constraints", "constraint_signature",
    "constraint_family_signature", "source_dataset", "constraint_type", "instruction_ids", "heldout_instruction_ids",
)
RARE = "__rare_constraint_family_signature__"
MISSING = "__missing__"


def base_frame(df: DataFrame, split_name: str, split_type: str, seed: int) -> DataFrame:
    """The columns a split needs; texts stay behind."""
    return df.select(
        *[c for c in SPLIT_COLUMNS if c in df.columns and c not in ("split", "heldout_instruction_ids")],
        F.lit(split_name).alias("split_name"),
        F.lit(split_type).alias("split_type"),
        F.lit(seed).alias("seed"),
        F.array().cast("array<string>").alias("heldout_instruction_ids"),
    )


def stratify_labels(df: DataFrame, min_count: int = 20, name: str = "strat_label", key: str = "prompt_id") -> DataFrame:
    """Label ``num::family signature``; labels with fewer than ``min_count`` rows share the rare label of their number.

    Rows are not shuffled by their label: a label may hold nearly all of them.
    """
    num = F.col("num_constraints").cast("string")
    raw = F.concat(num, F.lit("::"), F.coalesce("constraint_family_signature", F.lit(MISSING)))
    tagged = df.withColumn("_raw", raw)
    # One row per distinct label: counted once and written, every later step reads the small table.
    counts = tagged.groupBy("_raw", num.alias("_num")).agg(F.count("*").alias("_n"))
    label = F.when(F.col("_n") < min_count, F.concat("_num", F.lit("::" + RARE))).otherwise(F.col("_raw"))
    labels = checkpointed(counts.select("_raw", label.alias(name), "_n"))
    return looked_up(tagged, labels, "_raw", "_n", key).drop("_raw", "_n")


def quotas(counts: DataFrame, label: str, total: int, wanted: int) -> DataFrame:
    """Largest-remainder share of ``wanted`` per label, from a table with one row per label and its size ``n``."""
    product = F.col("n").cast("decimal(38,0)") * F.lit(wanted)
    base, rest = F.floor(product / F.lit(total)).cast("bigint"), (product % F.lit(total)).cast("bigint")
    shares = counts.select(label, base.alias("_base"), rest.alias("_rest"))
    given = shares.agg(F.coalesce(F.sum("_base"), F.lit(0))).scalar()
    ordered = ordered_totals(shares, [], [F.col("_rest").desc(), F.col(label).asc()], {"_place": F.lit(1).cast("bigint")})
    extra = F.when(F.col("_place") <= wanted - given, 1).otherwise(0)
    return ordered.select(label, (F.col("_base") + extra).alias("quota"))


def take_stratified(
    df: DataFrame, label: str, seed: int, fraction: float | None = None, size: int | None = None,
    key: str = "prompt_id", name: str = "taken",
) -> DataFrame:
    """Mark ``ceil(rows * fraction)`` (or ``size``) rows, spread over the strata.

    Strata with a single row are pooled into one; all others keep their share.
    """
    per_label = checkpointed(df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("n")))
    rows = per_label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pooled = F.when(F.col("n") < 2, F.lit("")).otherwise(F.col("_label"))
    strata = per_label.groupBy(pooled.alias("_stratum")).agg(F.sum("n").alias("n"))
    wanted = math.ceil(rows * fraction) if fraction is not None else min(size, rows)
    share = quotas(strata, "_stratum", rows, wanted)
    # A label's stratum, quota and size in one small table: every row looks them up once.
    known = checkpointed(per_label.withColumn("_stratum", pooled).join(share, "_stratum"))
    tagged = looked_up(df.withColumn("_label", F.col(label)), known, "_label", "n", key).drop("_label", "n")
    ranked = hash_rank(tagged, ["_stratum"], key, seed, "_rank")
    return ranked.withColumn(name, F.col("_rank") <= F.col("quota")).drop("_stratum", "_rank", "quota")


def _finish(df: DataFrame) -> DataFrame:
    return df.select(*SPLIT_COLUMNS)


def _three_way(df: DataFrame, train: float, val: float, test: float, seed: int) -> DataFrame:
    if not math.isclose(train + val + test, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"the shares {train}, {val} and {test} do not make a whole")
    first = take_stratified(stratify_labels(df, 20), "strat_label", seed, val + test).drop("strat_label")
    # Both halves of the second step read this narrow frame: written once instead of ranked three times.
    first = checkpointed(first)
    rest = stratify_labels(first.filter("taken").drop("taken"), 2)
    second = take_stratified(rest, "strat_label", seed + 1, test / (val + test), name="last").drop("strat_label")
    return (
        first.filter(~F.col("taken")).drop("taken").withColumn("split", F.lit("train"))
        .unionByName(second.withColumn("split", F.when(F.col("last"), "test").otherwise("val")).drop("last"))
    )


def split_iid(df: DataFrame, seed: int = 42, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    return _finish(_three_way(base_frame(df, f"iid_seed{seed}", "iid_prompt", seed), train, val, test, seed))


def split_group(df: DataFrame, seed: int = 42) -> DataFrame:
    """All prompts of a task key land in one part; a key's stratum is the most frequent label of its prompts."""
    base = base_frame(df, f"group_key_seed{seed}", "base_key_group", seed)
    modes = group_mode(stratify_labels(base, 20), "base_key", "strat_label", "strat_label")
    first = checkpointed(take_stratified(modes, "strat_label", seed, 0.2, key="base_key"))
    second = take_stratified(
        first.filter("taken").drop("taken"), "strat_label", seed + 1, 0.5, key="base_key", name="last"
    )
    parts = first.filter(~F.col("taken")).select("base_key", F.lit("train").alias("split")).unionByName(
        second.select("base_key", F.when(F.col("last"), "test").otherwise("val").alias("split"))
    )
    return _finish(base.join(parts, "base_key"))


def split_composition_c1(df: DataFrame, seed: int = 42) -> DataFrame:
    """1 to 3 constraints train, 4 validate, 5 test."""
    n = F.col("num_constraints")
    part = F.when(n.isin(1, 2, 3), "train").when(n == 4, "val").when(n == 5, "test").otherwise("")
    return _finish(base_frame(df, "composition_heldout_c1", "composition_heldout", seed).withColumn("split", part))


def split_composition_c2(df: DataFrame, seed: int = 42) -> DataFrame:
    """1 to 4 constraints train; 5 constraints split 20/80 into val and test."""
    base = base_frame(df, "composition_heldout_c2", "composition_heldout", seed)
    held = stratify_labels(base.filter(F.col("num_constraints") == 5), 2)
    marked = take_stratified(held, "strat_label", seed, 0.8).drop("strat_label")
    n = F.col("num_constraints")
    others = base.filter(n.isNull() | (n != 5)).withColumn("split", F.when(n.isin(1, 2, 3, 4), "train").otherwise(""))
    return _finish(
        others.unionByName(marked.withColumn("split", F.when(F.col("taken"), "test").otherwise("val")).drop("taken"))
    )


def heldout_ids(
    df: DataFrame, min_frequency: int = 100, max_quantile: float = 0.9, min_family_frequency: int = 500,
    fraction: float = 0.1, seed: int = 42, avoid_rare_families: bool = True,
) -> DataFrame:
    """Rules kept for test: neither rare nor among the most frequent, a tenth of the candidates in hash order."""
    freq = id_frequency(df)
    upper = freq.agg(F.floor(F.percentile("frequency", F.lit(max_quantile))))
    candidates = freq.filter((F.col("frequency") >= min_frequency) & (F.col("frequency") <= upper.scalar()))
    if avoid_rare_families:
        candidates = candidates.filter(F.col("family_frequency") >= min_family_frequency)
    count = candidates.agg(F.greatest(F.lit(1), F.bround(F.count("*") * fraction)).cast("bigint"))
    ranked = hash_rank(candidates, [], "instruction_id", seed, "_rank")
    return ranked.filter(F.col("_rank") <= count.scalar()).drop("_rank")


def split_atomic(df: DataFrame, heldout: Sequence[str], seed: int = 42, val_fraction: float = 0.1) -> DataFrame:
    """Prompts with any held-out rule are the test part; the others are split by stratum into train and val."""
    if not heldout:
        raise ValueError("no held-out rules given")
    base = base_frame(df, f"atomic_constraint_heldout_seed{seed}", "atomic_constraint_heldout", seed)
    base = base.withColumn("heldout_instruction_ids", ids_within(F.col("instruction_ids"), heldout))
    kept = stratify_labels(base.filter(F.size("heldout_instruction_ids") == 0), 20)
    marked = take_stratified(kept, "strat_label", seed, val_fraction).drop("strat_label")
    test = base.filter(F.size("heldout_instruction_ids") > 0).withColumn("split", F.lit("test"))
    return _finish(
        test.unionByName(marked.withColumn("split", F.when(F.col("taken"), "val").otherwise("train")).drop("taken"))
    )


def heldout_manifest(splits: DataFrame, selected: DataFrame, seed: int = 42) -> DataFrame:
    """One nested record: the selected rules and the rows per part and number of constraints."""
    cells = splits.groupBy("split", "num_constraints").agg(F.count("*").alias("n"))
    per_split = cells.groupBy("split").agg(
        F.sum("n").alias("row_count"), F.array_sort(F.collect_list(F.struct("num_constraints", "n"))).alias("by_num")
    )
    parts = per_split.agg(F.array_sort(F.collect_list(F.struct("split", "row_count", "by_num"))).alias("p"))
    rules = selected.agg(
        F.array_sort(F.collect_list(F.struct("instruction_id", "frequency", "family", "family_frequency")))
    )
    return parts.select(
        F.struct(F.lit(seed).alias("seed"), F.size(rules.scalar()).alias("selected_instruction_count")).alias("selection"),
        rules.scalar().alias("heldout_instruction_ids"),
        F.col("p").alias("splits"),
    )


def validate(splits: DataFrame, expected: int, heldout: Sequence[str] = ()) -> DataFrame:
    """Violations per rule of a split table; all zero for a sound one."""
    ids = splits.groupBy("prompt_id").agg(F.count("*").alias("n"))
    keys = splits.groupBy("base_key").agg(F.countDistinct("split").alias("n"))
    hit = F.size(ids_within(F.col("instruction_ids"), list(heldout))) > 0 if heldout else F.lit(False)
    rows = splits.agg(
        F.abs(F.count("*") - expected).alias("row_count_gap"),
        F.count_if(F.col("split").isNull() | (F.col("split") == "")).alias("unassigned_rows"),
        F.count_if(F.col("split").isin("train", "val") & hit).alias("heldout_leak_rows"),
    )
    return rows.withColumns(
        {
            "duplicate_prompt_ids": ids.agg(F.count_if(F.col("n") > 1)).scalar(),
            "base_key_leaks": keys.agg(F.count_if(F.col("n") > 1)).scalar(),
        }
    )
