"""Result tables: ranks, selections, curve frames and example mining.

Ranks without a partition are taken over result tables (one row per experiment), never over prompts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespan.operators.metrics import outcome_class
from rulespan.operators.normalize import curve_label, size_of_label
from rulespan.operators.ranking import top_per_group

LAST = 1_000_000_000


def ranked(results: DataFrame, value: str, ties: Sequence[str], name: str) -> DataFrame:
    """Position of every result, best value first."""
    w = Window.orderBy(F.col(value).desc(), *ties)
    return results.withColumn(name, F.row_number().over(w).cast("bigint"))


def summary_by_config(per_run: DataFrame) -> DataFrame:
    seeds = F.array_sort(F.collect_set("seed"))
    return per_run.groupBy("model_family", "train_size_label", "split").agg(
        F.countDistinct("seed").alias("run_count"),
        F.array_join(F.transform(seeds, lambda s: s.cast("string")), ",").alias("seeds"),
        F.avg("auroc").alias("auroc"),
        F.avg("auprc").alias("auprc"),
    )


def selection_table(summary: DataFrame) -> DataFrame:
    """Per family the configuration with the best validation, and the one with the best test, average precision.

    Only configurations with both splits take part; equal values go to the first configuration by name.
    """
    keys = ["model_family", "train_size_label"]
    val = summary.filter(F.col("split") == "val").select(
        *keys, F.col("auroc").alias("val_auroc"), F.col("auprc").alias("val_auprc")
    )
    test = summary.filter(F.col("split") == "test").select(
        *keys, F.col("auroc").alias("test_auroc"), F.col("auprc").alias("test_auprc"), "run_count", "seeds"
    )
    wide = val.join(test, keys)

    def best(rule: str, by: str) -> DataFrame:
        w = Window.partitionBy("model_family").orderBy(F.col(by).desc(), "train_size_label")
        return wide.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).select(
            "model_family", F.lit(rule).alias("selection_rule"), F.col("train_size_label").alias("selected_config"),
            "val_auroc", "val_auprc", "test_auroc", "test_auprc", "run_count", "seeds",
        )

    return best("validation-selected", "val_auprc").unionByName(best("best by test", "test_auprc"))


def error_examples(wide: DataFrame, n: int) -> DataFrame:
    """Five recipes of wrong predictions over a prompt x model score table, n rows each.

    A row is read once and offered to the recipes it fits; each task keeps n rows of a recipe before they meet.
    """
    right = {f: (F.col(f) >= 0.5) == (F.col("label") == 1) for f in ("tfidf", "tiny", "frozen")}
    recipes = {
        "false_positive": ((F.col("label") == 0) & (F.col("tiny") >= 0.8), -F.col("tiny")),
        "false_negative": ((F.col("label") == 1) & (F.col("tiny") <= 0.2), F.col("tiny")),
        "tiny_right_tfidf_wrong": (right["tiny"] & ~right["tfidf"], -F.col("tiny")),
        "frozen_right_tiny_wrong": (right["frozen"] & ~right["tiny"], -F.col("frozen")),
        "all_wrong": (~right["tfidf"] & ~right["tiny"] & ~right["frozen"], F.lit(0.0)),
    }
    offers = F.array(*[F.when(fits, F.struct(F.lit(name).alias("recipe"), by.cast("double").alias("by"))) for name, (fits, by) in recipes.items()])
    fitting = wide.select("prompt_id", "label", "tfidf", "tiny", "frozen", F.explode(offers).alias("_o")).filter(F.col("_o").isNotNull())
    rows = fitting.select("_o.*", "prompt_id", "label", "tfidf", "tiny", "frozen")
    best = top_per_group(rows, ["recipe"], [F.col("by").asc(), F.col("prompt_id").asc()], n, "_rn")
    return best.select("recipe", "prompt_id", "label", "tfidf", "tiny", "frozen")


def quadrant_examples(averaged: DataFrame, n: int) -> DataFrame:
    """The n most confident prompts of every outcome class, in one pass."""
    p = F.col("p_mean")
    scored = averaged.withColumn("case_group", outcome_class(F.col("label"), F.when(p >= 0.5, 1).otherwise(0))).withColumn(
        "confidence", F.round(F.abs(p - 0.5), 9)
    )
    return top_per_group(scored, ["case_group"], [F.col("confidence").desc(), F.col("prompt_id").asc()], n, "_rn").drop("_rn")


def prompt_examples(
    averaged: DataFrame, per_rule: DataFrame, per_class: int = 2, min_rows: int = 100, hard: int = 4, pool: int = 6
) -> DataFrame:
    """Outcome examples followed by one prompt per hard rule (lowest average precision), without repeats.

    The hard rules are at most ``pool`` names; for each the errors come first, then the most confident prompt.
    """
    p = F.col("p_mean")
    classes = quadrant_examples(averaged, per_class).withColumn("focus", F.lit(""))
    names = (
        per_rule.filter((F.col("test_rows") >= min_rows) & F.col("auprc").isNotNull())
        .orderBy("auprc", "positive_rate", "instruction_id").limit(pool)
        .withColumn("rule_order", F.row_number().over(Window.orderBy("auprc", "positive_rate", "instruction_id")))
        .select("instruction_id", "rule_order")
    )
    scored = averaged.withColumn("outcome", outcome_class(F.col("label"), F.when(p >= 0.5, 1).otherwise(0))).withColumn(
        "confidence", F.round(F.abs(p - 0.5), 9)
    )
    candidates = (
        scored.join(classes.select("prompt_id"), "prompt_id", "left_anti")
        .withColumn("instruction_id", F.explode(F.array_distinct("instruction_ids")))
        .join(names, "instruction_id")
    )
    # A rule may lose its best prompts to earlier rules: `pool` prompts per rule are enough to pick without repeats.
    order = [F.col("outcome").isin("FP", "FN").desc(), F.col("confidence").desc(), F.col("prompt_id")]
    w = Window.partitionBy("instruction_id").orderBy(*order)
    few = candidates.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= pool)
    offered = few.groupBy(F.lit(1).alias("_one")).agg(
        F.array_sort(
            F.collect_list(F.struct("rule_order", "_rn", "prompt_id", "instruction_id", "label", "p_mean", "confidence"))
        ).alias("_c")
    )
    none = F.array().cast("array<struct<rule_order:int,_rn:int,prompt_id:string,instruction_id:string,label:int,p_mean:double,confidence:double>>")

    def take(kept: Column, c: Column) -> Column:
        free = (F.size(kept) < hard) & ~F.exists(
            kept, lambda k: (k["rule_order"] == c["rule_order"]) | (k["prompt_id"] == c["prompt_id"])
        )
        return F.when(free, F.concat(kept, F.array(c))).otherwise(kept)

    chosen = offered.select(F.inline(F.aggregate("_c", none, take))).select(
        F.lit("Hard rule").alias("case_group"), "prompt_id", "label", "p_mean", "confidence", F.col("instruction_id").alias("focus")
    )
    return classes.select("case_group", "prompt_id", "label", "p_mean", "confidence", "focus").unionByName(chosen)


def curve_comparison(rollups: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Roll-ups of several model families as one curve frame: labels unified and filtered, missing deviation 0."""
    label = curve_label(F.col("train_size_label"))
    return (
        rollups.withColumn("curve_label", label)
        .filter(F.col("curve_label").isin(*labels))
        .select(
            F.col("model_family").alias("family"),
            "curve_label",
            "split",
            "accuracy_mean",
            F.coalesce("accuracy_std", F.lit(0.0)).alias("accuracy_std"),
            F.coalesce(size_of_label(F.col("curve_label")), F.lit(LAST)).alias("curve_order"),
        )
    )
