"""Counts, rates, duplicate and leak audits, lift and association tables.

Percentiles here are exact over token counts: whole numbers below the context limit, so the table of distinct values
per group stays small. Continuous values use ``ranking.exact_quantiles``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespan.operators.ranking import exact_quantiles, null_safe_join, top_per_group

MISSING = "<missing>"

# Function-only module: helpers used inside tasks travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


# --- frequencies and duplicates --------------------------------------------------------------------------------


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("row_count"))


def top_levels(df: DataFrame, column: str, n: int, other: str = "__other__") -> DataFrame:
    """The rows with all but the ``n`` most frequent values of a column (ties in value order) replaced by one level."""
    tops = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), column).limit(n)
    marked = df.join(F.broadcast(tops.select(F.col(column).alias("_level"))), F.col(column) == F.col("_level"), "left")
    return marked.withColumn(column, F.coalesce("_level", F.lit(other))).drop("_level")


def id_frequency(df: DataFrame, ids: str = "instruction_ids") -> DataFrame:
    """Frequency of every id and of its family; repeats inside a row count."""
    per_id = df.select(F.explode(ids).alias("instruction_id")).groupBy("instruction_id").agg(F.count("*").alias("frequency"))
    family = F.substring_index("instruction_id", ":", 1)
    by_family = Window.partitionBy("family")
    return per_id.withColumn("family", family).withColumn("family_frequency", F.sum("frequency").over(by_family))


def duplicates_excess(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values that repeat, and rows beyond the first of each value."""
    out = []
    for c in columns:
        n = df.groupBy(c).agg(F.count("*").alias("n"))
        out.append(
            n.agg(
                F.count_if(F.col("n") > 1).alias("duplicate_values"),
                F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
            ).select(F.lit(c).alias("column"), "*")
        )
    first, *others = out
    for o in others:
        first = first.unionByName(o)
    return first


def duplicate_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct values (null counts as one), rows in repeated groups, repeated values, nulls."""
    n = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    again = F.col("n") > 1
    return n.groupBy(*by).agg(
        F.sum("n").alias("row_count"),
        F.count("*").alias("unique_count"),
        F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("duplicate_row_count"),
        F.count_if(again).alias("duplicated_value_count"),
        F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    )


def _spread(df: DataFrame, column: str, part: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and parts per value. The set of parts per value is at most the handful of parts that exist."""
    return df.groupBy(*by, column).agg(
        F.count("*").alias("row_count"), F.array_sort(F.collect_set(F.col(part).cast("string"))).alias("_parts")
    )


def duplicate_preview(df: DataFrame, column: str, part: str, n: int) -> DataFrame:
    seen = _spread(df, column, part).filter(F.col("row_count") > 1)
    return (
        seen.select(column, "row_count", F.array_join("_parts", "|").alias("splits"))
        .orderBy(F.col("row_count").desc(), column)
        .limit(n)
    )


def leakage(df: DataFrame, column: str, part: str, by: Sequence[str] = ()) -> DataFrame:
    """Values that occur in more than one part."""
    return (
        _spread(df, column, part, by)
        .filter(F.size("_parts") > 1)
        .select(
            *by, column, "row_count", F.size("_parts").cast("bigint").alias("partition_count"),
            F.array_join("_parts", "|").alias("partitions"),
        )
    )


def leakage_summary(df: DataFrame, column: str, part: str, by: Sequence[str] = ()) -> DataFrame:
    return leakage(df, column, part, by).groupBy(*by).agg(
        F.count("*").alias("leaked_value_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("leaked_row_count")
    )


def null_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column the null or empty rows and their share (0 for an empty table)."""
    total = df.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(c) for c in columns]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("empty_count")) for c in columns])
    return total.select("n", F.inline(cells)).select(
        "column", "empty_count", F.coalesce(ratio("empty_count", "n"), F.lit(0.0)).alias("ratio")
    )


def promptset_audit(
    df: DataFrame, expected: int, empty_message: Column, empty_constraint: Column, parse_failed: Column
) -> DataFrame:
    """One record: size, distributions and frequencies as sorted JSON maps, duplicates, empty and failed shares.

    The rows are read once: each gives a few (kind, value) entries, which are counted together; the counted values
    then make one row per kind. Texts stay behind.
    """
    ids = F.coalesce("instruction_ids", F.array().cast("array<string>"))
    shown = ("num_constraints", "source_dataset", "constraint_type", "instruction_id", "constraint_family")

    def one(kind: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))

    def each(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def flag(name: str, hit: Column) -> Column:
        return F.when(hit, one(name, F.lit(""))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))

    entries = F.concat(
        *[one(c, F.col(c)) for c in ("num_constraints", "source_dataset", "constraint_type", "prompt_id", "base_key")],
        each("instruction_id", ids), each("constraint_family", F.transform(ids, lambda i: F.substring_index(i, ":", 1))),
        flag("empty_messages", empty_message), flag("empty_constraint", empty_constraint), flag("parse_failures", parse_failed),
    )
    counted = df.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))
    # Values of the shown kinds are few; of ids and keys only sums are kept.
    entry = F.when(F.col("kind").isin(*shown), F.struct(F.coalesce("value", F.lit("None")).alias("k"), "n"))
    known = F.col("value").isNotNull()
    per_kind = counted.groupBy("kind").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known & (F.col("n") > 1), F.col("n") - 1).otherwise(0)).alias("repeated_rows"),
        F.count_if(known & (F.col("n") > 1)).alias("repeated_values"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    of = F.map_from_entries(F.collect_list(F.struct("kind", F.struct("n", "repeated_rows", "repeated_values", "entries"))))
    record = per_kind.agg(of.alias("of"))

    def field(kind: str, name: str) -> Column:
        return F.coalesce(F.try_element_at("of", F.lit(kind))[name], F.lit(0).cast("bigint"))

    def shown_as(kind: str) -> Column:
        return F.to_json(F.map_from_entries(F.try_element_at("of", F.lit(kind))["entries"]))

    rows = field("prompt_id", "n")
    out = {
        "num_rows": rows,
        "expected_num_rows": F.lit(expected).cast("bigint"),
        "expected_num_rows_match": rows == expected,
        "num_constraints_distribution": shown_as("num_constraints"),
        "dataset_distribution": shown_as("source_dataset"),
        "constraint_type_distribution": shown_as("constraint_type"),
        "instruction_id_frequency": shown_as("instruction_id"),
        "constraint_family_frequency": shown_as("constraint_family"),
        "duplicate_prompt_rows": field("prompt_id", "repeated_rows"),
        "duplicate_base_keys": field("base_key", "repeated_values"),
        "duplicate_base_key_rows": field("base_key", "repeated_rows"),
    }
    for kind in ("empty_messages", "empty_constraint", "parse_failures"):
        out[kind] = field(kind, "n")
        out[f"{kind}_ratio"] = F.coalesce(ratio(field(kind, "n"), rows), F.lit(0.0))
    return record.select(*[c.alias(name) for name, c in out.items()])


# --- pass rates ------------------------------------------------------------------------------------------------


def _rate_aggregates() -> list[Column]:
    return [
        F.count("*").alias("row_count"),
        F.count_if("checker_pass").alias("pass_count"),
        F.count_if(F.col("checker_error_count") > 0).alias("checker_error_rows"),
        F.count_if("output_truncated").alias("truncated_count"),
        F.percentile("prompt_tokens", F.lit(0.5)).alias("prompt_tokens_p50"),
        F.percentile("output_tokens", F.lit(0.5)).alias("output_tokens_p50"),
        F.percentile("output_tokens", F.lit(0.9)).alias("output_tokens_p90"),
        F.avg("num_constraints").alias("num_constraints_mean"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumn("pass_rate", ratio("pass_count", "row_count")).withColumn(
        "truncated_rate", ratio("truncated_count", "row_count")
    )


def rate_table(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    return _with_rates(df.groupBy(*facets).agg(*_rate_aggregates()))


def rate_table_sets(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rate tables of several facet sets in one job; ``grouping_id`` tells the sets apart."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return _with_rates(grouped.agg(F.grouping_id().alias("grouping_id"), *_rate_aggregates()))


def constraint_rates(child: DataFrame) -> DataFrame:
    out = child.groupBy("instruction_id").agg(
        F.count("*").alias("row_count"),
        F.count_if("followed").alias("pass_count"),
        F.count_if("checker_error").alias("checker_error_count"),
    )
    return out.withColumn("pass_rate", ratio("pass_count", "row_count")).withColumn(
        "checker_error_rate", ratio("checker_error_count", "row_count")
    )


def check_summary(checks: DataFrame) -> DataFrame:
    """Totals of a check run; rates rounded to 8 places."""
    ok, cut = F.col("checker_pass"), F.col("output_truncated")

    def rate(a: Column, b: Column) -> Column:
        return F.round(ratio(a, b), 8)

    n, passed = F.count("*"), F.count_if(ok)
    return checks.agg(
        n.alias("row_count"),
        passed.alias("pass_count"),
        (n - passed).alias("fail_count"),
        rate(passed, n).alias("pass_rate"),
        F.count_if(F.col("checker_error_count") > 0).alias("checker_error_rows"),
        rate(F.count_if(F.col("checker_error_count") > 0), n).alias("checker_error_row_rate"),
        F.count_if(cut).alias("output_truncated_count"),
        rate(F.count_if(ok & cut), F.count_if(cut)).alias("output_truncated_pass_rate"),
        rate(F.count_if(ok & ~cut), F.count_if(~cut)).alias("not_output_truncated_pass_rate"),
        F.countDistinct("cluster").alias("cluster_count"),
    )


def two_sided_top(df: DataFrame, by: Column, tie: Sequence[Column], k: int) -> DataFrame:
    """The k highest and the k lowest rows of a result table."""
    top = df.orderBy(by.desc(), *tie).limit(k).withColumn("side", F.lit("top"))
    low = df.orderBy(by.asc(), *tie).limit(k).withColumn("side", F.lit("lowest"))
    return top.unionByName(low)


def length_profile(df: DataFrame, tokens: str, limit: int) -> DataFrame:
    cuts = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    t = F.col(tokens)
    one = df.agg(
        F.count("*").alias("row_count"),
        F.min(t).alias("min"),
        F.max(t).alias("max"),
        F.avg(t).alias("mean"),
        F.countDistinct(t).alias("distinct_lengths"),
        F.count_if(t < limit).alias("below_limit"),
        F.count_if(t >= limit).alias("at_or_above_limit"),
        F.percentile(t, F.array(*map(F.lit, cuts))).alias("_p"),
    )
    return one.select(
        "row_count", "min", "max", "mean", "distinct_lengths", "below_limit", "at_or_above_limit",
        ratio("below_limit", "row_count").alias("below_limit_share"),
        *[F.col("_p")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(cuts)],
    )


def _top_values(df: DataFrame, key: str, value: str, k: int, name: str) -> DataFrame:
    """Per key the k most frequent values as JSON; ties in value order."""
    counts = df.groupBy(key, F.coalesce(F.col(value), F.lit(MISSING)).alias("value")).agg(F.count("*").alias("count"))
    top = top_per_group(counts, [key], [F.col("count").desc(), F.col("value")], k, "_rn")
    ordered = F.array_sort(F.collect_list(F.struct("_rn", "value", "count")))
    return top.groupBy(key).agg(
        F.to_json(F.transform(ordered, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))).alias(name)
    )


def cluster_profile(df: DataFrame) -> DataFrame:
    total = df.agg(F.count("*"))
    base = df.groupBy("cluster").agg(
        F.count("*").alias("row_count"),
        F.min("prompt_tokens").alias("prompt_tokens_min"),
        F.round(F.percentile("prompt_tokens", F.lit(0.5)), 2).alias("prompt_tokens_p50"),
        F.round(F.percentile("prompt_tokens", F.lit(0.9)), 2).alias("prompt_tokens_p90"),
        F.max("prompt_tokens").alias("prompt_tokens_max"),
        F.round(F.avg("num_constraints"), 3).alias("num_constraints_mean"),
    ).withColumn("share", F.round(F.col("row_count") / total.scalar(), 6))
    bins = df.groupBy("cluster", "length_bin").agg(F.count("*").alias("n")).groupBy("cluster").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("length_bin", "n"))))).alias("length_bin_counts")
    )
    for part in (
        _top_values(df, "cluster", "constraint_family_signature", 3, "top_family_signatures"),
        _top_values(df, "cluster", "constraint_signature", 3, "top_constraint_signatures"),
        bins,
    ):
        base = null_safe_join(base, part, ["cluster"])
    return base


# --- split and cluster drift -----------------------------------------------------------------------------------


def cluster_share(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Share of every cluster inside a split next to its share in the whole table."""
    keys = list(by)
    cells = df.groupBy(*keys, "cluster").agg(
        F.count("*").alias("row_count"),
        F.count_if("checker_pass").alias("pass_count"),
        F.percentile("prompt_tokens", F.lit(0.5)).alias("prompt_tokens_median"),
        F.percentile("prompt_tokens", F.lit(0.9)).alias("prompt_tokens_p90"),
    )
    # The cell table holds splits x clusters rows; the windows below run over that.
    outer = [k for k in keys if k != "split"]
    n = F.col("row_count")
    return (
        cells.withColumn("share", n / F.sum(n).over(Window.partitionBy(*keys)))
        .withColumn("pass_rate", F.col("pass_count") / n)
        .withColumn(
            "global_share",
            F.sum(n).over(Window.partitionBy(*outer, "cluster")) / F.sum(n).over(Window.partitionBy(*outer, F.lit(1))),
        )
        .withColumn("share_diff_from_all", F.col("share") - F.col("global_share"))
    )


def split_tvd(shares: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Total variation distance of each split from the whole; clusters a split lacks count with share 0."""
    missing = 1 - F.sum("global_share")
    return shares.groupBy(*by).agg(
        F.sum("row_count").alias("row_count"),
        F.count("*").alias("cluster_count"),
        (0.5 * (F.sum(F.abs("share_diff_from_all")) + missing)).alias("cluster_tvd_vs_all"),
    )


def top_drift(shares: DataFrame, n: int) -> DataFrame:
    return shares.orderBy(F.round(F.abs("share_diff_from_all"), 9).desc(), "split", "cluster").limit(n).select(
        "split", "cluster", "row_count", "share", "global_share", "share_diff_from_all", "pass_rate"
    )


def split_audit(splits: DataFrame, all_rows: DataFrame) -> DataFrame:
    """One record per split file: size, duplicates, leaks, coverage, drift, passes by part, and the critical flag.

    Leaking prompts or missing ids are critical; leaking task keys are critical only for the grouped split. The split
    table is read twice: once for the counts per part and cluster, once, met with the known ids, for what its prompt ids
    and task keys show.
    """
    cells = splits.groupBy("split_name", "split", "cluster").agg(
        F.count("*").alias("n"), F.count_if("checker_pass").alias("passes"), F.count_if("output_truncated").alias("cut")
    )
    part, file = Window.partitionBy("split_name", "split"), Window.partitionBy("split_name")
    share = F.col("n") / F.sum("n").over(part)
    overall = F.sum("n").over(Window.partitionBy("split_name", "cluster")) / F.sum("n").over(file)
    # A cluster that a part lacks differs by its whole overall share.
    parts = cells.withColumns({"_s": share, "_g": overall}).groupBy("split_name", "split").agg(
        F.sum("n").alias("row_count"), F.sum("passes").alias("pass_count"), F.sum("cut").alias("truncated_rows"),
        (0.5 * (F.sum(F.abs(F.col("_s") - F.col("_g"))) + 1 - F.sum("_g"))).alias("tvd"),
    )
    said = F.concat_ws(":", F.coalesce("split", F.lit("<missing>")), "row_count", "pass_count", "truncated_rows", F.round(ratio("pass_count", "row_count"), 6))
    sizes = parts.groupBy("split_name").agg(
        F.sum("row_count").alias("row_count"), F.max("tvd").alias("max_cluster_tvd"), F.array_join(F.array_sort(F.collect_list(said)), ";").alias("pass_by_split")
    )
    ids = all_rows.select("prompt_id").distinct().withColumn("_known", F.lit(True))
    total = all_rows.agg(F.countDistinct("prompt_id")).first()[0]
    keyed = splits.select("split_name", "split", "prompt_id", "base_key").join(ids, "prompt_id", "left").select(
        "split_name", "split", F.coalesce("_known", F.lit(False)).alias("_known"),
        F.inline(F.array(
            F.struct(F.lit("prompt").alias("kind"), F.col("prompt_id").cast("string").alias("value")),
            F.struct(F.lit("key").alias("kind"), F.col("base_key").cast("string").alias("value")),
        )),
    )
    per_value = keyed.groupBy("split_name", "kind", "value").agg(
        F.count("*").alias("n"), (F.min("split") < F.max("split")).alias("leaks"), F.max("_known").alias("known")
    )
    known = F.col("value").isNotNull()
    prompt, key = F.col("kind") == "prompt", F.col("kind") == "key"
    found = per_value.groupBy("split_name").agg(
        F.sum(F.when(prompt & known & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("prompt_duplicate_rows"),
        F.sum(F.when(key & known & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("base_key_duplicate_rows"),
        F.count_if(prompt & known & ~F.col("known")).alias("extra_prompt_id_count"),
        (F.lit(total) - F.count_if(prompt & F.col("known"))).alias("missing_prompt_id_count"),
        F.count_if(prompt & known & F.col("leaks")).alias("prompt_leaks"),
        F.count_if(key & known & F.col("leaks")).alias("base_key_leaks"),
    )
    critical = (
        (F.col("prompt_duplicate_rows") > 0)
        | (F.col("prompt_leaks") > 0)
        | (F.col("missing_prompt_id_count") > 0)
        | (F.col("extra_prompt_id_count") > 0)
        | (F.col("split_name").contains("group_key") & (F.col("base_key_leaks") > 0))
    )
    return sizes.join(found, "split_name").withColumn("critical", critical)


# --- lift and association --------------------------------------------------------------------------------------


def _lift_columns(df: DataFrame, whole: DataFrame, n: str, x: str) -> DataFrame:
    """Lift of a group's positive rate over the overall rate, with the binomial z of its excess."""
    totals = whole.select(F.struct("rows", "positives").alias("t"))
    out = df.withColumn("_t", totals.scalar())
    rate = F.col("_t.positives") / F.col("_t.rows")
    expected = F.col(n) * rate
    variance = F.col(n) * rate * (1 - rate)
    return out.withColumns(
        {
            "truncated_rate": ratio(x, n),
            "row_share": F.col(n) / F.col("_t.rows"),
            "truncated_share": F.col(x) / F.greatest(F.lit(1), F.col("_t.positives")),
            "expected_truncated_count": expected,
            "excess_truncated_count": F.col(x) - expected,
            "lift_vs_overall": ratio(ratio(x, n), rate),
            "binomial_z": F.when(variance > 0, (F.col(x) - expected) / F.sqrt(variance)),
        }
    ).drop("_t")


def _whole(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if("output_truncated").alias("positives"))


def lift_table(df: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    grouped = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("category")).agg(
        F.count("*").alias("row_count"),
        F.count_if("output_truncated").alias("truncated_count"),
        F.round(F.percentile("prompt_tokens", F.lit(0.5)), 2).alias("prompt_tokens_p50"),
        F.round(F.percentile("output_tokens", F.lit(0.5)), 2).alias("output_tokens_p50"),
        F.round(F.percentile("output_tokens", F.lit(0.9)), 3).alias("output_tokens_p90"),
        F.round(F.avg("num_constraints"), 3).alias("num_constraints_mean"),
    ).filter(F.col("row_count") >= min_count)
    return _lift_columns(grouped, _whole(df), "row_count", "truncated_count")


def lift_by_id(df: DataFrame, ids: str = "instruction_ids", min_count: int = 1) -> DataFrame:
    """Lift per instruction id: rows are distinct prompts, positives are summed over exploded rows.

    Rows are counted per id and prompt, then per id and token count: the median comes from these counts.
    """
    rows = df.select("prompt_id", "output_truncated", "prompt_tokens", F.explode(ids).alias("category"))
    per_prompt = rows.groupBy("category", "prompt_id", "prompt_tokens").agg(F.count("*").alias("n"), F.count_if("output_truncated").alias("x"))
    first = F.row_number().over(Window.partitionBy("category", "prompt_id").orderBy("prompt_tokens"))
    per_length = per_prompt.withColumn("_new", (first == 1).cast("int")).groupBy("category", "prompt_tokens").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("_new").alias("prompts")
    )
    grouped = per_length.groupBy("category").agg(
        F.sum("prompts").alias("row_count"),
        F.sum("x").alias("truncated_count"),
        F.round(F.percentile("prompt_tokens", F.lit(0.5), F.col("n")), 2).alias("prompt_tokens_p50"),
    ).filter(F.col("row_count") >= min_count)
    return _lift_columns(grouped, _whole(df), "row_count", "truncated_count")


def concentration(df: DataFrame, column: str, tops: Sequence[int] = (3, 5)) -> DataFrame:
    """Share of positives and of rows held by the groups with the most positives."""
    groups = df.groupBy(column).agg(
        F.count("*").alias("row_count"), F.count_if("output_truncated").alias("truncated_count")
    )
    best = groups.orderBy(F.col("truncated_count").desc(), column).limit(max(tops))
    position = F.row_number().over(Window.orderBy(F.col("truncated_count").desc(), column))
    ranked = best.withColumn("_rn", position)
    whole = _whole(df).select(F.struct("rows", "positives")).scalar()
    sums = ranked.agg(
        *[F.sum(F.when(F.col("_rn") <= k, F.col(c))).alias(f"{c}_{k}") for k in tops for c in ("truncated_count", "row_count")]
    ).withColumn("_t", whole)
    return sums.select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(k).cast("bigint").alias("top"),
                    ratio(F.col(f"truncated_count_{k}"), F.col("_t.positives")).alias("truncated_share"),
                    ratio(F.col(f"row_count_{k}"), F.col("_t.rows")).alias("row_share"),
                )
                for k in tops
            ])
        )
    )


def contingency(df: DataFrame, features: Sequence[str], flag: str) -> DataFrame:
    """Rows and positives per feature and level; one pass over the table for all features."""
    fan = F.inline(
        F.array(*[
            F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("string"), F.lit(MISSING)).alias("level"))
            for f in features
        ])
    )
    return df.select(F.col(flag).alias("_y"), fan).groupBy("feature", "level").agg(
        F.count("*").alias("n"), F.count_if("_y").alias("pos")
    )


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b or tiny
        c = b + an / c or tiny
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi_square_p(chi2: Column, dof: Column) -> Column:
    @F.arrow_udf("double")
    def p_value(x: pa.Array, k: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), k.to_pylist(), strict=True)
        return pa.array([None if v is None or not n else _upper_gamma(n / 2, v / 2) for v, n in pairs], pa.float64())

    return p_value(chi2, dof)


def association(df: DataFrame, features: Sequence[str], flag: str) -> DataFrame:
    """Chi-square (continuity-corrected with one degree of freedom), Cramer's V and mutual information per feature."""
    cells = contingency(df, features, flag)
    w = Window.partitionBy("feature")
    t = cells.withColumns(
        {"_N": F.sum("n").over(w), "_P": F.sum("pos").over(w), "_levels": F.count("*").over(w)}
    ).withColumn("_share", F.col("_P") / F.col("_N"))
    corrected = F.col("_levels") == 2

    def cell(observed: Column, expected: Column) -> Column:
        gap = F.abs(observed - expected)
        gap = F.when(corrected, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / expected

    def info(observed: Column, column_total: Column) -> Column:
        n = F.col("_N")
        return F.when(observed > 0, observed / n * F.log(observed * n / (F.col("n") * column_total))).otherwise(0.0)

    e1 = F.col("n") * F.col("_share")
    e0 = F.col("n") - e1
    neg = F.col("n") - F.col("pos")
    out = (
        t.filter((F.col("_levels") >= 2) & (F.col("_P") > 0) & (F.col("_P") < F.col("_N")))
        .groupBy("feature")
        .agg(
            F.count("*").alias("levels"),
            F.sum(cell(F.col("pos"), e1) + cell(neg, e0)).alias("chi2"),
            (F.count("*") - 1).alias("dof"),
            F.sum(info(F.col("pos"), F.col("_P")) + info(neg, F.col("_N") - F.col("_P"))).alias("mutual_information"),
            F.max("_N").alias("_n"),
        )
    )
    return out.withColumn("cramers_v", F.sqrt(F.col("chi2") / F.col("_n"))).drop("_n")


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts per cell; the column values are given, so no extra job looks for them. Missing cells are 0."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return wide.na.fill(0, list(values))


def pivot_rate(df: DataFrame, row: str, column: str, values: Sequence[str], flag: str, min_rows: int = 30) -> DataFrame:
    """Positive rate per cell, null where a cell is absent or has fewer rows than asked for."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("n"), F.count_if(flag).alias("x"))
    shown = F.when(F.first("n") >= min_rows, F.first("x") / F.first("n"))
    return cells.groupBy(row).pivot(column, list(values)).agg(shown)


def cluster_failures(checks: DataFrame, child: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Per cluster a summary row, and the most frequent failed rules with their share of all failures."""
    parents = checks.select("prompt_id", "cluster")
    rows = child.join(parents, "prompt_id")
    per_cluster = rows.groupBy("cluster").agg(
        F.count("*").alias("constraint_count"), F.count_if(~F.col("followed")).alias("failed_constraint_count")
    )
    summary = null_safe_join(
        checks.groupBy("cluster").agg(
            F.count("*").alias("row_count"),
            F.count_if("checker_pass").alias("pass_count"),
            F.avg("num_constraints").alias("num_constraints_mean"),
            F.percentile("prompt_tokens", F.lit(0.5)).alias("prompt_tokens_p50"),
            F.percentile("output_tokens", F.lit(0.5)).alias("output_tokens_p50"),
            F.percentile("output_tokens", F.lit(0.9)).alias("output_tokens_p90"),
            F.count_if(F.col("checker_error_count") > 0).alias("checker_error_rows"),
        ),
        per_cluster,
        ["cluster"],
    ).withColumn("pass_rate", ratio("pass_count", "row_count"))
    counts = rows.filter(~F.col("followed")).groupBy("cluster", "instruction_id").agg(F.count("*").alias("fail_count"))
    share = F.col("fail_count") / F.sum("fail_count").over(Window.partitionBy("cluster"))
    failures = top_per_group(
        counts.withColumn("failed_constraint_share", share), ["cluster"],
        [F.col("fail_count").desc(), F.col("instruction_id")], top, "position",
    )
    return summary, failures


def throughput_summary(df: DataFrame, wall_seconds: float) -> DataFrame:
    """Success, truncation, token and latency totals of a generation run; wall time is given."""
    ok = F.col("ok")
    sums = df.agg(
        F.count("*").alias("row_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        F.count_if(ok & F.col("output_truncated")).alias("output_truncated_count"),
        F.count_if(ok & (F.col("finish_reason") == "length")).alias("finish_length_count"),
        F.count_if(ok & (F.col("finish_reason") == "stop")).alias("finish_stop_count"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("completion_tokens"),
        F.max(F.when(ok, F.col("output_tokens"))).alias("output_tokens_max"),
        F.percentile(F.when(ok, F.col("output_tokens")), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("_t"),
        F.min(F.when(ok, F.col("seconds"))).alias("seconds_min"),
        F.avg(F.when(ok, F.col("seconds"))).alias("seconds_mean"),
        F.max(F.when(ok, F.col("seconds"))).alias("seconds_max"),
    )
    bucket = F.floor(F.least(F.col("seconds"), F.lit(4096.0)) * 16)
    latency = exact_quantiles(
        df.filter(ok).select("seconds"), [], "seconds", {"seconds_p50": 0.5, "seconds_p90": 0.9}, bucket
    )
    packed = latency.select(F.struct("seconds_p50", "seconds_p90")).scalar()
    return sums.withColumn("_l", packed).select(
        *[c for c in sums.columns if c != "_t"],
        *[F.col("_t")[i].alias(f"output_tokens_p{q}") for i, q in enumerate((50, 90, 95))],
        F.col("_l.seconds_p50").alias("seconds_p50"),
        F.col("_l.seconds_p90").alias("seconds_p90"),
        (F.col("completion_tokens") / F.lit(float(wall_seconds))).alias("tokens_per_second"),
    )


# --- roll-ups over runs ----------------------------------------------------------------------------------------


def run_rollup(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], seed: str = "seed", single_run_std: float | None = 0.0
) -> DataFrame:
    """Mean, sample deviation, minimum and maximum over the runs of a configuration.

    The input has one row per run. ``single_run_std`` is the deviation reported for one run; None leaves it null.
    """
    columns = []
    for m in metrics:
        std = F.stddev_samp(m)
        columns += [
            F.avg(m).alias(f"{m}_mean"),
            (std if single_run_std is None else F.coalesce(std, F.lit(single_run_std))).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    seeds = F.array_sort(F.collect_set(seed))
    return df.groupBy(*keys).agg(
        F.countDistinct(seed).alias("run_count"),
        F.array_join(F.transform(seeds, lambda s: s.cast("string")), ",").alias("seeds"),
        *columns,
    )


def split_overview(splits: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per part, positive rate and distinct signatures of the test part, per split file."""
    joined = splits.select("split_name", "split", "prompt_id", "constraint_signature").join(
        labels.select("prompt_id", "checker_pass"), "prompt_id"
    )
    part = F.col("split")
    return joined.groupBy("split_name").agg(
        *[F.count_if(part == p).alias(f"{p}_rows") for p in ("train", "val", "test")],
        ratio(F.count_if((part == "test") & F.col("checker_pass")), F.count_if(part == "test")).alias("test_positive_rate"),
        F.countDistinct(F.when(part == "test", F.col("constraint_signature"))).alias("test_signature_count"),
    )


def token_support(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Test tokens that never occur in train: how many, and their share of all test tokens.

    Input: one row per (split, token) with its number of occurrences.
    """
    per = tokens.groupBy(token).agg(
        F.sum(F.when(F.col("split") == "train", F.col("n"))).alias("_train"),
        F.sum(F.when(F.col("split") == "test", F.col("n"))).alias("_test"),
    )
    unseen = F.col("_train").isNull() & F.col("_test").isNotNull()
    return per.agg(
        F.count_if(F.col("_train").isNotNull()).alias("train_token_count"),
        F.count_if(unseen).alias("unseen_token_count"),
        (
            F.coalesce(F.sum(F.when(unseen, F.col("_test"))), F.lit(0))
            / F.greatest(F.lit(1), F.coalesce(F.sum("_test"), F.lit(0)))
        ).alias("unseen_token_mass"),
    )
