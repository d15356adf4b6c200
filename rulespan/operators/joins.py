"""Key joins with checked cardinality, set operations and keep-one deduplication.

Joins carry no broadcast hint: the optimiser broadcasts a side it has measured to be small and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespan.functions.rules import conflict_edges


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)


def unique_keys(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The rows of ``df``; the job fails on a key that occurs twice. Only the key columns are read for the check."""
    twice = duplicate_keys(df.select(*keys), keys).agg(F.max(F.to_json(F.struct(*keys)))).scalar()
    fails = F.raise_error(F.concat(F.lit(f"{what}: duplicate key "), twice)).cast("boolean")
    return df.filter(F.when(twice.isNull(), F.lit(True)).otherwise(fails))


#: A key is hot when it holds more than this share of the rows: there are fewer than 512 of them.
HOT_SHARE = 1 / 512


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``key`` and in ``weight`` the number of its rows.

    ``table`` should be written already: it is read three times. Hot keys, fewer than 512 however large the table, come
    by a broadcast; their rows pass the join for all others spread by ``spread``, where nothing waits for them. So no
    task gets all rows of a key, and the table may have any size. Rows without a partner, or with a null key, get nulls.
    """
    names = [c for c in table.columns if c != key]
    total = table.agg(F.sum(weight)).first()[0] or 0
    # Always 0, but not a literal: that would be taken out of the join key, and the key alone would deal out the rows.
    zero = F.pmod(F.col(weight), F.lit(1)).cast("bigint")
    hot = table.filter(F.col(weight) > HOT_SHARE * total).limit(int(1 / HOT_SHARE)).select(F.col(key).alias("_hot"), F.struct(*names).alias("_of_hot"))
    cold = table.filter(F.col(weight) <= HOT_SHARE * total).select(F.col(key).alias("_cold"), zero.alias("_cold_part"), F.struct(*names).alias("_of_cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    spread_out = F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1
    marked = marked.withColumn("_part", F.when(F.col("_of_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(spread_out))
    both = marked.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_part") == F.col("_cold_part")), "left")
    return both.select(*rows.columns, *[F.coalesce(f"_of_hot.{c}", f"_of_cold.{c}").alias(c) for c in names])


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return unique_keys(left, keys, "left").join(unique_keys(right, keys, "right"), list(keys), how)


def match_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows, matched rows and rows without a partner, as one row."""
    marked = right.select(*keys).distinct().withColumn("_hit", F.lit(True))
    joined = left.select(*keys).join(marked, list(keys), "left")
    return joined.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("_hit").isNotNull()).alias("matched_count"),
        F.count_if(F.col("_hit").isNull()).alias("missing_count"),
    )


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Counts of both sides and of the ids only one side knows."""
    both = (
        expected.select(key, F.lit(1).alias("_e"), F.lit(0).alias("_f"))
        .unionByName(found.select(key, F.lit(0).alias("_e"), F.lit(1).alias("_f")))
        .groupBy(key)
        .agg(F.sum("_e").alias("_e"), F.sum("_f").alias("_f"))
    )
    return both.agg(
        F.sum("_e").alias("expected_row_count"),
        F.sum("_f").alias("found_row_count"),
        F.count_if(F.col("_f") == 0).alias("missing_count"),
        F.count_if(F.col("_e") == 0).alias("extra_count"),
    )


def coverage_preview(expected: DataFrame, found: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` ids missing from, and the first ``n`` ids extra in, the found side."""
    missing = expected.select(key).join(found.select(key), key, "left_anti").distinct().orderBy(key).limit(n)
    extra = found.select(key).join(expected.select(key), key, "left_anti").distinct().orderBy(key).limit(n)
    return missing.withColumn("issue", F.lit("missing_from_split")).unionByName(
        extra.withColumn("issue", F.lit("extra_not_in_all"))
    )


def overlap_counts(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str) -> DataFrame:
    """How many ids each pair of parts of two splits shares."""
    pairs = left.select(key, F.col(left_by).alias("left_part")).join(
        right.select(key, F.col(right_by).alias("right_part")), key
    )
    return pairs.groupBy("left_part", "right_part").agg(F.countDistinct(key).alias("shared_ids"))


def ids_within(ids: Column, wanted: Sequence[str] | Column) -> Column:
    """Sorted distinct ids of a row that belong to a set."""
    allowed = wanted if isinstance(wanted, Column) else F.array(*map(F.lit, wanted))
    return F.array_sort(F.array_distinct(F.array_intersect(ids, allowed)))


def only_supported(df: DataFrame, ids: str, supported: Sequence[str]) -> DataFrame:
    return df.filter(F.size(F.array_except(ids, F.array(*map(F.lit, supported)))) == 0)


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_one(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key, the first or last in an explicit order. Partial aggregation keeps one row per task and key."""
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Map a key through a table with one row per key; unknown keys get the default."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def conflict_pairs(df: DataFrame, ids: str = "instruction_ids", key: str = "prompt_id") -> DataFrame:
    """Rows that carry two rules which exclude each other, one output row per pair (a < b).

    The exclusion table is a constant keyed by rule; each id of a row looks up its partners inside the row, so rows
    are never joined with each other.
    """
    partners: dict[str, list[str]] = {}
    for a, b in conflict_edges():
        if a != b:
            partners.setdefault(a, []).append(b)
    table = F.create_map(*[x for a, bs in partners.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    hits = F.transform(
        F.array_distinct(ids),
        lambda a: F.transform(
            F.array_intersect(F.coalesce(F.try_element_at(table, a), F.array().cast("array<string>")), F.col(ids)),
            lambda b: F.struct(a.alias("instruction_a"), b.alias("instruction_b")),
        ),
    )
    return df.select(key, F.inline(F.flatten(hits)))


GUARDS = (
    "row_count_mismatch", "missing_response_rows", "constraint_count_mismatch_rows", "checker_error_rows",
    "provenance_mismatch_rows",
)


def label_build(promptset: DataFrame, checks: DataFrame, generations: DataFrame) -> DataFrame:
    """Prompts with untruncated checks, joined to their generation record."""
    kept = checks.filter(~F.col("output_truncated"))
    return join_one_to_one(join_one_to_one(promptset, kept, ["prompt_id"]), generations, ["prompt_id"], "left")


def label_guards(labelled: DataFrame, checks: DataFrame) -> DataFrame:
    """Violation counts of the five consistency rules of the labelled table, as one row."""
    expected = checks.filter(~F.col("output_truncated")).agg(F.count("*"))
    return labelled.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("response_text").isNull()).alias("missing_response_rows"),
        F.count_if(F.col("num_constraints_checked") != F.col("num_constraints")).alias("constraint_count_mismatch_rows"),
        F.count_if(F.col("checker_error_count") > 0).alias("checker_error_rows"),
        F.count_if(~F.col("generation_dir").eqNullSafe(F.col("generation_dir_from_outputs"))).alias(
            "provenance_mismatch_rows"
        ),
    ).withColumn("row_count_mismatch", F.col("row_count") - expected.scalar())
