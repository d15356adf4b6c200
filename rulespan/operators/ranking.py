"""Order-dependent operators that never sort a whole group in one task.

A running total over a large group is split into parts that follow the sort order: totals of the parts are summed over
a small table, and only rows of one part are sorted together. Two ways give the parts. In digest order they are prefixes
of the digest, evenly filled and pure functions of the row (``running_totals``). In the order of values, whose
distribution is unknown, Spark samples the sort columns and deals the rows out by range; they are written once with
their part, so every later step and every recomputation reads the same parts (``ordered_totals``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespan.session import shared_folder

def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the key columns of the left side stay."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def hex_bucket(digest: Column, digits: int = 3) -> Column:
    """Leading digits of a hex digest: evenly filled buckets in digest order."""
    return F.substring(digest, 1, digits)


def seeded_digest(seed: int, key: Column) -> Column:
    """Pseudo-random order of keys: SHA-256 of ``seed:key``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def _after_carry(rows: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Rows of a part behind one row that carries the total of all earlier parts."""
    rows = rows.withColumn("_late", F.lit(1))
    if carry is None:
        return rows
    return rows.unionByName(carry.withColumn("_late", F.lit(0)), allowMissingColumns=True)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Sequence[tuple[Column, bool]]],
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Add, per name in ``sums``, the total over all rows up to and including the row, in ``order`` within ``keys``.

    ``levels`` are buckets from coarse to fine as lists of (column, ascending). Each level must follow ``order``:
    a row in an earlier bucket sorts before every row of a later one.
    """
    named = [[(f"_b{i}_{j}", c, up) for j, (c, up) in enumerate(level)] for i, level in enumerate(levels)]
    parts = {f"_s_{n}": c for n, c in sums.items()}
    work = df.withColumns({**{n: c for level in named for n, c, _ in level}, **parts})

    carry, path = None, list(keys)
    for level in named:
        coarse, path = path, path + [n for n, _, _ in level]
        totals = work.groupBy(*path).agg(*[F.sum(p).alias(p) for p in parts])
        before = (
            Window.partitionBy(*coarse)
            .orderBy("_late", *[F.col(n).asc() if up else F.col(n).desc() for n, _, up in level])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            _after_carry(totals, carry)
            .select(*path, "_late", *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(p) for p in parts])
            .filter(F.col("_late") == 1)
            .drop("_late")
        )
    inside = (
        Window.partitionBy(*path).orderBy("_late", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _after_carry(work, carry)
        .withColumns({n: F.sum(f"_s_{n}").over(inside) for n in sums})
        .filter(F.col("_late") == 1)
        .select(*df.columns, *sums)
    )


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with ``_part``, ascending in ``keys`` and ``order``: parts of about equal size, written once."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "ranges")
    parted = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    parted.write.parquet(path)
    return spark.read.schema(parted.schema).parquet(path)


def ordered_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``running_totals`` in the order of values, however they are distributed. The input is computed once."""
    parts = {f"_s_{n}": c for n, c in sums.items()}
    placed = ranged(df.withColumns(parts), keys, order)
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(p).alias(p) for p in parts])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_part", *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(p) for p in parts])
    inside = Window.partitionBy(*keys, "_part").orderBy("_late", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _after_carry(placed, carry)
        .withColumns({n: F.sum(f"_s_{n}").over(inside) for n in sums})
        .filter(F.col("_late") == 1)
        .select(*df.columns, *sums)
    )


def hash_rank(
    df: DataFrame, strata: Sequence[str], key: str = "prompt_id", seed: int = 42, name: str = "hash_rank"
) -> DataFrame:
    """1-based position of every row in seeded hash order within its stratum."""
    digest = seeded_digest(seed, F.col(key))
    ranked = running_totals(
        df.withColumn("_h", digest),
        strata,
        [[(hex_bucket(F.col("_h")), True)]],
        [F.col("_h"), F.col(key)],
        {name: F.lit(1).cast("bigint")},
    )
    return ranked.drop("_h")


def score_rank(
    df: DataFrame, keys: Sequence[str], score: str, tie: str = "prompt_id", name: str = "position"
) -> DataFrame:
    """1-based position by score descending, ties by ``tie`` ascending; rows of one score are dealt out by ``tie``."""
    return ordered_totals(df, keys, [F.col(score).desc(), F.col(tie).asc()], {name: F.lit(1).cast("bigint")})


def dense_index(df: DataFrame, key: str = "prompt_id", name: str = "row_index") -> DataFrame:
    """0-based dense index in key order, for hex keys."""
    ranked = running_totals(
        df, [], [[(hex_bucket(F.col(key)), True)]], [F.col(key)], {name: F.lit(1).cast("bigint")}
    )
    return ranked.withColumn(name, F.col(name) - 1)


def stable_sample(df: DataFrame, size: int | None, seed: int, key: str = "prompt_id") -> DataFrame:
    """Seeded hash sample; samples of one seed are nested. No size, or one beyond the rows, keeps every row."""
    if size is None:
        return df
    if size <= 0:
        raise ValueError(f"sample size must be positive, got {size}")
    return hash_rank(df, [], key, seed, "_rank").filter(F.col("_rank") <= size).drop("_rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """First ``k`` rows per group. Spark keeps k rows per task before the shuffle, so hot groups stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def group_mode(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(
        F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(name)
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], bucket: Column
) -> DataFrame:
    """Linearly interpolated quantiles without holding a group's values in one task.

    ``bucket`` is a non-decreasing function of the value with a bounded number of results. Equal values are counted
    first; positions are found by running totals over the counted values.
    """
    rows = df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, bucket.alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_totals(counts, keys, [[(F.col("_k"), True)]], [F.col("_v").asc()], {"_upto": F.col("_n")})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = null_safe_join(upto, totals, keys) if keys else upto.withColumn("_total", totals.scalar())

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col("_v")))

    columns = []
    for name, q in quantiles.items():
        h = (F.col("_total") - 1) * q
        low, high = at(F.floor(h)), at(F.ceil(h))
        share = F.max(h - F.floor(h))
        columns.append((low + (high - low) * share).alias(name))
    return placed.groupBy(*keys).agg(*columns)
