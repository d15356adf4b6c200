"""Samples by cluster, length and outcome. Every random choice is a seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespan.operators.ranking import hash_rank, hex_bucket, null_safe_join, ordered_totals, running_totals, seeded_digest
from rulespan.session import checkpointed


def _layers(excess: dict[int, int], gap: int) -> tuple[int, int]:
    """(whole layers, units left over) when ``gap`` units are cut one layer after the other.

    ``excess``: how many clusters can give how many units. Layer j takes one unit of every cluster that has j to give.
    """
    level, giving = 0, sum(c for e, c in excess.items() if e > 0)
    for e in sorted(x for x in excess if x > 0):
        if (e - level) * giving > gap:
            return level + gap // giving, gap % giving
        gap -= (e - level) * giving
        level, giving = e, giving - excess[e]
    return level, 0


def allocate_sqrt(counts: DataFrame, cluster: str, size: int) -> DataFrame:
    """Rows to draw per cluster: proportional to the square root of its size, at least 1, exact in total.

    ``counts`` holds one row per cluster (``n`` rows each), and is written once with its shares. Missing units go to the
    largest remainders. Surplus units are cut like water down to a common level: shares were rounded down, so a greedy
    loop takes one unit of every cluster that has one left before it takes a second of any. The level follows from how
    many clusters have which share (a table as short as there are different shares), and only the units at the level
    are put in order. Fewer rows than clusters: one each.
    """
    weight = counts.agg(F.sum(F.sqrt("n"))).first()[0]
    if not weight:
        return counts.select(cluster, "n", F.lit(0).cast("bigint").alias("allocation"))
    raw = F.sqrt("n") / F.lit(weight) * size
    first = checkpointed(counts.withColumn("_raw", raw).withColumn("_a", F.greatest(F.floor("_raw"), F.lit(1)).cast("bigint")))
    shares = {r["_a"] - 1: r["c"] for r in first.groupBy("_a").agg(F.count("*").alias("c")).collect()}
    gap = size - sum((e + 1) * c for e, c in shares.items())
    layers, units = (0, gap) if gap >= 0 else _layers(shares, -gap)
    sign = 1 if gap >= 0 else -1
    able = first if gap >= 0 else first.filter(F.col("_a") - 1 > layers)
    lacking = (F.col("_raw") - F.col("_a")) * sign
    placed = ordered_totals(able.select(cluster, lacking.alias("_v")), [], [F.col("_v").desc(), F.col(cluster).asc()], {"_place": F.lit(1).cast("bigint")})
    more = placed.filter(F.col("_place") <= units).select(cluster, F.lit(sign).alias("_unit"))
    level = F.least(F.col("_a") - 1, F.lit(layers))
    return null_safe_join(first, more, [cluster], "left").select(
        cluster, "n", (F.col("_a") - level + F.coalesce("_unit", F.lit(0))).alias("allocation")
    )


def _length_position(df: DataFrame, cluster: str) -> DataFrame:
    """0-based position inside the cluster by (prompt_tokens, prompt_id)."""
    ranked = running_totals(
        df,
        [cluster],
        [[(F.col("prompt_tokens"), True)], [(hex_bucket(F.col("prompt_id"), 2), True)]],
        [F.col("prompt_tokens"), F.col("prompt_id")],
        {"_pos": F.lit(1).cast("bigint")},
    )
    return ranked.withColumn("_pos", F.col("_pos") - 1)


def chunk_sample(df: DataFrame, allocation: DataFrame, cluster: str, seed: int) -> DataFrame:
    """One row from each of ``allocation`` equal length chunks per cluster; small clusters are kept whole."""
    placed = null_safe_join(_length_position(df, cluster), allocation, [cluster])
    n, k, at = F.col("n"), F.col("allocation"), F.col("_pos")
    small, extra = F.floor(n / k), n % k
    large = extra * (small + 1)
    chunk = (
        F.when(k >= n, at)
        .when(at < large, F.floor(at / (small + 1)))
        .otherwise(extra + F.floor((at - large) / small))
    )
    picked = placed.withColumn("_chunk", chunk).groupBy(cluster, "_chunk").agg(
        F.min_by(F.struct(*df.columns), F.struct(seeded_digest(seed, F.col("prompt_id")), "prompt_id")).alias("_row")
    )
    return picked.select("_row.*")


def cluster_length_sample(df: DataFrame, size: int, seed: int, cluster: str = "cluster") -> DataFrame:
    """Chunk sample over all clusters plus the shortest and longest prompt, trimmed evenly to ``size`` and shuffled."""
    counts = df.groupBy(cluster).agg(F.count("*").alias("n"))
    drawn = chunk_sample(df, allocate_sqrt(counts, cluster, size), cluster, seed)
    ends = df.agg(
        F.min_by("prompt_id", F.struct("prompt_tokens", "prompt_id")).alias("a"),
        F.min_by("prompt_id", F.struct(-F.col("prompt_tokens"), "prompt_id")).alias("b"),
    ).select(F.explode(F.array("a", "b")).alias("prompt_id"))
    extremes = df.join(ends.distinct(), "prompt_id", "left_semi").withColumn("_keep", F.lit(1))
    both = drawn.withColumn("_keep", F.lit(0)).unionByName(extremes)
    merged = both.groupBy("prompt_id").agg(
        F.max_by(F.struct(*[c for c in both.columns if c != "prompt_id"]), "_keep").alias("_row")
    ).select("prompt_id", "_row.*")
    merged = checkpointed(merged)
    rows, drawn_rows = merged.agg(F.count("*"), F.count_if(F.col("_keep") == 0)).first()
    over = max(rows - size, 0)
    order = [F.col(cluster).asc(), F.col("prompt_tokens").asc(), F.col("prompt_id").asc()]
    placed = ordered_totals(merged, [], order, {"_at": 1 - F.col("_keep")}).withColumn("_at", F.col("_at") - 1)
    # The i-th row to drop lies at floor(i * step); a row is one of them if the next whole i that reaches it does.
    step = (drawn_rows - 1) / (over - 1) if over > 1 else 0.0
    if over == 0:
        dropped = F.lit(False)
    elif step == 0:
        dropped = F.col("_at") == 0
    else:
        near = [F.floor(F.col("_at") / F.lit(step)) + d for d in (0, 1)]
        dropped = F.lit(False)
        for i in near:
            dropped = dropped | ((i >= 0) & (i < over) & (F.floor(i * F.lit(step)) == F.col("_at")))
    left = placed.filter(~((F.col("_keep") == 0) & dropped)).select(*df.columns)
    return hash_rank(left, [], "prompt_id", seed, "position")


def length_grid_sample(df: DataFrame, size: int) -> DataFrame:
    """Rows at evenly spaced ranks of the distinct lengths; gaps are filled from the shortest lengths.

    The table of distinct lengths is bounded by the longest prompt in tokens.
    """
    per_length = df.groupBy("prompt_tokens").agg(
        F.min_by(F.struct(*[c for c in df.columns if c != "prompt_tokens"]), "prompt_id").alias("_row")
    )
    ranked = per_length.withColumn("_at", F.row_number().over(Window.orderBy("prompt_tokens")) - 1)
    grid = per_length.agg(F.count("*").alias("m")).select(
        "m",
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.lit(size - 1)),
                lambda i: F.bround(i * ((F.col("m") - 1) / F.lit(float(max(size - 1, 1))))).cast("int"),
            )
        ).alias("s"),
    )
    unused = F.array_except(F.sequence(F.lit(0), (F.col("m") - 1).cast("int")), F.col("s"))
    chosen = F.when(F.lit(size) >= F.col("m"), F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))).otherwise(
        F.concat("s", F.slice(unused, F.lit(1), F.greatest(size - F.size("s"), F.lit(0))))
    )
    return (
        ranked.join(grid.select(F.explode(chosen).alias("_at")), "_at")
        .select("prompt_tokens", "_row.*")
    )


def outcome_sample(
    df: DataFrame, size: int, seed: int, cluster: str = "cluster", passes: int = 20, few_passes: int = 10,
    rare_rate: float = 0.2, most_share: float = 0.5,
) -> DataFrame:
    """Per cluster a mix of passed and failed rows: ``passes`` (``few_passes`` where the pass rate is under ``rare_rate``),
    at most ``most_share`` of the sample; then fails; then more passes when fails run out."""
    ok = F.col("checker_pass")
    c = df.groupBy(cluster).agg(F.count_if(ok).alias("_p"), F.count_if(~ok).alias("_f"))
    target = F.when(F.col("_p") / (F.col("_p") + F.col("_f")) >= rare_rate, passes).otherwise(few_passes)
    take = F.least(target, F.col("_p"), F.lit(int(size * most_share)))
    fails = F.least(size - F.col("_take"), F.col("_f"))
    extra = F.least(size - F.col("_take") - F.col("_fails"), F.col("_p") - F.col("_take"))
    caps = c.withColumn("_take", take).withColumn("_fails", fails).withColumn("_passes", F.col("_take") + extra)
    ranked = null_safe_join(
        hash_rank(df, [cluster, "checker_pass"], "prompt_id", seed, "_rank"),
        caps.select(cluster, "_passes", "_fails"), [cluster],
    )
    cap = F.when(ok, F.col("_passes")).otherwise(F.col("_fails"))
    return ranked.filter(F.col("_rank") <= cap).select(*df.columns)


def audit_sample(
    df: DataFrame, seed: int, per_group: int, per_cluster: int, clusters: Sequence[int]
) -> DataFrame:
    """Rows per outcome x truncation cell and per outcome of chosen clusters; a row belongs to its first group."""
    ok, cut = F.col("checker_pass"), F.col("output_truncated")
    cell = F.concat_ws(
        "_", F.when(ok, "pass").otherwise("fail"), F.when(cut, "truncated").otherwise("not_truncated")
    )
    ranked = hash_rank(df, ["checker_pass", "output_truncated"], "prompt_id", seed, "_cell")
    ranked = hash_rank(ranked, ["cluster", "checker_pass"], "prompt_id", seed + 1, "_cluster")
    in_cluster = F.col("cluster").isin(*clusters) & (F.col("_cluster") <= per_cluster)
    group = F.when(F.col("_cell") <= per_group, cell).when(
        in_cluster,
        F.concat(F.lit("cluster_"), F.col("cluster").cast("string"), F.when(ok, "_pass").otherwise("_fail")),
    )
    return ranked.withColumn("audit_group", group).filter(F.col("audit_group").isNotNull()).drop("_cell", "_cluster")


def per_group_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int, key: str = "prompt_id") -> DataFrame:
    return hash_rank(df, keys, key, seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def size_ladder(df: DataFrame, sizes: Sequence[int | None], seed: int, key: str = "prompt_id") -> DataFrame:
    """Nested samples of growing size from one ranking; a size beyond the rows is labelled ``<size>/full``."""
    ranked = hash_rank(df, [], key, seed, "_rank")
    rows = df.agg(F.count("*")).scalar()

    def step(size: int | None) -> Column:
        if size is None:
            return F.struct(F.lit("full").alias("size_label"), rows.alias("_size"))
        name = f"{size // 1000}k" if size % 1000 == 0 else str(size)
        label = F.when(rows < size, f"{name}/full").otherwise(name)
        return F.struct(label.alias("size_label"), F.lit(size).cast("bigint").alias("_size"))

    fan = ranked.select("*", F.inline(F.array(*[step(s) for s in sizes])))
    return fan.filter(F.col("_rank") <= F.col("_size")).drop("_rank", "_size")
