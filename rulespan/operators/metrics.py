"""Prediction metrics as grouped aggregations.

Everything starts from one compact table: per key and distinct score the number of positive and negative rows
(partial aggregation runs before the shuffle). Ranking metrics are running totals over that table.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from rulespan.functions.text import bound_once
from rulespan.operators.ranking import null_safe_join, ordered_totals, ranged, score_rank
from rulespan.session import checkpointed

# The small task-side helpers of this module travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Coverages, list lengths and bins the result tables are reported for.
COVERAGES = (0.1, 0.2, 0.5, 1.0)
CURVE_COVERAGES = tuple(round(0.05 * i, 2) for i in range(1, 21))
TOP_K = (100, 500, 1000, 2000)
BINS = 10

#: Rows whose bootstrap weights a task holds at once.
BLOCK_ROWS = 4096


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(_ratio(a, b), F.lit(0.0))


def score_counts(
    df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "p_pred", weight: str | None = None
) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight)
    y = F.col(label)
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(w * y).cast("bigint").alias("pos"), F.sum(w * (1 - y)).cast("bigint").alias("neg")
    )


def curve(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct score: true and false positives when everything at or above the score is selected."""
    return ordered_totals(counts, keys, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})


def area_metrics(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUROC (ties count half) and average precision (step sum); null unless both classes occur."""
    pos, neg = F.sum("pos"), F.sum("neg")
    both = (pos > 0) & (neg > 0)
    above = F.col("fp") - F.col("neg") + F.col("neg") / 2
    misordered = F.sum(F.col("pos") * above)
    precision = F.sum(F.col("pos") * _ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")))
    return points.groupBy(*keys).agg(
        F.when(both, 1 - _ratio(misordered, pos * neg)).alias("auroc"),
        F.when(both, _ratio(precision, pos)).alias("auprc"),
    )


def bin_left(p: Column, bins: int = BINS) -> Column:
    """Left-closed bins [i/n, (i+1)/n), the last one closed; edges are the doubles i/n."""
    guess = F.least(F.greatest(F.floor(p * bins), F.lit(0)), F.lit(bins - 1))
    down = F.when((guess > 0) & (p < guess / F.lit(float(bins))), guess - 1).otherwise(guess)
    return F.when((down < bins - 1) & (p >= (down + 1) / F.lit(float(bins))), down + 1).otherwise(down).cast("bigint")


def bin_right(p: Column, bins: int = BINS) -> Column:
    """Right-closed bins (i/n, (i+1)/n], 0 in the first one; edges are the doubles i/n."""
    guess = F.least(F.greatest(F.ceil(p * bins) - 1, F.lit(0)), F.lit(bins - 1))
    down = F.when((guess > 0) & (p <= guess / F.lit(float(bins))), guess - 1).otherwise(guess)
    return F.when((down < bins - 1) & (p > (down + 1) / F.lit(float(bins))), down + 1).otherwise(down).cast("bigint")


BIN_RULES = {"left": bin_left, "right": bin_right}


def _bin_sums(counts: DataFrame, keys: Sequence[str], closed: str, bins: int) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    return counts.groupBy(*keys, BIN_RULES[closed](F.col("score"), bins).alias("bin")).agg(
        F.sum(n).alias("row_count"), F.sum(n * F.col("score")).alias("_p"), F.sum("pos").alias("_y")
    )


def calibration_error(counts: DataFrame, keys: Sequence[str], closed: str = "right", bins: int = BINS) -> DataFrame:
    """Expected calibration error; empty bins add nothing."""
    gap = F.abs(F.col("_y") - F.col("_p"))
    return (
        _bin_sums(counts, keys, closed, bins)
        .groupBy(*keys)
        .agg((F.sum(gap) / F.sum("row_count")).alias("ece"))
    )


def reliability_bins(counts: DataFrame, keys: Sequence[str], closed: str = "right", bins: int = BINS) -> DataFrame:
    """All bins per key, with null means where a bin is empty."""
    filled = _bin_sums(counts, keys, closed, bins).withColumn(
        "_cell", F.struct("row_count", "_p", "_y")
    )
    # At most `bins` cells per key: gathered in a map and spread again, so no bin is missing.
    cells = filled.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "_cell"))).alias("_cells")
    )
    spread = cells.select(
        *keys, "_cells", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
    ).withColumn("_cell", F.try_element_at("_cells", F.col("bin")))
    n = F.coalesce(F.col("_cell.row_count"), F.lit(0))
    return spread.select(
        *keys,
        "bin",
        (F.col("bin") / bins).alias("bin_left"),
        ((F.col("bin") + 1) / bins).alias("bin_right"),
        n.alias("row_count"),
        _ratio(F.col("_cell._p"), n).alias("avg_pred"),
        _ratio(F.col("_cell._y"), n).alias("empirical_rate"),
    )


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    n = tp + fp + fn + tn
    recall, specificity = _ratio_or_zero(tp, tp + fn), _ratio_or_zero(tn, tn + fp)
    return {
        "accuracy": _ratio(tp + tn, n),
        "balanced_accuracy": F.when(tp + fn == 0, specificity)
        .when(tn + fp == 0, recall)
        .otherwise((recall + specificity) / 2),
        "precision": _ratio_or_zero(tp, tp + fp),
        "recall": recall,
        "f1": _ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "positive_rate": _ratio(tp + fn, n),
    }


def threshold_metrics(counts: DataFrame, keys: Sequence[str], threshold: Column | float = 0.5) -> DataFrame:
    """Confusion counts and rates at a threshold; 0 where a rate is 0/0."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = F.col("score") >= t
    cells = counts.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumn("row_count", tp + fp + fn + tn).withColumns(_rates(tp, fp, fn, tn))


def loss_metrics(counts: DataFrame, keys: Sequence[str], clip: float = 1e-15) -> DataFrame:
    """Brier score and clipped log loss."""
    p = F.col("score")
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    n = F.sum(F.col("pos") + F.col("neg"))
    return counts.groupBy(*keys).agg(
        (F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / n).alias("brier"),
        (F.sum(-(F.col("pos") * F.log(q) + F.col("neg") * F.log(1 - q))) / n).alias("log_loss"),
    )


def grouped_metrics(
    df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "p_pred", closed: str = "right"
) -> DataFrame:
    """Every headline metric per key: one pass over the rows, then work on the (key, score) table only."""
    counts = score_counts(df, keys, label, score)
    out = threshold_metrics(counts, keys)
    for other in (
        loss_metrics(counts, keys),
        calibration_error(counts, keys, closed),
        area_metrics(curve(counts, keys), keys),
    ):
        out = null_safe_join(out, other, keys)
    return out


def best_f1(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold with the highest F1 among 0, 0.5, 1 and all scores; the lowest threshold wins ties."""
    totals = counts.groupBy(*keys).agg(
        F.sum("pos").alias("_P"),
        *[F.sum(F.when(F.col("score") >= t, F.col(c)).otherwise(0)).alias(f"_{c}{i}")
          for i, t in enumerate((0.0, 0.5, 1.0)) for c in ("pos", "neg")],
    )
    fixed = totals.select(
        *keys,
        "_P",
        F.explode(
            F.array(*[
                F.struct(F.lit(t).alias("score"), F.col(f"_pos{i}").alias("tp"), F.col(f"_neg{i}").alias("fp"))
                for i, t in enumerate((0.0, 0.5, 1.0))
            ])
        ).alias("c"),
    ).select(*keys, "_P", "c.*")
    scored = null_safe_join(
        curve(counts, keys).select(*keys, "score", "tp", "fp"), totals.select(*keys, "_P"), keys
    )
    f1 = _ratio_or_zero(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("_P"))
    return (
        scored.unionByName(fixed)
        .withColumn("f1", f1)
        .groupBy(*keys)
        .agg(F.max(F.struct(F.col("f1"), (-F.col("score")).alias("_low"))).alias("b"))
        .select(*keys, (-F.col("b._low")).alias("threshold"), F.col("b.f1").alias("f1"))
    )


def selective(
    df: DataFrame,
    keys: Sequence[str],
    coverages: Sequence[float] = COVERAGES,
    rounding: str = "ceil",
    label: str = "label",
    score: str = "p_pred",
    tie: str = "prompt_id",
) -> DataFrame:
    """Accuracy on the most confident share of rows.

    ``ceil``: confidence is the distance from 0.5 and positive precision looks at rows predicted positive.
    ``half_even``: confidence is max(p, 1-p) and "positive precision" is the mean label of all selected rows.
    """
    p, y = F.col(score), F.col(label)
    confidence = F.abs(p - 0.5) if rounding == "ceil" else F.greatest(p, 1 - p)
    rows = df.select(
        *keys,
        tie,
        confidence.alias("_c"),
        F.when((p >= 0.5) == (y == 1), 1).otherwise(0).alias("_ok"),
        F.when(p >= 0.5, 1).otherwise(0).alias("_hit"),
        y.alias("_y"),
    )
    ranked = ordered_totals(rows, keys, [F.col("_c").desc(), F.col(tie).asc()], {"_position": F.lit(1).cast("bigint")})
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("_n"))
    wanted = [
        F.greatest(
            F.lit(1), (F.ceil(F.col("_n") * c) if rounding == "ceil" else F.bround(F.col("_n") * c)).cast("bigint")
        )
        for c in coverages
    ]
    sizes = sizes.withColumn("_k", F.array(*wanted))
    # Each row falls in the first coverage that takes it; sums per coverage are then accumulated over the few steps.
    stepped = null_safe_join(ranked, sizes, keys).withColumn(
        "_step", F.size(F.filter("_k", lambda k: k < F.col("_position")))
    )
    sums = stepped.filter(F.col("_step") < len(coverages)).groupBy(*keys, "_step").agg(
        F.count("*").alias("_rows"),
        F.sum("_ok").alias("_ok"),
        F.sum("_hit").alias("_hit"),
        F.sum(F.col("_hit") * F.col("_y")).alias("_hit_y"),
        F.sum("_y").alias("_y"),
        F.sum("_c").alias("_c"),
    )
    gathered = sums.groupBy(*keys).agg(F.collect_list(F.struct("_step", "_rows", "_ok", "_hit", "_hit_y", "_y", "_c")).alias("_steps"))
    spread_out = gathered.select(
        *keys, "_steps", F.posexplode(F.array(*map(F.lit, coverages))).alias("_at", "coverage")
    )

    def upto(field: str) -> Column:
        zero = F.lit(0.0) if field == "_c" else F.lit(0).cast("bigint")
        return F.aggregate(
            F.filter("_steps", lambda s: s["_step"] <= F.col("_at")), zero, lambda a, s: a + s[field]
        )

    n = upto("_rows")
    precision = _ratio(upto("_hit_y"), upto("_hit")) if rounding == "ceil" else _ratio(upto("_y"), n)
    return spread_out.select(
        *keys,
        "coverage",
        n.alias("selected_rows"),
        _ratio(upto("_ok"), n).alias("selective_accuracy"),
        (1 - _ratio(upto("_ok"), n)).alias("selective_risk"),
        precision.alias("selected_positive_precision"),
        (upto("_c") / n).alias("mean_confidence"),
    )


def precision_at_k(
    df: DataFrame, keys: Sequence[str], ks: Sequence[int] = TOP_K, label: str = "label", score: str = "p_pred"
) -> DataFrame:
    """Precision, recall and mean score of the k highest-scored rows; a shorter list counts all its rows."""
    ranked = score_rank(df.select(*keys, "prompt_id", score, label), keys, score)
    totals = df.groupBy(*keys).agg(F.sum(label).alias("_positives"))
    top = ranked.filter(F.col("position") <= max(ks))
    per_k = top.select(
        *keys, label, score, "position", F.explode(F.array(*map(F.lit, ks))).alias("k")
    ).filter(F.col("position") <= F.col("k"))
    sums = per_k.groupBy(*keys, "k").agg(
        F.count("*").alias("selected_rows"),
        F.sum(label).alias("positive_count_at_k"),
        F.avg(score).alias("mean_score_at_k"),
    )
    return null_safe_join(sums, totals, keys).select(
        *keys,
        F.col("k").cast("bigint").alias("k"),
        "selected_rows",
        _ratio(F.col("positive_count_at_k"), F.col("selected_rows")).alias("precision_at_k"),
        _ratio(F.col("positive_count_at_k"), F.col("_positives")).alias("recall_at_k"),
        "positive_count_at_k",
        "mean_score_at_k",
    )


# Cumulative probabilities of a Poisson variable with mean 1, up to the last one below 1 in doubles.
POISSON_ONE = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217,
    0.9999999899522336, 0.9999999991683892, 0.9999999999363918,
)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit numbers spread over all places."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def poisson_weights(groups: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) weights, one row a group (given by its 64-bit hash), one column a replicate: the same on any executor."""
    step = np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    share = (_mixed(groups.astype(np.int64).view(np.uint64)[:, None] + step) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON_ONE, share, side="left")


def _score_blocks(pdf: pd.DataFrame, reps: int, rows: int):
    """(scores, weighted positives, weighted negatives) of whole scores from the highest down, a bounded block at a time."""
    pdf = pdf.sort_values("score", ascending=False, kind="stable")
    score, h = pdf["score"].to_numpy(), pdf["_h"].to_numpy()
    pos, neg = (pdf[c].to_numpy(dtype=np.float64) for c in ("pos", "neg"))
    held = None
    for a in range(0, len(score), rows):
        z = min(a + rows, len(score))
        w = poisson_weights(h[a:z], reps)
        first = np.flatnonzero(np.r_[True, score[a + 1 : z] != score[a : z - 1]])
        block = [score[a:z][first], *(np.add.reduceat(w * side[a:z, None], first, axis=0) for side in (pos, neg))]
        if held is not None:
            if held[0][0] == block[0][0]:
                block[1][0] += held[1][0]
                block[2][0] += held[2][0]
            else:
                yield held
        if len(first) > 1:
            yield [x[:-1] for x in block]
        held = [x[-1:] for x in block]
    if held is not None:
        yield held


def _pieces(pdf: pd.DataFrame, reps: int, rows: int):
    """A part's first score, the scores between, and its last one, each as (score, positives, negatives)."""
    first, between, last = None, None, None
    for block in _score_blocks(pdf, reps, rows):
        if first is None:
            first, block = [x[0] for x in block], [x[1:] for x in block]
        if len(block[0]):
            pos, neg = block[1][:-1].sum(0), block[2][:-1].sum(0)
            if last is not None:
                pos, neg = pos + last[1], neg + last[2]
            if last is not None or len(block[0]) > 1:
                between = [np.nan, pos, neg] if between is None else [np.nan, between[1] + pos, between[2] + neg]
            last = [x[-1] for x in block]
    return first, between, last


class _Areas:
    """Sums behind AUROC and average precision of all replicates, score by score from the highest down."""

    def __init__(self, tp: np.ndarray, fp: np.ndarray):
        self.tp, self.fp, self.misordered, self.precision = tp.copy(), fp.copy(), np.zeros(len(tp)), np.zeros(len(tp))

    def add(self, pos: np.ndarray, neg: np.ndarray) -> None:
        tp, fp = self.tp + np.cumsum(pos, axis=0), self.fp + np.cumsum(neg, axis=0)
        self.misordered += (pos * (fp - neg / 2)).sum(0)
        self.precision += (pos * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)).sum(0)
        self.tp, self.fp = tp[-1], fp[-1]


_SUMS = "_key string, misordered array<double>, precision array<double>, pos array<double>, neg array<double>"


def bootstrap_replicates(
    df: DataFrame,
    keys: Sequence[str],
    group: str = "base_key",
    reps: int = 300,
    seed: int = 42,
    label: str = "label",
    score: str = "p_pred",
) -> DataFrame:
    """Arrays of AUROC and average precision over the replicates of a group bootstrap, per key.

    Rows are counted per (key, score, group) and dealt out by score. A part sums its first score, its last one and those
    between, each as one array over all replicates; folding these in order gives what lies above each part and the areas
    at scores that reach over an edge. With that carried in, each part adds the areas of its inner scores. No row is
    copied for a replicate and no score has to fit in one task.
    """
    rows = BLOCK_ROWS
    base = df.filter(F.col(score).isNotNull()).select(
        F.to_json(F.struct(*keys)).alias("_key") if keys else F.lit("{}").alias("_key"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col(group).cast("string"), F.lit("__missing__"))).alias("_h"),
        F.col(score).cast("double").alias("score"),
        F.col(label).alias("_y"),
    )
    counts = base.groupBy("_key", "score", "_h").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    placed = ranged(counts, ["_key"], [F.col("score").desc(), F.col("_h").asc()])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for slot, piece in enumerate(_pieces(pdf, reps, rows)):
            if piece is not None:
                out.append((pdf["_key"].iloc[0], pdf["_part"].iloc[0], slot, float(piece[0]), piece[1], piece[2]))
        return pd.DataFrame(out, columns=["_key", "_part", "slot", "score", "pos", "neg"])

    pieces = checkpointed(placed.groupBy("_key", "_part").applyInPandas(summed, "_key string, _part int, slot int, score double, pos array<double>, neg array<double>"))

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        """What lies above the inner scores of each part; the last row holds the areas of all other scores, and the totals."""
        pieces = pdf.sort_values(["_part", "slot"]).to_dict("records")
        areas, held, out = _Areas(np.zeros(reps), np.zeros(reps)), None, []
        key = pieces[0]["_key"]
        for r in pieces:
            pos, neg = np.asarray(r["pos"]), np.asarray(r["neg"])
            if held is not None and (r["slot"] == 1 or r["score"] != held[0]):
                areas.add(held[1][None], held[2][None])
                held = None
            if r["slot"] == 1:
                out.append((key, r["_part"], areas.tp, areas.fp, None, None))
                areas.tp, areas.fp = areas.tp + pos, areas.fp + neg
            else:
                held = (r["score"], pos, neg) if held is None else (held[0], held[1] + pos, held[2] + neg)
        if held is not None:
            areas.add(held[1][None], held[2][None])
        out.append((key, None, areas.tp, areas.fp, areas.misordered, areas.precision))
        return pd.DataFrame(out, columns=["_key", "_part", "pos", "neg", "misordered", "precision"]).astype({"_part": "Int64"})

    folded = checkpointed(pieces.groupBy("_key").applyInPandas(carried, "_key string, _part int, pos array<double>, neg array<double>, misordered array<double>, precision array<double>"))

    def inner(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(above):
            return pd.DataFrame([], columns=["_key", "misordered", "precision", "pos", "neg"])
        areas, edges = _Areas(np.asarray(above["pos"].iloc[0]), np.asarray(above["neg"].iloc[0])), (pdf["score"].max(), pdf["score"].min())
        for scores, pos, neg in _score_blocks(pdf, reps, rows):
            mine = (scores != edges[0]) & (scores != edges[1])
            if mine.any():
                areas.add(pos[mine], neg[mine])
        none = np.zeros(reps)
        return pd.DataFrame([(pdf["_key"].iloc[0], areas.misordered, areas.precision, none, none)], columns=["_key", "misordered", "precision", "pos", "neg"])

    above = folded.filter("_part IS NOT NULL")
    parts = placed.groupBy("_key", "_part").cogroup(above.groupBy("_key", "_part")).applyInPandas(inner, _SUMS)
    edges = folded.filter("_part IS NULL").select("_key", "misordered", "precision", "pos", "neg")

    def areas(pdf: pd.DataFrame) -> pd.DataFrame:
        misordered, precision, pos, neg = (np.sum(np.stack(pdf[c].to_list()), axis=0) for c in ("misordered", "precision", "pos", "neg"))
        both = (pos > 0) & (neg > 0)
        row = (pdf["_key"].iloc[0], 1 - misordered[both] / (pos * neg)[both], precision[both] / pos[both])
        return pd.DataFrame([row], columns=["_key", "auroc", "auprc"])

    done = edges.unionByName(parts).groupBy("_key").applyInPandas(areas, "_key string, auroc array<double>, auprc array<double>")
    if not keys:
        return done.drop("_key")
    return done.select(F.from_json("_key", df.select(*keys).schema).alias("_of"), "auroc", "auprc").select("_of.*", "auroc", "auprc")


def _quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array."""

    def of(v: Column) -> Column:
        at = (F.size(v) - 1) * F.lit(q)
        low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return bound_once(F.array_sort(values), of)


def bootstrap_ci(
    df: DataFrame,
    keys: Sequence[str],
    group: str = "base_key",
    reps: int = 300,
    seed: int = 42,
    label: str = "label",
    score: str = "p_pred",
) -> DataFrame:
    """Group bootstrap intervals of AUROC and average precision.

    Deviation: groups get Poisson(1) weights instead of multinomial draws, so every row is weighted where it is.
    Replicates without both classes are left out.
    """
    bounds = bootstrap_replicates(df, keys, group, reps, seed, label, score).select(
        *keys,
        F.lit(reps).alias("reps_requested"),
        F.size("auroc").cast("bigint").alias("reps_used"),
        *[_quantile(F.col(c), q).alias(f"{c}_ci_{end}") for c in ("auroc", "auprc") for end, q in (("low", 0.025), ("high", 0.975))],
    )
    point = area_metrics(curve(score_counts(df, keys, label, score), keys), keys)
    return null_safe_join(point, bounds, keys, "left")


def spearman(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rank correlation of model scores on a wide table; equal scores share their average rank.

    Ranks come from the distinct scores of each model, not from sorting all rows together.
    """
    long = df.select(
        "prompt_id", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("s")) for m in models])).alias("v")
    ).select("prompt_id", "v.*")
    counts = long.groupBy("m", "s").agg(F.count("*").alias("n"))
    upto = ordered_totals(counts, ["m"], [F.col("s").asc()], {"below": F.col("n")})
    ranks = upto.select("m", "s", (F.col("below") - (F.col("n") - 1) / 2).alias("r"))
    wide = long.join(ranks, ["m", "s"]).groupBy("prompt_id").pivot("m", list(models)).agg(F.first("r"))
    pairs = [(a, b) for a in models for b in models]
    row = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}|{b}`").alias("spearman"))
                for a, b in pairs
            ])
        ).alias("x")
    ).select("x.*")


def outcome_class(label: Column, prediction: Column) -> Column:
    return (
        F.when((prediction == 1) & (label == 1), "TP")
        .when((prediction == 1) & (label == 0), "FP")
        .when((prediction == 0) & (label == 1), "FN")
        .otherwise("TN")
    )


def seed_average(df: DataFrame, keys: Sequence[str], score: str = "p_pred") -> DataFrame:
    """Mean (and sample deviation) of the score over the runs of a prompt."""
    return df.groupBy(*keys).agg(
        F.avg(score).alias("p_mean"), F.stddev_samp(score).alias("p_std"), F.count("*").alias("run_count")
    )


def score_histogram(df: DataFrame, keys: Sequence[str], score: str, bins: int) -> DataFrame:
    """Score histogram per key with equal-width bins over [0, 1]."""
    return df.groupBy(*keys, bin_left(F.col(score), bins).alias("bin")).agg(F.count("*").alias("row_count"))
