"""Prediction metric queries (one grouped job each) over the derived prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulespan.operators import metrics as m
from rulespan.operators.ranking import null_safe_join
from rulespan.plans.catalog import query
from rulespan.plans.testbed import FAMILIES, Testbed, with_tables

RUN = ["run_id", "split"]
R = ", ".join(RUN)


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    """Metrics are compared after rounding: sums of doubles depend on their order."""
    # A Brier score is a short decimal fraction that can sit exactly between two rounded values: nudge it up.
    return df.withColumns(
        {c: F.round(F.col(c) + 1e-12 if c == "brier" else F.col(c), places) for c in columns}
    )


def preds_sql(body: str) -> str:
    return with_tables("predictions", body=body)


def scored_sql(keys: str, body: str, source: str = "predictions") -> str:
    """Oracle head: counts per (keys, score) with running totals from the highest score down."""
    return preds_sql(f"""
counts AS (SELECT {keys}, p_pred AS score, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY ALL),
points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER k AS P, sum(neg) OVER k AS N
           FROM counts WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC), k AS (PARTITION BY {keys}))
{body}""")


AUROC = "CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum(pos * (N - fp + neg / 2.0::DOUBLE))::DOUBLE / (max(P) * max(N))::DOUBLE, 9) END"
AUPRC = "CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum(pos::DOUBLE * tp / (tp + fp)) / max(P), 9) END"

CONFUSION = """CAST(count_if(p_pred >= 0.5 AND label = 1) AS BIGINT) AS tp, CAST(count_if(p_pred >= 0.5 AND label = 0) AS BIGINT) AS fp,
 CAST(count_if(p_pred < 0.5 AND label = 1) AS BIGINT) AS fn, CAST(count_if(p_pred < 0.5 AND label = 0) AS BIGINT) AS tn, count(*) AS row_count"""
RATES = """round((tp + tn)::DOUBLE / row_count, 9) AS accuracy,
 round(CASE WHEN tp + fn = 0 THEN tn::DOUBLE / (tn + fp) WHEN tn + fp = 0 THEN tp::DOUBLE / (tp + fn)
       ELSE (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END, 9) AS balanced_accuracy,
 round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 9) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS recall,
 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1,
 round((tp + fn)::DOUBLE / row_count, 9) AS positive_rate"""
RATE_NAMES = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "positive_rate")
CLIPPED = "least(greatest(p_pred, 1e-15::DOUBLE), 1::DOUBLE - 1e-15::DOUBLE)"
BRIER = "round(avg((p_pred - label) * (p_pred - label)) + 1e-12::DOUBLE, 9)"
LOGLOSS = f"round(avg(-(label * ln({CLIPPED}) + (1 - label) * ln(1 - {CLIPPED}))), 9)"


def edge_list(n: int) -> str:
    return "[" + ", ".join(f"{i / n!r}::DOUBLE" for i in range(1, n)) + "]"


def bin_sql(closed: str, n: int = 10, p: str = "p_pred") -> str:
    op = "<=" if closed == "left" else "<"
    return f"CAST(len(list_filter({edge_list(n)}, lambda e: e {op} {p})) AS BIGINT)"


def ece_sql(closed: str, keys: str = R) -> str:
    return (
        f"SELECT {keys}, round(sum(abs(y - p)) / sum(n), 9) AS ece FROM (SELECT {keys}, {bin_sql(closed)} AS bin, "
        f"count(*) AS n, sum(label) AS y, sum(p_pred) AS p FROM predictions GROUP BY ALL) GROUP BY ALL"
    )


@query("threshold_metrics", preds_sql(f"SELECT {R}, tp, fp, fn, tn, row_count, {RATES} FROM (SELECT {R}, {CONFUSION} FROM predictions GROUP BY ALL)"))
def threshold_metrics(t: Testbed):
    return rounded(m.threshold_metrics(m.score_counts(t.predictions(), RUN), RUN), *RATE_NAMES)


@query("auroc", scored_sql(R, f"SELECT {R}, {AUROC} AS auroc FROM points GROUP BY ALL"))
def auroc(t: Testbed):
    points = m.curve(m.score_counts(t.predictions(), RUN), RUN)
    return rounded(m.area_metrics(points, RUN).select(*RUN, "auroc"), "auroc")


@query("auprc", scored_sql(R, f"SELECT {R}, {AUPRC} AS auprc FROM points GROUP BY ALL"))
def auprc(t: Testbed):
    points = m.curve(m.score_counts(t.predictions(), RUN), RUN)
    return rounded(m.area_metrics(points, RUN).select(*RUN, "auprc"), "auprc")


LINE_SQL = """WITH counts AS (SELECT l_linestatus, 1 - l_discount * 5 AS score, count_if(l_returnflag = 'R') AS pos,
  count_if(l_returnflag <> 'R') AS neg FROM lineitem GROUP BY ALL),
points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER k AS P, sum(neg) OVER k AS N
  FROM counts WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC), k AS (PARTITION BY l_linestatus))"""


@query("auroc_tied_scores", f"{LINE_SQL} SELECT l_linestatus, {AUROC} AS auroc, {AUPRC} AS auprc FROM points GROUP BY ALL")
def auroc_tied_scores(t: Testbed):
    rows = t.table("lineitem").select(
        "l_linestatus",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (1 - F.col("l_discount") * 5).alias("p_pred"),
    )
    keys = ["l_linestatus"]
    return rounded(m.area_metrics(m.curve(m.score_counts(rows, keys), keys), keys), "auroc", "auprc")


@query("brier_logloss", preds_sql(f"SELECT {R}, {BRIER} AS brier, {LOGLOSS} AS log_loss FROM predictions GROUP BY ALL"))
def brier_logloss(t: Testbed):
    return rounded(m.loss_metrics(m.score_counts(t.predictions(), RUN), RUN), "brier", "log_loss")


@query("ece_left", preds_sql(ece_sql("left")))
def ece_left(t: Testbed):
    return rounded(m.calibration_error(m.score_counts(t.predictions(), RUN), RUN, "left"), "ece")


@query("ece_right", preds_sql(ece_sql("right")))
def ece_right(t: Testbed):
    return rounded(m.calibration_error(m.score_counts(t.predictions(), RUN), RUN, "right"), "ece")


def bins_sql(closed: str, n: int = 10) -> str:
    return f"""
filled AS (SELECT {R}, {bin_sql(closed, n)} AS bin, count(*) AS n, avg(p_pred) AS p, avg(label) AS y FROM predictions GROUP BY ALL),
runs AS (SELECT DISTINCT {R} FROM predictions)
SELECT r.run_id, r.split, b.bin, b.bin::DOUBLE / {n} AS bin_left, (b.bin + 1)::DOUBLE / {n} AS bin_right,
       coalesce(n, 0) AS row_count, round(p, 9) AS avg_pred, round(y, 9) AS empirical_rate
FROM runs r CROSS JOIN (SELECT unnest(range(0, {n})) AS bin) b
LEFT JOIN filled f ON f.run_id = r.run_id AND f.split = r.split AND f.bin = b.bin"""


@query("reliability_bins", preds_sql(bins_sql("right")))
def reliability_bins(t: Testbed):
    return rounded(m.reliability_bins(m.score_counts(t.predictions(), RUN), RUN, "right"), "avg_pred", "empirical_rate")


@query("reliability_bins_left", preds_sql(bins_sql("left", 15)))
def reliability_bins_left(t: Testbed):
    return rounded(
        m.reliability_bins(m.score_counts(t.predictions(), RUN), RUN, "left", 15), "avg_pred", "empirical_rate"
    )


@query("calibration_avg", preds_sql(f"""
filled AS (SELECT model_family, train_size_label, seed, split, {bin_sql('right')} AS bin, count(*) AS n, avg(p_pred) AS p, avg(label) AS y
           FROM predictions GROUP BY ALL)
SELECT model_family, train_size_label, split, bin, CAST(sum(n) AS BIGINT) AS row_count, round(avg(p), 9) AS avg_pred,
       round(avg(y), 9) AS empirical_rate, count(*) AS seed_count FROM filled GROUP BY ALL"""))
def calibration_avg(t: Testbed):
    keys = ["model_family", "train_size_label", "seed", "split"]
    bins = m.reliability_bins(m.score_counts(t.predictions(), keys), keys, "right").filter(F.col("row_count") > 0)
    return rounded(
        bins.groupBy("model_family", "train_size_label", "split", "bin").agg(
            F.sum("row_count").alias("row_count"),
            F.avg("avg_pred").alias("avg_pred"),
            F.avg("empirical_rate").alias("empirical_rate"),
            F.count("*").alias("seed_count"),
        ),
        "avg_pred",
        "empirical_rate",
    )


@query("pr_points", scored_sql(R, f"SELECT {R}, score, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / P, 9) AS recall FROM points"))
def pr_points(t: Testbed):
    counts = m.score_counts(t.predictions(), RUN)
    totals = counts.groupBy(*RUN).agg(F.sum("pos").alias("P"))
    points = null_safe_join(m.curve(counts, RUN), totals, RUN)
    return rounded(
        points.select(
            *RUN, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
            F.try_divide("tp", "P").alias("recall"),
        ),
        "precision", "recall",
    )


@query("roc_points", scored_sql(R, f"SELECT {R}, score, round(fp::DOUBLE / N, 9) AS fpr, round(tp::DOUBLE / P, 9) AS tpr FROM points"))
def roc_points(t: Testbed):
    counts = m.score_counts(t.predictions(), RUN)
    totals = counts.groupBy(*RUN).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    points = null_safe_join(m.curve(counts, RUN), totals, RUN)
    return rounded(
        points.select(*RUN, "score", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr")),
        "fpr", "tpr",
    )


FACET_METRICS = ("brier", "log_loss", "ece", "auroc", "auprc")


def metrics_sql(keys: str, joined: str, source: str = "predictions", closed: str = "right") -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in joined.split(", "))
    on_c, on_d = on.replace("b.", "c."), on.replace("b.", "d.")
    listed = ", ".join(f"a.{k}" for k in joined.split(", "))
    return scored_sql(keys, f""",
conf AS (SELECT {keys}, {CONFUSION}, {BRIER} AS brier, {LOGLOSS} AS log_loss FROM {source} GROUP BY ALL),
bins AS (SELECT {keys}, {bin_sql(closed)} AS bin, count(*) AS n, sum(label) AS y, sum(p_pred) AS p FROM {source} GROUP BY ALL),
ece AS (SELECT {keys}, round(sum(abs(y - p)) / sum(n), 9) AS ece FROM bins GROUP BY ALL),
area AS (SELECT {keys}, {AUROC} AS auroc, {AUPRC} AS auprc FROM points GROUP BY ALL)
SELECT {listed}, tp, fp, fn, tn, row_count, {RATES}, brier, log_loss, ece, auroc, auprc
FROM conf a JOIN ece c ON {on_c} JOIN area d ON {on_d}""".replace("\n,\nconf", ",\nconf"), source).replace(")\n,\nconf", "),\nconf")


@query("run_metrics", metrics_sql(R, R))
def run_metrics(t: Testbed):
    return rounded(m.grouped_metrics(t.predictions(), RUN), *RATE_NAMES, *FACET_METRICS)


@query("per_cluster", metrics_sql("model_family, cluster", "model_family, cluster").replace(
    "SELECT a.model_family, a.cluster,", "SELECT a.model_family, a.cluster, round(1 - (tp + tn)::DOUBLE / row_count, 9) AS error_rate,"))
def per_cluster(t: Testbed):
    out = m.grouped_metrics(t.predictions(), ["model_family", "cluster"])
    return rounded(out.withColumn("error_rate", 1 - F.col("accuracy")), *RATE_NAMES, *FACET_METRICS, "error_rate")


# Facet name -> level, in SQL both engines read.
FACETS = {
    "num_constraints": "num_constraints || ''",
    "family_signature": "constraint_family_signature",
    "top_family": "split_part(constraint_family_signature, '|', 1)",
    "length_bin": "length_bin",
    "source_dataset": "source_dataset",
    "constraint_type": "constraint_type",
}


@query("facet_metrics", metrics_sql("facet, level", "facet, level", "faceted").replace(
    "counts AS (", "faceted AS (" + " UNION ALL ".join(
        f"SELECT '{name}' AS facet, {sql} AS level, label, p_pred FROM predictions WHERE model_family = 'tfidf'"
        for name, sql in FACETS.items()) + "),\ncounts AS (", 1))
def facet_metrics(t: Testbed):
    # One pass: each row is fanned out to its six facet levels (a fixed number), never scanned six times.
    rows = t.predictions().filter(F.col("model_family") == "tfidf")
    fan = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.expr(c).alias("level")) for n, c in FACETS.items()]))
    faceted = rows.select("label", "p_pred", fan.alias("f")).select("label", "p_pred", "f.*")
    return rounded(m.grouped_metrics(faceted, ["facet", "level"]), *RATE_NAMES, *FACET_METRICS)


BEST_F1 = f"""cand AS (SELECT {R}, score AS threshold, CASE WHEN tp + fp + P = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (tp + fp + P)::DOUBLE END AS f1 FROM points
 UNION ALL SELECT {R}, x.t, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn)::DOUBLE END FROM
 (SELECT {R}, x.t, count_if(p_pred >= x.t AND label = 1) AS tp, count_if(p_pred >= x.t AND label = 0) AS fp, count_if(p_pred < x.t AND label = 1) AS fn
  FROM predictions, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) x(t) GROUP BY ALL) x),
best AS (SELECT {R}, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY {R} ORDER BY f1 DESC, threshold) AS rn FROM cand) WHERE rn = 1)"""


@query("best_f1", scored_sql(R, f", {BEST_F1} SELECT {R}, threshold, round(f1, 9) AS f1 FROM best").replace(")\n, cand", "),\ncand"))
def best_f1(t: Testbed):
    return rounded(m.best_f1(m.score_counts(t.predictions(), RUN), RUN), "f1")


@query("threshold_transfer", scored_sql(R, f", {BEST_F1}" + """,
moved AS (SELECT p.run_id, v.threshold, v.f1 AS val_f1, count_if(p_pred >= v.threshold AND label = 1) AS tp,
  count_if(p_pred >= v.threshold AND label = 0) AS fp, count_if(p_pred < v.threshold AND label = 1) AS fn
  FROM predictions p JOIN best v ON v.run_id = p.run_id AND v.split = 'val' WHERE p.split = 'test' GROUP BY ALL)
SELECT run_id, threshold, round(val_f1, 9) AS val_f1,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS test_f1,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 9) AS test_precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS test_recall FROM moved""").replace(")\n, cand", "),\ncand"))
def threshold_transfer(t: Testbed):
    counts = m.score_counts(t.predictions(), RUN)
    chosen = m.best_f1(counts.filter(F.col("split") == "val"), RUN).select(
        "run_id", "threshold", F.col("f1").alias("val_f1")
    )
    test = counts.filter(F.col("split") == "test").join(chosen, "run_id")
    moved = m.threshold_metrics(test, ["run_id", "threshold", "val_f1"], F.col("threshold"))
    return rounded(
        moved.select(
            "run_id", "threshold", "val_f1", F.col("f1").alias("test_f1"), F.col("precision").alias("test_precision"),
            F.col("recall").alias("test_recall"),
        ),
        "val_f1", "test_f1", "test_precision", "test_recall",
    )


def selective_sql(coverages, rounding: str) -> str:
    conf = "abs(p_pred - 0.5::DOUBLE)" if rounding == "ceil" else "greatest(p_pred, 1 - p_pred)"
    size = "ceil(n * c.coverage)" if rounding == "ceil" else "round_even(n * c.coverage, 0)"
    precision = (
        "round(sum(hit * label)::DOUBLE / nullif(sum(hit), 0), 9)" if rounding == "ceil" else "round(avg(label), 9)"
    )
    values = ", ".join(f"({c!r}::DOUBLE)" for c in coverages)
    return preds_sql(f"""
ranked AS (SELECT run_id, split, label, {conf} AS conf, CASE WHEN (p_pred >= 0.5) = (label = 1) THEN 1 ELSE 0 END AS ok,
   CASE WHEN p_pred >= 0.5 THEN 1 ELSE 0 END AS hit, count(*) OVER (PARTITION BY {R}) AS n,
   row_number() OVER (PARTITION BY {R} ORDER BY {conf} DESC, prompt_id) AS rn FROM predictions)
SELECT {R}, c.coverage, count(*) AS selected_rows, round(avg(ok), 9) AS selective_accuracy, round(1 - avg(ok), 9) AS selective_risk,
   {precision} AS selected_positive_precision, round(avg(conf), 9) AS mean_confidence
FROM ranked, (VALUES {values}) c(coverage) WHERE rn <= greatest(1, {size}) GROUP BY ALL""")


SELECTIVE = ("selective_accuracy", "selective_risk", "selected_positive_precision", "mean_confidence")


@query("selective_ceil", selective_sql(m.COVERAGES, "ceil"))
def selective_ceil(t: Testbed):
    return rounded(m.selective(t.predictions(), RUN, rounding="ceil"), *SELECTIVE)


@query("selective_round", selective_sql(m.COVERAGES, "half_even"))
def selective_round(t: Testbed):
    return rounded(m.selective(t.predictions(), RUN, rounding="half_even"), *SELECTIVE)


@query("coverage_risk", selective_sql(m.CURVE_COVERAGES, "ceil"))
def coverage_risk(t: Testbed):
    return rounded(m.selective(t.predictions(), RUN, m.CURVE_COVERAGES, "ceil"), *SELECTIVE)


@query("precision_at_k", preds_sql(f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {R} ORDER BY p_pred DESC, prompt_id) AS rn,
   sum(label) OVER (PARTITION BY {R}) AS positives FROM predictions)
SELECT {R}, k, count(*) AS selected_rows, round(sum(label)::DOUBLE / count(*), 9) AS precision_at_k,
   round(sum(label)::DOUBLE / nullif(max(positives), 0), 9) AS recall_at_k, CAST(sum(label) AS BIGINT) AS positive_count_at_k,
   round(avg(p_pred), 9) AS mean_score_at_k
FROM ranked, (VALUES (100::BIGINT), (500), (1000), (2000)) c(k) WHERE rn <= k GROUP BY ALL"""))
def precision_at_k(t: Testbed):
    return rounded(m.precision_at_k(t.predictions(), RUN), "precision_at_k", "recall_at_k", "mean_score_at_k")


PER_ID_SQL = """
averaged AS (SELECT model_family, prompt_id, max(label) AS label, avg(p_pred) AS p_pred, any_value(instruction_ids) AS ids
             FROM predictions WHERE split = 'test' AND train_size_label = 'full' GROUP BY model_family, prompt_id),
exploded AS (SELECT model_family, label, p_pred, unnest(ids) AS instruction_id FROM averaged),
counts AS (SELECT model_family, instruction_id, p_pred AS score, sum(label) AS pos, sum(1 - label) AS neg FROM exploded GROUP BY ALL),
points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER k AS P, sum(neg) OVER k AS N FROM counts
           WINDOW w AS (PARTITION BY model_family, instruction_id ORDER BY score DESC), k AS (PARTITION BY model_family, instruction_id)),
area AS (SELECT model_family, instruction_id, max(P + N) AS n, max(P) AS pp, {auroc} AS auroc, {auprc} AS auprc FROM points GROUP BY ALL)
SELECT instruction_id, CAST(max(n) AS BIGINT) AS test_rows, round(max(pp)::DOUBLE / max(n), 9) AS positive_rate,
  {columns}, arg_max(model_family, (auprc, {order})) FILTER (auprc IS NOT NULL) AS best_model
FROM area GROUP BY ALL""".format(
    auroc=AUROC, auprc=AUPRC,
    columns=", ".join(
        f"max(auroc) FILTER (model_family = '{f}') AS {f}_auroc, max(auprc) FILTER (model_family = '{f}') AS {f}_auprc"
        for f in FAMILIES
    ),
    order="CASE model_family WHEN 'frozen' THEN 3 WHEN 'tfidf' THEN 2 ELSE 1 END",
)


@query("per_constraint", preds_sql(PER_ID_SQL))
def per_constraint(t: Testbed):
    picked = t.predictions().filter((F.col("split") == "test") & (F.col("train_size_label") == "full"))
    averaged = picked.groupBy("model_family", "prompt_id").agg(
        F.max("label").alias("label"), F.avg("p_pred").alias("p_pred"), F.first("instruction_ids").alias("ids")
    )
    rows = averaged.select("model_family", "label", "p_pred", F.explode("ids").alias("instruction_id"))
    keys = ["model_family", "instruction_id"]
    counts = m.score_counts(rows, keys)
    area = rounded(m.area_metrics(m.curve(counts, keys), keys), "auroc", "auprc")
    sizes = counts.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("p"))
    joined = null_safe_join(area, sizes, keys)
    wide = joined.groupBy("instruction_id").agg(
        F.max("n").alias("test_rows"),
        F.round(F.max("p") / F.max("n"), 9).alias("positive_rate"),
        *[
            F.max(F.when(F.col("model_family") == f, F.col(c))).alias(f"{f}_{c}")
            for f in FAMILIES
            for c in ("auroc", "auprc")
        ],
        # The first family in listed order wins ties.
        F.max_by(
            "model_family",
            F.when(F.col("auprc").isNotNull(), F.struct("auprc", -F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("model_family")))),
        ).alias("best_model"),
    )
    return wide


@query("auprc_lift", scored_sql(R, f"SELECT {R}, {AUPRC} AS auprc, round(max(P)::DOUBLE / max(P + N), 9) AS positive_rate, "
       f"round(({AUPRC}) / nullif(round(max(P)::DOUBLE / max(P + N), 9), 0), 9) AS auprc_lift FROM points GROUP BY ALL"))
def auprc_lift(t: Testbed):
    counts = m.score_counts(t.predictions(), RUN)
    rate = counts.groupBy(*RUN).agg((F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("positive_rate"))
    out = rounded(
        null_safe_join(m.area_metrics(m.curve(counts, RUN), RUN).drop("auroc"), rate, RUN), "auprc", "positive_rate"
    )
    return rounded(out.withColumn("auprc_lift", F.try_divide("auprc", "positive_rate")), "auprc_lift")


@query("bootstrap_ci")
def bootstrap_ci(t: Testbed):
    rows = t.predictions().filter((F.col("split") == "test") & F.col("model_family").isin("tiny", "frozen"))
    keys = ["model_family", "train_size_label", "seed"]
    return rounded(
        m.bootstrap_ci(rows, keys), "auroc", "auprc", "auroc_ci_low", "auroc_ci_high", "auprc_ci_low", "auprc_ci_high"
    )


SPEARMAN_SQL = """
wide AS (SELECT prompt_id, {w} FROM predictions WHERE split = 'test' GROUP BY prompt_id),
ranks AS (SELECT {r} FROM wide)
{u}""".format(
    w=", ".join(f"round(avg(p_pred) FILTER (model_family = '{f}'), 6) AS {f}" for f in FAMILIES),
    r=", ".join(
        f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0::DOUBLE AS {f}" for f in FAMILIES
    ),
    u=" UNION ALL ".join(
        f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(corr({a}, {b}), 9) AS spearman FROM ranks"
        for a in FAMILIES for b in FAMILIES
    ),
)


@query("spearman", preds_sql(SPEARMAN_SQL))
def spearman(t: Testbed):
    wide = (
        t.predictions().filter(F.col("split") == "test").groupBy("prompt_id").pivot("model_family", list(FAMILIES))
        .agg(F.round(F.avg("p_pred"), 6))
    )
    return rounded(m.spearman(wide, FAMILIES), "spearman")


@query("score_hist", preds_sql(f"SELECT model_family, split, label, {bin_sql('left', 30)} AS bin, count(*) AS row_count FROM predictions GROUP BY ALL"))
def score_hist(t: Testbed):
    return m.score_histogram(t.predictions(), ["model_family", "split", "label"], "p_pred", 30)


CLASS_SQL = "CASE WHEN p_pred >= 0.5 THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END"


@query("outcome_class", preds_sql(f"SELECT run_id, prompt_id, {CLASS_SQL} AS outcome, round(greatest(p_pred, 1 - p_pred), 9) AS confidence FROM predictions"))
def outcome_class(t: Testbed):
    p = F.col("p_pred")
    return t.predictions().select(
        "run_id",
        "prompt_id",
        m.outcome_class(F.col("label"), F.when(p >= 0.5, 1).otherwise(0)).alias("outcome"),
        F.round(F.greatest(p, 1 - p), 9).alias("confidence"),
    )


@query("uncertain_band", preds_sql("SELECT run_id, prompt_id, p_pred, label FROM predictions WHERE p_pred BETWEEN 0.45 AND 0.55"))
def uncertain_band(t: Testbed):
    return t.predictions().filter(F.col("p_pred").between(0.45, 0.55)).select("run_id", "prompt_id", "p_pred", "label")
