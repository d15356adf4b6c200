"""Queries over frequencies, audits, pass rates, lift tables, ordering and run roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.operators import joins as j
from rulespan.operators import metrics as m
from rulespan.operators import profile as p
from rulespan.operators import ranking as r
from rulespan.operators import report as rep
from rulespan.plans.catalog import query
from rulespan.plans.q_metrics import rounded
from rulespan.plans.testbed import FAMILIES, Testbed, with_tables


def on(*names: str, body: str) -> str:
    return with_tables(*names, body=body)


def cif(condition: str) -> str:
    return f"CAST(count_if({condition}) AS BIGINT)"


@query("value_counts", on("checks", body="SELECT num_constraints, source_dataset, count(*) AS row_count FROM checks GROUP BY ALL"))
def value_counts(t: Testbed):
    return p.value_counts(t.checks(), "num_constraints", "source_dataset")


@query("id_frequency", on("constraints", body="""
f AS (SELECT instruction_id, split_part(instruction_id, ':', 1) AS family, count(*) AS frequency FROM constraints GROUP BY ALL)
SELECT instruction_id, family, frequency, CAST(sum(frequency) OVER (PARTITION BY family) AS BIGINT) AS family_frequency FROM f"""))
def id_frequency(t: Testbed):
    return p.id_frequency(t.promptset())


def excess_sql(column: str, table: str = "promptset") -> str:
    return f"""SELECT '{column}' AS "column", {cif('n > 1')} AS duplicate_values, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT {column}, count(*) AS n FROM {table} GROUP BY ALL)"""


@query("dup_stats_excess", on("promptset", body=" UNION ALL ".join(map(excess_sql, ("prompt_id", "base_key", "user_prompt")))))
def dup_stats_excess(t: Testbed):
    return p.duplicates_excess(t.promptset(), ["prompt_id", "base_key", "user_prompt"])


@query("dup_stats_all", on("checks", body=f"""SELECT split, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS unique_count,
 CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_row_count, {cif('n > 1')} AS duplicated_value_count,
 CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS null_count
FROM (SELECT split, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE base_key END AS k, count(*) AS n FROM checks GROUP BY ALL) GROUP BY split"""))
def dup_stats_all(t: Testbed):
    rows = t.checks().withColumn("k", F.when(F.col("doc_id") % 50 != 0, F.col("base_key")))
    return p.duplicate_summary(rows, "k", ["split"])


@query("dup_preview", on("checks", body="""SELECT constraint_family_signature, count(*) AS row_count, string_agg(DISTINCT split, '|' ORDER BY split) AS splits
FROM checks GROUP BY ALL HAVING count(*) > 1 ORDER BY row_count DESC, constraint_family_signature LIMIT 30"""))
def dup_preview(t: Testbed):
    return p.duplicate_preview(t.checks(), "constraint_family_signature", "split", 30)


LEAK = """leaks AS (SELECT base_key, count(*) AS row_count, count(DISTINCT split) AS partition_count, string_agg(DISTINCT split, '|' ORDER BY split) AS partitions
 FROM (SELECT base_key, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM checks) GROUP BY ALL HAVING count(DISTINCT split) > 1)"""


def leak_rows(t: Testbed):
    return t.checks().withColumn("split", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train"))


@query("leakage", on("checks", body=LEAK + " SELECT * FROM leaks"))
def leakage(t: Testbed):
    return p.leakage(leak_rows(t), "base_key", "split")


@query("leakage_summary", on("checks", body=LEAK + " SELECT count(*) AS leaked_value_count, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS leaked_row_count FROM leaks"))
def leakage_summary(t: Testbed):
    return p.leakage_summary(leak_rows(t), "base_key", "split")


@query("null_ratio", f"""WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang FROM documents)
SELECT 'text' AS "column", {cif("coalesce(text, '') = ''")} AS empty_count, round({cif("coalesce(text, '') = ''")}::DOUBLE / count(*), 9) AS ratio FROM d
UNION ALL SELECT 'lang', {cif("coalesce(lang, '') = ''")}, round({cif("coalesce(lang, '') = ''")}::DOUBLE / count(*), 9) FROM d""")
def null_ratio(t: Testbed):
    d = F.col("doc_id")
    rows = t.table("documents").select(
        F.when(d % 7 == 0, "").otherwise(F.col("text")).alias("text"), F.when(d % 11 != 0, F.col("lang")).alias("lang")
    )
    return rounded(p.null_ratios(rows, ["text", "lang"]), "ratio")


def json_counts_sql(column: str, table: str = "promptset") -> str:
    return (f"(SELECT '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' FROM "
            f"(SELECT CAST({column} AS VARCHAR) AS k, count(*) AS n FROM {table} GROUP BY ALL))")


def flag_sql(name: str, condition: str) -> str:
    return f"{cif(condition)} AS {name}, {cif(condition)}::DOUBLE / count(*) AS {name}_ratio"


@query("promptset_audit", on("promptset", body=f"""
dup AS ({excess_sql('prompt_id')} UNION ALL {excess_sql('base_key')}),
ids AS (SELECT unnest(instruction_ids) AS id FROM promptset)
SELECT count(*) AS num_rows, CAST(1000 AS BIGINT) AS expected_num_rows, count(*) = 1000 AS expected_num_rows_match,
 {json_counts_sql('num_constraints')} AS num_constraints_distribution, {json_counts_sql('source_dataset')} AS dataset_distribution,
 {json_counts_sql('constraint_type')} AS constraint_type_distribution, {json_counts_sql('id', 'ids')} AS instruction_id_frequency,
 {json_counts_sql("split_part(id, ':', 1)", 'ids')} AS constraint_family_frequency,
 (SELECT duplicate_rows FROM dup WHERE "column" = 'prompt_id') AS duplicate_prompt_rows,
 (SELECT duplicate_values FROM dup WHERE "column" = 'base_key') AS duplicate_base_keys, (SELECT duplicate_rows FROM dup WHERE "column" = 'base_key') AS duplicate_base_key_rows,
 {flag_sql('empty_messages', "user_prompt = ''")}, {flag_sql('empty_constraint', "doc_id % 53 = 0")}, {flag_sql('parse_failures', "doc_id % 97 = 0")} FROM promptset"""))
def promptset_audit(t: Testbed):
    d = F.col("doc_id")
    return p.promptset_audit(t.promptset(), 1000, F.coalesce("user_prompt", F.lit("")) == "", d % 53 == 0, d % 97 == 0)


RATES = f"""count(*) AS row_count, {cif('checker_pass')} AS pass_count, {cif('checker_error_count > 0')} AS checker_error_rows,
 {cif('output_truncated')} AS truncated_count, quantile_cont(prompt_tokens::DOUBLE, 0.5) AS prompt_tokens_p50, quantile_cont(output_tokens::DOUBLE, 0.5) AS output_tokens_p50,
 round(quantile_cont(output_tokens::DOUBLE, 0.9), 6) AS output_tokens_p90, round(avg(num_constraints), 9) AS num_constraints_mean,
 round(count_if(checker_pass)::DOUBLE / count(*), 9) AS pass_rate, round(count_if(output_truncated)::DOUBLE / count(*), 9) AS truncated_rate"""
RATE_ROUND = ("num_constraints_mean", "pass_rate", "truncated_rate")
SETS = (("cluster",), ("cluster", "length_bin"), ("length_bin",), ("num_constraints",), ("constraint_family_signature",), ("output_truncated",))


def rates(df):
    return rounded(df, *RATE_ROUND).withColumn("output_tokens_p90", F.round("output_tokens_p90", 6))


@query("pass_rate_by_facet", on("checks", body=f"SELECT cluster, length_bin, {RATES} FROM checks GROUP BY cluster, length_bin"))
def pass_rate_by_facet(t: Testbed):
    return rates(p.rate_table(t.checks(), ["cluster", "length_bin"]))


@query("pass_rate_grouping_sets", on("checks", body=f"""SELECT coalesce(cluster, -1) AS cluster, length_bin, coalesce(num_constraints, -1) AS num_constraints,
 constraint_family_signature, CAST(output_truncated AS VARCHAR) AS output_truncated,
 CAST(grouping_id(cluster, length_bin, num_constraints, constraint_family_signature, output_truncated) AS BIGINT) AS grouping_id,
 {RATES.replace('output_truncated)', 'cut)')} FROM (SELECT *, output_truncated AS cut FROM checks)
 GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in SETS)})"""))
def pass_rate_grouping_sets(t: Testbed):
    out = rates(p.rate_table_sets(t.checks(), SETS))
    return out.withColumns({
        "cluster": F.coalesce("cluster", F.lit(-1)), "num_constraints": F.coalesce("num_constraints", F.lit(-1)),
        "output_truncated": F.col("output_truncated").cast("string"), "grouping_id": F.col("grouping_id").cast("bigint"),
    })


@query("constraint_rates", on("constraints", body=f"""SELECT instruction_id, count(*) AS row_count, {cif('followed')} AS pass_count, {cif('checker_error')} AS checker_error_count,
 round(count_if(followed)::DOUBLE / count(*), 9) AS pass_rate, round(count_if(checker_error)::DOUBLE / count(*), 9) AS checker_error_rate FROM constraints GROUP BY ALL"""))
def constraint_rates(t: Testbed):
    return rounded(p.constraint_rates(t.constraints()), "pass_rate", "checker_error_rate")


@query("check_summary", on("checks", body=f"""SELECT count(*) AS row_count, {cif('checker_pass')} AS pass_count, {cif('NOT checker_pass')} AS fail_count,
 round(count_if(checker_pass)::DOUBLE / count(*), 8) AS pass_rate, {cif('checker_error_count > 0')} AS checker_error_rows,
 round(count_if(checker_error_count > 0)::DOUBLE / count(*), 8) AS checker_error_row_rate, {cif('output_truncated')} AS output_truncated_count,
 round(count_if(checker_pass AND output_truncated)::DOUBLE / count_if(output_truncated), 8) AS output_truncated_pass_rate,
 round(count_if(checker_pass AND NOT output_truncated)::DOUBLE / count_if(NOT output_truncated), 8) AS not_output_truncated_pass_rate,
 count(DISTINCT cluster) AS cluster_count FROM checks"""))
def check_summary(t: Testbed):
    return p.check_summary(t.checks())


QS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query("length_profile", on("checks", body=f"""SELECT count(*) AS row_count, min(prompt_tokens) AS min, max(prompt_tokens) AS max, round(avg(prompt_tokens), 9) AS mean,
 count(DISTINCT prompt_tokens) AS distinct_lengths, {cif('prompt_tokens < 2048')} AS below_limit, {cif('prompt_tokens >= 2048')} AS at_or_above_limit,
 round(count_if(prompt_tokens < 2048)::DOUBLE / count(*), 9) AS below_limit_share,
 {", ".join(f"round(quantile_cont(prompt_tokens::DOUBLE, {q / 100}), 6) AS p{q:02d}" for q in QS)} FROM checks"""))
def length_profile(t: Testbed):
    out = p.length_profile(t.checks(), "prompt_tokens", 2048)
    return rounded(rounded(out, "mean", "below_limit_share"), *[f"p{q:02d}" for q in QS], places=6)


def top3_sql(value: str, name: str) -> str:
    return f"""{name} AS (SELECT cluster, '[' || string_agg('{{"value":"' || v || '","count":' || n || '}}', ',' ORDER BY rn) || ']' AS {name}
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) AS rn FROM (SELECT cluster, {value} AS v, count(*) AS n FROM checks GROUP BY cluster, {value})) WHERE rn <= 3 GROUP BY cluster)"""


@query("cluster_profile", on("checks", body=f"""
{top3_sql('constraint_family_signature', 'top_family_signatures')}, {top3_sql('constraint_signature', 'top_constraint_signatures')},
bins AS (SELECT cluster, '{{' || string_agg('"' || length_bin || '":' || n, ',' ORDER BY length_bin) || '}}' AS length_bin_counts
 FROM (SELECT cluster, length_bin, count(*) AS n FROM checks GROUP BY ALL) GROUP BY cluster)
SELECT c.cluster, count(*) AS row_count, min(prompt_tokens) AS prompt_tokens_min, round(quantile_cont(prompt_tokens::DOUBLE, 0.5), 2) AS prompt_tokens_p50,
 round(quantile_cont(prompt_tokens::DOUBLE, 0.9), 2) AS prompt_tokens_p90, max(prompt_tokens) AS prompt_tokens_max, round(avg(num_constraints), 3) AS num_constraints_mean,
 round(count(*)::DOUBLE / (SELECT count(*) FROM checks), 6) AS share, any_value(top_family_signatures) AS top_family_signatures,
 any_value(top_constraint_signatures) AS top_constraint_signatures, any_value(length_bin_counts) AS length_bin_counts
FROM checks c JOIN top_family_signatures a ON a.cluster = c.cluster JOIN top_constraint_signatures b ON b.cluster = c.cluster JOIN bins d ON d.cluster = c.cluster GROUP BY c.cluster"""))
def cluster_profile(t: Testbed):
    return p.cluster_profile(t.checks())


SHARES = f"""cells AS (SELECT split, cluster, count(*) AS row_count, {cif('checker_pass')} AS pass_count, quantile_cont(prompt_tokens::DOUBLE, 0.5) AS prompt_tokens_median,
 round(quantile_cont(prompt_tokens::DOUBLE, 0.9), 6) AS prompt_tokens_p90 FROM checks WHERE NOT (split = 'val' AND cluster < 5) GROUP BY split, cluster),
shares AS (SELECT *, row_count::DOUBLE / sum(row_count) OVER (PARTITION BY split) AS share, pass_count::DOUBLE / row_count AS pass_rate,
 (sum(row_count) OVER (PARTITION BY cluster))::DOUBLE / sum(row_count) OVER () AS global_share FROM cells)"""


def shares(t: Testbed):
    return p.cluster_share(t.checks().filter(~((F.col("split") == "val") & (F.col("cluster") < 5))))


@query("cluster_share", on("checks", body=SHARES + """ SELECT split, cluster, row_count, pass_count, prompt_tokens_median, prompt_tokens_p90, round(share, 9) AS share,
 round(pass_rate, 9) AS pass_rate, round(global_share, 9) AS global_share, round(share - global_share, 9) AS share_diff_from_all FROM shares"""))
def cluster_share(t: Testbed):
    out = rounded(shares(t), "share", "pass_rate", "global_share", "share_diff_from_all")
    return out.withColumn("prompt_tokens_p90", F.round("prompt_tokens_p90", 6))


@query("split_tvd", on("checks", body=SHARES + """,
g AS (SELECT DISTINCT cluster, global_share FROM shares)
SELECT s.split, CAST(max(s.n) AS BIGINT) AS row_count, max(s.k) AS cluster_count, round(0.5 * sum(abs(coalesce(x.share, 0) - g.global_share)), 9) AS cluster_tvd_vs_all
FROM (SELECT split, sum(row_count) AS n, count(*) AS k FROM shares GROUP BY split) s CROSS JOIN g LEFT JOIN shares x ON x.split = s.split AND x.cluster = g.cluster GROUP BY s.split"""))
def split_tvd(t: Testbed):
    return rounded(p.split_tvd(shares(t)), "cluster_tvd_vs_all")


@query("top_drift", on("checks", body=SHARES + """ SELECT split, cluster, row_count, round(share, 9) AS share, round(global_share, 9) AS global_share,
 round(share - global_share, 9) AS share_diff_from_all, round(pass_rate, 9) AS pass_rate FROM shares ORDER BY round(abs(share - global_share), 9) DESC, split, cluster LIMIT 10"""))
def top_drift(t: Testbed):
    return rounded(p.top_drift(shares(t), 10), "share", "global_share", "share_diff_from_all", "pass_rate")


LIFT = """ round(x::DOUBLE / n, 9) AS truncated_rate, round(n::DOUBLE / N_ALL, 9) AS row_share, round(x::DOUBLE / greatest(1, P_ALL), 9) AS truncated_share,
 round(n * (P_ALL::DOUBLE / N_ALL), 6) AS expected_truncated_count, round(x - n * (P_ALL::DOUBLE / N_ALL), 6) AS excess_truncated_count,
 round((x::DOUBLE / n) / (P_ALL::DOUBLE / N_ALL), 9) AS lift_vs_overall,
 round((x - n * (P_ALL::DOUBLE / N_ALL)) / sqrt(n * (P_ALL::DOUBLE / N_ALL) * (1 - P_ALL::DOUBLE / N_ALL)), 9) AS binomial_z
FROM g, (SELECT count(*) AS N_ALL, count_if(output_truncated) AS P_ALL FROM checks)"""
LIFT_9 = ("truncated_rate", "row_share", "truncated_share", "lift_vs_overall", "binomial_z")
LIFT_6 = ("expected_truncated_count", "excess_truncated_count")


@query("lift_table", on("checks", body="""
g AS (SELECT CASE WHEN doc_id % 40 = 0 THEN '<missing>' ELSE source_dataset END AS category, count(*) AS n, count_if(output_truncated) AS x,
 round(quantile_cont(prompt_tokens::DOUBLE, 0.5), 2) AS p50, round(quantile_cont(output_tokens::DOUBLE, 0.5), 2) AS o50,
 round(quantile_cont(output_tokens::DOUBLE, 0.9), 3) AS o90, round(avg(num_constraints), 3) AS nc FROM checks GROUP BY ALL HAVING count(*) >= 10)
SELECT category, n AS row_count, CAST(x AS BIGINT) AS truncated_count, p50 AS prompt_tokens_p50, o50 AS output_tokens_p50, o90 AS output_tokens_p90, nc AS num_constraints_mean,""" + LIFT))
def lift_table(t: Testbed):
    rows = t.checks().withColumn("source_dataset", F.when(F.col("doc_id") % 40 != 0, F.col("source_dataset")))
    return rounded(rounded(p.lift_table(rows, "source_dataset", 10), *LIFT_9), *LIFT_6, places=6)


@query("lift_by_id", on("checks", body="""
e AS (SELECT prompt_id, output_truncated, prompt_tokens, unnest(instruction_ids) AS category FROM checks),
g AS (SELECT category, count(DISTINCT prompt_id) AS n, count_if(output_truncated) AS x, round(quantile_cont(prompt_tokens::DOUBLE, 0.5), 2) AS p50 FROM e GROUP BY ALL HAVING count(DISTINCT prompt_id) >= 5)
SELECT category, n AS row_count, CAST(x AS BIGINT) AS truncated_count, p50 AS prompt_tokens_p50,""" + LIFT))
def lift_by_id(t: Testbed):
    return rounded(rounded(p.lift_by_id(t.checks(), min_count=5), *LIFT_9), *LIFT_6, places=6)


@query("concentration", on("checks", body="""
g AS (SELECT cluster, count(*) AS n, count_if(output_truncated) AS x, row_number() OVER (ORDER BY count_if(output_truncated) DESC, cluster) AS rn FROM checks GROUP BY cluster)
SELECT k AS top, round(sum(x) FILTER (rn <= k)::DOUBLE / sum(x), 9) AS truncated_share, round(sum(n) FILTER (rn <= k)::DOUBLE / sum(n), 9) AS row_share
FROM g, (VALUES (3::BIGINT), (5)) v(k) GROUP BY k"""))
def concentration(t: Testbed):
    return rounded(p.concentration(t.checks(), "cluster"), "truncated_share", "row_share")


FEATURES = ("cluster", "length_bin", "constraint_type", "num_constraints", "base_key")
CONT = "cont AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, coalesce(CAST({f} AS VARCHAR), '<missing>') AS level, count(*) AS n, count_if(output_truncated) AS pos FROM checks GROUP BY ALL" for f in FEATURES
) + """), tot AS (SELECT *, sum(n) OVER w AS nn, sum(pos) OVER w AS pp, count(*) OVER w AS levels FROM cont WINDOW w AS (PARTITION BY feature)),
cells AS (SELECT feature, levels, nn, pos AS o, n AS row_total, pp AS col_total, n * (pp::DOUBLE / nn) AS e FROM tot
 UNION ALL SELECT feature, levels, nn, n - pos, n, nn - pp, n - n * (pp::DOUBLE / nn) FROM tot)"""


@query("chi_square", on("checks", body=CONT + """
SELECT feature, max(levels) AS levels, round(sum(power(abs(o - e) - CASE WHEN levels = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), 6) AS chi2, max(levels) - 1 AS dof,
 round(sqrt(sum(power(abs(o - e) - CASE WHEN levels = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) / max(nn)), 9) AS cramers_v FROM cells GROUP BY feature"""))
def chi_square(t: Testbed):
    out = p.association(t.checks(), FEATURES, "output_truncated").drop("mutual_information")
    return rounded(rounded(out, "cramers_v"), "chi2", places=6)


@query("chi_square_p")
def chi_square_p(t: Testbed):
    out = p.association(t.checks(), FEATURES, "output_truncated").select("feature", "chi2", "dof")
    return out.withColumn("p_value", p.chi_square_p(F.col("chi2"), F.col("dof")))


@query("mutual_info", on("checks", body=CONT + """
SELECT feature, round(sum(CASE WHEN o > 0 THEN o::DOUBLE / nn * ln(o::DOUBLE * nn / (row_total::DOUBLE * col_total)) ELSE 0 END), 9) AS mutual_information FROM cells GROUP BY feature"""))
def mutual_info(t: Testbed):
    out = p.association(t.checks(), FEATURES, "output_truncated").select("feature", "mutual_information")
    return rounded(out, "mutual_information")


BINS = ("001-128", "129-256", "257-512", "513-1024", "1025-2047", "nan")


@query("pivot_counts", on("checks", body="SELECT cluster, " + ", ".join(f"{cif(f"length_bin = '{b}'")} AS \"{b}\"" for b in BINS) + " FROM checks GROUP BY cluster"))
def pivot_counts(t: Testbed):
    return p.pivot_counts(t.checks(), "cluster", "length_bin", BINS)


@query("pivot_rate", on("checks", body="SELECT num_constraints, " + ", ".join(
    f"CASE WHEN count_if(length_bin = '{b}') >= 30 THEN round(count_if(length_bin = '{b}' AND checker_pass)::DOUBLE / count_if(length_bin = '{b}'), 9) END AS \"{b}\"" for b in BINS
) + " FROM checks GROUP BY num_constraints"))
def pivot_rate(t: Testbed):
    out = p.pivot_rate(t.checks(), "num_constraints", "length_bin", BINS, "checker_pass")
    return out.select("num_constraints", *[F.round(F.col(f"`{b}`"), 9).alias(b) for b in BINS])


@query("cluster_failures", on("checks", "constraints", body="""
j AS (SELECT k.cluster, c.instruction_id, c.followed FROM constraints c JOIN checks k USING (prompt_id)),
f AS (SELECT cluster, instruction_id, count(*) AS fail_count FROM j WHERE NOT followed GROUP BY ALL),
s AS (SELECT *, round(fail_count::DOUBLE / sum(fail_count) OVER (PARTITION BY cluster), 9) AS failed_constraint_share,
 row_number() OVER (PARTITION BY cluster ORDER BY fail_count DESC, instruction_id) AS position FROM f)
SELECT cluster, instruction_id, fail_count, failed_constraint_share, position FROM s WHERE position <= 20"""))
def cluster_failures(t: Testbed):
    _, failures = p.cluster_failures(t.checks(), t.constraints())
    return rounded(failures, "failed_constraint_share").withColumn("position", F.col("position").cast("bigint"))


@query("cluster_failure_summary", on("checks", "constraints", body=f"""
j AS (SELECT k.cluster, count(*) AS constraint_count, {cif('NOT followed')} AS failed_constraint_count FROM constraints c JOIN checks k USING (prompt_id) GROUP BY ALL)
SELECT c.cluster, count(*) AS row_count, {cif('checker_pass')} AS pass_count, round(avg(num_constraints), 9) AS num_constraints_mean, quantile_cont(prompt_tokens::DOUBLE, 0.5) AS prompt_tokens_p50,
 quantile_cont(output_tokens::DOUBLE, 0.5) AS output_tokens_p50, round(quantile_cont(output_tokens::DOUBLE, 0.9), 6) AS output_tokens_p90, {cif('checker_error_count > 0')} AS checker_error_rows,
 any_value(constraint_count) AS constraint_count, any_value(failed_constraint_count) AS failed_constraint_count, round(count_if(checker_pass)::DOUBLE / count(*), 9) AS pass_rate
FROM checks c JOIN j ON j.cluster = c.cluster GROUP BY c.cluster"""))
def cluster_failure_summary(t: Testbed):
    summary, _ = p.cluster_failures(t.checks(), t.constraints())
    return rounded(rounded(summary, "num_constraints_mean", "pass_rate"), "output_tokens_p90", places=6)


GEN = "CASE WHEN n_chars % 7 = 0 THEN 'length' ELSE 'stop' END"


@query("throughput_summary", f"""WITH g AS (SELECT doc_id % 13 <> 0 AS ok, {GEN} AS finish_reason, n_chars > 2048 AS output_truncated, (n_chars * 3) % 1500 AS output_tokens,
 CAST(n_chars * 7919 % 10007 AS DOUBLE) / 256 AS seconds FROM documents)
SELECT count(*) AS row_count, {cif('ok')} AS success_count, {cif('NOT ok')} AS failure_count, {cif('ok AND output_truncated')} AS output_truncated_count,
 {cif("ok AND finish_reason = 'length'")} AS finish_length_count, {cif("ok AND finish_reason = 'stop'")} AS finish_stop_count, CAST(sum(output_tokens) FILTER (ok) AS BIGINT) AS completion_tokens,
 max(output_tokens) FILTER (ok) AS output_tokens_max, min(seconds) FILTER (ok) AS seconds_min, round(avg(seconds) FILTER (ok), 9) AS seconds_mean, max(seconds) FILTER (ok) AS seconds_max,
 {", ".join(f"round(quantile_cont(output_tokens::DOUBLE, {q}) FILTER (ok), 6) AS output_tokens_p{round(q * 100)}" for q in (0.5, 0.9, 0.95))},
 round(quantile_cont(seconds, 0.5) FILTER (ok), 6) AS seconds_p50, round(quantile_cont(seconds, 0.9) FILTER (ok), 6) AS seconds_p90,
 round(CAST(sum(output_tokens) FILTER (ok) AS BIGINT) / 60.0::DOUBLE, 9) AS tokens_per_second FROM g""")
def throughput_summary(t: Testbed):
    d, n = F.col("doc_id"), F.col("n_chars")
    rows = t.table("documents").select(
        (d % 13 != 0).alias("ok"), F.expr(GEN).alias("finish_reason"), (n > 2048).alias("output_truncated"),
        ((n * 3) % 1500).alias("output_tokens"), ((n * 7919 % 10007).cast("double") / 256).alias("seconds"),
    )
    out = rounded(p.throughput_summary(rows, 60.0), "seconds_mean", "tokens_per_second")
    return rounded(out, "seconds_p50", "seconds_p90", *[f"output_tokens_p{q}" for q in (50, 90, 95)], places=6)


@query("latency_quantiles", """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL""")
def latency_quantiles(t: Testbed):
    bucket = F.floor(F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(4096.0)) * 16)
    out = r.exact_quantiles(t.table("events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, bucket)
    return rounded(out, "p50", "p90", "p99", places=6)


RUN_KEYS = ["model_family", "train_size_label", "split"]
RUNS_SQL = """runs AS (SELECT model_family, train_size_label, seed, split, round(avg(CASE WHEN (p_pred >= 0.5) = (label = 1) THEN 1 ELSE 0 END), 9) AS accuracy,
 round(avg((p_pred - label) * (p_pred - label)) + 1e-12::DOUBLE, 9) AS brier FROM predictions GROUP BY ALL)"""


def runs(t: Testbed):
    """One row per run and split; one configuration has a single run."""
    rows = t.predictions()
    keys = ["model_family", "train_size_label", "seed", "split"]
    counts = m.score_counts(rows, keys)
    out = r.null_safe_join(m.threshold_metrics(counts, keys).select(*keys, "accuracy"), m.loss_metrics(counts, keys), keys)
    return rounded(out.drop("log_loss"), "accuracy", "brier")


def rollup_sql(std: str) -> str:
    cols = ", ".join(
        f"round(avg({x}), 9) AS {x}_mean, {std.format(x=x)} AS {x}_std, min({x}) AS {x}_min, max({x}) AS {x}_max" for x in ("accuracy", "brier")
    )
    return f"{RUNS_SQL} SELECT model_family, train_size_label, split, count(DISTINCT seed) AS run_count, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds, {cols} FROM runs GROUP BY ALL"


ROLL = tuple(f"{x}_{s}" for x in ("accuracy", "brier") for s in ("mean", "std"))


@query("run_rollup", on("predictions", body=rollup_sql("coalesce(round(stddev_samp({x}), 9), 0)")))
def run_rollup(t: Testbed):
    return rounded(p.run_rollup(runs(t), RUN_KEYS, ["accuracy", "brier"]), *ROLL)


@query("capacity_rollup", on("predictions", body=rollup_sql("round(stddev_samp({x}), 9)")))
def capacity_rollup(t: Testbed):
    return rounded(p.run_rollup(runs(t), RUN_KEYS, ["accuracy", "brier"], single_run_std=None), *ROLL)


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("token_support", f"""WITH tok AS (SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split, unnest({WORDS}) AS token FROM documents),
per AS (SELECT token, count_if(split = 'train') AS tr, count_if(split = 'test') AS te FROM tok GROUP BY token)
SELECT {cif('tr > 0')} AS train_token_count, {cif('tr = 0 AND te > 0')} AS unseen_token_count, round(coalesce(sum(te) FILTER (tr = 0), 0)::DOUBLE / sum(te), 9) AS unseen_token_mass FROM per""")
def token_support(t: Testbed):
    d = F.col("doc_id")
    tokens = t.texts("doc_id", "text").select(
        F.when(d % 10 < 7, "train").when(d % 10 == 7, "val").otherwise("test").alias("split"),
        F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("token"),
    ).filter(F.col("token").isNotNull())
    return rounded(p.token_support(tokens.groupBy("split", "token").agg(F.count("*").alias("n"))), "unseen_token_mass")


@query("split_counts", on("checks", body="""SELECT split, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS num_constraints, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(x) AS BIGINT) AS pass_count
FROM (SELECT split, CAST(num_constraints AS VARCHAR) AS k, count(*) AS n, count_if(checker_pass) AS x FROM checks GROUP BY ALL) GROUP BY split"""))
def split_counts(t: Testbed):
    n = t.checks().groupBy("split", F.col("num_constraints").cast("string").alias("k")).agg(
        F.count("*").alias("n"), F.count_if("checker_pass").alias("x")
    )
    return n.groupBy("split").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("num_constraints"),
        F.sum("n").alias("row_count"), F.sum("x").alias("pass_count"),
    )


@query("constraint_tops", on("constraints", body=f"""
c AS (SELECT instruction_id, count(*) AS row_count, round(count_if(followed)::DOUBLE / count(*), 9) AS pass_rate FROM constraints GROUP BY ALL)
SELECT * FROM (SELECT *, 'top' AS side FROM c ORDER BY pass_rate DESC, row_count DESC, instruction_id LIMIT 15)
UNION ALL SELECT * FROM (SELECT *, 'lowest' AS side FROM c ORDER BY pass_rate, row_count DESC, instruction_id LIMIT 15)"""))
def constraint_tops(t: Testbed):
    c = rounded(p.constraint_rates(t.constraints()), "pass_rate").select("instruction_id", "row_count", "pass_rate")
    return p.two_sided_top(c, F.col("pass_rate"), [F.col("row_count").desc(), F.col("instruction_id")], 15)


# --- ordering, top-k, pivots -----------------------------------------------------------------------------------


@query("result_rank", on("predictions", body=RUNS_SQL + " SELECT model_family, train_size_label, seed, split, accuracy, row_number() OVER (ORDER BY accuracy DESC, model_family, train_size_label, seed, split) AS result_rank FROM runs"))
def result_rank(t: Testbed):
    return rep.ranked(runs(t).drop("brier"), "accuracy", ["model_family", "train_size_label", "seed", "split"], "result_rank")


@query("hash_sample", on("promptset", body="SELECT prompt_id, base_key FROM promptset ORDER BY sha256('42:' || prompt_id), prompt_id LIMIT 300"))
def hash_sample(t: Testbed):
    return r.stable_sample(t.promptset().select("prompt_id", "base_key"), 300, 42)


@query("topk_groups", on("checks", body="""
g AS (SELECT cluster, base_key, count(*) AS n, sum(output_tokens) AS tokens FROM checks GROUP BY ALL)
SELECT cluster, base_key, n AS row_count, CAST(tokens AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY tokens DESC, base_key) AS rn FROM g) WHERE rn <= 5"""))
def topk_groups(t: Testbed):
    g = t.checks().groupBy("cluster", "base_key").agg(F.count("*").alias("row_count"), F.sum("output_tokens").alias("tokens"))
    return r.top_per_group(g, ["cluster"], [F.col("tokens").desc(), F.col("base_key")], 5, "_rn").drop("_rn")


@query("group_mode", on("checks", body="""SELECT base_key, length_bin AS mode_bin FROM (SELECT base_key, length_bin, row_number() OVER (PARTITION BY base_key ORDER BY count(*) DESC, length_bin) AS rn
FROM checks GROUP BY base_key, length_bin) WHERE rn = 1"""))
def group_mode(t: Testbed):
    return r.group_mode(t.checks(), "base_key", "length_bin", "mode_bin")


@query("arg_best", on("predictions", body="SELECT prompt_id, arg_max(run_id, (p_pred, run_id)) AS best_run, max(p_pred) AS best_score FROM predictions GROUP BY prompt_id"))
def arg_best(t: Testbed):
    return t.predictions().groupBy("prompt_id").agg(
        F.max_by("run_id", F.struct("p_pred", "run_id")).alias("best_run"), F.max("p_pred").alias("best_score")
    )


@query("stable_sort", on("checks", body="SELECT prompt_id, cluster, prompt_tokens FROM checks"))
def stable_sort(t: Testbed):
    return t.checks().select("prompt_id", "cluster", "prompt_tokens").orderBy("cluster", F.col("prompt_tokens").desc(), "prompt_id")


@query("seed_average", on("predictions", body="SELECT model_family, train_size_label, split, prompt_id, round(avg(p_pred), 9) AS p_mean, round(stddev_samp(p_pred), 9) AS p_std, count(*) AS run_count FROM predictions GROUP BY ALL"))
def seed_average(t: Testbed):
    return rounded(m.seed_average(t.predictions(), ["model_family", "train_size_label", "split", "prompt_id"]), "p_mean", "p_std")


WIDE_SQL = "wide AS (SELECT prompt_id, " + ", ".join(f"round(avg(p_pred) FILTER (model_family = '{f}'), 9) AS {f}" for f in FAMILIES) + " FROM predictions WHERE split = 'test' AND train_size_label = 'full' GROUP BY prompt_id)"


def wide(t: Testbed):
    rows = t.predictions().filter((F.col("split") == "test") & (F.col("train_size_label") == "full"))
    return rows.groupBy("prompt_id").pivot("model_family", list(FAMILIES)).agg(F.round(F.avg("p_pred"), 9))


@query("score_pivot", on("predictions", body=WIDE_SQL + " SELECT * FROM wide"))
def score_pivot(t: Testbed):
    return wide(t)


@query("metric_unpivot", on("predictions", body=RUNS_SQL + " SELECT model_family, train_size_label, seed, split, 'accuracy' AS metric, accuracy AS value FROM runs UNION ALL SELECT model_family, train_size_label, seed, split, 'brier', brier FROM runs"))
def metric_unpivot(t: Testbed):
    return runs(t).unpivot(["model_family", "train_size_label", "seed", "split"], ["accuracy", "brier"], "metric", "value")


@query("pivot_delta", on("predictions", body=WIDE_SQL + """, d AS (SELECT prompt_id, round(tiny - tfidf, 9) AS delta FROM wide)
SELECT * FROM (SELECT *, 'top' AS side FROM d ORDER BY delta DESC, prompt_id LIMIT 20) UNION ALL SELECT * FROM (SELECT *, 'lowest' AS side FROM d ORDER BY delta, prompt_id LIMIT 20)"""))
def pivot_delta(t: Testbed):
    d = wide(t).select("prompt_id", F.round(F.col("tiny") - F.col("tfidf"), 9).alias("delta"))
    return p.two_sided_top(d, F.col("delta"), [F.col("prompt_id")], 20)


# --- reports over runs -----------------------------------------------------------------------------------------

FULL_SQL = """runs AS (SELECT model_family, train_size_label, seed, split, {auroc} AS auroc, {auprc} AS auprc FROM points GROUP BY ALL),
summary AS (SELECT model_family, train_size_label, split, count(DISTINCT seed) AS run_count, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds,
 round(avg(auroc), 9) AS auroc, round(avg(auprc), 9) AS auprc FROM runs GROUP BY ALL),
wide AS (SELECT v.model_family, v.train_size_label, v.auroc AS val_auroc, v.auprc AS val_auprc, t.auroc AS test_auroc, t.auprc AS test_auprc, t.run_count, t.seeds
 FROM summary v JOIN summary t ON t.model_family = v.model_family AND t.train_size_label = v.train_size_label AND v.split = 'val' AND t.split = 'test')
SELECT model_family, rule AS selection_rule, train_size_label AS selected_config, val_auroc, val_auprc, test_auroc, test_auprc, run_count, seeds FROM (
 SELECT *, 'validation-selected' AS rule, row_number() OVER (PARTITION BY model_family ORDER BY val_auprc DESC, train_size_label) AS rn FROM wide UNION ALL
 SELECT *, 'best by test' AS rule, row_number() OVER (PARTITION BY model_family ORDER BY test_auprc DESC, train_size_label) AS rn FROM wide) WHERE rn = 1"""


def _scored(keys: str, body: str) -> str:
    from rulespan.plans.q_metrics import AUPRC, AUROC, scored_sql

    return scored_sql(keys, ", " + body.format(auroc=AUROC, auprc=AUPRC)).replace(")\n, ", "),\n")


@query("selection_table", _scored("model_family, train_size_label, seed, split", FULL_SQL))
def selection_table(t: Testbed):
    keys = ["model_family", "train_size_label", "seed", "split"]
    points = m.curve(m.score_counts(t.predictions(), keys), keys)
    per_run = rounded(m.area_metrics(points, keys), "auroc", "auprc")
    return rep.selection_table(rounded(rep.summary_by_config(per_run), "auroc", "auprc"))


SIDES = """case_rows AS (
 SELECT 'false_positive' AS recipe, *, row_number() OVER (ORDER BY tiny DESC, prompt_id) AS rn FROM w WHERE label = 0 AND tiny >= 0.8 UNION ALL
 SELECT 'false_negative', *, row_number() OVER (ORDER BY tiny, prompt_id) FROM w WHERE label = 1 AND tiny <= 0.2 UNION ALL
 SELECT 'tiny_right_tfidf_wrong', *, row_number() OVER (ORDER BY tiny DESC, prompt_id) FROM w WHERE (tiny >= 0.5) = (label = 1) AND (tfidf >= 0.5) <> (label = 1) UNION ALL
 SELECT 'frozen_right_tiny_wrong', *, row_number() OVER (ORDER BY frozen DESC, prompt_id) FROM w WHERE (frozen >= 0.5) = (label = 1) AND (tiny >= 0.5) <> (label = 1) UNION ALL
 SELECT 'all_wrong', *, row_number() OVER (ORDER BY prompt_id) FROM w WHERE (frozen >= 0.5) <> (label = 1) AND (tiny >= 0.5) <> (label = 1) AND (tfidf >= 0.5) <> (label = 1))"""


@query("error_examples", on("predictions", body=WIDE_SQL + ", w AS (SELECT wide.*, CAST(l.checker_pass AS INTEGER) AS label FROM wide JOIN checks l USING (prompt_id)), " + SIDES
       + " SELECT recipe, prompt_id, label, tfidf, tiny, frozen FROM case_rows WHERE rn <= 5"))
def error_examples(t: Testbed):
    w = wide(t).join(t.checks().select("prompt_id", F.col("checker_pass").cast("int").alias("label")), "prompt_id")
    return rep.error_examples(w, 5)


@query("prompt_examples", on("predictions", body="""
g AS (SELECT prompt_id, max(label) AS label, round(avg(p_pred), 9) AS p_mean, any_value(instruction_ids) AS ids FROM predictions WHERE model_family = 'tiny' AND train_size_label = 'full' AND split = 'test' GROUP BY prompt_id),
o AS (SELECT *, CASE WHEN p_mean >= 0.5 THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome, round(abs(p_mean - 0.5), 9) AS confidence FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY confidence DESC, prompt_id) AS rn FROM o)
SELECT outcome AS case_group, prompt_id, label, p_mean, confidence FROM q WHERE rn <= 2"""))
def prompt_examples(t: Testbed):
    return rep.quadrant_examples(_averaged(t), 2).select("case_group", "prompt_id", "label", "p_mean", "confidence")


def _averaged(t: Testbed):
    rows = t.predictions().filter(
        (F.col("model_family") == "tiny") & (F.col("train_size_label") == "full") & (F.col("split") == "test")
    )
    return rows.groupBy("prompt_id").agg(
        F.max("label").alias("label"), F.round(F.avg("p_pred"), 9).alias("p_mean"), F.first("instruction_ids").alias("instruction_ids")
    )


@query("hard_rule_examples")
def hard_rule_examples(t: Testbed):
    averaged = _averaged(t)
    keys = ["instruction_id"]
    rows = averaged.select("label", F.col("p_mean").alias("p_pred"), F.explode("instruction_ids").alias("instruction_id"))
    counts = m.score_counts(rows, keys)
    sizes = counts.groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("test_rows"), (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("positive_rate")
    )
    per_rule = r.null_safe_join(rounded(m.area_metrics(m.curve(counts, keys), keys), "auprc"), sizes, keys)
    return rep.prompt_examples(averaged, per_rule, min_rows=5)


@query("curve_comparison", on("predictions", body=RUNS_SQL + """,
c AS (SELECT model_family AS family, CASE WHEN train_size_label = '80k' THEN 'full' ELSE train_size_label END AS curve_label, split, round(avg(accuracy), 9) AS accuracy_mean,
 coalesce(round(stddev_samp(accuracy), 9), 0) AS accuracy_std FROM runs GROUP BY ALL)
SELECT family, curve_label, split, accuracy_mean, accuracy_std, CASE curve_label WHEN '20k' THEN CAST(20000 AS BIGINT) WHEN '40k' THEN CAST(40000 AS BIGINT) ELSE CAST(1000000000 AS BIGINT) END AS curve_order FROM c"""))
def curve_comparison(t: Testbed):
    roll = rounded(p.run_rollup(runs(t), RUN_KEYS, ["accuracy"], single_run_std=None), "accuracy_mean", "accuracy_std")
    frames = [roll.filter(F.col("model_family") == f) for f in FAMILIES]
    frames[1] = frames[1].drop("seeds")
    return rep.curve_comparison(j.union_runs(frames), ["full", "40k", "20k"])


@query("experiment_table", on("predictions", body=RUNS_SQL + """,
c AS (SELECT model_family || ' ' || train_size_label AS experiment, round(avg(accuracy), 9) AS accuracy_mean, count(*) AS run_count FROM runs WHERE split = 'test' GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY accuracy_mean DESC, experiment) AS result_rank FROM c"""))
def experiment_table(t: Testbed):
    per = runs(t).filter(F.col("split") == "test").groupBy(F.concat_ws(" ", "model_family", "train_size_label").alias("experiment")).agg(
        F.round(F.avg("accuracy"), 9).alias("accuracy_mean"), F.count("*").alias("run_count")
    )
    return rep.ranked(per, "accuracy_mean", ["experiment"], "result_rank")
