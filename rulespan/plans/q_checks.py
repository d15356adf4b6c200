"""The whole rule-check job: specification -> verdicts -> strict label -> pass rates, and its cross-checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from rulespan.functions.alternatives import SHADOWS, SMOKE, shadow_check, smoke_check
from rulespan.functions.rules import REGISTERED
from rulespan.operators import checks as c
from rulespan.plans import sqltext as q
from rulespan.plans.catalog import query
from rulespan.plans.q_metrics import rounded
from rulespan.plans.q_profile import cif
from rulespan.plans.q_rules import PROBES
from rulespan.plans.testbed import Testbed
from rulespan.session import checkpointed

# Ids drawn by the job: all rules of the dispatch table plus an unknown one.
DRAWN = (*REGISTERED, "unknown:rule")
PICK = f"(doc_id * 7 + j * 11) % {len(DRAWN)}"


def responses(t: Testbed) -> DataFrame:
    """Documents as responses; each has 1 to 5 constraints whose arguments follow from the document."""
    branches = " ".join(
        f"WHEN {i} THEN " + (
            f"to_json(named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {e}' for n, e in PROBES[r][1].items())}))" if PROBES[r][1] else "'{}'"
        )
        for i, r in enumerate(REGISTERED)
    )
    names = "array(" + ", ".join(f"'{n}'" for n in DRAWN) + ")"
    constraints = (
        "transform(sequence(0, cast(doc_id % 5 as int)), j -> named_struct('instruction_id', "
        f"element_at({names}, cast({PICK} as int) + 1), 'kwargs_json', CASE cast({PICK} as int) {branches} ELSE '{{}}' END))"
    )
    return t.texts("doc_id", "text", "lang").select(
        "doc_id", F.expr("sha2('doc:' || doc_id, 256)").alias("prompt_id"), F.col("text").alias("response_text"),
        (F.col("doc_id") % 5 + 1).alias("num_constraints"), F.expr(constraints).alias("constraints"),
    )


def _verdict_sql() -> str:
    def inline(sql: str, rule: str) -> str:
        arguments = {n: e.replace("array(", "list_value(") for n, e in PROBES[rule][1].items()}
        return re.sub(r"\ba_(\w+)\b", lambda m: f"({arguments[m.group(1)]})", sql)

    ok = " ".join(f"WHEN {i} THEN ({inline(PROBES[r][2], r)}) AND NOT ({inline(PROBES[r][3], r)})" for i, r in enumerate(REGISTERED))
    bad = " ".join(f"WHEN {i} THEN ({inline(PROBES[r][3], r)})" for i, r in enumerate(REGISTERED) if PROBES[r][3] != "false")
    names = "[" + ", ".join(f"'{n}'" for n in DRAWN) + "]"
    return f"""WITH drawn AS (SELECT doc_id, text, text AS v, lang, unnest(range(0, doc_id % 5 + 1)) AS j FROM documents),
picked AS (SELECT *, CAST({PICK} AS INTEGER) AS i FROM drawn),
verdicts AS (SELECT doc_id, sha256('doc:' || doc_id) AS prompt_id, j AS constraint_index, ({names})[i + 1] AS instruction_id,
 coalesce(CASE i {ok} ELSE false END, false) AS followed, CASE i WHEN {len(REGISTERED)} THEN true {bad} ELSE false END AS checker_error FROM picked),
strict AS (SELECT doc_id, prompt_id, count(*) AS num_constraints_checked, {cif('followed')} AS followed_count, {cif('NOT followed')} AS failed_count,
 {cif('checker_error')} AS checker_error_count, bool_and(followed) AND NOT bool_or(checker_error) AS strict_pass FROM verdicts GROUP BY ALL)
"""


VERDICTS = _verdict_sql()
COUNTS = ("num_constraints_checked", "followed_count", "failed_count", "checker_error_count")


def checked(t: Testbed) -> DataFrame:
    return c.run_checks(responses(t))


def strict(t: Testbed) -> DataFrame:
    out = c.check_rows(checked(t))
    return out.withColumns({n: F.col(n).cast("bigint") for n in COUNTS})


@query("check_dispatch", VERDICTS + "SELECT prompt_id, constraint_index, instruction_id, followed, checker_error FROM verdicts")
def check_dispatch(t: Testbed):
    return c.per_constraint(checked(t)).select(
        "prompt_id", F.col("constraint_index").cast("bigint").alias("constraint_index"), "instruction_id", "followed", "checker_error"
    )


@query("strict_pass", VERDICTS + f"SELECT prompt_id, {', '.join(COUNTS)}, strict_pass FROM strict")
def strict_pass(t: Testbed):
    return strict(t).select("prompt_id", *COUNTS, "strict_pass")


@query("strict_pass_rate", VERDICTS + f"""SELECT doc_id % 5 + 1 AS num_constraints, count(*) AS row_count, {cif('strict_pass')} AS pass_count,
 round(count_if(strict_pass)::DOUBLE / count(*), 9) AS pass_rate, {cif('checker_error_count > 0')} AS checker_error_rows FROM strict GROUP BY ALL""")
def strict_pass_rate(t: Testbed):
    return strict(t).groupBy("num_constraints").agg(
        F.count("*").alias("row_count"),
        F.count_if("strict_pass").alias("pass_count"),
        F.round(F.count_if("strict_pass") / F.count("*"), 9).alias("pass_rate"),
        F.count_if(F.col("checker_error_count") > 0).alias("checker_error_rows"),
    )


@query("check_rows", VERDICTS + """SELECT s.prompt_id, length(d.text) AS response_chars, num_constraints_checked, followed_count, failed_count, checker_error_count,
 strict_pass AS checker_pass, num_constraints_checked <> d.doc_id % 5 + 1 AS count_mismatch FROM strict s JOIN documents d ON d.doc_id = s.doc_id""")
def check_rows(t: Testbed):
    return strict(t).select(
        "prompt_id", F.length("response_text").cast("bigint").alias("response_chars"), *COUNTS,
        F.col("strict_pass").alias("checker_pass"), (F.col("num_constraints_checked") != F.col("num_constraints")).alias("count_mismatch"),
    )


@query("checked_rule_rates", VERDICTS + f"""SELECT instruction_id, count(*) AS row_count, {cif('followed')} AS pass_count, {cif('checker_error')} AS checker_error_count FROM verdicts GROUP BY ALL""")
def checked_rule_rates(t: Testbed):
    return c.per_constraint(checked(t)).groupBy("instruction_id").agg(
        F.count("*").alias("row_count"), F.count_if("followed").alias("pass_count"), F.count_if("checker_error").alias("checker_error_count")
    )


SPEC = """'[{"instruction_id":["keywords:palindrome","length_constraints:number_words"],"kwargs":[null,{"num_words":' || doc_id || '}]},{"instruction_id":["punctuation:no_comma"],"kwargs":[]}]'"""


@query("explode_constraints", """SELECT 'd' || doc_id AS prompt_id, i AS constraint_index, (['keywords:palindrome', 'length_constraints:number_words', 'punctuation:no_comma'])[i + 1] AS instruction_id,
 CASE WHEN i = 1 THEN '{"num_words":' || doc_id || '}' ELSE '{}' END AS kwargs_json FROM documents, (SELECT unnest(range(0, 3)) AS i)""")
def explode_constraints(t: Testbed):
    rows = t.table("documents").select(F.expr("'d' || doc_id").alias("prompt_id"), F.expr(SPEC).alias("ground_truth_spec"))
    return c.explode_constraints(rows).withColumn("constraint_index", F.col("constraint_index").cast("bigint"))


@query("recheck_agreement", VERDICTS + f"""SELECT count(*) AS row_count, {cif('doc_id % 10 <> 0')} AS strict_pass_agree, {cif('doc_id % 7 <> 0')} AS followed_count_agree, count(*) AS failed_count_agree,
 {cif('doc_id % 10 <> 0 AND doc_id % 7 <> 0')} AS all_agree FROM strict""")
def recheck_agreement(t: Testbed):
    # Both sides of the join read the verdicts; the rules are run once.
    new = checkpointed(strict(t).select("doc_id", "prompt_id", "strict_pass", "followed_count", "failed_count"))
    d = F.col("doc_id")
    stored = new.withColumn("strict_pass", F.when(d % 10 == 0, ~F.col("strict_pass")).otherwise(F.col("strict_pass"))).withColumn(
        "followed_count", F.when(d % 7 == 0, F.col("followed_count") + 1).otherwise(F.col("followed_count"))
    )
    return c.recheck_agreement(stored, new)


def _several(t: Testbed, rules) -> DataFrame:
    """Every document against every listed rule: a fixed fan-out inside the row."""
    items = ", ".join(
        "named_struct('instruction_id', '{}', 'kwargs_json', {})".format(
            r, f"to_json(named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {e}' for n, e in PROBES[r][1].items())}))" if PROBES[r][1] else "'{}'"
        )
        for r in rules
    )
    return t.texts("doc_id", "text", "lang").select(
        F.expr("sha2('doc:' || doc_id, 256)").alias("prompt_id"), F.col("text").alias("response_text"), F.expr(f"array({items})").alias("constraints")
    )


@query("shadow_agreement", "SELECT r AS instruction_id, (SELECT count(*) FROM documents) AS row_count, (SELECT count(*) FROM documents) AS agree_count, 1.0::DOUBLE AS agreement_rate "
       "FROM (SELECT unnest(['" + "', '".join(SHADOWS) + "']) AS r)")
def shadow_agreement(t: Testbed):
    rows = c.run_checks(_several(t, SHADOWS), rules=SHADOWS)
    both = rows.select("response_text", F.inline_outer("verdicts")).filter(F.col("constraint_index").isNotNull()).select(
        "instruction_id", "followed",
        F.coalesce(shadow_check(F.col("instruction_id"), F.col("response_text"), F.col("kwargs_json")), F.lit(False)).alias("shadow"),
    )
    return c.agreement_by_rule(both, "followed", "shadow")


SMOKE_SQL = {
    "change_case:english_capital": r"NOT regexp_matches(text, '\p{Ll}')",
    "change_case:english_lowercase": r"NOT regexp_matches(text, '\p{Lu}')",
    "detectable_format:title": "regexp_matches(text, '<<[^<>]+>>')",
    "keywords:exclude_word_harder": "NOT contains(lower(text), 'and')",
    "keywords:existence": "contains(lower(text), 'the') AND contains(lower(text), 'of')",
    "keywords:forbidden_words": "NOT (contains(lower(text), 'whou') OR contains(lower(text), 'été') OR contains(lower(text), 'onen'))",
    "last_word:last_word_answer": "coalesce(lower(regexp_extract_all(text, '[A-Za-z0-9'']+')[-1]) = 'end', false)",
    "punctuation:no_comma": "NOT contains(text, ',')",
    "startend:end_checker": "suffix(rtrim(text, ' ' || chr(10)), CASE WHEN doc_id % 2 = 0 THEN '.' ELSE 'EN.' END)",
    "startend:quotation": f"length({q.strip('text')}) >= 2 AND starts_with({q.strip('text')}, '\"') AND suffix({q.strip('text')}, '\"')",
}


@query("smoke_checks", " UNION ALL ".join(
    f"SELECT '{r}' AS instruction_id, sha256('doc:' || doc_id) AS prompt_id, {SMOKE_SQL[r]} AS followed FROM documents" for r in SMOKE))
def smoke_checks(t: Testbed):
    rows = _several(t, SMOKE).select("prompt_id", "response_text", F.inline("constraints"))
    return rows.select(
        "instruction_id", "prompt_id", smoke_check(F.col("instruction_id"), F.col("response_text"), F.col("kwargs_json")).alias("followed")
    )


@query("smoke_pass", "WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, {SMOKE_SQL[r]} AS followed FROM documents" for r in ("punctuation:no_comma", "keywords:existence"))
       + ") SELECT doc_id % 10 AS bucket, count(*) AS row_count, CAST(count_if(ok) AS BIGINT) AS pass_count FROM (SELECT doc_id, bool_and(followed) AS ok FROM s GROUP BY doc_id) GROUP BY ALL")
def smoke_pass(t: Testbed):
    rules = ("punctuation:no_comma", "keywords:existence")
    rows = _several(t, rules).join(t.table("documents").select(F.expr("sha2('doc:' || doc_id, 256)").alias("prompt_id"), "doc_id"), "prompt_id")
    # Verdicts stay inside the row: two rules per response, no regrouping of texts.
    verdicts = [smoke_check(F.lit(r), F.col("response_text"), F.get("constraints", F.lit(i))["kwargs_json"]) for i, r in enumerate(rules)]
    return rows.select((F.col("doc_id") % 10).alias("bucket"), (verdicts[0] & verdicts[1]).alias("ok")).groupBy("bucket").agg(
        F.count("*").alias("row_count"), F.count_if("ok").alias("pass_count")
    )


__all__ = ["checked", "responses", "rounded"]
