"""Rule checks over responses.

Every constraint of a row is checked inside that row: the constraints are an array, and one ``transform`` yields an
array of verdicts. No shuffle is needed for the strict label, and the response text is never copied per constraint.
The child table (one row per constraint) is an ``explode`` of the verdict array, after the text is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from rulespan.functions import text as tx
from rulespan.functions.regex import regex_hits
from rulespan.functions.rules import ARGUMENT_TYPES, REGISTERED, RULES, Args, Response

SPEC = "array<struct<instruction_id:array<string>,kwargs:array<string>>>"
_ARGUMENTS = "struct<" + ",".join(f"`{n}`:{t}" for n, t in sorted(ARGUMENT_TYPES.items()) if n != "N") + ">"

# Fixed value: text of the two error messages that do not depend on the data.
_MESSAGES = {
    "MissingParameter": "a rule argument is absent; the original check would draw a random one",
    "error": "invalid regular expression",
}


def constraints_of(spec: Column) -> Column:
    """Flatten a specification (JSON text) to an array of (instruction_id, kwargs_json), in order."""
    items = F.from_json(spec, SPEC)

    def pairs(item: Column) -> Column:
        return F.transform(
            F.coalesce(item["instruction_id"], F.array().cast("array<string>")),
            lambda name, i: F.struct(
                name.alias("instruction_id"),
                F.coalesce(F.nullif(F.get(item["kwargs"], i), F.lit("null")), F.lit("{}")).alias("kwargs_json"),
            ),
        )

    return F.flatten(F.transform(items, pairs))


def explode_constraints(df: DataFrame, spec: str = "ground_truth_spec", key: str = "prompt_id") -> DataFrame:
    return df.select(key, F.posexplode(constraints_of(F.col(spec))).alias("constraint_index", "c")).select(
        key, "constraint_index", "c.instruction_id", "c.kwargs_json"
    )


def _chain(branches: Iterable[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def _by_rule(name: Column, per_rule: dict[str, Column], default: Column) -> Column:
    """CASE on the family first, then on the id inside the family."""
    families: dict[str, list[str]] = {}
    for rule in per_rule:
        families.setdefault(rule.partition(":")[0], []).append(rule)
    family = F.substring_index(name, ":", 1)
    return _chain(
        (
            (family == F.lit(f), _chain(((name == F.lit(r), per_rule[r]) for r in rules), default))
            for f, rules in families.items()
        ),
        default,
    )


def _verdict(rule_name: str, t: Response, c: Column) -> Column:
    rule = RULES[rule_name]
    k = Args(c["arguments"], c["upper_n"])
    unexpected = F.exists(c["keys"], lambda n: ~n.isin(*rule.keys)) if rule.keys else F.size(c["keys"]) > 0
    branches = [(unexpected, F.lit("TypeError"))]
    branches += [(fault(t, k), F.lit(kind)) for kind, fault in rule.faults]
    if rule.missing is not None:
        branches.append((rule.missing(k), F.lit("MissingParameter")))
    follow = rule.follow(t, k)
    if rule.patterns is not None:
        hits = c["hits"]
        branches.append((F.coalesce(F.exists(hits, lambda h: h["n"] < 0), F.lit(False)), F.lit("error")))
        follow = F.when(hits.isNotNull(), rule.follow_hits(t, k, hits)).otherwise(follow)
    branches.append((F.coalesce(follow, F.lit(False)), F.lit("pass")))
    return _chain(branches, F.lit("fail"))


_POSTSCRIPT = "detectable_content:postscript"
_NO_STRINGS = "array<string>"


@lru_cache(maxsize=64)
def _wanted_patterns(names: tuple[str, ...]) -> Column:
    """Per constraint the regexes Python has to search, null where the rule's argument is plain text."""
    none = F.lit(None).cast(_NO_STRINGS)
    return F.transform(
        F.col("_parsed"),
        lambda c: _by_rule(
            c["instruction_id"],
            {n: RULES[n].patterns(Args(c["arguments"], c["upper_n"])).otherwise(none) for n in names},
            none,
        ),
    )


@lru_cache(maxsize=64)
def _judged(names: tuple[str, ...]) -> Column:
    """The verdict of every constraint. Built once per rule set: the expression only names helper columns."""
    t = Response(*map(F.col, ("_value", "_lower", "_words", "_sentences", "_tokens", "_starred")))
    return F.transform(
        F.col("_parsed"),
        lambda c, i: F.struct(
            i.alias("constraint_index"),
            c["instruction_id"].alias("instruction_id"),
            c["kwargs_json"].alias("kwargs_json"),
            _by_rule(
                c["instruction_id"], {n: _verdict(n, t, c) for n in names}, F.lit("KeyError")
            ).alias("verdict"),
        ),
    )


def _spelled(j: Column) -> Column:
    failed = ~j["verdict"].isin("pass", "fail")
    messages = F.create_map(*[F.lit(x) for kv in _MESSAGES.items() for x in kv])
    return F.struct(
        j["constraint_index"].alias("constraint_index"),
        j["instruction_id"].alias("instruction_id"),
        j["kwargs_json"].alias("kwargs_json"),
        (j["verdict"] == "pass").alias("followed"),
        failed.alias("checker_error"),
        F.when(failed, j["verdict"]).otherwise(F.lit("")).alias("checker_error_type"),
        F.when(failed, F.coalesce(messages[j["verdict"]], j["instruction_id"]))
        .otherwise(F.lit(""))
        .alias("checker_error_message"),
    )


def _with_python_matches(work: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Attach the matches of regex arguments. Post-script markers search lower-case text, all others the text."""
    wanted = work.withColumn("_wanted", _wanted_patterns(names)).withColumn(
        "_wanted", F.when(F.exists("_wanted", lambda p: p.isNotNull()), F.col("_wanted"))
    )
    is_low = lambda c: c["instruction_id"] == _POSTSCRIPT
    asked = F.col("_wanted").isNotNull()
    out = wanted.withColumn("_hits", regex_hits(F.when(asked, F.col("_value")), F.col("_wanted")))
    pick = lambda c, i: F.get("_hits", i)
    if _POSTSCRIPT in names:
        low = asked & F.exists("_parsed", is_low)
        out = out.withColumn(
            "_low_hits", regex_hits(F.when(low, F.col("_lower")), F.when(low, F.col("_wanted")))
        )
        pick = lambda c, i: F.when(is_low(c), F.get("_low_hits", i)).otherwise(F.get("_hits", i))
    return out.withColumn(
        "_parsed", F.transform("_parsed", lambda c, i: c.withField("hits", pick(c, i)))
    )


def run_checks(
    df: DataFrame,
    response: str = "response_text",
    constraints: str = "constraints",
    rules: Iterable[str] | None = None,
) -> DataFrame:
    """Add ``verdicts``: array of (constraint_index, instruction_id, kwargs_json, followed, checker_error, ...).

    ``rules`` narrows the dispatch table; an id outside of it is a KeyError verdict, as an unknown id is.
    A faulty constraint becomes an error verdict and never fails the job.
    """
    names = tuple(REGISTERED if rules is None else rules)
    parsed = F.transform(
        F.col(constraints),
        lambda c: F.struct(
            c["instruction_id"].alias("instruction_id"),
            c["kwargs_json"].alias("kwargs_json"),
            F.from_json(c["kwargs_json"], _ARGUMENTS).alias("arguments"),
            F.get_json_object(c["kwargs_json"], "$.N").try_cast("double").alias("upper_n"),
            F.coalesce(F.json_object_keys(c["kwargs_json"]), F.array().cast(_NO_STRINGS)).alias("keys"),
        ),
    )

    # Arrays shared by several rules: built once per response, and only where a constraint of the row needs them.
    def when_used(kind: str, array: Column) -> Column:
        users = [n for n in names if kind in RULES[n].uses]
        if not users:
            return F.lit(None).cast(_NO_STRINGS)
        return F.when(F.exists(F.col(constraints), lambda c: c["instruction_id"].isin(*users)), array)

    v = F.col("_value")
    work = df.withColumns(
        {"_value": F.coalesce(F.col(response), F.lit("")), "_parsed": parsed}
    ).withColumns(
        {
            "_lower": F.lower(v),
            "_words": when_used("words", tx.words(v)),
            "_sentences": when_used("sentences", tx.sentences(v)),
            "_tokens": when_used("tokens", tx.word_tokens(v)),
            "_starred": when_used("starred", tx.paragraphs_starred(v)),
        }
    )
    with_patterns = tuple(n for n in names if RULES[n].patterns is not None)
    if with_patterns:
        work = _with_python_matches(work, with_patterns)
    work = work.withColumn("_judged", _judged(names)).withColumn("verdicts", F.transform("_judged", _spelled))
    return work.select(*df.columns, "verdicts")


def strict_columns(verdicts: Column) -> dict[str, Column]:
    """Counts and the strict label: at least one constraint, no error, none failed."""
    followed = F.size(F.filter(verdicts, lambda r: r["followed"]))
    errors = F.size(F.filter(verdicts, lambda r: r["checker_error"]))
    total = F.size(verdicts)
    return {
        "num_constraints_checked": total,
        "followed_count": followed,
        "failed_count": total - followed,
        "checker_error_count": errors,
        "strict_pass": (total > 0) & (errors == 0) & (followed == total),
    }


def check_rows(checked: DataFrame) -> DataFrame:
    """Parent records: the checked frame plus strict columns."""
    return checked.withColumns(strict_columns(F.col("verdicts")))


def per_constraint(checked: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Child records: one row per constraint, without the text.

    The outer form is used because for the inner one Spark derives the filter ``size(verdicts) > 0`` and pushes it to
    the scan, which runs every check a second time.
    """
    return checked.select(key, F.inline_outer("verdicts")).filter(F.col("constraint_index").isNotNull())


def agreement_by_rule(child: DataFrame, left: str, right: str) -> DataFrame:
    """Per rule, how often two verdict columns agree."""
    agree = F.count_if(F.col(left) == F.col(right))
    return child.groupBy("instruction_id").agg(
        F.count("*").alias("row_count"),
        agree.alias("agree_count"),
        (agree / F.count("*")).alias("agreement_rate"),
    )


def recheck_agreement(stored: DataFrame, recomputed: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Totals of rows whose stored label and counts equal the recomputed ones."""
    columns = ("strict_pass", "followed_count", "failed_count")
    joined = stored.select(key, *columns).join(
        recomputed.select(key, *[F.col(c).alias(f"new_{c}") for c in columns]), key
    )
    same = {c: F.col(c) == F.col(f"new_{c}") for c in columns}
    return joined.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(same[c]).alias(f"{c}_agree") for c in columns],
        F.count_if(same[columns[0]] & same[columns[1]] & same[columns[2]]).alias("all_agree"),
    )
