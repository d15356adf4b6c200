"""Raw prompt rows to the normalised prompt table, and row-level derivations around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulespan.functions import text as tx
from rulespan.functions.columns import LENGTH_BINS, is_context_error, token_bin  # noqa: F401
from rulespan.functions.literals import parse_spec

FAMILY_END = ":"


def prompt_id(messages: Column, ground_truth: Column, constraint: Column) -> Column:
    """SHA-256 of the canonical JSON of a row: keys in alphabetical order, compact, nulls kept."""
    body = F.struct(
        constraint.alias("constraint"),
        ground_truth.alias("ground_truth"),
        F.transform(
            F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")),
            lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")),
        ).alias("messages"),
    )
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def flatten_prompt(messages: Column) -> Column:
    """The one user message, or all messages as ``role: content`` lines; empty without messages."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    lines = F.transform(
        messages,
        lambda m: F.concat(F.coalesce(m["role"], F.lit("unknown")), F.lit(": "), F.coalesce(m["content"], F.lit(""))),
    )
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "")
        .when(F.size(users) == 1, F.coalesce(F.get(users, F.lit(0))["content"], F.lit("")))
        .otherwise(F.array_join(lines, "\n"))
    )


def family(instruction_id: Column) -> Column:
    return F.substring_index(instruction_id, FAMILY_END, 1)


def signature(ids: Column) -> Column:
    """Sorted ids joined by a bar, repeats kept."""
    return F.array_join(F.array_sort(ids), "|")


def family_signature(ids: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(ids, family)), "|")


def normalize(raw: DataFrame) -> DataFrame:
    """key, messages, ground_truth, dataset, constraint_type, constraint -> the prompt table plus parse status."""
    parsed = raw.withColumn("_p", parse_spec(F.col("ground_truth")))
    ids = F.col("_p.instruction_ids")
    return parsed.select(
        prompt_id(F.col("messages"), F.col("ground_truth"), F.col("constraint")).alias("prompt_id"),
        F.col("key").alias("base_key"),
        F.col("messages").alias("raw_messages"),
        flatten_prompt(F.col("messages")).alias("user_prompt"),
        F.col("constraint").alias("constraint_text"),
        F.col("_p.ground_truth_spec").alias("ground_truth_spec"),
        ids.alias("instruction_ids"),
        signature(ids).alias("constraint_signature"),
        family_signature(ids).alias("constraint_family_signature"),
        F.size(ids).alias("num_constraints"),
        F.col("dataset").alias("source_dataset"),
        "constraint_type",
        F.col("_p.parse_ok").alias("parse_ok"),
        F.col("_p.parse_error").alias("parse_error"),
    )


def key_family(key: Column) -> Column:
    """Key without its trailing numbers, ``<missing>`` when blank."""
    cut = F.regexp_replace(tx.strip(F.coalesce(key, F.lit("<missing>"))), r"([_:\-#]\d+)+$", "")
    return F.when(tx.strip(F.coalesce(key, F.lit("x"))) == "", "<missing>").otherwise(cut)


def split_ids(text: Column) -> Column:
    """Instruction ids in a signature: bar-separated, or found by pattern when the text looks like a list."""
    parts = F.filter(F.split(text, r"\|"), lambda p: p != "")
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z_]+:[A-Za-z0-9_]+"), F.lit(0))
    return F.when(text.contains("|") & ~text.contains("["), parts).otherwise(
        F.coalesce(found, F.array().cast("array<string>"))
    )


def output_flags(df: DataFrame, max_tokens: int = 1024, context_limit: int = 4096, error_chars: int | None = None) -> DataFrame:
    """Flags of a generation record from its token counts, finish reason and error text, which stays whole.

    ``error_chars`` cuts the error text, for tables that are only looked at.
    """
    error = F.coalesce(F.col("error"), F.lit(""))
    tokens = F.when(F.col("ok"), F.col("output_tokens"))
    hit = F.coalesce(tokens >= max_tokens, F.lit(False))
    reason = F.coalesce(F.col("finish_reason"), F.lit(""))
    cut = (reason == "length") | hit
    total = F.col("prompt_tokens") + max_tokens
    return df.withColumns(
        {
            "output_tokens": tokens,
            "output_hit_max_tokens": hit,
            "output_truncated": cut,
            "output_limit_status": F.when(cut, "truncated").otherwise("completed"),
            "prompt_plus_max_output_tokens": total,
            "within_context_budget": total <= context_limit,
            "context_window_error": is_context_error(F.col("ok"), F.col("error")),
            "error": error if error_chars is None else F.substring(error, 1, error_chars),
        }
    )


def length_filter_audit(df: DataFrame, tokens: str, truncated: str, limit: int, facets: list[str]) -> DataFrame:
    """Rows before, after and removed by ``tokens <= limit and not truncated``, per facet value, with maxima."""
    kept = (F.col(tokens) <= limit) & ~F.col(truncated)
    return df.groupBy(*facets).agg(
        F.count("*").alias("rows_before"),
        F.count_if(kept).alias("rows_after"),
        F.count_if(~kept).alias("rows_removed"),
        F.max(tokens).alias("max_before"),
        F.max(F.when(kept, F.col(tokens))).alias("max_after"),
    )


def clip(value: Column, limit: int, marker: str) -> Column:
    """Cut long text; ``{omitted}`` in the marker becomes the number of characters left out."""
    before, slot, after = marker.partition("{omitted}")
    tail = F.concat(F.lit(before), (F.length(value) - limit).cast("string"), F.lit(after)) if slot else F.lit(marker)
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.substring(value, 1, limit), tail))


def shorten(value: Column, width: int, placeholder: str = "...") -> Column:
    """White space collapsed; whole words kept while they and the placeholder fit the width."""
    flat = tx.strip(F.regexp_replace(value, tx.WS + "+", " "))
    room = width - len(placeholder)
    kept = F.regexp_extract(flat, rf"(?s)\A(.{{0,{room}}})(?:\s|\z)", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(tx.strip(kept), F.lit(placeholder)))


def strip_line_ends(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"(?m)[ \t\x0b\f\r]+$|\n\z", "")


def constraint_rollup(child: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Per prompt the ordered verdict text and the failed-only text. A prompt has a handful of constraints."""
    rows = child.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("constraint_index", "followed", "instruction_id", "kwargs_json"))).alias("c")
    )

    def line(c: Column, with_status: bool) -> Column:
        status = [F.when(c["followed"], "PASS").otherwise("FAIL")] if with_status else []
        return F.concat(
            F.concat_ws(":", c["constraint_index"].cast("string"), *status, c["instruction_id"]),
            F.lit(" kwargs="),
            c["kwargs_json"],
        )

    failed = F.filter("c", lambda c: ~c["followed"])
    return rows.select(
        key,
        F.array_join(F.transform("c", lambda c: line(c, True)), " | ").alias("constraint_summary"),
        F.when(F.size(failed) == 0, "none")
        .otherwise(F.array_join(F.transform(failed, lambda c: line(c, False)), " | "))
        .alias("failed_summary"),
    )


def has_invalid_nth(kwargs_json: Column) -> Column:
    """The wanted paragraph lies beyond the number of paragraphs."""
    nth = F.get_json_object(kwargs_json, "$.nth_paragraph").try_cast("int")
    count = F.get_json_object(kwargs_json, "$.num_paragraphs").try_cast("int")
    return F.coalesce(nth > count, F.lit(False))


def curve_label(label: Column) -> Column:
    """Spellings of the largest training size collapse to ``full``; a ``train_`` prefix is dropped."""
    return F.when(label.isin("80k", "80k/full", "train_80k"), "full").otherwise(
        F.replace(label, F.lit("train_"), F.lit(""))
    )


def size_of_label(label: Column) -> Column:
    """``40k`` -> 40000, plain numbers as they are, ``full`` -> null."""
    thousands = F.regexp_extract(F.lower(label), r"^(\d+)k$", 1)
    return F.when(thousands != "", thousands.try_cast("bigint") * 1000).otherwise(label.try_cast("bigint"))


def standard_predictions(df: DataFrame, renames: dict[str, str], run: dict[str, object]) -> DataFrame:
    """Model-specific prediction columns to the common names, run columns added, validation and test rows kept."""
    out = df.withColumnsRenamed(renames).filter(F.col("split").isin("val", "test"))
    return out.withColumns(
        {**{n: F.lit(v) for n, v in run.items()}, "pred_label": (F.col("p_pred") >= 0.5).cast("int")}
    )
