"""Second versions of some rules: an independent one used to cross-check results, and a looser smoke subset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from rulespan.functions import text as tx

# Each takes (response, arguments as JSON text) and is written in another way than the rule it shadows.


def _arg(kwargs: Column, name: str) -> Column:
    return F.get_json_object(kwargs, f"$.{name}")


def _list(kwargs: Column, name: str) -> Column:
    return F.from_json(_arg(kwargs, name), "array<string>")


def _relation(count: Column, kwargs: Column, bound: str) -> Column:
    limit = _arg(kwargs, bound).try_cast("double")
    return F.when(_arg(kwargs, "relation") == "less than", count < limit).otherwise(count >= limit)


def _found(v: Column, keyword: Column) -> Column:
    return F.size(F.split(F.lower(v), F.concat(F.lit(r"\Q"), F.lower(keyword), F.lit(r"\E")), -1)) - 1


def _edge_trimmed(v: Column) -> Column:
    # One pass to the end and back over the blanks there, instead of a search at every character.
    return F.regexp_extract(v, rf"(?s)\A{tx.WS}*+(.*{tx.NOT_WS})?", 1)


SHADOWS: dict[str, Callable[[Column, Column], Column]] = {
    "detectable_format:json_format": lambda v, k: F.get_json_object(
        F.concat(
            F.lit("["),
            F.regexp_replace(_edge_trimmed(v), r"\A(?:```(?:json|Json|JSON))?(?:```)?|```\z", ""),
            F.lit("]"),
        ),
        "$[0]",
    ).isNotNull(),
    "detectable_format:title": lambda v, k: v.rlike(rf"<<[^\n]*[^\n<>{tx.WS[1:-1]}][^\n]*>>"),
    "keywords:existence": lambda v, k: ~F.exists(_list(k, "keywords"), lambda w: _found(v, w) < 1),
    "keywords:forbidden_words": lambda v, k: ~F.arrays_overlap(
        F.split(F.lower(v), r"[^\p{L}\p{N}_]+"), F.transform(_list(k, "forbidden_words"), F.lower)
    ),
    "keywords:frequency": lambda v, k: _relation(_found(v, _arg(k, "keyword")), k, "frequency"),
    "length_constraints:number_words": lambda v, k: _relation(
        F.size(F.filter(F.split(v, r"[^\p{L}\p{N}_]+"), lambda w: w != "")), k, "num_words"
    ),
    "punctuation:no_comma": lambda v, k: F.instr(v, ",") == 0,
    "punctuation:punctuation_dot": lambda v, k: F.instr(v, ".") == 0,
    "punctuation:punctuation_exclamation": lambda v, k: F.instr(v, "!") == 0,
    "startend:end_checker": lambda v, k: F.right(
        F.lower(F.regexp_replace(_edge_trimmed(v), r'\A"+|"+\z', "")), F.length(_edge_trimmed(_arg(k, "end_phrase")))
    )
    == F.lower(_edge_trimmed(_arg(k, "end_phrase"))),
    "startend:quotation": lambda v, k: _edge_trimmed(v).rlike(r'(?s)\A".*"\z'),
}


def shadow_check(rule: Column, response: Column, kwargs: Column) -> Column:
    """Verdict of the independent version; null for rules without one."""
    out = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for name, check in SHADOWS.items():
        out = out.when(rule == name, check(response, kwargs))
    return out


def _last_plain_word(v: Column) -> Column:
    words = F.regexp_extract_all(v, F.lit("[A-Za-z0-9']+"), F.lit(0))
    return F.lower(F.try_element_at(words, F.lit(-1)))


def _plain_absent(v: Column, words: Column) -> Column:
    return F.forall(words, lambda w: ~F.lower(v).contains(F.lower(w)))


SMOKE: dict[str, Callable[[Column, Column], Column]] = {
    "change_case:english_capital": lambda v, k: ~v.rlike(r"\p{Ll}"),
    "change_case:english_lowercase": lambda v, k: ~v.rlike(r"\p{Lu}"),
    "detectable_format:title": lambda v, k: v.rlike("<<[^<>]+>>"),
    "keywords:exclude_word_harder": lambda v, k: _plain_absent(v, F.array(_arg(k, "keyword"))),
    "keywords:existence": lambda v, k: F.forall(
        _list(k, "keywords"), lambda w: F.lower(v).contains(F.lower(w))
    ),
    "keywords:forbidden_words": lambda v, k: _plain_absent(v, _list(k, "forbidden_words")),
    "last_word:last_word_answer": lambda v, k: _last_plain_word(v) == F.lower(_arg(k, "last_word")),
    "punctuation:no_comma": lambda v, k: ~v.contains(","),
    "startend:end_checker": lambda v, k: (F.length(_arg(k, "end_phrase")) > 0)
    & F.rtrim(v, F.lit(tx.SPACE_CHARS)).endswith(_arg(k, "end_phrase")),
    "startend:quotation": lambda v, k: (F.length(tx.strip(v)) >= 2)
    & tx.strip(v).startswith('"')
    & tx.strip(v).endswith('"'),
}


def smoke_check(rule: Column, response: Column, kwargs: Column) -> Column:
    """Looser verdict of ten rules (substring search, case-sensitive end phrase, no language test)."""
    out = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for name, check in SMOKE.items():
        out = out.when(rule == name, F.coalesce(check(response, kwargs), F.lit(False)))
    return out
