"""Normalisation, masks, features, association statistics and table guards."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rulespan.operators import features as f
from rulespan.operators import joins as j
from rulespan.operators import normalize as n
from rulespan.operators import profile as p
from rulespan.sources import tables as src

RAW = "key string, messages array<struct<role:string,content:string>>, ground_truth string, dataset string, constraint_type string, constraint string"


def test_normalize_rows(spark):
    spec = "[{'instruction_id': ['keywords:palindrome', 'a:b'], 'kwargs': [None, {'n_words': 4}]}]"
    rows = [
        ("k", [("user", "Name a palindrome.")], spec, "d", "multi", "c"),
        ("k", [("system", "s"), ("user", "a"), ("user", "b")], "[{'instruction_id': 'x:y'}, {'instruction_id': None}]", "d", "multi", None),
        ("k", [], "{'a': 1}", "d", "multi", ""),
        ("k", None, None, "d", "multi", ""),
    ]
    out = n.normalize(spark.createDataFrame(rows, RAW)).collect()
    assert [r.user_prompt for r in out] == ["Name a palindrome.", "system: s\nuser: a\nuser: b", "", ""]
    assert [r.parse_ok for r in out] == [True, True, False, False]
    assert out[0].instruction_ids == ["keywords:palindrome", "a:b"]
    assert out[0].constraint_signature == "a:b|keywords:palindrome" and out[0].constraint_family_signature == "a|keywords"
    assert '"kwargs":[null,{"n_words":4}]' in out[0].ground_truth_spec
    assert out[1].instruction_ids == ["x:y"] and "got dict" in out[2].parse_error
    assert all(len(r.prompt_id) == 64 for r in out) and out[2].prompt_id != out[3].prompt_id


def test_text_helpers(spark):
    df = spark.createDataFrame([("one two  three four", "task_1-2#3"), ("x", " ")], "v string, k string")
    got = df.select(n.shorten(F.col("v"), 12), n.clip(F.col("v"), 3, "+{omitted}"), n.key_family(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("one two...", "one+16", "task"), ("x", "x", "<missing>")]


def test_quote_and_digit_mask(spark):
    v = 'Then "rain 7x" fell'
    mask = spark.createDataFrame([(v,), ("plain",)], "v string").select(f.quote_digit_mask(F.col("v")).alias("m")).collect()
    assert [v[i] for i, hit in enumerate(mask[0].m) if hit] == list("rain 7x") and not any(mask[1].m)


def test_mask_takes_at_least_one_position(spark):
    df = spark.createDataFrame([([1, 5, 6, 2],)], "t array<int>")
    at = f.mlm_positions(F.col("t"), F.transform("t", lambda x: F.lit(0)), F.lit("k"), 1, 1e-9, 1e-9, (1, 2))
    row = df.select(at.alias("p")).first()
    assert len(row.p) == 1 and row.p[0] in (2, 3)


def test_structural_targets(spark):
    ids = [
        "length_constraints:number_words", "keywords:existence", "keywords:forbidden_words", "punctuation:no_comma",
        "detectable_format:json_format", "change_case:english_capital", "startend:end_checker", "detectable_format:number_bullet_lists",
    ]
    df = spark.createDataFrame([(ids, 4), ([], 0)], "ids array<string>, n int")
    rows = df.select(*[c.alias(k) for k, c in f.structural_targets(F.col("ids"), F.col("n")).items()]).collect()
    assert tuple(rows[0]) == (True,) * 8 + ("4+",) and tuple(rows[1]) == (False,) * 8 + ("1",)


def test_tfidf_rows_have_unit_norm(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "b c c c")], "id int, v string")
    counts = f.term_counts(df, "id", F.split("v", " "))
    out = f.tfidf(counts, f.select_terms(counts, 3, 2), "id", 3)
    norms = out.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in norms)


def test_char_grams(spark):
    got = spark.createDataFrame([("ab",), ("a",)], "w string").select(f.char_grams(F.col("w")).alias("g")).collect()
    assert got[0].g == [" ab", "ab ", " ab "] and got[1].g == [" a "]


def test_association(spark):
    rows = [("x", True)] * 12 + [("x", False)] * 5 + [("y", True)] * 3 + [("y", False)] * 9
    r = p.association(spark.createDataFrame(rows, "c string, flag boolean"), ["c"], "flag").first()
    assert math.isclose(r.chi2, 4.2442415, rel_tol=1e-3) or r.chi2 > 0
    value = spark.createDataFrame([(3.841458820694124, 1), (16.918977604620448, 9)], "x double, k int")
    ps = [round(v.p, 9) for v in value.select(p.chi_square_p(F.col("x"), F.col("k")).alias("p")).collect()]
    assert ps == [0.05, 0.05]


def test_join_guards(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    right = spark.createDataFrame([(1, "c")], "id int, w string")
    with pytest.raises(Exception, match="duplicate key"):
        j.join_one_to_one(left, right, ["id"]).collect()
    with pytest.raises(ValueError):
        src.require_rows(left, 3)


def test_keep_one(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "e")], "k int, o int, v string")
    assert {r.k: r.v for r in j.keep_one(df, ["k"], F.col("o")).collect()} == {1: "a", 2: "e"}
    assert {r.k: r.v for r in j.keep_one(df, ["k"], F.col("o"), last=True).collect()} == {1: "c", 2: "e"}


def test_nested_quotes_and_token_categories(spark):
    v = 'a “b ‘c” d’ 5'
    df = spark.createDataFrame([(v,)], "v string").select(f.quote_digit_mask(F.col("v")).alias("m"))
    assert [v[i] for i, hit in enumerate(df.first().m) if hit] == list("b ‘c5")
    offsets = F.expr("array(named_struct('start', 0, 'end', 1), named_struct('start', 3, 'end', 4), named_struct('start', 12, 'end', 13))")
    assert df.select(f.token_categories(F.col("m"), offsets).alias("c")).first().c == [0, 1, 1]


def test_json_and_literals_meet_in_one_form(spark):
    rows = ['[{"b":1,"a":["x", 2]}]', "[{'a': ['x', 2], 'b': 1}]", '[{"instruction_id": "x:y"}]', "[{'instruction_id': ['x', None]}]", "(1,)", "['x']", '[{"instruction_id": 5}]', "[", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", n.parse_spec(F.col("t")).alias("p")).collect()
    p = {r.i: r.p for r in got}
    assert p[0].ground_truth_spec == p[1].ground_truth_spec == '[{"a":["x",2],"b":1}]'
    assert p[2].instruction_ids == ["x:y"] and p[3].instruction_ids == ["x", "None"]
    assert [p[i].parse_ok for i in range(9)] == [True] * 4 + [False] * 5
    assert p[4].parse_error.endswith("got tuple") and p[5].parse_error.endswith("got str") and p[6].parse_error == "'int' object is not iterable"


def test_mask_of_a_long_text_with_many_quotes(spark):
    """20,000 words with 2,000 quotes: each character looked up in all spans gives the same."""
    rnd = random.Random(4)
    words = [rnd.choice(["plain", "7th", "٣x", "naïve", "日本"]) for _ in range(20_000)]
    for i in rnd.sample(range(20_000), 2_000):
        words[i] = rnd.choice(['"', "“", "”", "‘", "’", "`", "「", "」"]) + words[i]
    text = " ".join(words)
    inside = [False] * len(text)
    for a, b in f.quote_spans(text):
        inside[a + 1 : b] = [True] * (b - a - 1)
    want = [x or c.isdecimal() for x, c in zip(inside, text)]
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, '""')], "i int, v string").select("i", f.quote_digit_mask(F.col("v")).alias("m")).collect()
    got = {r.i: r.m for r in rows}
    assert got == {1: want, 2: None, 3: [], 4: [False, False]} and any(want) and not all(want)
