"""Steps that run once per text, and once per text only."""

from pyspark.sql import functions as F

from rulespan.functions import alternatives, rules, text as tx


def test_white_space_is_one_property_and_the_same_characters(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in [*codes, 0x1F600, 0x20000]], "code int, c string")
    found = rows.select("code", F.col("c").rlike(f"^{tx.WS}$").alias("ws"), F.col("c").rlike(f"^{tx.NOT_WS}$").alias("other"))
    got = found.collect()
    assert {r.code for r in got if r.ws} == set(tx.SPACE_CODES) and all(r.ws != r.other for r in got)
    assert tx.WS.count("-") == 0  # no list of ranges to ask for every character


def test_a_language_vote_reads_the_text_once(spark):
    df = spark.createDataFrame([("the of and 𝐀the", )], "v string")
    plan = df.select(tx.detected_language(F.col("v")).alias("l"))._jdf.queryExecution().analyzed().toString()
    # Function words are looked up, not searched language by language.
    assert "(?<!" not in plan
    assert df.select(tx._vote(F.col("v"), ("en", "de")).alias("l")).first().l == "en"


def test_sentences_of_a_part_are_cut_once():
    t = rules.Response(*map(F.col, ("a", "b", "c", "d", "e", "g")))
    args = rules.Args(F.col("k"), F.col("n"))
    shown = str(rules.RULES["count:counting_composition"].follow(t, args))
    assert shown.count("Prof|Capt") == 2  # two starter patterns, in one splitter


def test_edges_are_trimmed_without_a_search_at_every_character(spark):
    values = ["", "  ", " a b\n", "a", " x \x1c", "\n\n'q' .", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    trimmed = alternatives._edge_trimmed(F.col("v"))
    assert "regexp_replace" not in str(trimmed)
    assert [r.t for r in df.select(trimmed.alias("t")).collect()] == [v if v is None else v.strip() for v in values]
