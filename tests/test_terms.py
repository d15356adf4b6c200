"""Terms counted inside the rows against plain counting."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulespan.operators import features as f
from rulespan.operators import terms


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(terms, "TOKENS", 40)


def texts(n=60, seed=5):
    rnd = random.Random(seed)
    some = ["the", "of", "été", "abab", "a", "xyzzy", "ß"]
    rows = [(i, " ".join(rnd.choices(some, k=rnd.randrange(0, 25)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "abab " * 300), (3, "of of"), (None, "the"), (None, "the a")]


def test_char_grams_are_counted_without_a_shuffle_by_document(spark, small_slices):
    df = spark.createDataFrame(texts(), "doc_id bigint, text string")
    got = f.char_gram_frequency(df, "doc_id", "text")
    want = f.document_frequency(f.char_term_counts(df, "doc_id", "text"))
    rows = [{r.term: (r.df, r.cf) for r in x.collect()} for x in (got, want)]
    assert rows[0] == rows[1]
    # Nothing is exchanged by document and term where no id repeats.
    unique = f.char_gram_frequency(df.filter("doc_id <> 3"), "doc_id", "text")
    plan = unique._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan.split("MapInArrow")[0] and "Generate" not in plan


def test_slices_hold_few_tokens_or_one_row():
    batch = pa.RecordBatch.from_pydict({"w": pa.array([["a"] * n for n in (0, 1, terms.TOKENS + 5, 3, 0)] + [None])})
    assert [x.num_rows for x in terms._slices([batch], "w")] == [2, 1, 3]


def test_counters_by_hand():
    values = pa.array([["a", "b", "a", None, "b"], [], None, ["b", "b"]])
    got = terms.words_and_chars(3, 5)(values)
    seen = {(int(r), got.terms[int(t)].as_py()): int(n) for r, t, n in zip(got.row, got.term, got.tf)}
    assert seen == {
        (0, " a "): 2, (0, " b "): 2, (0, "w:a"): 2, (0, "w:b"): 2, (0, "w:a b"): 1, (0, "w:b a"): 1,
        (3, " b "): 2, (3, "w:b"): 2, (3, "w:b b"): 1,
    }
    assert collections.Counter(got.row.tolist()) == {0: 6, 3: 3}


def test_the_most_frequent_terms_whatever_the_filter_lets_pass(spark, small_slices, monkeypatch):
    monkeypatch.setattr(terms, "CELLS", 64)  # many terms share a cell
    rnd = random.Random(8)
    rows = [(i, [min(int(rnd.expovariate(0.2)), 50) for _ in range(rnd.randrange(0, 30))]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>")
    counts = df.select("doc_id", F.inline(f.vocabulary.ngram_counts(F.col("tokens"), 1, 3)))
    for most in (1, 7, 100, 10_000):
        found = terms.frequent(df, "tokens", terms.id_ngrams(1, 3), 80, 2, 0.9, most, "bigint")
        got, want = (f.number_terms(x, most).select("term", "df", "cf", "feature") for x in (found, f.select_terms(counts, 80, 2, 0.9)))
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0


def test_weights_and_vectors_match_the_joined_form(spark, small_slices):
    rows = [(i, t.split()) for i, t in texts()[:60]]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    counts = f.term_counts(df, "doc_id", F.col("tokens"))
    kept = f.number_terms(f.select_terms(counts, 60, 2), 5)
    want = {(r.doc_id, r.term): (r.tf, r.weight) for r in f.tfidf(counts, kept, "doc_id", 60).collect()}
    shared = terms.known(kept, f.idf(60, F.col("df")))
    got = {(r.doc_id, r.term): (r.tf, r.weight) for r in terms.weights(df, "doc_id", "tokens", terms.words, shared).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    feature = {r.term: r.feature for r in kept.collect()}
    for r in terms.vectors(df, "tokens", terms.words, shared, 5).collect():
        assert dict(zip(r.features.indices.tolist(), r.features.values.tolist())) == {feature[t]: got[d, t][1] for d, t in got if d == r.doc_id}


def test_no_text_at_all(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, tokens array<string>")
    found = terms.frequent(df, "tokens", terms.words, 2, 2, 1.0, 10)
    assert found.count() == 0
    shared = terms.known(f.number_terms(found, 10), f.idf(2, F.col("df")))
    assert terms.weights(df, "doc_id", "tokens", terms.words, shared).count() == 0


def test_encoding_by_parts_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in texts() if i is not None], "doc_id bigint, text string").coalesce(1)
    whole = [list(r.input_ids or []) for r in f.encode_column(df, "text", [(70, 71), (71, 72)]).collect()]
    monkeypatch.setattr(f.vocabulary, "ENCODED", 3)
    assert [list(r.input_ids or []) for r in f.encode_column(df, "text", [(70, 71), (71, 72)]).collect()] == whole
