"""Byte-pair vocabulary, encoding and the classifier's term tables against plain versions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespan.operators import features as f
from rulespan.operators import models as ml
from rulespan.operators import vocabulary as v
from rulespan.session import content_key, publish, published

SF = "/root/testdata/sf0.001"


def one_pair_at_a_time(counts, merges, min_frequency=2):
    """The plain algorithm: count all pairs, merge the best one everywhere, count again where something changed."""
    ids = v.byte_ids()
    words, n = [[int(ids[b]) for b in w.encode()] for w in counts], list(counts.values())
    pairs, where = collections.Counter(), collections.defaultdict(set)

    def count(i, sign):
        for p in zip(words[i], words[i][1:]):
            pairs[p] += sign * n[i]
            where[p].add(i)

    for i in range(len(words)):
        count(i, 1)
    out = []
    while len(out) < merges:
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < min_frequency:
            break
        new = len(v.SPECIAL_TOKENS) + v.BYTES + len(out)
        out.append(best)
        for i in list(where.pop(best)):
            count(i, -1)
            w, merged, j = words[i], [], 0
            while j < len(w):
                hit = tuple(w[j : j + 2]) == best
                merged.append(new if hit else w[j])
                j += 2 if hit else 1
            words[i] = merged
            count(i, 1)
        pairs = collections.Counter({p: c for p, c in pairs.items() if c > 0})
    return out


def encoded_plainly(piece, merges):
    ids = v.byte_ids()
    w = [int(ids[b]) for b in piece.encode()]
    rank = {p: i for i, p in enumerate(merges)}
    while len(w) > 1:
        best = min(zip(w, w[1:]), key=lambda p: rank.get(p, 1 << 30))
        if best not in rank:
            break
        i = next(i for i in range(len(w) - 1) if (w[i], w[i + 1]) == best)
        w[i : i + 2] = [len(v.SPECIAL_TOKENS) + v.BYTES + rank[best]]
    return w


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()) or [("x", 0)], "pretoken string, frequency bigint").filter("frequency > 0").repartition(3)


@pytest.mark.parametrize("hot, guessed, floor", [(100_000, 512, 16), (40, 7, 16), (100_000, 1, 2), (3, 5, 1)])
def test_merges_are_those_of_one_pair_at_a_time(spark, monkeypatch, hot, guessed, floor):
    monkeypatch.setattr(v, "HOT", hot)
    monkeypatch.setattr(v, "GUESSED", guessed)
    monkeypatch.setattr(v, "FLOOR", floor)
    r = np.random.default_rng(hot + guessed)
    counts = collections.Counter("".join(r.choice(list("abcd é"), r.integers(1, 9))) for _ in range(300))
    counts.update({"aaaaaaa": 40, "aaaa": 30, "ababab": 25, "z": 500, "新しい": 11, "xy": 20, "abc": 90, "once": 1})
    assert v.learn(table(spark, counts), 60) == one_pair_at_a_time(counts, 60)


def test_all_merges_of_the_documents(spark):
    train = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 10 < 7")
    pretokens = f.pretoken_frequency(train, "text").persist()
    counts = {r.pretoken: r.frequency for r in pretokens.collect()}
    got = v.learn(pretokens, 7_739)
    # The plain version scans all pairs for each merge: the first merges by it, all of them by their own counts.
    assert got[:600] == one_pair_at_a_time(counts, 600) and len(got) == 7_739
    words = v.Words(*_flat(counts))
    best = []
    for a in range(0, 7_739, 500):
        done = v.replayed(words, v.Steps(got[:a], 261))
        pairs = collections.Counter()
        inside, whose = np.flatnonzero(done.inside()), np.repeat(np.arange(len(done.length)), done.length)
        for x, y, n in zip(done.symbols[inside], done.symbols[inside + 1], done.n[whose[inside]]):
            pairs[int(x), int(y)] += int(n)
        best.append(min(pairs, key=lambda p: (-pairs[p], p)) == got[a])
    assert all(best)


def _flat(counts):
    raw = [np.frombuffer(w.encode(), np.uint8) for w in counts]
    return v.byte_ids()[np.concatenate(raw)], np.array(list(map(len, raw))), np.array(list(counts.values()))


def test_few_or_no_pretokens(spark):
    assert v.learn(table(spark, {}), 5) == []
    assert v.learn(table(spark, {"a": 9}), 5) == []
    assert v.learn(table(spark, {"ab": 1}), 5) == []
    assert v.learn(table(spark, {"ab": 2}), 5) == [(int(v.byte_ids()[97]), int(v.byte_ids()[98]))]


def test_token_table_and_encoding(spark):
    df = spark.createDataFrame([("a", "low lower lowest"), ("b", "low 新しい"), ("c", ""), ("d", None), ("e", "aaaaa aaaa " * 50)], "id string, v string").repartition(2)
    merges = v.learn(f.pretoken_frequency(df, "v"), 20)
    tokens = v.token_table(spark, merges)
    assert tokens.count() == 5 + 256 + len(merges) and v.merges_of(tokens) == merges
    rows = {r.id: r for r in f.encode_column(df, "v", merges, 3).collect()}
    assert rows["c"].token_count_full == 0 and rows["d"].token_count_full == 0 and rows["a"].truncated and rows["a"].token_count == 3
    text = {r.id: r.token for r in tokens.collect()}
    whole = {r.id: r.input_ids for r in f.encode_column(df, "v", merges, 10_000).collect()}
    assert bytes.fromhex("".join(text[i] for i in whole["b"])).decode() == "low 新しい"
    pieces = {r.id: r.p for r in df.select("id", F.regexp_extract_all(F.coalesce("v", F.lit("")), F.lit(f.PRETOKEN), F.lit(0)).alias("p")).collect()}
    for key, ids in whole.items():
        assert ids == [i for p in pieces[key] for i in encoded_plainly(p, merges)]


def test_queries_learn_the_whole_vocabulary(spark):
    from rulespan.plans import registry

    rows = registry.QUERIES["bpe_merges"](spark, SF)
    assert rows.agg({"id": "max"}).first()[0] == 7_999 and rows.count() == 8_000 - 256 - 5


def test_tables_are_published_under_their_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    key = content_key(df, "i", "t")
    assert content_key(df.orderBy(F.desc("i")), "i", "t") == key != content_key(df.limit(1), "i", "t")
    assert published(spark, "some", key) is None
    assert publish(spark.range(3), "some", key).count() == 3 == published(spark, "some", key).count()
    assert publish(spark.range(5), "some", key).count() == 5 == published(spark, "some", key).count()


def test_ngram_counts_of_token_ids(spark):
    r = np.random.default_rng(3)
    rows = [(i, [int(x) for x in r.integers(0, 6, r.integers(0, 12))]) for i in range(40)] + [(90, None), (91, []), (92, [7_999] * 5)]
    df = spark.createDataFrame(rows, "id int, ids array<int>").repartition(3)
    got = df.select("id", F.inline(v.ngram_counts(F.col("ids"), 1, 3))).withColumn("term", v.ngram_ids(F.col("term"))).collect()
    want = collections.Counter()
    for i, ids in rows:
        for n in (1, 2, 3):
            for a in range(len(ids or ()) - n + 1):
                want[i, " ".join(map(str, ids[a : a + n]))] += 1
    assert {(x.id, x.term): x.tf for x in got} == want
    with pytest.raises(ValueError):
        v.ngram_counts(F.col("ids"), 1, 4)


def test_terms_are_numbered_by_frequency(spark):
    terms = spark.createDataFrame([(t, 2, int(c)) for t, c in zip("abcdefghij", [5, 9, 5, 1, 9, 9, 2, 5, 5, 7])], "term string, df bigint, cf bigint").repartition(4)
    got = {r.feature: r.term for r in f.number_terms(terms, 6).collect()}
    assert got == dict(enumerate("befjac"))


def test_logistic_fit_meets_the_conditions_of_the_optimum(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(200, 3))
    y = (x @ [1.5, -1.0, 0.0] + r.normal(size=200) > 0.8).astype(int)
    df = spark.createDataFrame([([float(c) for c in a], int(b)) for a, b in zip(x, y)], "a array<double>, label int")
    model = ml.fit_logistic(df.select(ml.array_to_vector("a").alias("features"), "label"), c=0.5, max_iter=500)
    w, b = model.coefficients.toArray(), model.intercept
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    slack = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(w / 0.5 + x.T @ slack).max() < 1e-2 and abs(slack.sum()) < 1e-2


def test_a_planted_class_is_learnt_from_token_terms(spark):
    rows = spark.createDataFrame(
        [(i, "train" if i % 3 else "test", i % 2, f"{'good' if i % 2 else 'bad'} words number {i} of this") for i in range(240)],
        "doc_id bigint, split string, label int, text string",
    )
    merges = v.learn(f.pretoken_frequency(rows, "text"), 40)
    ids = f.encode_column(rows, "text", merges)
    counts = ids.select("doc_id", F.inline(v.ngram_counts(F.col("input_ids"), 1, 3)))
    model, terms, scored = ml.text_model(rows.drop("text"), counts, "doc_id", 2, 1.0, 100)
    assert terms.count() == 100 and sorted(r.feature for r in terms.collect()) == list(range(100))
    assert scored.filter("(p_pred > 0.5) <> (label = 1)").count() == 0
    named = ml.coefficient_table(model, terms)
    assert ml.top_coefficients(named, 5).count() == 10 and ml.feature_space(named).first().vocabulary_size == 100
    curve = ml.learning_curve(rows.drop("text"), counts, "doc_id", [40, None], 42, 2, 100).collect()
    assert {r.train_size_label for r in curve} == {"40", "full"} and all(r.auroc > 0.95 for r in curve)
