"""Models over rows whose terms are cut and looked up once."""

import collections
import random

import numpy as np
import pyarrow as pa

from rulespan.operators import models as ml
from rulespan.operators import terms


def test_any_letters_are_cut_as_python_cuts_them():
    rnd = random.Random(6)
    # Enough different letters that five of them do not fit one number.
    rows = [["".join(chr(rnd.choice([rnd.randrange(97, 100), rnd.choice([rnd.randrange(0x4E00, 0xD7FF), rnd.randrange(0x10000, 0x1FFFF)])])) for _ in range(rnd.randrange(1, 9))) for _ in range(400)] for _ in range(20)]
    got = terms.char_grams(3, 5)(pa.array(rows))
    want = collections.Counter()
    for i, row in enumerate(rows):
        for w in row:
            p = f" {w} "
            want.update((i, p[a : a + k]) for k in (3, 4, 5) for a in range(len(p) - k + 1))
    row, term, tf = got.entries()
    assert {(r, got.terms[t].as_py()): n for r, t, n in zip(row.tolist(), term.tolist(), tf.tolist())} == want
    assert got.totals().sum() == sum(want.values()) and len(got.terms) == len({t for _, t in want})


def test_terms_are_found_by_their_text(monkeypatch):
    some = [f"t{i}" for i in range(500)] + ["", "é" * 9, "ab", "ba"]
    asked = pa.array(some[::2] + ["x", "t1 ", "", "bb"])
    want = [sorted(some).index(x) if x in some else -1 for x in asked.to_pylist()]
    for hashes in (terms._hashes, lambda found: np.zeros(len(found), np.uint64)):
        monkeypatch.setattr(terms, "_hashes", hashes)
        known = terms.Known(pa.array(sorted(some)), np.arange(len(some)), np.ones(len(some)))
        assert known.places(asked).tolist() == want


def test_tokens_meet_labels_once_and_a_fit_has_few_parts(spark, monkeypatch):
    seen, fit = [], ml.fit_logistic
    monkeypatch.setattr(ml, "fit_logistic", lambda df, **more: seen.append(df.rdd.getNumPartitions()) or fit(df, **more))
    rows = spark.createDataFrame([(i, "train" if i % 4 else "test", i % 2) for i in range(120)], "k bigint, split string, label int")
    tokens = spark.createDataFrame([(i, ["a", "b" if i % 2 else "c"]) for i in range(120)], "k bigint, tokens array<string>")
    cores = spark.sparkContext.defaultParallelism
    _, vocabulary, scored = ml.row_model(rows, tokens.repartition(5 * cores), "k", terms.words, "string", 1, 1.0, 100)
    assert seen[0] <= cores and vocabulary.count() == 3
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.filter("pred_label <> label").count() == 0 and scored.count() == 120
    many = rows.repartition(40)
    assert [ml.few_parts(many, n).rdd.getNumPartitions() for n in (0, 20 * ml.ENTRIES)] == [cores, 20]
