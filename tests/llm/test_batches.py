"""The pipeline bounds the texts in one Arrow batch, what its workers keep, and the files of a round."""

import corpus_pipeline
import public_tokenizers
from rulespan.llm import bpe, components
from rulespan.llm.common import TEXTS_PER_BATCH, small_batches, stored

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_take_small_batches_and_leave_smaller_ones(spark):
    before = spark.conf.get(KEY)
    try:
        docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        corpus_pipeline.pii_redaction(spark, docs, "")
        assert int(spark.conf.get(KEY)) == TEXTS_PER_BATCH
        spark.conf.set(KEY, "7")
        assert small_batches(spark).conf.get(KEY) == "7"
    finally:
        spark.conf.set(KEY, before)


def test_words_a_task_has_met_do_not_stay_with_its_worker():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    with bpe.borrowed(source) as c:
        ids = c.encode("links of words")
        assert set(c._cache) >= {"links", "words"}
    assert not bpe.codec(source)._cache
    assert bpe.codec(source).encode("links of words") == ids


def test_a_round_of_components_writes_as_many_files_as_its_links_need(spark, monkeypatch):
    files = []

    def counted(df, name):
        out = stored(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "stored", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        chains = [(i, i + 1) for i in range(0, 3000) if i % 5 < 4]
        got = {r.node: r.component for r in components.connected(spark.createDataFrame(chains, "a bigint, b bigint"), "a", "b").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 5 for i in range(3000)}
    assert len(files) > 2 and max(files[1:]) <= components.LEAST_FILES
