"""Documents to training tokens in five stages; each stage works on all its predecessor kept.

The stages learn their models from what they are given, so SQL cannot express the whole; tests compare each stage
with a brute-force version. In every stage an empty table gives an empty table, texts of any length are read whole, and
columns other than those of documents are dropped. Rows that repeat id and text are judged alike by stages one, three
and four, kept once by the second, and encoded each for itself by the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespan.llm import bpe, contamination, jaccard, language, pii
from rulespan.llm.common import shipped, small_batches, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those rejected (no text, no letter, far from all centroids) go."""
    small_batches(shipped(spark))
    model = language.fit(docs, ~language.held_out())
    return language.predict(docs, model, list(COLUMNS)).filter("NOT rejected").select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more over five-word shingles hold together.

    The one with the smallest id stays; documents without words are in no group and stay.
    """
    small_batches(spark)
    return jaccard.deduplicated(docs.select(*COLUMNS), n_gram=5, hundredths=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in 20 lies in a benchmark passage."""
    small_batches(spark)
    return contamination.detect(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).filter("NOT contaminated").select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by masks; ``n_chars`` counts the new text."""
    small_batches(spark)
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to.

    Decoding joins vocabulary strings by spaces, so encoding that text again need not give the same ids.
    """
    small_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode(docs, path, keep=("doc_id", "lang", "source"), decoded=True)
    return rows.withColumn("n_tokens", F.size("ids").cast("bigint")).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontaminate),
    ("pii", pii_redaction),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
