import pytest

#: Names the operators use inside, as extra columns that must not disturb them.
CLASHING = ("_k", "_text", "n", "g", "h", "e", "d", "r", "at", "z", "sid", "size", "shard", "slot", "key", "windows", "items", "runs", "score", "rank", "spans", "ids", "component_id", "lang_pred")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table and clashing extra ones."""

    def make(rows, lang=None, extra=True):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        data = [(i, t, lang(i) if lang else None, None, len(t) if t else None) for i, t in rows]
        df = spark.createDataFrame(data, schema).repartition(3)
        if extra:
            for c in CLASHING:
                df = df.withColumn(c, df["text"])
        return df

    return make
