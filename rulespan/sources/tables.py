"""Scans, sinks and guards over columnar tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


#: Stored bytes up to which a table in few files is dealt out again.
SMALL_TABLE = 64 << 20


def dealt_out(df: DataFrame, most_bytes: int = SMALL_TABLE) -> DataFrame:
    """A small table in fewer files than cores, dealt out to all cores; any other table as it is.

    One file with one row group is read by one task. The reshuffle is bounded by ``most_bytes`` of stored input, on
    any cluster: a larger table is left to ``spark.sql.files.maxPartitionBytes``.
    """
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    stored = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return df.repartition(cores) if stored <= most_bytes else df


def shard_union(spark: SparkSession, folders: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Rows of many shard folders in one scan, tagged with their folder; missing flags read as false."""
    df = spark.read.option("mergeSchema", "true").parquet(*folders)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.withColumn("generation_dir", folder).withColumns(
        {f: F.coalesce(F.col(f), F.lit(False)) for f in flags}
    )


def text_scan_stats(df: DataFrame, text: str, allowed: DataFrame | None = None, key: str = "prompt_id") -> DataFrame:
    """One row of counts over a text column, optionally inside an id whitelist.

    Distinct texts are counted by digest, so texts themselves are not shuffled.
    """
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    if allowed is not None:
        marked = allowed.select(key).distinct().withColumn("_in", F.lit(True))
        rows = rows.join(marked, key, "left")
    else:
        rows = rows.withColumn("_in", F.lit(True))
    n = F.length("_t")
    chosen = F.coalesce(F.col("_in"), F.lit(False))
    filled = chosen & (n > 0)
    counts = rows.agg(
        F.count("*").alias("row_count"),
        F.count_if(chosen).alias("selected_row_count"),
        F.count_if(filled).alias("non_empty_text_count"),
        F.count_if(chosen & (n == 0)).alias("empty_text_count"),
        F.countDistinct(F.when(filled, F.sha2("_t", 256))).alias("unique_text_count"),
        F.coalesce(F.sum(F.when(filled, n)), F.lit(0)).alias("total_chars"),
        F.coalesce(F.max(F.when(filled, n)), F.lit(0)).alias("max_chars"),
    )
    return counts.withColumn(
        "mean_chars_non_empty",
        F.coalesce(F.round(F.try_divide("total_chars", "non_empty_text_count"), 4), F.lit(0.0)),
    )


def distinct_texts(df: DataFrame, text: str, allowed: DataFrame | None = None, key: str = "prompt_id") -> DataFrame:
    rows = df if allowed is None else df.join(allowed.select(key), key, "left_semi")
    return rows.select(F.col(text).alias("text")).filter(F.length("text") > 0).distinct()


def first_available(
    wanted: DataFrame, sources: Sequence[DataFrame], key: str, fields: Sequence[str], order: Column
) -> DataFrame:
    """Fields of the first source that knows any wanted key; keys it lacks get empty text.

    Inside the chosen source the first row per key (by ``order``) is kept.
    """
    tagged = [
        s.withColumn("_at", F.lit(i)).join(wanted.select(key), key, "left_semi") for i, s in enumerate(sources)
    ]
    found = reduce(DataFrame.unionByName, tagged)
    best = found.agg(F.min("_at"))
    chosen = found.filter(F.col("_at") == best.scalar())
    first = chosen.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("_f"))
    return wanted.join(first, key, "left").select(
        *wanted.columns, *[F.coalesce(F.col(f"_f.{c}"), F.lit("")).alias(c) for c in fields]
    )


_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: What the reader takes an unquoted empty field for; its own default is the empty text, which would make "" a null.
#: The escape of the quote's escape is named because unnamed it is NUL, which would be lost in quoted fields.
_CSV_READ = {"multiLine": True, "nullValue": r"\N", "charToEscapeQuoteEscaping": '"'}


def _texts_replaced(df: DataFrame, pattern: str, by: str) -> DataFrame:
    return df.select(
        *[F.regexp_replace(c, pattern, by).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    )


def write_csv(df: DataFrame, path: str) -> None:
    r"""Result tables as UTF-8 CSV with a header; quotes inside fields are doubled, a null is an empty field, "" an empty text.

    Texts that are backslashes and an N get one more backslash, as ``read_csv`` has ``\N`` for null.
    """
    _texts_replaced(df, r"\A(\\+N)\z", r"\\$1").write.mode("overwrite").options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Every text as ``write_csv`` was given it: null, empty, or with any characters."""
    return _texts_replaced(spark.read.schema(schema).options(**_CSV, **_CSV_READ).csv(path), r"\A\\(\\+N)\z", "$1")


def write_record(record: DataFrame, path: str) -> None:
    """A one-row audit or manifest frame as JSON, null fields kept."""
    record.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_zstd(df: DataFrame, path: str, by: Sequence[str] = (), notes: dict[str, str] | None = None) -> None:
    """Parquet with zstd. ``notes`` are stored with the schema, as column metadata of every column."""
    if notes:
        df = df.select(*[F.col(c).alias(c, metadata=notes) for c in df.columns])
    writer = df.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", True)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Input rows without an output row yet."""
    return inputs.join(done.select(key), key, "left_anti")


def shard_status(inputs: DataFrame, done: DataFrame, index: str, size: int) -> DataFrame:
    """Per shard of ``size`` consecutive indexes: complete shards are skipped, all others run."""
    shard = F.floor(F.col(index) / size).alias("shard")
    want = inputs.groupBy(shard).agg(F.count("*").alias("expected_rows"))
    have = done.groupBy(shard).agg(F.count("*").alias("output_rows"))
    n = F.coalesce(F.col("output_rows"), F.lit(0))
    return want.join(have, "shard", "left").select(
        "shard",
        "expected_rows",
        n.alias("output_rows"),
        F.when(n == F.col("expected_rows"), "skipped_existing").otherwise("run").alias("status"),
    )


def expected_rows(df: DataFrame, expected: int) -> DataFrame:
    """Row-count guard as a one-row status."""
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.lit(expected).cast("bigint").alias("expected_rows"),
        (F.col("row_count") == expected).alias("matches"),
    )


def require_rows(df: DataFrame, expected: int) -> None:
    """Row-count guard that raises."""
    found = df.count()
    if found != expected:
        raise ValueError(f"expected {expected} rows, found {found}")


def newest_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
