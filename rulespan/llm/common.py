"""Helpers the operators of this package share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulespan.session import shared_folder

#: An absent doc_id sorts behind all others wherever the smallest id decides.
LAST_ID = (1 << 63) - 1


@cache
def _archive() -> str:
    """This library as one file, for executors that do not have it."""
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "rulespan_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return str(path)


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this library on the path of its Python workers (the driver serves the archive)."""
    sc = spark.sparkContext
    if Path(_archive()).name not in getattr(sc, "_python_includes", []):
        sc.addPyFile(_archive())
    return spark


#: Whole texts in one Arrow batch. It lies in memory up to four times in each task: on both sides, going in and out.
TEXTS_PER_BATCH = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most ``TEXTS_PER_BATCH`` rows; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXTS_PER_BATCH:
        spark.conf.set(_BATCH, str(TEXTS_PER_BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets Spark delete a query's shuffle files as soon as the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the folder all executors share, and read again: cuts lineage, survives lost executors.

    Once the table is complete nothing reads the shuffle files behind it, so they go with the query that wrote it.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One key for all rows with the same id and text: rows that repeat get the same result, rows that clash do not mix."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def row_name(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of a row's id and text, as hex digits: rows that differ have different names."""
    said = F.when(F.col(text).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(text)))
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), said).cast("binary"))


#: A key is hot when it holds more than this share of the rows: there are fewer than one over it of them.
HOT_SHARE = 1 / 512


def with_label(rows: DataFrame, labels: DataFrame, key: str, counts: DataFrame, spread: str) -> DataFrame:
    """``rows`` with the columns that ``labels`` (one row for each key) has for their key, without a hot task.

    ``counts`` is (key, rows): keys that hold more than ``HOT_SHARE`` of all rows, fewer than 512, get their labels from
    a broadcast of that bounded size. Their rows go through the other join spread by ``spread`` and match nothing there.
    """
    names = [c for c in labels.columns if c != key]
    total = counts.agg(F.sum("rows")).scalar()
    few = labels.join(counts.filter(F.col("rows") > HOT_SHARE * total).select(key), key).limit(int(1 / HOT_SHARE))
    hot = few.select(F.col(key).alias("_hot"), F.struct(*names).alias("_of_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    marked = marked.withColumn("_part", F.when(F.col("_of_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1))
    # Always 0, but not a literal: that would be taken out of the join key, and the key alone would deal out the rows.
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    rest = labels.select(F.col(key).alias("_cold"), zero.alias("_cold_part"), F.struct(*names).alias("_of_cold"))
    both = marked.join(rest, (F.col(key) == F.col("_cold")) & (F.col("_part") == F.col("_cold_part")), "left")
    return both.select(*[F.col(c) for c in rows.columns if c not in names], *[F.coalesce(f"_of_hot.{c}", f"_of_cold.{c}").alias(c) for c in names])


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column holds about ``most_bytes`` at once (one longer text stays alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        n = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(n.astype(np.int64)) // most_bytes
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(n)]):
            yield batch.slice(int(a), int(b - a))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit numbers spread over all 64 places."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
