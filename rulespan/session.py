"""Session helpers: settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(master: str | None = None, app: str = "rulespan", **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans are built from many small Columns; call-site capture triples the time that takes.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as ``spark.checkpoint.dir`` names it.

    Unset, it is a temporary folder where driver and executors are one process (``local[...]``, as in tests); on
    a cluster that would be another folder on each machine, so an unset folder is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the cluster."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_root(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach, for tables a job writes and reads back."""
    return f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table as compressed columns in a fresh shared folder, for rows that several passes read; and the folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _published_at(spark: SparkSession, name: str, key: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_shared_root(spark)}/{name}-{key}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published(spark: SparkSession, name: str, key: str) -> DataFrame | None:
    """The table ``name`` made from what ``key`` stands for, if a job has published it in the shared folder."""
    path, files = _published_at(spark, name, key)
    return spark.read.parquet(path.toString()) if files.exists(path) else None


def publish(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a table for all later jobs that ask for this name and key.

    It is written aside and moved into place when complete, so a lost writer leaves nothing that could be read.
    """
    spark = df.sparkSession
    path, files = _published_at(spark, name, key)
    aside = shared_folder(spark, name)
    df.write.parquet(aside)
    files.delete(path, True)
    files.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), path)
    return spark.read.parquet(path.toString())


def content_key(df: DataFrame, *of: str) -> str:
    """A key of the rows of a table, in any order: their number and the sum of their digests."""
    digest = F.xxhash64(*[F.col(c) for c in of])
    row = df.select(digest.alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("d").cast("decimal(20,0)")).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['s']}:{','.join(of)}".encode()).hexdigest()[:32]


def removed(spark: SparkSession, path: str) -> None:
    """A folder of the shared root deleted, its reader being done."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
