"""Connected components of a link table by alternating star contractions, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulespan.llm.common import stored

#: Links in one file of a round, about; a round has at least LEAST_FILES, so that no round is left to a few tasks.
LINKS_A_FILE = 20_000
LEAST_FILES = 24


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node hands its (larger or smaller) neighbours to the smallest node it knows."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges  # a > b throughout
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = both.join(least, "a").filter("b > a" if large else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Each node's neighbours are only ever reduced to a minimum, so no group is gathered; every round is written to the
    shared folder. The number of rounds grows with the logarithm of the longest chain. A round is written in as many
    files as its links need, not one for each shuffle partition: each file costs an executor child processes and a writer.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links"
    )
    files = max(LEAST_FILES, -(-edges.count() // LINKS_A_FILE))
    mark = None
    while True:
        edges = stored(_stars(_stars(edges, True), False).coalesce(files), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            ).coalesce(files)
        mark = now
