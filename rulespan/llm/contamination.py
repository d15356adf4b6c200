"""Benchmark decontamination: documents that hold passages of benchmark items, by a prefix-filtered set join.

Every run of ``width`` words of an item is one window; an item with fewer words (but not none) is one window. For a
containment of a whole window the necessary prefix, with tokens ordered by rarity over all documents, is its rarest
token: a document can hold the window only where it holds that token. Documents probe an index of these tokens; the
token's place in the window (positional bound) and the window's length (length bound) give the one place where the
window may lie; there all words are compared, so the answer is exact.

The benchmark side is read in blocks of a bounded number of windows, each sent to the tasks once; the documents never
shuffle while one block holds all windows. With more blocks the hits of each are united per (id, text) row key.

Edge cases: null or empty texts (on either side) have no words; repeated windows of several items count for each of
them; items with a null id count among ``n_items`` with an empty id; an empty benchmark hits nothing. Which of
equally rare tokens stands for a window changes no result. Repeated documents get equal results, an empty table none; long texts are
cut into batches by bytes, a single longer one is read whole.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulespan.llm.common import row_key, slices, stored

WIDTH = 13
#: Windows of the benchmark held by one task at a time (about 200 bytes each).
BLOCK_WINDOWS = 50_000

# Bytes that end a word become spaces and A-Z become a-z: then the words are what split() finds. UTF-8 bytes of
# code points from 0x80 on are word bytes.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (window, items): words joined by a space, and the sorted ids of the items that hold it."""

    def run(batches):
        for batch in slices(batches, "text"):
            item, window = [], []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                for a in range(max(1, len(w) - width + 1) if w else 0):
                    item.append(i)
                    window.append(b" ".join(w[a : a + width]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.string())], ["item", "window"])

    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "item string, window string").distinct()


def token_rarity(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """For each token of the windows, in how many documents it is: (token, n). One count per token and task shuffles."""
    tokens = windows.select(F.explode(F.array_distinct(F.split("window", " "))).alias("token")).distinct()

    def count(batches):
        found: dict[bytes, int] = defaultdict(int)
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                for w in set(words(text)):
                    found[w] += 1
            if len(found) > 400_000:
                yield out(found)
                found.clear()
        yield out(found)

    def out(found):
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("utf-8", "replace") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"]
        )

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "token string, n bigint")
    return tokens.join(counts.groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_index(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, place, window, items): each window under its rarest token, with that token's place in the window.

    A window with a token that no document holds can occur nowhere and is left out.
    """
    windows = stored(item_windows(benchmark, width), "benchmark-windows")
    rarity = token_rarity(docs, windows)
    placed = windows.select("window").distinct().select("window", F.posexplode(F.split("window", " ")).alias("place", "token"))
    prefix = (
        placed.join(rarity, "token")
        .groupBy("window")
        .agg(F.min(F.struct("n", "token", "place")).alias("_p"))
        .filter(F.col("_p.n") > 0)
    )
    items = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return prefix.join(items, "window").select(F.col("_p.token").alias("key"), F.col("_p.place").alias("place"), "window", "items")


def _blocks(index: DataFrame, block_windows: int) -> list[DataFrame]:
    """The index as frames of about ``block_windows`` windows at most."""
    parts = -(-index.count() // block_windows)
    if parts <= 1:
        return [index]
    return [index.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == p) for p in range(parts)]


def _hits(rows: DataFrame, block: DataFrame, fields) -> DataFrame:
    """Rows with their number of words, the places of hit words as (start, end) runs, and the ids of the items found."""
    index: dict[bytes, list] = defaultdict(list)
    for r in block.collect():
        # One object a window: a list of its words takes seven times the memory in every task.
        window = r["window"].encode()
        index[r["key"].encode()].append((r["place"], window.count(b" ") + 1, window, tuple(r["items"])))
    known = rows.sparkSession.sparkContext.broadcast(dict(index))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        keys = known.value
        for batch in slices(batches, "_text"):
            n_words, runs, items = [], [], []
            for text in batch.column("_text").to_pylist():
                w = words(text)
                at, ids = set(), set()
                for i, token in enumerate(w):
                    if token in keys:
                        for place, length, window, owners in keys[token]:
                            a = i - place
                            if a >= 0 and a + length <= len(w) and b" ".join(w[a : a + length]) == window:
                                at.add((a, a + length))
                                ids.update(owners)
                n_words.append(len(w))
                runs.append(_merged(at))
                items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in fields],
                    pa.array(n_words, pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in x] for x in runs], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                [*[f.name for f in fields], "n_words", "runs", "items"],
            )

    return rows.mapInArrow(run, f"{schema}, n_words bigint, runs array<struct<a:bigint,b:bigint>>, items array<string>")


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every document with ``n_words``, ``runs`` of hit words and ``items`` found."""
    index = stored(prefix_index(docs, benchmark, width), "benchmark-index")
    fields = [f for f in docs.schema.fields if f.name in keep]
    rows = docs.select(*[F.col(f.name) for f in fields], F.col("text").cast("binary").alias("_text"))
    blocks = _blocks(index, block_windows)
    if len(blocks) == 1:
        return _hits(rows, blocks[0], fields)
    keyed = docs.select(row_key().alias("_k"), F.col("text").cast("binary").alias("_text"))
    key = [f for f in keyed.schema.fields if f.name == "_k"]
    each = reduce(DataFrame.unionByName, [_hits(keyed, b, key) for b in blocks])
    united = each.groupBy("_k").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return docs.select(*[F.col(f.name) for f in fields], row_key().alias("_k")).join(united, "_k").drop("_k")


def _digest(rows: DataFrame) -> DataFrame:
    """Counts of distinct hit words from possibly overlapping runs."""
    ordered = F.array_sort("runs")
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    n_hit = F.aggregate(
        ordered,
        zero,
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("bigint"), r["b"] - F.greatest(acc["to"], r["a"]))).alias("n"), F.greatest(acc["to"], r["b"]).alias("to")
        ),
        lambda acc: acc["n"],
    )
    return rows.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def detect(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """Every document with counts of words, hit words and items found; contaminated from one hit word in 20."""
    return _digest(find(docs, benchmark, keep=keep, **how)).select(
        *keep,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        "runs",
        "items",
    )
