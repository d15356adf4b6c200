"""Shards of nearly equal bytes by a histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie next to each other and are cut only where one group
is larger than the room left in a shard. Each round counts, over all partitions, the exact bytes below evenly spaced
candidate keys inside every interval that still holds a shard border; the interval around the wanted byte count
replaces the old one, until a border misses its target by no more than the tolerance or its interval holds one key.
Only these counts (at most ``PROBES`` per border and round) reach the driver. With the borders known, the shard is an
expression on the key, and rows are exchanged once, for the numbers inside the shards.

Edge cases: a null text has the size of its overhead and crc32 0; a null doc_id sorts before all others; rows that
repeat id and text share a key and stay in one shard; an empty table gives an empty result. A text counts by its bytes
however long it is; one longer than a shard's share makes that shard as large as itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespan.llm.common import stored

#: Bytes each row takes besides its text.
OVERHEAD = 8
#: Candidate keys between the ends of an interval in one round.
PROBES = 512
#: Share of a shard's size by which a border may miss its target.
TOLERANCE = 0.001
#: Rows numbered by one task, about.
RUN_ROWS = 200_000

# The sort key in parts whose differences fit a bigint: 62 bits of the text's hash, then both halves of the id.
_PARTS = ("_h", "_hi", "_lo")


def with_key(docs: DataFrame) -> DataFrame:
    """Adds size, crc32 and the parts of the sort key to the columns of the rows."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    least = F.lit(-(1 << 63)).cast("bigint")
    d = F.coalesce(F.col("doc_id").cast("bigint"), least)
    return docs.withColumns(
        {
            "size": (F.octet_length(raw) + OVERHEAD).cast("bigint"),
            "text_crc32": F.crc32(raw),
            "_h": F.shiftrightunsigned(F.xxhash64(raw), 2),
            "_hi": F.shiftright(d, 31),
            "_lo": d.bitwiseAND(F.lit((1 << 31) - 1)),
        }
    )


@dataclass(frozen=True)
class _Interval:
    """Keys that start with ``prefix`` and whose next part lies in [lo, hi]; ``below``: bytes of all smaller keys."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: int

    @property
    def part(self) -> str:
        return _PARTS[len(self.prefix)]

    @property
    def step(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // PROBES))

    def holds(self) -> Column:
        same = [F.col(p) == v for p, v in zip(_PARTS, self.prefix)]
        return reduce(Column.__and__, [*same, F.col(self.part).between(self.lo, self.hi)])

    def probe(self) -> Column:
        return F.expr(f"({self.part} - {self.lo}L) div {self.step}L")


def _counted(rows: DataFrame, open_: list[_Interval]) -> dict[int, dict[int, int]]:
    """Exact bytes between neighbouring candidate keys of each open interval, over all partitions."""
    number, probe = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for i, x in enumerate(open_):
        number, probe = F.when(x.holds(), i).otherwise(number), F.when(x.holds(), x.probe()).otherwise(probe)
    found = rows.select(number.alias("i"), probe.alias("p"), "size").filter("i IS NOT NULL").groupBy("i", "p").agg(F.sum("size").alias("b"))
    out: dict[int, dict[int, int]] = {i: {} for i in range(len(open_))}
    for r in found.collect():
        out[r["i"]][r["p"]] = r["b"]
    return out


def borders(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """For each border between shards the key (or key prefix) from which the next shard starts."""
    ends = rows.agg(F.sum("size").alias("total"), *[f(p).alias(f"{n}{p}") for p in _PARTS for n, f in (("a", F.min), ("b", F.max))]).first()
    if ends["total"] is None:
        return []
    total, room = ends["total"], tolerance * ends["total"] / n_shards
    span = [(ends[f"a{p}"], ends[f"b{p}"]) for p in _PARTS]
    at = {j: _Interval((), *span[0], 0) for j in range(1, n_shards)}
    done: dict[int, tuple[int, ...]] = {}
    while at:
        open_ = list(dict.fromkeys(at.values()))
        counts = _counted(rows, open_)
        for j, x in list(at.items()):
            goal, below, bytes_ = total * j / n_shards, x.below, counts[open_.index(x)]
            for p in sorted(bytes_):
                if below + bytes_[p] >= goal:
                    break
                below += bytes_[p]
            start = x.lo + p * x.step
            before, after = goal - below, below + bytes_[p] - goal
            last = x.step == 1 and len(x.prefix) + 1 == len(_PARTS)
            if min(before, after) <= room or last:
                done[j] = (*x.prefix, start if before <= after else start + x.step)
                del at[j]
            elif x.step > 1:
                at[j] = _Interval(x.prefix, start, min(start + x.step - 1, x.hi), below)
            else:  # one value of this part holds the border: go on with the next part
                at[j] = _Interval((*x.prefix, start), *span[len(x.prefix) + 1], below)
    return [done[j] for j in sorted(done)]


def _from(border: tuple[int, ...]) -> Column:
    """Whether a row's key lies at or behind a border."""
    *first, last = border
    out = F.col(_PARTS[len(first)]) >= last
    for p, v in reversed(list(zip(_PARTS, first))):
        out = (F.col(p) > v) | ((F.col(p) == v) & out)
    return out


def by_bytes(docs: DataFrame, n_shards: int = 24, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    rows = stored(with_key(docs.select("doc_id", "text")).drop("text"), "shard-keys") if set(keep) <= {"doc_id"} else with_key(docs)
    shard = reduce(Column.__add__, [_from(b).cast("int") for b in borders(rows, n_shards)], F.lit(0))
    n = rows.count()
    bits = min(16, max(0, (n // RUN_ROWS).bit_length()))
    placed = rows.select(*keep, "size", "text_crc32", *_PARTS, shard.alias("shard"), F.shiftright("_h", 62 - bits).alias("_bucket"))
    # Runs of about RUN_ROWS rows: hash buckets, of which those of hot texts are cut further by the id. The tables
    # of runs have at most 2^16 + n_shards rows, and one more for each RUN_ROWS rows of a hot text.
    cuts = placed.groupBy("shard", "_bucket").agg(F.ceil(F.count("*") / RUN_ROWS).alias("_cuts")).filter("_cuts > 1")
    run = F.pmod(F.xxhash64("_hi", "_lo"), F.coalesce("_cuts", F.lit(1).cast("bigint")))
    placed = placed.join(F.broadcast(cuts), ["shard", "_bucket"], "left").withColumn("_run", run).drop("_cuts")
    sizes = placed.groupBy("shard", "_bucket", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket", "_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("shard", "_bucket", "_run").orderBy(*_PARTS)
    numbered = placed.withColumn("_i", F.row_number().over(own)).join(starts, ["shard", "_bucket", "_run"])
    return numbered.select(*keep, "size", "text_crc32", "shard", (F.col("_start") + F.col("_i") - 1).alias("slot"))


def assign(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The assignment under the law ``bytes``; it promises nothing about a grown number of shards."""
    return by_bytes(docs, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
