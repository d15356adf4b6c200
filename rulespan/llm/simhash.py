"""Near-duplicates by SimHash: fingerprints joined through tables of distances to reference fingerprints.

Fingerprints are 64 majority bits over a document's shingles. For each distinct fingerprint x a table holds its Hamming
distances to 33 references: zero, and for each of 32 blocks of two bits the fingerprint that has just these set. Half of
d(x, 0) - d(x, block) + 2 is the number of ones of x in the block, a coordinate 0 to 2. The distance to the reference
that joins any set of blocks is a sum of these, so the largest coordinate difference of two fingerprints over all such
references is the sum of the differences of their coordinates. By the triangle inequality it is at most their Hamming
distance: linked fingerprints differ by at most ``MOST`` in all coordinates together.

Pairs are found without comparing all: the coordinates are cut into ``PARTS`` parts, and two fingerprints within
``MOST`` agree in all but two of them, so they meet in the cell of one choice of the other parts. A cell in which more
than ``CELL`` fingerprints meet is divided again: its members agree on the kept parts, so the two left out are cut into
parts themselves, until cells are small or nothing is left to cut. Within a small cell each pair is discarded by its
largest coordinate difference, and the survivors are verified by their exact distance.

Documents with equal fingerprints are one node, so copies never multiply; components come from star contractions.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle make one
shingle of all words; a null doc_id sorts behind all others; repeated rows get equal results; long texts are hashed in
blocks; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rulespan.llm.common import LAST_ID, slices, stored, with_label
from rulespan.llm.components import connected

N_GRAM, SEED = 3, 42
#: Linked up to so many differing bits.
MOST = 2
BLOCK_BITS = 2
REFERENCES = np.array([0] + [((1 << BLOCK_BITS) - 1) << i for i in range(0, 64, BLOCK_BITS)], np.uint64)
#: Parts the coordinates of a cell are cut into, and the members from which a cell is cut again.
PARTS, CELL = 4, 64
#: Shingles hashed at a time.
_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, n: int = N_GRAM) -> int:
    """The bits set in over half of the hashes of the text's shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(n, len(words))
    total, count = np.zeros(64, np.int64), len(words) - size + 1
    for a in range(0, count, _AT_ONCE):
        z = min(count, a + _AT_ONCE)
        spans = zip(starts[a:z].tolist(), ends[a + size - 1 : z + size - 1].tolist())
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), "<u8", z - a)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n_gram: int = N_GRAM) -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in slices(batches, "_text"):
            fp = np.array([fingerprint(t, n_gram) for t in b.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("_text")).mapInArrow(run, "doc_id bigint, fp bigint")


def distance_table(nodes: DataFrame) -> DataFrame:
    """(fp, d, c): each fingerprint's distances to the references, and the coordinates they give, packed in one number."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            d = np.bitwise_count(fp[:, None] ^ REFERENCES).astype(np.uint8)
            ones = (d[:, :1].astype(np.int64) - d[:, 1:] + BLOCK_BITS) // 2
            c = np.zeros(len(fp), np.uint64)
            for i in range(ones.shape[1]):
                c |= ones[:, i].astype(np.uint64) << np.uint64(i * BLOCK_BITS)
            yield pa.RecordBatch.from_arrays(
                [b.column("fp"), pa.array([r.tobytes() for r in d], pa.binary()), pa.array(c.view(np.int64))], ["fp", "d", "c"]
            )

    return nodes.select("fp").mapInArrow(run, "fp bigint, d binary, c bigint")


class State(NamedTuple):
    """What the members of a cell may still differ in: blocks of the coordinates, or, once these are used up, single bits."""

    bits: bool
    free: tuple[int, ...]


WHOLE = State(False, tuple(range(64 // BLOCK_BITS)))


def _mask(state: State, kept: list[int]) -> int:
    """The bits of the coordinates (or of the fingerprint) in these places, as a signed number."""
    width = 1 if state.bits else BLOCK_BITS
    m = sum(((1 << width) - 1) << i * width for i in kept)
    return m - (1 << 64) if m >> 63 else m


def divisions(state: State) -> list[tuple[int, State]]:
    """How a cell is divided: what its parts must agree in, and what they may still differ in.

    Fingerprints with all coordinates equal can differ inside blocks: then each single bit is a reference of its own.
    """
    if len(state.free) <= MOST:
        return [] if state.bits else [(0, State(True, tuple(range(64))))]
    n = min(PARTS, len(state.free))
    parts = [state.free[i::n] for i in range(n)]
    out = []
    for left_out in itertools.combinations(range(n), MOST):
        kept = [x for i, p in enumerate(parts) if i not in left_out for x in p]
        out.append((_mask(state, kept), State(state.bits, tuple(sorted(x for i in left_out for x in parts[i])))))
    return out


def _divided(members: DataFrame, names: dict[State, int]) -> DataFrame:
    """(fp, d, c, cell, state): every member in the cells of every division of its own cell.

    The rules are joined as a table: it grows with the depth of the division, not with the data.
    """
    rules = []
    for state, name in list(names.items()):
        rules += [(name, mask, state.bits, names.setdefault(left, max(names.values()) + 1)) for mask, left in divisions(state)]
    table = members.sparkSession.createDataFrame(rules, "state int, mask bigint, bits boolean, left int")
    cut = members.join(F.broadcast(table), "state")
    seen = F.when(F.col("bits"), F.col("fp")).otherwise(F.col("c")).bitwiseAND(F.col("mask"))
    # A cell's name: the cell it was cut from, what stays free, and what its members agree in.
    return cut.select("fp", "d", "c", F.xxhash64("cell", "left", seen).alias("cell"), F.col("left").alias("state"))


def _within(a: str, b: str) -> Column:
    """Largest coordinate difference over the tabled references, then the exact distance."""
    far = [F.abs(F.ascii(F.substring(a + "d", i + 1, 1).cast("string")) - F.ascii(F.substring(b + "d", i + 1, 1).cast("string"))) for i in range(len(REFERENCES))]
    return (F.greatest(*far) <= MOST) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST)


def links(table: DataFrame) -> DataFrame:
    """(a, b), a > b: every pair of different fingerprints at most ``MOST`` bits apart, possibly more than once."""
    names = {WHOLE: 0}
    # Not a literal, so that the rules are joined by a key.
    members = table.select("fp", "d", "c", F.lit(0).cast("bigint").alias("cell"), F.col("c").bitwiseAND(F.lit(0)).cast("int").alias("state"))
    found = None
    while True:
        cells = stored(_divided(members, names), "cells")
        size = cells.groupBy("cell").agg(F.count("*").alias("rows")).filter("rows > 1")
        shared = with_label(cells, size.select("cell", F.col("rows").alias("_n")), "cell", size, "fp").filter("_n IS NOT NULL")
        shared = stored(shared, "shared-cells")
        last = [name for state, name in names.items() if not divisions(state)]
        small = (F.col("_n") <= CELL) | F.col("state").isin(last)
        side = lambda x: shared.filter(small).select("cell", F.col("fp").alias(x), F.col("d").alias(f"{x}d"))
        pairs = stored(side("a").join(side("b"), "cell").filter("a > b").filter(_within("a", "b")).select("a", "b"), "cell-links")
        found = pairs if found is None else found.unionByName(pairs)
        members = shared.filter(~small).drop("_n")
        open_ = {r["state"] for r in members.select("state").distinct().collect()}
        if not open_:
            return found
        names = {state: name for state, name in names.items() if name in open_}


def components(docs: DataFrame, n_gram: int = N_GRAM) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every row; links counts the other fingerprints linked to its own."""
    rows = stored(fingerprints(docs, n_gram), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("id"), F.count("*").alias("rows")), "distinct-fingerprints")
    pairs = stored(links(distance_table(nodes)).distinct(), "fingerprint-links")
    label = stored(connected(pairs, "a", "b"), "labels")
    degree = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    known = nodes.join(label, F.col("fp") == F.col("node"), "left").select("fp", "id", "rows", F.coalesce("component", "fp").alias("c")).join(degree, "fp", "left")
    known = stored(known, "named-fingerprints")
    least = known.groupBy("c").agg(F.min("id").alias("_id"), F.sum("rows").alias("rows"))
    named = with_label(known.select("fp", "c", "rows", F.coalesce("n_links", F.lit(0)).alias("n_links")), least.select("c", "_id"), "c", least.select("c", "rows"), "fp")
    named = stored(named.select("fp", "rows", "n_links", "_id"), "component-names")
    out = with_label(rows, named.select("fp", "n_links", "_id"), "fp", named.select("fp", "rows"), "doc_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select("doc_id", hexed.alias("fingerprint"), F.coalesce(F.nullif("_id", F.lit(LAST_ID)), "doc_id").alias("component_id"), "n_links")
