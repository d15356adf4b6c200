"""Exact top-k by integer inner product: a Voronoi join of queries with all vectors.

Queries and data are compared through pivots. Queries are grouped by their nearest pivot c, with the group's radius r
(the largest distance to c). For every vector x and query q of the group, <q, x> lies within r * |x| of <c, x>. The
group's bound is the (k+1)-th largest <c, x> - r * |x| over all vectors, gathered from per-batch summaries; only
vectors with <c, x> + r * |x| at or above it can be among the best of any query in the group, and only those are sent
to it. They travel in packed chunks spread over salts; each chunk meets the group's query blocks and is solved locally
with one matrix product, and the local best are merged.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without an id.
Shorter vectors count as filled with zeros. Of rows with a repeated id each is a candidate; a query leaves out one row
equal to itself. Repeated query rows count once. Fewer than k candidates give fewer rows; an empty table gives none.
Scaled components are whole numbers held as doubles, exact at any size; products are summed without rounding, and a
score that does not fit 64 bits is an error, as is a component that overflows when scaled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rulespan.llm.common import stored

SCALE = 1024
#: At most so many pivots, and about so many queries to each.
MOST_PIVOTS, QUERIES_A_PIVOT = 128, 64
#: Vectors from which the pivots are chosen (the farthest first); a bounded sample, results do not depend on it.
PIVOT_SAMPLE = 1024
#: Queries in one block, and parts over which a group's chunks are spread.
QUERY_BLOCK, SALTS = 512, 16
#: Sums below the first are exact in doubles, below the second in 64-bit integers.
_EXACT_DOUBLE, _EXACT_LONG = float(1 << 53), float(1 << 63)


def _scaled(batches):
    for batch in batches:
        ids, vectors = batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()
        out_id, out_v = [], []
        for i, v in zip(ids, vectors):
            if i is None or v is None or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                out_id.append(i)
                whole = np.floor(SCALE * x)
                if not np.isfinite(whole).all():
                    raise OverflowError(f"vector {i} is too large to scale by {SCALE}")
                out_v.append(whole.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_v, pa.binary())], ["vec_id", "v"])


def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    if all(len(v) == 8 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), "<f8")
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, "<f8")
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' of whole numbers, without rounding."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < _EXACT_DOUBLE:
        return (a @ b.T).astype(np.int64)
    if most < _EXACT_LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], object).reshape(len(a), len(b))
    if whole.size and max(abs(int(x)) for x in whole.ravel()) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return whole.astype(np.int64)


def _pivots(queries: DataFrame, dims: int, n: int) -> np.ndarray:
    sample = queries.orderBy(F.xxhash64("vec_id", "v"), "v").select("v").limit(PIVOT_SAMPLE).collect()
    x = np.unique(_matrix([bytes(r["v"]) for r in sample], dims), axis=0) if sample else np.zeros((0, dims))
    if not len(x):
        return x
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    own = d.argmin(1)
    return own, np.linalg.norm(x - c[own], axis=1)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """For each row where ``is_query`` holds (a condition on vec_id): query_id, rank, vec_id, score."""
    data = stored(vectors.select("vec_id", "embedding").mapInArrow(_scaled, "vec_id bigint, v binary"), "vectors")
    queries = stored(data.filter(is_query).dropDuplicates(["vec_id", "v"]), "query-vectors")
    sizes = data.agg(F.max(F.octet_length("v")).alias("bytes")).first()
    dims, n_queries = (sizes["bytes"] or 0) // 8, queries.count()
    pivots = _pivots(queries, dims, min(MOST_PIVOTS, max(1, n_queries // QUERIES_A_PIVOT)))
    known = data.sparkSession.sparkContext.broadcast(pivots)

    def grouped(batches):
        c = known.value
        for b in batches:
            if b.num_rows:
                own, far = _nearest(_matrix(b.column("v").to_pylist(), dims), c)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(far)], [*b.schema.names, "g", "far"])

    members = stored(queries.mapInArrow(grouped, "vec_id bigint, v binary, g int, far double"), "query-groups")
    radius = np.full(len(pivots), -1.0)
    for r in members.groupBy("g").agg(F.max("far").alias("far")).collect():
        radius[r["g"]] = r["far"]

    def bounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products with each pivot, and how far a query of its group may differ (a little more, for rounding)."""
        size = np.linalg.norm(x, axis=1)[:, None]
        rounding = 1e-15 * (dims + 2) * size * np.linalg.norm(known.value, axis=1)
        return x @ known.value.T, size * np.maximum(radius, 0) * (1 + 1e-9) + rounding + 1e-3

    def summaries(batches):
        for b in batches:
            if b.num_rows:
                mid, off = bounded(_matrix(b.column("v").to_pylist(), dims))
                low = -np.sort(-(mid - off), axis=0)[: k + 1]
                g = np.tile(np.arange(low.shape[1], dtype=np.int32), len(low))
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(low.ravel())], ["g", "low"])

    best = Window.partitionBy("g").orderBy(F.desc("low"))
    lows = data.select("v").mapInArrow(summaries, "g int, low double").withColumn("i", F.row_number().over(best)).filter(F.col("i") <= k + 1)
    bound = np.full(len(pivots), -np.inf)
    for r in lows.groupBy("g").agg(F.min("low").alias("low"), F.count("*").alias("n")).collect():
        if r["n"] > k:
            bound[r["g"]] = r["low"]

    def chunks(batches):
        """Packed chunks of the vectors each group needs."""
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column("v").to_pylist(), object)
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            mid, off = bounded(_matrix(list(v), dims))
            need = (mid + off >= bound) & (radius >= 0)
            for g in np.flatnonzero(need.any(0)):
                at = np.flatnonzero(need[:, g])
                n += 1
                m = _matrix(list(v[at]), dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], pa.int32()), pa.array([(n + int(ids[0])) % SALTS], pa.int32()), pa.array([ids[at].astype("<i8").tobytes()]), pa.array([m.tobytes()])],
                    ["g", "salt", "ids", "m"],
                )

    def blocks(batches):
        for b in batches:
            g = b.column("g").to_numpy(zero_copy_only=False)
            v = np.array(b.column("v").to_pylist(), object)
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            for own in np.unique(g):
                rows = np.flatnonzero(g == own)
                for a in range(0, len(rows), QUERY_BLOCK):
                    at = rows[a : a + QUERY_BLOCK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own], pa.int32()), pa.array([ids[at].astype("<i8").tobytes()]), pa.array([_matrix(list(v[at]), dims).tobytes()])],
                        ["g", "q_ids", "q"],
                    )

    packed = data.mapInArrow(chunks, "g int, salt int, ids binary, m binary")
    asked = members.select("vec_id", "v", "g").mapInArrow(blocks, "g int, q_ids binary, q binary")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def solved(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                x, q = (np.frombuffer(row[c], "<f8").reshape(len(i), dims) for c, i in (("m", ids), ("q", q_ids)))
                s = _products(q, x)
                out = [[], [], [], []]
                for i in range(len(q_ids)):
                    row_s = s[i]
                    at = np.arange(len(ids))
                    if len(ids) > k + 1:
                        least = np.partition(row_s, len(ids) - k - 1)[len(ids) - k - 1]
                        at = np.flatnonzero(row_s >= least)
                    at = at[np.lexsort((ids[at], -row_s[at]))][: k + 1]
                    out[0].append(np.full(len(at), q_ids[i])), out[1].append(np.full(len(at), int(_products(q[i : i + 1], q[i : i + 1])[0, 0])))
                    out[2].append(ids[at]), out[3].append(row_s[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "own", "vec_id", "score"])

    local = packed.join(asked, ["g", "salt"]).select("ids", "m", "q_ids", "q").mapInArrow(solved, "query_id bigint, own bigint, vec_id bigint, score bigint")
    # One row equal to the query itself is its own; ``own`` also tells apart queries with the same id.
    order = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    first = local.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= k + 1)
    seen = F.sum(itself.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    left = first.withColumn("_self", itself & (seen == 1)).filter("NOT _self")
    return left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
