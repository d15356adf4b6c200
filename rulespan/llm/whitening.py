"""Whitening of embeddings: leading eigenvectors of the covariance by a block Jacobi-Davidson method.

The covariance is never formed. Its product with a block of vectors is a pass over the table: every task centres its
rows exactly (n * x - S in whole numbers), multiplies, and adds up one small matrix; these are summed in two steps, so
the driver gets at most ``FAN_IN`` of them. Everything else works on matrices of dimensions x subspace on the driver.

Each outer round projects the covariance on the subspace (Rayleigh-Ritz), locks the leading pairs whose residual is
down to rounding, and for the others solves the correction equation (I - UU')(A - theta I)(I - UU') t = -r by a few
MINRES steps, all columns in one product. The solutions widen the subspace, which is cut back to the best Ritz vectors
when it is full. A subspace as wide as the space holds the eigenvectors themselves.

Edge cases: rows whose vector is null or holds a null or non-finite entry are dropped; a null vec_id is kept. Shorter
vectors count as filled with zeros. Repeated rows count as often as they occur. Directions without variance (a constant
table, fewer rows than dimensions) give no component; an empty table gives no rows. Entries that do not fit 52 bits
after scaling, and deviations beyond 64 bits, are errors.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulespan.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Partial matrices that reach the driver at most.
FAN_IN = 16
#: MINRES steps for one correction, and the reduction of its residual that ends them early.
INNER_STEPS, INNER_REDUCTION = 6, 0.05
#: Residuals count as rounding below so many units of the last place of the trace.
ROUNDING = 16
MOST_ROUNDS = 300


class Eigen(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int
    products: int


def _ready(batches):
    for b in batches:
        ids, xs = [], []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
            if v is None or any(c is None for c in v):
                continue
            x = np.array(v, np.float64)
            if not np.isfinite(x).all():
                continue
            if (np.abs(x) * SCALE >= 2.0**52).any():
                raise OverflowError(f"an entry of vector {i} is too large to scale by {SCALE}")
            ids.append(i)
            xs.append((np.floor(SCALE * x).astype("<i8") + SHIFT).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary())], ["vec_id", "x"])


def _rows(x: list[bytes], dims: int) -> np.ndarray:
    if all(len(v) == 8 * dims for v in x):
        return np.frombuffer(b"".join(x), "<i8").reshape(len(x), dims)
    out = np.full((len(x), dims), SHIFT, "<i8")
    for i, v in enumerate(x):
        out[i, : len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding: in 64 bits where the numbers allow it."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _added(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the matrices (m: doubles, packed) of ``parts``: first within FAN_IN tasks, then on the driver."""

    def total(batches):
        out, any_ = np.zeros(math.prod(shape)), False
        for b in batches:
            for m in b.column("m").to_pylist():
                out += np.frombuffer(m, "<f8")
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["m"])

    got = sorted(bytes(r["m"]) for r in parts.repartition(FAN_IN).mapInArrow(total, "m binary").collect())
    return np.sum([np.frombuffer(m, "<f8") for m in got], axis=0).reshape(shape) if got else np.zeros(shape)


class Centred:
    """A table of whole vectors and its covariance as an operator on blocks of vectors."""

    def __init__(self, vectors: DataFrame):
        self.rows = stored(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(_ready, "vec_id bigint, x binary"), "whole-vectors")
        head = self.rows.agg(F.count("*").alias("n"), F.max(F.octet_length("x")).alias("bytes")).first()
        self.n, self.dims, self.products = head["n"], (head["bytes"] or 0) // 8, 0
        dims = self.dims

        def sums(batches):
            out = [0] * dims
            for b in batches:
                if b.num_rows:
                    x = _rows(b.column("x").to_pylist(), dims)
                    part = x.sum(0) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object).sum(0)
                    out = [a + int(c) for a, c in zip(out, part)]
            yield pa.RecordBatch.from_arrays([pa.array(list(range(dims)), pa.int32()), pa.array([str(s) for s in out], pa.string())], ["i", "s"])

        by_dim = self.rows.mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        self.sums = [int(r["s"]) for r in sorted(by_dim.collect(), key=lambda r: r["i"])] if self.n and dims else []

    def centred(self, x: list[bytes]) -> np.ndarray:
        return _exact(_rows(x, self.dims), self.n, self.sums).astype(np.float64) / self.n

    def over_rows(self, of) -> DataFrame:
        """One packed matrix a task: the sum of ``of(centred rows)`` over its batches."""
        n, sums, dims = self.n, self.sums, self.dims

        def run(batches):
            out = None
            for b in batches:
                if b.num_rows:
                    part = of(_exact(_rows(b.column("x").to_pylist(), dims), n, sums).astype(np.float64) / n)
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(out, "<f8").tobytes()], pa.binary())], ["m"])

        return self.rows.select("x").mapInArrow(run, "m binary")

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors (dims x any)."""
        self.products += 1
        return _added(self.over_rows(lambda c: c.T @ (c @ block)), block.shape) / self.n

    def trace(self) -> float:
        return float(_added(self.over_rows(lambda c: np.array([(c * c).sum()])), (1,))[0]) / self.n


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of ``new`` outside ``basis``, orthonormal to it; those that add nothing are left out."""
    kept = basis
    for t in new.T:
        size = np.linalg.norm(t)
        if not size > 0:
            continue
        t = t / size
        for _ in range(3):
            t = t - kept @ (kept.T @ t)
            left = np.linalg.norm(t)
            if left < 1e-10:
                break
            t = t / left
        else:
            kept = np.column_stack([kept, t])
    return kept[:, basis.shape[1] :]


def _corrections(times, ritz: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - UU')(A - theta I)(I - UU') t = -r, U being ``ritz``: one MINRES for all columns."""

    def projected(v: np.ndarray) -> np.ndarray:
        return v - ritz @ (ritz.T @ v)

    b = projected(-residual)
    t = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, before = b / first, np.zeros_like(b)
    w, w_before = np.zeros_like(b), np.zeros_like(b)
    phi, beta = beta.copy(), np.zeros_like(beta)
    cos, sin, delta_next, eps = -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        a = projected(times(v) - theta * v) - beta * before
        alpha = (v * a).sum(0)
        a = projected(a - alpha * v)
        beta_next = np.linalg.norm(a, axis=0)
        delta = cos * delta_next + sin * alpha
        gamma_bar = sin * delta_next - cos * alpha
        eps_now, eps = eps, sin * beta_next
        delta_next = -cos * beta_next
        gamma = np.hypot(gamma_bar, beta_next)
        safe = np.where(gamma > 0, gamma, 1.0)
        cos, sin = gamma_bar / safe, beta_next / safe
        step, phi = cos * phi, sin * phi
        w, w_before = np.where(gamma > 0, (v - eps_now * w_before - delta * w) / safe, 0.0), w
        t = t + step * w
        before, beta = v, beta_next
        v = np.where(beta_next > 0, a / np.where(beta_next > 0, beta_next, 1.0), 0.0)
        if (np.abs(phi) <= INNER_REDUCTION * first).all():
            break
    return projected(t)


def leading(times, dims: int, wanted: int, trace: float, seed: int = 7) -> Eigen:
    """The ``wanted`` largest eigenpairs of a symmetric operator given by its product with a block."""
    wanted = min(wanted, dims)
    widest = min(dims, max(3 * wanted, wanted + 20))
    calls = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return times(block)

    basis = _orthonormal(np.random.default_rng(seed).normal(size=(dims, min(dims, wanted + 8))), np.zeros((dims, 0)))
    image = product(basis)
    small = ROUNDING * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    for rounds in range(1, MOST_ROUNDS + 1):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y[:, :wanted], image @ y[:, :wanted]
        residual = ritz_image - ritz * theta[:wanted]
        size = np.linalg.norm(residual, axis=0)
        whole = basis.shape[1] == dims
        is_open = (size > small) & (not whole)
        if not is_open.any():
            return Eigen(theta[:wanted], ritz, size, rounds, calls)
        # Locked pairs stay in the subspace and in the projector; only open ones get a correction.
        room = widest - basis.shape[1]
        if room < min(is_open.sum(), dims - wanted):
            keep = min(wanted + 8, widest)
            basis, image = basis @ y[:, :keep], image @ y[:, :keep]
            room = widest - keep
        at = np.flatnonzero(is_open)[: max(room, 1)]
        t = _corrections(product, ritz, theta[at], residual[:, at], INNER_STEPS)
        more = _orthonormal(t, basis)
        if more.shape[1] == 0:
            more = _orthonormal(np.random.default_rng(seed + rounds).normal(size=(dims, len(at))), basis)
        more = more[:, : dims - basis.shape[1]]
        basis, image = np.column_stack([basis, more]), np.column_stack([image, product(more)])
    raise RuntimeError(f"{int(is_open.sum())} of {wanted} eigenpairs did not reach double precision in {MOST_ROUNDS} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark, table = vectors.sparkSession, Centred(vectors)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    trace = table.trace() if table.n and table.dims else 0.0
    if not trace > 0:
        return spark.createDataFrame([], schema)
    found = leading(table.times, table.dims, components, trace)
    real = found.values > ROUNDING * np.finfo(float).eps * trace
    values, basis = found.values[real], found.vectors[:, real]
    scaled = basis / np.sqrt(values)
    explained, k, n, sums, dims = values / trace, len(values), table.n, table.sums, table.dims
    spread = _added(table.over_rows(lambda c: (c @ scaled).T @ (c @ scaled)), (k, k)) / n
    error = float(np.abs(spread - np.eye(k)).max())

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, packed = b.column("vec_id"), b.column("x").to_pylist()
            for a in range(0, len(packed), 2048):
                exact = _exact(_rows(packed[a : a + 2048], dims), n, sums)
                far = int(np.abs(exact).max(initial=0))
                whole = exact if far * far * dims < 1 << 63 else exact.astype(object)
                deviation = (whole * whole).sum(1)
                m = len(exact)
                w = (exact.astype(np.float64) / n) @ scaled
                own = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, m).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        pa.array([int(d) for d in deviation], pa.int64()).take(pa.array(own)), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return table.rows.mapInArrow(run, schema)
