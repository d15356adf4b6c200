"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed character 1- to 3-grams. Spherical k-means finds a few centroids in
each language; a text gets the language of the centroid with the highest cosine. A text whose cosine lies below the
rejection floor of its length band is rejected: the floors are learned from the training texts' own distances.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and rejected. Very long texts are counted
in pieces, so memory does not follow their length. Repeated rows get equal results. Without any training row every
text is ``und`` and rejected; an empty table gives no rows. Of equally near centroids the first language in order wins.
Columns other than the id and the text are never inputs of a prediction.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulespan.llm.common import slices, stored

#: Places of the hashed n-gram vector.
DIMS = 8192
#: Training texts per language (about; a documented bound of the classifier's sample).
SAMPLE = 800
#: Centroids per language.
CENTROIDS = 4
#: Letters (with one space between words) from which the next length band starts; each band has its rejection floor.
BANDS = (8, 24, 80, 300, 1500)
#: A floor is this share of the lowest cosine that a training text of the band has with its own language.
SLACK = 0.45
_PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case code point if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def counts(text: str) -> tuple[np.ndarray, int]:
    """Hashed n-gram counts, and the length of the text's letters with single spaces."""
    total, size, tail = np.zeros(DIMS, np.int64), 0, np.zeros(0, np.uint32)
    shift = np.uint32(32 - int(math.log2(DIMS)))
    for at in range(0, len(text), _PIECE):
        a = _letters()[np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        a = np.concatenate([tail if at else np.array([32], np.uint32), a, [32] if at + _PIECE >= len(text) else []]).astype(np.uint32)
        a = a[np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]]
        old = len(tail)
        size += len(a) - old
        h = np.zeros(len(a), np.uint32)
        for n in (1, 2, 3):
            if len(a) < n:
                break
            h = (h[: len(a) - n + 1] + a[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            new = h[max(0, old - n + 1) :]  # grams that end in this piece
            total += np.bincount((new * np.uint32(0x85EBCA77)) >> shift, minlength=DIMS)
        tail = a[-2:]
    return total, max(0, size - 2)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _weights(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(found).astype(np.float32) * idf
    norm = np.linalg.norm(v)
    return v / norm if norm else v


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: tuple[float, ...]  # of each length band


def _band(size: int) -> int:
    return int(np.searchsorted(BANDS, size, side="right"))


def training_rows(docs: DataFrame, allowed, per_lang: int = SAMPLE) -> DataFrame:
    """About ``per_lang`` rows of each language, chosen by a hash of the id; ids that repeat count once."""
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    share = rows.groupBy("lang").agg((F.lit(per_lang) / F.count("*")).alias("_share"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) / F.lit(1 << 20)
    known = {r["lang"]: r["_share"] for r in share.collect()}
    if not known:
        return rows.select("doc_id", "lang", "text").limit(0)
    limit = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("lang")]
    return rows.filter(unit < limit).select("doc_id", "lang", "text").dropDuplicates(["doc_id"])


def _feature_rows(batches):
    for batch in slices(batches, "text"):
        langs, idx, val, size = [], [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if not has_letter(text):
                continue
            c, n = counts(text)
            at = np.flatnonzero(c)
            langs.append(lang), idx.append(at), val.append(c[at]), size.append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.int64())), pa.array(size, pa.int64())],
            ["lang", "idx", "val", "size"],
        )


def _clusters(idf: np.ndarray, k: int):
    """Spherical k-means over the bounded sample of one language, from far-apart first texts."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), DIMS), np.float32)
        for i, (at, n) in enumerate(zip(pdf["idx"], pdf["val"])):
            x[i, at] = n
        x = np.log1p(x) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        x = x[np.lexsort(x[:, :8].T)]  # the same start whatever order the rows come in
        mean = x.mean(0)
        c = [mean / max(np.linalg.norm(mean), 1e-9)]
        while len(c) < min(k, len(x)):
            c.append(x[int(np.argmin((x @ np.array(c).T).max(1)))])
        c = np.array(c)
        for _ in range(8):
            own = (x @ c.T).argmax(1)
            for j in range(len(c)):
                if (own == j).any():
                    m = x[own == j].mean(0)
                    c[j] = m / max(np.linalg.norm(m), 1e-9)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [v.tolist() for v in c]})

    return fit


def fit(docs: DataFrame, allowed, per_lang: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Centroids, inverse document frequencies and rejection floors from a bounded sample of the labelled rows.

    What reaches the driver is bounded: one number per vector place, ``k`` centroids per language, one floor per band.
    """
    rows = stored(
        training_rows(docs, allowed, per_lang).mapInArrow(_feature_rows, "lang string, idx array<int>, val array<bigint>, size bigint"),
        "language-sample",
    )
    n = rows.count()
    df = np.zeros(DIMS)
    for r in rows.select(F.explode("idx").alias("i")).groupBy("i").count().collect():
        df[r["i"]] = r["count"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    found = rows.groupBy("lang").applyInPandas(_clusters(idf, k), "lang string, centroid array<float>").collect()
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    langs = tuple(r["lang"] for r in found)
    centroids = np.array([r["centroid"] for r in found], np.float32).reshape(len(found), DIMS)

    def own_cosine(pdfs):
        for pdf in pdfs:
            best = []
            for lang, at, c in zip(pdf["lang"], pdf["idx"], pdf["val"]):
                v = np.zeros(DIMS)
                v[at] = c
                mine = [j for j, x in enumerate(langs) if x == lang]
                best.append(float((centroids[mine] @ _weights(v, idf)).max()))
            yield pd.DataFrame({"band": [_band(x) for x in pdf["size"]], "cosine": best})

    low = {r["band"]: r["low"] for r in rows.mapInPandas(own_cosine, "band int, cosine double").groupBy("band").agg(F.min("cosine").alias("low")).collect()}
    floors, least = [], math.inf
    for b in range(len(BANDS), -1, -1):  # a shorter band never asks for more than a longer one
        least = min(least, low.get(b, least))
        floors.append(0.0 if b not in low else SLACK * least)
    return Model(langs, centroids, idf, tuple(floors[::-1]))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred``, ``score`` and ``rejected``. Row-local: no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        m = known.value
        for batch in slices(batches, "_text"):
            pred, score, out = [], [], []
            texts = batch.column("_text").to_pylist()
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                x, size = np.zeros((len(part), DIMS), np.float32), np.zeros(len(part), np.int64)
                ok = np.array([has_letter(t) for t in part], bool) & (len(m.langs) > 0)
                for i in np.flatnonzero(ok):
                    c, size[i] = counts(part[i])
                    x[i] = _weights(c, m.idf)
                cos = x @ m.centroids.T if len(m.langs) else np.zeros((len(part), 1), np.float32)
                best = cos.argmax(1)
                top = np.clip(cos[np.arange(len(part)), best], 0, 1)
                for i in range(len(part)):
                    pred.append(m.langs[best[i]] if ok[i] else "und")
                    score.append(float(top[i]) if ok[i] else 0.0)
                    out.append(not ok[i] or bool(top[i] < m.floors[_band(size[i])]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in fields], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                [*[f.name for f in fields], "lang_pred", "score", "rejected"],
            )

    rows = docs.select(*[F.col(f.name) for f in fields], F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    """Rows kept from training: crc32 of the id as text leaves remainder 2 by 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    model = fit(docs.select("doc_id", "lang", "text"), ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
