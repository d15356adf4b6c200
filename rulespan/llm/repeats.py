"""Windows of tokens and the units they fall into: what the operators on repeated passages share.

A window is ``width`` consecutive tokens. Its anchor is the ``k``-gram with the smallest hash inside it (the leftmost
of equals), which depends on the window's content alone, so equal windows have equal anchors at equal places. A unit is
a run of windows with the same anchor occurrence; it spans the tokens from the first window's start to the last
window's end. Every window belongs to one unit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from rulespan.llm.common import LAST_ID, mixed, row_key, slices, stored

_BASE = 0x9E3779B97F4A7C15
#: Tokens hashed at once; longer documents are cut into pieces that share ``width - 1`` tokens.
PIECE = 1 << 20
#: Place of the start of a unit's first window in the number that stands for the unit.
SHIFT = 16
#: Anchors found in ``OFTEN`` documents of a sample of one in ``SAMPLED`` (a power of two) are common: what they stand
#: for is dealt out by its own content. Of more than ``MOST``, those in the most documents count.
SAMPLED, OFTEN, MOST = 64, 32, 100_000


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hashes:
    """Hashes of all token ranges of an array, by prefix sums of a polynomial."""

    def __init__(self, tokens: np.ndarray):
        size = 1 << max(12, int(len(tokens) + 1).bit_length())
        up, self._down = _powers(size)
        self._sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self._sums[1:])

    def all(self, width: int) -> np.ndarray:
        """Of every range of ``width`` tokens."""
        n = len(self._sums) - width
        return mixed((self._sums[width:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self._sums[b] - self._sums[a]) * self._down[a])


class Units(NamedTuple):
    doc: np.ndarray  # number of the document in the batch
    first: np.ndarray  # start of the unit's first window in the document
    count: np.ndarray  # of windows
    place: np.ndarray  # of the anchor behind the last window's start
    anchor: np.ndarray  # hash of the anchor's tokens
    content: np.ndarray  # hash of all tokens the unit spans, with the anchor's place


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def units(tokens: np.ndarray, lengths: np.ndarray, k: int, width: int) -> Units:
    """Units of documents whose tokens lie one behind the other."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    found = []
    if len(tokens) <= PIECE:
        found.append(_units(tokens, starts, lengths, k, width, 0, 0))
    else:
        for d, (a, n) in enumerate(zip(starts, lengths)):
            for at in range(0, max(1, n - width + 1), PIECE):
                part = tokens[a + at : a + min(n, at + PIECE + width - 1)]
                found.append(_units(part, np.zeros(1, np.int64), np.array([len(part)]), k, width, d, at))
    return Units(*[np.concatenate(c) for c in zip(*found)])


def _units(tokens, starts, lengths, k, width, doc0: int, at0: int) -> Units:
    n = len(tokens) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Units(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    hashes = Hashes(tokens)
    grams = hashes.all(k)
    low = np.uint64(32)
    keys = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    place = (_smallest(keys, width - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)[:n]
    inside = np.arange(n) + width <= (starts + lengths)[doc]
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])]
    a = np.flatnonzero(new)
    b = np.r_[a[1:], n] - 1
    ok = inside[a]
    a, b = a[ok], b[ok]
    p = place[a]
    spot = ((p - a) << 8 | (b - a)).astype(np.uint64)
    content = mixed(hashes.ranges(a, b + width) ^ mixed(spot + np.uint64(1)))
    d = doc[a]
    return Units(d + doc0, a - starts[d] + at0, b - a + 1, p - b, grams[p], content)


class Alphabet(NamedTuple):
    """How texts become tokens, and the lengths the search works with."""

    tokens: Callable  # list of texts (bytes) -> token hashes one behind the other, and the number of each text's tokens
    k: int  # tokens of an anchor
    width: int  # tokens of a window


def _common(rows: DataFrame, alphabet: Alphabet) -> np.ndarray:
    """Anchors of many documents, by a sample that depends on the rows alone. A miss costs time, never a result."""

    def run(batches):
        for b in slices(batches, "_text", 1 << 20):
            tokens, lengths = alphabet.tokens([t or b"" for t in b.column("_text").to_pylist()])
            u = units(tokens, lengths, alphabet.k, alphabet.width)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.stack([u.doc, u.anchor.view(np.int64)]), axis=1)[1])], ["h"])

    sample = rows.filter(F.xxhash64("d", "_text").bitwiseAND(SAMPLED - 1) == 0).select("_text")
    counted = sample.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    return np.array([r.h for r in counted.orderBy(F.col("n").desc(), "h").limit(MOST).collect()], np.int64)


def _signed(batch_docs: list[bytes], ids: np.ndarray, alphabet: Alphabet, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(h, e, row, at, common) of the units of a batch; those of a common anchor go by their content.

    ``at`` holds the first window's start (from bit SHIFT), how far behind the last window's start the anchor lies (7
    bits), a mark and how many windows follow the first (8 bits).

    A unit whose content an earlier document of the batch has is marked: that settles it, so of a group of copies only
    one row per batch has to meet others. Marked rows get a key of their own, which spreads them.
    """
    tokens, lengths = alphabet.tokens(batch_docs)
    u = units(tokens, lengths, alphabet.k, alphabet.width)
    d = ids[u.doc]
    order = np.lexsort((d, u.content, u.anchor))
    h, e = u.anchor[order], u.content[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (e[1:] != e[:-1])] if len(h) else np.zeros(0, bool)
    first = d[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    marked = np.zeros(len(d), bool)
    marked[order] = d[order] > first
    at = (u.first << SHIFT) | (u.place << 9) | (marked.astype(np.int64) << 8) | (u.count - 1)
    often = np.isin(u.anchor.view(np.int64), common)
    key = np.where(often, mixed(u.content), u.anchor)
    key = np.where(marked, mixed(u.content + d.astype(np.uint64) * np.uint64(_BASE) + u.first.astype(np.uint64)), key)
    return key.view(np.int64), u.content.view(np.int64), u.doc, at, often


def _clash(docs: DataFrame) -> bool:
    """Whether one id stands for several texts; then rows are joined by id and text instead of by id."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("d"), F.xxhash64("text").alias("t"))
    return bool(ids.groupBy("d").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").limit(1).count())


def _first_round(rows: DataFrame, alphabet: Alphabet, keys: list[str], common) -> DataFrame:
    """Per document the units settled as repeats of a smaller document, and those to look at window by window.

    Units of a common anchor meet their equals only, which spreads them; all others of them are to be looked at.
    """

    def run(batches):
        for b in slices(batches, "_text", 1 << 20):
            texts = [t or b"" for t in b.column("_text").to_pylist()]
            ids = b.column("d").to_numpy(zero_copy_only=False)
            h, e, row, at, often = _signed(texts, ids, alphabet, common.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(e), *[pa.array(b.column(c).to_numpy(zero_copy_only=False)[row]) for c in keys], pa.array(at), pa.array(often)],
                ["h", "e", *keys, "at", "common"],
            )

    found = rows.mapInArrow(run, "h bigint, e bigint, " + "".join(f"{c} bigint, " for c in keys) + "at bigint, common boolean")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    anchor = Window.partitionBy("h").orderBy("e").rowsBetween(*whole)
    content = Window.partitionBy("h", "e")
    found = found.withColumns({"_a": F.min("d").over(anchor), "_b": F.max("d").over(anchor), "_e": F.min("e").over(anchor), "_f": F.max("e").over(anchor)})
    found = found.withColumn("_m", F.min("d").over(content))
    repeat = (F.col("at").bitwiseAND(256) != 0) | (F.col("d") > F.col("_m"))
    unclear = ~repeat & (F.col("common") | ((F.col("_e") != F.col("_f")) & (F.col("_a") != F.col("_b"))))
    return (
        found.filter(repeat | unclear)
        .groupBy(keys[-1])
        .agg(F.collect_list(F.when(repeat, F.col("at"))).alias("repeats"), F.collect_list(F.when(~repeat, F.col("at"))).alias("unclear"))
    )


def _halves(hashes: Hashes, marks: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, count) of the windows of unclear units, under a longer part that all windows of the row share.

    A window reaches either at least half of its rest to the left of the anchor or more than half to the right; the
    key covers the anchor and that half, so chance repeats of an anchor alone no longer meet.
    """
    k, width = alphabet.k, alphabet.width
    half = (width - k + 1) // 2
    first = marks >> SHIFT
    last = first + (marks & 255)
    p = last + (marks >> 9 & 127)
    split = np.minimum(last, p - half)  # windows up to here reach at least ``half`` to the left
    left, right = split >= first, split < last
    a = np.concatenate([p[left] - half, p[right]])
    key = hashes.ranges(a, np.concatenate([p[left] + k, p[right] + width - half]))
    key[: left.sum()] = mixed(key[: left.sum()] ^ np.uint64(1))
    start = np.concatenate([first[left], np.maximum(first, split + 1)[right]])
    return key, start, np.concatenate([split[left], last[right]]) - start + 1


def _single(marks: np.ndarray, hashes: Hashes, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of every window of units with a common anchor; the key is the window's own."""
    first, n = marks >> SHIFT, (marks & 255) + 1
    start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return mixed(hashes.ranges(start, start + alphabet.width) ^ np.uint64(2)), start


def _met(found: list[tuple], keys: list[str]) -> tuple[list[np.ndarray], list]:
    """Columns of the windows ``_single`` found in a task's documents, with b"" or, for a repeat of a smaller document
    of the task, null: that settles it, so of a window many documents have few rows share its key."""
    key, start = (np.concatenate(c) for c in zip(*[f[:2] for f in found]))
    own = [np.repeat([f[2][i] for f in found], [len(f[0]) for f in found]) for i in range(len(keys))]
    order = np.lexsort((own[0], key))
    k, d = key[order], own[0][order]
    new = np.r_[True, k[1:] != k[:-1]]
    later = np.zeros(len(key), bool)
    later[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    key = np.where(later, mixed(key + own[-1].view(np.uint64) * np.uint64(_BASE) + start.astype(np.uint64)), key)
    return [key, *own, start], [None if x else b"" for x in later.tolist()]


def _unclear_rows(alphabet: Alphabet, keys: list[str], payload: Callable, common):
    def run(batches):
        found, size = [], 0
        u = zstandard.ZstdDecompressor()
        for b in batches:
            cols = {c: [] for c in ("key", *keys, "first", "windows")}
            for z, marks, *own in zip(*[b.column(c).to_pylist() for c in ("z", "unclear", *keys)]):
                if marks is None:
                    continue
                text = u.decompress(z)
                hashes = Hashes(alphabet.tokens([text])[0])
                marks = np.array(marks, np.int64)
                p = (marks >> SHIFT) + (marks & 255) + (marks >> 9 & 127)
                often = np.isin(hashes.ranges(p, p + alphabet.k).view(np.int64), common.value)
                if often.any():
                    found.append((*_single(marks[often], hashes, alphabet), own))
                    size += len(found[-1][0])
                    if size > 200_000:
                        yield out(dict(zip(cols, [*(c := _met(found, keys))[0], c[1]])))
                        found, size = [], 0
                key, first, n = _halves(hashes, marks[~often], alphabet)
                cols["key"].extend(key.tolist())
                for c, v in zip(keys, own):
                    cols[c].extend([v] * len(key))
                cols["first"].extend(first.tolist())
                cols["windows"].extend(payload(text, hashes, first, n, alphabet))
                if len(cols["key"]) > 20_000:
                    yield out(cols)
                    cols = {c: [] for c in cols}
            yield out(cols)
        if found:
            yield out(dict(zip(("key", *keys, "first", "windows"), [*(c := _met(found, keys))[0], c[1]])))

    def out(cols):
        arrays = [pa.array(np.array(cols["key"], np.uint64).view(np.int64)), *[pa.array(cols[c], pa.int64()) for c in (*keys, "first")], pa.array(cols["windows"], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, list(cols))

    return run


def _compared(keys: list[str], unpack: Callable):
    """Windows of rows sorted by (key, d): those of which a smaller document has an equal one, as runs.

    A row without bytes is one window that its key names; one with null is a window settled before.
    """

    def run(batches):
        last, seen = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            d = b.column("d").to_numpy()
            own = b.column(keys[-1]).to_numpy()
            first = b.column("first").to_numpy()
            windows = b.column("windows").to_pylist()
            full = np.array([bool(w) for w in windows])
            counts = np.ones(len(windows), np.int64)
            if full.any():
                some, counts[full] = unpack([w for w in windows if w])
            hashes = np.zeros(int(counts.sum()), np.uint64)
            if full.any():
                hashes[np.repeat(full, counts)] = some
            row = np.repeat(np.arange(len(key)), counts)
            order = np.lexsort((d[row], hashes, key[row]))
            k, h, w_d = key[row][order], hashes[order], d[row][order]
            new = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])] if len(k) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            least = w_d[np.flatnonzero(new)].copy()
            if last is not None and key[0] == last:
                for g, x in enumerate(h[new][k[new] == last].tolist(), int(np.searchsorted(k[new], last))):
                    if x in seen:
                        least[g] = min(least[g], seen[x])
            else:
                seen = {}
            if key[-1] != last:
                last, seen = key[-1], {}
            for x, y in zip(h[new][k[new] == last].tolist(), least[k[new] == last].tolist()):
                seen[x] = min(y, seen.get(x, y))
            gone = np.zeros(len(row), bool)
            gone[order] = w_d > least[group]
            gone |= np.array([w is None for w in windows])[row]
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
            at, r = place[gone], row[gone]
            start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)]) if len(r) else np.zeros(0, np.int64)
            n = np.diff(np.r_[start, len(r)])
            yield pa.RecordBatch.from_arrays([pa.array(own[r[start]]), pa.array((at[start] << SHIFT) | (n - 1))], [keys[-1], "at"])

    return run


def with_repeats(docs: DataFrame, alphabet: Alphabet, payload: Callable, unpack: Callable) -> DataFrame:
    """(doc_id, z, repeats): every row's compressed text and the runs of its windows that a smaller document has.

    A run is one number: the start of its first window (from bit SHIFT) and how many more follow (bits 0 to 7). Texts
    move once, compressed, to where the runs of their document are gathered; both joins read that one exchange.
    """
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    keys = ["d", "r"] if _clash(docs) else ["d"]
    r = keys[-1]
    rows = docs.select("doc_id", d.alias("d"), *([row_key().alias("r")] if len(keys) == 2 else []), F.col("text").cast("binary").alias("_text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, alphabet))
    first = stored(_first_round(rows.select(*keys, "_text"), alphabet, keys, common), "repeats")

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("doc_id", *keys)], pa.array([z.compress(t or b"") for t in b.column("_text").to_pylist()], pa.binary())],
                ["doc_id", *keys, "z"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = rows.mapInArrow(squeeze, f"doc_id {kind}, " + "".join(f"{c} bigint, " for c in keys) + "z binary")
    unclear = first.filter(F.size("unclear") > 0).select(r, "unclear")
    long_keys = "key bigint, " + "".join(f"{c} bigint, " for c in keys) + "first bigint, windows binary"
    # A left join on all columns of the texts, as the last one is: so Spark reads the same exchange twice.
    looked_at = texts.join(unclear, r, "left").select("doc_id", F.when(F.col("unclear").isNotNull(), F.col("z")).alias("z"), "unclear", *keys)
    windows = looked_at.mapInArrow(_unclear_rows(alphabet, keys, payload, common), long_keys)
    more = windows.repartition("key").sortWithinPartitions("key", "d").mapInArrow(_compared(keys, unpack), f"{r} bigint, at bigint")
    more = more.groupBy(r).agg(F.collect_list("at").alias("more"))
    none = F.array().cast("array<bigint>")
    settled = first.filter(F.size("repeats") > 0).select(r, "repeats")
    return texts.join(settled, r, "left").join(more, r, "left").select(
        "doc_id", "z", F.concat(F.coalesce("repeats", none), F.coalesce("more", none)).alias("repeats")
    )


def covered(n: int, runs: list[int], width: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window of a run."""
    depth = np.zeros(n + 1, np.int64)
    if runs:
        x = np.array(runs, np.int64)
        np.add.at(depth, x >> SHIFT, 1)
        np.add.at(depth, (x >> SHIFT) + (x & 255) + width, -1)
    return np.cumsum(depth[:-1]) > 0
