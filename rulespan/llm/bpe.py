"""Byte-pair encoding and decoding with a public word vocabulary, without its library.

Text is split at special tokens, put in NFC and lower case and cut into words; a word's bytes are merged in the order
of the merge table. Short words use one contiguous array of part boundaries with the rank of each adjacent pair: scan
for the smallest rank, delete that boundary, refresh the ranks beside it. The scan is quadratic, so words of more than
``LONG`` bytes use a heap of pairs with the same result. Decoding joins the vocabulary's strings by a space.

Edge cases: a null text is empty; empty text has no tokens and decodes to empty text; special tokens in a text are
their own ids. Of pairs with one rank the leftmost is merged first. Repeated rows, and rows without an id, are encoded
each for itself; an empty table gives no rows. Texts of any length are encoded whole, in batches that hold about a
megabyte of text (one longer text stays alone). Work is row-local; the cache of words a task keeps is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from rulespan.llm.common import slices

#: Bytes of a word from which the heap takes over.
LONG = 96
#: Words a task remembers at once.
CACHED_WORDS = 200_000
_END = "</w>"


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free character from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Codec:
    def __init__(self, source: str):
        """``source``: the text of the tokenizer's file."""
        spec = json.loads(source)
        vocab, special = spec["model"]["vocab"], spec["added_tokens"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in special}
        self.special = {t["content"]: t["id"] for t in special}
        self._at_special = regex.compile("|".join(map(regex.escape, self.special))) if special else None
        self._word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._one = [vocab[c] for c in _byte_characters()]
        self._last = [vocab[c + _END] for c in _byte_characters()]
        self._rank = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self._rank[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self._cache: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        at = 0
        for m in self._at_special.finditer(text) if self._at_special else ():
            self._plain(text[at : m.start()], out)
            out.append(self.special[m[0]])
            at = m.end()
        self._plain(text[at:], out)
        return out

    def forget(self) -> None:
        self._cache.clear()

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def _plain(self, text: str, out: list[int]) -> None:
        cache = self._cache
        for word in self._word.findall(lowered(text)):
            ids = cache.get(word)
            if ids is None:
                ids = self._merged(word)
                if len(word) <= LONG:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = ids
            out.extend(ids)

    def _merged(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        parts = [self._one[b] for b in raw[:-1]] + [self._last[raw[-1]]]
        return tuple(self._by_scan(parts) if len(parts) <= LONG else self._by_heap(parts))

    def _by_scan(self, parts: list[int]) -> list[int]:
        none = (len(self._rank), -1)
        ranks = [self._rank.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low is none or low[1] < 0:
                break
            i = ranks.index(low)
            parts[i] = low[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = self._rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = self._rank.get((parts[i], parts[i + 1]), none)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        """Smallest rank first, leftmost first among equals; entries whose parts have changed since are passed over."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (found := self._rank.get((parts[i], parts[after[i]]))):
                heapq.heappush(heap, (found[0], i, parts[i], parts[after[i]], found[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [p for p in parts if p >= 0]


def lowered(text: str) -> str:
    """NFC, then each character's own lower case (without the final form of sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=4)
def codec(source: str) -> Codec:
    return Codec(source)


@contextmanager
def borrowed(source: str) -> Iterator[Codec]:
    """The codec for one task. Its worker lives on through later stages, so the words it has met do not stay with it."""
    c = codec(source)
    try:
        yield c
    finally:
        c.forget()


def _source(spark, path: str):
    """The tokenizer's file, read once by the driver; its size is fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _fields(docs: DataFrame, keep) -> tuple[list, str]:
    fields = [f for f in docs.schema.fields if f.name in keep]
    return fields, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)


#: Token ids in one Arrow batch of results, so that one batch holds a bounded number of bytes.
IDS_A_BATCH = 1 << 19


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns of every row with its token ids; ``decoded`` adds the text they decode to, from the same task."""
    source = _source(docs.sparkSession, path)
    fields, schema = _fields(docs, keep)
    names = [*[f.name for f in fields], "ids", *(["decoded"] if decoded else [])]

    def run(batches):
        with borrowed(source.value) as c:
            for b in slices(batches, "_text", 1 << 20):
                ids = [c.encode(t) for t in b.column("_text").to_pylist()]
                texts = [pa.array([c.decode(i) for i in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(ids, pa.list_(pa.int32())), *texts], names)

    rows = docs.select(*[F.col(f.name) for f in fields], F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}ids array<int>{', decoded string' if decoded else ''}")


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with the text of its ``ids`` (null ids: empty)."""
    source = _source(rows.sparkSession, path)
    fields, schema = _fields(rows, keep)

    def run(batches):
        with borrowed(source.value) as c:
            for whole in batches:
                ends = np.cumsum(pc.fill_null(pc.list_value_length(whole.column("_ids")), 0).to_numpy(zero_copy_only=False)) // IDS_A_BATCH
                cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), whole.num_rows]
                for a, z in zip(cuts, cuts[1:]):
                    b = whole.slice(a, z - a)
                    texts = [c.decode(ids or ()) for ids in b.column("_ids").to_pylist()]
                    yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(texts, pa.string())], [*[f.name for f in fields], "decoded"])

    return rows.select(*[F.col(f.name) for f in fields], F.col("ids").alias("_ids")).mapInArrow(run, f"{schema}decoded string")


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row encoded, its ids decoded again, and both as digests: the ids never leave the task."""
    source = _source(docs.sparkSession, path)
    fields, schema = _fields(docs, keep)

    def run(batches):
        with borrowed(source.value) as c:
            for b in slices(batches, "_text", 1 << 20):
                n, of_ids, of_text = [], [], []
                for text in b.column("_text").to_pylist():
                    ids = c.encode(text)
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(f.name) for f in fields], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                    [*[f.name for f in fields], "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(*[F.col(f.name) for f in fields], F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
