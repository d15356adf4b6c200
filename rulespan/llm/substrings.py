"""Passages that an earlier document has already: seed and extend over words.

Seeds are winnowed anchors: in every 13 consecutive words the 5-gram with the smallest hash, so any shared passage of
13 words shares an anchor. Documents are joined on them. A shared anchor is extended both ways over all windows it
stands for; the windows that match in a document with a smaller id are the repeats, and neighbouring ones make up the
maximal repeat, whose words are removed. Anchors that one document has alone are never extended.

Each word covered by such a window is removed, judged on the input. Edge cases: null and empty texts have no words; a
text of fewer than 13 words keeps all; repeats inside one document stay; rows with the same id do not remove each
other's words; a null id sorts behind all others, so it never removes. Very long texts are hashed in pieces; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from rulespan.llm.repeats import Alphabet, covered, with_repeats

WIDTH, ANCHOR = 13, 5


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    known = _words()
    return np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(n.sum())), n


def _pack(text, hashes, first: np.ndarray, n: np.ndarray, alphabet: Alphabet) -> list[bytes]:
    """The windows as their hashes."""
    windows = hashes.all(alphabet.width)
    return [windows[a : a + c].tobytes() for a, c in zip(first.tolist(), n.tolist())]


def _unpack(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(windows), np.uint64), np.array([len(w) // 8 for w in windows], np.int64)


def deduplicate(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space) of every row."""
    rows = with_repeats(docs, Alphabet(_tokens, anchor, width), _pack, _unpack)

    def run(batches):
        u = zstandard.ZstdDecompressor()
        for b in batches:
            n, removed, kept = [], [], []
            for z, runs in zip(b.column("z").to_pylist(), b.column("repeats").to_pylist()):
                words = u.decompress(z).split()
                gone = covered(len(words), runs, width)
                n.append(len(words)), removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if runs else words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")
