"""Repeated byte strings of at least 50 bytes: seed and extend over bytes.

The method is that of ``substrings`` with bytes for words, not prefix doubling: there are no rank pairs and no reranking.
In every 50 bytes the anchor is the 16-gram with the smallest hash (equal strings have equal anchors). Step one compares
what the anchors' units span on both sides; units that are unique drop out, equal ones are settled. Step two compares the
rest window by window, under the anchor and the 17 bytes beside it.

Each byte covered by a 50-byte string that also starts in a document with a smaller id is removed, judged on the
input. Edge cases: a null text is empty; texts under 50 bytes stay whole; repeats inside one document stay; rows with
the same id do not remove each other's bytes; a null id sorts behind all others. Very long texts are hashed
in pieces; an empty table gives no rows. Kept bytes may cut a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from rulespan.llm.common import mixed
from rulespan.llm.repeats import Alphabet, Hashes, covered, with_repeats

WIDTH, ANCHOR = 50, 16
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _BYTES[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def _pack(text: bytes, hashes, first: np.ndarray, n: np.ndarray, alphabet: Alphabet) -> list[bytes]:
    """The windows as the bytes they span."""
    return [text[a:b] for a, b in zip(first.tolist(), (first + n + alphabet.width - 1).tolist())]


def _unpack(width: int):
    def run(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens, size = _tokens(windows)
        n = size - width + 1
        at = np.arange(int(n.sum())) + np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n)
        return Hashes(tokens).ranges(at, at + width), n

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes of every row."""
    rows = with_repeats(docs, Alphabet(_tokens, anchor, width), _pack, _unpack(width))

    def run(batches):
        u = zstandard.ZstdDecompressor()
        for b in batches:
            n, removed, spans, kept = [], [], [], []
            for z, runs in zip(b.column("z").to_pylist(), b.column("repeats").to_pylist()):
                text = u.decompress(z)
                gone = covered(len(text), runs, width)
                n.append(len(text)), removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if runs else text)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
