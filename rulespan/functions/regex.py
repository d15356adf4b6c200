"""Matches of user-written Python regexes, evaluated in Arrow batches.

Only rows whose argument holds regex syntax carry a pattern; all other rows pass null and cost nothing here.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The function below travels with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HITS = "array<array<struct<n:int,found:array<string>>>>"
_HITS_ARROW = pa.list_(
    pa.list_(pa.struct([("n", pa.int32()), ("found", pa.list_(pa.string()))]))
)

# First letter of a pattern: how to search. e/f stop early like all(...) over the sorted keywords does.
_FLAGS = {"i": re.I, "e": re.I, "f": re.I, "m": re.M, "l": 0, "c": 0, "r": 0}


def _search(text: str, patterns: list[str]) -> list[dict]:
    out: list[dict] = []
    for tagged in patterns:
        mode, pattern = tagged[0], tagged[1:]
        try:
            found = [m.group(0) for m in re.finditer(pattern, text, _FLAGS[mode])]
        except re.error:
            out.append({"n": -1, "found": None})
            break
        out.append({"n": len(found), "found": found if mode == "r" else None})
        if (mode == "e" and not found) or (mode == "f" and found):
            break
    return out


def regex_hits(text: Column, patterns: Column) -> Column:
    """Per constraint and pattern, the match count (-1: invalid pattern) and, for mode r, the matched texts."""

    @F.arrow_udf(HITS)
    def search(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        if wanted.null_count == len(wanted):
            return pa.nulls(len(wanted), _HITS_ARROW)
        rows = [
            None if w is None else [None if p is None else _search(t or "", p) for p in w]
            for t, w in zip(texts.to_pylist(), wanted.to_pylist(), strict=True)
        ]
        return pa.array(rows, _HITS_ARROW)

    return search(text, patterns)
