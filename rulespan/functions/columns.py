"""Small column rules over token counts, labels and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bin labels and edges. The first label set reads one higher than its left-closed edges.
LENGTH_BINS = ((128, "001-128"), (256, "129-256"), (512, "257-512"), (1024, "513-1024"), (2048, "1025-2047"))
LENGTH_BUCKETS = (
    (64, "0001-0064"), (128, "0065-0128"), (256, "0129-0256"), (512, "0257-0512"), (1024, "0513-1024"),
    (2048, "1025-2048"),
)
TOKEN_BINS = ((512, "<=512"), (1024, "513-1024"), (1536, "1025-1536"), (2048, "1537-2048"))

# Phrases that mark a request as too long for the model's context.
CONTEXT_ERRORS = (
    "maximum context", "context length", "max model len", "maximum model length", "tokens exceed", "too long",
)


def _binned(x: Column, edges, closed_left: bool, beyond: Column) -> Column:
    out = None
    for edge, label in edges:
        inside = x < edge if closed_left else x <= edge
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out.otherwise(beyond)


def length_bin(tokens: Column) -> Column:
    """Left-closed bins [0,128) [128,256) ...; text 'nan' outside of [0,2048)."""
    return F.when((tokens < 0) | tokens.isNull(), "nan").otherwise(
        _binned(tokens, LENGTH_BINS, True, F.lit("nan"))
    )


def length_bucket(tokens: Column) -> Column:
    """Right-closed bins [0,64] (64,128] ... and 2049+."""
    return _binned(tokens, LENGTH_BUCKETS, False, F.lit("2049+"))


def token_bin(tokens: Column) -> Column:
    return _binned(tokens, TOKEN_BINS, False, F.lit(">2048"))


def is_context_error(ok: Column, error: Column) -> Column:
    return ~ok & F.coalesce(F.lower(error).rlike("|".join(CONTEXT_ERRORS)), F.lit(False))
