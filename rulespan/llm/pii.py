"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Base spans (email, ip, card, phone by their fixed patterns and checks) are always kept. Beside them, wider patterns
propose candidates: obfuscated addresses, numbers without a plus sign, cards with other separators. Five labelers vote
yes, no or abstain on every candidate: the strict pattern (regex), known domains, calling codes and issuers
(gazetteer), words before it (context), its neighbours (border) and the regularity of its groups (shape). EM over the
counts of vote patterns of all documents estimates each labeler's reliability per kind; the resulting probabilities
train a logistic span classifier, which adds the candidates it finds more likely than not.

Both passes over the texts are row-local. What the driver gets are counts of categorical patterns: at most
4 kinds x 3^5 votes x a few dozen shapes, however many documents there are.

Edge cases: null texts are empty and have no spans; repeated rows get equal results; very long texts are scanned
piecewise by linear patterns; without candidates the classifier adds nothing; an empty table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulespan.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "border", "shape")
#: Code points before a span in which the context labeler looks for its words.
BEFORE = 32
#: Masks by which ``redact`` replaces spans.
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WIDE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}")
_WIDE_PHONE = re.compile(r"[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")
_WIDE_CARD = re.compile(r"[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")

# What the gazetteer knows.
DOMAIN_ENDS = {"com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "uk", "it", "eu", "us", "example"}
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
CUES = {
    "email": ("mail", "contact", "contacto", "kontakt", "courriel", "correo", "write to"),
    "ip": ("ip", "host", "server", "address", "adresse", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "numéro", "teléfono"),
}
COUNTER_CUES = ("version", "release", "isbn", "issn", "doi", "order", "invoice", "page", "figure", "table", "section", "§")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """Per kind every leftmost match of its pattern, and whether it passes the kind's check."""
    out: dict[str, list[tuple[int, int, bool]]] = {k: [] for k in KINDS}
    end, at = 0, text.find("@")
    while at >= 0:
        # Only the run of local characters before an @ can start a match, and only labels after it can end one.
        start = at
        while start > end and _LOCAL.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out["email"].append((start, domain.end(), True))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    for m in _DOTTED.finditer(text):
        labels, at = m[0].split("."), m.start()
        for i in range(0, len(labels) - 3, 4):
            four = labels[i : i + 4]
            n = len(".".join(four))
            out["ip"].append((at, at + n, all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four)))
            at += n + 1
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        out["card"].append((*m.span(), 13 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text):
        out["phone"].append((*m.span(), 9 <= len(_digits(m[0])) <= 15))
    return out


def _votes(text: str, kind: str, a: int, b: int, strict: int) -> tuple[int, ...]:
    s = text[a:b]
    d = _digits(s[:64])
    before = text[max(0, a - BEFORE) : a].lower()
    if kind == "email":
        known = 1 if s.lower().rstrip(")] ").rpartition(".")[2] in DOMAIN_ENDS else -1
        shape = 1 if re.search("[A-Za-z]", s) else -1
    elif kind == "ip":
        known = -1 if s.startswith("0.") else 1
        shape = 1 if all(x == "0" or x[0] != "0" for x in s.split(".")) else -1
    elif kind == "card":
        known = 1 if d.startswith(ISSUERS) else -1
        shape = 1 if luhn(d) and 13 <= len(d) <= 19 else -1
    else:
        known = (1 if d.startswith(CALLING_CODES) else -1) if s[0] == "+" else 0
        shape = 1 if 9 <= len(d) <= 15 and len(set(d)) > 2 else -1
    if any(c in before for c in COUNTER_CUES):
        context = -1
    else:
        context = int(any(c in before for c in CUES[kind]))
    border = 1 if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()) else -1
    return strict, known, context, border, shape


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...], tuple[int, int]]]:
    """(kind, start, end, is base, votes, shape bins) of every candidate, base ones included.

    Matches of a base pattern that only fall short of the length of a number or card are no candidates.
    """
    out = []
    digit, at_sign = re.search("[0-9]", text), "@" in text
    hidden = "(at" in text or "( at" in text or "[at" in text or "[ at" in text
    if not digit and not at_sign and not hidden:
        return out
    taken: list[tuple[int, int]] = []

    def add(kind, a, b, base, strict):
        n = len(_digits(text[a:b][:64]))
        out.append((kind, a, b, base, _votes(text, kind, a, b, strict), (min(n // 4, 5), min((b - a) // 8, 5))))

    for kind, spans in base_spans(text).items():
        for a, b, ok in spans:
            if ok:
                taken.append((a, b))
            if ok or kind == "ip" or len(_digits(text[a : min(b, a + 64)])) >= 9:
                add(kind, a, b, ok, 1 if ok else -1)
    wide = [("phone", _WIDE_PHONE), ("card", _WIDE_CARD)] if digit else []
    if hidden:
        wide.append(("email", _WIDE_EMAIL))
    taken.sort()
    for kind, pattern in wide:
        i = 0
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "phone":
                if a and text[a - 1] == "(" and ")" in m[0]:
                    a -= 1
                if a and (text[a - 1].isdigit() or text[a - 1] in "+.-"):
                    continue
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                add(kind, a, b, False, 0)
    return out


def _pattern_rows(batches):
    """Counts of (kind, base, votes, shape bins) per task: few, whatever the number of rows."""
    found: Counter = Counter()
    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            for kind, _, _, base, votes, bins in candidates(text or ""):
                found[kind, base, votes, bins] += 1
    keys = list(found)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.bool_()),
            pa.array([list(k[2]) for k in keys], pa.list_(pa.int32())),
            pa.array([list(k[3]) for k in keys], pa.list_(pa.int32())),
            pa.array([found[k] for k in keys], pa.int64()),
        ],
        ["kind", "base", "votes", "bins", "n"],
    )


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern is a real span, and per class, labeler and vote the estimated frequency."""
    p = np.clip(0.5 + votes.sum(1) / (2 * votes.shape[1] + 2), 0.05, 0.95)
    rate = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for y, w in ((0, n * (1 - p)), (1, n * p)):
            for v in (-1, 0, 1):
                # Weak prior: a labeler is right more often than wrong.
                prior = 1 + 2 * (v == (1 if y else -1))
                rate[y, :, v + 1] = ((votes == v) * w[:, None]).sum(0) + prior
        rate /= rate.sum(2, keepdims=True)
        share = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        by = np.log([1 - share, share])[:, None] + np.array([sum(np.log(rate[y, j, votes[:, j] + 1]) for j in range(votes.shape[1])) for y in (0, 1)])
        p = 1 / (1 + np.exp(np.clip(by[0] - by[1], -30, 30)))
    return p, rate


def _features(kind: str, votes, bins) -> np.ndarray:
    x = [1.0]
    for k in KINDS:
        own = kind == k
        x += [float(own), *[float(own) * v for v in votes], *[float(own) * (v == 0) for v in votes]]
    x += [float(bins[0] == i) for i in range(6)] + [float(bins[1] == i) for i in range(6)]
    return np.array(x)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression on soft labels by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge * beta
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta -= step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Weights of the span classifier, and each kind's labeler reliabilities, from the candidates of all documents."""
    rows = docs.select("text").mapInArrow(_pattern_rows, "kind string, base boolean, votes array<int>, bins array<int>, n bigint")
    found = rows.groupBy("kind", "base", "votes", "bins").agg(F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: (r["kind"], r["base"], r["votes"], r["bins"]))
    x, y, w, reliability = [], [], [], {}
    for kind in KINDS:
        own = [r for r in found if r["kind"] == kind]
        if not own:
            continue
        n = np.array([r["n"] for r in own], float)
        p, reliability[kind] = expectation_maximisation(np.array([r["votes"] for r in own]), n)
        x += [_features(kind, r["votes"], r["bins"]) for r in own]
        y += list(p)
        w += list(np.log1p(n))  # frequent patterns count more, but do not drown the rare ones
    beta = _logistic(np.array(x), np.array(y), np.array(w)) if x else np.array([])
    return beta, reliability


def spans(text: str, beta: np.ndarray, known: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those that the classifier adds; both by kind as listed, then start."""
    base, more = [], []
    for kind, a, b, is_base, votes, bins in candidates(text):
        if is_base:
            base.append((kind, a, b))
            continue
        if votes[0] < 0:  # a failed check is never overruled
            continue
        key = (kind, votes, bins)
        if key not in known:
            known[key] = float(_features(kind, votes, bins) @ beta) > 0
        if known[key]:
            more.append((kind, a, b))
    order = lambda s: (KINDS.index(s[0]), s[1])
    base.sort(key=order)
    taken: list[tuple[str, int, int]] = []
    for s in sorted(more, key=lambda s: (s[1], -s[2])):
        if not taken or s[1] >= taken[-1][2]:
            taken.append(s)
    return base, sorted(base + taken, key=order)


def _written(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with counts and digest of the base spans, and all spans."""
    beta, _ = fit(docs)
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)

    def run(batches):
        known: dict = {}
        for batch in slices(batches, "_text"):
            counts, digest, all_ = {k: [] for k in KINDS}, [], []
            for text in batch.column("_text").to_pylist():
                base, found = spans(text or "", beta, known)
                n = Counter(k for k, _, _ in base)
                for k in KINDS:
                    counts[k].append(n[k])
                digest.append(hashlib.sha256(_written(base).encode()).hexdigest())
                all_.append(_written(found))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in fields], *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digest, pa.string()), pa.array(all_, pa.string())],
                [*[f.name for f in fields], *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    rows = docs.select(*[F.col(f.name) for f in fields], F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind's mask; of overlapping spans the first, and the longest from there."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], MASKS[kind]]
            at = b
        elif b > at:  # the rest of a span that overlaps the one before goes too
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the spans in ``text`` replaced by masks. Null texts stay null."""
    beta, _ = fit(docs)
    schema = docs.schema

    def run(batches):
        known: dict = {}
        for batch in slices(batches, "text"):
            texts = [t if t is None else masked(t, spans(t, beta, known)[1]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, schema)
