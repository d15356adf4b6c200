"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression with literal tokens that each match of it must hold. The rarest of them, counted
over all urls, indexes the rule. The tokens of a url fetch its candidate rules, and only those run their expression.

Two kinds of rules go through the same index. Site rules ``host/path`` fit a host and its subdomains if the url's path
starts with theirs; the longest that fits wins. Where none fits, the method's own pattern rules decide: block where
one matches, else allow. Work is row-local: a hot host needs no shuffle.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no site rule; patterns still see
its text. Repeated urls get equal results, an empty table none; urls of
any length are read whole: their tokens fetch rules, and only these run. ``MOST_RULES`` bounds the index each task holds; more rules raise.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST_RULES = 100_000

# The site rules of the query, in the order given.
SITE_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: The method's own rules: what advertisement and tracking links look like.
PATTERN_RULES = (
    ("block", r"://([a-z0-9-]+\.)*ads-track\.", ("ads", "track")),
    ("block", r"://([a-z0-9-]+\.)*doubleclick\.", ("doubleclick",)),
    ("block", r"/(ads|banners)/", ("ads",)),
    ("block", r"/(ads|banners)/", ("banners",)),
    ("block", r"[?&]click_?id=", ("clickid",)),
    ("block", r"[?&]click_id=", ("click", "id")),
)
_TOKEN = re.compile(r"[a-z0-9]+|[^\x00-\x7f]+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    name: str | None = None  # of a site rule
    path: str = ""  # with which the url's path starts, for a site rule


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def site_rule(verdict: str, name: str) -> Rule:
    """The expression fits the host itself, or the host behind a dot; the path is compared as it is."""
    host, slash, path = name.partition("/")
    pattern = rf"(?s)(?:.*\.)?{re.escape(host)}\Z"
    # Tokens of the host end at dots; of the path only those that the rule closes are sure to stand alone.
    closed = _TOKEN.findall(host) + _TOKEN.findall(lower_ascii(path).rpartition("/")[0])
    return Rule(verdict, pattern, tuple(closed), name, slash + path)


def rules(site: Sequence[tuple[str, str]] = SITE_RULES, patterns=PATTERN_RULES) -> list[Rule]:
    out = [site_rule(v, n) for v, n in site] + [Rule(v, p, tuple(t)) for v, p, t in patterns]
    if len(out) > MOST_RULES:
        raise ValueError(f"{len(out)} rules; one index holds at most {MOST_RULES}")
    if any(not r.literals for r in out):
        raise ValueError("every rule needs a literal token")
    return out


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = re.search("[?#]", rest)
    rest = rest[: end.start()] if end else rest
    host, slash, path = rest.partition("/")
    return lower_ascii(host), slash + path


def tokens(url: str) -> set[str]:
    return set(_TOKEN.findall(lower_ascii(url)))


def token_counts(pages: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """In how many urls each wanted token is: one row per wanted token reaches the driver."""

    def run(batches):
        for batch in batches:
            found = dict.fromkeys(wanted, 0)
            for url in batch.column("url").to_pylist():
                for t in tokens(url or "") & found.keys():
                    found[t] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    rows = pages.select("url").mapInArrow(run, "token string, n bigint")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def judge(pages: DataFrame, listed: Sequence[Rule] | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns of every row with host, path, the site rule that decided and the verdict."""
    listed = rules() if listed is None else list(listed)
    n = token_counts(pages, sorted({t for r in listed for t in r.literals}))
    index: dict[str, list[Rule]] = {}
    for r in listed:
        index.setdefault(min(r.literals, key=lambda t: (n.get(t, 0), t)), []).append(r)
    known = pages.sparkSession.sparkContext.broadcast({t: [(r.verdict, r.pattern, r.name, r.path) for r in rs] for t, rs in index.items()})
    fields = [f for f in pages.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        ready = {t: [(v, re.compile(p), name, start) for v, p, name, start in rs] for t, rs in known.value.items()}
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column("_url").to_pylist():
                host, path = parts(url)
                low = lower_ascii(url or "")
                best, blocked = None, False
                for t in tokens(url or "") & ready.keys():
                    for verdict, pattern, name, start in ready[t]:
                        if name is None:
                            blocked |= verdict == "block" and bool(pattern.search(low))
                        elif path.startswith(start) and pattern.match(host) and (best is None or len(name) > len(best[1])):
                            best = (verdict, name)
                hosts.append(host), paths.append(path)
                names.append(best and best[1])
                verdicts.append(best[0] if best else "block" if blocked else "allow")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in fields], *[pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts)]],
                [*[f.name for f in fields], "host", "path", "rule", "verdict"],
            )

    rows = pages.select(*[F.col(f.name) for f in fields], F.col("url").alias("_url"))
    return rows.mapInArrow(run, f"{schema}, host string, path string, rule string, verdict string")
