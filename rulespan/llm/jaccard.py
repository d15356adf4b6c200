"""Exact Jaccard join of documents' word n-gram sets by universe partition and the pigeonhole principle.

Sets fall into size bands. Two sets with Jaccard similarity of at least t, the smaller of them in a band, differ in at
most D elements, a number the band fixes. The universe of hashed n-grams is cut into segments by a second hash; a
segment asks either for equality (it detects a difference of none) or, through its one-deletion neighbourhood, for a
difference of at most one. If the segments' allowances add up to D + 1, two linked sets must agree in one segment, so
every linked pair shares a signature. How many segments of each kind a band gets is decided by cost: the rows that are
emitted against the pairs that are expected to collide, from counts over all documents.

Only sets that share a signature go on. In each signature group the others are first compared with one pivot, the
member most connected elsewhere; members that end in the component of all the rest need no further comparison. Only
pairs of one group that still lie in different components are then compared, in blocks, through bit vectors whose
distance bounds the difference from below, and at last set by set, in the same block. Sets that share many large groups
meet in the first they both know of. No link between different texts is lost, and what leaves a block are its members
that need their text, then links: never a group's pairs.

Shingles are 64-bit hashes; equality of sets and similarities are decided on these. A set goes by the first 64 bits of
its 128-bit digest; sets that differ but share them are found by the other bits and get names of their own.
Equal sets are one node. Edge cases: null or empty texts have the empty set and link with nothing; fewer words than
an n-gram make one shingle of all words; a null doc_id sorts behind all others; repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespan.llm.common import LAST_ID, mixed, row_name, slices, stored
from rulespan.llm.components import connected

N_GRAM = 3
#: Linked from this intersection on, in hundredths of the union.
HUNDREDTHS = 90
#: Upper over lower size of a band, as a power of the ratio of sizes that can still link.
BAND_POWER = 1.5
#: Groups of up to so many members meet in a plain join, each row with a bounded number of others.
SMALL = 32
#: Members of a larger signature group compared with each other in one block.
BLOCK = 1024
#: Elements of their sets, about: what a block holds of long texts.
ELEMENTS = 4 << 20
#: So many of its large groups, the first by signature, each set brings along.
FIRST = 16
#: Words whose hashes a worker remembers; it lives on through later stages and so does this.
KNOWN_WORDS = 50_000
#: Bits of the vectors that bound differences from below.
BITS = 512
#: What one pair that collides by chance costs, in emitted rows (cost model only).
PAIR_COST = 5.0

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, remembered up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: bytes | None, n: int = N_GRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of lower-cased (A-Z) words between ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = mixed(out * _ODD + h[j : len(h) - size + 1 + j])
    return np.unique(out)


class Names:
    """Names of sets: 64 bits of their digest, but for those in ``renamed`` (name and other bits -> new name).

    ``bits`` is lower in tests only, so that sets meet under one name.
    """

    def __init__(self, bits: int = 64, renamed: dict[tuple[int, int], int] | None = None):
        self.bits, self.renamed = bits, renamed or {}

    def of(self, tokens: np.ndarray) -> tuple[int, int]:
        d = xxhash.xxh3_128_digest(tokens.tobytes())
        name = int.from_bytes(d[:8], "little", signed=True) >> 64 - self.bits
        check = int.from_bytes(d[8:], "little", signed=True)
        return self.renamed.get((name, check), name), check


def similar(a: np.ndarray, b: np.ndarray, hundredths: int) -> bool:
    if not len(a) or not len(b):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= hundredths * (len(a) + len(b) - both)


class Bands:
    """Size bands, and the allocation of segments chosen for each."""

    def __init__(self, largest: int, hundredths: int):
        self.t = hundredths
        ratio = (100 / hundredths) ** BAND_POWER
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * ratio)))
        n = len(self.low)
        self.exact, self.near, self.spare = [0] * n, [0] * n, [0] * n

    def partner(self, size: int) -> int:
        """The largest set that can link with one of this size."""
        return size * 100 // self.t

    def difference(self, band: int) -> int:
        """The most elements in which a set of this band can differ from a linked one that is not smaller."""
        top = self.low[band + 1] - 1
        return (top + self.partner(top)) * (100 - self.t) // (100 + self.t)

    def allocate(self, band: int, n: int, mean: float) -> None:
        """Segments that ask for equality, those that allow one deletion, and spare ones: the cheapest mix."""
        need = self.difference(band) + 1
        if need == 1:  # only equal sets link, and those are one node already
            return

        def cost(near: int, spare: int) -> float:
            exact = need - 2 * near + spare
            each = mean / (exact + near)
            empty = math.exp(-each)
            expected = exact * empty
            # Chance that a set has more empty segments than spare ones, so that it signs them.
            signs = 1 - sum(math.exp(i * math.log(expected) - expected - math.lgamma(i + 1)) for i in range(spare + 1)) if spare else 1.0
            pairs = PAIR_COST * n * empty * empty * max(signs, 0.0)
            return exact * (1 + pairs) + near * (1 + each) * (1 + pairs * each)

        options = [(near, 0) for near in range(need // 2 + 1)]
        options += [(0, round(1.3**i)) for i in range(1, 40) if 1.3**i <= need]
        self.near[band], self.spare[band] = min(options, key=lambda o: cost(*o))
        self.exact[band] = need - 2 * self.near[band] + self.spare[band]

    def of(self, size: int) -> list[int]:
        """Bands in which a set signs: its own, and those below from which a smaller set can link with it."""
        b = int(np.searchsorted(self.low, size, side="right")) - 1
        out = [b]
        while out[-1] and self.partner(self.low[out[-1]] - 1) >= size:
            out.append(out[-1] - 1)
        return out

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        out = []
        for band in self.of(len(tokens)):
            m = self.exact[band] + self.near[band]
            if not m:
                continue
            salt = np.uint64((band * 2 + 1) * int(_ODD) % 2**64)
            part = (mixed(tokens + salt) >> np.uint64(11)) % np.uint64(m)
            value = mixed(tokens * (salt | np.uint64(1)))
            n = np.bincount(part.astype(np.int64), minlength=m)
            order = np.argsort(part.astype(np.uint16 if m < 65536 else np.uint32), kind="stable")
            running = np.concatenate([[np.uint64(0)], np.cumsum(value[order], dtype=np.uint64)])
            ends = np.cumsum(n)
            total = running[ends] - running[ends - n]
            place = mixed(np.arange(m, dtype=np.uint64) + salt)
            signed = total ^ place
            if self.spare[band] and (n == 0).sum() <= self.spare[band]:
                signed = signed[n > 0]
            out.append(mixed(signed))
            if self.near[band]:  # the last segments also sign each set that lacks one of their elements
                far = part >= self.exact[band]
                at = part[far].astype(np.int64)
                out.append(mixed((total[at] - value[far]) ^ place[at]))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _bits(tokens: np.ndarray) -> list[int]:
    """The parity of the elements in each of BITS classes: two vectors differ in no more bits than the sets in elements."""
    n = np.bincount((mixed(tokens ^ _ODD) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64).tolist()


def _raw(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.col("text").cast("binary").alias("_text"))


def sets(docs: DataFrame, n_gram: int = N_GRAM, names: Names = Names()) -> DataFrame:
    """(doc_id, _k, n, sid, check) of every row: size, name and other bits of its set, nulls for the empty set."""

    def run(batches):
        for b in slices(batches, "_text"):
            n, sid, check = [], [], []
            for text in b.column("_text").to_pylist():
                t = shingles(text, n_gram)
                ids = names.of(t) if len(t) else (None, None)
                n.append(len(t)), sid.append(ids[0]), check.append(ids[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_k"), *[pa.array(x, pa.int64()) for x in (n, sid, check)]], ["doc_id", "_k", "n", "sid", "check"]
            )

    return _raw(docs, F.col("doc_id").cast("bigint"), row_name().alias("_k")).mapInArrow(run, "doc_id bigint, _k string, n bigint, sid bigint, check bigint")


def named_sets(docs: DataFrame, n_gram: int = N_GRAM, bits: int = 64) -> tuple[DataFrame, Names]:
    """``sets``, written, and the names in which no two different sets meet.

    Of some billion sets one pair is expected to share 64 bits, and the list of such sets grows that slowly: it is all
    that passes through the driver. The sets are named again until no name is shared.
    """
    names = Names(bits)
    while True:
        members = stored(sets(docs, n_gram, names), "shingle-sets")
        shared = members.groupBy("sid").agg(F.min("check").alias("_a"), F.max("check").alias("_b")).filter("_a <> _b").select("sid")
        clashing = members.join(shared, "sid").select("sid", "check").distinct().collect()
        if not clashing:
            return members, names
        first = {}
        for sid, check in sorted(clashing):
            if first.setdefault(sid, check) != check:
                fresh = int.from_bytes(xxhash.xxh3_64_digest(f"{sid}:{check}:{len(names.renamed)}".encode()), "little", signed=True)
                old = next((k for k, v in names.renamed.items() if v == sid and k[1] == check), (sid, check))
                names.renamed[old] = fresh


def _allocated(members: DataFrame, hundredths: int) -> Bands:
    largest = members.agg(F.max("n")).first()[0] or 1
    bands = Bands(largest, hundredths)
    band = F.lit(0)
    for i, low in enumerate(bands.low):
        band = F.when(F.col("n") >= low, i).otherwise(band)
    for r in members.filter("n > 0").groupBy(band.alias("band")).agg(F.count("*").alias("sets"), F.avg("n").alias("mean")).collect():
        bands.allocate(r["band"], r["sets"], r["mean"])
    # A band without sets of its own can still hold the smaller partner's signatures of none: it needs no segment.
    return bands


def _signed(docs: DataFrame, bands: Bands, n_gram: int, names: Names) -> DataFrame:
    """(g, sid): every signature of every set, once per batch."""
    known = docs.sparkSession.sparkContext.broadcast(bands)

    def run(batches):
        for b in slices(batches, "_text"):
            keys, ids, seen = [], [], set()
            for text in b.column("_text").to_pylist():
                t = shingles(text, n_gram)
                if not len(t):
                    continue
                sid = names.of(t)[0]
                if sid in seen:
                    continue
                seen.add(sid)
                g = known.value.signatures(t)
                keys.append(g.view(np.int64))
                ids.append(np.full(len(g), sid, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["g", "sid"])

    return _raw(docs).mapInArrow(run, "g bigint, sid bigint")


def _shared(signed: DataFrame) -> DataFrame:
    """Rows of the signatures that at least two sets have."""
    group = Window.partitionBy("g").orderBy("sid")
    whole = Window.partitionBy("g")
    rows = signed.withColumns({"_last": F.lag("sid").over(group), "_a": F.min("sid").over(whole), "_b": F.max("sid").over(whole)})
    return rows.filter("_a <> _b AND (_last IS NULL OR _last <> sid)").select("g", "sid")


def _packed(docs: DataFrame, wanted: DataFrame, n_gram: int) -> DataFrame:
    """(sid, z, n, bits) of the sets in ``wanted`` (_k, sid): compressed text, size and bit vector."""

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array([z.compress(t or b"") for t in b.column("_text").to_pylist()], pa.binary())], ["_k", "z"])

    def measure(batches):
        u = zstandard.ZstdDecompressor()
        for b in batches:
            n, bits = [], []
            for z in b.column("z").to_pylist():
                t = shingles(u.decompress(z), n_gram)
                n.append(len(t)), bits.append(_bits(t))
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("z"), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], ["sid", "z", "n", "bits"])

    texts = _raw(docs, row_name().alias("_k")).mapInArrow(squeeze, "_k string, z binary")
    return wanted.join(texts, "_k").dropDuplicates(["_k"]).select("sid", "z").mapInArrow(measure, "sid bigint, z binary, n bigint, bits array<bigint>")


def _verified(pairs: DataFrame, packed: DataFrame, n_gram: int, hundredths: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, decided on the whole sets."""

    def run(batches):
        u = zstandard.ZstdDecompressor()
        for batch in batches:
            out_a, out_b, last, kept = [], [], None, None
            for a, b, za, zb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "za", "zb")]):
                if b != last:
                    last, kept = b, shingles(u.decompress(zb), n_gram)
                if similar(shingles(u.decompress(za), n_gram), kept, hundredths):
                    out_a.append(a), out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    one = packed.select(F.col("sid").alias("a"), F.col("z").alias("za"))
    other = packed.select(F.col("sid").alias("b"), F.col("z").alias("zb"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "za", "zb").mapInArrow(run, "a bigint, b bigint")


def _possible(pairs: DataFrame, packed: DataFrame, hundredths: int) -> DataFrame:
    """The pairs (a, b) that sizes and bit vectors cannot rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(packed.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)
    return pairs.filter(_not_ruled_out(hundredths)).select("a", "b")


def _not_ruled_out(hundredths: int) -> Column:
    """The test of ``_possible`` on (na, bitsa) and (nb, bitsb)."""
    word = lambda i: F.bit_count(F.get("bitsa", F.lit(i)).bitwiseXOR(F.get("bitsb", F.lit(i))))
    apart = reduce(Column.__add__, [word(i) for i in range(BITS // 64)])
    sizes = 100 * F.least("na", "nb") >= hundredths * F.greatest("na", "nb")
    return sizes & (apart * (100 + hundredths) <= (F.col("na") + F.col("nb")) * (100 - hundredths))


def _meetings(pdf: pd.DataFrame, hundredths: int, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every row x of two blocks of a group, with the rows y that it may link with and does not meet elsewhere.

    They lie in different components (``c``, which may change between two steps), sizes and bit vectors do not rule a
    link out, and neither set's ``first`` groups hold an earlier one of both: there the two meet already.
    """
    bits = np.array(pdf["bits"].tolist(), np.int64).view(np.uint64).reshape(len(pdf), -1)
    first = np.array(pdf["first"].tolist(), np.int64)
    n, sid, own = (pdf[x].to_numpy() for x in ("n", "sid", "_own"))
    g, i, j = (pdf[x].iloc[0] for x in ("g", "_i", "_j"))
    for x in np.flatnonzero(own == i):
        y = np.flatnonzero((own == j) & (c != c[x]) & ((sid > sid[x]) | (i != j)))
        y = y[100 * np.minimum(n[y], n[x]) >= hundredths * np.maximum(n[y], n[x])]
        far = np.bitwise_count(bits[y] ^ bits[x]).sum(1)
        y = y[far * (100 + hundredths) <= (n[y] + n[x]) * (100 - hundredths)]
        if len(y):
            y = y[~np.isin(first[y], first[x][first[x] < g]).any(1)]
        if len(y):
            yield x, y


def _linked(rows: DataFrame, packed: DataFrame, n_gram: int, hundredths: int) -> DataFrame:
    """Links (a, b) that join the components of two blocks, at most one for each component in them.

    First each pair of blocks names its rows that may link with another; only those get their texts and meet again,
    to be decided on the whole sets. What leaves either step grows with the rows, not with their pairs.
    """

    def name(pdf):
        kept = np.zeros(len(pdf), bool)
        for x, y in _meetings(pdf, hundredths, pdf["component"].to_numpy()):
            kept[x] = kept[y] = True
        return pdf[kept]

    def link(pdf):
        u = zstandard.ZstdDecompressor()
        c, sid, z, known = pdf["component"].to_numpy(copy=True), pdf["sid"].to_numpy(), pdf["z"].to_numpy(), {}
        out = []
        for x, near in _meetings(pdf, hundredths, c):
            for y in near:
                if c[x] == c[y]:
                    continue
                for r in (x, y):
                    if r not in known:
                        known[r] = shingles(u.decompress(z[r]), n_gram)
                if similar(known[x], known[y], hundredths):
                    out.append((max(sid[x], sid[y]), min(sid[x], sid[y])))
                    c[c == c[y]] = c[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    named = rows.groupBy("g", "_i", "_j").applyInPandas(name, rows.schema)
    return named.join(packed.select("sid", "z"), "sid").groupBy("g", "_i", "_j").applyInPandas(link, "a bigint, b bigint")


def _close(members: DataFrame, hundredths: int, packed: DataFrame | None = None, n_gram: int = N_GRAM) -> DataFrame:
    """Pairs of one group in different components that sizes and bit vectors cannot rule out.

    ``members``: (g, sid, n, bits, component). Groups of up to SMALL members are joined with themselves. A larger one
    is cut into blocks of about BLOCK members and ELEMENTS elements, and every two of its blocks meet in one place.
    Two sets meet in the first large group that both know of. With the texts (``packed``) only links leave the blocks;
    without them, all pairs that pass.
    """
    size = members.groupBy("g").agg(F.count("*").alias("_r"), F.sum("n").alias("_e"), F.min("component").alias("_c"), F.max("component").alias("_d"))
    parts = F.ceil(F.greatest(F.col("_r") / BLOCK, F.col("_e") / ELEMENTS)).cast("int")
    counted = members.join(size.filter("_c <> _d").select("g", "_r", parts.alias("_p")), "g")
    small = counted.filter(F.col("_r") <= SMALL)
    side = lambda x: small.select("g", F.col("sid").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "bits", "component")])
    few = side("a").join(side("b"), "g").filter((F.col("a") > F.col("b")) & (F.col("componenta") != F.col("componentb")) & _not_ruled_out(hundredths))
    large = stored(counted.filter(F.col("_r") > SMALL).select("g", "_p", "sid", "n", "bits", "component"), "large-groups")
    # As many for each set: behind its last group stands a number that is before none.
    first = F.slice(F.concat(F.sort_array(F.collect_list("g")), F.array_repeat(F.lit(LAST_ID), FIRST)), 1, FIRST)
    rows = large.join(large.groupBy("sid").agg(first.alias("first")), "sid").withColumn("_own", F.pmod(F.xxhash64("sid"), "_p").cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    rows = rows.withColumns({"_i": F.least("_own", "__other"), "_j": F.greatest("_own", "__other")})
    rows = rows.select("g", "_i", "_j", "_own", "sid", "n", "bits", "component", "first")

    def pairs(pdf):
        sid = pdf["sid"].to_numpy()
        out = [(max(sid[x], sid[y]), min(sid[x], sid[y])) for x, near in _meetings(pdf, hundredths, pdf["component"].to_numpy()) for y in near]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    if packed is None:
        many = rows.groupBy("g", "_i", "_j").applyInPandas(pairs, "a bigint, b bigint")
    else:
        many = _linked(rows, packed, n_gram, hundredths)
    return few.select("a", "b").unionByName(many).distinct()


def components(docs: DataFrame, n_gram: int = N_GRAM, hundredths: int = HUNDREDTHS, name_bits: int = 64) -> DataFrame:
    """(doc_id, _k, n_shingles, component_id, n_copies, first) of every row.

    ``_k`` is the row's key (id and text); ``first`` marks the row that stands for its component, and empty sets.
    """
    members, names = named_sets(docs, n_gram, name_bits)
    first = F.coalesce("doc_id", F.lit(LAST_ID))
    nodes = members.filter("n > 0").groupBy("sid").agg(F.min(F.struct(first.alias("id"), F.col("_k"))).alias("_f"), F.count("*").alias("n_copies"))
    nodes = stored(nodes.select("sid", F.col("_f.id").alias("id"), F.col("_f._k").alias("_k"), "n_copies"), "distinct-sets")
    shared = stored(_shared(_signed(docs, _allocated(members, hundredths), n_gram, names)), "shared-signatures")
    packed = stored(_packed(docs, nodes.join(shared.select("sid").distinct(), "sid").select("_k", "sid"), n_gram), "candidate-sets")

    size = shared.groupBy("g").agg(F.count("*").alias("_r"))
    degree = shared.join(size, "g").groupBy("sid").agg(F.sum("_r").alias("_degree"))
    pivot = shared.join(degree, "sid").groupBy("g").agg(F.max(F.struct("_degree", "sid")).alias("_p")).select("g", F.col("_p.sid").alias("b"))
    star = shared.join(pivot, "g").filter("sid <> b").select(F.col("sid").alias("a"), "b")
    star = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(_verified(_possible(star, packed, hundredths), packed, n_gram, hundredths), "links")
    label = stored(connected(links, "a", "b"), "labels")

    labelled = shared.join(label, F.col("sid") == F.col("node"), "left").select("g", "sid", F.coalesce("component", "sid").alias("component"))
    open_ = labelled.groupBy("g").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("_r")).filter("_a <> _b AND _r > 2")
    rest = labelled.join(open_.select("g"), "g").join(packed.select("sid", "n", "bits"), "sid")
    close = _close(rest, hundredths, packed, n_gram).join(star, ["a", "b"], "left_anti")
    more = stored(_verified(close, packed, n_gram, hundredths), "links")
    if more.limit(1).count():
        label = stored(connected(links.unionByName(more), "a", "b"), "labels")

    named = nodes.join(label, F.col("sid") == F.col("node"), "left").select("sid", "id", "_k", "n_copies", F.coalesce("component", "sid").alias("c"))
    smallest = named.groupBy("c").agg(F.min(F.struct("id", "_k")).alias("_least"))
    done = named.join(smallest, "c").select("sid", F.col("_least.id").alias("_id"), F.col("_least._k").alias("_first"), "n_copies")
    return members.join(done, "sid", "left").select(
        "doc_id",
        "_k",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.nullif("_id", F.lit(LAST_ID)), "doc_id").alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        (F.col("_first").isNull() | (F.col("_first") == F.col("_k"))).alias("first"),
    )


def deduplicated(docs: DataFrame, n_gram: int = N_GRAM, hundredths: int = HUNDREDTHS) -> DataFrame:
    """All columns of one row of each component (of equal rows one), and of every row with an empty set."""
    others = components(docs, n_gram, hundredths).filter("NOT first").select(F.col("_k").alias("__other")).distinct()
    keyed = docs.withColumn("__row_key", row_name())
    left = keyed.join(others, F.col("__row_key") == F.col("__other"), "left_anti")
    return left.dropDuplicates(["__row_key"]).drop("__row_key")
