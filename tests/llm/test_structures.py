"""Whitening, fingerprints and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rulespan.llm import conversations, simhash, whitening
from rulespan.llm.common import with_label

# -- whitening -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims, wanted, decay", [(64, 32, 0.0), (12, 32, 0.1), (150, 8, 0.02), (40, 5, 3.0)])
def test_leading_pairs_are_those_of_the_dense_solver(dims, wanted, decay):
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(dims, dims)))
    e = np.exp(-decay * np.arange(dims)) * (1 + 0.01 * r.random(dims))
    a = (q * e) @ q.T
    found = whitening.leading(lambda b: a @ b, dims, wanted, np.trace(a))
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    assert np.allclose(found.values, values[::-1][:wanted], rtol=0, atol=1e-13)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(min(wanted, dims)), atol=1e-12)
    assert (np.abs(a @ found.vectors - found.vectors * found.values) < 1e-13).all()


def test_a_matrix_with_equal_eigenvalues():
    found = whitening.leading(lambda b: 3.0 * b, 30, 4, 90.0)
    assert np.allclose(found.values, 3.0) and found.residuals.max() < 1e-12


def dense(x, components):
    n, total = len(x), x.sum(0)
    far = n * x - total
    c = far.astype(float) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    keep = e > 1e-12 * np.trace(v)
    return (far.astype(object) ** 2).sum(1), c @ (q[:, keep] / np.sqrt(e[keep])), e[keep] / np.trace(v)


@pytest.mark.parametrize("kind", ["plain", "offset", "flat", "short"])
def test_whitening_equals_the_dense_version(spark, kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 10)) * np.linspace(1, 3, 10)
    if kind == "offset":
        x = x + 1e6
    if kind == "flat":
        x[:, 3] = 2.0
    rows = [(i, [float(c) for c in v], "c") for i, v in enumerate(x)]
    rows += [(400, None, ""), (401, [1.0, None], ""), (402, [float("nan")] * 10, ""), (403, [float("inf")] + [0.0] * 9, "")]
    rows += [(7, rows[7][1], "again"), (None, rows[8][1], "")] + ([(404, [5.0], ""), (405, [], "")] if kind == "short" else [])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component string").repartition(5)
    kept = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    whole = np.array([np.floor(64 * np.array(v + [0.0] * (10 - len(v)))).astype(np.int64) + 1_000_000 for _, v in kept])
    deviation, white, explained = dense(whole, 32)
    got = whitening.whiten(df).toPandas()
    assert len(got) == len(kept) * len(explained) and set(got["n"]) == {len(kept)}
    assert got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    ids = np.array([-1 if i is None else i for i, _ in kept])
    want = sorted((int(i), int(d)) for i, d in zip(ids, deviation))
    first = got[got["component"] == 1].fillna({"vec_id": -1})
    assert sorted(zip(first["vec_id"].astype(int), first["deviation"])) == want
    for j in range(len(explained)):
        one = got[got["component"] == j + 1].fillna({"vec_id": -1})
        assert np.allclose(one["explained"], explained[j], rtol=1e-9)
        mine, theirs = sorted(zip(one["vec_id"], one["deviation"], one["whitened"])), sorted(zip(ids, deviation, white[:, j]))
        a, b = np.array([m[2] for m in mine]), np.array([float(t[2]) for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_whitening_of_nothing_and_of_one_vector(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 4)).collect() == []
    assert whitening.whiten(make([(1, None), (2, [])])).collect() == []
    with pytest.raises(Exception, match="too large to scale"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id bigint, embedding array<double>"))


# -- fingerprints --------------------------------------------------------------------------------------------------


def fingerprint_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_by_hand(rows):
    """(id or None, fingerprint) rows to components by comparing all pairs."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
            label[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, 1 << 63), (1 << 63) if doc is None else doc)
    return [doc if least[root(i)] == 1 << 63 else least[root(i)] for i, (doc, _) in enumerate(rows)]


def test_fingerprints_and_components_by_brute_force(frame):
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "CASE", "x y"]
    base = [[vocabulary[i] for i in r.integers(0, len(vocabulary), r.integers(1, 200))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:40]:
        for _ in range(3):
            c = list(b)
            c[int(r.integers(0, len(c)))] = "changed"
            texts.append(" \t".join(c))
    texts += [None, "", " \n", "one", "ONE two", texts[0], texts[0], "long " * 40_000, "tie a b", "tie a b c"]
    rows = [(i + 3, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, "alone " * 9), (3, texts[0])]
    got = simhash.components(frame(rows)).collect()
    fps = [fingerprint_by_hand(t) for _, t in rows]
    want = linked_by_hand([(i, f) for (i, _), f in zip(rows, fps)])
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or -1)
    assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in got), key=key) == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want)), key=key)


@pytest.mark.parametrize("cell", [2, 64])
def test_links_of_dense_fingerprints(spark, monkeypatch, cell):
    """All links are found where thousands of fingerprints crowd around one, inside blocks too, and cells are cut to the last."""
    monkeypatch.setattr(simhash, "CELL", cell)
    r = np.random.default_rng(9)
    crowd = {0, (1 << 64) - 1, 1 << 63, 1, 2, 3, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA, 0x5555555555555556, 0x5555555555555559}
    for _ in range(600):
        x = 0x5555555555555555
        for b in r.integers(0, 12, 3):
            x ^= 1 << int(b)
        crowd.add(x)
    crowd |= {int(x) for x in r.integers(0, 1 << 63, 200)}
    crowd = sorted(crowd)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in crowd]
    df = spark.createDataFrame(signed, "fp bigint")
    got = {(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.links(simhash.distance_table(df)).collect()}
    want = {frozenset(p) for p in itertools.combinations(crowd, 2) if (p[0] ^ p[1]).bit_count() <= 2}
    assert {frozenset(p) for p in got} == want and len(got) == len(want)


def test_distances_bound_the_coordinates(spark):
    df = spark.createDataFrame([(0,), (-1,), (0x0123456789ABCDEF,)], "fp bigint")
    for x in simhash.distance_table(df).collect():
        fp = x.fp % (1 << 64)
        assert list(x.d) == [(fp ^ int(p)).bit_count() for p in simhash.REFERENCES]
        assert x.c % (1 << 64) == sum((fp >> i & 3).bit_count() << i for i in range(0, 64, 2))


def test_fingerprints_of_an_empty_table(frame):
    assert simhash.components(frame([])).collect() == []


# -- conversations -------------------------------------------------------------------------------------------------


def damaged_by_hand(rows):
    said = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, outputs) by a search over whole edit sequences, the cheapest and then least first."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, made
        if (i, state, audit) in seen:
            continue
        seen.add((i, state, audit))
        opens = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        to = {"s": 1, "u": 2, "a": 3}
        for letter in opens:
            if letter != "s" and audit[-2:] != "II":
                heapq.heappush(heap, (cost + 3, audit + "I", i, to[letter], made + (({"u": "user", "a": "assistant"}[letter], ""),)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for letter in opens:
                    if role[:1] == letter:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to[letter], made + ((role, text),)))
                    elif letter != "s":
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, to[letter], made + (({"u": "user", "a": "assistant"}[letter], text),)))
    raise AssertionError


def repaired_by_hand(rows):
    want = []
    left = damaged_by_hand(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, role, text) for c, t, role, text in left if c == conv))
        faults, seen = [], set()
        for _, _, role, text in mine:
            said = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for known, t, _, _ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, made = cheapest([r[2:] for r in mine], faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        want.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return want


def conversation_rows(n, seed, longest=6):
    r = np.random.default_rng(seed)
    rows = []
    for conv in range(n):
        for turn in range(int(r.integers(1, longest + 1))):
            role = str(r.choice(["user", "assistant", "system", "tool", "", "USER"], p=[0.4, 0.36, 0.12, 0.06, 0.03, 0.03]))
            text = str(r.choice(["Yes.", "No", "Why? ", "", "\t\n", "So!\n", "and so on", "Ende。", "Same."]))
            rows.append((conv, turn if r.random() < 0.95 else None, role, text))
    rows += [(None, 1, "user", "Hm."), (None, None, None, None), (None, 3, "assistant", "Ok."), (1, 1, "user", "Yes."), (1, 1, "user", "Yes.")]
    rows += [(-5, -(2**40), "system", "Go."), (-5, 2**40, "user", "x" * 100_000)]
    return rows


def of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, fault string").repartition(4)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return sorted((tuple(x[c] for c in COLUMNS) for x in conversations.repair(df).collect()), key=lambda x: (x[0] is None, x[0] or 0))


@pytest.mark.parametrize("piece", [2, 64])
def test_repair_by_search(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = conversation_rows(250, 4)
    assert found(of(spark, rows)) == sorted(repaired_by_hand(rows), key=lambda x: (x[0] is None, x[0] or 0))


def test_pieces_change_nothing_in_a_long_conversation(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(9, t, str(r.choice(["user", "assistant", "system", "tool"])), str(r.choice(["A.", "B", "", f"{t}."]))) for t in range(700)]
    whole = found(of(spark, rows).withColumn("conv_id", F.lit(9)))
    monkeypatch.setattr(conversations, "PIECE", 10_000)
    conversations.solve.cache_clear()
    assert found(of(spark, rows)) == whole


def test_conversations_without_rows(spark):
    assert found(of(spark, [])) == []
    gone = next((c, t) for c in range(50) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert found(of(spark, [(*gone, "user", "Hi.")])) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_labels_of_a_hot_key_come_without_a_hot_task(spark):
    rows = spark.range(8_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).alias("k"))
    labels = rows.select("k").distinct().select("k", (F.col("k") * 2).alias("v"))
    counts = rows.groupBy("k").agg(F.count("*").alias("rows"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_label(rows, labels, "k", counts, "id")
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert out.filter("v = 2 * k").count() == 8_000
