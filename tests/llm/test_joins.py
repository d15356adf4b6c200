"""Operators that compare rows with each other: joins, repeats, shards, search, rules, and the pipeline."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulespan.llm import jaccard, knn, language, repeats, sharding, substrings, suffixes, urls
from rulespan.llm.components import connected

VOCABULARY = [f"w{i}" for i in range(60)]


def corpus(n=120, seed=0, longest=60):
    """Random texts, near copies, exact copies, a shared passage, and the edge cases."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0 or not out:
            t = [r.choice(VOCABULARY) for _ in range(r.randint(0, longest))]
        else:
            t = list(r.choice(out)[1].split())
            for _ in range(r.choice([0, 1, 1, 2, 8])):
                if t:
                    t[r.randrange(len(t))] = r.choice(VOCABULARY)
        if i % 7 == 0:
            t += [f"p{j}" for j in range(20)]
        out.append((1000 - i, r.choice([" ", "\n", "  "]).join(t)))
    return out + [(2000, None), (2001, ""), (2002, " \t"), (2003, "One"), (2004, "oNE"), (2005, "w1 w2 " * 3000)]


# -- n-gram Jaccard join -------------------------------------------------------------------------------------------


def by_hand(rows, n_gram, hundredths):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + n_gram]) for a in range(len(w) - n_gram + 1)} if len(w) >= n_gram else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n_gram, hundredths, seed", [(3, 90, 1), (2, 60, 2)])
def test_components_by_brute_force(frame, n_gram, hundredths, seed):
    rows = corpus(seed=seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame(rows), n_gram, hundredths).collect()}
    assert got == by_hand(rows, n_gram, hundredths)


def test_sets_that_share_a_name_are_told_apart(frame):
    """Names of four bits: nearly all sets clash, are renamed, and give the same components."""
    rows = corpus(seed=5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame(rows), name_bits=4).collect()}
    assert got == by_hand(rows, 3, 90)


def test_every_linked_pair_shares_a_signature():
    r = random.Random(3)
    for hundredths in (90, 80, 60):
        bands = jaccard.Bands(3000, hundredths)
        for b in range(len(bands.low) - 1):
            bands.allocate(b, r.choice([10, 10_000, 10**7]), (bands.low[b] + bands.low[b + 1]) / 2)
        for _ in range(400):
            n = r.choice([r.randint(1, 12), r.randint(1, 60), r.randint(1, 1500)])
            both = np.array(r.sample(range(1 << 40), n), np.uint64)
            few = n * 100 // hundredths - n
            a = r.randint(0, few)
            x = np.unique(np.concatenate([both, np.array(r.sample(range(1 << 41, 1 << 42), a), np.uint64)]))
            y = np.unique(np.concatenate([both, np.array(r.sample(range(1 << 43, 1 << 44), few - a), np.uint64)]))
            if jaccard.similar(x, y, hundredths) and len(x) != len(y) or (few and len(np.intersect1d(x, y)) < max(len(x), len(y))):
                assert np.intersect1d(bands.signatures(x), bands.signatures(y)).size, (hundredths, len(x), len(y), n)


@pytest.mark.parametrize("small, block", [(32, 1024), (32, 40), (200, 1024)])
def test_pairs_are_found_without_a_pivot(spark, small, block, monkeypatch):
    """Sets that only link with each other, not with the pivot of their group."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(4)
    sets = [np.unique(np.array(r.sample(range(1 << 30), 100), np.uint64)) for _ in range(150)]
    sets[149] = np.unique(np.append(sets[7][1:], np.uint64(5)))
    rows = [(1, i, len(s), jaccard._bits(s), i) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "g bigint, sid bigint, n bigint, bits array<bigint>, component bigint")
    assert {(x.a, x.b) for x in jaccard._close(df, 90).collect()} == {(149, 7)}


@pytest.mark.parametrize("block, elements", [(1024, 4 << 20), (3, 4 << 20), (1024, 60)])
def test_large_groups_by_brute_force(frame, block, elements, monkeypatch):
    """Nearly all groups are large ones, cut into blocks by members or by elements."""
    for name, value in (("SMALL", 2), ("BLOCK", block), ("ELEMENTS", elements), ("FIRST", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed=7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame(rows), 2, 60).collect()}
    assert got == by_hand(rows, 2, 60)


def test_a_family_of_unlinked_texts_gives_no_pairs(frame, monkeypatch):
    """Texts made from one, each with its own changes: all share segments and few bits differ, yet hardly any two link."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    asked, verified = [], jaccard._verified

    def counting(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counting)
    r = random.Random(12)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(90):
        t = list(base)
        for place in r.sample(range(400), 6):
            t[place] = f"own{i}x{place}"
        rows.append((i, " ".join(t)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.components(frame(rows), 5, 80).collect()}
    assert got == by_hand(rows, 5, 80)
    assert asked[1] < len(rows)  # after the comparison with pivots: links between components, no pairs to be decided


def test_sets_of_many_large_groups_meet_once():
    """Three groups of the same members: their one possible pair comes out of one of them."""
    r = random.Random(4)
    sets = [np.unique(np.array(r.sample(range(1 << 30), 100), np.uint64)) for _ in range(12)]
    sets[9] = np.unique(np.append(sets[7][1:], np.uint64(5)))
    members = [{"g": g, "_i": 0, "_j": 0, "_own": 0, "sid": i, "n": len(s), "bits": jaccard._bits(s), "first": [-5, 3, 8]} for g in (-5, 3, 8) for i, s in enumerate(sets)]
    met = []
    for g in (-5, 3, 8):
        pdf = pd.DataFrame([m for m in members if m["g"] == g])
        met += [(g, x, y.tolist()) for x, y in jaccard._meetings(pdf, 90, pdf["sid"].to_numpy())]
    assert met == [(-5, 7, [9])]


def test_copies_and_repeated_rows(frame):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A b  c d"), (None, "a b c d"), (8, None), (8, None), (None, "")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in jaccard.components(frame(rows)).collect())
    assert got == [(0, 0, 0), (0, 3, 2), (3, 3, 2), (5, 3, 2), (5, 3, 2), (8, 8, 0), (8, 8, 0)]
    kept = jaccard.deduplicated(frame(rows)).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (3, "A b  c d"), (8, "")]
    assert jaccard.components(frame([])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# -- repeated passages ---------------------------------------------------------------------------------------------


def removed_by_hand(rows, tokens, width):
    windows = {}
    rows = [(i if i is not None else 1 << 62, t) for i, t in rows]
    for i, t in rows:
        w = tokens(t)
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            windows[key] = min(i, windows.get(key, i))
    out = []
    for i, t in rows:
        w = tokens(t)
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if windows[tuple(w[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        out.append((i, w, gone))
    return out


ROWS = {
    "corpus": corpus(90, seed=8, longest=70),
    "repeated ids": [(4, "q " + " ".join(VOCABULARY)), (4, " ".join(VOCABULARY)), (4, " ".join(VOCABULARY)), (2, " ".join(VOCABULARY[5:40])), (None, " ".join(VOCABULARY[:30])), (None, "z " * 40), (9, "z " * 50)],
    "few letters": [(i, "".join(random.Random(i).choice("ab ") for _ in range(200))) for i in range(40)],
    "nothing": [],
}


@pytest.mark.parametrize("rows", ROWS.values(), ids=ROWS)
@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_word_repeats_by_brute_force(frame, rows, piece, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", piece)
    want = sorted((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for i, w, gone in removed_by_hand(rows, lambda t: (t or "").split(), 13))
    got = substrings.deduplicate(frame(rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got) == want


@pytest.mark.parametrize("rows", ROWS.values(), ids=ROWS)
def test_byte_repeats_by_brute_force(frame, rows):
    want = []
    for i, w, gone in removed_by_hand(rows, lambda t: (t or "").encode(), 50):
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        want.append((i, len(w), sum(gone), spans, bytes(x for x, g in zip(w, gone) if not g)))
    got = suffixes.deduplicate(frame(rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


def test_units_hold_every_window_once():
    r = np.random.default_rng(0)
    tokens, lengths = r.integers(0, 3, 500).astype(np.uint64), np.array([0, 3, 12, 13, 200, 272])
    u = repeats.units(tokens, lengths, 5, 13)
    seen = sorted((d, a + j) for d, a, n in zip(u.doc, u.first, u.count) for j in range(n))
    assert seen == [(d, s) for d, n in enumerate(lengths) for s in range(max(0, n - 12))]


# -- shards --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("runs", [200_000, 5])
def test_shards_are_even_and_whole(frame, runs, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", runs)
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 200)) for i in range(600)] + [(i, "the same text") for i in range(600, 1200)] + [(None, None), (-5, "é"), (5000, "again"), (5000, "again"), (1 << 62, "")]
    got = sharding.assign(frame(rows), 6).collect()
    assert sorted((x.doc_id or 0, x.size) for x in got) == sorted((i or 0, len((t or "").encode()) + 8) for i, t in rows)
    bytes_ = [sum(x.size for x in got if x.shard == s) for s in range(6)]
    assert max(bytes_) - min(bytes_) <= 2 * 208 + 0.002 * sum(bytes_) / 6
    for s in range(6):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    import zlib

    text = dict(rows)
    assert all(x.text_crc32 == zlib.crc32((text[x.doc_id] or "").encode()) for x in got)
    assert {x.law for x in got} == {"bytes"} and {x.grown_shard for x in got} == {None}
    assert len({x.shard for x in got if x.size == 21}) <= 3  # equal texts lie side by side


def test_shards_of_nothing_and_of_one_row(frame):
    assert sharding.assign(frame([])).collect() == []
    assert [(x.shard, x.slot) for x in sharding.assign(frame([(1, None)])).collect()] in ([(s, 0)] for s in range(24))


# -- search --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["groups", "ties", "large"])
def test_top_k_by_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES_A_PIVOT", 4)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    r = np.random.default_rng(2)
    x = {"groups": r.normal(size=(10, 8))[r.integers(0, 10, 400)] + 0.05 * r.normal(size=(400, 8)), "ties": r.integers(-1, 2, (400, 4)) / 4, "large": r.normal(size=(60, 3)) * 1e6}[kind]
    rows = [(i, [float(c) for c in v], "clash") for i, v in enumerate(x)]
    rows += [(5000, None, ""), (5010, [1.0, None], ""), (5020, [float("nan")] * 4, ""), (5030, [float("inf"), 1.0], ""), (None, [1.0], ""), (5040, [0.5], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    v = {i: np.floor(1024 * np.array(e)).astype(np.int64).astype(object) for i, e, _ in rows if i is not None and e and all(c is not None and np.isfinite(c) for c in e)}
    want = []
    for q in v:
        if q % 10 == 0:
            best = sorted((-int(sum(a * b for a, b in zip(v[q], v[i]))), i) for i in v if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = knn.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_with_few_rows_and_repeated_ones(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert knn.top_k(make([]), F.col("vec_id") == 0, 3).collect() == []
    got = knn.top_k(make([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5])]), F.col("vec_id") == 0, 3).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0, 1 << 20), (0, 2, 1, 1 << 19)]


def test_search_keeps_large_components_apart(spark):
    rows = [(0, [2e6, 0.0]), (1, [3e6, 1.0]), (2, [4e6, -1.0]), (3, [2.5e6, 2.0])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 3).collect()
    assert sorted((x["rank"], x["vec_id"], x["score"]) for x in got) == [(1, 2, 8 * 10**12 << 20), (2, 1, 6 * 10**12 << 20), (3, 3, 5 * 10**12 << 20)]


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [3e6]), (1, [4e6])]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        knn.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 3).collect()


# -- url rules -----------------------------------------------------------------------------------------------------


def test_rules(spark):
    cases = {
        "https://a.example.com/fr/1": ("a.example.com", "/fr/1", "com/", "allow"),
        "http://WWW.Example.COM/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net/es": ("x.net", "/es", None, "allow"),
        "http://x.net/ES/": ("x.net", "/ES/", None, "allow"),
        "http://m.ads-track.example.org/en": ("m.ads-track.example.org", "/en", None, "block"),
        "http://x.org/ads/1": ("x.org", "/ads/1", None, "block"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://x.com?q=/": ("x.com", "", None, "allow"),
        "no scheme/com/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://É.com/": ("É.com", "/", "com/", "allow"),
        "http://com/a\nb": ("com", "/a\nb", "com/", "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(cases)] + [(0, list(cases)[0], "clash")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id], list(cases)[r.page_id]
    assert urls.judge(df.limit(0)).collect() == []


def test_rules_without_literals_are_refused():
    with pytest.raises(ValueError):
        urls.rules(patterns=[("block", ".*", ())])


# -- pipeline ------------------------------------------------------------------------------------------------------


def test_stages_one_by_one(spark, frame, tmp_path):
    letters = "the of and to in that is was for with".split()
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(letters) + r.choice(["", "s", "ed", "er", "y"]) for _ in range(n))
    base = text(200)
    item = text(30)
    rows = [(i, text(80)) for i in range(60)]
    rows += [(100, base), (101, base), (102, base.replace(" ", "\n", 3) + " end"), (103, item + " " + text(50)), (104, None), (105, "12 34"), (106, text(60) + " mail a.b@c.org")]
    docs = frame(rows, lang=lambda i: "en")
    docs.drop("lang_pred").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    every = [i for i, _ in rows]
    kept, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        kept.append(ids(now))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert now.columns == list(corpus_pipeline.COLUMNS)
            before = now
    assert kept[0] == [i for i in every if i not in (104, 105)]
    assert kept[1] == [i for i in kept[0] if i not in (101, 102)]
    assert kept[2] == [i for i in kept[1] if i != 103]
    assert kept[3] == kept[4] == kept[2]
    masked = {x.doc_id: (x.text, x.n_chars) for x in before.collect()}
    assert masked[106][0].endswith("mail <EMAIL>") and masked[106][1] == len(masked[106][0]) and masked[100][0] == base
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert ids(run) == kept[4] and all(x.n_tokens == len(x.ids) > 0 for x in run.collect())


def test_held_out_is_the_checksum_of_the_id(spark):
    import zlib

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", language.held_out().alias("x")).collect()
    assert [r.x for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got]


def test_a_phrase_of_many_documents_is_no_single_key(frame, monkeypatch, tmp_path):
    """A phrase of 10 words in 240 documents, each with its own words around it or those of an earlier document."""
    import uuid
    from collections import Counter

    from rulespan.llm import repeats, substrings, suffixes

    phrase = "ten words that very many documents of this table have"
    around = [" ".join(f"w{i % 200}x{j}" for j in range(12)) for i in range(240)]
    rows = [(i, f"{around[i]} {phrase} {around[i][::-1] if i < 220 else around[i]}") for i in range(240)]
    compared, folder = repeats._compared, str(tmp_path)

    def counting(keys, unpack):
        inner = compared(keys, unpack)

        def run(batches):
            seen = Counter()

            def passed():
                for b in batches:
                    seen.update(b.column("key").to_pylist())
                    yield b

            yield from inner(passed())
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(max(seen.values(), default=0)))

        return run

    monkeypatch.setattr(repeats, "_compared", counting)
    monkeypatch.setattr(repeats, "SAMPLED", 1, raising=False)

    def expected(units, width):
        least, gone = {}, []
        for i, u in enumerate(units):
            for a in range(len(u) - width + 1):
                least.setdefault(tuple(u[a : a + width]), i)
        for i, u in enumerate(units):
            hit = {a + j for a in range(len(u) - width + 1) if least[tuple(u[a : a + width])] < i for j in range(width)}
            gone.append(len(hit))
        return gone

    docs = frame(rows)
    found = {r.doc_id: r.n_removed for r in substrings.deduplicate(docs).collect()}
    assert [found[i] for i in range(240)] == expected([t.split() for _, t in rows], 13)
    found = {r.doc_id: r.n_removed for r in suffixes.deduplicate(docs).collect()}
    assert [found[i] for i in range(240)] == expected([t.encode() for _, t in rows], 50)
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) <= 24


def test_stages_on_nothing_on_repeated_rows_and_on_a_long_text(spark, frame, tmp_path):
    """An empty table passes all stages; a repeated row stays once; a text of 200,000 words is read whole."""
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = random.Random(9)
    long = " ".join(f"w{r.randrange(9_000)}" for _ in range(200_000)) + " mail me@example.org"
    for rows in ([], [(1, "some short text of seven words here"), (1, "some short text of seven words here"), (2, long), (3, None), (4, "")]):
        now = frame(rows, lang=lambda i: "en" if i % 2 else "de", extra=False)
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
        out = now.collect()
        assert len(out) == len({x.doc_id for x in out}) and {x.doc_id for x in out} <= {1, 2}
        assert all(x.n_tokens > 200_000 for x in out if x.doc_id == 2)
    assert 2 in {x.doc_id for x in out}
