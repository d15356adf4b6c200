"""Operators that judge each text by itself: language, personal data, contamination, tokens."""

import hashlib
import random
import re

import pytest

from rulespan.llm import bpe, contamination, language, pii

WORDS = {"en": "the of and to in that is was for with on as by".split(), "de": "der die und in den von zu das mit sich des auf für".split(), "ru": "и в не на я быть он с что а по это она".split()}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "ing" if lang == "en" else "ung" if lang == "de" else "ая"]) for _ in range(n))


# -- language ------------------------------------------------------------------------------------------------------


def test_language_is_learned_and_foreign_text_rejected(frame):
    docs = [(i, prose(("en", "de")[i % 2], 5 + i % 60, i)) for i in range(160)]
    odd = [(900, None), (901, ""), (902, "1234 !!"), (903, prose("ru", 40, 1)), (904, "the " * 400_000), (0, docs[0][1]), (None, prose("de", 30, 7))]
    got = language.identify(frame(docs + odd, lang=lambda i: ("en", "de")[i % 2] if i is not None and i < 900 else None)).collect()
    assert len(got) == len(docs) + len(odd)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(by_id[i][0].lang_pred == ("en", "de")[i % 2] and not by_id[i][0].rejected for i, _ in docs)
    assert [r.lang_pred for i in (900, 901, 902) for r in by_id[i]] == ["und"] * 3
    assert all(r.score == 0 and r.rejected for i in (900, 901, 902) for r in by_id[i])
    assert by_id[903][0].rejected and by_id[903][0].lang_pred in ("en", "de")
    assert by_id[904][0].lang_pred == "en"
    assert len(by_id[0]) == 2 and by_id[0][0] == by_id[0][1]
    assert by_id[None][0].lang_pred == "de" and by_id[None][0].held_out is False
    assert all(0 <= r.score <= 1 for r in got)


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = prose("de", 300, 3) + " " + prose("ru", 50, 1)
    whole = language.counts(text)
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(language, "_PIECE", piece)
        part = language.counts(text)
        assert (part[0] == whole[0]).all() and part[1] == whole[1]


def test_language_without_training_rows(frame):
    assert [r.lang_pred for r in language.identify(frame([(1, "some text")])).collect()] == ["und"]
    assert language.identify(frame([])).collect() == []


# -- personal data -------------------------------------------------------------------------------------------------


def base_by_regex(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice(r.choice(["0123456789", "0123456789.", "ab.@-", "+ ()-12", "é a@b.co", "1.2", "4111 1111"])) for _ in range(r.randint(0, 50)))
        if r.random() < 0.2:
            t = "x 4111 1111-1111 1111 " + t
        assert [(k, a, b) for k, spans in pii.base_spans(t).items() for a, b, ok in spans if ok] == base_by_regex(t), t


def test_pii_query_rows(frame):
    texts = {1: "mail a.b@c.org or +1 (555) 555-1234 now", 2: None, 3: "", 4: "ip 10.0.0.1, no 999.1.1.1", 5: "x" * 300_000 + " a@b.cd", 6: "é card 4111 1111 1111 1111", 7: "call (555) 123-4567 or tel 555 123 4567"}
    more = [(100 + i, f"tel (30{i % 10}) 555-{1000 + i} and mail u{i}@mail.example.com, call +49 30 1234{i:03d}") for i in range(60)]
    got = {r.doc_id: r for r in pii.detect(frame([*texts.items(), *more, (1, texts[1])])).collect()}
    for i, t in texts.items():
        base = base_by_regex(t or "")
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for x, _, _ in base) for k in pii.KINDS)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i].spans.split(","))
    assert "phone:5:19" in got[7].spans  # the classifier adds a number without a plus sign
    assert got[2].spans == got[3].spans == "" and pii.detect(frame([])).collect() == []


def test_redaction_masks_spans_and_leaves_the_rest(frame):
    got = {r.doc_id: r.text for r in pii.redact(frame([(1, "to a@b.org, é +1 (555) 555-1234."), (2, None), (3, "clean 12 text")], extra=False)).collect()}
    assert got == {1: "to <EMAIL>, é <PHONE>.", 2: None, 3: "clean 12 text"}


def test_labeler_reliability_is_recovered():
    import numpy as np

    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.5
    right = np.array([0.95, 0.9, 0.6, 0.8, 0.7])
    votes = np.where(r.random((4000, 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    p, rate = pii.expectation_maximisation(votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.95
    assert np.abs(rate[1, :, 2] - right).max() < 0.06


# -- contamination -------------------------------------------------------------------------------------------------


def contaminated_by_hand(docs, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for j, item in items:
            v = words(item)
            for a in range(max(1, len(v) - width + 1) if v else 0):
                window = v[a : a + width]
                for s in range(len(w) - len(window) + 1):
                    if w[s : s + len(window)] == window:
                        hit |= {*range(s, s + len(window))}
                        found.add("" if j is None else str(j))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [50_000, 7])
def test_contamination_by_brute_force(spark, frame, block):
    r = random.Random(2)
    vocabulary = ["the", "Of", "und", "Ünd", "a1", "x", "É", "漢", "to", "in"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(r.randint(1, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (93, "solo unseen"), (None, text(20)), (5, "THE of und")]
    docs = [(i, text(r.randint(0, 40)) + " " + (items[i % 20][1] or "") if i % 3 else text(20)) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "?!"), (93, "und " * 50_000), (94, items[3][1].upper())]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("key", F_lit())
    got = {x.doc_id: x for x in contamination.detect(frame(docs), benchmark, width=5, block_windows=block).collect()}
    for i, want in contaminated_by_hand(docs, items, 5).items():
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want, i


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_contamination_of_repeated_rows_and_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "a b c")]
    assert {(r.n_words, r.n_hit) for r in contamination.detect(frame(docs), none).collect()} == {(3, 0)}
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b c", "d e f", "x y z"])], "item_id bigint, text string")
    for block in (100, 1):
        got = sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in contamination.detect(frame(docs), items, block_windows=block).collect())
        assert got == [(0, 3, 2), (1, 3, 1), (1, 3, 2), (1, 3, 2)]
    assert contamination.detect(frame([]), items).collect() == []


# -- byte-pair codec -----------------------------------------------------------------------------------------------

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def texts(n):
    r = random.Random(4)
    for _ in range(n):
        s = "".join(r.choice("abcdefghijkl'stre m1234 \n\t.,!?éüß漢字ΣÅİǅ́ <|startoftext|>") for _ in range(r.randint(0, 60)))
        yield s + r.choice(["", "", "<|endoftext|>" + s, s.replace(" ", "") * 12, "IT'S we'll"])


def test_codec_equals_the_library(spark, frame):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = list(enumerate([*texts(400), None, "", " ", "a" * 5000, "ab" * 3000 + " x"]))
    got = {r.doc_id: r for r in bpe.digests(frame(rows), PATH).collect()}
    encoded = {r.doc_id: r.ids for r in bpe.encode(frame(rows), PATH).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert encoded[i] == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(frame(rows), PATH), PATH).collect()}
    assert back == {i: library.decode(encoded[i], skip_special_tokens=False) for i, _ in rows}
    assert bpe.digests(frame([]), PATH).collect() == []


def test_scan_and_heap_agree():
    with open(PATH, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    for t in texts(300):
        raw = t.encode()[:80]
        parts = [codec._one[b] for b in raw]
        assert codec._by_scan(list(parts)) == codec._by_heap(list(parts))


def test_the_token_stage_decodes(spark, frame):
    import hashlib

    import corpus_pipeline
    import public_tokenizers
    from rulespan.llm import bpe

    docs = frame([(1, "Some words, 新しい ones too."), (2, ""), (3, None)], extra=False)
    path = public_tokenizers.path("word_bpe_49k.json")
    codec = bpe.Codec(open(path, encoding="utf-8").read())
    rows = corpus_pipeline.tokens(spark, docs, "").collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(codec.decode(r.ids).encode()).hexdigest()
