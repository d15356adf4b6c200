"""Terms counted where their row is: statistics, vocabulary and weights without one shuffled row per document and term.

A *counter* takes a list array of tokens (Arrow) and returns what its rows hold and the distinct terms. Batches are
cut into slices of at most ``TOKENS`` tokens, or one row, so a task's memory follows the longest row only. Statistics are
summed per slice before they are exchanged. Vocabularies have at most ``max_features`` terms and travel as a broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from rulespan.operators.vocabulary import ID_BITS, _gathered
from rulespan.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a slice at most, unless one row has more.
TOKENS = 200_000


class Counted:
    """What the rows of a slice hold: units (words, pairs, n-grams) and the terms each unit stands for.

    ``row``, ``unit`` and ``n`` are places of units in rows; without ``n`` each counts once. Unit i stands for the next
    ``length[i]`` numbers in ``place``, which point into ``terms``; without ``held`` a unit is its own term. Rows are
    spread out to terms only for those terms that are asked for. In ``raw`` counts numbers stand in ``terms`` once for each
    time they occur.
    """

    def __init__(self, row: np.ndarray, unit: np.ndarray, n: np.ndarray | None, terms: pa.Array, held: tuple[np.ndarray, np.ndarray] | None = None, raw: bool = False):
        self.at, self.unit, self.n, self.terms, self.held, self.raw = row, unit, n, terms, held, raw

    def distinct(self, wanted: np.ndarray | None = None) -> Counted:
        """The same with each term once, of raw counts only the ``wanted`` ones."""
        if not self.raw:
            return self
        code, row = self.terms.to_numpy(), self.at
        place, found = _dense(code if wanted is None else code[wanted])
        return Counted(row if wanted is None else row[wanted], place, None, pa.array(found))

    def totals(self) -> np.ndarray:
        """How often each term occurs in all rows."""
        units = len(self.terms) if self.held is None else len(self.held[0])
        found = np.bincount(self.unit, self.n, units)
        if self.held is not None:
            length, place = self.held
            found = np.bincount(place, np.repeat(found, length), len(self.terms))
        return found.astype(np.int64)

    def entries(self, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, count) by row and number. ``number`` renames the terms; those below zero are left out."""
        if self.raw:
            raise ValueError("raw counts have no numbers of terms")
        number = np.arange(len(self.terms)) if number is None else number
        row, n = self.at, self.n
        if self.held is None:
            term = number[self.unit]
            kept = term >= 0
            row, term, n = row[kept], term[kept], None if n is None else n[kept]
        else:
            length, place = self.held
            place, whose = number[place], np.repeat(np.arange(len(length)), length)
            kept = place >= 0
            place, length = place[kept], np.bincount(whose[kept], minlength=len(length))
            times = length[self.unit]
            term = _gathered(place, np.cumsum(length) - length, length, self.unit)
            row, n = np.repeat(row, times), None if n is None else np.repeat(n, times)
        return _entries(row, term, int(number.max(initial=0)) + 1, n)

    row, term, tf = (property(lambda self, i=i: self.entries()[i]) for i in range(3))


Counter = Callable[[pa.ListArray], Counted]


def per_key(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, tokens) with one row per key. Rows that share a key are joined, with a null between that no n-gram spans."""
    if df.groupBy(key).count().filter("count > 1").isEmpty():
        return df.select(key, tokens.alias("tokens"))
    rows = df.select(key, F.concat(tokens, F.array(F.lit(None))).alias("tokens"))
    return rows.groupBy(key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


def _slices(batches, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _flat(values: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all rows in order, and the row of each."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values.flatten(), np.repeat(np.arange(len(sizes)), sizes)


def _coded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each token among the distinct ones (null: -1), and these."""
    coded = tokens.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each number among the distinct ones, and these."""
    found, place = np.unique(codes, return_inverse=True)
    return place, found


def _entries(row: np.ndarray, term: np.ndarray, size: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) with the sum of ``of``, or their number."""
    key = row * size + term
    if not len(key):
        return key, key, key
    bits = 0 if of is None else int(of.max()).bit_length()
    if int(key.max()) >> (62 - bits):
        # No room for key and count in one number.
        order = np.argsort(key)
        key, of = key[order], of[order]
    else:
        if of is not None:
            key = (key << bits) | of
        key.sort()
        if of is not None:
            key, of = key >> bits, key & ((1 << bits) - 1)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tf = np.diff(np.r_[first, len(key)]) if of is None else np.add.reduceat(of, first)
    return key[first] // size, key[first] % size, tf


def _joined(parts: list[Counted]) -> Counted:
    """Units and terms of different kinds as one."""
    terms = pa.concat_arrays([p.terms.cast(pa.string()) for p in parts])
    held = [(np.ones(len(p.terms), np.int64), np.arange(len(p.terms))) if p.held is None else p.held for p in parts]
    units, shift = (np.cumsum([0, *x]) for x in ((len(length) for length, _ in held), (len(p.terms) for p in parts)))
    row, unit, n = (np.concatenate(x) for x in zip(*((p.at, p.unit + u, p.n) for p, u in zip(parts, units))))
    return Counted(row, unit, n, terms, (np.concatenate([x for x, _ in held]), np.concatenate([x + s for (_, x), s in zip(held, shift)])))


def words(values: pa.ListArray) -> Counted:
    tokens, row = _flat(values)
    code, known = _coded(tokens)
    return Counted(*_entries(row[code >= 0], code[code >= 0], max(len(known), 1)), known)


def given(values: pa.ListArray) -> Counted:
    """Structs (term, tf) that are counted already."""
    entries, row = _flat(values)
    coded = entries.field("term").dictionary_encode()
    code, tf = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (coded.indices, entries.field("tf")))
    return Counted(row, code, tf, coded.dictionary)


def word_pairs(values: pa.ListArray) -> Counted:
    """Two words that follow each other, joined by a blank."""
    tokens, row = _flat(values)
    code, known = _coded(tokens)
    whole = (row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
    place, pairs = _dense((code[:-1] * max(len(known), 1) + code[1:])[whole])
    left, right = (known.take(pa.array(x)) for x in np.divmod(pairs, max(len(known), 1)))
    return Counted(*_entries(row[:-1][whole], place, max(len(pairs), 1)), pc.binary_join_element_wise(left, right, " "))


def _cut(padded: str, end: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(start, place in the terms) of all character n-grams that end before ``end`` of their start, and the terms."""
    points = np.frombuffer(padded.encode("utf-32-le"), "<u4").astype(np.int64)
    text = np.frombuffer(padded.encode(), np.uint8)
    byte = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]
    letter, letters = _dense(points)
    base = size = max(len(letters), 1)
    code, starts, places, first, n = letter, [], [], [], 0
    for k in range(1, high + 1):
        if k > 1:
            if size * base >= 1 << 62:
                code, known = _dense(code)
                size = len(known)
            code, size = code[:-1] * base + letter[k - 1 :], size * base
        at = np.flatnonzero(end[: len(code)] - np.arange(len(code)) >= k)
        if k >= low and len(at):
            place, known = _dense(code[at])
            one = np.zeros(len(known), np.int64)
            one[place] = at
            starts.append(at)
            places.append(place + n)
            first.append((byte[one], byte[one + k] - byte[one]))
            n += len(known)
        if len(code) < 2:
            break
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    start, length = (np.concatenate(x) for x in zip(*first))
    flat, offsets = _gathered(text, start, length, np.arange(n)), np.r_[0, np.cumsum(length)].astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
    return np.concatenate(starts), np.concatenate(places), terms


def char_grams(low: int, high: int) -> Counter:
    """Character n-grams inside each word padded with one blank on each side; each distinct word is cut once."""

    def count(values: pa.ListArray) -> Counted:
        tokens, row = _flat(values)
        code, known = _coded(tokens)
        entries = _entries(row[code >= 0], code[code >= 0], max(len(known), 1))
        padded = [f" {w} " for w in known.to_pylist()]
        size = np.array([len(w) for w in padded], np.int64)
        word = np.repeat(np.arange(len(size)), size)
        start, place, terms = _cut("".join(padded), np.cumsum(size)[word], low, high)
        order = np.argsort(word[start], kind="stable")
        return Counted(*entries, terms, (np.bincount(word[start], minlength=len(size)), place[order]))

    return count


def words_and_chars(low: int, high: int) -> Counter:
    """Character n-grams, and single words and pairs of words with the mark ``w:`` before them."""
    chars = char_grams(low, high)

    def count(values: pa.ListArray) -> Counted:
        plain = [words(values), word_pairs(values)]
        return _joined([chars(values), *(Counted(c.at, c.unit, c.n, pc.binary_join_element_wise("w:", c.terms.cast(pa.string()), "")) for c in plain)])

    return count


def id_ngrams(low: int, high: int) -> Counter:
    """N-grams of token ids, each as one number: see ``vocabulary.ngram_counts``."""
    if high * ID_BITS > 63:
        raise ValueError(f"n-grams of up to {63 // ID_BITS} ids fit a code, not {high}")

    def count(values: pa.ListArray) -> Counted:
        tokens, row = _flat(values)
        ids = tokens.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes, rows = [], []
        for n in range(low, high + 1):
            m = len(ids) - n + 1
            if m <= 0:
                continue
            code, whole = np.zeros(m, np.int64), row[:m] == row[n - 1 :]
            for j in range(n):
                code = (code << ID_BITS) | ids[j : j + m]
                whole &= ids[j : j + m] > 0
            codes.append(code[whole])
            rows.append(row[:m][whole])
        code, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, rows))
        return Counted(row, np.arange(len(code)), None, pa.array(code), raw=True)

    return count


#: (term, df, cf) of slices that are kept before they are summed up.
KEPT = 2_000_000


def _summed_up(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    terms, *counts = zip(*parts)
    coded = pa.concat_arrays(terms).dictionary_encode()
    place, n = coded.indices.to_numpy(), len(coded.dictionary)
    sums = [pa.array(np.bincount(place, np.concatenate(x), n).astype(np.int64)) for x in counts]
    return pa.RecordBatch.from_arrays([coded.dictionary, *sums], ["term", "df", "cf"])


def statistics(df: DataFrame, tokens: str, counter: Counter, kind: str = "string", passing=None) -> DataFrame:
    """(term, df, cf) over all rows: slices are summed up where they are, then by term.

    ``passing`` is a broadcast of one bit per cell; terms of other cells are left out.
    """

    def run(batches):
        bits = None if passing is None else np.unpackbits(passing.value).astype(bool)
        parts, kept = [], 0
        for batch in _slices(batches, tokens):
            c = counter(batch.column(tokens))
            if c.raw:
                c = c.distinct(None if bits is None else bits[_cells(c.terms)])
                wanted = np.arange(len(c.terms))
            else:
                wanted = np.arange(len(c.terms)) if bits is None else np.flatnonzero(bits[_cells(c.terms)])
            number = np.full(len(c.terms), -1)
            number[wanted] = np.arange(len(wanted))
            _, term, _ = c.entries(number)
            parts.append((c.terms.take(pa.array(wanted)), np.bincount(term, minlength=len(wanted)), c.totals()[wanted]))
            kept += len(wanted)
            if kept >= KEPT:
                yield _summed_up(parts)
                parts, kept = [], 0
        if parts:
            yield _summed_up(parts)

    found = df.select(tokens).mapInArrow(run, f"term {kind}, df bigint, cf bigint")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


#: Cells of the filter that sorts out rare terms, in blocks; tasks that fill it at most.
CELLS, BLOCKS, FILLERS = 1 << 23, 64, 24
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(found: pa.Array) -> np.ndarray:
    """64 bits for each term: a polynomial of its bytes, or its number, mixed."""
    if pa.types.is_integer(found.type):
        h = found.to_numpy(zero_copy_only=False).astype(np.uint64) * _FACTOR
    else:
        raw = found.cast(pa.binary())
        _, offsets, data = raw.buffers()
        ends = np.frombuffer(offsets, "<i4")[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        length = np.diff(ends)
        power = np.cumprod(np.full(int(length.max(initial=0)) + 1, _FACTOR))
        place = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], length)
        sums = np.r_[np.uint64(0), np.cumsum((flat + np.uint64(1)) * power[place], dtype=np.uint64)]
        h = np.diff(sums[ends - ends[0]])
        h ^= h >> np.uint64(32)
        h *= _FACTOR
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _cells(found: pa.Array) -> np.ndarray:
    """The cell of each term."""
    return _cell(_hashes(found))


def _cell_sums(df: DataFrame, tokens: str, counter: Counter) -> DataFrame:
    """(block, sums): in each cell, how often its terms occur together. No term occurs more often than its cell."""
    width = CELLS // BLOCKS

    def filled(batches):
        sums = np.zeros(CELLS, np.int64)
        for batch in _slices(batches, tokens):
            c = counter(batch.column(tokens))
            np.add.at(sums, _cells(c.terms), c.totals())
        if sums.any():
            # Values of bytes of one weight lie together: most are zero and compress.
            blocks = [sums[i * width : (i + 1) * width].view(np.uint8).reshape(-1, 8).T.tobytes() for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], ["block", "sums"])

    def added(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("block").to_pylist(), b.column("sums")):
                sums = np.ascontiguousarray(np.frombuffer(raw.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
                out[i] = out[i] + sums if i in out else sums
        for i, sums in out.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "sums": pa.array([sums], pa.list_(pa.int64()))})

    found = df.select(tokens).coalesce(FILLERS).mapInArrow(filled, "block int, sums binary")
    return found.repartition(BLOCKS, "block").mapInArrow(added, "block int, sums array<bigint>")


def frequent(
    df: DataFrame, tokens: str, counter: Counter, rows: int, min_df: int, max_df: float, max_features: int, kind: str = "string"
) -> DataFrame:
    """(term, df, cf) of at least those terms that are among the ``max_features`` most frequent, of fitting df.

    Terms too rare to be among them are not exchanged: those whose cell holds less than ``least`` occurrences. That bound
    is guessed from the cells; where fewer than ``max_features`` terms reach it, it was too high and a lower one is taken.
    """
    cells = checkpointed(_cell_sums(df, tokens, counter))
    held = cells.select(F.explode("sums").alias("n")).filter("n > 0").groupBy("n").agg(F.count("*").alias("k")).orderBy(F.col("n").desc()).toArrow()
    n, k = (held.column(c).to_numpy() for c in ("n", "k"))
    if not len(n):
        return statistics(df, tokens, counter, kind).limit(0)
    place = int(np.searchsorted(np.cumsum(k), max_features))
    usual = int(n[np.searchsorted(np.cumsum(k), k.sum() // 2)])
    least = max(min_df, int(0.7 * (int(n[min(place, len(n) - 1)]) - usual)))
    while True:
        passing = np.zeros(CELLS, bool)
        chosen = cells.select("block", F.transform("sums", lambda x: x >= F.lit(least)).alias("passes")).toArrow()
        for block, passes in zip(chosen.column("block").to_pylist(), chosen.column("passes")):
            passing[block * (CELLS // BLOCKS) :][: CELLS // BLOCKS] = passes.values.to_numpy(zero_copy_only=False)
        shared = df.sparkSession.sparkContext.broadcast(np.packbits(passing))
        fits = (F.col("df") >= min_df) & (F.col("df") <= max_df * rows) & (F.col("cf") >= least)
        found = checkpointed(statistics(df, tokens, counter, kind, shared).filter(fits))
        if least <= min_df or found.count() >= max_features:
            return found
        least = max(min_df, least // 2)


class Known:
    """A vocabulary as tasks look it up: terms in order, and the feature and weight of each."""

    def __init__(self, terms: pa.Array, feature: np.ndarray, idf: np.ndarray):
        self.terms, self.feature, self.idf = terms, feature, idf
        if not pa.types.is_integer(terms.type):
            self.hashes = _hashes(terms)
            self.order = np.argsort(self.hashes)
            self.hashes = self.hashes[self.order]
            self.cells = np.zeros(CELLS, bool)
            self.cells[_cell(self.hashes)] = True
            self.clash = bool((self.hashes[1:] == self.hashes[:-1]).any())

    def places(self, wanted: pa.Array) -> np.ndarray:
        """Where each term stands, -1 where it is not known."""
        out = np.full(len(wanted), -1)
        if not len(self.terms) or not len(wanted):
            return out
        wanted = wanted.cast(self.terms.type)
        if pa.types.is_integer(wanted.type):
            known, asked = self.terms.to_numpy(), wanted.to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            return np.where(known[at] == asked, at, -1)
        if self.clash:
            return pc.index_in(wanted, self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        h = _hashes(wanted)
        near = np.flatnonzero(self.cells[_cell(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        near, at = (x[self.hashes[at] == h[near]] for x in (near, self.order[at]))
        same = pc.equal(self.terms.take(pa.array(at)), wanted.take(pa.array(near))).to_numpy(zero_copy_only=False)
        out[near[same]] = at[same]
        return out

    def by_feature(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The feature of each place (-1 of the place -1), and the place and weight of each feature."""
        n = int(self.feature.max(initial=-1)) + 1
        place, idf = np.zeros(n, np.int64), np.zeros(n)
        place[self.feature], idf[self.feature] = np.arange(len(self.feature)), self.idf
        return np.r_[self.feature, -1].astype(np.int64), place, idf


def known(vocabulary: DataFrame, weight: Column):
    """A vocabulary (term, feature) of bounded size, sent to the tasks once."""
    table = vocabulary.select("term", "feature", weight.alias("idf")).orderBy("term").toArrow().combine_chunks()
    term = table.column("term").combine_chunks()
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    # A plain tuple: tasks may not have this module where they could look up a class of it.
    ready = (term, table.column("feature").to_numpy(), table.column("idf").to_numpy())
    return vocabulary.sparkSession.sparkContext.broadcast(ready)


def _weight(row: np.ndarray, idf: np.ndarray, tf: np.ndarray, size: int) -> np.ndarray:
    """Sublinear, smoothed weights, of length one in each row."""
    w = (1 + np.log(tf)) * idf
    return w / np.sqrt(np.bincount(row, w * w, size))[row]


def weights(df: DataFrame, key: str, tokens: str, counter: Counter, shared, kind: str = "string") -> DataFrame:
    """(key, term, tf, weight) of every row's terms in the vocabulary, computed inside the row."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, term {kind}, tf bigint, weight double"

    def run(batches):
        vocabulary = Known(*shared.value)
        numbered, place, idf = vocabulary.by_feature()
        for batch in _slices(batches, tokens):
            c = counter(batch.column(tokens)).distinct()
            row, feature, tf = c.entries(numbered[vocabulary.places(c.terms)])
            w = _weight(row, idf[feature], tf, batch.num_rows)
            columns = [batch.column(key).take(pa.array(row)), vocabulary.terms.take(pa.array(place[feature])), pa.array(tf.astype(np.int64)), pa.array(w)]
            yield pa.RecordBatch.from_arrays(columns, [key, "term", "tf", "weight"])

    return df.select(key, tokens).mapInArrow(run, schema)


_ENTRY = pa.struct([("term", pa.int32()), ("tf", pa.int32())])


def numbered(df: DataFrame, tokens: str, counter: Counter, shared) -> DataFrame:
    """Every row with its known terms, as structs (term: the feature, tf), in place of its tokens: see ``given``."""
    kept = [x for x in df.schema.fields if x.name != tokens]

    def run(batches):
        vocabulary = Known(*shared.value)
        numbered, _, _ = vocabulary.by_feature()
        for batch in _slices(batches, tokens):
            c = counter(batch.column(tokens)).distinct()
            row, feature, tf = c.entries(numbered[vocabulary.places(c.terms)])
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32))
            entries = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (feature, tf)], fields=list(_ENTRY))
            found = [*(batch.column(x.name) for x in kept), pa.ListArray.from_arrays(ends, entries)]
            yield pa.RecordBatch.from_arrays(found, [*(x.name for x in kept), tokens])

    entries = ArrayType(StructType([StructField("term", IntegerType()), StructField("tf", IntegerType())]))
    return df.select(*[x.name for x in kept], tokens).mapInArrow(run, StructType([*kept, StructField(tokens, entries)]))


_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def vectors(df: DataFrame, tokens: str, counter: Counter, shared, size: int) -> DataFrame:
    """The other columns of every row with its sparse unit vector ``features``; a row without known terms gets an empty one.

    Vectors are made anew for whoever reads them: token ids are a small part of their size.
    """
    kept = [x for x in df.schema.fields if x.name != tokens]

    def run(batches):
        vocabulary = Known(*shared.value)
        numbered, _, idf = vocabulary.by_feature()
        for batch in _slices(batches, tokens):
            c = counter(batch.column(tokens)).distinct()
            row, feature, tf = c.entries(numbered[vocabulary.places(c.terms)])
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32))
            indices = pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32)))
            values = pa.ListArray.from_arrays(ends, pa.array(_weight(row, idf[feature], tf, batch.num_rows)))
            n = batch.num_rows
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), indices, values]
            features = pa.StructArray.from_arrays(parts, fields=list(_VECTOR))
            yield pa.RecordBatch.from_arrays([*(batch.column(x.name) for x in kept), features], [*(x.name for x in kept), "features"])

    return df.select(*[x.name for x in kept], tokens).mapInArrow(run, StructType([*kept, StructField("features", VectorUDT())]))
