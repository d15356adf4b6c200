"""Exact byte-pair vocabulary: guessed merges, checked by one pass over all pre-tokens.

Training takes the most frequent pair of adjacent symbols, merges it everywhere, and goes on; ties go to the smaller
ids. Each merge depends on all before it, so the merges are not computed one pass each but guessed many at a time:

- An *epoch* starts with exact counts of all pairs. Pairs below a floor (a 16th of the best, or what keeps the table on
  the driver bounded) cannot be merged before the best pair has come down to the floor, so until then words fall apart
  at them, and the rest is kept as distinct segments with their frequency.
- A *round* guesses the next merges in order and makes one pass over the segments. Every segment replays the guess and
  reports, for each step, by how much each pair's count changes. Summed up, that gives the exact count of every pair
  at every step, and the driver accepts the steps up to the first that was not the best pair at its turn. What the
  remaining steps changed is what the next guess is made from.

Words are rewritten once an epoch, never in a round. The driver holds counts of ``HOT`` pairs and the changes of
``GUESSED`` steps. Results do not depend on these numbers.
"""

from __future__ import annotations

import heapq
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespan.session import removed, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Special tokens in id order, and the number of byte symbols that follow them.
SPECIAL_TOKENS = ("<unk>", "<pad>", "<s>", "</s>", "<mask>")
BYTES = 256

#: Pairs whose counts the driver holds at most, and merges guessed in one round.
HOT, GUESSED = 100_000, 512
#: Tasks that add up a round's changes at most: each gets a share of the pairs, whatever the number of shuffle partitions.
ADDERS = 24
#: An epoch lasts while the best pair is at least this share of its first one.
FLOOR = 16
#: Rows encoded at a time.
ENCODED = 256
_NONE = np.int32(2**31 - 1)

Pair = tuple[int, int]


def byte_ids() -> np.ndarray:
    """Id of each byte: printable ones first, as their stand-in characters sort."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    order = sorted(plain) + [b for b in range(BYTES) if b not in plain]
    ids = np.zeros(BYTES, np.int32)
    ids[order] = len(SPECIAL_TOKENS) + np.arange(BYTES)
    return ids


def _key(left, right):
    return (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)


class Steps:
    """Merges in order, ready to be looked up: the i-th makes symbol ``first + i`` of its pair."""

    def __init__(self, pairs: list[Pair], first: int):
        self.first, size = first, first + len(pairs)
        keys = _key([p[0] for p in pairs], [p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.left, self.right = np.zeros(size, bool), np.zeros(size, bool)
        self.left[[p[0] for p in pairs]] = True
        self.right[[p[1] for p in pairs]] = True

    def ranks(self, symbols: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """For each symbol the step that merges it with the next one, where there is one."""
        out = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1 and len(self.keys):
            at = np.flatnonzero(self.left[symbols[:-1]] & self.right[symbols[1:]] & inside)
            keys = _key(symbols[at], symbols[at + 1])
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = self.keys[found] == keys
            out[at[same]] = self.rank[found[same]]
        return out


class Words(NamedTuple):
    """Symbol sequences one after the other, their lengths and frequencies."""

    symbols: np.ndarray
    length: np.ndarray
    n: np.ndarray

    def chosen(self, mask: np.ndarray) -> Words:
        return Words(self.symbols[np.repeat(mask, self.length)], self.length[mask], self.n[mask])

    def inside(self) -> np.ndarray:
        """Whether each symbol but the last of all has its follower in the same word."""
        out = np.ones(len(self.symbols), bool)
        out[np.cumsum(self.length) - 1] = False
        return out[:-1]


def replayed(words: Words, steps: Steps, log: list | None = None) -> Words:
    """Words after the steps, in no order. ``log`` gets (step, pair key, change of its count) of every change.

    Each word takes the smallest step it holds a pair of, at all its places from left to right, until it holds none:
    the same as taking the steps one by one, as a step only makes pairs of later ones.
    """
    done = []
    while len(words.length):
        inside, whose = words.inside(), np.repeat(np.arange(len(words.length)), words.length)
        rank = steps.ranks(words.symbols, inside)
        least = np.minimum.reduceat(rank, np.cumsum(words.length) - words.length)
        open_ = least != _NONE
        if not open_.all():
            done.append(words.chosen(~open_))
            words, kept = words.chosen(open_), np.repeat(open_, words.length)
            if not len(words.length):
                break
            rank, least = rank[kept], least[open_]
            inside, whose = words.inside(), np.repeat(np.arange(len(words.length)), words.length)
        at = np.flatnonzero(rank == least[whose])
        # Places next to each other are a run of one symbol: every second one is taken.
        runs = np.r_[True, at[1:] != at[:-1] + 1]
        i = np.arange(len(at))
        at = at[(i - np.maximum.accumulate(np.where(runs, i, 0))) % 2 == 0]
        symbols, touched = words.symbols, np.zeros(len(words.symbols), bool)
        touched[at] = touched[at + 1] = True

        def changes(symbols, touched, inside, whose, sign):
            where = np.flatnonzero((touched[:-1] | touched[1:]) & inside)
            log.append((least[whose[where]], _key(symbols[where], symbols[where + 1]), sign * words.n[whose[where]]))

        if log is not None:
            changes(symbols, touched, inside, whose, -1)
        symbols = symbols.copy()
        symbols[at] = steps.first + least[whose[at]]
        kept, made = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
        kept[at + 1], made[at] = False, True
        words = Words(symbols[kept], words.length - np.bincount(whose[at], minlength=len(words.length)), words.n)
        if log is not None:
            changes(words.symbols, made[kept], words.inside(), whose[kept], 1)
    if not done:
        return words
    return Words(*(np.concatenate(x) for x in zip(*done)))


def _summed(*columns: np.ndarray, of: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` with the sum of ``of``."""
    order = np.lexsort(columns)
    sorted_ = [c[order] for c in columns]
    if not len(order):
        return sorted_, of
    first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in sorted_], axis=0)])
    return [c[first] for c in sorted_], np.add.reduceat(of[order], first)


def _read(batch: pa.RecordBatch) -> Words:
    """Rows (w: packed symbols, n) as words."""
    w = batch.column("w")
    _, offsets, data = w.buffers()
    ends = np.frombuffer(offsets, "<i4")[w.offset : w.offset + len(w) + 1]
    symbols = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<i4") if data is not None else np.zeros(0, "<i4")
    length = np.diff(ends) // 4
    filled = length > 0
    return Words(symbols.astype(np.int32), length[filled].astype(np.int64), batch.column("n").to_numpy(zero_copy_only=False)[filled])


def _packed(words: Words) -> pa.RecordBatch:
    ends = np.r_[0, np.cumsum(words.length) * 4].astype("<i4")
    w = pa.Array.from_buffers(pa.binary(), len(words.length), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.symbols.astype("<i4").tobytes())])
    return pa.RecordBatch.from_arrays([w, pa.array(words.n)], ["w", "n"])


class _Tables:
    """Tables of the shared folder that replace one another."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path, before = shared_folder(self.spark, name), self.paths.get(name)
        df.write.parquet(path)
        if before:
            removed(self.spark, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths.values():
            removed(self.spark, path)


def _initial(pretokens: DataFrame) -> DataFrame:
    """(w, n): pre-tokens of at least two bytes as packed byte symbols."""

    def run(batches):
        table = byte_ids()
        for b in batches:
            raw = b.column("w")
            _, offsets, data = raw.buffers()
            ends = np.frombuffer(offsets, "<i4")[raw.offset : raw.offset + len(raw) + 1]
            flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
            words = Words(table[flat], np.diff(ends).astype(np.int64), b.column("n").to_numpy(zero_copy_only=False))
            yield _packed(words.chosen(words.length > 1))

    return pretokens.select(F.col("pretoken").cast("binary").alias("w"), F.col("frequency").alias("n")).mapInArrow(run, "w binary, n bigint")


def _moved_on(words: DataFrame, steps: Steps) -> DataFrame:
    """The words after some more merges; those of a single symbol go."""

    def run(batches):
        for b in batches:
            out = replayed(_read(b), steps)
            yield _packed(out.chosen(out.length > 1))

    return words.mapInArrow(run, "w binary, n bigint")


def _pair_counts(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            words = _read(b)
            if len(words.length):
                inside, whose = np.flatnonzero(words.inside()), np.repeat(np.arange(len(words.length)), words.length)
                (keys,), n = _summed(_key(words.symbols[inside], words.symbols[inside + 1]), of=words.n[whose[inside]])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return words.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _segments(words: DataFrame, hot: np.ndarray) -> DataFrame:
    """Distinct parts of words between pairs that are not hot, with their frequency."""

    def run(batches):
        for b in batches:
            words = _read(b)
            if not len(words.length):
                continue
            keys = _key(words.symbols[:-1], words.symbols[1:])
            found = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            whose = np.repeat(np.arange(len(words.length)), words.length)
            starts = np.flatnonzero(np.r_[True, ~((hot[found] == keys) & words.inside())])
            parts = Words(words.symbols, np.diff(np.r_[starts, len(words.symbols)]), words.n[whose[starts]])
            yield _packed(parts.chosen(parts.length > 1))

    return words.mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def _changes(segments: DataFrame, made: Steps, guess: Steps, hot: np.ndarray, floor: int) -> dict[int, list[tuple[int, int]]]:
    """(pair, change of its count) by step of the guess, for hot pairs and for new ones that reach the floor.

    One pass and one exchange: tasks add up what their segments report, then each pair's changes meet in one task.
    """

    def reported(batches):
        logs: list = []
        for b in batches:
            log: list = []
            replayed(replayed(_read(b), made), guess, log)
            if log:
                step, key, n = (np.concatenate(x) for x in zip(*log))
                new = ((key >> 32) >= guess.first) | ((key & 0xFFFFFFFF) >= guess.first)
                found = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                kept = new | (hot[found] == key)
                (step, key), n = _summed(step[kept], key[kept], of=n[kept])
                logs.append((step, key, n))
        if logs:
            step, key, n = (np.concatenate(x) for x in zip(*logs))
            (step, key), n = _summed(step, key, of=n)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(key), pa.array(n)], ["step", "key", "n"])

    def added(batches):
        logs = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("step", "key", "n")] for b in batches]
        if not logs:
            return
        step, key, n = (np.concatenate(x) for x in zip(*logs))
        (step, key), n = _summed(step, key, of=n)
        (pairs,), gain = _summed(key, of=np.maximum(n, 0))
        gained = gain[np.searchsorted(pairs, key)]
        kept = ((gained == 0) | (gained >= floor)) & (n != 0)
        yield pa.RecordBatch.from_arrays([pa.array(step[kept]), pa.array(key[kept]), pa.array(n[kept])], ["step", "key", "n"])

    schema = "step int, key bigint, n bigint"
    found = segments.mapInArrow(reported, schema).repartition("key").coalesce(ADDERS).mapInArrow(added, schema).toArrow()
    out: dict[int, list[tuple[int, int]]] = {}
    for step, key, n in zip(*(found.column(c).to_pylist() for c in ("step", "key", "n"))):
        out.setdefault(step, []).append((key, n))
    return out


def _pair(key: int) -> Pair:
    return key >> 32, key & 0xFFFFFFFF


class _Ranking:
    """Counts of hot pairs; the best is the most frequent, of these the one with the smallest ids."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.heap = [(-n, k) for k, n in counts.items()]
        heapq.heapify(self.heap)

    def copy(self) -> _Ranking:
        other = object.__new__(_Ranking)
        other.counts, other.heap = dict(self.counts), list(self.heap)
        return other

    def best(self) -> tuple[int, int] | None:
        """(key, count) of the best pair."""
        while self.heap:
            n, key = self.heap[0]
            now = self.counts.get(key, 0)
            if now == -n and now > 0:
                return key, now
            heapq.heappop(self.heap)
        return None

    def take(self, key: int, changes) -> None:
        for k, n in changes:
            now = self.counts[k] = self.counts.get(k, 0) + n
            if now > 0:
                heapq.heappush(self.heap, (-now, k))
        self.counts.pop(key, None)


def learn(pretokens: DataFrame, merges: int, min_frequency: int = 2) -> list[Pair]:
    """Pairs of symbol ids in the order of their merges, learnt from (pretoken, frequency).

    The i-th merge makes symbol ``len(SPECIAL_TOKENS) + BYTES + i``, also where its text repeats an earlier one's. Fewer
    merges come back where no pair is frequent enough.
    """
    tables, base = _Tables(pretokens.sparkSession), len(SPECIAL_TOKENS) + BYTES
    learnt: list[Pair] = []
    words, at_words = tables.write("words", _initial(pretokens)), 0
    while len(learnt) < merges:
        if at_words < len(learnt):
            words, at_words = tables.write("words", _moved_on(words, Steps(learnt[at_words:], base + at_words))), len(learnt)
        best_first = _pair_counts(words).filter(F.col("n") >= min_frequency).orderBy(F.col("n").desc(), "key").limit(HOT + 1).toArrow()
        keys, counts = (best_first.column(c).to_numpy() for c in ("key", "n"))
        if not len(keys):
            break
        floor, last = max(min_frequency, int(counts[0]) // FLOOR), sys.maxsize
        if len(keys) > HOT and counts[HOT] >= floor:
            floor = int(counts[HOT]) + 1
            if counts[0] < floor:  # more pairs share the best count than are held: those up to the last held come first
                floor, last = int(counts[0]), int(keys[HOT])
        ranking = _Ranking(dict(zip(keys[counts >= floor].tolist(), counts[counts >= floor].tolist())))

        def can_take(best: tuple[int, int] | None) -> bool:
            return best is not None and (best[1] > floor or best[1] == floor and best[0] <= last)

        hot = np.array(sorted(ranking.counts), np.int64)
        segments, at_segments = tables.write("segments", _segments(words, hot)), len(learnt)
        known: dict[int, list[tuple[int, int]]] = {}
        while len(learnt) < merges and can_take(ranking.best()):
            guess, trial, made = [], ranking.copy(), {}
            while len(guess) < min(GUESSED, merges - len(learnt)) and can_take(best := trial.best()):
                guess.append(best[0])
                trial.take(best[0], known.get(best[0], ()))
            steps = Steps([_pair(k) for k in guess], base + len(learnt))
            done = Steps(learnt[at_segments:], base + at_segments)
            by_step = _changes(segments, done, steps, np.array(sorted(ranking.counts), np.int64), floor)
            known = {}
            for i, key in enumerate(guess):
                best = ranking.best()
                if not can_take(best) or best[0] != key:
                    # New symbols of steps not taken get other numbers, so only changes of known pairs serve the next guess.
                    known = {k: [c for c in by_step.get(j, ()) if max(_pair(c[0])) < base + len(learnt)] for j, k in enumerate(guess) if j >= i}
                    break
                ranking.take(key, by_step.get(i, ()))
                learnt.append(_pair(key))
    tables.close()
    return learnt


# --- using a vocabulary ----------------------------------------------------------------------------------------


def token_table(spark, merges: list[Pair]) -> DataFrame:
    """Token ids with their bytes in hex: special tokens, the 256 bytes, then one token per merge."""
    ids = byte_ids()
    tokens = [s for s in SPECIAL_TOKENS] + [""] * BYTES
    for b in range(BYTES):
        tokens[ids[b]] = f"{b:02X}"
    for left, right in merges:
        tokens.append(tokens[left] + tokens[right])
    first = len(SPECIAL_TOKENS) + BYTES
    kinds = ["special"] * len(SPECIAL_TOKENS) + ["byte"] * BYTES + ["merge"] * len(merges)
    pairs = [(None, None)] * first + list(merges)
    rows = [(i, t, k, a, b) for i, (t, k, (a, b)) in enumerate(zip(tokens, kinds, pairs, strict=True))]
    return spark.createDataFrame(rows, "id int, token string, kind string, left int, right int")


def merges_of(table: DataFrame) -> list[Pair]:
    """The merges of a token table in order; the table is as long as the vocabulary."""
    rows = table.filter(F.col("kind") == "merge").select("id", "left", "right").collect()
    return [(r["left"], r["right"]) for r in sorted(rows)]


def _gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The runs ``values[start[i] : start[i] + length[i]]`` for each wanted i, one after the other."""
    n = length[wanted]
    ends = np.cumsum(n)
    return values[np.repeat(start[wanted] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def piece_ids(pieces: pa.Array, steps: Steps, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all pieces in order, number of ids of each piece); each distinct piece is encoded once."""
    coded = pieces.dictionary_encode()
    raw = coded.dictionary.cast(pa.binary())
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, "<i4")[raw.offset : raw.offset + len(raw) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    # The place of each piece travels where the frequency is otherwise: replaying does not keep the order.
    done = replayed(Words(table[flat], np.diff(ends).astype(np.int64), np.arange(len(raw))), steps)
    start, length = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    start[done.n], length[done.n] = np.cumsum(done.length) - done.length, done.length
    wanted = coded.indices.to_numpy(zero_copy_only=False)
    return _gathered(done.symbols, start, length, wanted), length[wanted]


# The byte-level pre-token pattern, and the classes of characters that it tells apart.
PRETOKEN = r"(?U)'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = range(4)
_CLASSES: dict[str, Broadcast] = {}


def letter_classes(spark: SparkSession) -> Broadcast:
    """The class of every code point as Spark's own patterns have it, sent to the tasks once a session."""
    app = spark.sparkContext.applicationId
    if app not in _CLASSES:
        c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        kind = F.when(c.rlike(r"(?U)\A\p{L}\z"), LETTER).when(c.rlike(r"(?U)\A\p{N}\z"), NUMBER).when(c.rlike(r"(?U)\A\s\z"), SPACE)
        listed = spark.range(0x110000).filter(~F.col("id").between(0xD800, 0xDFFF))
        found = listed.select("id", kind.alias("kind")).filter("kind IS NOT NULL").toArrow()
        table = np.zeros(0x110000, np.uint8)
        table[found.column("id").to_numpy()] = found.column("kind").to_numpy()
        _CLASSES.clear()
        _CLASSES[app] = spark.sparkContext.broadcast(table)
    return _CLASSES[app]


def cut(texts: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts in order, as bytes; number of pieces of each text): what ``PRETOKEN`` finds, one after the other.

    The pieces are runs of one class. The last blank before a run belongs to it; other white space before a run is cut off
    its last character; an apostrophe that begins a piece takes the letters of a contraction.
    """
    raw = texts.cast(pa.binary()).fill_null(b"")
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, "<i4")[raw.offset : raw.offset + len(raw) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(points)
    if not n:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    # Bytes that continue a character are not counted.
    byte = np.r_[np.flatnonzero((flat & 0xC0) != 0x80), len(flat)]
    rows = np.searchsorted(byte, ends - ends[0])
    first = np.zeros(n + 1, bool)
    first[rows] = True
    kind = classes[points]
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    at = np.flatnonzero((points[:-1] == 0x27) & start[: n - 1] & (kind[1:] == LETTER) & ~first[1:n])
    a = points[at + 1]
    b = np.where(first[at + 2], 0, points[np.minimum(at + 2, n - 1)])
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = np.isin(a, [ord("r"), ord("v")]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    start[at[one | two] + 1] = False
    after = np.r_[at[one] + 2, at[two] + 3]
    after = after[~first[after]]
    start[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(start[:n])
    pieces = np.r_[byte[starts], len(flat)].astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(pieces.tobytes()), pa.py_buffer(flat.tobytes())])
    return out, np.diff(np.searchsorted(starts, rows))


def encoded(texts, merges: list[Pair], shared: Broadcast):
    """Token ids of a text (null: none), row by row without a shuffle, some hundred rows at a time."""
    steps, table = Steps(merges, len(SPECIAL_TOKENS) + BYTES), byte_ids()

    def part(values: pa.Array) -> pa.Array:
        pieces, sizes = cut(values, shared.value)
        ids, n = piece_ids(pieces, steps, table)
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(sizes)]]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))

    @F.arrow_udf("array<int>")
    def encode(values: pa.Array) -> pa.Array:
        # A few hundred rows at a time: the arrays of a whole batch of long texts would take gigabytes.
        parts = [part(values.slice(a, ENCODED)) for a in range(0, len(values), ENCODED)]
        return pa.concat_arrays(parts) if parts else part(values)

    return encode(texts)


#: Bits of a token id inside an n-gram's code.
ID_BITS = 21


def ngram_counts(ids, low: int, high: int):
    """(term, tf) of the n-grams of each array of token ids, counted where the row is.

    A term is one number: the ids plus one in ``ID_BITS`` bits each, so that shorter n-grams have codes of their own.
    """
    if high * ID_BITS > 63:
        raise ValueError(f"n-grams of up to {63 // ID_BITS} ids fit a code, not {high}")

    @F.arrow_udf("array<struct<term:bigint,tf:int>>")
    def count(values: pa.Array) -> pa.Array:
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 1
        sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        codes, rows = [], []
        for n in range(low, high + 1):
            m = len(flat) - n + 1
            if m <= 0:
                continue
            code = np.zeros(m, np.int64)
            for j in range(n):
                code = (code << ID_BITS) | flat[j : j + m]
            whole = row[:m] == row[n - 1 :]
            codes.append(code[whole])
            rows.append(row[:m][whole])
        code, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, rows))
        (code, row), tf = _summed(code, row, of=np.ones(len(code), np.int64))
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(sizes)))].astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(code), pa.array(tf.astype(np.int32))], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(ends), struct)

    return count(ids)


def ngram_ids(term):
    """The token ids of an n-gram's code, space-joined."""
    one = F.lit((1 << ID_BITS) - 1)
    parts = [F.shiftright(term, i * ID_BITS).bitwiseAND(one) for i in (2, 1, 0)]
    return F.concat_ws(" ", *[F.when(p > 0, (p - 1).cast("string")) for p in parts])
