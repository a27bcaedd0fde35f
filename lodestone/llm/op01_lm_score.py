"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs of the training fold are quantised on a logarithmic scale: level(c) = 1 + floor(log(c) / log(BASE)).
An n-gram of level q enters a Bloom filter as the items (n-gram, 1) ... (n-gram, q). An n-gram's level is found by probing
(n-gram, 1), (n-gram, 2), ... until one is missing; the middle of the counts of that level stands for its count.
A pair's count is held to those of its words, which a true count cannot exceed; that undoes many false positives.
From these counts come smoothed probabilities: P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU), P(w) add-0.1 over all counts.
MU is the value at which the mass that the model leaves to pairs not seen, the mean of MU / (c(v) + MU) over all tokens v, equals the
share of training tokens whose pair occurs once (Good and Turing's estimate of the unseen). Both sides are taken over the whole training fold.

The filter has :data:`TOKEN_BITS` bits per training token at every corpus size, so its rate of false positives stays. It is made of
segments; an n-gram's hash names its segment and all its items fall in it. Tasks send their counts packed by segment, and each segment is
built whole by one task from summed counts; segments number so many that the counts of one fit a worker. A filter of at most
``broadcast_bits`` is broadcast. A larger one stays in the shared folder and is probed where it lies: a run of texts sends its distinct n-grams,
packed, to the shards (runs of segments) that hold them, each shard's task probes them, and the levels return to the run. Both ways give the same scores.
A run's own rows pass by the shards' stage, so that texts are read once for it; its tokens go as codes of its distinct words.

The base score needs exact counts. Words that occur often (at most :data:`HOT_WORDS` of them, by a threshold on their counts) are broadcast
with their counts; the others' are joined by a shuffle, in which each text sends a word once. A word of more than :data:`NAME_BYTES`
bytes goes by its SHA-256. Neither counts nor words of the corpus come to the driver beyond these bounds.

Cases. Null text: as empty; its one token is the end. Null id: held out by the rule for empty text (crc32 0). Repeated rows: each is a
row of the corpus and gets a row of the result. Very long texts: whole. Empty table, or no training text: all counts 0, probabilities uniform.
Words that occur in held-out texts alone have count 0. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

#: A filter of at most so many bits (128 MB) is broadcast.
BROADCAST_BITS = 1 << 30
#: Segments are a power of two: at least so many, and enough for each to hold about so many training tokens.
LEAST_SEGMENT_BITS, MOST_SEGMENT_BITS, SEGMENT_TOKENS = 12, 24, 1 << 20
#: Bits of a shard, the part of a larger filter that one task probes at a time, and the exponent of the least number of them.
SHARD_BITS, LEAST_SHARDS = 1 << 26, 5
PROBES = 4
#: Filter bits by training token.
TOKEN_BITS = 8
BASE = 1.5
LEVELS = 64
HOT_WORDS, NAME_BYTES = 150_000, 64
#: MU lies between these.
LEAST_MU, MOST_MU = 1e-3, 1e9
#: The end of a text; no word holds a space.
END = b" "
#: Tokens whose counts a worker holds before it sends them, and words whose hashes it keeps.
HELD, CACHE = 2_000_000, 200_000
#: Text bytes scored or counted at a time; every token has some numbers of eight bytes.
SLICE = 1 << 20
#: Text bytes of a run, whose distinct n-grams are sent to the shards together.
RUN = 4 << 20
#: n-grams that are probed at a time, so that what the probes hold stays in a processor's cache.
PROBED = 1 << 15
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LEVEL, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB)


class Tokens:
    """A run of texts as tokens: lower-cased (A-Z) words between characters of ``[\\x20\\x09-\\x0D]``, and after each text's the end; null is empty.

    ``words`` are the distinct ones, the end last; ``codes`` their places in it, token by token; ``starts`` and ``sizes`` are the texts'.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        inside = ((data - np.uint8(9)) > 4) & (data != 32)
        lower = data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
        # A word begins or ends at white space and at a text's bounds.
        edge = np.ones(len(data) + 1, bool)
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[bounds] = True
        begin, end = np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & edge[1:]) + 1
        offsets = np.zeros(len(begin) + 1, np.int32)
        np.cumsum(end - begin, out=offsets[1:])
        found = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(lower[inside])]).dictionary_encode()
        self.words: pa.Array = pa.concat_arrays([found.dictionary, pa.array([END], pa.binary())])
        self.sizes = np.diff(np.searchsorted(begin, bounds)) + 1
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        is_word = np.ones(len(begin) + len(texts), bool)
        is_word[ends - 1] = False
        self.codes = np.full(len(is_word), len(self.words) - 1, np.int32)
        self.codes[is_word] = found.indices.to_numpy()

    def listed(self) -> list[bytes]:
        return self.words.to_numpy(zero_copy_only=False).tolist()


class Hashes(dict):
    """64-bit hashes by word; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """As :class:`Hashes`, for words that come once."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * _PAIR + (second ^ (second >> np.uint64(32))) * _STEP)


def level(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE(count)), at most LEVELS."""
    return np.minimum(LEVELS, 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9)).astype(np.int64)


#: The middle of a level's whole counts; 0 for level 0.
MIDDLE = np.array([0.0] + [(math.ceil(BASE ** (q - 1) - 1e-9) + max(math.ceil(BASE**q - 1e-9) - 1, math.ceil(BASE ** (q - 1) - 1e-9))) / 2 for q in range(1, LEVELS + 1)])


def segment(key: np.ndarray, segment_bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - segment_bits)).astype(np.int64)


class Filter:
    """The log-frequency Bloom filter, or its segments from ``first`` on; each is ``width`` bits."""

    def __init__(self, bits: bytes | bytearray, width: int, segment_bits: int, first: int = 0) -> None:
        self.bytes_ = np.frombuffer(bits, np.uint8)
        self.width, self.segment_bits, self.first = width, segment_bits, first

    @staticmethod
    def start(key: np.ndarray, q: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """What the places of the items (key, q) are derived from."""
        x = _mixed(key + (np.asarray(q).astype(np.uint64) * _LEVEL))
        return x, (x * _STEP) | np.uint64(1)

    @staticmethod
    def place(x: np.ndarray, step: np.ndarray, i: int, width: int) -> np.ndarray:
        """The i-th bit of each item, within its segment."""
        return (((x + np.uint64(i) * step) >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """By membership probes, level after level, until one is missing."""
        return self.levels_up_to(key, np.full(len(key), LEVELS, np.uint8))

    def levels_up_to(self, key: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The lesser of an n-gram's level and ``most``, beyond which it is not probed. Sorted keys are probed near each other."""
        out = np.zeros(len(key), np.uint8)
        for lo in range(0, len(key), PROBED):
            self._probe(key[lo : lo + PROBED], most[lo : lo + PROBED], out[lo : lo + PROBED])
        return out

    def _probe(self, key: np.ndarray, most: np.ndarray, out: np.ndarray) -> None:
        width, half = np.uint64(self.width), np.uint64(32)
        open_ = np.arange(len(key))
        at = (segment(key, self.segment_bits) - self.first).astype(np.uint64) * width
        for q in range(1, LEVELS + 1):
            more = np.flatnonzero(most >= q)
            if len(more) < len(open_):
                at, key, most, open_ = at[more], key[more], most[more], open_[more]
            if not len(open_):
                break
            # As ``place``, probe by probe.
            x, step = self.start(key, q)
            for i in range(PROBES):
                if i:
                    x += step
                bit = x >> half
                bit *= width
                bit >>= half
                bit += at
                bytes_ = self.bytes_.take((bit >> np.uint64(3)).view(np.int64))
                bytes_ >>= bit.astype(np.uint8) & np.uint8(7)
                good = np.flatnonzero((bytes_ & np.uint8(1)).view(bool))
                if len(good) < len(open_):
                    at, key, most, open_, x, step = at[good], key[good], most[good], open_[good], x[good], step[good]
            out[open_] = q


_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))


def before(words: np.ndarray, starts: np.ndarray, end: int | np.uint64 = _END_HASH) -> np.ndarray:
    """What stands before each token; the end before a text's first."""
    out = np.concatenate([np.array([end], words.dtype), words[:-1]])
    out[starts] = end
    return out


def pairs(codes: np.ndarray, starts: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Hashes of the tokens' pairs from those of their distinct words, the end last."""
    out = np.empty(len(codes), np.uint64)
    prior = before(codes, starts, len(hashed) - 1)
    for lo in range(0, len(out), PROBED):
        out[lo : lo + PROBED] = pair_hash(hashed[prior[lo : lo + PROBED]], hashed[codes[lo : lo + PROBED]])
    return out


class Model:
    """Sizes, MU, and where the filter is: broadcast with the model, or as a table of segments."""

    def __init__(self, n: int, v: int, mu: float, segment_bits: int, width: int, filter_: Filter | None = None, segments: DataFrame | None = None) -> None:
        self.n, self.v, self.mu, self.segment_bits, self.width, self.filter, self.segments = n, v, mu, segment_bits, width, filter_, segments

    def __getstate__(self) -> dict:
        return {**self.__dict__, "segments": None}

    def log_p(self, own: np.ndarray, prior: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 P(token | token before) from the levels of the token, the one before and the pair."""
        out = np.empty(len(own))
        for lo in range(0, len(own), PROBED):
            hi = lo + PROBED
            out[lo:hi] = self._log_p(own[lo:hi], prior[lo:hi], pair[lo:hi])
        return out

    def _log_p(self, own: np.ndarray, prior: np.ndarray, pair: np.ndarray) -> np.ndarray:
        own, prior, pair = (np.minimum(MIDDLE[x], self.n) for x in (own, prior, pair))
        pair = np.minimum(pair, np.minimum(own, prior))
        p = np.minimum((own + 0.1) / (self.n + 0.1 * (self.v + 1)), 1.0)
        return np.log10((pair + self.mu * p) / (prior + self.mu))

    def scores(self, found: Tokens, hashed: np.ndarray) -> np.ndarray:
        """log10 probabilities of whole texts, by the filter at hand; ``hashed`` are their distinct words."""
        known, order = np.zeros(len(hashed), np.uint8), np.argsort(hashed)
        known[order] = self.filter.levels(hashed[order])
        own = known[found.codes]
        prior = before(own, found.starts, known[-1])
        keys = pairs(found.codes, found.starts, hashed)
        # Each pair once, and no further than to the levels of its words, to which it is held.
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        heads = np.flatnonzero(new)
        pair = np.empty(len(keys), np.uint8)
        pair[order] = self.filter.levels_up_to(keys[heads], np.maximum.reduceat(np.minimum(own, prior)[order], heads))[np.cumsum(new) - 1]
        return np.add.reduceat(self.log_p(own, prior, pair), found.starts)


def unseen_mu(sizes: list[tuple[int, int]], singles: int) -> float:
    """MU for words of these (count, tokens in all) if ``singles`` tokens have a pair that occurs once."""
    c = np.array([x for x, _ in sizes], float)
    tokens_ = np.array([x for _, x in sizes], float)
    low, high = math.log(LEAST_MU), math.log(MOST_MU)
    for _ in range(100):
        mid = (low + high) / 2
        mu = math.exp(mid)
        low, high = (mid, high) if float((tokens_ * (mu / (c + mu))).sum()) < singles else (low, mid)
    return math.exp((low + high) / 2)


def name(word: bytes) -> bytes:
    """The word, or for a long one a name that no word has."""
    return word if len(word) <= NAME_BYTES else END + hashlib.sha256(word).digest()


def named(words: pa.Array) -> pa.Array:
    """The words by their names."""
    long = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > NAME_BYTES)
    if not len(long):
        return words
    own = words.to_pylist()
    for i in long.tolist():
        own[i] = name(own[i])
    return pa.array(own, pa.binary())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, summed over some millions of tokens at a time."""

    def out(parts: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        all_ = pa.concat_arrays([x for x, _ in parts]).dictionary_encode()
        n = np.bincount(all_.indices.to_numpy(), np.concatenate([x for _, x in parts])).astype(np.int64)
        own = named(all_.dictionary)
        for lo in range(0, len(own), 100_000):
            yield pa.RecordBatch.from_arrays([own[lo : lo + 100_000], pa.array(n[lo : lo + 100_000])], ["word", "n"])

    parts, held = [], 0
    for batch in (x for b in batches for x in common.slices(b, 0, SLICE)):
        found = Tokens(batch.column(0))
        parts.append((found.words, np.bincount(found.codes, minlength=len(found.words))))
        held += len(found.codes)
        if held >= HELD:
            yield from out(parts)
            parts, held = [], 0
    yield from out(parts)


def _count_grams(segment_bits: int):
    """Counts of hashed words and pairs, summed likewise and packed by segment."""
    places = np.arange(1 << segment_bits, dtype=np.uint64) << np.uint64(64 - segment_bits)

    def out(grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        # Sorted keys lie by segment. Most counts are 1 and not sent.
        once, often, times = key[n == 1], key[n > 1], n[n > 1].astype(np.uint32)
        cuts, cuts_often = ([*np.searchsorted(k, places), len(k)] for k in (once, often))
        some = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(cuts_often) > 0)).tolist()
        for lo in range(0, len(some), 256):
            own = some[lo : lo + 256]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int32()), pa.array([once[cuts[i] : cuts[i + 1]].tobytes() for i in own], pa.binary()),
                    pa.array([often[cuts_often[i] : cuts_often[i + 1]].tobytes() for i in own], pa.binary()), pa.array([times[cuts_often[i] : cuts_often[i + 1]].tobytes() for i in own], pa.binary()),
                ],
                ["segment", "once", "often", "times"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = [], 0
        for batch in (x for b in batches for x in common.slices(b, 0, SLICE)):
            found = Tokens(batch.column(0))
            hashed = word_hashes(found.listed())
            grams += [hashed[found.codes], pairs(found.codes, found.starts, hashed)]
            held += len(found.codes)
            if held >= HELD:
                yield from out(grams)
                grams, held = [], 0
        yield from out(grams)

    return count


SEGMENT_ROW = "segment int, bits binary, singles long"


def _segments(width: int):
    """Builds segments from packed counts, which come sorted by segment: one row (segment, bits, n-grams that occur once) each."""

    def bits(parts: list[tuple[bytes, bytes, bytes]]) -> tuple[bytes, int]:
        once, often = (np.frombuffer(b"".join(p[k] for p in parts), np.uint64) for k in (0, 1))
        times = np.frombuffer(b"".join(p[2] for p in parts), np.uint32).astype(np.int64)
        key = np.concatenate([once, often])
        n = np.concatenate([np.ones(len(once), np.int64), times])
        order = np.argsort(key)
        key, n = key[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n, heads)
        key, q = key[heads], level(n.astype(float))
        # A row for each level that an n-gram enters.
        key = np.repeat(key, q)
        lev = np.arange(len(key)) - np.repeat(np.cumsum(q) - q, q) + 1
        held = np.zeros(width, bool)
        x, step = Filter.start(key, lev)
        for i in range(PROBES):
            held[Filter.place(x, step, i, width)] = True
        return np.packbits(held, bitorder="little").tobytes(), int((n == 1).sum())

    def row(own: int, parts: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        data, singles = bits(parts)
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([data], pa.binary()), pa.array([singles], pa.int64())], ["segment", "bits", "singles"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for own, *blobs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if own != now and parts:
                    yield row(now, parts)
                    parts = []
                now = own
                parts.append(tuple(blobs))
        if parts:
            yield row(now, parts)

    return build


def by_count(words: DataFrame) -> list[tuple[int, int, int, int]]:
    """(step, words, tokens, least count) by count on a scale of some thousand steps: a small table whatever the corpus."""
    step = F.floor(F.log(F.col("n").cast("double")) * 64).cast("int")
    grouped = words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least"))
    return sorted((r["s"], r["words"], r["tokens"], r["least"]) for r in grouped.collect())


CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within go when these end, and do not lie beside what comes after."""
    was = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, was)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bits: int = BROADCAST_BITS, token_bits: int = TOKEN_BITS) -> tuple[Model, DataFrame]:
    """The model, and the table of exact word counts (word, n) in the shared folder."""
    training = docs.where(common.fold_remainder(F.col(id_col), 10) != 0)
    text = training.select(F.col(text_col).alias("text"))
    # Executors may be lost while later steps read the words, so they are written.
    with shuffles_end(docs.sparkSession):
        words = common.materialize(text.transform(common.in_arrow, _count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    steps = by_count(words)
    n, v = sum(x[2] for x in steps), sum(x[1] for x in steps)
    segment_bits = int(np.clip(math.ceil(math.log2(max(n, 1) / SEGMENT_TOKENS)), LEAST_SEGMENT_BITS, MOST_SEGMENT_BITS))
    width = max(8, token_bits * (n + v) // (1 << segment_bits) // 8 * 8)
    # Segments are dealt to partitions; each partition's come one after another.
    packed = text.transform(common.in_arrow, _count_grams(segment_bits), "segment int, once binary, often binary, times binary").repartition("segment").sortWithinPartitions("segment")
    built = packed.transform(common.in_arrow, _segments(width), SEGMENT_ROW)
    if width << segment_bits <= broadcast_bits:
        with shuffles_end(docs.sparkSession):
            rows = built.toArrow()
        flags = bytearray((width << segment_bits) // 8)
        for own, bits in zip(rows.column("segment").to_pylist(), rows.column("bits"), strict=True):
            flags[own * width // 8 : (own + 1) * width // 8] = bits.as_py()
        singles, filter_, segments = sum(rows.column("singles").to_pylist()), Filter(flags, width, segment_bits), None
    else:
        with shuffles_end(docs.sparkSession):
            segments = common.materialize(built, "lm-segments")
        singles, filter_ = segments.agg(F.coalesce(F.sum("singles"), F.lit(0))).first()[0], None
    # Step 0 holds the words that occur once.
    singles -= sum(x[1] for x in steps if x[3] == 1)
    mu = unseen_mu([(tokens_ / words_, tokens_) for _, words_, tokens_, _ in steps], singles)
    return Model(int(n), int(v), mu, segment_bits, width, filter_, segments), words


def hot_words(words: DataFrame) -> tuple[dict[bytes, int], int]:
    """The most frequent words with their counts, at most HOT_WORDS of them, and the count from which on all words are in."""
    least, room = None, HOT_WORDS
    for _, found, _, low in reversed(by_count(words)):
        if found > room:
            break
        least, room = low, room - found
    if least is None:
        return {}, 1 << 62
    return {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= least).collect()}, least


PREPARED = ["doc_id", "held_out", "text_md5", "n_tokens", "n_hot", "hot_score", "cold"]


def _prepared(batch: pa.RecordBatch, logs: dict[bytes, float]) -> tuple[pa.RecordBatch, Tokens, np.ndarray]:
    """What a slice of texts says without the filter, its tokens and their distinct words' hashes. batch: doc_id, held_out, text_md5, text."""
    found = Tokens(batch.column(3))
    own = found.listed()
    names = named(found.words)
    logs_of = np.fromiter(map(logs.get, own if names is found.words else names.to_pylist(), repeat(math.nan)), float, len(own))
    is_cold = np.isnan(logs_of)
    hot_score = np.add.reduceat(np.nan_to_num(logs_of)[found.codes], found.starts)
    # A text's words that are not hot, each once with its frequency.
    at = np.flatnonzero(is_cold[found.codes])
    texts = np.repeat(np.arange(len(found.sizes)), found.sizes)[at]
    each, tf = np.unique(texts * len(own) + found.codes[at], return_counts=True)
    offsets = np.searchsorted(each, np.arange(len(found.sizes) + 1) * len(own)).astype(np.int32)
    words = pa.StructArray.from_arrays([names.take(pa.array(each % len(own))), pa.array(tf, pa.int64())], ["word", "tf"])
    n_hot = found.sizes - np.bincount(texts, minlength=len(found.sizes))
    cold = pa.ListArray.from_arrays(pa.array(offsets), words)
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found.sizes), pa.array(n_hot), pa.array(hot_score), cold], PREPARED), found, word_hashes(own)


def _with_score(prepared: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*prepared.columns, pa.array(scores)], [*PREPARED, "score"])


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of rows with one value in a column, as they come."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            if rows and row[column] != now:
                yield now, rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield now, rows


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on: those of sorted or small numbers compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_levels(levels: np.ndarray) -> bytes:
    return len(levels).to_bytes(8, "little") + pa.compress(levels.tobytes(), codec="zstd", asbytes=True)


def unpacked_levels(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class Packed:
    """The distinct words of a run, by the places of the hot ones and the names that the prepared rows hold anyway; a long word's hash goes with them."""

    def __init__(self, logs: dict[bytes, float]) -> None:
        self.places = {w: i for i, w in enumerate(logs, 1)}
        self.hashes = word_hashes([END, *logs])

    def pack(self, found: Tokens, hashed: np.ndarray) -> bytes:
        at = np.fromiter(map(self.places.get, named(found.words).to_numpy(zero_copy_only=False).tolist(), repeat(0)), np.int32, len(hashed))
        long = np.flatnonzero(pc.binary_length(found.words).to_numpy(zero_copy_only=False) > NAME_BYTES)
        return np.array([len(hashed), len(long), *long]).tobytes() + hashed[long].tobytes() + pa.compress(planes(at), codec="zstd", asbytes=True)

    def unpack(self, data: bytes, cold: pa.ListArray) -> np.ndarray:
        """The hashes. Codes are given as words first occur, so texts' cold words by code come in the order of their codes."""
        k, n = np.frombuffer(data, np.int64, 2).tolist()
        long, hashes = np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.uint64, n, 16 + 8 * n)
        at = from_planes(pa.decompress(data[16 + 16 * n :], decompressed_size=4 * k, codec="zstd", asbytes=True), np.int32)
        out = self.hashes[at]
        others = [w for w in cold.flatten().field("word").dictionary_encode().dictionary.to_numpy(zero_copy_only=False).tolist() if w != END]
        out[np.flatnonzero(at[:-1] == 0)] = word_hashes(others)
        out[long] = hashes
        out[-1] = _END_HASH
        return out


def scored_by_shards(source: DataFrame, model: Model, known: Broadcast, schema: str) -> DataFrame:
    """The prepared rows with their scores, the filter being too large to broadcast."""
    segment_bits, width = model.segment_bits, model.width
    shard_bits = int(np.clip(math.ceil(math.log2((width << segment_bits) / SHARD_BITS)), LEAST_SHARDS, segment_bits))
    inner = segment_bits - shard_bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run of texts one row with its prepared rows and its tokens, which passes by some shard, and its n-grams by shard."""
        logs, task, words = known.value, TaskContext.get(), Packed(known.value)
        packed = pa.ipc.IpcWriteOptions(compression="zstd")
        run = 0
        for batch in (x for b in batches for x in common.slices(b, 3, RUN)):
            prepared, found, hashed = _prepared(batch, logs)
            keys = np.unique(np.concatenate([hashed, pairs(found.codes, found.starts, hashed)]))
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, prepared.schema, options=packed) as out:
                out.write_batch(prepared)
            codes = pa.compress(planes(found.codes), codec="zstd", asbytes=True)
            cuts = [*np.searchsorted(keys, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)), len(keys)]
            some = np.flatnonzero(np.diff(cuts)).tolist()
            own = f"{task.partitionId()}-{run}"
            by = (task.partitionId() + run) % (1 << shard_bits)
            run += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([own] * (1 + len(some))), pa.array([by, *some], pa.int32()), pa.array([sink.getvalue(), *(planes(np.diff(keys[cuts[i] : cuts[i + 1]], prepend=np.uint64(0))) for i in some)], pa.binary()),
                    pa.array([words.pack(found, hashed)] + [None] * len(some), pa.binary()), pa.array([codes] + [None] * len(some), pa.binary()),
                ],
                ["run", "shard", "data", "words", "codes"],
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, its segments first: each run's levels. Prepared rows pass, as shard -1."""
        now, flags, filter_ = None, None, None
        for batch in batches:
            answers: list[tuple[str, int, bytes, bytes | None, bytes | None]] = []
            for shard, run, at, data, words, codes in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if codes is not None:
                    answers.append((run, -1, data, words, codes))
                    continue
                if shard != now:
                    now, flags, filter_ = shard, bytearray((width << inner) // 8), None
                if run is None:
                    lo = (at - (shard << inner)) * width // 8
                    flags[lo : lo + len(data)] = data
                    continue
                filter_ = filter_ or Filter(flags, width, segment_bits, shard << inner)
                answers.append((run, shard, packed_levels(filter_.levels(np.cumsum(from_planes(data, np.uint64), dtype=np.uint64))), None, None))
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for a in answers], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["run", "shard", "data", "words", "codes"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Packed(known.value)
        for _, ((_, _, prepared, words, codes), *answers) in _groups(batches, 0):
            rows = pa.ipc.open_stream(prepared).read_all().combine_chunks().to_batches()[0]
            sizes = rows.column(3).to_numpy()
            k, starts, hashed = int(sizes.sum()), np.cumsum(sizes) - sizes, hot.unpack(words, rows.column(6))
            codes = from_planes(pa.decompress(codes, decompressed_size=4 * k, codec="zstd", asbytes=True), np.int32)
            # The n-grams' order is that in which they were asked for.
            at = np.unique(np.concatenate([hashed, pairs(codes, starts, hashed)]), return_inverse=True)[1]
            levels = np.frombuffer(b"".join(unpacked_levels(a[2]) for a in answers), np.uint8)[at]
            of_words, pair = levels[: len(hashed)], levels[len(hashed) :]
            own = of_words[codes]
            yield _with_score(rows, np.add.reduceat(model_.log_p(own, before(own, starts, of_words[-1]), pair), starts))

    model_ = Model(model.n, model.v, model.mu, segment_bits, width)
    asked = source.transform(common.in_arrow, ask, "run string, shard int, data binary, words binary, codes binary")
    none = F.lit(None)
    filter_rows = model.segments.select(
        F.shiftright("segment", inner).alias("shard"), none.cast("string").alias("run"), F.col("segment").alias("at"), F.col("bits").alias("data"), none.cast("binary").alias("words"), none.cast("binary").alias("codes")
    )
    probe_rows = asked.select("shard", "run", none.cast("int").alias("at"), "data", "words", "codes")
    dealt = filter_rows.unionByName(probe_rows).repartition("shard").sortWithinPartitions("shard", F.col("run").asc_nulls_first())
    levels = dealt.transform(common.in_arrow, probe, "run string, shard int, data binary, words binary, codes binary")
    # The probes need not lie beside the levels on their way back.
    with shuffles_end(source.sparkSession):
        levels = common.materialize(levels, "lm-levels")
    back = levels.repartition("run").sortWithinPartitions("run", "shard")
    return back.transform(common.in_arrow, finish, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bits: int = BROADCAST_BITS, token_bits: int = TOKEN_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    model, words = train(docs, id_col, text_col, broadcast_bits, token_bits)
    hot, least = hot_words(words)
    known = spark.sparkContext.broadcast({w: math.log10(c + 0.1) for w, c in hot.items()})
    held_out = common.fold_remainder(F.col(id_col), 10) == 0
    source = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("text_md5"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, text_md5 binary, n_tokens long, n_hot long, hot_score double, cold array<struct<word:binary,tf:long>>, score double"

    if model.filter is None:
        scored = scored_by_shards(source, model, known, schema)
    else:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, logs = shared.value, known.value
            for batch in (x for b in batches for x in common.slices(b, 3, SLICE)):
                prepared, found, hashed = _prepared(batch, logs)
                yield _with_score(prepared, own.scores(found, hashed))

        scored = source.transform(common.in_arrow, run, schema)
    # One row per cold word; a text's own numbers ride on the first. A text without cold words gets a word that no table holds.
    rows = scored.select("doc_id", "held_out", "text_md5", "n_tokens", "n_hot", "hot_score", "score", F.posexplode_outer("cold").alias("at", "cold"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    numbers = [F.when(first, F.col(c)).alias(c) for c in ("n_tokens", "n_hot", "hot_score", "score")]
    none = F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    sent = rows.select("doc_id", "held_out", "text_md5", *numbers, first.cast("long").alias("rows"), F.coalesce("cold.word", none).alias("word"), F.coalesce("cold.tf", F.lit(0)).alias("tf"))
    cold_words = words.where(F.col("n") < least)
    joined = sent.join(cold_words, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    summed = joined.groupBy("doc_id", "held_out", "text_md5").agg(
        F.sum("rows").alias("rows"), F.max("n_tokens").alias("n_tokens"), F.max("n_hot").alias("n_hot"), F.max("hot_score").alias("hot_score"), F.max("score").alias("score"),
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("cold_known"), F.sum(F.col("tf") * F.log10(c + 0.1)).alias("cold_score"),
    )
    base = F.col("hot_score") + F.col("cold_score") / F.col("rows") - F.col("n_tokens") * F.lit(math.log10(model.n + 0.1 * (model.v + 1)))
    # Repeated rows of one id and text were summed together.
    copies = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return copies.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + (F.col("cold_known") / F.col("rows")).cast("long")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
