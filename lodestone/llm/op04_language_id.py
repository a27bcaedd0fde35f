"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts up to :data:`ORDER` bytes long with symbol counts. A symbol is coded in the longest
known context; one not seen there costs an escape (method C: distinct symbols d among n occurrences, escape d / (n + d)) and
is coded in the next shorter context without the symbols already ruled out, down to a uniform code over the symbols never seen.
The trees are frozen after training, so a symbol's exact code length is a function of the last ORDER + 1 bytes: it is
tabulated for every byte string of that length seen in training and computed, by the same function, for the rest. A text's
language is the one with the shortest total code, its score the posterior of that language under equal priors.

Training uses a bounded sample of labelled rows: per language about :data:`SAMPLE_ROWS` rows by hash of id and text, and of a text at
most :data:`SAMPLE_CHARS` characters, from a place chosen by hash. That bounds what is gathered and broadcast whatever the corpus; it grows only with
the number of languages. Texts are scored whole.

Cases. Null text, or one without any letter: ``und``, score 0. Null language: not learned from. Null id: hashed as empty
text for the fold. Repeated rows: one result each. Very long texts: whole, in slices of fixed size. Ties: the smaller
language name. Empty table, or nothing to learn from: ``und``. Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

ORDER = 3
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 20_000
#: Bytes before a text's first.
PAD = b" " * ORDER
#: Positions scored at a time.
SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The big-endian number of each byte with the ``order`` bytes before it; the first ``order`` bytes have none."""
    n = len(data) - order
    out = np.zeros(max(n, 0), np.uint32 if order <= 3 else np.uint64)
    for i in range(order + 1):
        out = (out << np.array(8, out.dtype)) | data[i : n + i].astype(out.dtype)
    return out


class Tree:
    """Frozen counts of one language, as sorted arrays for each order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
        self.gram, self.n, self.ctx, self.total, self.distinct, self.ruled_n = [], [], [], [], [], []
        for j in range(order + 1):
            gram, at = np.unique(keys & np.uint64((1 << 8 * (j + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts)
            ctx, of = np.unique(gram >> np.uint64(8), return_inverse=True)
            self.gram.append(gram)
            self.n.append(n)
            self.ctx.append(ctx)
            self.total.append(np.bincount(of, n))
            self.distinct.append(np.bincount(of).astype(np.float64))
            # What the next shorter context counts of the symbols that this one knows.
            self.ruled_n.append(np.bincount(of, self.n[j - 1][np.searchsorted(self.gram[j - 1], gram & np.uint64((1 << 8 * j) - 1))]) if j else None)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Exact code lengths of the last byte of each key after its other bytes."""
        keys = keys.astype(np.uint64)
        cost, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        gone_n, gone_d = np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(self.order, -1, -1):
            ctx = (keys >> np.uint64(8)) & np.uint64((1 << 8 * j) - 1)
            at, known = _find(self.ctx[j], ctx)
            n, d = self.total[j][at] - gone_n, self.distinct[j][at] - gone_d
            use = open_ & known & (d > 0)
            g, has = _find(self.gram[j], keys & np.uint64((1 << 8 * (j + 1)) - 1))
            hit = use & has
            cost[hit] += np.log2((n + d)[hit] / self.n[j][g[hit]])
            open_ &= ~hit
            out = use & ~has
            cost[out] += np.log2((n + d)[out] / d[out])
            if j:
                gone_n = np.where(known, self.ruled_n[j][at], 0.0)
                gone_d = np.where(known, self.distinct[j][at], 0.0)
        cost[open_] += np.log2(256 - self.distinct[0][0])
        return cost


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class Index:
    """Places of known keys, by hashing in rounds: what finds its slot taken goes on to the next, smaller one."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.rounds = keys, []
        left, salt = np.arange(len(keys)), 0
        while len(left):
            bits = max(4, int(np.ceil(np.log2(4 * len(left)))))
            slots = np.full(1 << bits, -1, np.int32)
            mult = np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1) | 1)
            h = self._slot(keys[left], mult, bits)
            slots[h] = left
            self.rounds.append((slots, mult, bits))
            left, salt = left[slots[h] != left], salt + 1

    @staticmethod
    def _slot(keys: np.ndarray, mult: np.uint64, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * mult) >> np.uint64(64 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out, rest = None, None
        for slots, mult, bits in self.rounds:
            own = keys if rest is None else keys[rest]
            at = slots[self._slot(own, mult, bits)]
            at[(at >= 0) & (self.keys[at] != own)] = -1
            if rest is None:
                out = at
            else:
                out[rest] = at
            rest = np.flatnonzero(at < 0) if rest is None else rest[at < 0]
            if not len(rest):
                break
        return out if out is not None else np.full(len(keys), -1, np.int32)


class Model:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        self.order, self.langs = order, sorted(counts)
        self.trees = [Tree(*counts[x], order) for x in self.langs]
        kind = np.uint32 if order <= 3 else np.uint64
        self.keys = np.unique(np.concatenate([counts[x][0] for x in self.langs])).astype(kind) if self.langs else np.zeros(0, kind)
        self.index = Index(self.keys)
        self.table = np.stack([t.bits(self.keys) for t in self.trees]) if self.langs else np.zeros((0, 0))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, a row per text and a column per language."""
        pad = PAD[: self.order] if self.order <= len(PAD) else b" " * self.order
        data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + self.order) - sizes
        ends = starts + sizes
        out = np.zeros((len(texts), len(self.langs)))
        for lo in range(self.order, len(data), SLICE):
            hi = min(lo + SLICE, len(data))
            keys = grams(data[lo - self.order : hi], self.order)
            own = np.arange(np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi, side="left"))
            own = own[sizes[own] > 0]
            # Text and padding take turns, so no piece between two edges is empty; those of padding are left out.
            edges = np.stack([np.maximum(starts[own], lo), np.minimum(ends[own], hi)], axis=1).ravel() - lo
            edges = edges[:-1] if len(edges) and edges[-1] == hi - lo else edges
            if not len(edges):
                continue
            found = self.index.find(keys)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                odd, which = np.unique(keys[missing], return_inverse=True)
            for i in range(len(self.langs)):
                bits = self.table[i][found]
                if len(missing):
                    bits[missing] = self.trees[i].bits(odd)[which]
                out[own, i] += np.add.reduceat(bits, edges)[::2]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        total = self.lengths([(t or "").encode() for t in texts])
        best = total.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(total.min(axis=1, keepdims=True) - total, -1000.0)).sum(axis=1)
        return [(self.langs[b], float(s)) if t and _LETTER.search(t) else ("und", 0.0) for t, b, s in zip(texts, best, share, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, order: int = ORDER, chars: int = SAMPLE_CHARS) -> Model:
    """Trees from about ``rows`` rows per language of those outside the fold crc32 mod 4 = 2."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where((common.fold_remainder(F.col("id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = common.materialize(own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "ppm-languages")
    if sizes.isEmpty():
        return Model({}, order)
    at = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text")), F.lit(1 << 40))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n")) * F.lit(float(1 << 40))
    sample = own.join(common.maybe_broadcast(sizes, 256), "lang").where(at < share).dropDuplicates(["id", "text"])
    # One place in a longer text, by another hash.
    room = F.greatest(F.char_length("text") - chars, F.lit(0)) + 1
    sample = sample.select("lang", F.substr(F.col("text"), (F.pmod(F.xxhash64(F.lit("place"), "text"), room) + 1).cast("int"), F.lit(chars)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in common.slices(b, 1)):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(np.frombuffer(b" " * order + text.encode(), np.uint8), order))
            for lang, found in by.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    summed = sample.transform(common.in_arrow, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    langs = np.array(summed.column("lang").to_pylist(), dtype=object)
    gram, n = summed.column("gram").to_numpy().astype(np.uint64), summed.column("n").to_numpy()
    for lang in sorted(set(langs.tolist())):
        mine = langs == lang
        counts[lang] = (gram[mine], n[mine])
    return Model(counts, order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), (common.fold_remainder(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in common.slices(b, 2)):
            found = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return source.transform(common.in_arrow, score, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, train(docs))
