"""Toxicity as a severity grade by cumulative-link (proportional-odds) ordinal regression.

Grades run from 0 (clean) to 3. One weight vector over sparse text features is shared by all grades; ordered thresholds
t1 < t2 < t3 cut its value: P(grade >= k) = sigmoid(w.x - tk). The expected severity is the sum of these. A text is toxic
where P(grade >= 1) exceeds the value that parts toxic from other training texts with the best F1.

Features are a text's distinct words and, among those, the counts of first four and five bytes, hashed to 32 bits; a word's share
of w.x is then one number, and a text's score a sum over its distinct words. Labels say only toxic or not. A toxic training text's grade comes from how many of
its words are marked, that is, carry a feature far more frequent in toxic than in other training texts: the thirds of
that count among toxic texts are grades 1, 2 and 3.

Training uses a bounded sample: about :data:`SAMPLE_ROWS` labelled rows by hash of id, fewer if their texts have more than :data:`SAMPLE_TOTAL`
characters in all, with texts of at most :data:`SAMPLE_CHARS` characters, gathered as hashed counts. Weights are fitted by proximal gradient steps with an L1 penalty and are not negative, so that
words without a bearing get none, long clean texts gather no score and clean words cannot outweigh toxic ones.

Cases. Null or empty text: no features, the score of an empty text. Null label: not learned from. Null id: matches no label.
Several labels of an id: the most toxic. Repeated rows: one result each. Very long texts: whole. No label, or one class only:
nothing is toxic. Empty table: empty result. Other columns are not read; the filter keeps them as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

#: Bounds of the sample of labelled rows that the weights are fitted on: rows, characters of a text and of all texts.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TOTAL = 12_000, 50_000, 64_000_000
GRADES = 3
#: Features in fewer training texts than this, or than a seventh of the root of their number, are left out: what a few copies share says nothing.
LEAST_TEXTS = 4
L1, STEPS, RATE = 5e-6, 300, 1.0
#: Log odds below which a feature is left out.
LEAST_ODDS = 1.0
#: A feature is marked if its log odds of toxic against other texts exceed this.
MARK = 3.0
_CACHE = 400_000
_LETTERS = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_LETTERS).split()


def features_of(word: bytes) -> tuple[int, ...]:
    if len(word) < 4:
        return (zlib.crc32(word),)
    return zlib.crc32(word), zlib.crc32(word[:4], 1), zlib.crc32(word[:5], 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Severity:
    """Weights by hashed feature, and the thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float], reject: float = 1.0) -> None:
        self.weights, self.thresholds, self.reject = weights, thresholds, reject

    def scorer(self) -> "_WordScores":
        return _WordScores(self.weights)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        if not self.thresholds:
            return np.zeros((len(score), GRADES))
        return _sigmoid(score[:, None] - np.array(self.thresholds)[None, :])


class _WordScores(dict):
    """A word's share of w.x; forgets all when it has grown large."""

    def __init__(self, weights: dict[int, float]) -> None:
        super().__init__()
        self._weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= _CACHE:
            self.clear()
        get = self._weights.get
        self[word] = value = sum(get(f, 0.0) for f in features_of(word))
        return value

    def text(self, text: str | None) -> float:
        return float(sum(map(self.__getitem__, set(words(text)))))


def grade(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, log_odds: dict[int, float]) -> np.ndarray:
    """0 for clean texts, 1 to GRADES for toxic ones by thirds of their marked words."""
    marked = np.array([sum(int(c) for f, c in zip(fs.tolist(), cs.tolist(), strict=True) if log_odds.get(f, 0.0) > MARK) for fs, cs in rows], float)
    cuts = np.quantile(marked[toxic], [k / GRADES for k in range(1, GRADES)]) if toxic.any() else []
    return np.where(toxic, 1 + np.searchsorted(cuts, marked, side="left"), 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> Severity:
    """rows: hashed features and their counts by text."""
    if not len(toxic) or toxic.all() or not toxic.any():
        return Severity({}, [])
    # A text names a feature once, so these are counts of texts; only features of toxic texts can get a weight.
    found, with_toxic = np.unique(np.concatenate([fs for (fs, _), y in zip(rows, toxic, strict=True) if y]), return_counts=True)
    with_clean = np.zeros(len(found), np.int64)
    for (fs, _), y in zip(rows, toxic, strict=True):
        if not y and len(found):
            at = np.minimum(np.searchsorted(found, fs), len(found) - 1)
            with_clean[at[found[at] == fs]] += 1
    n = [int((~toxic).sum()), int(toxic.sum())]
    least = max(LEAST_TEXTS, round(len(rows) ** 0.5 / 7))
    odds = np.log((with_toxic + 0.5) / (n[1] + 1)) - np.log((with_clean + 0.5) / (n[0] + 1))
    # With weights of one sign, features hardly more frequent in toxic texts would get none.
    kept = (odds > LEAST_ODDS) & (with_clean + with_toxic >= least)
    log_odds = dict(zip(found[kept].tolist(), odds[kept].tolist(), strict=True))
    used = sorted(log_odds)
    y = grade(rows, toxic, log_odds)
    names = np.array(used, np.uint32)
    feature, count, start = [], [], [0]
    for fs, cs in rows:
        at = np.minimum(np.searchsorted(names, fs), len(names) - 1) if len(names) else np.zeros(len(fs), int)
        keep = names[at] == fs if len(names) else np.zeros(len(fs), bool)
        feature.append(at[keep])
        count.append(cs[keep].astype(float))
        start.append(start[-1] + int(keep.sum()))
    feature, count = np.concatenate(feature), np.concatenate(count)
    of = np.repeat(np.arange(len(rows)), np.diff(start))
    w, theta = np.zeros(len(names)), np.linspace(2.0, 4.0, GRADES)
    seen_w, seen_t = np.full(len(names), 1e-8), np.full(GRADES, 1e-8)
    one, none, each = np.ones((len(rows), 1)), np.zeros((len(rows), 1)), np.arange(len(y))
    for _ in range(STEPS):
        z = np.bincount(of, w[feature] * count, len(rows))
        inner = _sigmoid(z[:, None] - theta)
        p = np.hstack([one, inner, none])
        upper, lower = p[each, y], p[each, y + 1]
        mass = np.maximum(upper - lower, 1e-12)
        # The likelihood of a grade is upper - lower; sigmoid' = s (1 - s).
        g = 1 - upper - lower
        grad = np.bincount(feature, g[of] * count, len(names)) / len(rows)
        seen_w += grad * grad
        rate = RATE / np.sqrt(seen_w)
        w = np.maximum(0.0, w + rate * (grad - L1))
        slope = inner * (1 - inner) / mass[:, None]
        own = (slope * (y[:, None] == np.arange(GRADES)) - slope * (y[:, None] == np.arange(1, GRADES + 1))).mean(axis=0)
        seen_t += own * own
        theta = np.maximum.accumulate(theta + RATE * own / np.sqrt(seen_t) + np.arange(GRADES) * 1e-9)
    kept = np.flatnonzero(w)
    out = Severity(dict(zip(names[kept].tolist(), w[kept].tolist(), strict=True)), theta.tolist())
    out.reject = best_cut(out.at_least(np.bincount(of, w[feature] * count, len(rows)))[:, 0], toxic)
    return out


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap that it lies in."""
    order = np.argsort(-p, kind="stable")
    caught = np.cumsum(toxic[order])
    f1 = 2 * caught / (np.arange(1, len(p) + 1) + toxic.sum())
    # A cut can only lie between different values.
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    at = int(f1.argmax())
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(p) else 0.0)) / 2)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, total_chars: int = SAMPLE_TOTAL
) -> Severity:
    """Fits on about ``rows`` labelled rows; the same rows give the same model."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic")
    total = marks.count()
    if not total:
        return Severity({}, [])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def chosen(limit: int) -> DataFrame:
        own = marks.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) < limit)
        own = own.groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).withColumnRenamed("doc_id", "__label_id")
        # At most about SAMPLE_ROWS rows of 12 bytes: a fixed bound.
        joined = texts.join(F.broadcast(own), F.col("id") == F.col("__label_id")).where(F.coalesce(F.char_length("text"), F.lit(0)) <= chars)
        return joined.select(F.col("id").cast("string"), "text", F.col("__toxic").cast("int")).dropDuplicates()

    limit = min(1 << 40, (rows << 40) // total)
    found = chosen(limit).agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    if found > total_chars:
        limit = limit * total_chars // found
    joined = chosen(limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in common.slices(b, 1)):
            out = []
            for text in batch.column(1).to_pylist():
                found: Counter = Counter()
                for word in set(words(text)):
                    found.update(features_of(word))
                keys = np.array(sorted(found), np.uint32)
                out.append((keys.tobytes(), np.array([found[k] for k in keys.tolist()], np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["id", "toxic", "features", "counts"]
            )

    got = joined.transform(common.in_arrow, count, "id string, toxic int, features binary, counts binary").toArrow().sort_by([("id", "ascending"), ("features", "ascending")])
    # Views of the gathered table, not copies.
    columns = ([np.frombuffer(x.as_buffer(), np.uint32) for x in got.column(name)] for name in ("features", "counts"))
    model = fit(list(zip(*columns, strict=True)), np.array(got.column("toxic").to_pylist(), int) > 0)
    del got, columns
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, p_toxic, severity (0 to 3), grade and toxic for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.scorer()
        for batch in (x for b in batches for x in common.slices(b, 1)):
            z = np.array([own.text(t) for t in batch.column(1).to_pylist()], float)
            p = shared.value.at_least(z)
            exact = -np.diff(np.hstack([np.ones((len(z), 1)), p, np.zeros((len(z), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(z), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(exact.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] > shared.value.reject)],
                ["doc_id", "score", "p_toxic", "severity", "grade", "toxic"],
            )

    return source.transform(common.in_arrow, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, p_toxic double, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Severity, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.scorer()
        for batch in (x for b in batches for x in common.slices(b, at)):
            z = np.array([own.text(t) for t in batch.column(at).to_pylist()], float)
            yield batch.filter(pa.array(shared.value.at_least(z)[:, 0] <= shared.value.reject))

    return docs.transform(common.in_arrow, run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
