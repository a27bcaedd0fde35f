import random

import numpy as np
import pytest

from lodestone.llm import op02_toxicity as op

from .conftest import prose

BAD = ["awful", "vileness", "nastier", "rotten"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(20, 120), 3000).split()
        toxic = i % 6 == 0
        for _ in range(rng.choice([2, 5, 12]) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_order(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in op.score(docs, op.train(docs, labels)).collect()}
    held = [got[i] for i in range(600, 900)]
    caught = [r.toxic for r in held if r.doc_id % 6 == 0]
    assert sum(caught) >= 0.9 * len(caught) and not any(r.toxic for r in held if r.doc_id % 6)
    texts = dict(docs.collect())
    count = lambda r: sum(texts[r.doc_id].split().count(b) for b in BAD)
    toxic = [r for r in held if r.doc_id % 6 == 0]
    few, many = [r.severity for r in toxic if count(r) <= 2], [r.severity for r in toxic if count(r) >= 8]
    assert np.mean(few) + 0.5 < np.mean(many) and all(0 <= r.severity <= op.GRADES for r in held)


def test_thresholds_are_ordered_and_shared(labelled):
    docs, labels = labelled
    model = op.train(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == op.GRADES
    p = model.at_least(np.linspace(-5, 20, 50))
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(p, axis=0) >= 0).all()


def test_filter_keeps_columns_and_rows(docs, labelled):
    model = op.train(*labelled)
    kept = op.without_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_odd_cases(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert op.score(docs, op.train(docs, none)).where("toxic").count() == 0
    one_class = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, 0, None), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert op.score(docs, op.train(docs, one_class)).count() == docs.count()
    assert op.score(empty, op.train(empty, one_class)).count() == 0
    ids = [(0, 1), (1, 0), (2, 0), (2, 1)]
    twice = spark.createDataFrame([(i, 1, t) for i, t in ids], "doc_id bigint, quality int, toxic int")
    assert op.score(docs, op.train(docs, twice)).count() == docs.count()


def test_best_cut_lies_in_a_gap():
    p, y = np.array([0.9, 0.8, 0.3, 0.2]), np.array([True, True, False, False])
    assert op.best_cut(p, y) == pytest.approx(0.55)


def test_scores_are_sums_over_distinct_words(docs, corpus):
    """Every row's numbers, word by word from the weights and thresholds."""
    import math
    import zlib

    model = op.Severity({zlib.crc32(b"w1"): 0.5, zlib.crc32(b"long"[:4], 1): 1.5, zlib.crc32(b"words"[:5], 2): 0.25}, [0.5, 1.0, 2.0], 0.6)
    got = sorted(((r.doc_id, round(r.score, 9), round(r.p_toxic, 9), round(r.severity, 9), r.grade, r.toxic) for r in op.score(docs, model).collect()), key=str)
    want = []
    for doc_id, text, *_ in corpus:
        letters = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower())
        z = 0.0
        for word in {w.encode() for w in letters.split(" ") if w}:
            z += model.weights.get(zlib.crc32(word), 0.0)
            if len(word) >= 4:
                z += model.weights.get(zlib.crc32(word[:4], 1), 0.0) + model.weights.get(zlib.crc32(word[:5], 2), 0.0)
        p = [1.0, *(1 / (1 + math.exp(t - z)) for t in model.thresholds), 0.0]
        exact = [p[k] - p[k + 1] for k in range(4)]
        want.append((doc_id, round(z, 9), round(p[1], 9), round(sum(k * x for k, x in enumerate(exact)), 9), exact.index(max(exact)), p[1] > 0.6))
    assert got == sorted(want, key=str)


def test_sample_is_bounded_by_characters(spark):
    docs = spark.createDataFrame([(i, ("awful " if i % 2 else "fine ") * 50 + f"x{i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    whole, part = op.train(docs, labels), op.train(docs, labels, total_chars=40_000)
    assert whole.weights and part.weights and part.thresholds != whole.thresholds
