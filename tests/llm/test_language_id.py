import math
import zlib

import numpy as np
import pytest

from lodestone.llm import op04_language_id as op


def tree_of(text, order=op.ORDER):
    keys, n = np.unique(op.grams(np.frombuffer(op.PAD + text.encode(), np.uint8), order), return_counts=True)
    return op.Tree(keys, n, order)


def bits_by_hand(train, text, order=op.ORDER):
    """PPM-C with exclusion, symbol by symbol, from plain dicts."""
    data = b" " * order + train.encode()
    counts = {}
    for i in range(order, len(data)):
        for j in range(order + 1):
            counts.setdefault(data[i - j : i], {}).setdefault(data[i], 0)
            counts[data[i - j : i]][data[i]] += 1
    data, total = b" " * order + text.encode(), 0.0
    for i in range(order, len(data)):
        gone = set()
        for j in range(order, -1, -1):
            seen = counts.get(data[i - j : i])
            if seen is None:
                continue
            left = {s: n for s, n in seen.items() if s not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                total -= math.log2(left[data[i]] / whole)
                break
            total -= math.log2(len(left) / whole)
            gone |= set(seen)
        else:
            total += math.log2(256 - len(gone))
    return total


TRAIN = "the cat sat on the mat and the dog sat on the log; a cat is no dog."


@pytest.mark.parametrize("text", ["the cat", "dog on a mat zz", "\x00ÿ the", "", "q"])
def test_code_lengths_are_exact(text):
    tree = tree_of(TRAIN)
    keys = op.grams(np.frombuffer(op.PAD + text.encode(), np.uint8))
    assert tree.bits(keys).sum() == pytest.approx(bits_by_hand(TRAIN, text))


def test_codes_are_a_distribution():
    tree = tree_of(TRAIN)
    for ctx in (b"the", b" ca", b"\x01\x02\x03", b"ogs"):
        keys = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        assert np.exp2(-tree.bits(keys)).sum() == pytest.approx(1)


def test_tables_slices_and_batches_agree(monkeypatch):
    texts = ["the cat sat", "", "le chat est là", "x" * 50, "dog"] * 4
    counts = {n: np.unique(op.grams(np.frombuffer(op.PAD + t.encode(), np.uint8)), return_counts=True) for n, t in (("en", TRAIN), ("fr", "le chat est sur la table et le chien est là"))}
    model = op.Model(counts)
    one = np.stack([model.lengths([t.encode()])[0] for t in texts])
    assert np.allclose(model.lengths([t.encode() for t in texts]), one)
    monkeypatch.setattr(op, "SLICE", 7)
    assert np.allclose(model.lengths([t.encode() for t in texts]), one)
    assert one[0, 0] == pytest.approx(bits_by_hand(TRAIN, texts[0]))


def test_index_finds_all_and_only_known_keys():
    keys = np.unique(np.random.RandomState(1).randint(0, 1 << 32, 3000).astype(np.uint32))
    index = op.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(np.arange(5000, dtype=np.uint32), keys)
    assert (index.find(other) == -1).all() and len(index.find(other[:0])) == 0


def test_corpus(docs, corpus):
    got = op.identify(docs, op.train(docs)).collect()
    assert len(got) == len(corpus)
    by = {r.doc_id: r for r in got}
    for doc_id, text, lang, *_ in corpus:
        r = by[doc_id]
        assert r.held_out == (zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")
    held = [by[d] for d, *_ in corpus if d is not None and 130 <= d < 160 and by[d].held_out]
    assert all(r.lang_pred == ("en", "fr")[r.doc_id % 2] for r in held)


def test_nothing_to_learn_from(docs, empty, spark):
    assert {r.lang_pred for r in op.identify(docs, op.train(empty)).collect()} == {"und"}
    assert op.identify(empty, op.train(docs)).count() == 0
