import random

import numpy as np
import pytest

from lodestone.llm import op05_sentencepiece as op

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pieces():
    return op.Pieces.load(op.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op.MODEL)


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], np.int32).tolist()


def test_same_as_the_library(pieces, library):
    rng = random.Random(1)
    alphabet = [*"abcdefghtheinong  ▁\n\t0123,.é中文日本語の🙂ßçÄ", "the", "ing", " and", "  ", "\n\n", " " * 17]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(1500)] + [" " * n for n in range(40)] + [" " * n + "the " * 3 for n in range(20)]
    encoder = op.Encoder(pieces)
    for t, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, np.int32).tolist() == library.encode(t), t
        if op.SPACE not in t:
            assert encoder.decode(library.encode(t)) == t


def test_long_texts_without_spaces(pieces, library):
    rng = random.Random(2)
    encoder = op.Encoder(pieces)
    for t in ("".join(rng.choice("abcdeintho") for _ in range(2000)), "aaaa" * 400, "的" * 300, "日本語" * 200):
        assert ids(encoder, t) == library.encode(t)


def test_compatible_is_what_merging_does(pieces):
    rng = random.Random(3)
    pick = [rng.choice(pieces.reached) for _ in range(4000)]
    a, b = np.array(pick[::2]), np.array(pick[1::2])
    got = pieces.compatible(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert g == (pieces.merge(pieces.pieces[x] + pieces.pieces[y]) == [x, y])


def test_cache_and_batches_do_not_matter(pieces, monkeypatch):
    texts = [f"word{i % 7} and other{i}" for i in range(200)]
    want = op.Encoder(pieces).encode(texts)
    monkeypatch.setattr(op, "CACHE", 5)
    monkeypatch.setattr(op, "INDEXED", 20)
    encoder = op.Encoder(pieces)
    assert [encoder.encode([t])[0] for t in texts] == want and encoder.encode(texts) == want


def test_corpus_round_trip(docs, corpus, pieces, library):
    rows = op.tokenize(docs, pieces).collect()
    texts = {d: t for d, t, *_ in corpus}
    assert len(rows) == len(corpus)
    for r in rows:
        t = texts[r.doc_id]
        if t is None:
            assert r.ids is None and r.n_ids is None and r.round_trip is None or not r.round_trip
        else:
            assert r.ids == library.encode(t) and r.n_ids == len(r.ids) and r.round_trip == (op.SPACE not in t)
    back = {r.doc_id: r.text for r in op.detokenize(op.tokenize(docs, pieces), pieces).collect()}
    assert all(back[d] == t for d, t in texts.items() if t is None or op.SPACE not in t)


def test_empty(empty, pieces):
    assert op.tokenize(empty, pieces).count() == 0
