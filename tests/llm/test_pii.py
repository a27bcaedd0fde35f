import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import op10_pii as op


def base_by_hand(text):
    out = [("email", *m.span()) for m in op._EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in op._CARD.finditer(text):
        d = [int(c) for c in m.group() if c in "0123456789"]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in op._PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


PARTS = st.sampled_from(["a", "b.c", "@", "x@y.z", " ", "-", ".", "+", "1", "42", "255", "256", "10.0.0.1", "4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485", "(", ")", "é", "٣", "\n", "_%", "@@", "00"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert op.base_spans(text) == base_by_hand(text)


@pytest.mark.parametrize("unit", ["1", "1.", "1 ", "12-", "@", "a@", "+1 ", "(1", "1.1.1.1 ", "123 456 7890 ", "4111111111111111,"])
def test_long_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.process_time()
    base, spans = op.find(text, op.SemiMarkov({"phone:bias": 0.1}))
    assert time.process_time() - start < 10 and set(base) <= set(spans)
    start = time.process_time()
    op.base_spans(text)
    assert time.process_time() - start < 2


def test_a_sample_holds_whatever_is_repeated(spark):
    """Null ids and repeated rows neither flood the sample nor empty it."""
    rows = [(None, f"text {i} mail a{i}@b.com") for i in range(2000)] + [(1, "same +1 (988) 555-2485")] * 2000
    got = op.common.hash_sample(spark.createDataFrame(rows, "doc_id bigint, text string"), 400, "doc_id", "text").count()
    assert 100 < got < 320


def test_marginals_and_decoding_match_enumeration():
    text = "a 1234 5678 9012 3456 b 12 34 56 78 90 c 555 666 7777"
    segments = op.candidates(text)[:10]
    model = op.SemiMarkov({f: w for s in segments for f, w in zip(op.features(text, *s), np.random.RandomState(4).normal(size=20), strict=False)})
    scores = [model.score(op.features(text, *s)) for s in segments]
    best, z, p = (-1e9, None), 0.0, np.zeros(len(segments))
    for mask in range(1 << len(segments)):
        chosen = [i for i in range(len(segments)) if mask >> i & 1]
        spans = sorted((segments[i][1], segments[i][2]) for i in chosen)
        if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
            total = sum(scores[i] for i in chosen)
            z += np.exp(total)
            p[chosen] += np.exp(total)
            best = max(best, (total, chosen))
    log_z, posterior = model.marginals(scores, segments)
    assert log_z == pytest.approx(np.log(z)) and np.allclose(posterior, p / z)
    assert sum(model.score(op.features(text, *s)) for s in model.decode(text, segments)) == pytest.approx(best[0])


@pytest.fixture(scope="module")
def model():
    m = op.SemiMarkov()
    texts = [f"write to user{i}.x@mail{i}.example.com now or call +1 (988) 555-{1000 + i} or pay 4111111111111111 from 10.0.{i}.1 ok. Meet at noon. The rest 1{i} 20 30" for i in range(60)]
    m.fit([x for t in texts for x in op.examples_of(t)])
    return m


def test_method_adds_spans(model):
    for text, kind in (("mail joe.b at example dot com today", "email"), ("call 0044 20 7946 0958 now", "phone"), ("card 4111/1111/1111/1111 ok", "card"), ("host 10[.]0[.]0[.]1 is", "ip")):
        base, spans = op.find(text, model)
        assert not base and [k for k, _, _ in spans] == [kind], text
    for text in ("we met at noon. The end", "in 1999 and 2001", "look at this. And that"):
        assert op.find(text, model) == ([], [])


def test_base_spans_stay_and_nothing_overlaps(model):
    text = "x@y.zz, +1 (988) 555-2485, 4111111111111111, 10.0.0.1 and 4111/1111/1111/1111"
    base, spans = op.find(text, model)
    assert set(base) <= set(spans) and len(spans) == len(base) + 1
    added = [s for s in spans if s not in base]
    assert all(a[2] <= b[1] or a[1] >= b[2] for a in added for b in base)


def test_corpus(docs, corpus, spark, empty, model):
    rows = op.detect(docs, model).collect()
    assert len(rows) == len(corpus)
    texts = {d: t for d, t, *_ in corpus}
    for r in rows:
        base = base_by_hand(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert op.detect(empty, op.train(empty)).count() == 0
    assert op.detect(docs, op.train(docs)).count() == len(corpus)
