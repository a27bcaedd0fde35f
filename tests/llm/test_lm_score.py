import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import op01_lm_score as op


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b" "]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


@pytest.mark.parametrize(("hot", "bits"), [(0, 1 << 30), (50, 1 << 30), (50, 0)])
def test_base_scores_are_exact(docs, corpus, monkeypatch, hot, bits):
    monkeypatch.setattr(op, "HOT_WORDS", hot)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in op.score(docs, broadcast_bits=bits).collect())
    counts = Counter()
    for doc_id, text, *_ in corpus:
        if not held(doc_id):
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for doc_id, text, *_ in corpus:
        own = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[doc_id, held(doc_id), len(own), sum(counts[w] > 0 for w in own), n, round(base, 4)] += 1
    assert got == want


def test_a_large_filter_gives_the_same_scores(docs):
    """Broadcast and probed where it lies."""
    by_broadcast, by_shards = (Counter((r.doc_id, r.n_tokens, r.base_score, r.score) for r in op.score(docs, broadcast_bits=bits).collect()) for bits in (1 << 30, 0))
    assert by_broadcast == by_shards and len({x[3] for x in by_shards}) > 50


def slow_level(model, key):
    """Probes of one n-gram, bit by bit."""
    size = 2**64
    step_1, step_2, by_level = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93

    def mixed(x):
        x = (x ^ (x >> 31)) * step_1 % size
        return x ^ (x >> 29)

    flags, q = model.filter.bytes_, 0
    while q < op.LEVELS:
        x = mixed((key + (q + 1) * by_level) % size)
        step = (x * step_2 % size) | 1
        for i in range(op.PROBES):
            at = (key >> (64 - model.segment_bits)) * model.width + ((((x + i * step) % size) >> 32) * model.width >> 32)
            if not flags[at // 8] >> (at % 8) & 1:
                return q
        q += 1
    return q


def by_hand(model, text, level_of):
    """A text's score, token by token."""
    total, last = 0.0, b" "
    count = lambda key: min(float(op.MIDDLE[level_of(key)]), model.n)
    for word in tokens(text):
        own, prior, pair = count((word,)), count((last,)), count((last, word))
        pair = min(pair, own, prior)
        p = min(1.0, (own + 0.1) / (model.n + 0.1 * (model.v + 1)))
        total += math.log10((pair + model.mu * p) / (prior + model.mu))
        last = word
    return total


def hashed(gram):
    hashes = op.Hashes().array(list(gram))
    return int(hashes[0] if len(gram) == 1 else op.pair_hash(hashes[:1], hashes[1:])[0])


def test_scores_are_those_of_a_slow_prober(docs, corpus):
    model, _ = op.train(docs)
    want = Counter((d, round(by_hand(model, t, lambda gram: slow_level(model, hashed(gram))), 4)) for d, t, *_ in corpus if len(t or "") < 1000)
    got = Counter((r.doc_id, round(r.score, 4)) for r in op.score(docs).collect())
    assert all(got[k] == n for k, n in want.items()) and len(want) > 100


@pytest.mark.parametrize("bits", [1 << 40, 0])
def test_scores_are_those_of_quantised_true_counts(docs, corpus, bits):
    """With a filter so wide that no probe is a false positive."""
    counts = Counter()
    for d, t, *_ in corpus:
        if not held(d):
            own = tokens(t)
            counts.update((w,) for w in own)
            counts.update(zip([b" ", *own[:-1]], own, strict=True))
    model, _ = op.train(docs, token_bits=400)
    singles, words = sum(n == 1 for g, n in counts.items() if len(g) == 2), [n for g, n in counts.items() if len(g) == 1]
    assert abs(sum(n * model.mu / (n + model.mu) for n in words) - singles) < 0.01 * singles
    level_of = lambda gram: int(op.level(np.array([float(counts[gram])]))[0]) if counts[gram] else 0
    want = Counter((d, round(by_hand(model, t, level_of), 4)) for d, t, *_ in corpus)
    got = Counter((r.doc_id, round(r.score, 4)) for r in op.score(docs, broadcast_bits=bits, token_bits=400).collect())
    assert got == want and all(s <= 0 for _, s in got)


def test_filter_never_underestimates():
    import pyarrow as pa

    rng = np.random.RandomState(1)
    keys = rng.randint(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(3)
    counts = rng.randint(1, 400, len(keys))
    width, segments = 4096, 12
    flags = bytearray((width << segments) // 8)
    at_ = op.segment(keys, segments)
    order = np.argsort(at_)
    rows = [(int(at_[i]), b"", keys[i : i + 1].tobytes(), np.array([counts[i]], np.uint32).tobytes()) for i in order]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)], ["segment", "once", "often", "times"])
    for out in op._segments(width)(iter([batch])):
        at = out.column(0)[0].as_py() * width // 8
        flags[at : at + width // 8] = out.column(1)[0].as_py()
    filter_ = op.Filter(flags, width, segments)
    found = filter_.levels(keys)
    want = op.level(counts.astype(float))
    assert (found >= want).all() and (found == want).mean() > 0.99
    strange = filter_.levels(rng.randint(0, 1 << 62, 20000).astype(np.uint64) * np.uint64(5) + np.uint64(1))
    assert (strange > 0).mean() < 0.02


def test_tokens_are_those_of_a_loop(corpus):
    import pyarrow as pa

    odd = [None, "", " ", "\n\t\x0b\x0c\r ", "a", " a", "a ", "A  b\x0bÉ\x1c\x85\xa0c", "", "b", None, "İI", "x\x00y \x00"]
    texts = pa.array([*odd, *(t for _, t, *_ in corpus), *odd], pa.string())
    for part in (texts, texts.slice(3, 20), texts.slice(0, 2), texts.slice(0, 0), texts.cast(pa.large_string())):
        found, want = op.Tokens(part), [tokens(t) for t in part.to_pylist()]
        words = found.listed()
        assert len(set(words)) == len(words) and words[-1] == b" "
        assert [words[c] for c in found.codes] == [w for x in want for w in x]
        assert list(found.sizes) == list(map(len, want)) and list(found.starts) == list(np.cumsum([0, *map(len, want)])[: len(want)])


def test_counting_and_preparing_cost_less_than_a_loop_over_tokens():
    """Work is by distinct word of a slice, not by token."""
    import random
    import time

    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 20_000}" for _ in range(500)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    whole = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([False] * 1000), pa.array(["m"] * 1000), pa.array(texts)], ["doc_id", "held_out", "text_md5", "text"])
    logs = {b"w%d" % i: 1.0 for i in range(1000)}

    def loop():
        counts = Counter()
        for t in texts:
            counts.update(tokens(t))

    def cost(run):
        out = []
        for _ in range(3):
            start = time.process_time()
            run()
            out.append(time.process_time() - start)
        return min(out)

    by_loop = cost(loop)
    assert cost(lambda: list(op._count_words(iter([batch])))) < 0.7 * by_loop
    assert cost(lambda: op._prepared(whole, logs)) < 1.2 * by_loop


@pytest.mark.parametrize("hot", [[], [b" "], [b"w1", b" ", b"w7", op.name(b"x" * 70)]])
def test_words_of_a_run_come_back(corpus, hot):
    """By places of hot words and names of cold ones."""
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus] + ["x" * 70, "y" * 100 + " w1", None, "w1 w1 w2"]
    for part in (texts, texts[::-1], [None], ["y" * 80]):
        n, logs = len(part), dict.fromkeys(hot, 1.0)
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([False] * n), pa.array([b"m"] * n), pa.array(part, pa.string())], ["doc_id", "held_out", "text_md5", "text"])
        prepared, found, hashed = op._prepared(batch, logs)
        words = op.Packed(logs)
        assert (words.unpack(words.pack(found, hashed), prepared.column(6)) == hashed).all()
        assert (op.from_planes(op.planes(hashed), np.uint64) == hashed).all()


def test_a_pair_is_probed_no_further_than_its_words():
    rng = np.random.RandomState(4)
    flags = rng.randint(0, 256, (2, 1 << 16)).astype(np.uint8)
    filter_ = op.Filter((flags[0] | flags[1]).tobytes() + b"\xff" * (1 << 16), 1 << 17, 3)
    keys = np.sort(rng.randint(0, 1 << 62, 100_000).astype(np.uint64) * np.uint64(4))
    most = rng.randint(0, 6, len(keys)).astype(np.uint8)
    levels = filter_.levels(keys)
    assert len(set(levels.tolist())) > 3 and (filter_.levels_up_to(keys, most) == np.minimum(levels, most)).all()


def test_long_words_by_name(spark):
    """A separator line in most texts is a word like others."""
    line = "=" * 500
    rows = [(i, f"a{i} {line} b") for i in range(200)]
    got = op.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    n = sum(4 for i, _ in rows if not held(i))
    assert all(r.train_tokens == n and r.n_known == (3 if r.held_out else 4) for r in got)


def test_levels_and_middles():
    c = np.arange(1, 2000)
    middle = op.MIDDLE[op.level(c.astype(float))]
    assert (np.abs(middle - c) <= 0.25 * c + 1e-9).all() and list(middle[:3]) == [1, 2, 3]


def test_pairs_add_to_words(spark):
    """Where word order carries information the model beats the base on held-out texts."""
    import random

    rng = random.Random(2)
    follow = {f"a{i}": [f"a{rng.randrange(60)}" for _ in range(3)] for i in range(60)}
    rows = []
    for i in range(300):
        w = [f"a{rng.randrange(60)}"]
        for _ in range(40):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    got = op.score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score + 0.3 * r.n_tokens for r in got)


def test_empty(empty):
    assert op.score(empty).collect() == []
