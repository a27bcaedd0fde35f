import random
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import op08_minhash_forest as op
from lodestone.llm.components import connected

from .conftest import prose


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def by_hand(rows, k, per_cent):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(d for d in sets if sets[d])
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("k", "per_cent"), [(3, 85), (5, 80)])
def test_corpus(docs, corpus, k, per_cent):
    got = op.near_duplicates(docs, k, per_cent).collect()
    assert len(got) == len(corpus)
    want = by_hand([(d, t) for d, t, *_ in corpus if d is not None], k, per_cent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id), r


def test_large_group_of_near_copies(spark, monkeypatch):
    """Regions beyond the size that is compared as a whole are parted and windowed."""
    monkeypatch.setattr(op, "REGION", 32)
    rng = random.Random(9)
    base, rows = prose(rng, 200, 5000).split(), []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(i, prose(rng, 100, 5000)) for i in range(400, 600)]
    got = {r.doc_id: r.component_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == {d: c for d, (_, c) in by_hand(rows, 3, 85).items()}


def test_filter(docs):
    kept = op.keep_first(docs, 3, 85)
    want = op.near_duplicates(docs, 3, 85).where("kept").count()
    assert kept.schema == docs.schema and kept.count() == want


def test_ids_shared_by_different_texts(spark):
    """Each row links by its own text; of each component one row stays."""
    rng = random.Random(8)
    a, b, c = (prose(rng, 100, 100_000).split() for _ in range(3))
    near = lambda w: " ".join(edited(rng, w, [50]))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (4, " ".join(c)), (5, ""), (5, None), (None, " ".join(a)), (None, "alone"), (6, near(c)), (6, "only six")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in op.near_duplicates(docs, 3, 85).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (5, 5), (6, 4), (6, 6)]
    kept = sorted(((r.doc_id or 0, r.text) for r in op.keep_first(docs, 3, 85, repeats=False).collect()), key=str)
    assert op.keep_first(docs, 3, 85).count() == len(kept) + 1
    assert kept == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, " ".join(c)), (5, ""), (5, None), (0, " ".join(a)), (0, "alone"), (6, "only six")], key=str)


def test_text_ids_and_clashing_columns(spark):
    rng = random.Random(8)
    a = prose(rng, 100, 100_000).split()
    rows = [(f"d{i}", " ".join(edited(rng, a, [9 * i])), {"k": i}) for i in range(4)] + [("d3", "other words here", {"k": 9})] * 2 + [("z", "alone", None)]
    docs = spark.createDataFrame(rows, "lost_id string, digest string, keep_id map<string,int>").withColumnsRenamed({"lost_id": "id", "digest": "t"})
    docs = docs.selectExpr("id", "t", "keep_id", "1 AS lost_id", "2 AS digest", "3 AS keep_digest", "4 AS row", "5 AS node", "6 AS component")
    got = {(r.doc_id, r.component_id) for r in op.near_duplicates(docs, 3, 85, "id", "t").collect()}
    assert got == {("d0", "d0"), ("d1", "d0"), ("d2", "d0"), ("d3", "d0"), ("d3", "d3"), ("z", "z")}
    kept = op.keep_first(docs, 3, 85, "id", "t", repeats=False)
    assert kept.columns == docs.columns and sorted((r.id, r.keep_id["k"] if r.keep_id else None, r.row) for r in kept.collect()) == [("d0", 0, 4), ("d3", 9, 4), ("z", None, 4)]


def test_groups_of_edited_copies(spark):
    """Ten groups of 500 near copies of a text with 2 to 8 edits each, many of them about the threshold."""
    want, rows = {}, []
    for seed in range(1, 11):
        rng = random.Random(seed)
        base, own = prose(rng, 200, 5000).split(), []
        for i in range(500):
            w = list(base)
            for _ in range(rng.randint(2, 8)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
            own.append((1000 * seed + i, " ".join(w)))
        want.update({d: c for d, (_, c) in by_hand(own, 3, 85).items()})
        rows += own
    got = {r.doc_id: r.component_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == want


def test_sets_do_not_depend_on_the_batch():
    texts = ["a b c d", "", None, "x", "A b C d e f", "a b", "b a"]
    together, n = op.shingle_sets(texts, 3, op.Hashes())
    apart = [op.shingle_sets([t], 3, op.Hashes()) for t in texts]
    assert n.tolist() == [2, 0, 0, 1, 4, 1, 1] and np.array_equal(together, np.concatenate([a for a, _ in apart]))
    assert apart[5][0] != apart[6][0]


def test_empty(empty):
    assert op.near_duplicates(empty).count() == 0 and op.keep_first(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(500, x) for x in range(501, 540)] + [(7, 7)]
    rng.shuffle(edges)
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.label for r in connected(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()}
    assert got == want


def edited(rng, words, at):
    """The words with new ones at these places."""
    out = list(words)
    for k in at:
        out[k] = f"new{rng.randrange(10**9)}"
    return out


def test_one_link_among_many_near_misses(spark):
    """Two components of 30 joined by one pair of 0.851; the other 899 pairs have 0.834 or 0.817."""
    rng, rows = random.Random(3), []
    for _ in range(4):
        left = prose(rng, 300, 100_000).split()
        right = edited(rng, left, range(10, 250, 30))
        for side, at in ((left, 5), (right, 6)):
            texts = [side, *(edited(rng, side, [at + 9 * k]) for k in range(29))]
            rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    want = {d: c for d, (_, c) in by_hand(rows, 3, 85).items()}
    assert len(set(want.values())) == 4 and got == want


def test_large_region_with_links_at_the_threshold(spark, monkeypatch):
    """Texts of one region that link with one other each, at 0.851, far from each other in every order."""
    monkeypatch.setattr(op, "REGION", 8)
    monkeypatch.setattr(op, "BLOCK", 32, raising=False)
    rng, rows = random.Random(4), []
    base = prose(rng, 300, 100_000).split()
    for _ in range(100):
        own = edited(rng, base, rng.sample(range(0, 297, 3), 6))
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((own, edited(rng, own, range(11, 299, 38))))]
    got = {r.doc_id: r.component_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    want = {d: c for d, (_, c) in by_hand(rows, 3, 85).items()}
    assert len(set(want.values())) == 100 and got == want
