import numpy as np
import pytest

from lodestone.llm import op09_multi_index as op


def by_hand(rows):
    ids, vectors = [], []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ids.append(i)
            vectors.append(np.array(v, float) / np.linalg.norm(np.array(v, float)))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = dict.fromkeys(parent, 0)
    if vectors:
        u = np.array(vectors)
        for a, b in zip(*np.nonzero(u @ u.T >= 0.95), strict=True):
            if ids[a] != ids[b]:
                n[ids[a]] += 1
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (n[i], root(i)) for i in parent}


def vectors(seed, singles=400, groups=30, hot=200, dim=16, spread=0.12):
    rng = np.random.RandomState(seed)
    rows = [v for v in rng.normal(size=(singles, dim))]
    for _ in range(groups):
        c = rng.normal(size=dim)
        rows += [c * rng.uniform(0.1, 9) + rng.normal(size=dim) * 0.0 for _ in range(1)] + [c + rng.normal(size=dim) * spread * np.linalg.norm(c) / np.sqrt(dim) for _ in range(rng.randint(1, 6))]
    c = rng.normal(size=dim)
    rows += [c + rng.normal(size=dim) * spread * np.linalg.norm(c) / np.sqrt(dim) for _ in range(hot)]
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in np.float32(rows[k])]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("seed", "spread", "hot"), [(1, 0.12, 200), (2, 0.25, 150), (3, 0.35, 60)])
def test_same_as_by_hand(spark, seed, spread, hot):
    """Tight groups are counted as balls; loose ones have members that link with some of a ball only."""
    rows = vectors(seed, hot=hot, spread=spread)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    want = by_hand(rows)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_chunks(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 16)
    monkeypatch.setattr(op, "BALLS", 0)
    rows = vectors(4, hot=120)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    want = by_hand(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_many_codewords(spark, monkeypatch):
    """A grid far finer than these rows ask for, counted and compared by small pieces."""
    monkeypatch.setattr(op, "codewords", lambda rows: 200)
    monkeypatch.setattr(op, "BIG_CELLS", 3)
    monkeypatch.setattr(op, "CHUNK", 4)
    monkeypatch.setattr(op, "BALLS", 0)
    rows = vectors(6, singles=900, hot=120)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    want = by_hand(rows)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values()) and all(got[i][0] <= want[i][0] for i in want)


def test_pieces():
    rng = np.random.RandomState(2)
    full = np.sort(rng.choice(70_000, 3000, replace=False))
    bits = {}
    for c in full:
        own = bits.setdefault(int(c) // op.BUCKET_BITS, bytearray(op.BUCKET_BITS // 8))
        own[c % op.BUCKET_BITS // 8] |= 1 << (c % 8)
    pieces = op.Pieces(70_000, bits, full[:10], np.arange(2, 12))
    want = np.zeros(70_000, int)
    want[full] = 1
    want[full[:10]] = np.arange(2, 12)
    assert (pieces[np.arange(70_000)] == want).all()


def test_codewords_grow_with_rows():
    assert [op.codewords(n) for n in (1, 128, 12_800, 1_280_000, 128_000_000)] == [1, 1, 10, 100, 1000]


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        op.near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_visits_come_in_order_and_start_at_home():
    x = np.random.RandomState(3).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = op.Index(x, 20_000)
    row, cell = index.visits(x)
    first = np.searchsorted(row, np.arange(len(x)))
    assert (cell[first] == index.home(x)).all() and index.visited_by(x[row], cell).all()


def test_odd_cases(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [
        (1, one), (2, [2.0, 0.0, 0.0, 0.0]), (3, None), (4, [0.0] * 4), (5, [float("nan"), 1.0, 0.0, 0.0]), (6, [None, 1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, one),
        (8, [1e30, 0.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.01, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS label", "'y' AS cell", "1 AS n")
    got = sorted((tuple(r) for r in op.near_duplicates(df).collect()), key=str)
    assert len(got) == len(rows)
    links = {r[0]: r[1:] for r in got}
    assert links[1] == (2, 1, True) and links[8] == (2, 1, False) and links[9] == (2, 9, True) and links[11] == (2, 9, False)
    assert all(links[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 10)) and links[None] == (0, None, False)
    assert [r for r in got if r[0] == 9] == [(9, 2, 9, True)] * 2
    assert op.near_duplicates(df.where("false")).count() == 0 and op.near_duplicates(df.where("vec_id = 3")).count() == 1
