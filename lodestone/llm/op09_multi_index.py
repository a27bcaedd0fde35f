"""Embedding near-dedup by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the product of the two is a grid of cells, and a vector lies in the cell of
its halves' nearest codewords. A query's cells come in multi-sequence order: by the sum, over the halves, of the squared least displacement
that would carry the half over into the codeword's region. It visits cells up to a radius set for the target recall,
and the vectors found there are verified by cosine in double precision. The radius is the larger of two quantiles at :data:`TARGET`:
over links that a bounded set of probe vectors has in the whole table, and over random displacements to the least linked cosine.

Dense groups would make the pairs grow with their squares. Balls take them out: a bounded sample gives at most :data:`BALLS` leaders, and
vectors within half the linking angle of a leader are all linked with each other, by the triangle inequality. Balls are
counted, not paired. Against another ball or vector, the angle to the leader and the ball's radius say that all its members link, or none;
only where they don't are members compared, with the ball as a cell of its own. Cells and their visitors are cut into
chunks of :data:`CHUNK` by hash, and each (chunk, chunk) is a group of bounded size.

Codewords number as the root of the rows over :data:`CELL`, up to :data:`CODEWORDS`, and their sample grows with them, up to :data:`SAMPLE_VALUES`.
Of the cells, workers get one bit each, whether it holds a vector, and the counts of those alone that need more than one chunk (:data:`BIG_CELLS` at most;
with more of them chunks are larger). Codebooks, leaders and probes come from bounded samples; every vector is indexed and every vector queries.

Cases. Null, zero and non-finite vectors, vectors with a null component, and those of another length than most have: no links. Null id: no links, null
component. Ids that are no whole numbers: an error before anything runs. Repeated rows of an id: never linked with each other; their links are added up, and each row shows the sum.
Ties of cosine with the threshold count as links. Empty table: empty result. Other columns (labels) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common
from lodestone.llm.components import connected

COSINE = 0.95
#: Sampled rows at least and by codeword, and sampled numbers at most (128 MB).
SAMPLE_ROWS, CODEWORD_ROWS, SAMPLE_VALUES = 16_384, 32, 16 << 20
#: Mean vectors a cell, codewords of a half at most, vectors of a chunk, and cells of several chunks at most.
CELL, CODEWORDS, CHUNK, BIG_CELLS = 128, 2048, 2048, 1 << 20
#: Distances to codewords held at a time, and cells counted before counts are sent.
DISTANCES, COUNTED = 2 << 20, 1 << 20
BALLS, BALL_SAMPLE, BALL_SHARE = 256, 4096, 0.002
PROBES, TARGET = 512, 0.999
#: Angles are compared with this margin, far above what arccos loses and far below any that matters.
MARGIN = 1e-6
_BINS = 4096


def units(batch: pa.RecordBatch, ids: int, vectors: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch whose vectors can link, and their unit vectors in double precision."""
    column = batch.column(vectors)
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(ids).is_valid().to_numpy(zero_copy_only=False) & (sizes == dim)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    # flatten() leaves out what lies under null rows.
    counted = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    starts = np.cumsum(counted) - counted
    rows = np.flatnonzero(valid)
    x = values[starts[rows][:, None] + np.arange(dim)[None, :]] if len(rows) and dim else np.zeros((0, dim))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    rows, x = rows[good], x[good]
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords of the rows; the same rows in the same order give the same."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    step = max(1, DISTANCES // max(len(centres), 1))
    for _ in range(rounds):
        square = (centres * centres).sum(axis=1) / 2
        near = np.concatenate([(x[lo : lo + step] @ centres.T - square).argmax(axis=1) for lo in range(0, len(x), step)])
        n = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            centres[:, d] = np.where(n > 0, np.bincount(near, x[:, d], len(centres)) / np.maximum(n, 1), centres[:, d])
    return centres


class Half:
    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        self.square = (centres * centres).sum(axis=1)
        gap = np.sqrt(np.maximum(self.square[:, None] + self.square[None, :] - 2 * centres @ centres.T, 0))
        self.gap = np.where(gap > 1e-12, 2 * gap, np.inf).astype(np.float32)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword, and for each codeword the squared least displacement into its region."""
        far = self.square[None, :] - 2 * x @ self.centres.T
        near = far.argmin(axis=1)
        least = far[np.arange(len(x)), near]
        bound = (far - least[:, None]) / self.gap[near]
        return near, bound * bound


def codewords(rows: int) -> int:
    """Codewords of a half for so many vectors."""
    return int(np.clip(np.ceil(np.sqrt(rows / CELL)), 1, CODEWORDS))


class Pieces:
    """Into how many chunks a cell's vectors, or its queries, are cut: none for an empty cell, one for most."""

    def __init__(self, cells: int, bits: dict[int, bytes], big: np.ndarray, times: np.ndarray) -> None:
        flags = bytearray(-(-cells // BUCKET_BITS) * (BUCKET_BITS // 8))
        for bucket, own in bits.items():
            flags[bucket * (BUCKET_BITS // 8) : (bucket + 1) * (BUCKET_BITS // 8)] = own
        self.flags, (self.big, self.times) = bytes(flags), (big, times)

    def __getitem__(self, cell: np.ndarray) -> np.ndarray:
        cell = np.asarray(cell, np.int64)
        out = ((np.frombuffer(self.flags, np.uint8)[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(np.int64)
        if len(self.big):
            at = np.minimum(np.searchsorted(self.big, cell), len(self.big) - 1)
            out = np.where(self.big[at] == cell, self.times[at], out)
        return out


#: Bits of a bitmap of Spark's ``bitmap_construct_agg``.
BUCKET_BITS = 32_768


class Index:
    """Codebooks, radius and balls: what is broadcast."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float = COSINE) -> None:
        self.cosine, self.dim = cosine, sample.shape[1]
        self.cut = self.dim // 2
        k = min(codewords(rows), max(1, len(sample) // 4))
        self.halves = [Half(k_means(sample[:, : self.cut], k)), Half(k_means(sample[:, self.cut :], k))]
        self.sizes = [len(h.centres) for h in self.halves]
        self.cells = self.sizes[0] * self.sizes[1]
        self.angle = float(np.arccos(cosine))
        self.leaders = self._leaders(sample[:BALL_SAMPLE])
        self.radius = self._displaced(sample)
        self.ball_size = self.ball_angle = self.ball_first = self.ball_all = np.zeros(0)
        self.homes = self.queries = None

    def _leaders(self, x: np.ndarray) -> np.ndarray:
        near = x @ x.T >= np.cos(self.angle / 2 - MARGIN)
        least, out = max(8, int(BALL_SHARE * len(x))), []
        count = near.sum(axis=1)
        while len(out) < BALLS and len(x) and count.max() >= least:
            best = int(count.argmax())
            out.append(x[best])
            gone = near[best].copy()
            count -= near[:, gone].sum(axis=1)
            near[:, gone] = False
        return np.array(out) if out else np.zeros((0, self.dim))

    def _displaced(self, sample: np.ndarray) -> float:
        rng = np.random.RandomState(7)
        x = sample[:4096]
        if not len(x):
            return 0.0
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-300)
        y = self.cosine * x + np.sqrt(1 - self.cosine**2) * noise
        return float(np.quantile(self.between(x, y), TARGET))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The radius at which one of two vectors visits the other's cell."""
        (a, p), (b, q) = self._bounds(x), self._bounds(y)
        at = np.arange(len(x))
        return np.minimum(p[0][at, b[0]] + p[1][at, b[1]], q[0][at, a[0]] + q[1][at, a[1]])

    def _bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        (a, p), (b, q) = self.halves[0].bounds(x[:, : self.cut]), self.halves[1].bounds(x[:, self.cut :])
        return [a, b], [p, q]

    def home(self, x: np.ndarray) -> np.ndarray:
        near, _ = self._bounds(x)
        return near[0] * self.sizes[1] + near[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits, for each row in multi-sequence order."""
        _, (p, q) = self._bounds(x)
        row, i = np.nonzero(p <= self.radius)
        of, j = np.nonzero(q <= self.radius)
        n = np.bincount(of, minlength=len(x))
        begin = np.cumsum(n) - n
        times = n[row]
        r, i = np.repeat(row, times), np.repeat(i, times)
        j = j[np.repeat(begin[row] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        total = p[r, i] + q[r, j]
        keep = total <= self.radius
        r, i, j, total = r[keep], i[keep], j[keep], total[keep]
        order = np.lexsort((total, r))
        return r[order], (i * self.sizes[1] + j)[order]

    def visited_by(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether each row visits its cell."""
        _, (p, q) = self._bounds(x)
        at = np.arange(len(x))
        return p[at, cell // self.sizes[1]] + q[at, cell % self.sizes[1]] <= self.radius

    def balls(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's ball or -1, and its angles to all leaders."""
        if not len(self.leaders):
            return np.full(len(x), -1), np.zeros((len(x), 0))
        angles = np.arccos(np.clip(x @ self.leaders.T, -1, 1))
        best = angles.argmin(axis=1)
        return np.where(angles[np.arange(len(x)), best] <= self.angle / 2 - MARGIN, best, -1), angles

    def relations(self, ball: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, ball) tables: all members link; it depends on the member. Of two balls the lower-numbered one's members ask."""
        if not len(self.leaders):
            return np.zeros(angles.shape, bool), np.zeros(angles.shape, bool)
        asks = (ball[:, None] < np.arange(len(self.leaders))[None, :]) & (self.ball_size > 0)[None, :]
        every = asks & (angles + self.ball_angle[None, :] <= self.angle - MARGIN)
        some = asks & ~every & (angles - self.ball_angle[None, :] <= self.angle + MARGIN)
        return every, some


OUT = "vec_id long, n long, next long, rows long"


def _out(ids: np.ndarray, n: np.ndarray | int = 0, other: np.ndarray | None = None, rows: int = 0) -> pa.RecordBatch:
    k = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.broadcast_to(np.asarray(n, np.int64), k)), pa.nulls(k, pa.int64()) if other is None else pa.array(other.astype(np.int64)), pa.array(np.full(k, rows, np.int64))],
        ["vec_id", "n", "next", "rows"],
    )


def forest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest id among those it is joined with, directly or not."""
    label = ids.copy()
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    return label


def verify(index: Index, cell: int, role: np.ndarray, ids: np.ndarray, home: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Counts and joins of one group. role: bit 1 home, bit 2 query."""
    h, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    counts, pi, pj = np.zeros(len(ids), np.int64), [], []
    for lo in range(0, len(q), 512):
        a, b = np.nonzero(x[q[lo : lo + 512]] @ x[h].T >= index.cosine)
        a, b = q[lo + a], h[b]
        other = ids[a] != ids[b]
        a, b = a[other], b[other]
        counts += np.bincount(a, minlength=len(ids))
        # The found one counts the link itself where it visits the query's cell.
        if cell >= index.cells:
            alone = np.ones(len(a), bool)
        else:
            alone = home[a] != home[b]
            at = np.flatnonzero(alone)
            alone[at] = ~index.visited_by(x[b[at]], home[a[at]])
        counts += np.bincount(b[alone], minlength=len(ids))
        pi.append(a)
        pj.append(b)
    i, j = (np.concatenate(p) if p else np.zeros(0, int) for p in (pi, pj))
    # A vector may be here twice, as home and as query.
    names, at = np.unique(ids, return_inverse=True)
    label = forest(len(names), at[i], at[j], names)
    counts = np.bincount(at, counts, len(names)).astype(np.int64)
    keep = (counts > 0) | (label != names)
    return _out(names[keep], counts[keep], label[keep])


def near_duplicates(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    source = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    lengths = source.where("vector IS NOT NULL").groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    rows, dim = (lengths[0]["n"], lengths[0]["dim"]) if lengths else (0, 0)
    limit = min(max(SAMPLE_ROWS, CODEWORD_ROWS * codewords(rows)), SAMPLE_VALUES // max(dim, 1))
    share = min(1 << 40, (limit << 40) // max(rows, 1))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = units(batch, 0, 1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "unit"])

    picked = source.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < share).transform(common.in_arrow, clean, "vec_id long, unit binary").toArrow().sort_by("vec_id")
    sample = np.frombuffer(b"".join(picked.column("unit").to_pylist()), np.float64).reshape(-1, dim) if picked.num_rows else np.zeros((0, dim))
    # In the order of ids, but not of a kind: rows of neighbouring ids may be alike.
    sample = sample[np.random.RandomState(11).permutation(len(sample))]
    if not len(sample):
        return source.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    index = Index(sample, rows, cosine)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Batch, places and ids of the vectors that can link, and their unit vectors; so many rows that their distances to codewords fit."""
        step = max(64, DISTANCES // (2 * max(index.sizes)))
        for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            own, x = units(batch, 0, 1, dim)
            yield batch, own, batch.column(0).take(pa.array(own)).to_numpy(zero_copy_only=False), x

    # 1. The balls' sizes, radii and first ids.
    if len(index.leaders):
        shared = spark.sparkContext.broadcast(index)

        def by_ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, ids, x in vectors(batches):
                ball, angles = shared.value.balls(x)
                at = np.flatnonzero(ball >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ball[at].astype(np.int64)), pa.array(angles[at, ball[at]]), pa.array(ids[at])], ["ball", "angle", "vec_id"])

        stats = source.transform(common.in_arrow, by_ball, "ball long, angle double, vec_id long").groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.min("vec_id").alias("first"))
        index.ball_size, index.ball_angle, index.ball_first = (np.zeros(len(index.leaders), t) for t in (np.int64, float, np.int64))
        for r in stats.collect():
            index.ball_size[r["ball"]], index.ball_angle[r["ball"]], index.ball_first[r["ball"]] = r["n"], r["angle"], r["first"]
    # 2. The radius, by the links of probes outside balls with all rows.
    probes = sample[index.balls(sample)[0] < 0][:PROBES]
    if len(probes):
        shared_2 = spark.sparkContext.broadcast((index, probes))

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, probe = shared_2.value
            seen = np.zeros(_BINS + 1, np.int64)
            for _, _, _, x in vectors(batches):
                a, b = np.nonzero(x @ probe.T >= own.cosine)
                # A probe meets itself, too; that is no displacement at all.
                other = (x[a] != probe[b]).any(axis=1)
                bins = np.ceil(own.between(x[a[other]], probe[b[other]]) / (2 - 2 * own.cosine) * _BINS).astype(int) if other.any() else np.zeros(0, int)
                seen += np.bincount(np.minimum(bins, _BINS), minlength=_BINS + 1)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bin", "n"])

        bins = sorted((r["bin"], r["n"]) for r in source.transform(common.in_arrow, probed, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect())
        total, run = sum(n for _, n in bins), 0
        for b, n in bins:
            run += n
            if run >= TARGET * total:
                index.radius = max(index.radius, b / _BINS * (2 - 2 * cosine))
                break
    # 3. Homes and queries of each cell (balls follow the cells), and how many vectors link with all of a ball.
    shared_3 = spark.sparkContext.broadcast(index)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_3.value
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def out() -> pa.RecordBatch:
            parts = [np.unique(np.concatenate(x) if x else np.zeros(0, np.int64), return_counts=True) for x in held]
            cells = np.unique(np.concatenate([c for c, _ in parts]))
            sums = np.zeros((3, len(cells)), np.int64)
            for k, (c, n) in enumerate(parts):
                sums[k, np.searchsorted(cells, c)] = n
            return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), *map(pa.array, sums)], ["cell", "homes", "queries", "every"])

        for _, _, _, x in vectors(batches):
            ball, angles = own.balls(x)
            every, some = own.relations(ball, angles)
            free = x[ball < 0]
            for k, cells in enumerate(((own.home(free), own.cells + ball[ball >= 0]), (own.visits(free)[1], own.cells + np.nonzero(some)[1]), (own.cells + np.nonzero(every)[1],))):
                held[k] += cells
                size += sum(map(len, cells))
            if size >= COUNTED:
                yield out()
                held, size = [[], [], []], 0
        yield out()

    tally = source.transform(common.in_arrow, counted, "cell long, homes long, queries long, every long").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("homes", "queries", "every")])
    tally = common.materialize(tally, "multi-index-cells")
    chunk = CHUNK
    while tally.where(F.greatest("homes", "queries") > chunk).count() > BIG_CELLS:
        chunk *= 2
    big = tally.where(F.greatest("homes", "queries") > chunk).select("cell", "homes", "queries").toArrow().sort_by("cell")
    cell, homes, queries = (big.column(k).to_numpy().astype(np.int64) for k in range(3))
    # Buckets count from one.
    bucket = (F.bitmap_bucket_number(F.col("cell") + 1) - 1).alias("bucket")
    for name, times in (("homes", homes), ("queries", queries)):
        bits = tally.where(F.col(name) > 0).groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits")).collect()
        setattr(index, name, Pieces(index.cells + len(index.leaders), {r["bucket"]: bytes(r["bits"]) for r in bits}, cell, -(-times // chunk)))
    index.ball_all = np.zeros(len(index.leaders), np.int64)
    # At most BALLS rows.
    for r in tally.where(F.col("cell") >= index.cells).select("cell", "every").collect():
        index.ball_all[r["cell"] - index.cells] = r["every"]
    # 4. Homes and queries to their groups.
    shared_4 = spark.sparkContext.broadcast(index)
    group = "cell long, h long, q long, role int, vec_id long, home long, unit binary"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_4.value
        pieces_h, pieces_q = own.homes, own.queries
        for _, _, ids, x in vectors(batches):
            ball, angles = own.balls(x)
            _, some = own.relations(ball, angles)
            free = np.flatnonzero(ball < 0)
            home = np.full(len(x), -1)
            home[free] = own.home(x[free])
            row, cell = own.visits(x[free])
            row = free[row]
            asks, of = np.nonzero(some)
            held = np.flatnonzero(ball >= 0)
            # Queries, then homes; a cell of one piece with a query at home gets it once, in both roles.
            q_row, q_cell = np.concatenate([row, asks]), np.concatenate([cell, own.cells + of])
            h_row, h_cell = np.concatenate([free, held]), np.concatenate([home[free], own.cells + ball[held]])
            single = (home[q_row] == q_cell) & (pieces_h[q_cell] == 1) & (pieces_q[q_cell] == 1)
            out = [(q_row[single], q_cell[single], np.zeros(int(single.sum()), int), np.zeros(int(single.sum()), int), 3)]
            q_row, q_cell = q_row[~single], q_cell[~single]
            both = (h_cell < own.cells) & (pieces_h[h_cell] == 1) & (pieces_q[h_cell] == 1)
            h_row, h_cell = h_row[~both], h_cell[~both]
            for rows_, cells_, mine, others, role in ((q_row, q_cell, pieces_q, pieces_h, 2), (h_row, h_cell, pieces_h, pieces_q, 1)):
                times = others[cells_]
                r, c = np.repeat(rows_, times), np.repeat(cells_, times)
                across = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                piece = (ids[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(mine[c], 1)
                out.append((r, c, piece if role == 1 else across, across if role == 1 else piece, role))
            data = [v.tobytes() for v in x]
            for r, c, h, q, role in out:
                for lo in range(0, len(r), 4096):
                    at = slice(lo, lo + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v.astype(np.int64)) for v in (c[at], h[at], q[at])] + [pa.array(np.full(len(r[at]), role, np.int32)), pa.array(ids[r[at]]), pa.array(home[r[at]].astype(np.int64)), pa.array([data[k] for k in r[at].tolist()], pa.binary())],
                        ["cell", "h", "q", "role", "vec_id", "home", "unit"],
                    )

    def checked(table: pa.Table) -> pa.Table:
        own = shared_4.value
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(-1, dim)
        role, ids, home = (table.column(c).to_numpy() for c in ("role", "vec_id", "home"))
        return pa.Table.from_batches([verify(own, table.column("cell")[0].as_py(), role, ids, home, x)])

    found = source.transform(common.in_arrow, dealt, group).groupBy("cell", "h", "q").applyInArrow(checked, OUT)

    # 5. Every row: what its ball and the balls that it links with as a whole give.
    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_4.value
        for batch, places, ids, x in vectors(batches):
            yield _out(batch.column(0), rows=1)
            ball, angles = own.balls(x)
            every, _ = own.relations(ball, angles)
            if not len(own.leaders):
                continue
            n = (every * own.ball_size[None, :]).sum(axis=1)
            n += np.where(ball >= 0, own.ball_size[ball] - 1 + own.ball_all[ball], 0)
            at = np.flatnonzero(ball >= 0)
            yield _out(ids[at], other=own.ball_first[ball[at]])
            r, b = np.nonzero(every)
            yield _out(ids[r], other=own.ball_first[b])
            at = np.flatnonzero(n)
            yield _out(ids[at], n[at])

    facts = common.materialize(found.unionByName(source.transform(common.in_arrow, base, OUT)), "multi-index-facts")
    labels = connected(facts.where("next IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("next").alias("b")))
    summed = facts.groupBy("vec_id").agg(F.sum("n").alias("n_links"), F.sum("rows").alias("rows"))
    out = summed.join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).withColumn("component_id", F.coalesce("label", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


#: All pairs; for small tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id, vec_id AS at FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.at
), n AS (
  SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1
)
SELECT v.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.at) AS component_id, v.vec_id = min(r.at) AS kept FROM v JOIN r USING (vec_id) LEFT JOIN n USING (vec_id) GROUP BY v.vec_id
"""
