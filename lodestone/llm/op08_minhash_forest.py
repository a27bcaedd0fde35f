"""MinHash near-dedup by an LSH forest: several sorted signature orders, candidates from longest common prefixes.

A text's set are its distinct word shingles. Each of :data:`TREES` orders has :data:`DEPTH` MinHash values of its own; a text's key there is
their sequence. Texts with the same set are one class, and a node for each class enters the forest. Every order is sorted as a
whole (range partitioning over key and id, so equal keys can be cut and no partition grows with a group). A region is all
rows with a common prefix of :data:`LEAST_DEPTH` values. Texts are compared by 64 four-bit sketches and set sizes.

Quick rounds, at most :data:`ROUNDS`, join most of what belongs together: each text's best candidate of another component is verified.
They only spare the last pass work. They search runs of the order: a region of moderate size is compared as a whole; a larger one is parted
at deeper prefixes, as deep as its density asks, its rows compared with their neighbours on the way, and what is still large at full
depth goes through overlapping windows. What they pass over is left to the last pass.

The last pass is complete: in every region that holds two components or more, whatever its size, every candidate pair of two components
is verified. A region's rows are dealt to blocks by hash of id, those of its largest component apart from the others, and each
two blocks meet in a task's cell; two blocks of the largest component needn't. A pair is taken in the first order in which it shares a
region, so once. Sets go to a cell once for each of its texts that has a candidate there, not once for each pair.

Recall: two texts of similarity s share a region in a given order with probability s ** LEAST_DEPTH, in none of the orders
with (1 - s ** LEAST_DEPTH) ** TREES: 3e-7 at 0.85, in regions of any size. Links are exact: intersections of full sets are counted.

Cases. Null text or text without words: empty set, linked with nothing, itself kept. Fewer words than a shingle: the whole sequence is
one. Null id: such rows are reported with a null component and linked with nothing. Repeated rows: same set, same class. Ids of any
type that orders; an id shared by different texts: each row links by its own text, and gets the smallest id reached from there. Ties
go to the smaller id. Empty table: empty result. Very long texts: whole; what a worker takes at a time is bounded by bytes. Only the id and text
columns are read. :func:`keep_first` keeps rows without a set, rows without an id, and of each component one id's rows of one set, whatever texts share the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common
from lodestone.llm.components import connected
from lodestone.llm.op01_lm_score import Hashes

TREES, DEPTH, LEAST_DEPTH = 12, 8, 2
#: Four-bit sketches by text; candidates match by them up to five standard deviations under the threshold.
SKETCHES = 64
#: Rows that quick rounds compare with each other at a time, and neighbours seen where a region is parted.
REGION, NEIGHBOURS = 2048, 8
#: Quick rounds before the last pass.
ROUNDS = 2
#: Mean rows of a block of the last pass, and mean bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Rows of a block whose pairs are held at a time.
STRIP = 128
_M = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15], np.uint64)
_RNG = np.random.RandomState(20240229)
_MULT = (_RNG.randint(0, 1 << 62, TREES * DEPTH).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.randint(0, 1 << 62, TREES * DEPTH).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M[0]
    x = (x ^ (x >> np.uint64(33))) * _M[1]
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets as sorted distinct 64-bit hashes, one after another, and the sets' sizes."""
    lists = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = hashes.array([w for x in lists for w in x])
    n = np.where(sizes >= words, sizes - words + 1, (sizes > 0).astype(np.int64))
    starts = np.cumsum(sizes) - sizes
    if len(flat) >= words:
        roll = np.zeros(len(flat) - words + 1, np.uint64)
        for i in range(words):
            roll = _mixed(roll * _M[2] + flat[i : i + len(roll)] + np.uint64(i + 1))
    else:
        roll = np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    at_short = np.cumsum(n)[short] - 1
    values = roll[np.minimum(at, max(len(roll) - 1, 0))] if len(roll) else np.zeros(len(at), np.uint64)
    for k, place in zip(short.tolist(), at_short.tolist(), strict=True):
        own = np.array([len(lists[k]) * 1_000_003], np.uint64)
        for h in hashes.array(lists[k]):
            own = _mixed(own * _M[2] + h)
        values[place] = own[0]
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[first], of[first]
    return values, np.bincount(of, minlength=len(texts)).astype(np.int64)


def _digests(values: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """Digests of sets that lie one after another; null for an empty set."""
    raw, ends = values.tobytes(), np.cumsum(n)
    return [hashlib.sha256(raw[8 * int(e - c) : 8 * int(e)]).digest()[:16] if c else None for e, c in zip(ends, n, strict=True)]


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), digest of the set, keys (all orders' values, big-endian) and sketch of every row with an id."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in (x for b in batches for x in common.slices(b, 1)):
            values, n = shingle_sets(batch.column(1).to_pylist(), words, hashes)
            full = np.flatnonzero(n)
            ends = np.cumsum(n)
            heads = (ends - n)[full]
            mins = np.zeros((len(n), TREES * DEPTH), np.uint32)
            if len(full):
                for k in range(TREES * DEPTH):
                    mins[full, k] = np.minimum.reduceat(values * _MULT[k] + _ADD[k], heads) >> np.uint64(32)
            low = (mins[:, :SKETCHES] & 15).astype(np.uint8)
            sketch = low[:, 0::2] << 4 | low[:, 1::2]
            digest = _digests(values, n)
            keys = mins.astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["doc_id", "n", "digest", "keys", "sketch"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.transform(common.in_arrow, run, f"doc_id {kind}, n long, digest binary, keys binary, sketch binary")


def _estimates(sketch: np.ndarray, i: np.ndarray, j: np.ndarray | None = None) -> np.ndarray:
    """Matching sketches of rows i (down) and j (across); sketches are four words of sixteen nibbles."""
    out = np.zeros((len(i), len(j)), np.uint8)
    for w in range(sketch.shape[1]):
        x = sketch[i, w][:, None] ^ sketch[j, w][None, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        out += np.bitwise_count(x & np.uint64(0x1111111111111111))
    return SKETCHES - out


def _least(threshold: float) -> int:
    """Matching sketches from which on a pair is a candidate."""
    p = threshold + (1 - threshold) / 16
    return int(np.floor(SKETCHES * (p - 5 * np.sqrt(p * (1 - p) / SKETCHES))))


class Region:
    """Each row's best candidate of another component among rows sorted by key."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, sketch: np.ndarray, labels: np.ndarray, threshold: float) -> None:
        self.ids, self.sizes, self.keys, self.sketch, self.labels, self.threshold = ids, sizes, keys, sketch, labels, threshold
        self.least = _least(threshold)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def common(self) -> np.ndarray:
        """Length of the common prefix of each row with the one before (0 for the first)."""
        same = self.keys[1:] == self.keys[:-1]
        return np.concatenate([[0], np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))])

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids to verify."""
        self._part(0, len(self.ids), self.common(), LEAST_DEPTH)
        return self._chosen()

    def _part(self, lo: int, hi: int, lcp: np.ndarray, depth: int) -> None:
        todo = [(lo, hi, depth)]
        while todo:
            lo, hi, depth = todo.pop()
            cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] < depth)).tolist(), hi]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                if b - a <= REGION:
                    self._block(a, b)
                elif depth < DEPTH:
                    self._near(a, b)
                    todo.append((a, b, depth + 1))
                else:
                    for x in range(a, b, REGION // 2):
                        self._block(x, min(x + REGION, b))

    def _near(self, a: int, b: int) -> None:
        """Rows and the next few in the order: those with the longest common prefixes."""
        for gap in range(1, NEIGHBOURS + 1):
            i = np.arange(a, b - gap)
            x = self.sketch[i] ^ self.sketch[i + gap]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            match = SKETCHES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1).astype(np.int64)
            self._take(i, i + gap, match)

    def _block(self, a: int, b: int) -> None:
        for x in range(a, b, STRIP):
            i, j = np.arange(x, min(x + STRIP, b)), np.arange(x, b)
            match = _estimates(self.sketch, i, j)
            r, c = np.nonzero(match >= self.least)
            keep = i[r] < j[c]
            self._take(i[r[keep]], j[c[keep]], match[r[keep], c[keep]].astype(np.int64))

    def _take(self, i: np.ndarray, j: np.ndarray, match: np.ndarray) -> None:
        n, m = self.sizes[i], self.sizes[j]
        good = (match >= self.least) & (np.minimum(n, m) >= self.threshold * np.maximum(n, m) - 1e-9) & (self.labels[i] != self.labels[j]) & (self.ids[i] != self.ids[j])
        i, j, match = i[good], j[good], match[good]
        if len(i):
            # Each row's best partner; the first block that holds a row doesn't decide alone, so both directions are kept.
            i, j, match = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([match, match])
            self.found.append(_top(i, j, match, self.ids, i, 1))

    def _chosen(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j, match = (np.concatenate([f[k] for f in self.found]) for k in range(3))
        i, j, match = _top(i, j, match, self.ids, i, 1)
        a, b = np.minimum(self.ids[i], self.ids[j]), np.maximum(self.ids[i], self.ids[j])
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _top(i: np.ndarray, j: np.ndarray, match: np.ndarray, ids: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best-matching pairs of each group; ties go to smaller ids."""
    order = np.lexsort((ids[i], ids[j], -match, group))
    own = group[order]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    rank = np.arange(len(own)) - np.repeat(heads, np.diff([*heads, len(own)]))
    order = order[rank < k]
    return i[order], j[order], match[order]


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: doc_id, n, keys, sketch, label. Distinct pairs a < b for a quick round."""
    trees = rows.select(
        F.posexplode(F.array(*[F.substring("keys", 1 + 4 * DEPTH * t, 4 * DEPTH) for t in range(TREES)])).alias("tree", "key"), "doc_id", "n", "sketch", "label"
    )
    ordered = trees.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint32)
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, SKETCHES // 16)
            now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3)) + (key, sketch, batch.column(5).to_numpy(zero_copy_only=False))
            # Whole regions go; the last stays, as it may go on in the next batch.
            new = np.ones(len(key), bool)
            new[1:] = (now[0][1:] != now[0][:-1]) | (key[1:, :LEAST_DEPTH] != key[:-1, :LEAST_DEPTH]).any(axis=1)
            if held:
                new[0] = held[-1][0][-1] != now[0][0] or (held[-1][3][-1, :LEAST_DEPTH] != key[0, :LEAST_DEPTH]).any()
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if new.any():
                yield from _many([*held, tuple(x[:cut] for x in now)])
                held, rows_held = [tuple(x[cut:] for x in now)], len(key) - cut
            else:
                held.append(now)
                rows_held += len(key)
            if rows_held > 8 * REGION:
                # A region without end is worked by pieces that overlap by half a window.
                yield from _many(held)
                held = [tuple(x[-REGION // 2 :] for x in held[-1])]
                rows_held = len(held[0][0])
        if held:
            yield from _many(held)

    def _many(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Candidates among held rows, order by order."""
        whole = tuple(np.concatenate([p[k] for p in parts]) for k in range(6))
        tree = whole[0]
        cuts = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1], [True]])) if len(tree) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            _, ids, n, keys, sketch, label = (x[lo:hi] for x in whole)
            a, b = Region(ids, n, keys, sketch, label, threshold).search()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return ordered.select("tree", "key", "doc_id", "n", "sketch", "label").transform(common.in_arrow, run, "a long, b long").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """node and full set (64-bit hashes, sorted) of each of ``nodes`` (node, rep, digest)."""
    rows = nodes.count()
    ids = common.maybe_broadcast(nodes.select(F.col("rep").alias("__id")).distinct(), 64, rows)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, F.col("doc_id") == F.col("__id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in (x for b in batches for x in common.slices(b, 1)):
            values, n = shingle_sets(batch.column(1).to_pylist(), words, hashes)
            stop = (np.cumsum(n) * 8).tolist()
            raw = values.tobytes()
            sets = pa.array([raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_digests(values, n), pa.binary()), sets], ["rep", "digest", "members"])

    found = source.transform(common.in_arrow, run, f"rep {source.schema['doc_id'].dataType.simpleString()}, digest binary, members binary")
    # An id's other texts have other digests; its repeated rows give one set.
    return found.join(common.maybe_broadcast(nodes, 96, rows), ["rep", "digest"]).select("node", "members").dropDuplicates(["node"]).withColumnRenamed("node", "doc_id")


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= per_cent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both_ = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((both_[1:] == both_[:-1]).sum())
                good.append(100 * shared >= per_cent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.transform(common.in_arrow, run, "a long, b long")


CELL = ("region", "lo", "hi")


def remaining(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: doc_id, n, keys, sketch, label. All candidate pairs of two components, by cell: the ids a and b of pairs, packed, and the ids among them."""
    heads = [F.substring("keys", 1 + 4 * DEPTH * t, 4 * LEAST_DEPTH) for t in range(TREES)]
    regions = F.array(*[F.concat(F.lit(bytearray([t])), head) for t, head in enumerate(heads)])
    trees = rows.select(F.explode(regions).alias("region"), "doc_id", "n", "sketch", "label", F.concat(*heads).alias("heads"))
    parts = trees.groupBy("region", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("members"))
    whole = parts.groupBy("region").agg(F.sum("rows").alias("size"), F.sum("members").alias("members"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("rows", "label", "members")).alias("top"))
    blocks = lambda n, members: F.ceil(F.greatest(n / BLOCK, members * 8 / BLOCK_BYTES)).cast("long")
    shared = whole.where("labels > 1").select(
        "region", "size", F.col("top.label").alias("top"), blocks(F.col("top.rows"), F.col("top.members")).alias("tops"),
        blocks(F.col("size") - F.col("top.rows"), F.col("members") - F.col("top.members")).alias("others"),
    )
    joined = common.join_groups(trees, common.materialize(shared, "forest-regions"), "region", "size")
    at_top, by_hash = F.col("label") == F.col("top"), F.xxhash64("doc_id")
    dealt = joined.withColumn("block", F.when(at_top, F.pmod(by_hash, F.col("tops"))).otherwise(F.col("tops") + F.pmod(by_hash, F.col("others"))))
    met = F.sequence(F.when(at_top, F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("others") - 1)
    cells = dealt.select("region", "doc_id", "n", "sketch", "label", "heads", "block", F.explode(met).alias("met"))
    cells = cells.select("region", F.least("block", "met").alias("lo"), F.greatest("block", "met").alias("hi"), "doc_id", "n", "sketch", "label", "heads", "block")
    least = _least(threshold)

    def pairs(cell: tuple[bytes, int, int], parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(parts).combine_chunks()
        ids, n, label, block = (own.column(k).to_numpy() for k in ("doc_id", "n", "label", "block"))
        sketch = np.frombuffer(b"".join(own.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCHES // 16)
        head = np.frombuffer(b"".join(own.column("heads").to_pylist()), np.uint64).reshape(-1, TREES)[:, : cell[0][0]]
        left, right = np.flatnonzero(block == cell[1]), np.flatnonzero(block == cell[2])
        for x in range(0, len(left), STRIP):
            i = left[x : x + STRIP]
            r, c = np.nonzero(_estimates(sketch, i, right) >= least)
            r, c = i[r], right[c]
            good = (np.minimum(n[r], n[c]) >= threshold * np.maximum(n[r], n[c]) - 1e-9) & (label[r] != label[c])
            if cell[1] == cell[2]:
                good &= r < c
            r, c = r[good], c[good]
            # An earlier order in which the two share a region takes the pair.
            new = ~(head[r] == head[c]).any(axis=1)
            a, b = np.minimum(ids[r[new]], ids[c[new]]), np.maximum(ids[r[new]], ids[c[new]])
            if len(a):
                named = np.unique(np.concatenate([a, b])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell[0]], pa.binary()), pa.array([cell[1]]), pa.array([cell[2]]), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([named], pa.list_(pa.int64()))],
                    [*CELL, "a", "b", "ids"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in CELL), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if keys[lo] != now and held:
                        yield from pairs(now, held)
                        held = []
                    now = keys[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from pairs(now, held)

    return cells.repartition(*CELL).sortWithinPartitions(*CELL).transform(common.in_arrow, run, "region binary, lo long, hi long, a binary, b binary, ids array<long>")


def confirmed_cells(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links among the pairs of :func:`remaining`, enough of them to join what they join: no link of two texts that a cell's other links join already."""
    needed = pairs.select(*CELL, F.explode("ids").alias("doc_id")).distinct().join(sets, "doc_id")
    none = F.lit(None)
    both = needed.select(*CELL, "doc_id", "members", none.cast("binary").alias("a"), none.cast("binary").alias("b")).unionByName(
        pairs.select(*CELL, none.cast("long").alias("doc_id"), none.cast("binary").alias("members"), "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets_, codes, up = None, {}, None, {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        for batch in batches:
            links: list[tuple[int, int]] = []
            for *cell, doc_id, members, a, b in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if cell != now:
                    now, sets_, codes, up = cell, {}, None, {}
                if doc_id is not None:
                    sets_[doc_id] = np.frombuffer(members, np.uint64)
                    continue
                if codes is None:
                    values, code = np.unique(np.concatenate(list(sets_.values())), return_inverse=True)
                    codes = dict(zip(sets_, np.split(code, np.cumsum([len(x) for x in sets_.values()])[:-1]), strict=True))
                    marked, sets_ = np.zeros(len(values), bool), {}
                left, right = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                order = np.lexsort((right, left))
                left, right = left[order], right[order]
                heads = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])).tolist()
                for lo, hi in zip(heads, [*heads[1:], len(left)], strict=True):
                    x = int(left[lo])
                    others = [y for y in right[lo:hi].tolist() if root(y) != root(x)]
                    if not others:
                        continue
                    marked[codes[x]] = True
                    sizes = np.array([len(codes[y]) for y in others])
                    shared = np.add.reduceat(marked[np.concatenate([codes[y] for y in others])].astype(np.int64), np.cumsum(sizes) - sizes)
                    marked[codes[x]] = False
                    for k in np.flatnonzero(100 * shared >= per_cent * (len(codes[x]) + sizes - shared)).tolist():
                        if root(others[k]) != root(x):
                            up[root(others[k])] = root(x)
                            links.append((x, others[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    dealt = both.select(*CELL, "doc_id", "members", "a", "b").repartition(*CELL).sortWithinPartitions(*CELL, F.col("doc_id").asc_nulls_last())
    return dealt.transform(common.in_arrow, run, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with their components' labels; a row in no component keeps its id."""
    own = rows.drop("label").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return own.withColumn("label", F.coalesce("label", "doc_id"))


def near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    return _near_duplicates(docs, words, per_cent, id_col, text_col).drop("digest", "component")


def _near_duplicates(docs: DataFrame, words: int, per_cent: int, id_col: str, text_col: str) -> DataFrame:
    signed = common.materialize(signatures(docs, words, id_col, text_col), "forest-signatures")
    named = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # Nodes are numbered as they are written, and read from there ever after.
    grouped = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = common.materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "forest-classes")
    # A row for each class: that of its smallest id, once.
    one = classes.select(F.col("digest").alias("__digest"), F.col("rep").alias("__rep"), "node")
    reps = named.join(one, (F.col("digest") == F.col("__digest")) & (F.col("doc_id") == F.col("__rep")))
    rows = common.materialize(reps.select(F.col("node").alias("doc_id"), "n", "keys", "sketch", F.col("node").alias("label")).dropDuplicates(["doc_id"]), "forest-rows")
    sets_for = lambda nodes: common.materialize(sets_of(docs, classes.join(nodes, "node").select("node", "rep", "digest"), words, id_col, text_col), "forest-sets")

    links, labels, seen, every = None, None, None, rows
    for _ in range(ROUNDS):
        found = candidates(rows, per_cent / 100)
        pairs = common.materialize(found if seen is None else found.join(seen, ["a", "b"], "left_anti"), "forest-pairs")
        if pairs.isEmpty():
            break
        if seen is None:
            active = common.materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "forest-active")
            sets = sets_for(active)
            rows = rows.join(active.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        seen = pairs if seen is None else seen.unionByName(pairs)
        new = common.materialize(confirmed(pairs, sets, per_cent), "forest-links")
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        labels = connected(links)
        rows = common.materialize(_labelled(rows, labels), "forest-rows")

    rest = common.materialize(remaining(every if labels is None else _labelled(every, labels), per_cent / 100), "forest-rest")
    if not rest.isEmpty():
        wanted = common.materialize(rest.select(F.explode("ids").alias("node")).distinct(), "forest-wanted")
        new = common.materialize(confirmed_cells(rest, sets_for(wanted), per_cent), "forest-links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = connected(links)

    known = classes.select("digest", "size", "node", F.col("node").alias("label"), F.col("rep").alias("component_id"))
    if labels is not None:
        # Nodes' numbers say nothing: a component is named by its smallest id.
        joined = common.materialize(known.drop("label").join(labels, "node"), "forest-joined")
        firsts = common.materialize(joined.groupBy("label").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "forest-firsts")
        named_ = common.join_groups(joined.drop("component_id"), firsts, "label", "nodes").select(*known.columns)
        known = common.materialize(named_.unionByName(known.join(labels, "node", "left_anti")), "forest-named")
    own = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    with_set = common.join_groups(own.where("digest IS NOT NULL AND doc_id IS NOT NULL"), known.select("digest", "size", F.col("label").alias("component"), "component_id"), "digest", "size")
    rest = own.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", "digest", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    out = with_set.select("doc_id", "n_shingles", "digest", "component", "component_id").unionByName(rest)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, words: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest id; and all rows that have no set or no id. ``repeats``: rows of one id and one set all stay, else one of them."""
    marked = _near_duplicates(docs, words, per_cent, id_col, text_col).where("digest IS NOT NULL AND doc_id IS NOT NULL")
    rows = common.materialize(marked.groupBy("doc_id", "component", "kept").agg(F.count(F.lit(1)).alias("times"), F.min("digest").alias("digest")), "forest-marked")
    shared = common.materialize(rows.groupBy("doc_id").agg(F.sum("times").alias("times")).where("times > 1").select("doc_id"), "forest-shared")
    # Ids of one row go by id. What shared ids bear is told apart by sets: of a component's rows with its id those of the least digest stay.
    lost = rows.where("NOT kept").join(shared, "doc_id", "left_anti").unionByName(shared, allowMissingColumns=True)
    lost_id, digest, keep_id, keep_digest = common.unused(docs.columns, "lost_id", "digest", "keep_id", "keep_digest")
    lost = common.materialize(lost.select(F.col("doc_id").alias(lost_id)), "forest-lost")
    rest = docs.join(common.maybe_broadcast(lost, 64), F.col(id_col) == F.col(lost_id), "left_anti")
    if shared.isEmpty():
        return rest
    again = docs.join(common.maybe_broadcast(shared.select(F.col("doc_id").alias(keep_id)), 64), F.col(id_col) == F.col(keep_id), "left_semi")
    at, names = docs.columns.index(text_col), [*docs.columns, digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in (x for b in batches for x in common.slices(b, at)):
            own = pa.array(_digests(*shingle_sets(batch.column(at).to_pylist(), words, hashes)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names)

    digested = again.transform(common.in_arrow, run, T.StructType([*again.schema.fields, T.StructField(digest, T.BinaryType())]))
    stay = rows.where("kept").join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias(keep_id), F.col("digest").alias(keep_digest))
    found = digested.join(stay, (F.col(id_col) == F.col(keep_id)) & (F.col(digest) == F.col(keep_digest)))
    columns, row = [F.col(f"`{c}`") for c in docs.columns], common.unused(names, "row")[0]
    rest = rest.unionByName(digested.where(F.col(digest).isNull()).select(*columns))
    if repeats:
        return rest.unionByName(found.select(*columns))
    # Partial minima: a row repeated in a third of the table travels once per task.
    first = found.groupBy(keep_id, keep_digest).agg(F.min_by(F.struct(*columns), F.struct(F.col(text_col), common.content_hash(docs, docs.columns))).alias(row)).select(f"{row}.*")
    return rest.unionByName(first)


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), words=3, per_cent=85)


#: All pairs that share a shingle; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT doc_id, doc_id AS at FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.at
)
SELECT n.doc_id, n.n AS n_shingles, min(r.at) AS component_id, n.doc_id = min(r.at) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
