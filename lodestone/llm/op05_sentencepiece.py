"""SentencePiece (BPE with byte fallback) encoding by suffix-array matching, and decoding.

The texts of a batch are cut into stretches across whose borders no piece can reach, and the stretches not met before are joined
into one text. Its suffixes are sorted to the depth of the longest piece; a binary search for every piece of the vocabulary
gives the range of its occurrences; these are the edges of a lattice, sorted by position and relaxed from left to right.

The vocabulary is a BPE one, so an edge may not be taken for its score: it must be a step of the one path that merging by
score would leave. That is a local matter: a sequence of pieces is the BPE encoding exactly if each two neighbours are what
merging makes of their joint text (:meth:`Pieces.compatible`). So each position has one last piece, and an edge relaxes its end
if it is compatible with the last piece at its start.

The vocabulary file is read by the driver alone and broadcast (some MB, whatever the corpus). Executors keep a bounded cache
of stretches that they have encoded; a stretch's encoding doesn't depend on its batch, so results don't either.

Cases. Null text: null ids, no round trip. Empty text: no ids. Null id: kept. Repeated rows: one result each. Very long texts, also
without spaces: whole, cut where no piece can reach across, else relaxed position by position. Characters outside the vocabulary: a piece per
byte. The character U+2581 stands for a space in the vocabulary and is decoded as one, so texts that hold it don't
come back the same (``round_trip`` is false). Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SPACE = SPACE.encode()
#: Stretches kept by a worker (as many again may be on their way out), characters indexed at a time, and the longest stretch that is relaxed side by side with others.
CACHE, INDEXED, SIDE_BY_SIDE = 150_000, 250_000, 64
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _bytes(stretch: str) -> bytes:
    """What is matched: UTF-8, with the space's sign as one byte that UTF-8 doesn't have."""
    return stretch.encode().replace(_SPACE, b"\xc1")


class Pieces:
    """A vocabulary's tables; plain arrays and dicts, so that it can be broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], ordinary: list[bool], byte_ids: dict[int, int]) -> None:
        self.pieces, self.byte_ids = pieces, byte_ids
        self.ids = {p: i for i, p in enumerate(pieces) if ordinary[i]}
        self.score = scores
        self.chars = {p for p in self.ids if len(p) == 1}
        self.decoded = [p.replace(SPACE, " ").encode() if ordinary[i] else b"" for i, p in enumerate(pieces)]
        for b, i in byte_ids.items():
            self.decoded[i] = bytes([b])
        # Merges in the order of their scores, after all single characters.
        merged = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-scores[i], i))
        self.rank = np.zeros(len(pieces), np.int64)
        for r, c in enumerate(sorted(self.chars)):
            self.rank[self.ids[c]] = r
        for r, i in enumerate(merged):
            self.rank[i] = len(self.chars) + r
        self.of_rank = np.zeros(len(self.ids), np.int64)
        for i in self.ids.values():
            self.of_rank[self.rank[i]] = i
        # The last merge of each piece; pieces that merging cannot reach are not matched.
        self.left, self.right = np.arange(len(self.ids)), np.arange(len(self.ids))
        self.reached = []
        for p, i in self.ids.items():
            parts, last = self.merge(p, trace=True)
            if parts == [i]:
                self.reached.append(i)
                if last is not None:
                    self.left[self.rank[i]], self.right[self.rank[i]] = self.rank[last[0]], self.rank[last[1]]
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[int(self.rank[a]) * len(pieces) + int(self.rank[b])] = int(self.rank[i])
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # Merges of equal score are decided by position alone, which ranks don't show; these pieces' pairs are merged outright.
        equal: dict[float, int] = {}
        for i in merged:
            equal[scores[i]] = equal.get(scores[i], 0) + 1
        tied = np.zeros(len(self.ids), bool)
        for i in merged:
            tied[self.rank[i]] = equal[scores[i]] > 1
        self.tied = tied
        texts = sorted((_bytes(self.pieces[i]), i) for i in self.reached)
        self.width = max(len(t) for t, _ in texts)
        self.needle_id = np.array([i for _, i in texts])
        self.needle = np.array([t for t, _ in texts], f"S{self.width}")
        self.needle_end = np.array([t + b"\xff" * (self.width - len(t)) for t, _ in texts], f"S{self.width}")
        self.n_bytes = np.array([len(_bytes(p)) for p in pieces])

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(bytes_) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        ordinary = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        out = cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], ordinary, bytes_)
        if any(SPACE in p.lstrip(SPACE) for p in out.ids) or any(not out.chars.issuperset(p) for p in out.ids):
            raise ValueError("pieces must hold spaces at their front only, and characters that are pieces themselves")
        return out

    def merge(self, text: str, trace: bool = False) -> list[int] | tuple[list[int], tuple[int, int] | None]:
        """BPE by its definition: the best-scored, then leftmost, pair of neighbours whose joint text is a piece is merged, until none is."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = max(((self.score[self.ids[parts[k] + parts[k + 1]]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.ids), default=None)
            if best is None:
                break
            k = -best[1]
            last = (self.ids[parts[k]], self.ids[parts[k + 1]])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        ids = [self.ids[p] for p in parts]
        return (ids, last) if trace else ids

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of two pieces gives back the two, by undoing their merges from the border.

        Piece by piece the later merge of the two is undone; if at any moment the pieces at the border could have merged
        before the merge last undone, they would have.
        """
        a, b = self.rank[first], self.rank[second]
        limit = np.full(len(a), len(self.pieces) + 1)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        any_tied = self.tied[a] | self.tied[b]
        for i in np.flatnonzero(any_tied):
            good[i] = self.merge(self.pieces[first[i]] + self.pieces[second[i]]) == [first[i], second[i]]
        open_ = open_[~any_tied]
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * len(self.pieces) + y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            joined = np.where(self.pair_key[at] == key, self.pair_rank[at], len(self.pieces) + 1)
            bad = joined < limit[open_]
            good[open_[bad]] = False
            open_, x, y = open_[~bad], x[~bad], y[~bad]
            nx, ny = self.right[x], self.left[y]
            # Undo the left piece's merge if it is the later one, or the right piece has none.
            undo_x = np.where(x > y, nx != x, (nx != x) & (ny == y))
            undo_y = ~undo_x & (ny != y)
            limit[open_[undo_x]] = x[undo_x]
            limit[open_[undo_y]] = y[undo_y] + 1
            a[open_[undo_x]], b[open_[undo_y]] = nx[undo_x], ny[undo_y]
            open_ = open_[undo_x | undo_y]
        return good


class Encoder:
    """Encodes texts; keeps what it has encoded."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.words, self.old_words = {}, {}
        self.others, self.old_others = {"": b""}, {}
        self.bytes_ = [np.int32(pieces.byte_ids[b]).tobytes() for b in range(256)]
        self.pair_key, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)

    def _good(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """As ``compatible``, remembering pairs."""
        key = first.astype(np.int64) * len(self.p.pieces) + second
        if len(self.pair_key) > 500_000:
            self.pair_key, self.pair_good = self.pair_key[:0], self.pair_good[:0]
        new = np.unique(key)
        if len(self.pair_key):
            at = np.minimum(np.searchsorted(self.pair_key, new), len(self.pair_key) - 1)
            new = new[self.pair_key[at] != new]
        if len(new):
            keys = np.concatenate([self.pair_key, new])
            good = np.concatenate([self.pair_good, self.p.compatible(new // len(self.p.pieces), new % len(self.p.pieces))])
            order = np.argsort(keys)
            self.pair_key, self.pair_good = keys[order], good[order]
        return self.pair_good[np.searchsorted(self.pair_key, key)]

    def stretches(self, texts: list[str]) -> list[bytes]:
        """The ids (int32) of stretches of known characters."""
        out: list[bytes] = []
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= INDEXED or i + 1 == len(texts):
                out += self._indexed(texts[lo : i + 1])
                lo, size = i + 1, 0
        return out

    def _indexed(self, texts: list[str]) -> list[bytes]:
        p = self.p
        data = [_bytes(t) for t in texts]
        flat = np.frombuffer(b"\0".join(data) + b"\0" * (p.width + 1), np.uint8)
        sizes = np.array([len(d) for d in data])
        begins = np.cumsum(sizes + 1) - sizes - 1
        total = int(begins[-1] + sizes[-1])
        # Suffixes that begin with a character of a text.
        heads = np.flatnonzero((flat[:total] != 0) & (flat[:total] & 0xC0 != 0x80))
        windows = np.lib.stride_tricks.sliding_window_view(flat, p.width)[heads]
        suffixes = np.ascontiguousarray(windows).view(f"S{p.width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        lo, hi = np.searchsorted(suffixes, p.needle, "left"), np.searchsorted(suffixes, p.needle_end, "right")
        del suffixes, windows
        n = hi - lo
        piece = np.repeat(p.needle_id, n)
        start = heads[order[np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]]
        end = start + p.n_bytes[piece]
        text_of = np.repeat(np.arange(len(texts)), sizes + 1)[:total]
        offset = end - begins[text_of[start]]
        last = np.full(total + 1, -1, np.int64)
        long_ = sizes > SIDE_BY_SIDE
        long_edge = long_[text_of[start]] if long_.any() else np.zeros(len(start), bool)
        at_begin = start == begins[text_of[start]]

        short = np.flatnonzero(~long_edge)
        short = short[np.argsort(offset[short], kind="stable")]
        cuts = np.searchsorted(offset[short], np.arange(1, SIDE_BY_SIDE + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            edge = short[a:b]
            if not len(edge):
                continue
            before = last[start[edge]]
            free = at_begin[edge]
            take = free.copy()
            ask = np.flatnonzero(~free & (before >= 0))
            if len(ask):
                take[ask] = self._good(before[ask], piece[edge[ask]])
            last[end[edge[take]]] = piece[edge[take]]
        if long_.any():
            edge = np.flatnonzero(long_edge)
            edge = edge[np.argsort(end[edge], kind="stable")]
            known: dict[tuple[int, int], bool] = {}
            for s, e, t, free in zip(start[edge].tolist(), end[edge].tolist(), piece[edge].tolist(), at_begin[edge].tolist(), strict=True):
                before = int(last[s])
                if not free:
                    if before < 0:
                        continue
                    good = known.get((before, t))
                    if good is None:
                        good = known[before, t] = bool(p.compatible(np.array([before]), np.array([t]))[0])
                    if not good:
                        continue
                last[e] = t
        return self._walk(last, begins, begins + sizes)

    def _walk(self, last: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Back from each text's end over the last pieces."""
        count = np.zeros(len(begins), np.int64)
        cur, live = ends.copy(), np.flatnonzero(ends > begins)
        while len(live):
            count[live] += 1
            cur[live] -= self.p.n_bytes[last[cur[live]]]
            live = live[cur[live] > begins[live]]
        stop = np.cumsum(count)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        cur, at, live = ends.copy(), stop.copy(), np.flatnonzero(ends > begins)
        while len(live):
            t = last[cur[live]]
            at[live] -= 1
            out[at[live]] = t
            cur[live] -= self.p.n_bytes[t]
            live = live[cur[live] > begins[live]]
        raw = out.tobytes()
        stop = (stop * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]

    def _cut(self, text: str) -> list[str]:
        """Stretches of known characters, and unknown characters by themselves; cut where no piece reaches across."""
        if len(text) <= SIDE_BY_SIDE and self.p.chars.issuperset(text):
            return [text]
        out, lo, inner, chars = [], 0, self.p.inner, self.p.chars
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inner:
                out.append(text[lo:i])
                lo = i
        out.append(text[lo:])
        return [y for x in out for y in ([x] if len(x) == 1 or chars.issuperset(x) else x)]

    def learn(self, words: Iterable[str], others: Iterable[str]) -> None:
        """Encodes what is new: words (which a space precedes) and other stretches."""
        simple: dict[str, list[tuple[dict, str]]] = {}
        cut: list[tuple[dict, str, list[str]]] = []
        chars = self.p.chars
        for into, keys, before in ((self.words, words, SPACE), (self.others, others, "")):
            for key in keys:
                whole = before + key
                if len(whole) <= SIDE_BY_SIDE and chars.issuperset(key):
                    simple.setdefault(whole, []).append((into, key))
                else:
                    cut.append((into, key, self._cut(whole)))
        todo = list(simple)
        for text, ids in zip(todo, self.stretches(todo), strict=True):
            for into, key in simple[text]:
                into[key] = ids
        todo = sorted({x for _, _, parts in cut for x in parts if x[0] in chars})
        ids = dict(zip(todo, self.stretches(todo), strict=True))
        for into, key, parts in cut:
            into[key] = b"".join(ids[x] if x in ids else b"".join(self.bytes_[b] for b in x.encode()) for x in parts)

    def _missing(self, wanted: set[str], now: dict[str, bytes], old: dict[str, bytes]) -> list[str]:
        """What is in neither generation; what is in the old one only moves on."""
        wanted -= now.keys()
        for x in wanted & old.keys():
            now[x] = old[x]
        return sorted(wanted - now.keys())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids (int32) of each text."""
        if len(self.words) + len(self.others) > CACHE:
            # Stretches that are met again before the next time stay.
            self.words, self.old_words = {}, self.words
            self.others, self.old_others = {"": b""}, self.others
        plans = []
        words: set[str] = set()
        others: set[str] = set()
        for text in texts:
            lines = []
            # A line feed is in no piece, so lines are apart; the text's first line has a space put before it.
            for i, line in enumerate(text.split("\n")):
                if not line and i:
                    lines.append(("", ()))
                elif SPACE in line or "  " in line or line.startswith(" ") or line.endswith(" ") or not line:
                    parts = _RUNS.findall((SPACE + line if i == 0 else line).replace(" ", SPACE))
                    others.update(parts)
                    lines.append((None, parts))
                else:
                    parts = line.split(" ")
                    first = parts.pop(0) if i else ""
                    others.add(first)
                    words.update(parts)
                    lines.append((first, parts))
            plans.append(lines if text else [])
        self.learn(self._missing(words, self.words, self.old_words), self._missing(others, self.others, self.old_others))
        feed = self.bytes_[10]
        known, rest = self.words.__getitem__, self.others.__getitem__
        return [
            feed.join(b"".join(map(rest, parts)) if first is None else rest(first) + b"".join(map(known, parts)) for first, parts in lines)
            for lines in plans
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD, and the space put before the text goes."""
        out = b"".join(map(self.p.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_encoders: dict[int, Encoder] = {}


def tokenize(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_ids and round_trip (whether decoding gives the text) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        # A worker that is used again keeps its encodings.
        encoder = _encoders.get(id(own))
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[id(own)] = Encoder(own)
        for batch in (x for b in batches for x in common.slices(b, 1)):
            texts = batch.column(1).to_pylist()
            ids = encoder.encode([t or "" for t in texts])
            sizes = np.array([len(x) // 4 for x in ids], np.int32)
            same = [None if t is None else encoder.decode(np.frombuffer(x, np.int32).tolist()) == t for t, x in zip(texts, ids, strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([t is None for t in texts] + [False]))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))
            counts = pa.array(sizes, mask=np.array([t is None for t in texts], bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, counts, pa.array([bool(s) for s in same])], ["doc_id", "ids", "n_ids", "round_trip"])

    return source.transform(common.in_arrow, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_ids int, round_trip boolean")


def detokenize(tokens: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids give null."""
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)
    source = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return source.transform(common.in_arrow, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return tokenize(common.documents(spark, sf_dir), Pieces.load(model))
