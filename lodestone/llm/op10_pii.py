"""Personal data by a semi-Markov conditional random field over whole-span candidates.

Base spans come from four fixed patterns. Beside them, looser patterns propose candidate segments per kind: obfuscated mail
addresses (``name at host dot com``), addresses in brackets or with spaces, card-like and phone-like digit groups with
other separators or without ``+``, ports after addresses. A segment is scored as a whole: kind, shape, digit count, Luhn
validity, separators, the word before it, agreement of group sizes. Text outside segments is label O with score 0, so the
semi-Markov chain over a text is a sequence of non-overlapping segments and O gaps; its partition function and its best path are
sums and maxima over segments that end at each candidate boundary. Boundaries and kinds are chosen jointly by dynamic
programming over candidates sorted by end: bounded entity length keeps each step's predecessors bounded, and runs of
text without candidates are skipped as one O step of score 0.

Weights are fitted by stochastic gradient ascent on the conditional likelihood (forward-backward over candidates) on a bounded
sample: about :data:`SAMPLE_ROWS` texts by hash of id and text, and of each at most :data:`SAMPLE_WINDOWS` windows around candidates, chosen by hash
from the whole text, cut to :data:`SAMPLE_CHARS` characters; of a window at most :data:`SAMPLE_NEGATIVES` candidates are shown as negatives.
There are no gold spans, so the sample is labelled by distant supervision: base spans that pass their checks are the targets, and each such span is
also shown in an altered form made by fixed rewriting rules (``@`` to `` at ``, other separators, ``00`` for ``+``), whose target is
the rewritten span. Digit runs that fail every check are negatives.

The base spans always stay; decoded spans that overlap a base span of any kind are dropped.

Cases. Null text: as empty, no spans. Null id: kept as null. Repeated rows: one result each. Very long texts: whole, the work is
linear in candidates. Empty table: empty result. Ties in decoding: the path that ends earlier wins, then the kind listed
first. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import nsmallest
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the sample that the weights are fitted on; texts are found and decoded whole.
SAMPLE_ROWS, SAMPLE_WINDOWS, SAMPLE_CHARS, SAMPLE_NEGATIVES = 4000, 4, 600, 20
#: Entities are at most so long; longer candidates are not proposed (base spans have no bound).
MAX_SPAN = 96
#: Passes over the sample, step size and weight decay of the fit.
EPOCHS, RATE, L2 = 6, 0.3, 1e-4

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The contract's ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``: a match can only start where a run of digits does, and giving digits back never helps.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")

#: Candidate patterns. The first part of each is an anchor that is rare in prose.
_LOOSE = (
    ("email", re.compile(r"\b[A-Za-z0-9._%+-]{1,40}\s?[\[({]?\s?(?:@|\bat\b)\s?[\])}]?\s?[A-Za-z0-9-]{1,30}(?:\s?[\[({]?\s?(?:\.|\bdot\b)\s?[\])}]?\s?[A-Za-z0-9-]{1,20}){1,3}")),
    ("ip", re.compile(r"\b[0-9]{1,3}(?:\s?[.\[\](){}]{1,3}\s?[0-9]{1,3}){3}\b")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{0,2}[0-9]{2,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9]{1,4}[)]?(?:[ ./()_-]{1,2}[0-9]{2,4}){1,4}(?![0-9])")),
)
#: Where digits lie close enough for any of the last three.
_RUN = re.compile(r"[0-9](?:[ ./()\[\]{}_-]{0,4}[0-9]){3,}")
#: From the sign or word ``at`` to the first dot after a host's label.
_AT_TAIL = re.compile(r"(?:@|\bat\b)\s?[\])}]?\s?[A-Za-z0-9-]{1,30}\s?[\[({]?\s?(?:\.|\bdot\b)")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``_EMAIL.finditer``, started from each ``@`` instead of each word: a match's first ``@`` ends its local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four fixed patterns that pass their checks, by kind as listed and then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(_at_most_255(p) for p in m.group().split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        # Digits are at least half of a match.
        if 13 <= m.end() - m.start() <= 38 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Segments that the field may choose, sorted by end, start and kind."""
    found: set[tuple[int, int, str]] = set()
    has_digit = _DIGIT.search(text) is not None
    for m in _AT_TAIL.finditer(text):
        lo = max(0, m.start() - 48)
        for c in _LOOSE[0][1].finditer(text, lo, min(len(text), m.end() + MAX_SPAN)):
            if c.start() <= m.start() < c.end() and c.end() - c.start() <= MAX_SPAN:
                found.add((c.end(), c.start(), "email"))
    if has_digit:
        for run in _RUN.finditer(text):
            lo, hi = max(0, run.start() - 1), run.end() + 1
            for kind, pattern in _LOOSE[1:]:
                for c in pattern.finditer(text, lo, hi):
                    if c.end() - c.start() <= MAX_SPAN:
                        found.add((c.end(), c.start(), kind))
    return [(k, a, b) for b, a, k in sorted(found, key=lambda x: (x[0], x[1], KINDS.index(x[2])))]


_CUES = {
    "email": re.compile(r"mail|contact|write|reach", re.I), "ip": re.compile(r"\bip\b|addr|host|server|from", re.I),
    "card": re.compile(r"card|visa|pay|account|credit", re.I), "phone": re.compile(r"phone|tel|call|fax|mobile|contact", re.I),
}


def features(text: str, kind: str, start: int, end: int) -> list[str]:
    """Names of the whole-span features that hold for a segment."""
    s = text[start:end]
    d = _digits(s)
    out = [f"{kind}:bias", f"{kind}:cue={bool(_CUES[kind].search(text, max(0, start - 24), start))}"]
    before, after = text[start - 1 : start], text[end : end + 1]
    out.append(f"{kind}:edge={(not before or before.isspace() or before in '([<\"') and (not after or not after.isalnum())}")
    if kind == "email":
        tail = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower()
        out += [f"email:at={'@' in s}", f"email:word_at={bool(re.search(r'at', s)) and '@' not in s}", f"email:dot={'.' in s}", f"email:word_dot={bool(re.search(r'dot', s))}"]
        out += [f"email:tld={tail in _TLDS}", f"email:brackets={bool(re.search(r'[][(){}]', s))}", f"email:gaps={min(3, sum(ch.isspace() for ch in s))}", f"email:sentence={bool(_STOP.search(s))}"]
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        out += [f"ip:in_range={all(_at_most_255(p) for p in parts)}", f"ip:plain={s.count('.') == 3 and len(s) == len(d) + 3}", f"ip:joined={before == '.' or after == '.' and text[end + 1 : end + 2].isdigit()}"]
    elif kind == "card":
        groups = tuple(len(g) for g in re.findall(r"[0-9]+", s))
        out += [f"card:luhn={luhn(d)}", f"card:count={13 <= len(d) <= 19}", f"card:luhn16={luhn(d) and len(d) == 16}", f"card:first={d[0] in '3456'}", f"card:even={len(set(groups)) == 1 and len(groups) == 4}"]
    else:
        groups = re.findall(r"[0-9]+", s)
        out += [f"phone:count={9 <= len(d) <= 15}", f"phone:prefix={'plus' if s[0] == '+' else 'zeros' if s[:2] == '00' else 'paren' if s[0] == '(' else 'none'}", f"phone:groups={min(len(groups), 6)}"]
        out += [f"phone:last4={len(groups[-1]) == 4}", f"phone:dots={s.count('.') > 2}", f"phone:luhn={len(d) >= 13 and luhn(d)}"]
    return out


_STOP = re.compile(r"\.\s")
_TLDS = frozenset("com org net edu gov io de fr es uk info co eu us".split())


class SemiMarkov:
    """Weights by feature name; O has score 0."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = dict(weights or {})

    def score(self, names: Iterable[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def _before(self, segments: list[tuple[str, int, int]]) -> list[int]:
        """For each segment, how many of the segments (sorted by end) end at or before its start."""
        ends = np.array([b for _, _, b in segments])
        return np.searchsorted(ends, [a for _, a, _ in segments], side="right").tolist()

    def decode(self, text: str, segments: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The best non-overlapping choice of segments and kinds."""
        if not segments:
            return []
        before = self._before(segments)
        best, took = [0.0], []
        for i, (k, a, b) in enumerate(segments):
            with_it = best[before[i]] + self.score(features(text, k, a, b))
            took.append(with_it > best[-1])
            best.append(max(best[-1], with_it))
        out, i = [], len(segments)
        while i:
            if took[i - 1]:
                out.append(segments[i - 1])
                i = before[i - 1]
            else:
                i -= 1
        return out[::-1]

    def marginals(self, scores: list[float], segments: list[tuple[str, int, int]]) -> tuple[float, list[float]]:
        """log Z and each segment's posterior, by forward and backward sums over candidates."""
        n, before = len(segments), self._before(segments)
        fwd = [0.0]
        for i in range(n):
            fwd.append(np.logaddexp(fwd[-1], fwd[before[i]] + scores[i]))
        back = [-math.inf] * n + [0.0]
        for i in range(n, 0, -1):
            back[i - 1] = np.logaddexp(back[i - 1], back[i])
            j = before[i - 1]
            back[j] = np.logaddexp(back[j], back[i] + scores[i - 1])
        return float(fwd[-1]), [math.exp(min(0.0, fwd[before[i]] + scores[i] + back[i + 1] - fwd[-1])) for i in range(n)]

    def fit(self, examples: list[tuple[list[list[str]], list[tuple[str, int, int]], list[bool]]]) -> None:
        """examples: features by segment, segments, and which of them are the target."""
        squared: dict[str, float] = {}
        for _ in range(EPOCHS):
            for names, segments, gold in examples:
                _, posterior = self.marginals([self.score(x) for x in names], segments)
                step: dict[str, float] = {}
                for own, p, g in zip(names, posterior, gold, strict=True):
                    if abs(g - p) > 1e-6:
                        for f in own:
                            step[f] = step.get(f, 0.0) + g - p
                for f, g in step.items():
                    g -= L2 * self.weights.get(f, 0.0)
                    squared[f] = squared.get(f, 1e-3) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + RATE * g / math.sqrt(squared[f])


def _altered(kind: str, s: str, pick: int) -> str:
    """A span rewritten as people obfuscate or reformat it."""
    if kind == "email":
        at, dot = (" at ", " dot ") if pick % 3 == 0 else (" [at] ", " [dot] ") if pick % 3 == 1 else (" (at) ", ".")
        name, host = s.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", "[.]") if pick % 2 else s.replace(".", " . ")
    if kind == "card":
        d = _digits(s)
        return "/".join(d[i : i + 4] for i in range(0, len(d), 4)) if pick % 2 else ".".join(d[i : i + 4] for i in range(0, len(d), 4))
    return s.replace("+", "00", 1) if pick % 2 else s.replace("+", "", 1).replace("(", "").replace(")", "")


def examples_of(text: str) -> list[tuple[list[list[str]], list[tuple[str, int, int]], list[bool]]]:
    """Training examples: the windows around candidates as they are, and around base spans rewritten."""
    out = []

    def add(window: str, targets: set[tuple[str, int, int]]) -> None:
        segments = candidates(window)
        if segments and targets <= set(segments):
            out.append(([features(window, *x) for x in segments], segments, [x in targets for x in segments]))

    base = base_spans(text)
    for i, (k, a, b) in enumerate(base):
        lo, hi = max(0, a - 60), min(len(text), b + 60)
        inside = {(kk, aa - lo, bb - lo) for kk, aa, bb in base if aa >= lo and bb <= hi}
        add(text[lo:hi], inside)
        new = _altered(k, text[a:b], a + i)
        if not any(x is not base[i] and x[1] < hi and x[2] > lo for x in base):
            window = text[lo:a] + new + text[b:hi]
            add(window, {(k, a - lo, a - lo + len(new))})
    covered = [(a, b) for _, a, b in base]
    for k, a, b in candidates(text)[:SAMPLE_NEGATIVES]:
        if not any(x < b + 60 and y > a - 60 for x, y in covered):
            lo, hi = max(0, a - 60), min(len(text), b + 60)
            add(text[lo:hi], set())
    return out


def find(text: str, model: SemiMarkov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those and the decoded ones that touch none of them."""
    base = base_spans(text)
    segments = candidates(text)
    if base and segments:
        mask = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in mask]
        # The furthest end of the base spans up to each.
        furthest = list(accumulate((b for _, b in mask), max))
        keep = []
        for k, a, b in segments:
            at = bisect_left(starts, b)
            if not at or furthest[at - 1] <= a:
                keep.append((k, a, b))
        segments = keep
    extra = model.decode(text, segments)
    return base, sorted(base + extra, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS, chars: int = SAMPLE_CHARS) -> SemiMarkov:
    """Fits the weights on a sample of about ``rows`` texts chosen by hash; the same rows give the same weights."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text"))
    # Only windows around candidates come to the driver.
    sample = common.hash_sample(own, rows, "key", "text")

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in common.slices(b, 1)):
            found: list[tuple[str, str]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = [(a, b) for _, a, b in base_spans(text)] + [(a, b) for _, a, b in candidates(text)]
                merged: list[list[int]] = []
                for a, b in sorted((max(0, a - 130), b + 130) for a, b in spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cut = [text[a : min(b, a + chars)] for a, b in merged]
                found += [(key, x) for x in nsmallest(windows, cut, key=lambda x: hashlib.md5(x.encode("utf-8", "replace")).digest())]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["key", "window"])

    model = SemiMarkov()
    texts = sorted({(r["key"], r["window"]) for r in sample.transform(common.in_arrow, find_windows, "key string, window string").toLocalIterator()})
    model.fit([x for _, text in texts for x in examples_of(text)])
    return model


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: SemiMarkov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text, as :data:`RESULT` says; the id keeps its type."""
    weights = model.weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiMarkov(weights)
        for batch in (x for b in batches for x in common.slices(b, 1)):
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base, spans = find(text or "", own)
                kinds = [k for k, _, _ in base]
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = RESULT.replace("doc_id long", f"doc_id {kind}")
    names = [x.split()[0] for x in schema.split(", ")]
    return source.transform(common.in_arrow, scan, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return detect(docs, train(docs))
