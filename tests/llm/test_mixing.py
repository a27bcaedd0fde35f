import hashlib
import math
from collections import Counter

import pytest

from lodestone.llm import op03_mixing as op


def counts_by_hand(rows, weights=None, seed=op.SEED, budget=1.0):
    size = Counter()
    for _, text, _, source, _ in rows:
        size[source] += max(len(text or ""), 1)
    w = {s: (n**op.ALPHA if weights is None else weights.get(s, 0.0)) for s, n in size.items()}
    total, n = sum(w.values()), sum(size.values())
    out = Counter()
    for doc_id, _, _, source, _ in rows:
        name = "null" if doc_id is None else str(doc_id)
        u = (int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rate = w[source] / total * budget * n / size[source]
        k, cdf = 0, math.exp(-rate)
        while rate and cdf <= u and k < 3 * rate + 100:
            k += 1
            cdf += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out[doc_id] += k
    return out


def test_counts_are_inverse_poisson(docs, corpus):
    got = Counter(r.doc_id for r in op.mix(docs).collect())
    assert got == +counts_by_hand(corpus)


def test_given_weights_and_budget(docs, corpus):
    weights = {"hot": 0.1, "s1": 3.0, None: 0.01}
    got = Counter(r.doc_id for r in op.mix(docs, weights=weights, budget=5.0).collect())
    assert got == +counts_by_hand(corpus, weights, budget=5.0)


def test_columns_copies_and_order(docs):
    out = op.mix(docs)
    assert [c for c in out.columns if c not in ("copy", "shuffle_key")] == [c for c in docs.columns if c != "copy"]
    rows = out.select("doc_id", "copy", "shuffle_key").where("doc_id <> 5").collect()
    assert len(rows) == len({(r.doc_id, r["copy"]) for r in rows})
    assert op.mixed_documents(docs.drop("copy")).columns == docs.drop("copy").columns


def test_salted_join_gives_the_same(docs, monkeypatch):
    want = Counter((r.doc_id, r["copy"]) for r in op.mix(docs).collect())
    monkeypatch.setattr(op.common, "BROADCAST_BYTES", 0)
    assert Counter((r.doc_id, r["copy"]) for r in op.mix(docs).collect()) == want


INTERNAL = ("__source", "__rate", "__cdf", "__salt", "__at", "__u", "__n", "__k", "__log", "__sum", "__size", "__weight", "__name", "copy", "shuffle_key", "low", "high")


def test_columns_named_like_internal_ones_survive(docs, monkeypatch):
    from pyspark.sql import functions as F

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    clashing = plain.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in INTERNAL])
    want = Counter(r.doc_id for r in op.mix(plain).collect())
    for limit in (1 << 20, 0):
        monkeypatch.setattr(op.common, "BROADCAST_BYTES", limit)
        rows = op.mixed_documents(clashing).collect()
        assert Counter(r.doc_id for r in rows) == want
        assert all(r[c] == (None if r.doc_id is None else f"{c}-{r.doc_id}") for r in rows for c in INTERNAL)
        rows = op.mix(clashing).collect()
        assert Counter(r.doc_id for r in rows) == want and all(r["__u"] == f"__u-{r.doc_id}" for r in rows if r.doc_id is not None)


def test_distribution_function_and_bisection(spark):
    from pyspark.sql import functions as F

    rates = [(None, 0.0), ("a", 1e-9), ("b", 0.3), ("c", 7.5), ("d", 1000.0), ("e", 100_000.0)]
    for source, rate, cdf in op.poisson_cdf(spark.createDataFrame(rates, "s string, r double"), "s", "r", "c").collect():
        assert (rate == 0) == (not cdf) and (not cdf or abs(cdf[-1] - 1) < 1e-8)
        for k in {0, 1, int(rate), int(rate + 3 * rate**0.5)} if cdf else ():
            log_p = -rate + k * math.log(rate) - math.lgamma(k + 1)
            assert cdf[k] - (cdf[k - 1] if k else 0) == pytest.approx(math.exp(log_p), rel=1e-6, abs=1e-14)
    rows = [([], 0.5), ([0.1], 0.05), ([0.1], 0.1), ([0.1], 0.2), ([0.1, 0.2, 0.2, 0.9], 0.2), ([0.1 * i for i in range(1, 10)], 0.55), ([0.5] * 100, 0.5), ([0.5] * 100, 0.4)]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<double>, u double").select(op.count_up_to(F.col("c"), F.col("u"))).collect()]
    assert got == [sum(x <= u for x in c) for c, u in rows]


def test_senseless_rates_are_refused(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id bigint, text string, source string")
    with pytest.raises(ValueError, match="repeated"):
        op.mix(df, weights={"a": 1.0}, budget=1e9)


def test_sources_meet_their_weights(spark):
    rows = [(i, "x" * 10, "en", "a" if i < 3000 else "b", 10) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter(r.source for r in op.mix(df, weights={"a": 1.0, "b": 1.0}, budget=2.0).collect())
    assert abs(got["a"] - 4000) < 250 and abs(got["b"] - 4000) < 250


def test_large_rate(spark):
    df = spark.createDataFrame([(1, "x", "en", "a", 1), (2, "y" * 1999, "en", "b", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert abs(op.mix(df, weights={"a": 1.0, "b": 1.0}).where("source = 'a'").count() - 1000) < 200


def test_empty(empty):
    assert op.mix(empty).count() == 0 and op.mix(empty, weights={"a": 1.0}).count() == 0
