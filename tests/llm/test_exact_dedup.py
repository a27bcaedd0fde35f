import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import op06_exact_dedup as op


def by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(m[2], keep, len(members), m[2] == keep, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_same_as_by_hand(docs, corpus, files_per_batch):
    got = op.deduplicate(docs, files_per_batch=files_per_batch)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == by_hand(corpus)


def test_clashing_digests_are_told_apart_by_bytes(docs, corpus):
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)
    got = op.deduplicate(docs, digest=weak)
    want = sorted(((a, b, c, d) for a, b, c, d, _ in by_hand(corpus)), key=str)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want


def test_shuffled_joins_give_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(op.common, "BROADCAST_BYTES", 0)
    assert sorted((tuple(r)[:5] for r in op.deduplicate(docs).collect()), key=str) == by_hand(corpus)


def test_locators_name_the_kept_row(docs):
    row = op.deduplicate(docs).where("kept AND doc_id IS NOT NULL AND group_size > 1").first()
    file, index = row.keep_locator.rsplit("#", 1)
    spark = docs.sparkSession
    assert spark.read.parquet(file).where(F.col("_metadata.row_index") == int(index)).first().doc_id == row.keep_id


def test_filter(docs, corpus):
    kept = op.keep_first(docs)
    assert kept.schema == docs.schema
    want = sorted((r[0] for r in by_hand(corpus) if r[3]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_without_locators_and_empty(spark, corpus, empty):
    df = spark.createDataFrame(corpus, empty.schema).distinct()
    assert {r.keep_locator for r in op.deduplicate(df).collect()} == {None}
    assert op.deduplicate(empty).count() == 0 and op.keep_first(empty).count() == 0


def test_filter_goes_by_id_and_text(spark):
    """A copy without id, or with the id of another text, takes no clean text with it; of repeated rows one stays where asked."""
    rows = [(None, "a copy"), (1, "a copy"), (None, "clean"), (7, "also clean"), (7, "b"), (3, "b"), (9, "z"), (9, "z"), (None, "no id"), (None, "no  id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(1, "a copy"), (None, "clean"), (7, "also clean"), (3, "b"), (9, "z")]
    one = [tuple(r) for r in op.keep_first(df, repeats=False).collect()]
    assert sorted(one, key=str) == sorted([*want, (None, "no  id")], key=str)
    every = [tuple(r) for r in op.keep_first(df).collect()]
    assert sorted(every, key=str) == sorted([*want, (9, "z"), *[r for r in rows if "id" in r[1]]], key=str)
