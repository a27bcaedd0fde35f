import pytest

import corpus_pipeline
from lodestone.llm import op02_toxicity as op2
from lodestone.llm import op05_sentencepiece as op5

from .conftest import SCHEMA
from .test_exact_dedup import by_hand as exact
from .test_minhash_forest import by_hand as near
from .test_mixing import counts_by_hand


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    extra = [(2000 + i, f"plain words number {i} with awful rotten stuff {i}" if i % 4 == 0 else f"plain words number {i} with good stuff {i} today", "en", "s1", 9) for i in range(80)]
    rows = [r for r in corpus if r[0] is not None and r[0] != 5] + extra
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(2000 + i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_and_columns(spark, sf_dir):
    path, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert [c for c, _ in stage(spark, docs, path).dtypes] == docs.columns


def test_same_as_by_hand(spark, sf_dir):
    path, rows = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = op2.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scorer = model.scorer()
    import numpy as np

    rows = [r for r in rows if not model.at_least(np.array([scorer.text(r[1])]))[0, 0] > model.reject]
    assert not any("awful" in (r[1] or "") for r in rows)
    kept = {r[0] for r in exact(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    components = near([(r[0], r[1]) for r in rows], 5, 80)
    rows = [r for r in rows if components[r[0]][1] == r[0]]
    copies = counts_by_hand(rows)
    encoder = op5.Encoder(op5.Pieces.load(op5.MODEL))
    want = []
    for doc_id, text, *_ in rows:
        ids = None if text is None else np.frombuffer(encoder.encode([text])[0], np.int32).tolist()
        want += [(doc_id, ids)] * copies[doc_id]
    got = [(r.doc_id, r.ids) for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
