"""A corpus pipeline of five stages: toxic documents and copies go, sources are mixed, what stays is tokenized.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Cases, of every stage. Empty table: empty result. Extra columns, whatever their names: kept by all but the last stage. Very long texts: whole.
Null text: as empty; never toxic, of one group with other texts without words where copies are told, repeated at its source's rate, no ids of pieces.
Null id: never dropped by near copies, as such rows are linked with nothing. What each stage does with ties, repeated rows and shared ids is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common
from lodestone.llm import op02_toxicity as op2
from lodestone.llm import op03_mixing as op3
from lodestone.llm import op05_sentencepiece as op5
from lodestone.llm import op06_exact_dedup as op6
from lodestone.llm import op08_minhash_forest as op8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Each row is judged by its own text, repeated rows alike; ids only lead to labels, and a null id to none.

    A probability that ties with the cut stays. No labels: all rows stay.
    """
    return op2.without_toxic(docs, op2.train(docs, common.table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the same text: the longest, then that of the smallest id, a null id last.

    Of repeated rows, and of rows that share id and text, one stays; rows that share an id alone are told apart by text.
    """
    return op6.keep_first(docs, repeats=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; the smallest id stays.

    Rows without words stay. Of rows that share id and set one stays; rows that share an id alone are told apart by their sets.
    """
    return op8.keep_first(docs, words=5, per_cent=80, repeats=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights, shuffled. A null source is one of its own; rows that share an id share their count."""
    return op3.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids of pieces: a row for each row, with doc_id, ids, n_ids and round_trip."""
    return op5.tokenize(docs, op5.Pieces.load(op5.MODEL))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", tokens)]

#: The fitted and the hashed stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written in the shared folder before the next reads it."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
