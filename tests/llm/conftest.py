import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use for their own.
CLASHES = ("digest", "kept", "n", "copy", "label", "tree", "key", "word", "segment", "group_size", "score", "rows", "norm", "at", "__id")


def prose(rng, words=60, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, hot groups and all odd cases."""
    rng = random.Random(5)
    rows, base = [], [prose(rng) for _ in range(40)]
    langs = {"en": "the and of to in is that it was for ", "fr": "le la les des une est que pour dans sur "}
    for i in range(160):
        lang = ("en", "fr")[i % 2]
        text = base[i % 40] if i < 60 else prose(rng, rng.randint(1, 90))
        if 60 <= i < 90:  # near copies of a long text
            words = base[i % 5].split()
            words[rng.randrange(len(words))] = f"edit{i}"
            text = " ".join(words)
        if 90 <= i < 130:  # a hot group of exact copies but for white space
            text = base[0].replace(" ", "  " if i % 2 else "\n")
        rows.append((i, f"{langs[lang]}{text}" if i >= 130 else text, lang, "hot" if i % 3 == 0 else f"s{i % 4}", len(text)))
    odd = [
        (1000, None, "en", "s1", None), (1001, "", None, None, 0), (1002, " \n\t ", "fr", "s1", 4), (None, "no id here", "en", "s2", 10), (1003, "one", "en", "s2", 3),
        (1004, "two words", "fr", None, 9), (1005, "ab" * 40_000, "en", "s3", 80_000), (1006, "long " * 30_000, "en", "s3", 150_000), (1007, "日本語 и 🙂 ▁ x\x0by\x1fz", None, "s3", 20),
        (1008, "12345 !!! 67", "en", "s3", 12), (5, base[5], "fr", "s1", 1), (5, base[5], "fr", "s1", 1),
    ]
    return rows + odd


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    """The corpus as a Parquet table, with columns of clashing names."""
    path = f"file://{tmp_path_factory.mktemp('corpus')}/documents.parquet"
    df = spark.createDataFrame(corpus, SCHEMA).repartition(3, "doc_id")
    for c in CLASHES:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
