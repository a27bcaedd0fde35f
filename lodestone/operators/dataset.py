"""Datasets: DataFrames with join, concatenation and statistics semantics.

Joins match null keys with null keys. Where both sides have a column of one name the right side's value wins, at the left side's
place, and is null on left rows without a match.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.column import Col, elements, quoted
from lodestone.functions.filters import Filter, RecordFilter, scope_of
from lodestone.plans.schema import conform, find_type


class Dataset:
    """A lazy dataset; everything but ``size``, ``min``, ``max`` and writing only makes a plan."""

    def __init__(self, df: DataFrame, partitions: tuple[str, ...] = ()) -> None:
        self.df, self.partitions = df, tuple(partitions)

    @classmethod
    def in_memory(cls, spark: SparkSession, rows, schema: T.StructType) -> Dataset:
        from lodestone.sources.memory import in_memory

        return cls(in_memory(spark, rows, schema))

    def as_(self, schema: T.StructType) -> Dataset:
        """The same records decoded to another schema."""
        return Dataset(conform(self.df, schema), self.partitions)

    def where(self, predicate: Filter) -> Dataset:
        if isinstance(predicate, RecordFilter):
            return Dataset(self.df.where(predicate.predicate(F.col("_metadata.row_index"))), self.partitions)
        return Dataset(self.df.where(predicate.compile(scope_of(self.df.schema, frozenset(self.partitions)))), self.partitions)

    def select(self, *columns: Col) -> Dataset:
        from lodestone.sources.reader import project

        return Dataset(project(self.df, tuple(columns)))

    def inner_join(self, right: Dataset, on_left: str | Col, on_right: str | Col, build_right: bool = False) -> Dataset:
        return join(self, right, on_left, on_right, "inner", build_right)

    def left_join(self, right: Dataset, on_left: str | Col, on_right: str | Col, build_right: bool = False) -> Dataset:
        return join(self, right, on_left, on_right, "left", build_right)

    def right_join(self, right: Dataset, on_left: str | Col, on_right: str | Col, build_right: bool = False) -> Dataset:
        return join(self, right, on_left, on_right, "right", build_right)

    def full_join(self, right: Dataset, on_left: str | Col, on_right: str | Col, build_right: bool = False) -> Dataset:
        return join(self, right, on_left, on_right, "full", build_right)

    def concat(self, other: Dataset) -> Dataset:
        """All records of both; fields that one lacks are null there."""
        return Dataset(self.df.unionByName(other.df, allowMissingColumns=True))

    def size(self) -> int:
        return self.df.count()

    def min(self, path: str) -> Any:
        return self._extreme(F.min, path)

    def max(self, path: str) -> Any:
        return self._extreme(F.max, path)

    def _extreme(self, how, path: str) -> Any:
        if find_type(self.df.schema, path) is None:
            return None
        return self.df.agg(how(F.col(quoted(elements(path)))).alias("v")).first()["v"]

    def write_and_close(self, path: str, **options) -> None:
        """One file."""
        from lodestone.sources.writer import Writer

        Writer(self.df.sparkSession).options(**options).write_and_close(path, self.df)

    def write_dataset(self, path: str, partition_by: tuple[str, ...] = (), **options) -> None:
        """A directory."""
        from lodestone.sources.writer import Writer

        Writer(self.df.sparkSession).options(**options).write_dataset(path, self.df, partition_by)


def _key(df: DataFrame, path: str | Col) -> tuple[str, ...]:
    name = path.path if isinstance(path, Col) else path
    if find_type(df.schema, name) is None:
        raise ValueError(f"invalid join path: {name}")
    return elements(name)


def join(left: Dataset, right: Dataset, on_left: str | Col, on_right: str | Col, how: str, build_right: bool = False) -> Dataset:
    """An equi-join on one path of each side. ``build_right`` asks for a hash join that builds the right side; else the optimizer chooses."""
    l, r = left.df, right.df
    key_l, key_r = _key(l, on_left), _key(r, on_right)
    # Both sides get names of their own, so that neither clashes nor a self-join are ambiguous.
    l2 = l.toDF(*[f"__l{i}" for i in range(len(l.columns))])
    r2 = r.toDF(*[f"__r{i}" for i in range(len(r.columns))])
    at = {f"l:{c}": f"__l{i}" for i, c in enumerate(l.columns)} | {f"r:{c}": f"__r{i}" for i, c in enumerate(r.columns)}

    def key(side: str, path: tuple[str, ...]) -> Column:
        return F.col(quoted([at[f"{side}:{path[0]}"], *path[1:]]))

    if build_right:
        # A broadcast can't build the right side of a right or full join; a shuffled hash join can. Its size is the caller's to know.
        r2 = r2.hint("shuffle_hash")
    out = l2.join(r2, key("l", key_l).eqNullSafe(key("r", key_r)), how)
    names = [F.col(at[f"r:{c}"] if c in r.columns else at[f"l:{c}"]).alias(c) for c in l.columns]
    names += [F.col(at[f"r:{c}"]).alias(c) for c in r.columns if c not in l.columns]
    return Dataset(out.select(*names))
