"""Statistics of datasets: count, minimum, maximum, under a filter and a projection.

What is asked together is computed in one pass with partial sums; only the columns asked for are read. Without a filter, a count and the extremes of
whole-number, date and boolean columns come from the files' footers (text, decimals, times and floating point have no exact extremes there); files whose
footers lack them are scanned.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.column import elements, quoted
from lodestone.functions.filters import NOOP, Filter, Noop
from lodestone.operators.dataset import Dataset
from lodestone.plans.schema import find_type


@dataclass(frozen=True)
class StatsBuilder:
    spark: SparkSession
    predicate: Filter = NOOP
    schema: T.StructType | None = None
    opts: dict | None = None

    def filter(self, predicate: Filter) -> StatsBuilder:
        return replace(self, predicate=predicate)

    def projection(self, schema: T.StructType) -> StatsBuilder:
        return replace(self, schema=schema)

    def options(self, **opts) -> StatsBuilder:
        return replace(self, opts=opts)

    def stats(self, path) -> Stats:
        from lodestone.sources.reader import Reader

        reader = Reader(self.spark).filter(self.predicate).options(**(self.opts or {}))
        if self.schema is not None:
            reader = reader.projected_as(self.schema)
        plain = isinstance(self.predicate, Noop) and self.schema is None and not self.opts and isinstance(path, str)
        return Stats(reader.read(path), path if plain else None)


_IN_FOOTERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)
_FOOTER_SCAN = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.partitionColumnTypeInference.enabled": "false"}


class Stats:
    """``path``: where the dataset's files are, if it is all of them as they are."""

    def __init__(self, dataset: Dataset, path: str | None = None) -> None:
        self.dataset, self.path = dataset, path

    def record_count(self) -> int:
        return self.summary().first()["record_count"]

    def min(self, path: str) -> Any:
        """Nulls aside; None if there is no value or no such column."""
        return self.summary(path).first()[1]

    def max(self, path: str) -> Any:
        return self.summary(path).first()[2]

    def summary(self, *paths: str) -> DataFrame:
        """A one-row DataFrame: record_count, and min_ and max_ of each path (dots as underscores)."""
        return self.from_footers(*paths) or self._aggregated(self.dataset.df, paths)

    @staticmethod
    def _aggregated(df: DataFrame, paths: tuple[str, ...]) -> DataFrame:
        out = [F.count(F.lit(1)).alias("record_count")]
        for p in paths:
            known = find_type(df.schema, p) is not None
            c = F.col(quoted(elements(p))) if known else F.lit(None)
            name = "_".join(elements(p))
            out += [F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}")]
        return df.agg(*out)

    def footer_plan(self, *paths: str) -> DataFrame | None:
        """The summary as a plan over footers, or None where they don't say it."""
        df, partitions = self.dataset.df, self.dataset.partitions
        plain = all(len(elements(p)) == 1 and p not in partitions and isinstance(find_type(df.schema, p), _IN_FOOTERS) for p in paths)
        if self.path is None or partitions or not df.columns or not plain:
            return None
        conf = df.sparkSession.conf
        before = {k: conf.get(k, None) for k in _FOOTER_SCAN}
        try:
            for k, v in _FOOTER_SCAN.items():
                conf.set(k, v)
            out = self._aggregated(df.sparkSession.read.parquet(self.path), paths)
            # Planned here, while the settings hold.
            out._jdf.queryExecution().executedPlan()
            return out
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def from_footers(self, *paths: str) -> DataFrame | None:
        plan = self.footer_plan(*paths)
        if plan is None:
            return None
        try:
            return plan.sparkSession.createDataFrame(plan.collect(), plan.schema)
        except Exception as e:
            # All-null columns and files by other writers may have no extremes in their footers.
            if "FAILED_READ_FILE" not in str(e) and "No min/max found" not in str(e):
                raise
            return None
