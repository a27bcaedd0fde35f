"""Datasets and Parquet files in memory, for small data."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.sources import files


def in_memory(spark: SparkSession, rows: Iterable | Callable[[], Iterable], schema: T.StructType) -> DataFrame:
    """A DataFrame over rows, or over what a function gives."""
    return spark.createDataFrame(list(rows() if callable(rows) else rows), schema)


class InMemoryFile:
    """A Parquet file's bytes. Writing again before ``take`` is an error."""

    def __init__(self, data: bytes | None = None) -> None:
        self.data = data

    def write(self, df: DataFrame) -> None:
        if self.data is not None:
            raise FileExistsError("the file holds data; take() it first")
        from lodestone.sources.writer import Writer

        spark = df.sparkSession
        path = files.scratch(spark, "memory") + ".parquet"
        Writer(spark).write_and_close(path, df)
        fs, p = files.fs_path(spark, path)
        stream = fs.open(p)
        try:
            self.data = bytes(stream.readAllBytes())
        finally:
            stream.close()
            files.delete(spark, path)

    def take(self) -> bytes:
        """The bytes; the file is empty after."""
        if self.data is None:
            raise ValueError("nothing was written")
        data, self.data = self.data, None
        return data

    def materialized(self, spark: SparkSession) -> str:
        """A path that Spark can read, in the shared scratch folder."""
        if self.data is None:
            raise ValueError("nothing was written")
        path = files.scratch(spark, "memory") + ".parquet"
        fs, p = files.fs_path(spark, path)
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        out.write(bytearray(self.data))
        out.close()
        return path
