"""Writers: a single file, several writes to one file, directories; modes and Parquet options.

Single files are for data that one task can write (a part file is renamed to its place); everything else goes to a directory,
in as many files as there are partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.column import elements, quoted
from lodestone.plans.schema import conform, find_type
from lodestone.sources import files

CREATE, OVERWRITE = "create", "overwrite"


@dataclass(frozen=True)
class WriteOptions:
    mode: str = CREATE
    compression: str = "snappy"
    dictionary: bool = True
    dictionary_page_size: int | None = None
    page_size: int | None = None
    row_group_size: int | None = None
    max_padding: int | None = None
    validation: bool = False
    #: ``INT96``, ``TIMESTAMP_MICROS`` or ``TIMESTAMP_MILLIS``.
    timestamp_type: str = "INT96"
    time_zone: str | None = None
    extra: dict = field(default_factory=dict)

    def parquet(self) -> dict[str, str]:
        out = {"compression": self.compression, "parquet.enable.dictionary": str(self.dictionary).lower(), "parquet.validation": str(self.validation).lower()}
        named = {"parquet.dictionary.page.size": self.dictionary_page_size, "parquet.page.size": self.page_size, "parquet.block.size": self.row_group_size, "parquet.writer.max-padding": self.max_padding}
        return out | {k: str(v) for k, v in named.items() if v is not None} | self.extra


@dataclass(frozen=True)
class Writer:
    spark: SparkSession
    schema: T.StructType | None = None
    opts: WriteOptions = WriteOptions()
    writer_fn: Callable[[DataFrame, str], None] | None = None

    def of(self, schema: T.StructType) -> Writer:
        """Data is conformed to the schema first."""
        return replace(self, schema=schema)

    generic = of

    def custom(self, writer_fn: Callable[[DataFrame, str], None]) -> Writer:
        return replace(self, writer_fn=writer_fn)

    def options(self, **opts) -> Writer:
        return replace(self, opts=replace(self.opts, **opts))

    def _ready(self, df: DataFrame) -> DataFrame:
        return conform(df, self.schema) if self.schema is not None else df

    def write_and_close(self, path: str, df: DataFrame) -> None:
        """One file at exactly this path."""
        if files.exists(self.spark, path) and self.opts.mode == CREATE:
            raise FileExistsError(path)
        df = self._ready(df)
        if self.writer_fn:
            self.writer_fn(df, path)
            return
        parent, _, name = path.rpartition("/")
        # Beside its place, so that renaming moves no data; hidden from readers.
        draft = f"{parent}/.{name}.{files.scratch(self.spark, 'x').rsplit('-', 1)[-1]}"
        try:
            self._parquet(df.coalesce(1), draft, "errorifexists")
            parts = [p for p in files.data_files(self.spark, draft) if p.endswith(".parquet")]
            if files.exists(self.spark, path):
                # The old file steps aside and goes when the new one is in its place: a crash leaves one of them.
                files.rename(self.spark, path, f"{draft}.old")
            files.rename(self.spark, parts[0], path)
        finally:
            files.delete(self.spark, draft)
            if files.exists(self.spark, path):
                files.delete(self.spark, f"{draft}.old")

    def build(self, path: str) -> IncrementalWriter:
        """A writer that takes chunks until it is closed."""
        return IncrementalWriter(self, path)

    def write_dataset(self, path: str, df: DataFrame, partition_by: tuple[str, ...] = (), max_records: int | None = None, defaults: dict[str, str] | None = None) -> None:
        """A directory. CREATE adds files to one that is there; OVERWRITE replaces what is there; a file in the way is an error to CREATE.

        Partition columns are text leaves, nested or not; they leave the data and name the directories in the order given.
        """
        validate_path(self.spark, path, self.opts.mode)
        df, names = lifted(self._ready(df), partition_by, defaults or {})
        if names:
            # A partition's rows come together, so files don't number tasks times partitions; adaptive execution splits large ones.
            df = df.hint("rebalance", *[F.col(quoted([n])) for n in names])
        self._parquet(df, path, "append" if self.opts.mode == CREATE else "overwrite", names, max_records)

    def _parquet(self, df: DataFrame, path: str, mode: str, partition_by: tuple[str, ...] = (), max_records: int | None = None) -> None:
        settings = {"spark.sql.parquet.outputTimestampType": self.opts.timestamp_type}
        if self.opts.time_zone:
            settings["spark.sql.session.timeZone"] = self.opts.time_zone
        before = {k: self.spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            out = df.write.mode(mode).options(**self.opts.parquet())
            if max_records:
                out = out.option("maxRecordsPerFile", max_records)
            (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


class IncrementalWriter:
    """Chunks are kept as plans and written as one file on closing."""

    def __init__(self, writer: Writer, path: str) -> None:
        if writer.opts.mode == CREATE and files.exists(writer.spark, path):
            raise FileExistsError(path)
        self.writer, self.path, self.chunks, self.closed = writer, path, [], False

    def write(self, df: DataFrame) -> IncrementalWriter:
        if self.closed:
            raise RuntimeError("the writer is closed")
        self.chunks.append(self.writer._ready(df))
        return self

    def close(self) -> None:
        if self.closed:
            return
        self.closed = True
        if self.chunks:
            whole = self.chunks[0]
            for more in self.chunks[1:]:
                whole = whole.unionByName(more)
            self.writer.write_and_close(self.path, whole)

    def __enter__(self) -> IncrementalWriter:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.close()


def validate_path(spark: SparkSession, path: str, mode: str) -> None:
    """Clears the way for a directory: OVERWRITE deletes a file or directory, CREATE fails on a file."""
    if files.is_file(spark, path):
        if mode == CREATE:
            raise FileExistsError(path)
        files.delete(spark, path)


def lifted(df: DataFrame, paths: tuple[str, ...], defaults: dict[str, str]) -> tuple[DataFrame, tuple[str, ...]]:
    """Partition leaves as columns of their own, named by their paths, and gone from the data. Null takes the default, or is an error."""
    from lodestone.functions import records

    names = tuple(".".join(elements(p)) for p in paths)
    values = []
    for path, name in zip(paths, names, strict=True):
        kind = find_type(df.schema, path)
        if kind is None:
            raise ValueError(f"there is no field {path} to partition by")
        if not isinstance(kind, T.StringType):
            raise ValueError(f"partition field {path} is {kind.simpleString()}, not text")
        value = F.col(quoted(elements(path)))
        other = F.lit(defaults[name]) if name in defaults else F.raise_error(F.lit(f"partition field {name} is null")).cast("string")
        # An empty value would be read back as null.
        values.append(F.when(value.isNull() | (value == ""), other).otherwise(value).alias(f"__part_{name}"))
    if not names:
        return df, ()
    df = df.select("*", *values)
    for path in paths:
        df = records.removed(df, path)
    if all(c.startswith("__part_") for c in df.columns):
        raise ValueError("partitioning takes all fields; none is left to write")
    return df.toDF(*[c.removeprefix("__part_") for c in df.columns]), names
