"""Readers of Parquet files and Hive trees.

A reader is an immutable builder: what to read (all fields as a schema, a projection, generically), a filter, options. Reading gives a lazy
:class:`~lodestone.operators.dataset.Dataset`. Filters come before projections, so a filter column need not be selected, and
reach the scan as Catalyst expressions; columns are pruned by Catalyst.

Partition values are text, whatever they look like, and are URL-decoded as UTF-8 with ``+`` as space. Names with dots become
nested fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.codecs import to_type
from lodestone.functions.column import Col, elements, quoted
from lodestone.functions.filters import NOOP, Filter, Noop, RecordFilter, scope_of
from lodestone.operators.dataset import Dataset
from lodestone.plans.schema import Codec, conform, find_type
from lodestone.sources import files
from lodestone.sources.memory import InMemoryFile

_INFER = "spark.sql.sources.partitionColumnTypeInference.enabled"
_PLAIN = re.compile(r"[A-Za-z0-9._ -]*")


@dataclass(frozen=True)
class ReadOptions:
    """Options of one read; none outlives it. ``time_zone`` is that of a session of the dataset's own; vectored IO and Hadoop settings go to the scan;
    ``nanos_as_long`` reads INT64 nanoseconds as numbers."""

    time_zone: str | None = None
    vectored_io: bool | None = None
    nanos_as_long: bool = False
    hadoop: Mapping[str, str] = field(default_factory=dict)
    read: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Reader:
    spark: SparkSession
    kind: str = "generic"
    schema: T.StructType | None = None
    columns: tuple[Col, ...] = ()
    predicate: Filter = NOOP
    opts: ReadOptions = ReadOptions()
    codecs: Mapping[str, Codec] | None = None
    reader_fn: Callable[[SparkSession, str], DataFrame] | None = None

    def as_(self, schema: T.StructType, codecs: Mapping[str, Codec] | None = None) -> Reader:
        """All columns, decoded to a schema: optional fields may be missing, numbers are coerced."""
        return replace(self, kind="as", schema=schema, codecs=codecs)

    def projected_as(self, schema: T.StructType) -> Reader:
        """Only the schema's fields, nested ones too; a field that is missing is an error."""
        return replace(self, kind="projected_as", schema=schema)

    def generic(self) -> Reader:
        return replace(self, kind="generic")

    def projected_generic(self, *what: Col | T.StructType) -> Reader:
        """By columns with types and aliases, or by a schema."""
        if len(what) == 1 and isinstance(what[0], T.StructType):
            return replace(self, kind="projected_as", schema=what[0])
        return replace(self, kind="columns", columns=tuple(what))

    def custom(self, reader_fn: Callable[[SparkSession, str], DataFrame]) -> Reader:
        """Brings its own scan: ``reader_fn(spark, path)``."""
        return replace(self, reader_fn=reader_fn)

    def filter(self, predicate: Filter) -> Reader:
        return replace(self, predicate=predicate)

    def options(self, **opts) -> Reader:
        return replace(self, opts=replace(self.opts, **opts))

    def read(self, path: str | InMemoryFile, read_map: Callable[[DataFrame], DataFrame] | None = None) -> Dataset:
        """``read_map`` is applied to the records as they are read."""
        if isinstance(path, InMemoryFile):
            path = path.materialized(self.spark)
        if self.opts.time_zone:
            return replace(self, spark=_zoned(self.spark, self.opts.time_zone), opts=replace(self.opts, time_zone=None)).read(path, read_map)
        df, partitions = (self.reader_fn(self.spark, path), ()) if self.reader_fn else self._scan(path)
        return Dataset(self._shaped(read_map(df) if read_map else df, partitions), partitions)

    def stream(self, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> Dataset:
        """An unbounded read of the files that come to a directory."""
        reader = self.spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return Dataset(self._shaped(reader.parquet(path), ()), ())

    def read_files(self, path: str) -> list[tuple[str, Dataset]]:
        """Each file's own dataset, in the order of their names; lazy, one scan each."""
        return [(f, self.read(f)) for f in files.data_files(self.spark, path)]

    def read_by_file(self, path: str, name: str = "file") -> Dataset:
        """All files' records in one scan, with the file that each comes from: to work file by file without a list of files on the driver."""
        df, partitions = self._scan(path)
        return Dataset(self._shaped(df.withColumn(name, F.col("_metadata.file_path")), partitions), partitions)

    def _shaped(self, df: DataFrame, partitions: tuple[str, ...]) -> DataFrame:
        if not isinstance(self.predicate, Noop):
            if not df.columns:
                return df
            if isinstance(self.predicate, RecordFilter):
                df = df.where(self.predicate.predicate(F.col("_metadata.row_index")))
            else:
                df = df.where(self.predicate.compile(scope_of(df.schema, frozenset(partitions))))
        if self.kind == "as":
            return conform(df, self.schema, self.codecs)
        if self.kind == "projected_as":
            return conform(df, T.StructType([T.StructField(f.name, _optional(f.dataType), True) for f in self.schema.fields]), strict=True) if df.columns else conform(df, self.schema)
        if self.kind == "columns":
            return project(df, self.columns)
        return df

    def _scan(self, path: str) -> tuple[DataFrame, tuple[str, ...]]:
        spark = self.spark
        scan = dict(self.opts.hadoop)
        if self.opts.vectored_io is not None:
            scan["parquet.hadoop.vectored.io.enabled"] = str(self.opts.vectored_io).lower()
        reader = spark.read.options(**{**scan, **self.opts.read})
        before = {k: spark.conf.get(k, None) for k in (_INFER, "spark.sql.legacy.parquet.nanosAsLong")}
        spark.conf.set(_INFER, "false")
        if self.opts.nanos_as_long:
            spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        try:
            try:
                df = reader.parquet(path)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" in str(e):
                    raise
                leaves = files.partition_leaves(spark, path)
                if not leaves:
                    return spark.createDataFrame([], self.schema or T.StructType([])), ()
                df = reader.option("basePath", path).parquet(*[p for p, _ in leaves])
            except Exception as e:  # a tree that Spark's listing refuses is an assertion in the JVM
                if "onflicting" not in str(e) and "CONFLICTING" not in str(e):
                    raise
                df = reader.option("basePath", path).parquet(*[p for p, _ in files.partition_leaves(spark, path)])
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        names = _partition_names(df)
        return _partitioned(df, names), names


def _zoned(spark: SparkSession, zone: str) -> SparkSession:
    """A session like this one but for its time zone."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.session.timeZone", zone)
    return own


def _optional(kind: T.DataType) -> T.DataType:
    """A type whose parts may all be null."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _optional(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_optional(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _optional(kind.valueType), True)
    return kind


def _partition_names(df: DataFrame) -> tuple[str, ...]:
    """Partition columns, from the scan's own relation."""
    plan = df._jdf.queryExecution().analyzed()
    schema = plan.collectLeaves().head().relation().partitionSchema()
    return tuple(schema.fieldNames())


def _partitioned(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    if not names:
        return df
    # Only values that Spark reads otherwise than URLDecoder are taken from paths; other trees keep partition pruning.
    index = df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    folders = index.partitionSpec().partitions().mkString("/\n") + "/"
    odd = [n for n in names if any(not _PLAIN.fullmatch(v) for v in set(re.findall(rf"/{re.escape(n)}=([^/\n]*)/", folders.replace(")/", "/"))))]
    for n in odd:
        raw = F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(n)}=([^/]*)/", 1)
        # The path is URI-encoded once more; null stays null.
        df = df.withColumn(n, F.when(F.col(quoted([n])).isNotNull(), F.url_decode(F.url_decode(F.regexp_replace(raw, r"\+", "%2B")))))
    dotted = [n for n in names if "." in n]
    for n in dotted:
        head, *rest = elements(n)
        df = _nested(df, head, rest, F.col(quoted([n]))).drop(quoted([n]).strip("`")) if head in df.columns else _new_nested(df, n, head, rest)
    return df


def _nested(df: DataFrame, head: str, rest: list[str], value: Column) -> DataFrame:
    from lodestone.functions import records

    return records.updated(df, ".".join([head, *rest]), value)


def _new_nested(df: DataFrame, name: str, head: str, rest: list[str]) -> DataFrame:
    value = F.col(quoted([name]))
    for part in reversed(rest):
        value = F.struct(value.alias(part))
    return df.select(*[F.col(quoted([c])) for c in df.columns if c != name], value.alias(head))


def project(df: DataFrame, columns: tuple[Col, ...]) -> DataFrame:
    """Columns by path, cast and renamed. A path listed twice has the type that it is first given."""
    types: dict[tuple[str, ...], T.DataType] = {}
    out = []
    for c in columns:
        have = find_type(df.schema, c.path)
        if have is None:
            raise ValueError(f"invalid column projection: {c.path}")
        if c.type is not None:
            types.setdefault(c.elements, c.type)
        want = types.get(c.elements)
        value = F.col(quoted(c.elements))
        out.append((value if want is None or want == have else to_type(value, have, want)).alias(c.output))
    return df.select(*out)
