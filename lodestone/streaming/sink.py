"""A pass-through streaming sink: partitions, transforms and rotates Parquet files, then hands the batch on.

Each micro-batch is written as files of at most ``max_count`` records a partition and closed with the batch, so ``max_duration``
is the trigger's interval. A batch becomes visible file by file under names of its own number; a plan of those names is written first
and a mark last, so that a batch repeated after a failure replaces what it left, and one that was finished isn't written
again. What comes after (``then``) gets the batch's input once it is written, at least once.

Where ``max_count`` makes many small files of a batch, its records are counted first and shared out, so that a task writes a bounded number of
files. Which task a record goes to depends on the record alone, so a task that is repeated has the same records. Each task's last file may be a short one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.column import elements, quoted
from lodestone.plans.schema import conform
from lodestone.sources import files
from lodestone.sources.writer import OVERWRITE, Writer, lifted, validate_path

#: Records of a file, as many as a default row group's bytes; and seconds before a file is closed.
MAX_COUNT, MAX_DURATION = 134_217_728, 60.0
#: Files that a task writes, as long as these hold no more records than this. Fewer than the least would be short ones too often: larger files are left to the bytes of a task.
TASK_FILES, TASK_ROWS, LEAST_FILES = 64, 100_000, 8
#: The log's folder, and the column that names the folders of a draft's tasks (no hidden ones).
_LOG, _TASK = "_lodestone_log", "lodestone-task"
#: Values of the partition columns and the number of their records.
Counts = list[tuple[tuple[str, ...], int]]


@dataclass(frozen=True)
class PostWriteState:
    """What a handler is told: the batch's input, records by partition path, and a flush, which has nothing to do: files are closed."""

    batch: DataFrame
    counts: Mapping[str, int]

    def flush(self, path: str) -> None:
        return None


@dataclass(frozen=True)
class ViaParquet:
    spark: SparkSession
    schema: T.StructType | None = None
    count: int = MAX_COUNT
    duration: float = MAX_DURATION
    partitions: tuple[str, ...] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)
    transform: Callable[[DataFrame], DataFrame] | None = None
    handler: Callable[[PostWriteState], None] | None = None
    partition_fn: Callable[[DataFrame], DataFrame] | None = None
    writer: Writer | None = None

    def of(self, schema: T.StructType) -> ViaParquet:
        return replace(self, schema=schema)

    generic = of

    def custom(self, writer: Writer) -> ViaParquet:
        """Brings its own writer options."""
        return replace(self, writer=writer)

    def max_count(self, n: int) -> ViaParquet:
        if n <= 0:
            raise ValueError("max_count must be positive")
        return replace(self, count=n)

    def max_duration(self, seconds: float) -> ViaParquet:
        return replace(self, duration=seconds)

    def partition_by(self, *paths: str) -> ViaParquet:
        return replace(self, partitions=tuple(paths))

    def partition_using(self, fn: Callable[[DataFrame], DataFrame], *names: str) -> ViaParquet:
        """``fn`` makes the partition columns ``names``."""
        return replace(self, partition_fn=fn, partitions=tuple(names))

    def default_partition(self, defaults: Mapping[str, str]) -> ViaParquet:
        return replace(self, defaults=dict(defaults))

    def pre_write_transformation(self, fn: Callable[[DataFrame], DataFrame]) -> ViaParquet:
        """From input records to any number of written ones."""
        return replace(self, transform=fn)

    def post_write_handler(self, fn: Callable[[PostWriteState], None]) -> ViaParquet:
        return replace(self, handler=fn)

    def options(self, **opts) -> ViaParquet:
        return replace(self, writer=(self.writer or Writer(self.spark)).options(**opts))

    def write(self, stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, available_now: bool = False) -> StreamingQuery:
        writer = self.writer or Writer(self.spark)
        validate_path(self.spark, path, writer.opts.mode)
        if writer.opts.mode == OVERWRITE and not files.exists(self.spark, checkpoint):
            files.delete(self.spark, path)

        def each(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                counts = self._batch(batch, number, path, writer)
                if self.handler:
                    self.handler(PostWriteState(batch, counts))
                if then:
                    then(batch, number)
            finally:
                batch.unpersist()

        out = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=f"{max(1, int(self.duration * 1000))} milliseconds")).start()

    def shaped(self, batch: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
        """What is written of a batch, and its partition columns."""
        df = self.transform(batch) if self.transform else batch
        if self.partition_fn:
            df = self.partition_fn(df)
        if self.schema is not None:
            df = conform(df, self.schema)
        return lifted(df, self.partitions, dict(self.defaults))

    def _shared(self, df: DataFrame, names: tuple[str, ...], counts: Counts) -> DataFrame | None:
        """The records in the tasks that write them, None if one is enough."""
        task_files = min(TASK_FILES, TASK_ROWS // self.count)
        task_rows = task_files * self.count
        if not names:
            tasks = math.ceil(counts[0][1] / task_rows)
            return df.repartition(tasks) if tasks > 1 else None
        # Values with more records than a task's are cut by a hash into slices, a task each; whole values share the tasks before these.
        first = math.ceil(sum(math.ceil(n / self.count) for _, n in counts if n <= task_rows) / task_files)
        large, tasks = [], first
        for value, n in counts:
            if n > task_rows:
                large.append((*value, tasks, math.ceil(n / task_rows)))
                tasks += large[-1][-1]
        if tasks <= 1:
            return None
        keys = [f"__value{i}" for i in range(len(names))]
        slices = df.sparkSession.createDataFrame(large, ", ".join([*(f"{k} string" for k in keys), "__first int", "__slices int"]))
        same = [F.col(quoted([n])) == F.col(k) for n, k in zip(names, keys, strict=True)]
        by_value, by_record = F.xxhash64(*[F.col(quoted([n])) for n in names]), F.xxhash64(*[_hashable(f) for f in df.schema.fields])
        task = F.when(F.col("__slices").isNull(), F.pmod(by_value, F.lit(max(first, 1)))).otherwise(F.col("__first") + F.pmod(by_record, F.col("__slices")))
        return df.join(F.broadcast(slices), same, "left").repartitionById(tasks, task.cast("int")).select(*[F.col(quoted([c])) for c in df.columns])

    def _drafted(self, df: DataFrame, names: tuple[str, ...], counts: Counts | None, draft: str, writer: Writer) -> list[str]:
        """Writes a draft; its files by their places."""
        shared = self._shared(df, names, counts) if counts is not None else None
        if shared is None:
            ready = df.hint("rebalance", *[F.col(quoted([n])) for n in names]) if names else df
            writer._parquet(ready, draft, "overwrite", names, self.count)
        else:
            # Each task has a folder of its own, which the job's commit renames as a whole.
            writer._parquet(shared.withColumn(_TASK, F.spark_partition_id()), draft, "overwrite", (_TASK, *names), self.count)
        return [p for p in files.leaves(self.spark, draft, len(names) + (shared is not None)) if p.endswith(".parquet")]

    def _batch(self, batch: DataFrame, number: int, path: str, writer: Writer) -> dict[str, int]:
        df, names = self.shaped(batch)
        log = f"{path}/{_LOG}/{number}"
        done = files.exists(self.spark, f"{log}.done")
        small = self.count * LEAST_FILES <= TASK_ROWS and not done
        counts = _counted(df, names) if small or self.handler else None
        if not done:
            if files.exists(self.spark, f"{log}.plan"):
                files.delete_all(self.spark, path, [f"{path}/{name}" for name in json.loads(_read(self.spark, f"{log}.plan"))])
            draft = f"{path}/_draft-{number}"
            files.delete(self.spark, draft)
            moves = {}
            for k, f in enumerate(self._drafted(df, names, counts if small else None, draft, writer)):
                *folders, name = f.rsplit(f"/_draft-{number}/", 1)[1].split("/")
                moves[f] = "/".join([*folders[len(folders) - len(names) :], f"b{number:08d}-{k:05d}{name[name.index('.'):]}"])
            _create(self.spark, f"{log}.plan", json.dumps(sorted(moves.values())))
            files.rename_all(self.spark, path, {old: f"{path}/{new}" for old, new in moves.items()})
            files.delete(self.spark, draft)
            _create(self.spark, f"{log}.done", "")
        if not self.handler:
            return {}
        return {path + "".join(f"/{n}={v}" for n, v in zip(names, value, strict=True)): n_rows for value, n_rows in counts}


def _counted(df: DataFrame, names: tuple[str, ...]) -> Counts:
    if not names:
        return [((), df.count())]
    return [(tuple(r)[:-1], r[-1]) for r in df.groupBy(*[F.col(quoted([n])) for n in names]).count().collect()]


def _hashable(field: T.StructField) -> Column:
    """A column that can be hashed: maps and variants have no hash of their own."""
    column = F.col(quoted([field.name]))
    return column.cast("string") if any(kind in field.dataType.simpleString() for kind in ("map<", "variant")) else column


def _create(spark: SparkSession, path: str, text: str) -> None:
    fs, p = files.fs_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str:
    fs, p = files.fs_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
