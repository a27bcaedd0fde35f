"""What the corpus operators share: shared-folder tables, size-checked joins, batches of text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 64 << 20
_RUN = uuid.uuid4().hex


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and all runs on this machine, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestone-{_RUN}"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder. The run's folder goes when the driver ends."""
    root = shared_root(spark)
    if root not in _known:
        _known.add(root)
        atexit.register(remove, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


_known: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path by the file system that it names; a session that has ended leaves it to the cluster."""
    jsc = getattr(spark.sparkContext, "_jsc", None)
    if jsc is None or spark.sparkContext._jvm is None:
        return
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(jsc.hadoopConfiguration()).delete(hadoop, True)
    except (OSError, RuntimeError):
        return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: lineage is cut, and any executor can be lost after."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast if ``rows`` (counted here if not given) of ``row_bytes`` fit in ``limit``; else a shuffled join stays."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= limit else df


def fold_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def hash_sample(df: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """About ``rows`` rows chosen by hash of id and text. Rows that share both fall together and are taken once, so no repeated row or null id exceeds ``rows``."""
    total = df.count()
    if not total:
        return df
    at = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)), F.lit(1 << 40))
    return df.where(at < F.lit(min(1 << 40, (rows << 40) // total))).dropDuplicates([id_col, text_col])


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them where a table has a column so named."""
    taken, out = {c.lower() for c in columns}, []
    for own in names:
        while own.lower() in taken:
            own = "_" + own
        taken.add(own.lower())
        out.append(own)
    return out


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """A hash over those of the columns that can be hashed, to order rows by."""
    types = dict(df.dtypes)
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns if not any(x in types[c] for x in ("map<", "variant"))])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Groups with over a thousandth of all rows number fewer than this; a broadcast of them has a fixed bound.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Joins each row to its group's row. ``size`` is the group's count of rows: the few heavy groups are broadcast, the others shuffled."""
    heavy_at = max(rows.count() // HEAVY, 1)
    heavy, light = groups.where(F.col(size) > heavy_at), groups.where(F.col(size) <= heavy_at)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rest.join(light, key).unionByName(rows.join(F.broadcast(heavy), key))


#: Bytes of the batches that Spark sends to a Python worker, if the session does not say.
BATCH_BYTES = 16 << 20


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes as well as by rows; a row is never cut."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


#: Text bytes that a Python worker takes from a batch at a time.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch by runs of rows of at most ``limit`` bytes in a text column, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, before = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, before = hi, int(ends[hi - 1])
