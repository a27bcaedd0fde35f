"""Exact dedup as a stateful stream over digests, DataFrame operations only.

A first scan derives from each text a SHA-256 digest of its normal form, its length in code points, its
stable id and a locator of its content (file and row, where the scan knows them). These small rows are
streamed through a keyed aggregation whose state lies in RocksDB, on disk, and never expires: for each
digest it retains the member count and the identity and locator of the row to keep. Several micro-batches
may feed it; each emits the digests that it changed, and the last version of a digest holds.

On hits (digests with two rows or more) the full bytes are compared: the texts of hits alone are grouped by
digest and whole normal form. The grouping combines before its shuffle, so a text with a third of all rows
travels once per task. Digests under which different texts meet are split by their texts.

Cases. Null text: as empty. Null id: loses ties to every other id. Repeated rows: each counts as a member;
rows that share id and text share their fate, and :func:`keep_first` can hold them to one. Ties: the smallest id stays. Empty table: empty result. Only the id and
text columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # What a task has committed lies in the shared checkpoint; its local files go at once.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Groups with over a thousandth of all rows number fewer than this; a broadcast of them has a fixed bound.
HEAVY = 1000


def normal_form(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _keys(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [F.col(id_col).alias("doc_id"), digest(normal_form(text)).alias("digest"), F.char_length(text).cast("long").alias("n_points")]
    try:
        return docs.select(*base, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("locator"))
    except AnalysisException:
        return docs.select(*base, F.lit(None).cast("string").alias("locator"))


def _rank(doc_id: Column, n_points: Column, locator: Column) -> Column:
    """Smallest first: most code points, then a non-null id, then the smallest."""
    return F.struct((-n_points).alias("points"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), locator.alias("locator"))


def stream_groups(spark: SparkSession, keys_path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Runs the stateful stream over the files at ``keys_path`` to its end: one row for each digest."""
    out = common.shared_path(spark, "dedup-state-out")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(keys_path).groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(_rank(F.col("doc_id"), F.col("n_points"), F.col("locator"))).alias("best")
    )

    def emit(batch: DataFrame, epoch: int) -> None:
        # Overwriting the epoch's own folder makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").foreachBatch(emit)
            .option("checkpointLocation", common.shared_path(spark, "dedup-stream")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not query.recentProgress or not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], state.schema)
    emitted = spark.read.schema(T.StructType([*state.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(out)
    if len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 1:
        return emitted.drop("epoch")
    last = emitted.groupBy("digest").agg(F.max("epoch").alias("epoch"))
    return emitted.join(last, ["digest", "epoch"]).drop("epoch")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, keep_locator.

    ``digest`` may be any deterministic string of the normal form; texts are told apart by their bytes, so a weak
    one costs time and not correctness.
    """
    spark = docs.sparkSession
    schema = _keys(docs, id_col, text_col, digest).schema
    keys_path = common.shared_path(spark, "dedup-keys")
    _keys(docs, id_col, text_col, digest).write.parquet(keys_path)
    keys = spark.read.schema(schema).parquet(keys_path)
    groups = common.materialize(stream_groups(spark, keys_path, schema, files_per_batch), "dedup-groups")

    hits = groups.where("group_size > 1").select("digest")
    n_hits = hits.count()
    clashes = None
    if n_hits:
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), normal_form(F.col(text_col)).alias("norm"))
        texts = texts.withColumn("digest", digest(F.col("norm")))
        hit_texts = texts.join(common.maybe_broadcast(hits, 200, n_hits), "digest", "left_semi")
        variants = hit_texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
        clashing = common.materialize(variants.groupBy("digest").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("digest"), "dedup-clashes")
        n_clashes = clashing.count()
        if n_clashes:
            clashes = texts.join(common.maybe_broadcast(clashing, 200, n_clashes), "digest", "left_semi")
            keys = keys.join(common.maybe_broadcast(clashing, 200, n_clashes), "digest", "left_anti")

    rows = keys.count()
    heavy_at = max(rows // HEAVY, 1)
    fields = ["digest", "group_size", "best"]
    light = keys.join(F.broadcast(groups.where(F.col("group_size") > heavy_at).select("digest")), "digest", "left_anti")
    heavy = keys.join(F.broadcast(groups.where(F.col("group_size") > heavy_at).select(*fields)), "digest")
    joined = light.join(groups.where(F.col("group_size") <= heavy_at).select(*fields), "digest").unionByName(heavy)
    joined = joined.select("doc_id", "digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"))
    if clashes is not None:
        per_text = clashes.groupBy("digest", "norm").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(_rank(F.col("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long"), F.lit(None).cast("string"))).alias("best"),
        )
        split = clashes.join(per_text, ["digest", "norm"])
        joined = joined.unionByName(
            split.select("doc_id", F.col("norm").alias("digest"), "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"))
            .withColumn("digest", digest(F.col("digest")))
        )
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "keep_locator")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; what goes is told by id and text. ``repeats``: rows of one id and one text all stay, else one of them."""
    marked = deduplicate(docs, id_col, text_col).where("group_size > 1").groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("times"))
    odd = marked.where(~F.col("kept") if repeats else ~F.col("kept") | (F.col("times") > 1))
    odd_id, odd_digest, odd_kept, row = common.unused(docs.columns, "odd_id", "odd_digest", "odd_kept", "row")
    odd = common.materialize(odd.select(F.col("doc_id").alias(odd_id), F.unhex("text_sha256").alias(odd_digest), F.col("kept").alias(odd_kept)), "dedup-odd")
    same = F.col(id_col).eqNullSafe(F.col(odd_id)) & (F.unhex(sha256(normal_form(F.col(text_col)))) == F.col(odd_digest))
    rest = docs.join(common.maybe_broadcast(odd, 64), same, "left_anti")
    again = odd.where(F.col(odd_kept))
    if repeats or again.isEmpty():
        return rest
    # Partial minima: a text repeated in a third of all rows travels once per task.
    found = docs.join(common.maybe_broadcast(again, 64), same)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.struct((-F.char_length(text)).alias("points"), text.alias("text"), common.content_hash(docs, docs.columns).alias("rest"))
    one = found.groupBy(odd_id, odd_digest).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank).alias(row))
    return rest.unionByName(one.select(f"{row}.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.documents(spark, sf_dir)).drop("keep_locator")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
