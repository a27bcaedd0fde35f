"""Mixing sources to target weights by Poisson replication, DataFrame operations only.

A source of ``size`` characters and target weight ``w`` (weights sum to 1) is to fill ``w * budget`` characters, so each of
its documents is repeated at the mean rate ``w * budget / size``. A document's repetition count is the inverse of the Poisson
distribution function at a uniform number hashed from seed and id: count = number of k with CDF(k) <= u. The distribution
functions are arrays made once per source by running sums, in logarithms so that large rates neither underflow nor overflow, and extend
twelve standard deviations and 40 terms beyond the mean, where the upper tail is below what the 52-bit uniform can resolve. A document's
count is found in its source's array by bisection.
Each document is exploded by its count, and the copies are dealt by a hash of (seed, id, copy) to all partitions and sorted
by it within: a global shuffle without a sampling pass.

Sizes are summed by source with partial sums, so a hot source costs one row per task. The per-source table is broadcast
only if its counted size is small; beyond that it is joined by (source, salt), the salt splitting hot sources.

Cases. Null source: a source of its own. Null text or empty text: counts as one character, so that it is drawn at its
source's rate and no size is zero. Null id: hashed as the text ``null``. Repeated rows: the same count, each. Very long texts:
as others. Empty table: empty result. A source with no weight in ``weights``: weight 0, never drawn. Other columns of the input
are kept, whatever their names; one named like an added column (``copy``, ``shuffle_key``) is replaced by :func:`mix` and kept by
:func:`mixed_documents`. A mean rate above :data:`MOST_RATE` is an error: no source is filled by so many copies of the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common

SEED = "mix-1"
#: Exponent of the default target: weights in proportion to size ** ALPHA.
ALPHA = 0.5
#: Salts of a per-source table too large to broadcast.
SALTS = 64
MOST_RATE = 1e7
_SCALE = float(1 << 52)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of md5 over the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_SCALE)


def poisson_cdf(rates: DataFrame, source: str, rate: str, cdf: str) -> DataFrame:
    """The rows with the array CDF(0), CDF(1), ... up to where the upper tail is negligible; empty for rate 0, where the count is 0."""
    mean = F.col(rate)
    terms = F.ceil(mean + 12.0 * F.sqrt(mean) + 40.0).cast("int")
    k, order = F.col("__k"), Window.partitionBy(source).orderBy("__k")
    rows = rates.where(mean > 0).select(source, rate, F.explode(F.sequence(F.lit(0), terms)).alias("__k"))
    log_factorial = F.sum(F.ln(F.greatest(k, F.lit(1)).cast("double"))).over(order)
    logs = rows.select(source, rate, "__k", (k * F.ln(mean) - mean - log_factorial).alias("__log"))
    # Running sums do not fall, so sorting restores their order.
    sums = logs.select(source, rate, F.sum(F.exp("__log")).over(order).alias("__sum")).groupBy(source, rate).agg(F.sort_array(F.collect_list("__sum")).alias(cdf))
    return sums.unionByName(rates.where(~(mean > 0)).select(source, rate, F.array().cast("array<double>").alias(cdf)))


def count_up_to(cdf: Column, u: Column) -> Column:
    """How many of the sorted array's numbers are at most ``u``, by bisection."""

    def step(bounds: Column, _: Column) -> Column:
        low, high = bounds["low"], bounds["high"]
        mid = F.floor((low + high) / 2).cast("int")
        below = F.get(cdf, mid) <= u
        return F.when(low < high, F.struct(F.when(below, mid + 1).otherwise(low).alias("low"), F.when(below, high).otherwise(mid).alias("high"))).otherwise(bounds)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cdf) + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(cdf).alias("high")), step)["low"]


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, alpha: float, budget: float, source_col: str, text_col: str) -> DataFrame:
    """One row per source: __source, __rate and its distribution function __cdf. ``budget`` is in corpus sizes."""
    size = F.greatest(F.coalesce(F.char_length(F.col(text_col)), F.lit(1)), F.lit(1)).cast("long")
    sizes = docs.select(F.col(source_col).alias("__source"), size.alias("__size")).groupBy("__source").agg(F.sum("__size").alias("__size"))
    if weights is None:
        weighed = sizes.withColumn("__weight", F.pow(F.col("__size").cast("double"), F.lit(alpha)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__name string, __weight double")
        weighed = sizes.join(given, F.col("__source").cast("string").eqNullSafe(F.col("__name")), "left").drop("__name").fillna({"__weight": 0.0})
    weighed = common.materialize(weighed, "mix-sources")
    # Summed as decimals, so that the rates and with them the copies are the same on every run.
    total = weighed.agg(F.sum(F.col("__weight").cast("decimal(38,12)")).cast("double").alias("w"), F.sum("__size").alias("n"))
    row = total.first()
    if not row["w"]:
        return weighed.select("__source", F.lit(0.0).alias("__rate"), F.array().cast("array<double>").alias("__cdf"))
    rate = F.col("__weight") / F.lit(row["w"]) * F.lit(budget) * F.lit(float(row["n"])) / F.col("__size")
    rated = common.materialize(weighed.select("__source", rate.alias("__rate")), "mix-means")
    largest = rated.agg(F.max("__rate")).first()[0]
    if largest > MOST_RATE:
        raise ValueError(f"a source would be repeated {largest:.3g} times; at most {MOST_RATE:.3g} is sensible")
    return poisson_cdf(rated, "__source", "__rate", "__cdf")


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, budget: float = 1.0, seed: str = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The copies, shuffled: the input's columns, copy (from 0) and shuffle_key (hex; the order within a partition)."""
    return _mixed(docs, weights, alpha, budget, seed, id_col, source_col, text_col, "copy", "shuffle_key")


def _mixed(
    docs: DataFrame, weights: dict[str | None, float] | None, alpha: float, budget: float, seed: str, id_col: str, source_col: str, text_col: str, copy: str, key: str
) -> DataFrame:
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (copy, key)])
    own_source, rate, cdf, salt, at, u, n = common.unused([*docs.columns, copy, key], "__source", "__rate", "__cdf", "__salt", "__at", "__u", "__n")
    rates = common.materialize(source_rates(docs, weights, alpha, budget, source_col, text_col), "mix-rates").toDF(own_source, rate, cdf)
    rows, longest = rates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(cdf)), F.lit(0))).first()
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if rows * (64 + 8 * longest) <= common.BROADCAST_BYTES:
        joined = docs.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col(own_source)))
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(at, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(
            salted, F.col(source_col).eqNullSafe(F.col(own_source)) & (F.col(at) == F.col(salt))
        )
    drawn = joined.withColumn(u, uniform(F.lit(seed), name)).withColumn(n, count_up_to(F.col(cdf), F.col(u))).where(F.col(n) > 0)
    copies = drawn.select(*columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy))
    keyed = copies.withColumn(key, F.md5(F.concat_ws("|", F.lit(seed), name, F.col(copy).cast("string"))))
    return keyed.repartition(key).sortWithinPartitions(key)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The copies with the columns of ``docs`` alone, in shuffled order."""
    copy, key = common.unused(docs.columns, "copy", "shuffle_key")
    return _mixed(docs, None, ALPHA, 1.0, SEED, "doc_id", "source", "text", copy, key).drop(copy, key)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


ORACLE = f"""
WITH sizes AS (
  SELECT source, sum(greatest(coalesce(length(text), 1), 1))::BIGINT AS size FROM documents GROUP BY source
), weighed AS (
  SELECT source, size, pow(size::DOUBLE, {ALPHA}) AS weight FROM sizes
), totals AS (
  SELECT list_sum(list_sort(list(weight))) AS w, sum(size)::DOUBLE AS n FROM weighed
), rates AS (
  SELECT source, weight / w * 1.0 * n / size AS rate FROM weighed, totals
), terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 200) t(k)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), drawn AS (
  SELECT d.*, (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / {_SCALE} AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
    (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n FROM drawn d
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM counted WHERE n > 0
)
SELECT *, md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key FROM copies
"""
