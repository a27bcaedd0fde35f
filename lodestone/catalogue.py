"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import codecs, proto, records
from lodestone.functions.column import Col
from lodestone.functions.filters import NOOP, RecordFilter, Udp
from lodestone.operators.dataset import Dataset
from lodestone.operators.stats import Stats, StatsBuilder
from lodestone.plans.schema import conform, find_type, group, list_of, map_of, merge_projection, optional, required, skip_paths
from lodestone.sources import files
from lodestone.sources.memory import InMemoryFile
from lodestone.sources.reader import Reader
from lodestone.sources.writer import CREATE, OVERWRITE, Writer
from lodestone.streaming.sink import ViaParquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def path(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


def orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders with a column of each kind of null: status F, and every third customer, are null."""
    df = Reader(spark).read(path(sf_dir, "orders")).df
    return Dataset(df.select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("status"), F.expr("CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END").alias("cust"), "o_totalprice"))


ORDERS = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS cust, o_totalprice FROM orders)"


# --- scans ---

@query("SELECT * FROM nation")
def scan_generic(spark, sf_dir):
    return Reader(spark).generic().read(path(sf_dir, "nation")).df


CUSTOMER = group(required("c_custkey", "int"), optional("c_acctbal", "decimal(12,1)"), optional("c_name", "string"), optional("c_missing", "date"))


@query("SELECT c_custkey::INTEGER AS c_custkey, c_acctbal::DECIMAL(12,1) AS c_acctbal, c_name, NULL::DATE AS c_missing FROM customer")
def scan_typed_cast(spark, sf_dir):
    return Reader(spark).as_(CUSTOMER).read(path(sf_dir, "customer")).df


@query("SELECT c_custkey, c_mktsegment FROM customer")
def scan_projected_typed(spark, sf_dir):
    return Reader(spark).projected_as(group(optional("c_custkey", "bigint"), optional("c_mktsegment", "string"))).read(path(sf_dir, "customer")).df


@query("SELECT s_suppkey, s_name FROM supplier")
def scan_projected_schema(spark, sf_dir):
    return Reader(spark).projected_generic(group(optional("s_suppkey", "bigint"), optional("s_name", "string"))).read(path(sf_dir, "supplier")).df


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def scan_custom(spark, sf_dir):
    reader = Reader(spark).custom(lambda s, p: s.read.parquet(p).select("r_regionkey", "r_name"))
    return reader.read(path(sf_dir, "region"), read_map=lambda df: df.withColumn("r_name", F.upper("r_name"))).df


@query("SELECT n_nationkey, n_name FROM nation")
def scan_in_memory_file(spark, sf_dir):
    held = InMemoryFile()
    held.write(Reader(spark).projected_generic(Col("n_nationkey"), Col("n_name")).read(path(sf_dir, "nation")).df)
    return Reader(spark).read(InMemoryFile(held.take())).df


@query("SELECT i AS id, i * i AS square FROM range(0, 100) t(i)")
def scan_in_memory(spark, sf_dir):
    return Dataset.in_memory(spark, lambda: [(i, i * i) for i in range(100)], group(required("id", "bigint"), required("square", "bigint"))).df


@query("SELECT count(*) AS n FROM events")
def scan_files_each(spark, sf_dir):
    parts = [d.df.agg(F.count(F.lit(1)).alias("n")) for _, d in Reader(spark).read_files(path(sf_dir, "events"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.agg(F.sum("n").alias("n"))


@query("SELECT event_id, user_id FROM events")
def scan_options(spark, sf_dir):
    return Reader(spark).options(vectored_io=True, read={"mergeSchema": "false"}).projected_generic(Col("event_id"), Col("user_id")).read(path(sf_dir, "events")).df


@query("SELECT count(*) AS n FROM events")
def scan_by_file(spark, sf_dir):
    return Reader(spark).read_by_file(path(sf_dir, "events")).df.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("n")


@query("SELECT 'Asia/Tokyo' AS zone, '1970-01-01 09:00:00' AS shown UNION ALL SELECT 'UTC', '1970-01-01 00:00:00'")
def scan_time_zone(spark, sf_dir):
    """A read's zone is its dataset's own and not that of later reads."""
    out = []
    for zone in ("Asia/Tokyo", "UTC"):
        df = Reader(spark).options(time_zone=zone).projected_generic(Col("r_regionkey")).read(path(sf_dir, "region")).df
        out += df.where("r_regionkey = 0").select(F.lit(zone).alias("zone"), F.timestamp_seconds(F.col("r_regionkey")).cast("string").alias("shown")).collect()
    return spark.createDataFrame(out, "zone string, shown string")


# --- projection ---

@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def project_alias(spark, sf_dir):
    return Reader(spark).projected_generic(Col("o_orderkey"), Col("o_totalprice").alias("price")).read(path(sf_dir, "orders")).df


@query("SELECT o_orderkey, o_orderkey AS again FROM orders")
def project_repeated(spark, sf_dir):
    return Reader(spark).projected_generic(Col("o_orderkey").as_("bigint"), Col("o_orderkey").as_("int").alias("again")).read(path(sf_dir, "orders")).df


def nested_customers(spark: SparkSession, sf_dir: str) -> Dataset:
    df = Reader(spark).read(path(sf_dir, "customer")).df
    return Dataset(df.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place")).alias("who"), F.array(F.struct(F.col("c_acctbal").alias("a"), F.col("c_name").alias("b"))).alias("list")))


@query("SELECT c_custkey, c_mktsegment AS segment, c_name AS who FROM customer")
def project_nested(spark, sf_dir):
    return nested_customers(spark, sf_dir).select(Col("c_custkey"), Col("who.place.segment"), Col("who.name").alias("who")).df


@query("SELECT c_custkey, c_nationkey AS nation, c_acctbal AS a FROM customer")
def project_sub_struct(spark, sf_dir):
    slim = group(optional("c_custkey", "bigint"), optional("who", group(optional("place", group(optional("nation", "bigint"))))), optional("list", list_of(group(optional("a", "double")))))
    return nested_customers(spark, sf_dir).as_(slim).df.select("c_custkey", "who.place.nation", F.col("list")[0]["a"].alias("a"))


@query("SELECT n_nationkey::INTEGER AS n_nationkey, n_name, NULL::VARCHAR AS more FROM nation")
def retype_dataset(spark, sf_dir):
    return Reader(spark).read(path(sf_dir, "nation")).as_(group(required("n_nationkey", "int"), optional("n_name", "string"), optional("more", "string"))).df


@query("SELECT 'a.b' AS path, 'int' AS type UNION ALL SELECT 'a', 'struct<b:int>' UNION ALL SELECT 'd', 'none' UNION ALL SELECT 'first', 'bigint'")
def schema_walks(spark, sf_dir):
    s = group(required("a", group(optional("b", "int"), optional("c", "string"))), optional("d", group(optional("e", "int"))))
    slim = skip_paths(s, ["a.c", "d.e"])
    both = merge_projection([optional("x", "bigint"), optional("x", "int")])
    found = [("a.b", find_type(slim, "a.b")), ("a", find_type(slim, "a")), ("d", find_type(slim, "d")), ("first", find_type(both, "x"))]
    return spark.createDataFrame([(p, t.simpleString() if t else "none") for p, t in found], "path string, type string")


@query("SELECT 'invalid column projection: nothing.here' AS message")
def project_invalid(spark, sf_dir):
    try:
        Reader(spark).projected_generic(Col("nothing.here")).read(path(sf_dir, "region"))
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "message string")
    raise AssertionError("a projection of a missing column must fail")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def project_single_values(spark, sf_dir):
    """One field of each record, decoded by its path."""
    df = nested_customers(spark, sf_dir).df
    return df.select("c_custkey", Col("who.place.segment").column().alias("segment"))


# --- records ---

@query("SELECT 'x' AS zero, r_regionkey + 1 AS key, upper(r_name) AS r_name, 1 AS added FROM region")
def record_update_drop_rename(spark, sf_dir):
    df = Reader(spark).projected_generic(Col("r_regionkey"), Col("r_name"), Col("r_name").alias("gone")).read(path(sf_dir, "region")).df
    df = records.updated(records.removed(df, "gone"), "added", 1)
    df = records.updated(df, 0, F.col("r_regionkey") + 1)
    df = records.updated(records.renamed(df, 0, "key"), "r_name", F.upper("r_name"))
    return records.prepended(df, "zero", "x")


@query("SELECT c_custkey, c_custkey * 2 AS doubled, c_mktsegment AS segment, 'new' AS fresh FROM customer")
def record_nested_update(spark, sf_dir):
    df = nested_customers(spark, sf_dir).df
    df = records.updated(df, "who.place.doubled", F.col("c_custkey") * 2)
    df = records.removed(records.updated(df, "made.up.path", "new"), "who.name")
    return df.select("c_custkey", "who.place.doubled", "who.place.segment", F.col("made.up.path").alias("fresh"))


@query("SELECT r_regionkey, 'theirs' AS r_name, r_regionkey AS extra FROM region")
def record_merge(spark, sf_dir):
    df = Reader(spark).projected_generic(Col("r_regionkey"), Col("r_name")).read(path(sf_dir, "region")).df
    return records.merged(df, {"r_name": "theirs", "extra": F.col("r_regionkey")})


@query("SELECT n_nationkey, n_name AS second, 3::INTEGER AS len, NULL::VARCHAR AS beyond, 'v2' AS v, NULL::VARCHAR AS none FROM nation")
def record_lists_and_maps(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "nation")).df
    xs = records.list_updated(records.list_appended(F.array(F.lit("a"), F.lit("b")), "c"), 1, F.col("n_name"))
    m = records.map_updated(F.create_map(F.lit("k"), F.lit("v1")), "k", "v2")
    return df.select("n_nationkey", records.list_at(xs, 1).alias("second"), records.list_length(xs).alias("len"), records.list_at(xs, 9).alias("beyond"), records.map_apply(m, "k").alias("v"), records.map_get(m, "z").alias("none"))


@query("SELECT true AS has_key, false AS has_other, NULL::BIGINT AS r_regionkey, NULL::VARCHAR AS r_name")
def record_contains_and_empty(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "region")).df
    blank = records.empty(spark, group(optional("r_regionkey", "bigint"), optional("r_name", "string")))
    return blank.select(F.lit(records.contains(df, "r_name")).alias("has_key"), F.lit(records.contains(df, "x")).alias("has_other"), "r_regionkey", "r_name")


# --- filters ---

def _filter(name: str, predicate, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: orders(spark, sf_dir).where(predicate).df
    ORACLES[name] = f"SELECT * FROM {ORDERS} WHERE {sql}"


_status, _cust, _price, _key = Col("status"), Col("cust"), Col("o_totalprice"), Col("o_orderkey")
_filter("filter_eq", _status == "O", "status = 'O'")
_filter("filter_neq_nullsafe", _status != "O", "status IS DISTINCT FROM 'O'")
_filter("filter_gt", _cust > 100, "cust > 100")
_filter("filter_ge", _cust >= 100, "cust >= 100")
_filter("filter_lt", _cust < 100, "cust < 100")
_filter("filter_le", _cust <= 100, "cust <= 100")
_filter("filter_in", _cust.in_(1, 2, 4, 100), "cust IN (1, 2, 4, 100)")
_filter("filter_not_in", ~_cust.in_([1, 2, 4, 100]), "(cust IS NULL OR cust NOT IN (1, 2, 4, 100))")
_filter("filter_is_null", _status.is_null(), "status IS NULL")
_filter("filter_is_not_null", _status.is_not_null(), "status IS NOT NULL")
_filter("filter_and", (_status == "O") & (_price >= 100000.0), "status = 'O' AND o_totalprice >= 100000")
_filter("filter_or", (_status == "O") | (_cust < 50), "(status = 'O' OR cust < 50)")
_filter("filter_and_or_not", ~((_status == "O") & (_cust < 50)) & ~(_status == "P"), "(status IS DISTINCT FROM 'O' OR cust >= 50) AND status IS DISTINCT FROM 'P'")
_filter("filter_not_order", ~(_cust < 100), "cust >= 100")
_filter("filter_noop", NOOP, "true")
_filter("filter_udp_mod10", _key.udp(Udp(column=lambda c: c % 10 == 0)), "o_orderkey % 10 = 0")
_filter("filter_udp_null", _cust.udp(Udp(column=lambda c: c % 2 == 0, keep_null=True, may_keep=lambda c: c >= 0)), "(cust IS NULL OR cust % 2 = 0)")
_filter("filter_not_udp", ~_cust.udp(Udp(column=lambda c: c % 2 == 0)), "(cust IS NULL OR cust % 2 <> 0)")
_filter("filter_udp_python", _cust.udp(Udp(keep=lambda v: int(v) % 7 == 3)), "cust % 7 = 3")
_filter("filter_encoded", Col("status").encoded(lambda v: v[0].upper()) == "open", "status = 'O'")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE >= DATE '1995-01-01' AND o_orderdate::DATE < DATE '1996-01-01'")
def filter_date_range(spark, sf_dir):
    df = Reader(spark).projected_generic(Col("o_orderkey"), Col("o_orderdate").as_("date").alias("day")).read(path(sf_dir, "orders"))
    return df.where((Col("day") >= datetime.date(1995, 1, 1)) & (Col("day") < datetime.date(1996, 1, 1))).df


@query("SELECT o_orderkey, o_totalprice::DECIMAL(14,1) AS price FROM orders WHERE o_totalprice::DECIMAL(14,1) >= 150000.3")
def filter_decimal(spark, sf_dir):
    df = Reader(spark).projected_generic(Col("o_orderkey"), Col("o_totalprice").as_("decimal(14,1)").alias("price")).read(path(sf_dir, "orders"))
    return df.where(Col("price") >= decimal.Decimal("150000.25")).df


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10")
def filter_nested(spark, sf_dir):
    return nested_customers(spark, sf_dir).where((Col("who.place.segment") == "BUILDING") & (Col("who.place.nation") < 10)).df.select("c_custkey", "who.place.segment")


@query("SELECT event_id FROM events WHERE event_id >= (SELECT min(event_id) FROM events) + 1 AND event_id < (SELECT min(event_id) FROM events) + 10")
def record_filter(spark, sf_dir):
    return Reader(spark).projected_generic(Col("event_id")).filter(RecordFilter.between(1, 10)).read(path(sf_dir, "events")).df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 OR o_totalprice > 300000")
def filter_pushed_to_scan(spark, sf_dir):
    return Reader(spark).filter((Col("o_custkey") == 7) | (Col("o_totalprice") > 300000.0)).projected_generic(Col("o_orderkey"), Col("o_totalprice")).read(path(sf_dir, "orders")).df


# --- joins ---

@query("SELECT o_orderkey, o_custkey, o_totalprice AS price, c_custkey, c_name FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'")
def join_inner(spark, sf_dir):
    left = Reader(spark).projected_generic(Col("o_orderkey"), Col("o_custkey"), Col("o_totalprice").alias("price")).filter((Col("o_totalprice") >= 100000.0) & (Col("o_orderstatus") != "F")).read(path(sf_dir, "orders"))
    right = Reader(spark).projected_generic(Col("c_custkey"), Col("c_name")).read(path(sf_dir, "customer"))
    return left.inner_join(right, "o_custkey", "c_custkey").df


def _sides(spark: SparkSession, sf_dir: str) -> tuple[Dataset, Dataset]:
    left = Reader(spark).projected_generic(Col("o_orderkey"), Col("o_custkey")).filter(Col("o_custkey") < 700).read(path(sf_dir, "orders"))
    right = Reader(spark).projected_generic(Col("c_custkey"), Col("c_name")).filter(Col("c_custkey") >= 300).read(path(sf_dir, "customer"))
    return left, right


_SIDES = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 700) l {} JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 300) r ON l.o_custkey IS NOT DISTINCT FROM r.c_custkey"


def _join(how: str) -> None:
    QUERIES[f"join_{how}"] = lambda spark, sf_dir: getattr(_sides(spark, sf_dir)[0], f"{how}_join")(_sides(spark, sf_dir)[1], "o_custkey", "c_custkey").df
    ORACLES[f"join_{how}"] = "SELECT * FROM " + _SIDES.format(how.upper())


for _how in ("left", "right", "full"):
    _join(_how)


@query("SELECT * FROM " + _SIDES.format("FULL"))
def join_full_build_right(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return left.full_join(right, "o_custkey", "c_custkey", build_right=True).df


def _whole(spark: SparkSession, sf_dir: str) -> tuple[Dataset, Dataset]:
    """Whole tables with unmatched rows on both sides: orders with nulled keys, and customers with keys moved by 300."""
    right = Reader(spark).projected_generic(Col("c_custkey"), Col("c_name")).read(path(sf_dir, "customer")).df
    return Dataset(orders(spark, sf_dir).df.select("o_orderkey", "cust")), Dataset(right.select((F.col("c_custkey") + 300).alias("moved"), "c_name"))


_WHOLE = "SELECT o_orderkey, cust, moved, c_name FROM " + ORDERS + " l {} JOIN (SELECT c_custkey + 300 AS moved, c_name FROM customer) r ON l.cust IS NOT DISTINCT FROM r.moved"


def _join_whole(name: str, how: str, build_right: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = _whole(spark, sf_dir)
        return getattr(left, f"{how}_join")(right, "cust", "moved", build_right=build_right).df

    QUERIES[name], ORACLES[name] = run, _WHOLE.format(how.upper())


for _how in ("left", "right", "full"):
    _join_whole(f"join_{_how}_whole", _how)
_join_whole("join_full_whole_build_right", "full", True)


@query("SELECT l.k, r.k2, l.n, r.m FROM (SELECT nullif(n_regionkey, 2) AS k, count(*) AS n FROM nation GROUP BY 1) l FULL JOIN (SELECT nullif(r_regionkey, 3) AS k2, count(*) AS m FROM region GROUP BY 1) r ON l.k IS NOT DISTINCT FROM r.k2")
def join_null_keys(spark, sf_dir):
    left = Reader(spark).read(path(sf_dir, "nation")).df.groupBy(F.expr("nullif(n_regionkey, 2)").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    right = Reader(spark).read(path(sf_dir, "region")).df.groupBy(F.expr("nullif(r_regionkey, 3)").alias("k2")).agg(F.count(F.lit(1)).alias("m"))
    return Dataset(left).full_join(Dataset(right), "k", "k2").df


@query("SELECT n.id, r.name, n.region, r.key FROM (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation) n LEFT JOIN (SELECT r_regionkey AS key, r_name AS name FROM region WHERE r_regionkey < 3) r ON n.region IS NOT DISTINCT FROM r.key")
def join_name_clash(spark, sf_dir):
    left = Reader(spark).projected_generic(Col("n_nationkey").alias("id"), Col("n_name").alias("name"), Col("n_regionkey").alias("region")).read(path(sf_dir, "nation"))
    right = Reader(spark).projected_generic(Col("r_regionkey").alias("key"), Col("r_name").alias("name")).filter(Col("r_regionkey") < 3).read(path(sf_dir, "region"))
    return left.left_join(right, "region", "key").df


@query("SELECT c_custkey, c_nationkey AS nation, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_nested_key(spark, sf_dir):
    right = Reader(spark).projected_generic(Col("n_nationkey"), Col("n_name")).read(path(sf_dir, "nation"))
    return nested_customers(spark, sf_dir).inner_join(right, "who.place.nation", "n_nationkey").df.select("c_custkey", "who.place.nation", "n_name")


# --- concatenation ---

@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def concat_same(spark, sf_dir):
    one = Reader(spark).projected_generic(Col("n_nationkey"), Col("n_name")).read(path(sf_dir, "nation"))
    return one.concat(one).df


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def concat_rename(spark, sf_dir):
    one = Reader(spark).projected_generic(Col("n_nationkey").alias("id"), Col("n_name").alias("name")).read(path(sf_dir, "nation"))
    return one.concat(Reader(spark).projected_generic(Col("r_name").alias("name"), Col("r_regionkey").alias("id")).read(path(sf_dir, "region"))).df


@query("SELECT n_nationkey AS id, n_name AS name, NULL::VARCHAR AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def concat_missing(spark, sf_dir):
    one = Reader(spark).projected_generic(Col("n_nationkey").alias("id"), Col("n_name").alias("name")).read(path(sf_dir, "nation"))
    return one.concat(Reader(spark).projected_generic(Col("r_regionkey").alias("id"), Col("r_name").alias("region")).read(path(sf_dir, "region"))).df


@query("SELECT n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT r_regionkey::BIGINT FROM region")
def concat_retyped(spark, sf_dir):
    want = group(required("id", "bigint"))
    one = Reader(spark).projected_generic(Col("n_nationkey").as_("int").alias("id")).read(path(sf_dir, "nation"))
    two = Reader(spark).projected_generic(Col("r_regionkey").alias("id")).read(path(sf_dir, "region"))
    return one.as_(want).concat(two.as_(want)).df


# --- statistics ---

@query("SELECT count(*) AS record_count FROM lineitem")
def stats_count(spark, sf_dir):
    return StatsBuilder(spark).stats(path(sf_dir, "lineitem")).summary()


@query("SELECT count(*) AS record_count, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey, min(o_orderstatus) AS min_o_orderstatus, max(o_orderstatus) AS max_o_orderstatus FROM orders")
def stats_min_max(spark, sf_dir):
    return StatsBuilder(spark).stats(path(sf_dir, "orders")).summary("o_custkey", "o_orderstatus")


@query("SELECT count(*) AS record_count, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders WHERE o_custkey < 100")
def stats_filtered(spark, sf_dir):
    return StatsBuilder(spark).filter(Col("o_custkey") < 100).projection(group(optional("o_totalprice", "double"))).stats(path(sf_dir, "orders")).summary("o_totalprice")


@query("SELECT count(*) AS record_count, NULL::INTEGER AS min_nothing, NULL::INTEGER AS max_nothing FROM region")
def stats_missing_col(spark, sf_dir):
    found = StatsBuilder(spark).stats(path(sf_dir, "region"))
    assert found.min("nothing") is None and found.max("nothing") is None
    return found.summary("nothing").select("record_count", F.col("min_nothing").cast("int"), F.col("max_nothing").cast("int"))


@query(f"SELECT count(*) AS record_count, min(cust) AS min_cust, max(cust) AS max_cust, min(status) AS min_status, max(status) AS max_status FROM {ORDERS}")
def stats_nulls(spark, sf_dir):
    return Stats(orders(spark, sf_dir)).summary("cust", "status")


@query("SELECT 50::BIGINT AS size, 0::BIGINT AS low, 49::BIGINT AS high")
def stats_in_memory(spark, sf_dir):
    d = Dataset.in_memory(spark, [(i,) for i in range(50)], group(required("i", "bigint")))
    return spark.createDataFrame([(d.size(), d.min("i"), d.max("i"))], "size bigint, low bigint, high bigint")


@query("SELECT count(*) AS record_count, min(c_mktsegment) AS min_segment, max(c_mktsegment) AS max_segment FROM customer")
def stats_partition_column(spark, sf_dir):
    return Stats(_partitioned(spark, sf_dir)).summary("segment")


# --- partitions and sinks ---

def _partitioned(spark: SparkSession, sf_dir: str, predicate=NOOP) -> Dataset:
    place = files.scratch(spark, "partitioned")
    d = Reader(spark).projected_generic(Col("c_custkey"), Col("c_nationkey").as_("string").alias("nation"), Col("c_mktsegment").alias("segment")).read(path(sf_dir, "customer"))
    d.write_dataset(place, ("segment", "nation"))
    return Reader(spark).filter(predicate).read(place)


@query("SELECT c_custkey, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment FROM customer")
def partition_roundtrip(spark, sf_dir):
    return _partitioned(spark, sf_dir).df


@query("SELECT c_custkey, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_nationkey::VARCHAR > '2' OR c_custkey < 500)")
def partition_prune(spark, sf_dir):
    return _partitioned(spark, sf_dir, (Col("segment") == "BUILDING") & ((Col("nation") > "2") | (Col("c_custkey") < 500))).df


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
def partition_default(spark, sf_dir):
    place = files.scratch(spark, "partitioned")
    df = Reader(spark).read(path(sf_dir, "customer")).df.select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    Writer(spark).write_dataset(place, df, ("segment",), defaults={"segment": "none"})
    return Reader(spark).read(place).df


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def partition_nested(spark, sf_dir):
    place = files.scratch(spark, "partitioned")
    df = Reader(spark).read(path(sf_dir, "customer")).df.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("who"))
    Writer(spark).write_dataset(place, df, ("who.segment",))
    return Reader(spark).read(place).df.select("c_custkey", "who.name", "who.segment")


@query("SELECT n_nationkey, 'é+' || n_name || ' %=/x' AS name FROM nation")
def partition_escaped(spark, sf_dir):
    place = files.scratch(spark, "partitioned")
    df = Reader(spark).read(path(sf_dir, "nation")).df.select("n_nationkey", F.concat(F.lit("é+"), "n_name", F.lit(" %=/x")).alias("name"))
    # A plus sign in a directory's name is read as a space; written as its code, it stays one.
    Writer(spark).write_dataset(place, df.withColumn("name", F.replace("name", F.lit("+"), F.lit("%2B"))), ("name",))
    return Reader(spark).read(place).df.withColumn("name", F.replace("name", F.lit("%2B"), F.lit("+")))


@query("SELECT s_suppkey, s_name FROM supplier")
def write_roundtrip(spark, sf_dir):
    place = files.scratch(spark, "single") + ".parquet"
    Reader(spark).projected_generic(Col("s_suppkey"), Col("s_name")).read(path(sf_dir, "supplier")).write_and_close(place)
    return Reader(spark).read(place).df


@query("SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey FROM supplier")
def write_append(spark, sf_dir):
    place = files.scratch(spark, "appended")
    d = Reader(spark).projected_generic(Col("s_suppkey")).read(path(sf_dir, "supplier"))
    d.write_dataset(place, mode=CREATE)
    d.write_dataset(place, mode=CREATE)
    return Reader(spark).read(place).df


@query("SELECT s_suppkey FROM supplier")
def write_overwrite(spark, sf_dir):
    place = files.scratch(spark, "replaced")
    d = Reader(spark).projected_generic(Col("s_suppkey")).read(path(sf_dir, "supplier"))
    d.write_dataset(place)
    d.write_dataset(place, mode=OVERWRITE)
    return Reader(spark).read(place).df


@query("SELECT r_regionkey::INTEGER AS r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey::INTEGER, n_name FROM nation")
def write_incremental(spark, sf_dir):
    place = files.scratch(spark, "chunks") + ".parquet"
    want = group(required("r_regionkey", "int"), optional("r_name", "string"))
    with Writer(spark).of(want).options(compression="gzip", dictionary=False, page_size=64 << 10, row_group_size=1 << 20).build(place) as w:
        w.write(Reader(spark).read(path(sf_dir, "region")).df)
        w.write(Reader(spark).projected_generic(Col("n_nationkey").alias("r_regionkey"), Col("n_name").alias("r_name")).read(path(sf_dir, "nation")).df)
    return Reader(spark).read(place).df


@query("SELECT o_orderkey FROM orders")
def write_custom(spark, sf_dir):
    place = files.scratch(spark, "custom")
    Writer(spark).custom(lambda df, p: df.write.orc(p)).write_and_close(place, Reader(spark).projected_generic(Col("o_orderkey")).read(path(sf_dir, "orders")).df)
    return Reader(spark).custom(lambda s, p: s.read.orc(p)).read(place).df


# --- streams ---

def _streamed(spark: SparkSession, sf_dir: str, table: str, build: Callable[[ViaParquet], ViaParquet], columns: tuple[str, ...]) -> str:
    """Streams a table through the sink to its end; gives the sink's path."""
    source, place, checkpoint = (files.scratch(spark, x) for x in ("stream-in", "stream-out", "stream-check"))
    df = Reader(spark).read(path(sf_dir, table)).df.select(*columns)
    Writer(spark).write_dataset(source, df.repartition(3))
    stream = Reader(spark).stream(source, df.schema, max_files_per_trigger=1).df
    build(ViaParquet(spark)).write(stream, place, checkpoint, available_now=True).awaitTermination()
    return place


@query("SELECT c_custkey, c_name FROM customer")
def stream_rotate(spark, sf_dir):
    return Reader(spark).read(_streamed(spark, sf_dir, "customer", lambda v: v.max_count(100).max_duration(1), ("c_custkey", "c_name"))).df


@query("SELECT r_regionkey * 10 + i AS id, r_name FROM region, range(0, 3) t(i)")
def stream_transform(spark, sf_dir):
    def thrice(df: DataFrame) -> DataFrame:
        return df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((F.col("r_regionkey") * 10 + F.col("i")).alias("id"), "r_name")

    return Reader(spark).read(_streamed(spark, sf_dir, "region", lambda v: v.pre_write_transformation(thrice), ("r_regionkey", "r_name"))).df


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'default') AS segment FROM customer")
def stream_partition(spark, sf_dir):
    def build(v: ViaParquet) -> ViaParquet:
        v = v.pre_write_transformation(lambda df: df.select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment")))
        return v.partition_by("segment").default_partition({"segment": "default"}).max_count(50)

    return Reader(spark).read(_streamed(spark, sf_dir, "customer", build, ("c_custkey", "c_mktsegment"))).df


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def stream_post_write(spark, sf_dir):
    told: dict[str, int] = {}

    def note(state) -> None:
        for k, n in state.counts.items():
            told[k.rsplit("=", 1)[1]] = told.get(k.rsplit("=", 1)[1], 0) + n

    _streamed(spark, sf_dir, "customer", lambda v: v.partition_by("c_mktsegment").post_write_handler(note), ("c_custkey", "c_mktsegment"))
    return spark.createDataFrame(sorted(told.items()), "segment string, n bigint")


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM region")
def stream_partition_using(spark, sf_dir):
    def parity(df: DataFrame) -> DataFrame:
        return df.withColumn("parity", F.when(F.col("r_regionkey") % 2 == 0, "even").otherwise("odd"))

    return Reader(spark).read(_streamed(spark, sf_dir, "region", lambda v: v.partition_using(parity, "parity"), ("r_regionkey",))).df


@query("SELECT n_nationkey, n_name FROM nation")
def stream_after_failure(spark, sf_dir):
    """A stage behind the sink fails once; the stream goes on from its checkpoint, and no record is lost or twice there."""
    source, place, checkpoint = (files.scratch(spark, x) for x in ("stream-in", "stream-out", "stream-check"))
    df = Reader(spark).read(path(sf_dir, "nation")).df.select("n_nationkey", "n_name")
    Writer(spark).write_dataset(source, df.repartition(3))
    failures = ["once"]

    def then(batch: DataFrame, number: int) -> None:
        if number == 1 and failures:
            raise RuntimeError(failures.pop())

    for _ in range(2):
        stream = Reader(spark).stream(source, df.schema, max_files_per_trigger=1).df
        try:
            ViaParquet(spark).write(stream, place, checkpoint, then=then, available_now=True).awaitTermination()
        except StreamingQueryException as e:
            if "once" not in str(e):
                raise
    return Reader(spark).read(place).df


@query("SELECT 'there is no field nothing to partition by' AS message UNION ALL SELECT 'partition field n_nationkey is int, not text' UNION ALL SELECT 'partitioning takes all fields; none is left to write'")
def write_errors(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "nation")).df.select(F.col("n_nationkey").cast("int"), "n_name")
    told = []
    for columns, by in ((("n_name",), "nothing"), (("n_nationkey", "n_name"), "n_nationkey"), (("n_name",), "n_name")):
        try:
            Writer(spark).write_dataset(files.scratch(spark, "never"), df.select(*columns), (by,))
        except ValueError as e:
            told.append((str(e),))
    return spark.createDataFrame(told, "message string")


# --- scalar conversions ---

@query("SELECT event_id, epoch_ms(event_id * 1000) AS millis, make_timestamp(event_id) AS micros, make_timestamp(event_id * 7 // 1000) AS nanos FROM events")
def codec_timestamp_units(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "events")).df
    i = F.col("event_id")
    made = [codecs.timestamp_of(i * 1000, "millis").alias("millis"), codecs.timestamp_of(i, "micros").alias("micros"), codecs.timestamp_of(i * 7, "nanos").alias("nanos")]
    return df.select("event_id", *[c.cast("timestamp_ntz") for c in made]).toDF("event_id", "millis", "micros", "nanos")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2)::DECIMAL(18,1) AS price FROM lineitem")
def codec_decimal_rescale(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "lineitem")).df
    return df.select("l_orderkey", "l_linenumber", codecs.rescaled(codecs.rescaled(F.col("l_extendedprice"), 18, 2), 18, 1).alias("price"))


@query("SELECT o_orderkey, (((o_orderkey * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INTEGER AS narrow FROM orders")
def codec_narrowing(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "orders")).df.select("o_orderkey", (F.col("o_orderkey") * 1000003).alias("narrow"))
    return conform(df, group(optional("o_orderkey", "bigint"), optional("narrow", "int")))


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants through the ages, with microseconds: some hours and days about midnight for every event."""
    i = F.col("event_id")
    return Reader(spark).read(path(sf_dir, "events")).df.select("event_id", F.timestamp_micros((i - 5000) * 43_199_999_983).alias("at"))


_INSTANTS = "(SELECT event_id, (event_id - 5000) * 43199999983 AS us FROM events)"


@query(f"SELECT event_id, us AS micros FROM {_INSTANTS}")
def codec_int96(spark, sf_dir):
    """Written as INT96 and read back, with days before 1970 and times about midnight."""
    place = files.scratch(spark, "int96")
    Writer(spark).options(timestamp_type="INT96").write_dataset(place, _instants(spark, sf_dir))
    return Reader(spark).read(place).df.select("event_id", codecs.units_of(F.col("at"), "micros").alias("micros"))


@query(f"SELECT event_id, us - 3600000000 AS west, us + 3600000000 AS east, us AS back, floor(us / 86400000000)::INTEGER AS day FROM {_INSTANTS}")
def codec_zones(spark, sf_dir):
    """Local times of two zones as instants, there and back, and days since the epoch in UTC."""
    at, us = F.col("at"), lambda c: codecs.units_of(c, "micros")
    there = codecs.instant_to_local(at, "GMT+1")
    day = codecs.epoch_day(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us(at) / 86_400_000_000).cast("int")))
    return _instants(spark, sf_dir).select("event_id", us(codecs.instant_to_local(at, "GMT-1")).alias("west"), us(there).alias("east"), us(codecs.local_to_instant(there, "GMT+1")).alias("back"), day.alias("day"))


@query("SELECT n::INTEGER AS number FROM (VALUES (7), (-3), (2147483647), (-2147483648), (0)) t(n)")
def proto_unknown_enum_numbers(spark, sf_dir):
    df = spark.createDataFrame([(7,), (-3,), (2147483647,), (-2147483648,), (0,)], "n int").select(proto.enum_name(F.col("n"), {0: "ZERO"}).alias("name"))
    return df.select(proto.enum_number(F.col("name"), {"ZERO": 0}).alias("number"))


@query("SELECT n_nationkey, n_name AS there_and_back, ascii(n_name)::INTEGER AS code FROM nation")
def codec_url_and_char(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "nation")).df
    return df.select("n_nationkey", codecs.url_decoded(codecs.url_encoded("n_name")).alias("there_and_back"), codecs.char_code(F.col("n_name")).alias("code"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'ZERO' WHEN 1 THEN 'ONE' ELSE n_regionkey::VARCHAR END AS name, n_regionkey::INTEGER AS number FROM nation")
def proto_enum(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "nation")).df.select("n_nationkey", proto.enum_name(F.col("n_regionkey"), {0: "ZERO", 1: "ONE"}).alias("name"))
    return df.withColumn("number", proto.enum_number(F.col("name"), {"ZERO": 0, "ONE": 1}))


@query("SELECT c_nationkey, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY c_nationkey")
def conform_maps(spark, sf_dir):
    df = Reader(spark).read(path(sf_dir, "customer")).df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))
    packed = df.select("c_nationkey", F.create_map(F.lit("n"), F.col("n").cast("int"), F.lit("last"), F.col("last").cast("int")).alias("m"))
    wide = conform(packed, group(optional("c_nationkey", "bigint"), optional("m", map_of("string", "bigint"))))
    return wide.select("c_nationkey", records.map_get(F.col("m"), "n").alias("n"), records.map_get(F.col("m"), "last").alias("last"))
