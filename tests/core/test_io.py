import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions.column import Col
from lodestone.operators.dataset import Dataset
from lodestone.operators.stats import StatsBuilder
from lodestone.plans.schema import group, optional, required
from lodestone.sources import files
from lodestone.sources.memory import InMemoryFile
from lodestone.sources.reader import Reader
from lodestone.sources.writer import OVERWRITE, Writer
from lodestone.streaming.sink import ViaParquet


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "x")], "id int, name string, part string")


def test_partition_values_are_text(spark, tmp, people):
    people.selectExpr("id", "id AS day").write.partitionBy("day").parquet(f"{tmp}/t")
    ds = Reader(spark).read(f"{tmp}/t")
    assert dict(ds.df.dtypes) == {"id": "int", "day": "string"} and ds.partitions == ("day",)
    assert Reader(spark).filter(Col("day") == "2").read(f"{tmp}/t").size() == 1
    plan = Reader(spark).filter(Col("day") == "2").read(f"{tmp}/t").df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    with pytest.raises(ValueError, match="holds text"):
        Reader(spark).filter(Col("day") == 2).read(f"{tmp}/t")


def test_partition_names_nest_and_values_decode(spark, tmp, people):
    for raw in ("x+y%20z", "caf%C3%A9"):
        people.select("id").coalesce(1).write.parquet(f"{tmp}/t/a.b={raw}")
    got = Reader(spark).read(f"{tmp}/t").df
    assert got.schema["a"].dataType.simpleString() == "struct<b:string>"
    assert {r.b for r in got.select("a.b").collect()} == {"x y z", "café"}


def test_not_over_partition_and_data(spark, tmp):
    spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 2), ('b', 1) AS t(p, x)").write.partitionBy("p").parquet(f"{tmp}/t")
    ds = Reader(spark).filter(~((Col("p") == "a") & (Col("x") == 1))).read(f"{tmp}/t")
    assert sorted((r.p, r.x) for r in ds.df.collect()) == [("a", 2), ("b", 1)]


def test_odd_trees(spark, tmp, people):
    people.coalesce(1).write.parquet(f"{tmp}/t/k=1")
    people.coalesce(1).write.parquet(f"{tmp}/t/other")
    assert Reader(spark).read(f"{tmp}/t").size() == 3
    people.coalesce(1).write.parquet(f"{tmp}/u/k=1/m=2")
    people.coalesce(1).write.parquet(f"{tmp}/u/k=1/j=2")
    with pytest.raises(ValueError, match="differ"):
        Reader(spark).read(f"{tmp}/u")


def test_empty_directory(spark, tmp):
    fs, p = files.fs_path(spark, f"{tmp}/empty")
    fs.mkdirs(p)
    ds = Reader(spark).as_(group(optional("id", "int"))).read(f"{tmp}/empty")
    assert ds.size() == 0 and ds.df.columns == ["id"]
    assert Reader(spark).read(f"{tmp}/empty").size() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Reader(spark).read(f"{tmp}/nowhere")


def test_projection_is_strict_about_names_and_lenient_about_types(spark, tmp, people):
    people.write.parquet(f"{tmp}/t")
    assert Reader(spark).projected_as(group(required("id", "bigint"))).read(f"{tmp}/t").df.dtypes == [("id", "bigint")]
    with pytest.raises(ValueError):
        Reader(spark).projected_as(group(optional("nothing", "int"))).read(f"{tmp}/t")
    # A filter column need not be selected.
    assert Reader(spark).filter(Col("id") == 2).projected_generic(Col("name")).read(f"{tmp}/t").df.collect() == [("b",)]


def test_single_file_writer(spark, tmp, people):
    path = f"{tmp}/one.parquet"
    Writer(spark).write_and_close(path, people)
    assert files.is_file(spark, path) and files.files_at_path(spark, path) == ["one.parquet"]
    with pytest.raises(FileExistsError):
        Writer(spark).write_and_close(path, people)
    Writer(spark).options(mode=OVERWRITE, compression="zstd").write_and_close(path, people.limit(1))
    assert Reader(spark).read(path).size() == 1
    assert files.files_at_path(spark, tmp) == ["one.parquet"]  # no drafts are left


def test_incremental_writer(spark, tmp, people):
    w = Writer(spark).of(group(optional("id", "bigint"))).build(f"{tmp}/inc.parquet")
    w.write(people).write(people)
    w.close()
    w.close()
    with pytest.raises(RuntimeError):
        w.write(people)
    assert Reader(spark).read(f"{tmp}/inc.parquet").size() == 6


def test_partitioned_writes(spark, tmp, people):
    with pytest.raises(ValueError, match="not text"):
        Writer(spark).write_dataset(f"{tmp}/p", people, ("id",))
    with pytest.raises(ValueError, match="no field"):
        Writer(spark).write_dataset(f"{tmp}/p", people, ("zzz",))
    with pytest.raises(ValueError, match="takes all fields"):
        Writer(spark).write_dataset(f"{tmp}/p", people.select("part"), ("part",))
    with pytest.raises(Exception, match="partition field name is null"):
        Writer(spark).write_dataset(f"{tmp}/q", people, ("name",))
    Writer(spark).write_dataset(f"{tmp}/r", people, ("part", "name"), defaults={"name": "none"})
    assert sorted((r.part, r.name) for r in Reader(spark).read(f"{tmp}/r").df.collect()) == [("x", "a"), ("x", "none"), ("y", "b")]


def test_write_path_rules(spark, tmp, people):
    Writer(spark).write_and_close(f"{tmp}/f", people)
    with pytest.raises(FileExistsError):
        Writer(spark).write_dataset(f"{tmp}/f", people)
    Writer(spark).options(mode=OVERWRITE).write_dataset(f"{tmp}/f", people)
    Writer(spark).write_dataset(f"{tmp}/f", people)
    assert Reader(spark).read(f"{tmp}/f").size() == 6
    Writer(spark).options(mode=OVERWRITE).write_dataset(f"{tmp}/f", people)
    assert Reader(spark).read(f"{tmp}/f").size() == 3


def test_in_memory_file(spark, people):
    held = InMemoryFile()
    with pytest.raises(ValueError):
        held.take()
    held.write(people)
    with pytest.raises(FileExistsError):
        held.write(people)
    data = held.take()
    held.write(people.limit(1))
    assert data[:4] == b"PAR1" and Reader(spark).read(InMemoryFile(data)).size() == 3 and Reader(spark).read(held).size() == 1


def test_arrow_lists(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"l": pa.array([[1, 2], [], None])}), tmp_path / "l.parquet", use_compliant_nested_type=False)
    assert [r.l for r in Reader(spark).read(f"file://{tmp_path}/l.parquet").df.collect()] == [[1, 2], [], None]


def test_nanos(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"t": pa.array([1_500_000_001], pa.timestamp("ns"))}), tmp_path / "n.parquet", version="2.6")
    assert Reader(spark).options(nanos_as_long=True).read(f"file://{tmp_path}/n.parquet").df.first().t == 1_500_000_001


def test_stats(spark, tmp):
    spark.sql("SELECT * FROM VALUES (1, NULL), (2, 5), (3, 4) AS t(a, b)").write.parquet(f"{tmp}/s")
    s = StatsBuilder(spark).stats(f"{tmp}/s")
    assert (s.record_count(), s.min("b"), s.max("b"), s.min("zz")) == (3, 4, 5, None)
    f = StatsBuilder(spark).filter(Col("a") > 7).stats(f"{tmp}/s")
    assert (f.record_count(), f.min("a")) == (0, None)


def _rows(n):
    return [(i, "p" if i % 3 else None) for i in range(n)]


def _stream(spark, tmp, via, n=33, files_=1):
    spark.createDataFrame(_rows(n), "i int, p string").repartition(files_).write.parquet(f"{tmp}/in")
    seen = []
    stream = Reader(spark).stream(f"{tmp}/in", spark.read.parquet(f"{tmp}/in").schema, 1).df
    via.write(stream, f"{tmp}/out", f"{tmp}/check", then=lambda b, k: seen.append((k, b.count())), available_now=True).awaitTermination()
    return seen


def test_stream_rotation_and_pass_through(spark, tmp):
    seen = _stream(spark, tmp, ViaParquet(spark).max_count(10))
    assert seen == [(0, 33)]
    assert len(files.files_at_path(spark, f"{tmp}/out")) == 4 and Reader(spark).read(f"{tmp}/out").size() == 33


def test_stream_partitions_defaults_and_handler(spark, tmp):
    told = []
    via = ViaParquet(spark).partition_by("p").default_partition({"p": "none"}).post_write_handler(lambda s: told.append({k.rsplit("=", 1)[1]: n for k, n in s.counts.items()}))
    _stream(spark, tmp, via)
    assert told == [{"p": 22, "none": 11}] and {r.p for r in Reader(spark).read(f"{tmp}/out").df.collect()} == {"p", "none"}


def test_stream_partition_using_and_schema(spark, tmp):
    via = ViaParquet(spark).of(group(optional("i", "bigint"), optional("half", "string"))).partition_using(lambda d: d.withColumn("half", F.when(F.col("i") < 20, "lo").otherwise("hi")), "half")
    _stream(spark, tmp, via)
    got = Reader(spark).read(f"{tmp}/out").df
    assert got.columns == ["i", "half"] and got.where("half = 'lo'").count() == 20


def test_stream_null_partition_is_an_error(spark, tmp):
    with pytest.raises(Exception, match="partition field p is null"):
        _stream(spark, tmp, ViaParquet(spark).partition_by("p"))


def test_stream_batch_repeated_after_a_failure(spark, tmp):
    via = ViaParquet(spark).max_count(10)
    df = spark.createDataFrame(_rows(33), "i int, p string")
    writer = Writer(spark)
    via._batch(df, 0, f"{tmp}/out", writer)
    # Finished: not written again.
    via._batch(df, 0, f"{tmp}/out", writer)
    assert Reader(spark).read(f"{tmp}/out").size() == 33
    # Not finished: what it left is replaced.
    files.delete(spark, f"{tmp}/out/_lodestone_log/0.done")
    via._batch(df.limit(5), 0, f"{tmp}/out", writer)
    assert Reader(spark).read(f"{tmp}/out").size() == 5


def _files_by_task(monkeypatch, max_count, *names):
    """Files that each writing task makes, filled as batches are written."""
    found, write = [], Writer._parquet

    def spy(self, df, path, *more):
        rows = df.groupBy(F.spark_partition_id().alias("task"), *names).count().collect()
        found.append([sum(-(-r["count"] // max_count) for r in rows if r.task == t) for t in {r.task for r in rows}])
        write(self, df, path, *more)

    monkeypatch.setattr(Writer, "_parquet", spy)
    return found


def test_stream_partitions_of_many_files_are_shared_out(spark, tmp, monkeypatch):
    """One large value, a middling one and many small ones, all in one input task: no task writes many files, no file is too long."""
    found = _files_by_task(monkeypatch, 2, "p")
    told = []
    df = spark.range(0, 700, 1, 1).selectExpr("id", "map('k', id) AS m", "CASE WHEN id < 400 THEN 'large' WHEN id < 500 THEN 'b=/ ~' ELSE concat('v', id) END AS p")
    via = ViaParquet(spark).partition_by("p").max_count(2).post_write_handler(told.append)
    counts = via._batch(df, 0, f"{tmp}/out", Writer(spark))
    assert len(found) == 1 and len(found[0]) > 5 and max(found[0]) <= 128
    assert sum(counts.values()) == 700 and counts[f"{tmp}/out/p=large"] == 400 and len(counts) == 202
    got = Reader(spark).read(f"{tmp}/out").df
    assert got.columns == ["id", "m", "p"] and sorted((r.id, r.m["k"], r.p) for r in got.collect()) == sorted((r.id, r.m["k"], r.p) for r in df.collect())
    assert max(r["count"] for r in got.groupBy(F.col("_metadata.file_path")).count().collect()) == 2
    # Finished: not written again. Not finished: all its files are replaced.
    assert via._batch(df, 0, f"{tmp}/out", Writer(spark)) == counts and Reader(spark).read(f"{tmp}/out").size() == 700
    files.delete(spark, f"{tmp}/out/_lodestone_log/0.done")
    via._batch(df.limit(5), 0, f"{tmp}/out", Writer(spark))
    assert Reader(spark).read(f"{tmp}/out").size() == 5


def test_stream_many_files_are_shared_out(spark, tmp, monkeypatch):
    """Without partitions, from one input task, with equal records: no task writes many files, and none is too long."""
    found = _files_by_task(monkeypatch, 2)
    df = spark.range(0, 700, 1, 1).selectExpr("id DIV 10 AS id", "CASE WHEN id < 200 THEN 'same' END AS p")
    ViaParquet(spark).max_count(2)._batch(df, 0, f"{tmp}/out", Writer(spark))
    assert len(found) == 1 and len(found[0]) > 5 and max(found[0]) <= 128
    got = Reader(spark).read(f"{tmp}/out").df
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert max(r["count"] for r in got.groupBy(F.col("_metadata.file_path")).count().collect()) == 2
    assert len(files.files_at_path(spark, f"{tmp}/out")) <= 360


@pytest.fixture
def sides(spark):
    left = Dataset(spark.sql("SELECT * FROM VALUES (1, 'l1'), (2, 'l2'), (2, 'l2b'), (NULL, 'ln') AS t(id, v)"))
    right = Dataset(spark.sql("SELECT * FROM VALUES (2L, 'r2', 9), (2L, 'r2b', 8), (3L, 'r3', 7), (NULL, 'rn', 6) AS t(key, v, x)"))
    return left, right


def rows_of(ds):
    return sorted(map(tuple, ds.df.collect()), key=str)


def test_joins(sides):
    left, right = sides
    assert left.inner_join(right, "id", "key").df.columns == ["id", "v", "key", "x"]
    inner = {(2, "r2", 2, 9), (2, "r2b", 2, 8), (None, "rn", None, 6)}
    assert set(rows_of(left.inner_join(right, "id", "key"))) == inner and len(rows_of(left.inner_join(right, "id", "key"))) == 5
    lone_left, lone_right = (1, None, None, None), (None, "r3", 3, 7)
    for build in (False, True):
        assert set(rows_of(left.left_join(right, "id", "key", build))) == inner | {lone_left}
        assert set(rows_of(left.right_join(right, "id", "key", build))) == inner | {lone_right}
        assert set(rows_of(left.full_join(right, "id", "key", build))) == inner | {lone_left, lone_right}
    assert left.full_join(right, "id", "key").size() == 7
    with pytest.raises(ValueError, match="invalid join path"):
        left.inner_join(right, "nope", "key")


def test_joins_with_an_empty_side(sides):
    left, right = sides
    none = Dataset(right.df.where("false"))
    assert rows_of(left.left_join(none, "id", "key")) == sorted([(1, None, None, None), (2, None, None, None), (2, None, None, None), (None, None, None, None)], key=str)
    assert left.inner_join(none, "id", "key").size() == 0 and left.right_join(none, "id", "key").size() == 0
    assert Dataset(left.df.where("false")).full_join(right, "id", "key").size() == 4


def test_self_join_and_decimal_keys(spark):
    d = Dataset(spark.sql("SELECT CAST(1.50 AS DECIMAL(5,2)) AS k, 1 AS a"))
    e = Dataset(spark.sql("SELECT CAST(1.5 AS DECIMAL(9,1)) AS k2, 2 AS b"))
    assert d.inner_join(e, "k", "k2").size() == 1 and d.inner_join(d, "k", "k").df.columns == ["k", "a"]


def test_concat(spark):
    a, b = Dataset(spark.sql("SELECT 1 AS x, 'a' AS y")), Dataset(spark.sql("SELECT 2L AS x, true AS z"))
    assert rows_of(a.concat(b)) == sorted([(1, "a", None), (2, None, True)], key=str)
    assert rows_of(a.concat(b).as_(group(optional("x", "int")))) == [(1,), (2,)]


def test_entry_registers_queries_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and json.dumps(e.oracle_sql())


def test_statistics_from_footers(spark, tmp):
    df = spark.range(1000).selectExpr("id", "CAST(id AS int) AS i", "date_add(DATE'1970-01-01', CAST(id AS int)) AS d", "CAST(id AS string) AS t", "CAST(NULL AS int) AS none", "CAST(id AS double) AS x")
    df.repartition(3).write.parquet(f"{tmp}/s")
    found = StatsBuilder(spark).stats(f"{tmp}/s")
    plan = found.footer_plan("id", "d")._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), MIN(d), MAX(d)]" in plan
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert tuple(found.summary("id", "i").first()) == (1000, 0, 999, 0, 999) and found.record_count() == 1000 and str(found.max("d")) == "1972-09-26"
    assert found.from_footers("none") is None and found.min("none") is None
    assert found.footer_plan("t") is None and found.footer_plan("x") is None and found.min("t") == "0" and found.max("x") == 999.0 and found.min("gone") is None
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    filtered = StatsBuilder(spark).filter(Col("id") > 10).stats(f"{tmp}/s")
    assert filtered.footer_plan("id") is None and filtered.min("id") == 11


def test_options_of_a_read_do_not_outlive_it(spark, tmp):
    spark.range(3).write.parquet(f"{tmp}/o")
    zone, hadoop = spark.conf.get("spark.sql.session.timeZone"), spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("parquet.hadoop.vectored.io.enabled")
    d = Reader(spark).options(time_zone="Asia/Tokyo", vectored_io=False, hadoop={"x.y.z": "1"}).read(f"{tmp}/o")
    assert d.df.count() == 3 and spark.conf.get("spark.sql.session.timeZone") == zone
    assert d.df.selectExpr("CAST(timestamp_seconds(0) AS string) AS s").first().s == "1970-01-01 09:00:00"
    assert hadoop.get("parquet.hadoop.vectored.io.enabled") == before and hadoop.get("x.y.z") is None


def test_records_by_file(spark, tmp):
    spark.range(30).repartition(3).write.parquet(f"{tmp}/f")
    got = Reader(spark).filter(Col("id") >= 0).read_by_file(f"{tmp}/f").df.groupBy("file").count().collect()
    assert len(got) == 3 and sum(r["count"] for r in got) == 30


def test_overwritten_file_steps_aside(spark, tmp):
    for n in (3, 5):
        Writer(spark).options(mode=OVERWRITE).write_and_close(f"{tmp}/one.parquet", spark.range(n).coalesce(1))
    assert spark.read.parquet(f"{tmp}/one.parquet").count() == 5 and [x for x in os.listdir(tmp.removeprefix("file://")) if not x.startswith(".one.parquet.crc")] == ["one.parquet"]
