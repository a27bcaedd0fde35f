import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import codecs, proto, records
from lodestone.functions.column import Col
from lodestone.operators.dataset import Dataset
from lodestone.plans.schema import Codec, CodecError, conform, find_type, group, list_of, map_of, merge_projection, optional, required, skip_paths


def test_conform_fields(spark):
    df = spark.sql("SELECT 5000000000L AS big, 1.25D AS d, CAST(NULL AS INT) AS gone, struct(1 AS a, 'x' AS b) AS s, array(struct(1L AS p, 2 AS q)) AS l, map('k', 1) AS m")
    want = group(
        optional("big", "int"), optional("d", "decimal(4,1)"), optional("gone", "bigint"), optional("s", group(optional("b", "string"), optional("new", "int"))),
        optional("l", list_of(group(optional("p", "int")))), optional("m", map_of("string", "bigint")), optional("absent", "date"),
    )
    row = conform(df, want).first()
    assert row.big == 705032704 and row.d == decimal.Decimal("1.3") and row.gone is None and row.s == ("x", None) and row.l == [(1,)] and row.m == {"k": 1} and row.absent is None


def test_conform_errors(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS i, struct(1 AS a) AS s")
    with pytest.raises(CodecError):
        conform(df, group(required("missing", "int")))
    with pytest.raises(CodecError):
        conform(df, group(optional("s", "string")))
    with pytest.raises(CodecError):
        conform(df, group(optional("absent", "int")), strict=True)
    with pytest.raises(Exception, match="required field i is null"):
        conform(df, group(required("i", "bigint"))).collect()


def test_null_structs_stay_null(spark):
    df = spark.createDataFrame([((1,),), (None,)], "s struct<a:int>")
    assert [r.s for r in conform(df, group(optional("s", group(optional("a", "bigint"))))).collect()] == [(1,), None]


def test_user_codec(spark):
    cents = Codec(T.LongType(), lambda c: (c * 100).cast("long"), lambda c: (c / 100).cast("decimal(10,2)"))
    df = spark.sql("SELECT 1234L AS price")
    assert conform(df, group(optional("price", "decimal(10,2)")), codecs={"price": cents}).first().price == decimal.Decimal("12.34")


def test_walks():
    s = group(required("a", group(optional("b", "int"), optional("c", group(optional("d", "int"))))), optional("e", "string"))
    assert find_type(s, "a.c.d") == T.IntegerType() and find_type(s, "a.x") is None and find_type(s, "e.f") is None and find_type(s, "") is None
    assert skip_paths(s, ["a.c.d", "e"]).simpleString() == "struct<a:struct<b:int>>"
    assert skip_paths(s, ["a.b", "a.c.d"]).simpleString() == "struct<e:string>"
    joined = merge_projection([optional("g", group(optional("x", "int"))), optional("g", group(optional("y", "int"))), optional("p", "int"), optional("p", "bigint")])
    assert joined.simpleString() == "struct<g:struct<x:int,y:int>,p:int>"


def test_projection(spark):
    ds = Dataset(spark.sql("SELECT 1L AS a, struct('x' AS b, struct(2 AS d) AS c) AS s"))
    row = ds.select(Col("a").as_("int"), Col("a").as_("string").alias("again"), Col("s.c.d"), Col("s..b").alias("t")).df
    assert row.columns == ["a", "again", "d", "t"] and tuple(row.first()) == (1, 1, 2, "x")
    with pytest.raises(ValueError, match="invalid column projection"):
        ds.select(Col("s.z"))


def test_record_operations(spark):
    df = spark.sql("SELECT 1 AS a, struct(2 AS b) AS s")
    assert records.updated(df, "s.x.y", 5).first() == (1, (2, (5,)))
    assert records.updated(df, "n.m", 5).columns == ["a", "s", "n"]
    with pytest.raises(ValueError):
        records.updated(df, "a.b", 1)
    assert records.removed(df, "s.b").columns == ["a"]
    assert records.removed(df, 0).columns == ["s"] and records.removed(df, "no").columns == ["a", "s"]
    assert records.updated(df, 0, 9, "z").first() == (9, (2,)) and records.renamed(df, 1, "t").columns == ["a", "t"]
    assert records.prepended(df, "p", 0).columns == ["p", "a", "s"]
    assert records.merged(df, {"a": 7, "q": 8}).first() == (7, (2,), 8)
    assert records.contains(df, "a") and not records.contains(df, "z")
    with pytest.raises(IndexError):
        records.updated(df, 5, 1)
    assert records.empty(spark, df.schema).first() == (None, None)
    with pytest.raises(Exception, match="no such key"):
        df.select(records.map_apply(F.create_map(F.lit("k"), F.lit(1)), "z")).collect()


def test_codecs(spark):
    df = spark.sql("SELECT 1700000000123456789L AS n, -1L AS neg")
    row = df.select(codecs.timestamp_of(F.col("n"), "nanos").cast("string").alias("a"), codecs.units_of(codecs.timestamp_of(F.col("neg"), "nanos"), "micros").alias("b")).first()
    assert row.a == "2023-11-14 22:13:20.123456" and row.b == -1
    assert codecs.rescale(decimal.Decimal("1.25"), 5, 1) == decimal.Decimal("1.3") and codecs.rescale(decimal.Decimal("-1.25"), 5, 1) == decimal.Decimal("-1.3")


def test_proto_schema():
    class F_:
        def __init__(self, name, type_, label=1, message_type=None):
            self.name, self.type, self.label, self.message_type = name, type_, label, message_type

    class D:
        def __init__(self, *fields, map_entry=False):
            self.fields, self.map_entry = fields, map_entry

    entry = D(F_("key", 9), F_("value", 5), map_entry=True)
    d = D(F_("i", 5), F_("e", 14), F_("xs", 3, 3), F_("m", 11, 3, entry), F_("sub", 11, 1, D(F_("b", 8))), F_("many", 11, 3, D(F_("y", 12))))
    assert proto.schema_of(d).simpleString() == "struct<i:int,e:string,xs:array<bigint>,m:map<string,int>,sub:struct<b:boolean>,many:array<struct<y:binary>>>"
