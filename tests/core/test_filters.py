"""Every comparison against its two-valued meaning, on rows with nulls, and what reaches the scan."""

import datetime
import decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.functions.column import Col
from lodestone.functions.filters import NOOP, RecordFilter, Udp
from lodestone.operators.dataset import Dataset
from lodestone.sources.reader import Reader

ROWS = [(1, "a"), (None, None), (3, "b"), (2, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return Dataset(spark.createDataFrame(ROWS, "i int, s string"))


def kept(ds, f):
    return sorted((r.i is None, r.i) for r in ds.where(f).df.collect())


def want(pred):
    return sorted((i is None, i) for i, s in ROWS if pred(i, s))


I, S = Col("i"), Col("s")
CASES = {
    "eq": (I == 1, lambda i, s: i == 1),
    "ne keeps null": (I != 1, lambda i, s: i != 1),
    "gt": (I > 1, lambda i, s: i is not None and i > 1),
    "ge": (I >= 2, lambda i, s: i is not None and i >= 2),
    "lt": (I < 2, lambda i, s: i is not None and i < 2),
    "le": (I <= 2, lambda i, s: i is not None and i <= 2),
    "in": (I.in_(1, 3), lambda i, s: i in (1, 3)),
    "not in keeps null": (~I.in_([1, 3]), lambda i, s: i not in (1, 3)),
    "not eq keeps null": (~(I == 1), lambda i, s: i != 1),
    "not ne drops null": (~(I != 1), lambda i, s: i == 1),
    "not lt drops null": (~(I < 2), lambda i, s: i is not None and i >= 2),
    "null": (S.is_null(), lambda i, s: s is None),
    "not null": (~S.is_null(), lambda i, s: s is not None),
    "and": ((I > 1) & (S != "b"), lambda i, s: i is not None and i > 1 and s != "b"),
    "or": ((I == 1) | S.is_null(), lambda i, s: i == 1 or s is None),
    "not and": (~((I > 1) & (S == "b")), lambda i, s: (i is not None and i <= 1) or s != "b"),
    "not or": (~((I == 1) | (S == "b")), lambda i, s: i != 1 and s != "b"),
    "noop": (NOOP, lambda i, s: True),
    "not noop": (~NOOP, lambda i, s: False),
    "udp": (I.udp(Udp(column=lambda c: c % 2 == 1)), lambda i, s: i is not None and i % 2 == 1),
    "udp null": (I.udp(Udp(column=lambda c: c % 2 == 1, keep_null=True)), lambda i, s: i is None or i % 2 == 1),
    "not udp": (~I.udp(Udp(column=lambda c: c % 2 == 1)), lambda i, s: i is None or i % 2 == 0),
    "python udp": (I.udp(Udp(keep=lambda v: v > 1, may_keep=lambda c: c > 0)), lambda i, s: i is not None and i > 1),
    "not python udp": (~I.udp(Udp(keep=lambda v: v > 1, may_keep_inverse=lambda c: c < 9)), lambda i, s: i is None or i <= 1),
    "python udp of null": (I.udp(Udp(keep=lambda v: v is None or v == 3)), lambda i, s: i is None or i == 3),
}


@pytest.mark.parametrize("name", CASES)
def test_null_semantics(rows, name):
    f, pred = CASES[name]
    assert kept(rows, f) == want(pred)


LEAVES = st.sampled_from([CASES[k] for k in ("eq", "ne keeps null", "lt", "in", "null", "udp", "udp null")])
TREES = st.recursive(
    LEAVES,
    lambda t: st.one_of(
        t.map(lambda x: ("not", x)), st.tuples(t, t).map(lambda x: ("and", *x)), st.tuples(t, t).map(lambda x: ("or", *x)),
    ),
    max_leaves=6,
)


def build(t):
    """The filter, its meaning and the meaning of its inverse, which at a leaf isn't always the complement."""
    if t[0] == "not":
        f, yes, no = build(t[1])
        return ~f, no, yes
    if t[0] in ("and", "or"):
        (f, fy, fn), (g, gy, gn) = build(t[1]), build(t[2])
        if t[0] == "and":
            return f & g, lambda i, s: fy(i, s) and gy(i, s), lambda i, s: fn(i, s) or gn(i, s)
        return f | g, lambda i, s: fy(i, s) or gy(i, s), lambda i, s: fn(i, s) and gn(i, s)
    f, yes = t
    ordered = f is CASES["lt"][0]
    return f, yes, (lambda i, s: i is not None and not yes(i, s)) if ordered else (lambda i, s: not yes(i, s))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TREES)
def test_any_nesting(rows, tree):
    f, yes, _ = build(tree)
    assert kept(rows, f) == want(yes)


def test_errors(rows):
    with pytest.raises(ValueError):
        I.in_([])
    with pytest.raises(TypeError):
        (I == 1) & RecordFilter.between(0, 1)
    with pytest.raises(TypeError):
        ~RecordFilter.between(0, 1)
    with pytest.raises(ValueError):
        rows.where(Col("nothing") == 1)
    with pytest.raises(TypeError):
        Col("b") > True


def test_literal_types(spark):
    df = spark.sql(
        "SELECT true AS b, 1Y AS y, 2S AS h, 3 AS i, 4L AS l, 1.5F AS f, 2.5D AS d, 'x' AS s, X'0102' AS n, DATE'2020-02-01' AS t,"
        " CAST(1.25 AS DECIMAL(10,2)) AS m, TIMESTAMP'2020-01-01 00:00:00' AS ts, 97 AS ch"
    )
    values = {
        "b": True, "y": 1, "h": 2, "i": 3, "l": 4, "f": 1.5, "d": 2.5, "s": "x", "n": b"\x01\x02", "t": datetime.date(2020, 2, 1),
        "m": decimal.Decimal("1.250"), "ts": datetime.datetime(2020, 1, 1), "ch": "a",
    }
    for name, v in values.items():
        assert Dataset(df).where(Col(name) == v).size() == 1, name
        assert Dataset(df).where(Col(name) != v).size() == 0, name
    assert Dataset(df).where(Col("m") == decimal.Decimal("1.246")).size() == 1  # rounded half up to the column's scale


def test_pushdown(spark, tmp):
    spark.range(100).selectExpr("id", "struct(id AS leaf) AS s").write.parquet(f"{tmp}/t")
    ds = Reader(spark).filter((Col("id") >= 50) & (Col("id") != 70) & (Col("s.leaf") < 60)).projected_generic(Col("id")).read(f"{tmp}/t")
    plan = ds.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,50)" in plan and "EqualNullSafe(id,70)" in plan and "LessThan(s.leaf,60)" in plan
    assert sorted(r.id for r in ds.df.collect()) == list(range(50, 60))


def test_record_filter_over_row_groups(spark, tmp):
    spark.range(5000, numPartitions=1).write.option("parquet.block.size", 2048).option("parquet.page.size", 512).parquet(f"{tmp}/t")
    ds = Reader(spark).filter(RecordFilter(lambda i: (i >= 2990) & (i < 3010))).read(f"{tmp}/t")
    assert sorted(r.id for r in ds.df.collect()) == list(range(2990, 3010))
