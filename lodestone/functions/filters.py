"""Predicates with explicit null semantics, compiled to Catalyst expressions that reach the Parquet scan.

A filter is two-valued: a row is in or out. On a null cell, ``==``, orderings and ``in`` are out, and ``!=`` is *in*. Negation is pushed to
the leaves and turns each into its inverse there: ``not (x == v)`` keeps nulls, ``not (x < v)`` is ``x >= v`` and drops them, ``not in``
keeps them. What is compiled has no NOT above a leaf, so SQL's third value can only mean "out" and nothing needs
to be wrapped in a way that would hide it from pushdown.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INVERSE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


@dataclass(frozen=True)
class Scope:
    """Where a filter is compiled: how a path is read, its type, and whether it is a partition column."""

    column: Callable[[str], Column]
    type: Callable[[str], T.DataType]
    partitions: frozenset[str] = frozenset()


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return _pair(self, other, And)

    def __or__(self, other: Filter) -> Filter:
        return _pair(self, other, Or)

    def __invert__(self) -> Filter:
        return Not(self)

    def compile(self, scope: Scope) -> Column:
        raise NotImplementedError

    def negated(self, scope: Scope) -> Column:
        """The inverse, pushed to the leaves."""
        raise NotImplementedError


def _pair(a: Filter, b: Filter, kind: type) -> Filter:
    if isinstance(a, RecordFilter) or isinstance(b, RecordFilter):
        raise TypeError("a record filter cannot be combined with other filters")
    return kind(a, b)


class Noop(Filter):
    """Keeps all rows."""

    def compile(self, scope: Scope) -> Column:
        return F.lit(True)

    def negated(self, scope: Scope) -> Column:
        return F.lit(False)


NOOP = Noop()


@dataclass(frozen=True)
class And(Filter):
    left: Filter
    right: Filter

    def compile(self, scope: Scope) -> Column:
        return self.left.compile(scope) & self.right.compile(scope)

    def negated(self, scope: Scope) -> Column:
        return self.left.negated(scope) | self.right.negated(scope)


@dataclass(frozen=True)
class Or(Filter):
    left: Filter
    right: Filter

    def compile(self, scope: Scope) -> Column:
        return self.left.compile(scope) | self.right.compile(scope)

    def negated(self, scope: Scope) -> Column:
        return self.left.negated(scope) & self.right.negated(scope)


@dataclass(frozen=True)
class Not(Filter):
    inner: Filter

    def __post_init__(self) -> None:
        if isinstance(self.inner, RecordFilter):
            raise TypeError("a record filter cannot be combined with other filters")

    def compile(self, scope: Scope) -> Column:
        return self.inner.negated(scope)

    def negated(self, scope: Scope) -> Column:
        return self.inner.compile(scope)


def literal(value: Any, path: str, scope: Scope) -> Column:
    """A literal for comparison with a path: checked against partition columns, decimals in the column's own scale."""
    if path in scope.partitions:
        if not isinstance(value, str):
            raise ValueError(f"partition column {path} holds text; it cannot be compared with {value!r}")
        return F.lit(value)
    kind = scope.type(path)
    if isinstance(value, decimal.Decimal) and isinstance(kind, T.DecimalType):
        rescaled = value.quantize(decimal.Decimal(1).scaleb(-kind.scale), decimal.ROUND_HALF_UP)
        return F.lit(rescaled)
    if isinstance(value, str) and len(value) == 1 and isinstance(kind, T.IntegralType):
        return F.lit(ord(value))
    if isinstance(value, (bytes, memoryview)):
        return F.lit(bytearray(value))
    return F.lit(value)


@dataclass(frozen=True)
class Compare(Filter):
    path: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.value is None:
            raise ValueError("null is tested by is_null")
        if isinstance(self.value, bool) and self.op not in ("==", "!="):
            raise TypeError("booleans have no order")

    def _column(self, op: str, scope: Scope) -> Column:
        c, v = scope.column(self.path), literal(self.value, self.path, scope)
        if op == "!=":
            return ~c.eqNullSafe(v)
        return {"==": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]

    def compile(self, scope: Scope) -> Column:
        return self._column(self.op, scope)

    def negated(self, scope: Scope) -> Column:
        return self._column(_INVERSE[self.op], scope)


@dataclass(frozen=True)
class In(Filter):
    path: str
    values: tuple

    def __post_init__(self) -> None:
        if not self.values:
            raise ValueError("in needs at least one value")

    def compile(self, scope: Scope) -> Column:
        return scope.column(self.path).isin(*[literal(v, self.path, scope) for v in self.values])

    def negated(self, scope: Scope) -> Column:
        return scope.column(self.path).isNull() | ~self.compile(scope)


@dataclass(frozen=True)
class IsNull(Filter):
    path: str
    null: bool

    def compile(self, scope: Scope) -> Column:
        c = scope.column(self.path)
        return c.isNull() if self.null else c.isNotNull()

    def negated(self, scope: Scope) -> Column:
        return IsNull(self.path, not self.null).compile(scope)


@dataclass(frozen=True)
class Udp:
    """A user's predicate over one column.

    ``column`` makes a Catalyst expression (preferred); else ``keep`` is called for each value, in Arrow batches. ``keep_null`` says what
    holds for null; by default ``keep(None)`` is asked, and an error there means no. An opaque ``keep`` can't be pushed
    down; ``may_keep`` and ``may_keep_inverse`` are column expressions that are true wherever the predicate (its inverse) may be, such as
    a range, and are put before it for the scan's sake.
    """

    column: Callable[[Column], Column] | None = None
    keep: Callable[[Any], bool] | None = None
    keep_null: bool | None = None
    may_keep: Callable[[Column], Column] | None = None
    may_keep_inverse: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if (self.column is None) == (self.keep is None):
            raise ValueError("a predicate is given either as column or as keep")

    def on_null(self) -> bool:
        if self.keep_null is not None:
            return self.keep_null
        if self.keep is None:
            return False
        try:
            return bool(self.keep(None))
        except (TypeError, AttributeError, ValueError):
            return False

    def holds(self, c: Column) -> Column:
        """Never null."""
        if self.column is not None:
            found = self.column(c)
        else:
            keep = self.keep

            @F.arrow_udf(T.BooleanType())
            def kept(values: pa.Array) -> pa.Array:
                return pa.array([v is not None and bool(keep(v)) for v in values.to_pylist()], pa.bool_())

            found = kept(c)
        return F.when(c.isNull(), F.lit(self.on_null())).otherwise(F.coalesce(found, F.lit(False)))


@dataclass(frozen=True)
class UserDefined(Filter):
    path: str
    predicate: Udp

    def compile(self, scope: Scope) -> Column:
        c = scope.column(self.path)
        found = self.predicate.holds(c)
        if self.predicate.may_keep is None:
            return found
        first = self.predicate.may_keep(c)
        return (first | c.isNull() if self.predicate.on_null() else first) & found

    def negated(self, scope: Scope) -> Column:
        c = scope.column(self.path)
        found = ~self.predicate.holds(c)
        if self.predicate.may_keep_inverse is None:
            return found
        first = self.predicate.may_keep_inverse(c)
        return (first if self.predicate.on_null() else first | c.isNull()) & found


@dataclass(frozen=True)
class RecordFilter(Filter):
    """Keeps records by their ordinal in the file. ``predicate`` takes and gives a Column."""

    predicate: Callable[[Column], Column]

    @classmethod
    def between(cls, start: int, end: int) -> RecordFilter:
        """Ordinals from start to before end."""
        return cls(lambda i: (i >= start) & (i < end))

    def compile(self, scope: Scope) -> Column:
        return self.predicate(F.col("_metadata.row_index"))


def scope_of(schema: T.StructType, partitions: Mapping[str, Any] | frozenset[str] = frozenset()) -> Scope:
    """The scope of a DataFrame with this schema."""
    from lodestone.functions.column import elements, quoted
    from lodestone.plans.schema import find_type

    def type_(path: str) -> T.DataType:
        found = find_type(schema, path)
        if found is None:
            raise ValueError(f"there is no column {path}")
        return found

    def column(path: str) -> Column:
        type_(path)
        return F.col(quoted(elements(path)))

    return Scope(column, type_, frozenset(partitions))
