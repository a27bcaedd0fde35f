"""Scalar conversions that Spark's casts don't give as they are."""

from __future__ import annotations

import decimal
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMED = {
    "boolean": T.BooleanType(), "byte": T.ByteType(), "tinyint": T.ByteType(), "short": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(),
    "long": T.LongType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}
_DECIMAL = re.compile(r"decimal\((\d+),\s*(\d+)\)")


def type_named(name: str | T.DataType) -> T.DataType:
    """A type by its name; primitive ones need no session."""
    if isinstance(name, T.DataType):
        return name
    if m := _DECIMAL.fullmatch(name.strip()):
        return T.DecimalType(int(m.group(1)), int(m.group(2)))
    return _NAMED.get(name.strip()) or T.DataType.fromDDL(name)


_WIDTH = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}


def wrapped(c: Column, bits: int) -> Column:
    """The low bits of a whole number as a signed one, as a narrowing conversion leaves them."""
    half = 1 << (bits - 1)
    low = c.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(low >= half, low - F.lit(1 << bits)).otherwise(low)


def to_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A primitive as another: whole numbers narrow by wrapping, the rest casts (decimals half up)."""
    bits = _WIDTH.get(type(want))
    if bits and isinstance(have, T.IntegralType):
        return wrapped(c, bits).cast(want)
    if isinstance(have, T.BinaryType) and isinstance(want, T.StringType):
        return F.decode(c, "utf-8")
    return c.cast(want)


def rescaled(c: Column, precision: int, scale: int) -> Column:
    """A decimal in a format, half up."""
    return c.cast(T.DecimalType(precision, scale))


def rescale(value: decimal.Decimal, precision: int, scale: int) -> decimal.Decimal:
    """The same on the driver: first to the precision's significant digits, then to the scale."""
    short = decimal.Context(prec=precision, rounding=decimal.ROUND_HALF_UP).plus(value)
    return short.quantize(decimal.Decimal(1).scaleb(-scale), decimal.ROUND_HALF_UP, decimal.Context(prec=76))


def timestamp_of(c: Column, unit: str) -> Column:
    """A timestamp from a whole number of ``millis``, ``micros`` or ``nanos`` (nanoseconds are cut off)."""
    if unit == "millis":
        return F.timestamp_millis(c)
    if unit == "micros":
        return F.timestamp_micros(c)
    if unit == "nanos":
        return F.timestamp_micros(_div(c, 1000))
    raise ValueError(f"unknown unit {unit}")


def _div(c: Column, by: int) -> Column:
    """Whole division downwards, without going through doubles."""
    return F.floor(c.cast(T.DecimalType(20, 0)) / F.lit(by)).cast("long")


def units_of(c: Column, unit: str) -> Column:
    """A timestamp as a whole number of units."""
    if unit == "millis":
        return F.unix_millis(c)
    if unit == "micros":
        return F.unix_micros(c)
    if unit == "nanos":
        return F.unix_micros(c) * F.lit(1000)
    raise ValueError(f"unknown unit {unit}")


def epoch_day(c: Column) -> Column:
    return F.unix_date(c)


def local_to_instant(c: Column, zone: str) -> Column:
    return F.to_utc_timestamp(c, zone)


def instant_to_local(c: Column, zone: str) -> Column:
    return F.from_utc_timestamp(c, zone)


def char_code(c: Column) -> Column:
    """The code of a text's first character, as characters are stored."""
    return F.ascii(c)


def char_of(c: Column) -> Column:
    return F.call_function("chr", c)


def url_encoded(c: Column) -> Column:
    return F.url_encode(c)


def url_decoded(c: Column) -> Column:
    return F.url_decode(c)
