"""Schemas: a small builder, walks over paths, and ``conform``, which gives a DataFrame a schema's types.

``conform`` follows the decoding rules of the data model: an optional field that is missing becomes null, a required one that is missing
or null is an error, numbers are coerced (a long in an int field wraps around), decimals are rescaled half up, structs, lists
and maps are conformed inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.codecs import to_type, type_named


class CodecError(ValueError):
    """A value or field that a schema does not admit."""


@dataclass(frozen=True)
class Codec:
    """Storage of a user's type: its Spark type and the column functions into and out of it."""

    type: T.DataType
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def required(name: str, type_: T.DataType | str) -> T.StructField:
    return T.StructField(name, type_named(type_), False)


def optional(name: str, type_: T.DataType | str) -> T.StructField:
    return T.StructField(name, type_named(type_), True)


def group(*fields: T.StructField) -> T.StructType:
    return T.StructType(list(fields))


def list_of(element: T.DataType | str, nullable: bool = True) -> T.ArrayType:
    return T.ArrayType(type_named(element), nullable)


def map_of(key: T.DataType | str, value: T.DataType | str, nullable: bool = True) -> T.MapType:
    return T.MapType(type_named(key), type_named(value), nullable)


def find_type(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path, or None."""
    at: T.DataType = schema
    for name in (x for x in path.split(".") if x):
        if not isinstance(at, T.StructType) or name not in at.fieldNames():
            return None
        at = at[name].dataType
    return at if at is not schema else None


def skip_paths(schema: T.StructType, paths: Iterable[str]) -> T.StructType:
    """The schema without some leaves; groups left empty go as well."""
    gone = {tuple(x for x in p.split(".") if x) for p in paths}

    def walk(s: T.StructType, at: tuple[str, ...]) -> T.StructType:
        out = []
        for f in s.fields:
            here = (*at, f.name)
            if here in gone:
                continue
            kind = f.dataType
            if isinstance(kind, T.StructType) and any(g[: len(here)] == here for g in gone):
                kind = walk(kind, here)
                if not kind.fields:
                    continue
            out.append(T.StructField(f.name, kind, f.nullable, f.metadata))
        return T.StructType(out)

    return walk(schema, ())


def merge_projection(fields: Iterable[T.StructField]) -> T.StructType:
    """Of fields that repeat a name, the first primitive type holds and groups are joined field by field."""
    out: dict[str, T.StructField] = {}
    for f in fields:
        have = out.get(f.name)
        if have is None:
            out[f.name] = f
        elif isinstance(have.dataType, T.StructType) and isinstance(f.dataType, T.StructType):
            out[f.name] = T.StructField(f.name, merge_projection([*have.dataType.fields, *f.dataType.fields]), have.nullable)
    return T.StructType(list(out.values()))


def conform(df: DataFrame, schema: T.StructType, codecs: Mapping[str, Codec] | None = None, strict: bool = False) -> DataFrame:
    """The DataFrame with exactly the schema's fields and types. ``strict``: a missing optional field is an error, too.

    ``codecs`` decode columns of users' types by top-level name.
    """
    columns = []
    for f in schema.fields:
        if f.name not in df.columns:
            columns.append(_absent(f, f.name, strict).alias(f.name))
            continue
        have = df.schema[f.name]
        c = F.col(f"`{f.name}`")
        if codecs and f.name in codecs:
            columns.append(codecs[f.name].decode(c).alias(f.name))
        else:
            columns.append(_field(c, have.dataType, have.nullable, f, f.name, strict).alias(f.name))
    return df.select(*columns)


def _absent(f: T.StructField, path: str, strict: bool) -> Column:
    if strict or not f.nullable:
        raise CodecError(f"field {path} is missing")
    return F.lit(None).cast(f.dataType)


def _field(c: Column, have: T.DataType, nullable: bool, f: T.StructField, path: str, strict: bool) -> Column:
    out = _value(c, have, f.dataType, path, strict)
    if f.nullable or not nullable:
        return out
    return F.when(c.isNull(), F.raise_error(F.lit(f"required field {path} is null")).cast(f.dataType)).otherwise(out)


def _value(c: Column, have: T.DataType, want: T.DataType, path: str, strict: bool) -> Column:
    if have == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        parts = []
        for f in want.fields:
            if f.name in have.fieldNames():
                inner = have[f.name]
                parts.append(_field(c.getField(f.name), inner.dataType, inner.nullable, f, f"{path}.{f.name}", strict).alias(f.name))
            else:
                parts.append(_absent(f, f"{path}.{f.name}", strict).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: _value(x, have.elementType, want.elementType, path, strict))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        keys = F.transform(F.map_keys(c), lambda x: _value(x, have.keyType, want.keyType, path, strict))
        values = F.transform(F.map_values(c), lambda x: _value(x, have.valueType, want.valueType, path, strict))
        return F.map_from_arrays(keys, values)
    if any(isinstance(t, (T.StructType, T.ArrayType, T.MapType)) for t in (have, want)):
        raise CodecError(f"field {path} is {have.simpleString()}, not {want.simpleString()}")
    return to_type(c, have, want)
