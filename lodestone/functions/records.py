"""Operations on the fields of records, their lists and maps, as DataFrame and column functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.column import elements, quoted
from lodestone.plans.schema import find_type


def _col(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _named(df: DataFrame, index: int) -> str:
    if not -len(df.columns) <= index < len(df.columns):
        raise IndexError(index)
    return df.columns[index]


def updated(df: DataFrame, field: str | int, value: Any, name: str | None = None) -> DataFrame:
    """Adds a field at the end or replaces it where it is. A dotted path goes into structs and makes those that are missing; an index
    replaces a field by position, under a new ``name`` if given."""
    if isinstance(field, int):
        old = _named(df, field)
        place = df.columns.index(old)
        return df.select(*[_col(value).alias(name or c) if i == place else F.col(quoted([c])) for i, c in enumerate(df.columns)])
    head, *rest = elements(field)
    if not rest:
        return df.withColumn(head, _col(value))
    return df.withColumn(head, _into(F.col(quoted([head])) if head in df.columns else None, df.schema[head].dataType if head in df.columns else None, rest, _col(value), head))


def _into(c: Column | None, kind: T.DataType | None, path: list[str], value: Column, at: str) -> Column:
    """The struct ``c`` with a value at a path; a null struct comes to be."""
    if kind is not None and not isinstance(kind, T.StructType):
        raise ValueError(f"{at} is no struct")
    name, rest = path[0], path[1:]
    fields = kind.fieldNames() if kind is not None else []
    parts, seen = [], False
    for f in fields:
        own = c.getField(f)
        if f == name:
            own, seen = (_into(own, kind[f].dataType, rest, value, f"{at}.{f}") if rest else value), True
        parts.append(own.alias(f))
    if not seen:
        parts.append((_into(None, None, rest, value, f"{at}.{name}") if rest else value).alias(name))
    return F.struct(*parts)


def removed(df: DataFrame, field: str | int) -> DataFrame:
    """Drops a field by name, index or path; a struct left empty goes as well."""
    if isinstance(field, int):
        field = quoted([_named(df, field)]).strip("`")
        return df.drop(field)
    path = elements(field)
    if find_type(df.schema, field) is None:
        return df
    while len(path) > 1:
        parent = find_type(df.schema, ".".join(path[:-1]))
        if len(parent.fields) > 1:
            return df.withColumn(path[0], F.col(quoted([path[0]])).dropFields(quoted(path[1:])))
        path = path[:-1]
    return df.drop(path[0])


def renamed(df: DataFrame, index: int, name: str) -> DataFrame:
    place = df.columns.index(_named(df, index))
    return df.toDF(*[name if i == place else c for i, c in enumerate(df.columns)])


def prepended(df: DataFrame, name: str, value: Any) -> DataFrame:
    return df.select(_col(value).alias(name), *[F.col(quoted([c])) for c in df.columns if c != name])


def merged(df: DataFrame, fields: dict[str, Any]) -> DataFrame:
    """With the other record's fields: on a clash theirs win, at the place of ours."""
    own = [(_col(fields[c]) if c in fields else F.col(quoted([c]))).alias(c) for c in df.columns]
    return df.select(*own, *[_col(v).alias(k) for k, v in fields.items() if k not in df.columns])


def contains(df: DataFrame, name: str) -> bool:
    return name in df.columns


def empty(spark, schema: T.StructType) -> DataFrame:
    """A record of nulls."""
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def list_appended(c: Column, value: Any) -> Column:
    return F.array_append(c, _col(value))


def list_at(c: Column, index: int) -> Column:
    """From 0; null beyond the end."""
    return F.try_element_at(c, F.lit(index + 1))


def list_updated(c: Column, index: int, value: Any) -> Column:
    return F.transform(c, lambda x, i: F.when(i == index, _col(value)).otherwise(x))


def list_length(c: Column) -> Column:
    return F.size(c)


def map_updated(c: Column, key: Any, value: Any) -> Column:
    """The other entries, and this one last."""
    return F.map_concat(F.map_filter(c, lambda k, _: k != _col(key)), F.create_map(_col(key), _col(value)))


def map_apply(c: Column, key: Any) -> Column:
    """An error where the key is missing."""
    return F.when(F.map_contains_key(c, _col(key)), F.try_element_at(c, _col(key))).otherwise(F.raise_error(F.lit("no such key")))


def map_get(c: Column, key: Any) -> Column:
    """Null where the key is missing."""
    return F.try_element_at(c, _col(key))
