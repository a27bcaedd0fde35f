"""Protocol Buffers: a descriptor's fields as a Spark schema.

Descriptors are used by their public attributes (``fields``, ``name``, ``cpp_type`` or ``type``, ``label``, ``message_type``), so no library is needed here.
Enumerations are text, by name; an unknown number is kept as text, too. Maps are repeated messages with ``map_entry`` set.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers of FieldDescriptor.TYPE_*.
_SCALAR = {
    1: T.DoubleType(), 2: T.FloatType(), 3: T.LongType(), 4: T.LongType(), 5: T.IntegerType(), 6: T.LongType(), 7: T.IntegerType(), 8: T.BooleanType(), 9: T.StringType(),
    12: T.BinaryType(), 13: T.IntegerType(), 14: T.StringType(), 15: T.IntegerType(), 16: T.LongType(), 17: T.IntegerType(), 18: T.LongType(),
}
_REPEATED = 3


def schema_of(descriptor: Any) -> T.StructType:
    return T.StructType([T.StructField(f.name, _type(f), True) for f in descriptor.fields])


def _type(f: Any) -> T.DataType:
    if f.type in (10, 11):
        message = f.message_type
        if getattr(message.GetOptions() if hasattr(message, "GetOptions") else message, "map_entry", False):
            key, value = message.fields
            return T.MapType(_type(key), _type(value))
        one: T.DataType = schema_of(message)
    elif f.type in _SCALAR:
        one = _SCALAR[f.type]
    else:
        raise ValueError(f"field {f.name} has an unknown type {f.type}")
    return T.ArrayType(one) if f.label == _REPEATED else one


def enum_name(number: Column, names: dict[int, str]) -> Column:
    """An enumeration's name; numbers without one stay as text."""
    out = number.cast("string")
    for n, name in names.items():
        out = F.when(number == n, F.lit(name)).otherwise(out)
    return out


def enum_number(name: Column, numbers: dict[str, int]) -> Column:
    out = F.expr("CAST(NULL AS INT)")
    for n, number in numbers.items():
        out = F.when(name == n, F.lit(number)).otherwise(out)
    return F.coalesce(out, name.try_cast("int"))
