"""Column paths: the names that filters, projections and joins are written in.

A path is dot-separated and may lead into structs; empty elements are dropped, so ``"a..b"`` is ``a.b``. A path may carry a type to
cast to, an alias to come out under, and an encoder for literals of a user's own type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import filters
from lodestone.functions.codecs import type_named


def elements(path: str) -> tuple[str, ...]:
    return tuple(x for x in path.split(".") if x)


def quoted(parts: Iterable[str]) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


@dataclass(frozen=True, eq=False)
class Col:
    """A path with what may hang on it. Comparison operators make filters."""

    path: str
    type: T.DataType | None = None
    name: str | None = None
    encode: Callable[[Any], Any] | None = None

    @property
    def elements(self) -> tuple[str, ...]:
        return elements(self.path)

    @property
    def output(self) -> str:
        """The alias, or else the last element."""
        return self.name or self.elements[-1]

    def as_(self, type_: T.DataType | str) -> Col:
        return replace(self, type=type_named(type_))

    def alias(self, name: str) -> Col:
        return replace(self, name=name)

    def encoded(self, encode: Callable[[Any], Any]) -> Col:
        """Literals compared with this column go through ``encode`` first."""
        return replace(self, encode=encode)

    def column(self) -> Column:
        if not self.elements:
            raise ValueError("an empty column path")
        return F.col(quoted(self.elements))

    def _leaf(self, op: str, value: Any) -> filters.Filter:
        return filters.Compare(self.path, op, self.encode(value) if self.encode else value)

    def __eq__(self, value: Any) -> filters.Filter:  # type: ignore[override]
        return self._leaf("==", value)

    def __ne__(self, value: Any) -> filters.Filter:  # type: ignore[override]
        return self._leaf("!=", value)

    def __gt__(self, value: Any) -> filters.Filter:
        return self._leaf(">", value)

    def __ge__(self, value: Any) -> filters.Filter:
        return self._leaf(">=", value)

    def __lt__(self, value: Any) -> filters.Filter:
        return self._leaf("<", value)

    def __le__(self, value: Any) -> filters.Filter:
        return self._leaf("<=", value)

    __hash__ = object.__hash__

    def in_(self, *values: Any) -> filters.Filter:
        """Membership; takes values or one collection of them, at least one."""
        if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset, range)):
            values = tuple(values[0])
        return filters.In(self.path, tuple(self.encode(v) if self.encode else v for v in values))

    def udp(self, predicate: filters.Udp) -> filters.Filter:
        return filters.UserDefined(self.path, predicate)

    def is_null(self) -> filters.Filter:
        return filters.IsNull(self.path, True)

    def is_not_null(self) -> filters.Filter:
        return filters.IsNull(self.path, False)
