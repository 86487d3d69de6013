"""A filter language over document metadata, compiled to Column expressions.

``where`` maps fields to a value or to operators: $eq $ne $gt $gte $lt $lte
$in $nin $exists $contains $startswith $endswith; $and and $or take lists of
filters. Several operators on a field and several fields must all hold.

Values compare only with values of their kind: a number with numbers, a text
with texts, a truth value with truth values; another kind is never equal, less
or greater. A missing field, a JSON null and metadata that is no JSON object
are missing alike: only $ne, $nin and $exists: false accept them. Text
operators take texts literally and mind the case. ``a.b`` is a nested field.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}
_TEXT: dict[str, Callable[[Column, Column], Column]] = {
    "$contains": F.contains,
    "$startswith": F.startswith,
    "$endswith": F.endswith,
}


class FilterError(ValueError):
    """A filter that cannot be compiled."""


class _Field:
    """One field of a JSON text column, by the kind of its value."""

    def __init__(self, meta: Column, name: str) -> None:
        if not _FIELD.fullmatch(name):
            raise FilterError(f"{name!r} cannot name a field: letters, digits and _ only, parts joined by dots")
        self.path = "$." + name
        self.json = F.try_parse_json(meta)
        self.value = F.try_variant_get(self.json, self.path, "variant")

    def missing(self) -> Column:
        return self.value.isNull() | F.is_variant_null(self.value)

    def _kind(self) -> Column:
        return F.schema_of_variant(self.value)

    def number(self) -> Column:
        return F.when(self._kind().rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.json, self.path, "double"))

    def text(self) -> Column:
        return F.when(self._kind() == "STRING", F.try_variant_get(self.json, self.path, "string"))

    def truth(self) -> Column:
        return F.when(self._kind() == "BOOLEAN", F.try_variant_get(self.json, self.path, "boolean"))

    def like(self, value: Any) -> tuple[Column, Column]:
        """(this field, the value) as columns of the value's kind."""
        if isinstance(value, bool):
            return self.truth(), F.lit(value)
        if isinstance(value, (int, float)):
            return self.number(), F.lit(float(value))
        if isinstance(value, str):
            return self.text(), F.lit(value)
        raise FilterError(f"a field cannot be compared with {value!r}")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equal(field: _Field, value: Any) -> Column:
    if value is None:
        return F.lit(False)
    own, other = field.like(value)
    return _sure(own == other)


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _condition(field: _Field, op: str, value: Any) -> Column:
    if op == "$eq":
        return _equal(field, value)
    if op == "$ne":
        return ~_equal(field, value)
    if op in _COMPARE:
        if isinstance(value, bool) or value is None:
            raise FilterError(f"{op} needs a number or a text")
        return _sure(_COMPARE[op](*field.like(value)))
    if op == "$in":
        return _any([_equal(field, v) for v in value])
    if op == "$nin":
        return ~_any([_equal(field, v) for v in value])
    if op == "$exists":
        return ~field.missing() if value else field.missing()
    if op in _TEXT:
        return _sure(_TEXT[op](field.text(), F.lit(str(value))))
    raise FilterError(f"{op!r} is none of the operators on a field")


def compile_filter(where: Mapping[str, Any] | None, meta: Column | str = "meta") -> Column:
    """The filter as a boolean Column that is never null. None and {} accept all."""
    column = F.col(meta) if isinstance(meta, str) else meta
    parts: list[Column] = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            each = [compile_filter(v, column) for v in value]
            parts.append(_all(each) if key == "$and" else _any(each))
        elif key.startswith("$"):
            raise FilterError(f"{key!r} does not join filters; $and and $or do")
        else:
            field = _Field(column, key)
            operators = value.items() if isinstance(value, Mapping) else [("$eq", value)]
            parts += [_condition(field, op, v) for op, v in operators]
    return _all(parts)


def matching(docs: DataFrame, where: Mapping[str, Any] | None) -> DataFrame:
    """Documents whose ``meta`` the filter accepts."""
    return docs.where(compile_filter(where)) if where else docs
