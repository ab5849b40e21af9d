"""Condition lists of mapping documents as one boolean Column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F, types as T


def _listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


# Operator names of a condition, the spellings of documents and of the catalogue.
_OPERATORS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    "==": lambda c, v: c == v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "not like": lambda c, v: ~c.like(v),
    "in": lambda c, v: c.isin(_listed(v)),
    "not in": lambda c, v: ~c.isin(_listed(v)),
    "is_null": lambda c, v: c.isNull(),
    "is null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
    "is not null": lambda c, v: c.isNotNull(),
}


def _comparable(left: Column, left_type, right: Column, right_type) -> tuple[Column, Column]:
    """Text against a number compares as numbers; text that is no number gives null, not an error."""
    left_text, right_text = isinstance(left_type, T.StringType), isinstance(right_type, T.StringType)
    if left_text and isinstance(right_type, T.NumericType):
        return left.try_cast("double"), right
    if right_text and isinstance(left_type, T.NumericType):
        return left, right.try_cast("double")
    return left, right


def _type_of(value) -> T.DataType | None:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, (int, float)):
        return T.DoubleType()
    return T.StringType() if isinstance(value, str) else None


def condition(spec: Mapping, schema: T.StructType | None = None) -> Column:
    """``{column, operator, value | value_column}``; an unknown operator is an error.

    With the frame's ``schema``, mixed text and number comparisons are settled as described above.
    """
    operator = str(spec.get("operator"))
    build = _OPERATORS.get(operator.lower())
    if build is None:
        raise ValueError(f"unknown operator {operator!r} in condition on {spec.get('column')!r}")
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    name, other, value = spec["column"], spec.get("value_column"), spec.get("value")
    column = F.col(name)
    if other and operator.lower() in ("like", "not like"):
        matched = F.like(column, F.col(other))
        return matched if operator.lower() == "like" else ~matched
    if other:
        return build(*_comparable(column, types.get(name), F.col(other), types.get(other)))
    if operator in ("==", "=", "!=", "<", "<=", ">", ">=") and value is not None:
        return build(*_comparable(column, types.get(name), F.lit(value), _type_of(value)))
    return build(column, value)


def all_conditions(specs: Sequence[Mapping] | None, schema: T.StructType | None = None) -> Column | None:
    """All conditions together; None for an empty list, which means no filter."""
    if not specs:
        return None
    return reduce(lambda a, b: a & b, [condition(s, schema) for s in specs])
