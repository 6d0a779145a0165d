"""Roles of an operator (value, group, order, ...) resolved to columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Inputs = Mapping[str, DataFrame]
Params = Mapping[str, object]


class MissingRole(ValueError):
    """A role that an operator needs was not given, or names a column that is not there."""


def listed(value: object) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def require(df: DataFrame, params: Params, *roles: str) -> None:
    """Every role is given and, where it names columns, these exist."""
    for role in roles:
        if params.get(role) is None:
            raise MissingRole(f"role {role!r} is required")
        gone = [c for c in listed(params[role]) if c not in df.columns]
        if gone:
            raise MissingRole(f"role {role!r} names {gone[0]!r}, which is not in {df.columns}")


def ordering(params: Params, descending: bool = False) -> list[Column]:
    """The total order of the rows; Spark rows have none of their own."""
    names = listed(params.get("order"))
    if not names:
        raise MissingRole("role 'order' is required: a list of columns that orders the rows totally")
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in names]


def nan_to_null(df: DataFrame) -> DataFrame:
    """At the edge of the engine missing numbers are NULL only."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
