"""A declarative transform language: a JSON-like spec becomes a chain of frame operations.

    {"transforms": [{"op": "filter", "field": "x", "cmp": ">", "value": 1},
                    {"op": "derive", "as": "m", "fn": "to_period", "field": "d", "freq": "M"},
                    {"op": "topk", "k": 5, "order_by": "v", "group_by": ["g"]},
                    {"op": "aggregate", "group_by": ["g"], "measures": [{"field": "v", "agg": "sum"}]},
                    {"op": "sort", "by": [{"field": "g", "desc": true}]}],
     "constraints": {"filters": [...], "time_field": "d", "time_range": ["2020-01-01", "2020-12-31"]}}

Literals keep their types.  An unknown filter or aggregate is an error, not a silent no-op, and
all measures of an aggregate are computed.  A date that does not parse gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import month_text, quarter_text
from sparkloom.params import listed


class SpecError(ValueError):
    """The spec names something the language does not have."""


class EmptyResult(ValueError):
    """Nothing to work on, before or after the transforms."""


_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median,
    "nunique": F.count_distinct, "std": F.stddev_samp, "var": F.var_samp,
    "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
}


def condition(field: str, cmp: str, value: object) -> Column:
    """One filter.  Missing values fail all but ``!=`` and ``not in``, which keep them."""
    c = F.col(field)
    if cmp in ("==", "="):
        return c == F.lit(value)
    if cmp == "!=":
        return ~c.eqNullSafe(F.lit(value))
    if cmp in (">", "<", ">=", "<="):
        return {">": c.__gt__, "<": c.__lt__, ">=": c.__ge__, "<=": c.__le__}[cmp](F.lit(value))
    if cmp == "in":
        return c.isin(*listed_values(value))
    if cmp == "not in":
        return ~c.isin(*listed_values(value)) | c.isNull()
    if cmp == "between":
        low, high, *_ = listed_values(value) if len(listed_values(value)) > 1 else (None, None)
        if low is None:
            raise SpecError("between needs two values")
        return c.between(F.lit(low), F.lit(high))
    if cmp == "contains":
        return F.coalesce(c.cast("string").rlike(str(value)), F.lit(False))
    raise SpecError(f"unknown filter {cmp!r}")


def listed_values(value: object) -> list:
    return list(value) if isinstance(value, Sequence) and not isinstance(value, str) else [value]


def parsed_time(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string"))


def period(field: str, freq: str) -> Column:
    t = parsed_time(F.col(field))
    made = {"M": month_text(t), "Q": quarter_text(t), "Y": F.year(t).cast("string"), "D": F.date_format(t, "yyyy-MM-dd")}
    if freq not in made:
        raise SpecError(f"unknown period {freq!r}")
    return made[freq]


def _filter(df: DataFrame, t: Mapping) -> DataFrame:
    return df.filter(condition(t["field"], t["cmp"], t.get("value")))


def _derive(df: DataFrame, t: Mapping) -> DataFrame:
    if t.get("fn") == "to_period":
        return df.withColumn(t["as"], period(t["field"], t.get("freq", "M")))
    if t.get("fn") in (None, "copy"):
        return df.withColumn(t["as"], F.col(t["field"]) if t["field"] in df.columns else F.lit(None).cast("string"))
    raise SpecError(f"unknown function {t['fn']!r}")


def _topk(df: DataFrame, t: Mapping) -> DataFrame:
    key = F.col(t["order_by"])
    tie = [F.col(c).asc_nulls_last() for c in listed(t.get("tie"))]
    order = [key.desc_nulls_last() if t.get("desc", True) else key.asc_nulls_last(), *tie]
    groups = listed(t.get("group_by"))
    if not groups:
        return df.orderBy(*order).limit(int(t.get("k", 5)))
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= int(t.get("k", 5))).drop("__r")


def _aggregate(df: DataFrame, t: Mapping) -> DataFrame:
    made = []
    for m in t.get("measures") or []:
        agg = m.get("agg", "sum")
        if agg not in _AGGREGATES:
            raise SpecError(f"unknown aggregate {agg!r}")
        made.append(_AGGREGATES[agg](F.col(m["field"])).alias(m.get("as", m["field"])))
    if not made:
        raise SpecError("aggregate needs a measure")
    return df.groupBy(*listed(t.get("group_by"))).agg(*made)


def _sort(df: DataFrame, t: Mapping) -> DataFrame:
    return df.orderBy(*[F.col(k["field"]).desc_nulls_last() if k.get("desc") else F.col(k["field"]).asc_nulls_last() for k in t["by"]])


_STEPS = {"filter": _filter, "derive": _derive, "topk": _topk, "aggregate": _aggregate, "sort": _sort}


def compile_spec(spec: Mapping) -> list[Callable[[DataFrame], DataFrame]]:
    """The steps of a spec, transforms first and then constraints."""
    steps: list[Callable[[DataFrame], DataFrame]] = []
    for t in spec.get("transforms") or []:
        if t.get("op") not in _STEPS:
            raise SpecError(f"unknown transform {t.get('op')!r}")
        steps.append(lambda df, t=t: _STEPS[t["op"]](df, t))
    limits = spec.get("constraints") or {}
    for f in limits.get("filters") or []:
        steps.append(lambda df, f=f: _filter(df, f))
    if limits.get("time_range") and limits.get("time_field"):
        low, high = limits["time_range"]
        steps.append(lambda df: df.filter(parsed_time(F.col(limits["time_field"])).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp"))))
    return steps


def run_spec(df: DataFrame, spec: Mapping, check_empty: bool = False) -> DataFrame:
    """Apply a spec; with ``check_empty`` an empty input or result is an error (one small job each)."""
    if check_empty and df.isEmpty():
        raise EmptyResult("the input is empty")
    for step in compile_spec(spec):
        df = df.transform(step)
    if check_empty and df.isEmpty():
        raise EmptyResult("nothing is left after the transforms")
    return df
