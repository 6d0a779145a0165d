"""The usual silent mistake of each operator: runs, looks right, and is wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.transforms import OPERATORS
from sparkloom.params import Inputs, Params, listed

Slip = Callable[[Inputs, Params], DataFrame]


def _out(p: Params, name: str) -> str:
    return str(p.get("out") or OPERATORS[name].out)


def _by(i: Inputs, p: Params, **columns) -> DataFrame:
    return i["df"].groupBy(*listed(p["group"])).agg(*[v.alias(k) for k, v in columns.items()])


SLIPS: dict[str, Slip] = {
    "weighted_mean": lambda i, p: i["df"].agg(F.avg(p["value"]).alias(_out(p, "weighted_mean"))),
    "within_group_share": lambda i, p: i["df"].withColumn(_out(p, "within_group_share"), F.col(p["value"]) / i["df"].agg(F.sum(p["value"])).scalar()),
    "pct_point": lambda i, p: i["df"].withColumn(_out(p, "pct_point"), F.try_divide(F.col(p["new"]) - F.col(p["old"]), F.col(p["old"]))),
    "dedup_then_agg": lambda i, p: _by(i, p, **{p["value"]: F.sum(p["value"])}),
    "left_join_keep_all": lambda i, p: i["df"].join(i["df2"], listed(p.get("key")) or [c for c in i["df"].columns if c in i["df2"].columns]),
    "pooled_rate": lambda i, p: _by(i, p, **{_out(p, "pooled_rate"): F.avg(F.try_divide(F.col(p["num"]), F.col(p["den"])))}),
    "median_not_mean": lambda i, p: _by(i, p, **{p["value"]: F.avg(p["value"])}),
    "cumulative_running": lambda i, p: i["df"].withColumn(_out(p, "cumulative_running"), F.col(p["value"])),
    "topn_with_ties": lambda i, p: i["df"].orderBy(F.col(p["value"]).desc_nulls_last()).limit(p["n"]),
    # A total that a missing value makes missing.
    "nan_as_zero_sum": lambda i, p: _by(i, p, **{p["value"]: F.when(F.count(p["value"]) == F.count(F.lit(1)), F.sum(p["value"]))}),
    "count_includes_empty": lambda i, p: i["df"].groupBy(p["category"]).agg(F.count(F.lit(1)).alias(_out(p, "count_includes_empty"))),
    "proportion_true": lambda i, p: _by(i, p, **{_out(p, "proportion_true"): F.sum(F.col(p["flag"]).cast("int")).cast("double")}),
    "zscore_within_group": lambda i, p: i["df"].withColumn(_out(p, "zscore_within_group"), (F.col(p["value"]) - i["df"].agg(F.avg(p["value"])).scalar()) / i["df"].agg(F.stddev_pop(p["value"])).scalar()),
    "dense_rank": lambda i, p: i["df"].withColumn(_out(p, "dense_rank"), F.rank().over(Window.orderBy(F.col(p["value"]).desc()))),
    "cumcount_per_group": lambda i, p: i["df"].withColumn(_out(p, "cumcount_per_group"), F.row_number().over(Window.orderBy(*listed(p["order"]))).cast("long")),
    "rank_pct": lambda i, p: i["df"].withColumn(_out(p, "rank_pct"), F.rank().over(Window.orderBy(p["value"])).cast("double")),
    "clip_outlier": lambda i, p: i["df"].filter(F.col(p["value"]).between(p["lo"], p["hi"])),
    "index_align": lambda i, p: _positional(i, p),
    "dtype_coerce": lambda i, p: i["df"].withColumn(_out(p, "dtype_coerce"), F.col(p["id_col"]).try_cast("long").cast("string")),
    "groupby_dropna_key": lambda i, p: i["df"].dropna(subset=listed(p["group"])).groupBy(*listed(p["group"])).agg(F.sum(p["value"]).alias(p["value"])),
    "order_dependent_dedup": lambda i, p: _first_seen(i, p),
    "resample_boundary": lambda i, p: OPERATORS["resample_boundary"].transform(i, {**p, "closed": "left", "label": "left"}),
    "string_normalize_join": lambda i, p: i["df"].join(i["df2"].select(p["key"], p["lookup_value"]), p["key"], "left"),
    "join_fanout": lambda i, p: i["df"].join(i["df2"], listed(p.get("matched_on")) or listed(p["group"])).groupBy(*listed(p["group"])).agg(F.sum(p["measure"]).alias(p["measure"])),
    "null_in_agg_count": lambda i, p: _by(i, p, **{_out(p, "null_in_agg_count"): F.count(p["value"])}),
    "scale_before_split_leakage": lambda i, p: i["df"].withColumn(p.get("scaled") or "scaled", (F.col(p["feature"]) - i["df"].agg(F.avg(p["feature"])).scalar()) / i["df"].agg(F.stddev_pop(p["feature"])).scalar()),
    "lookahead_return": lambda i, p: _future(i, p),
    "latlon_swap": lambda i, p: i["df"].withColumns({p["lat"]: F.col(p["lon"]), p["lon"]: F.col(p["lat"])}),
    "array_difference": lambda i, p: i["df"].withColumn(_out(p, "array_difference"), F.flatten(F.transform(F.col(p["a"]), lambda x: F.transform(F.col(p["b"]), lambda y: x.cast("double") - y.cast("double"))))),
}


def _positional(i: Inputs, p: Params) -> DataFrame:
    """Adds row by row, whatever the keys."""
    w = Window.orderBy(*listed(p["key"]))
    left = i["df"].withColumn("__n", F.row_number().over(w))
    right = i["df2"].select(F.col(p["addend"]).alias("__w"), F.row_number().over(Window.orderBy(*(listed(p.get("order")) or [p["addend"]]))).alias("__n"))
    return left.join(right, "__n", "left").withColumn(_out(p, "index_align"), F.col(p["value"]) + F.col("__w")).drop("__n", "__w")


def _first_seen(i: Inputs, p: Params) -> DataFrame:
    df, keys = i["df"], listed(p["key"])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*listed(p["order"]))).alias("r")).select(*keys, "r.*").select(*df.columns)


def _future(i: Inputs, p: Params) -> DataFrame:
    w = Window.partitionBy(*listed(p.get("group"))).orderBy(*listed(p["order"]))
    return i["df"].withColumn(_out(p, "lookahead_return"), F.try_divide(F.lead(p["price"]).over(w), F.col(p["price"])) - 1)

