"""The typed operators: each takes input frames and roles and returns a lazy frame.

Missing values are NULL.  Operators that depend on the order of rows take the role ``order``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import clip, ieee_divide, normal_key
from sparkloom.functions.quantiles import exact_quantiles
from sparkloom.operators import ordered
from sparkloom.params import Inputs, MissingRole, Params, listed, ordering, require


@dataclass(frozen=True)
class Operator:
    name: str
    transform: Callable[[Inputs, Params], DataFrame]
    columns: tuple[str, ...]  # roles that name columns of ``df``
    constants: tuple[str, ...] = ()
    out: str | None = None  # default name of the output column
    ordered: bool = False
    family: str = "row"  # keeps rows, or "group"
    frames: tuple[str, ...] = field(default=("df",))

    def __call__(self, inputs: Inputs, params: Params) -> DataFrame:
        missing = [f for f in self.frames if f not in inputs]
        if missing:
            raise MissingRole(f"{self.name} needs the frame {missing[0]!r}")
        require(inputs["df"], params, *self.columns)
        for role in self.constants:
            if params.get(role) is None:
                raise MissingRole(f"role {role!r} is required")
        return self.transform(inputs, {"out": self.out, **params})


OPERATORS: dict[str, Operator] = {}


def operator(*columns: str, **kinds):
    def add(f):
        OPERATORS[f.__name__] = Operator(f.__name__, f, columns, **kinds)
        return OPERATORS[f.__name__]

    return add


def _groups(p: Params) -> list[str]:
    return listed(p["group"])


def _beside(df: DataFrame, groups: list[str], *aggregates: Column) -> DataFrame:
    """Rows with the aggregates of their group; a missing key is a group.

    An aggregate and a join: sums meet before the shuffle and rows stay where they are if the groups
    are few, while a window would send all rows of a group to one task.
    """
    keys = [f"__group{i}" for i in range(len(groups))]
    side = df.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)]).agg(*aggregates)
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys, strict=True)])
    return df.join(side, same, "left").drop(*keys)


# ---------------------------------------------------------------- aggregates


@operator("value", "weight", out="wavg", family="group")
def weighted_mean(inputs, p):
    v, w = F.col(p["value"]), F.col(p["weight"])
    return inputs["df"].agg(F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias(p["out"]))


@operator("group", "value", "key", family="group")
def dedup_then_agg(inputs, p):
    """One row for each key (the first in ``order``, else the least row), then sums by group."""
    df, keys = inputs["df"], listed(p["key"])
    tie = listed(p.get("order")) or [c for c in df.columns if c not in keys]
    # min_by over a struct pre-aggregates before the shuffle; a row number would not.
    rest = [c for c in dict.fromkeys([*_groups(p), p["value"]]) if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*tie)).alias("__row")).select(*keys, "__row.*")
    return one.groupBy(*_groups(p)).agg(F.sum(p["value"]).alias(p["value"]))


@operator("group", "num", "den", out="ctr", family="group")
def pooled_rate(inputs, p):
    return inputs["df"].groupBy(*_groups(p)).agg(F.try_divide(F.sum(p["num"]), F.sum(p["den"])).alias(p["out"]))


@operator("group", "value", family="group")
def median_not_mean(inputs, p):
    return exact_quantiles(inputs["df"], _groups(p), p["value"], {p["value"]: 0.5})


@operator("group", "value", family="group")
def nan_as_zero_sum(inputs, p):
    v = F.col(p["value"])
    return inputs["df"].groupBy(*_groups(p)).agg(F.sum(F.coalesce(v, F.lit(0))).alias(p["value"]))


@operator("category", out="n", family="group")
def count_includes_empty(inputs, p):
    """Counts for every member of the domain frame (``domain``), or of the observed ones."""
    c = p["category"]
    counts = inputs["df"].groupBy(c).agg(F.count(F.lit(1)).alias(p["out"]))
    if "domain" not in inputs:
        return counts
    own = inputs["domain"].select(F.col(c)).distinct()
    return own.join(counts, own[c].eqNullSafe(counts[c]), "left").select(own[c], F.coalesce(p["out"], F.lit(0)).alias(p["out"]))


@operator("group", "flag", out="pass_rate", family="group")
def proportion_true(inputs, p):
    return inputs["df"].groupBy(*_groups(p)).agg(F.avg(F.col(p["flag"]).cast("int")).alias(p["out"]))


@operator("group", "value", family="group")
def groupby_dropna_key(inputs, p):
    """A NULL key is a group of its own."""
    return inputs["df"].groupBy(*_groups(p)).agg(F.sum(p["value"]).alias(p["value"]))


@operator("group", "measure", family="group")
def join_fanout(inputs, p):
    """Sums over the left side, each row once however many matches it has on the right."""
    df = inputs["df"]
    if p.get("matched_on") and "df2" in inputs:
        df = df.join(inputs["df2"], listed(p["matched_on"]), "left_semi")
    return df.groupBy(*_groups(p)).agg(F.sum(p["measure"]).alias(p["measure"]))


@operator("group", out="n", family="group")
def null_in_agg_count(inputs, p):
    """The size of each group, whatever is missing in it."""
    return inputs["df"].groupBy(*_groups(p)).agg(F.count(F.lit(1)).alias(p["out"]))


@operator("group", "value", out="mean", family="group")
def mean_and_count(inputs, p):
    v = p["value"]
    return inputs["df"].groupBy(*_groups(p)).agg(F.avg(v).alias(p["out"]), F.count(v).alias("n"))


# ---------------------------------------------------------------- rows


@operator("group", "value", out="share")
def within_group_share(inputs, p):
    out = p.get("share_col") or p["out"]
    rows = _beside(inputs["df"], _groups(p), F.sum(p["value"]).alias("__total"))
    return rows.withColumn(out, F.try_divide(F.col(p["value"]), F.col("__total"))).drop("__total")


@operator("new", "old", out="pp")
def pct_point(inputs, p):
    return inputs["df"].withColumn(p["out"], (F.col(p["new"]) - F.col(p["old"])) * 100)


@operator("group", "value", out="z")
def zscore_within_group(inputs, p):
    v = F.col(p["value"])
    rows = _beside(inputs["df"], _groups(p), F.avg(v).alias("__mean"), F.stddev_pop(v).alias("__spread"))
    return rows.withColumn(p["out"], F.try_divide(v - F.col("__mean"), F.col("__spread"))).drop("__mean", "__spread")


@operator("value", constants=("lo", "hi"))
def clip_outlier(inputs, p):
    return inputs["df"].withColumn(p["value"], clip(F.col(p["value"]), p["lo"], p["hi"]))


@operator("id_col", out="key")
def dtype_coerce(inputs, p):
    """The id stays text, with its leading zeros."""
    return inputs["df"].withColumn(p["out"], F.col(p["id_col"]).cast("string"))


@operator("feature", "split", constants=("train_label",))
def scale_before_split_leakage(inputs, p):
    """Standardised with mean and deviation (population) of the training rows only."""
    df, x = inputs["df"], F.col(p["feature"])
    train = df.filter(F.col(p["split"]) == p["train_label"]).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    return df.withColumn(p.get("scaled") or "scaled", F.try_divide(x - train.select("m").scalar(), train.select("s").scalar()))


@operator("lat")
def latlon_swap(inputs, p):
    return inputs["df"]


@operator("a", "b", out="diff")
def array_difference(inputs, p):
    """Element by element, arrays of one length; different lengths are missing."""
    a, b = F.col(p["a"]), F.col(p["b"])
    return inputs["df"].withColumn(p["out"], F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))))


# ---------------------------------------------------------------- order and ranks


@operator("value", out="balance", ordered=True)
def cumulative_running(inputs, p):
    if not p.get("group"):
        return ordered.running_sum(inputs["df"], p["value"], listed(p["order"]), p["out"])
    w = Window.partitionBy(*_groups(p)).orderBy(*ordering(p)).rowsBetween(Window.unboundedPreceding, 0)
    return inputs["df"].withColumn(p["out"], F.when(F.col(p["value"]).isNotNull(), F.sum(p["value"]).over(w)))


@operator("value", constants=("n",))
def topn_with_ties(inputs, p):
    if not p.get("group"):
        return ordered.top_with_ties(inputs["df"], p["value"], p["n"])
    w = Window.partitionBy(*_groups(p)).orderBy(F.col(p["value"]).desc_nulls_last())
    return inputs["df"].withColumn("__r", F.rank().over(w)).filter(F.col("__r") <= p["n"]).drop("__r")


@operator("group", "value", constants=("n",))
def top_per_group(inputs, p):
    """The n rows with the largest values of each group, ties broken by ``order``."""
    w = Window.partitionBy(*_groups(p)).orderBy(F.col(p["value"]).desc_nulls_last(), *(ordering(p) if p.get("order") else []))
    return inputs["df"].withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= p["n"]).drop("__r")


@operator("value", out="rank")
def dense_rank(inputs, p):
    return ordered.dense_rank(inputs["df"], p["value"], p["out"])


@operator("group", out="occurrence", ordered=True)
def cumcount_per_group(inputs, p):
    w = Window.partitionBy(*_groups(p)).orderBy(*ordering(p))
    return inputs["df"].withColumn(p["out"], F.row_number().over(w).cast("long"))


@operator("value", out="pct")
def rank_pct(inputs, p):
    return ordered.rank_pct(inputs["df"], p["value"], p["out"])


@operator("key", ordered=True)
def order_dependent_dedup(inputs, p):
    """The row with the largest order of each key."""
    df, keys = inputs["df"], listed(p["key"])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*listed(p["order"]))).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


@operator("price", out="ret", ordered=True)
def lookahead_return(inputs, p):
    """Relative change from the row before (from a zero infinite, or NaN if both are); nothing from later rows."""
    df, price = inputs["df"], F.col(p["price"])
    if p.get("group"):
        before = df.withColumn("__lag", F.lag(price).over(Window.partitionBy(*_groups(p)).orderBy(*ordering(p))))
    else:
        before = ordered.lagged(df, p["price"], listed(p["order"]), "__lag")
    return before.withColumn(p["out"], ieee_divide(price, F.col("__lag")) - 1).drop("__lag")


@operator("value", out="growth", ordered=True)
def growth_rate(inputs, p):
    """Change against the row before; the first row goes."""
    df = ordered.lagged(inputs["df"], p["value"], listed(p["order"]), "__lag")
    return df.filter(F.col("__lag").isNotNull()).withColumn(p["out"], F.try_divide(F.col(p["value"]), F.col("__lag")) - 1).drop("__lag")


@operator("time", "value", constants=("freq",), family="group")
def resample_boundary(inputs, p):
    """Sums in bins closed on and labelled by ``closed`` and ``label`` (right by default); empty bins between have 0."""
    freq, right = p["freq"], p.get("closed", "right") == "right"
    t = F.col(p["time"])
    w = F.window(t - F.expr("INTERVAL 1 MICROSECOND") if right else t, freq)
    edge = "end" if p.get("label", "right") == "right" else "start"
    sums = inputs["df"].filter(t.isNotNull()).groupBy(w.alias("__w")).agg(F.sum(p["value"]).alias(p["value"])).select(F.col(f"__w.{edge}").alias(p["time"]), p["value"])
    spine = sums.agg(F.min(p["time"]).alias("a"), F.max(p["time"]).alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {freq}"))).alias(p["time"]))
    return spine.join(sums, p["time"], "left").withColumn(p["value"], F.coalesce(p["value"], F.lit(0)))


# ---------------------------------------------------------------- joins


@operator(frames=("df", "df2"))
def left_join_keep_all(inputs, p):
    on = listed(p.get("key")) or [c for c in inputs["df"].columns if c in inputs["df2"].columns]
    return inputs["df"].join(inputs["df2"], on, "left")


@operator("key", "value", out="total", frames=("df", "df2"))
def index_align(inputs, p):
    """Sum by key with the second frame; no partner adds zero, of several the last in ``order`` counts."""
    keys, addend = listed(p["key"]), p["addend"]
    tie = listed(p.get("order")) or [addend]
    right = inputs["df2"].groupBy(*keys).agg(F.max_by(addend, F.struct(*tie)).alias("__addend"))
    return inputs["df"].join(right, keys, "left").withColumn(p["out"], F.col(p["value"]) + F.coalesce("__addend", F.lit(0))).drop("__addend")


@operator("key", frames=("df", "df2"))
def string_normalize_join(inputs, p):
    """Left join on keys without case and edge white space."""
    key, value = p["key"], p["lookup_value"]
    right = inputs["df2"].select(normal_key(F.col(key)).alias("__k"), F.col(value)).groupBy("__k").agg(F.min(value).alias(value))
    return inputs["df"].withColumn("__k", normal_key(F.col(key))).join(right, "__k", "left").drop("__k")
