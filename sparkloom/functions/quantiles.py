"""Exact quantiles of groups of any size, in bounded memory.

``percentile`` keeps every distinct value of a group in one buffer.  That is for groups of at most ``ACCURACY``
rows here; for larger ones a first pass makes a small sketch a group, which gives two values around each wanted rank: the sketch is right within
``1 / ACCURACY`` of the group's rows, and the two are taken ``MARGIN`` times as far away.  A second pass counts
the rows below the lower one and, by value, those between, a few ten-thousandths of the group;
among these the ranks are exact.  Both passes aggregate before the shuffle, so a group may hold all rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import safe_unions

ACCURACY, MARGIN = 10_000, 3


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """``groups`` and a column for each probability, as ``percentile`` gives it: between two values, the line between them.

    Missing values are left out; a group without values has null.  A rank outside its two values would
    be an error of the sketch, and raises one.
    """
    keys = [f"__k{i}" for i in range(len(groups))]
    safe_unions(df.sparkSession)
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).cast("double").alias("__v"))
    at, far = sorted(set(probabilities.values())), MARGIN / ACCURACY
    bounds = sorted({min(1.0, max(0.0, q + d)) for q in at for d in (-far, far)})
    sketch = rows.groupBy(*keys).agg(F.count("__v").alias("__n"), F.approx_percentile("__v", F.array(*map(F.lit, bounds)), ACCURACY).alias("__b"))
    side = lambda q, d: F.col("__b")[bounds.index(min(1.0, max(0.0, q + d)))]
    pairs = [F.struct(F.lit(i).alias("q"), side(q, -far).alias("a"), side(q, far).alias("b")) for i, q in enumerate(at)]
    sketch = sketch.select(*keys, "__n", F.array(*pairs).alias("__p"))
    s = sketch.select(*[F.col(k).alias(f"{k}s") for k in keys], "__p", (F.col("__n") > ACCURACY).alias("__large"))
    on = [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys]
    near = rows.filter("__v IS NOT NULL")
    near = near.join(s, on) if keys else near.join(F.broadcast(s), F.lit(True))  # without groups the sketch is one row
    # A row adds to the rows below all ranks from some number on (no value), and by its value to the ranks it lies between.
    small = near.filter("NOT __large").groupBy(*keys).agg(F.percentile("__v", F.array(*map(F.lit, at))).alias("__q"))
    small = small.filter("__q IS NOT NULL").select(*keys, F.posexplode("__q").alias("q", "x"))
    near = near.filter("__large")
    passed = F.size(F.filter("__p", lambda x: x["a"] <= F.col("__v")))
    inside = F.transform(F.filter("__p", lambda x: F.col("__v").between(x["a"], x["b"])), lambda x: F.struct(x["q"].alias("q"), F.col("__v").alias("v")))
    hits = near.select(*keys, F.explode(F.concat(F.array(F.struct(passed.alias("q"), F.lit(None).cast("double").alias("v"))), inside)).alias("h"))
    counts = hits.groupBy(*keys, F.col("h.q").alias("q"), F.col("h.v").alias("__v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("q", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys, "q").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    valued = F.col("__v").isNotNull()
    upto = counts.withColumn("upto", F.coalesce(F.sum(F.when(~valued, F.col("c"))).over(w), F.lit(0)) + F.sum(F.when(valued, F.col("c"))).over(own)).filter(valued)
    # The smallest value with more than r rows up to it is the one of rank r (from 0).
    sizes = sketch.select(*[F.col(k).alias(f"{k}s") for k in keys], "__n")
    upto = upto.join(sizes, on) if keys else upto.join(F.broadcast(sizes), F.lit(True))
    place = F.element_at(F.array(*map(F.lit, at)), F.col("q") + 1) * (F.col("__n") - 1)
    rank = lambda r: F.min(F.when(F.col("upto") > r, F.col("__v")))
    lowest = F.min(F.col("upto") - F.col("c"))
    ends = upto.withColumn("place", place).groupBy(*keys, "q").agg(
        F.first("place").alias("place"), lowest.alias("below"), rank(F.floor("place")).alias("a"), rank(F.ceil("place")).alias("b")
    )
    low, high = F.floor("place"), F.ceil("place")
    between = F.when(low == high, F.col("a")).otherwise((high - F.col("place")) * F.col("a") + (F.col("place") - low) * F.col("b"))
    sure = (F.col("below") <= low) & F.col("b").isNotNull()
    found = ends.select(*keys, "q", F.when(sure, between).otherwise(F.raise_error(F.lit("a quantile lies outside its sketch")).cast("double")).alias("x"))
    wide = found.unionByName(small).groupBy(*keys).agg(*[F.max(F.when(F.col("q") == i, F.col("x"))).alias(f"__q{i}") for i in range(len(at))])
    f = wide.select(*[F.col(k).alias(f"{k}f") for k in keys], *[f"__q{i}" for i in range(len(at))])
    out = sketch.join(f, [F.col(k).eqNullSafe(F.col(f"{k}f")) for k in keys], "left") if keys else sketch.join(F.broadcast(f), F.lit(True), "left")
    return out.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], *[F.col(f"__q{at.index(q)}").alias(n) for n, q in probabilities.items()])
