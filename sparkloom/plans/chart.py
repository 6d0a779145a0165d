"""The relational part of charts: each mark's data as a long or wide table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.quantiles import exact_quantiles
from sparkloom.params import listed

# Name tokens that mark a ratio, a time, and the roles of overlays.
RATIO_NAMES = ("rate", "ratio", "share", "pct", "percent", "proportion", "prob", "%")
TIME_NAMES = ("date", "time", "month", "year", "quarter", "week", "day", "period")
MOST_SERIES = 10_000
ROLE_NAMES = {"target": ("target", "goal"), "forecast": ("forecast", "plan", "predict"), "baseline": ("baseline", "base", "prior"), "trend": ("trend", "moving", "avg")}


def bar(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x).agg(F.sum(y).alias(y))


def grouped_bar(df: DataFrame, x: str, series: str, y: str, names: list | None = None) -> DataFrame:
    """x by series, sums, missing cells 0.  Naming the series saves a pass."""
    return df.groupBy(x).pivot(series, names).agg(F.sum(y)).na.fill(0)


def heatmap(df: DataFrame, x: str, series: str, y: str, names: list | None = None) -> DataFrame:
    return df.groupBy(x).pivot(series, names).agg(F.avg(y)).na.fill(0)


def line(df: DataFrame, x: str, y: str, series: str | None = None) -> DataFrame:
    return df.select(*listed(series), x, y).orderBy(*listed(series), x)


def histogram(df: DataFrame, value: str, bins: int = 20, empty: bool = True) -> DataFrame:
    """Equal bins from the least to the largest value, the last closed; ``bin`` from 0."""
    v = F.col(value).cast("double")
    edges = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    place = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((v - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int"))
    counts = df.filter(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if not empty:
        return counts
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def box(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (the last values within ``reach`` times the quartile range) and outliers."""
    q = exact_quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    rows = df.select(group, value).join(q, group)
    inside = F.col(value).between(F.col("q1") - reach * iqr, F.col("q3") + reach * iqr)
    return rows.groupBy(group, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"))


def pie(df: DataFrame, label: str, value: str) -> DataFrame:
    """Positive totals and their shares; the grand total is one scalar, not a one-task window."""
    sums = df.groupBy(label).agg(F.sum(value).alias(value)).filter(F.col(value) > 0)
    return sums.withColumn("share", F.col(value) / sums.agg(F.sum(value)).scalar())


def scatter(df: DataFrame, x: str, y: str, series: str | None = None) -> DataFrame:
    return df.select(x, y, *listed(series))


def bins_2d(df: DataFrame, x: str, y: str, grid: int = 20) -> DataFrame:
    """Counts on a square grid over both ranges."""
    e = df.agg(F.min(x).alias("ax"), F.max(x).alias("bx"), F.min(y).alias("ay"), F.max(y).alias("by"))
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - e.select(a).scalar()) * grid / F.nullif(e.select(b).scalar() - e.select(a).scalar(), F.lit(0.0))), F.lit(grid - 1))
    return df.groupBy(F.coalesce(cell(x, "ax", "bx"), F.lit(0)).alias("bx"), F.coalesce(cell(y, "ay", "by"), F.lit(0)).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def violin(df: DataFrame, group: str, value: str, points: int = 20) -> DataFrame:
    """Evenly spaced quantiles of each group, a density without a kernel."""
    steps = {f"__s{i}": i / points for i in range(points + 1)}
    return exact_quantiles(df, [group], value, steps).select(group, F.posexplode(F.array(*steps)).alias("step", value))


def stacked(df: DataFrame, x: str, series: str, y: str, ratio: bool = False, normalise: bool = False) -> DataFrame:
    """Every (x, series) cell with its value (mean of ratios, else sum; absent 0), bottom and top of the stack."""
    cells = df.groupBy(x, series).agg((F.avg(y) if ratio else F.sum(y)).alias(y))
    # The series of a chart are few: one array beside each x, not a join of all with all.
    names = df.select(series).distinct().limit(MOST_SERIES + 1).agg(F.collect_list(F.struct(series)).alias("s"))
    if names.select(F.size("s")).first()[0] > MOST_SERIES:
        raise ValueError(f"a stack has at most {MOST_SERIES} series")
    spine = df.select(x).distinct().select(x, F.inline(names.scalar()))
    full = spine.join(cells, [x, series], "left").withColumn(y, F.coalesce(F.col(y).cast("double"), F.lit(0.0)))
    if normalise:
        total = F.sum(y).over(Window.partitionBy(x))
        full = full.withColumn(y, F.col(y) / F.when(total == 0, F.lit(1.0)).otherwise(total))
    top = F.sum(y).over(Window.partitionBy(x).orderBy(series).rowsBetween(Window.unboundedPreceding, 0))
    return full.withColumn("top", top).withColumn("bottom", F.col("top") - F.col(y))


def prepare(df: DataFrame, x: str, ys: list[str], order: list[str]) -> DataFrame:
    """Rows with all numbers present, ``__x`` as time where enough of x parses, else by first appearance."""
    t = F.try_to_timestamp(F.col(x).cast("string"))
    seen = df.agg(F.count(t).alias("t"), F.count(x).alias("n")).first()
    rows = df.withColumns({y: F.col(y).try_cast("double") if dict(df.dtypes)[y] == "string" else F.col(y).cast("double") for y in ys}).dropna(subset=ys)
    if seen.t >= max(3, 0.3 * seen.n):
        return rows.withColumn("__x", t).orderBy("__x", *order)
    first = df.groupBy(x).agg(F.min(F.struct(*order)).alias("__x"))
    return rows.join(first, x).orderBy("__x", *order)


def aggregate_repeats(df: DataFrame, x: str, y: str, series: str | None, ratio: bool) -> DataFrame:
    """One row for each (x, series): mean of ratios, sum of amounts."""
    return df.groupBy(x, *listed(series)).agg((F.avg(y) if ratio else F.sum(y)).alias(y))


def is_ratio(df: DataFrame, y: str) -> DataFrame:
    """One row: whether a column looks like a ratio, by name or by its values."""
    v = F.col(y).cast("double")
    named = any(t in y.lower() for t in RATIO_NAMES)
    stats = df.agg(F.avg(v.between(0, 1).cast("int")).alias("inside"), F.max(F.abs(v)).alias("most"), F.avg(v).alias("mean"))
    small = (F.col("inside") >= 0.6) & (F.col("most") <= 1.5)
    percent = F.lit("%" in y) & (F.col("most") <= 100) & (F.col("mean") <= 60)
    return stats.select(F.lit(y).alias("column"), F.coalesce(F.lit(named) | small | percent, F.lit(named)).alias("ratio"))


def axis_break(df: DataFrame, y: str) -> DataFrame:
    """One row: where a few large values justify a gap in the axis."""
    v = F.col(y).cast("double")
    q = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).join(F.broadcast(exact_quantiles(df, [], y, {"q90": 0.9, "q75": 0.75})), F.lit(True))  # a row each
    q = q.withColumn("q", F.when(F.col("n") >= 6, F.col("q90")).otherwise(F.col("q75")))
    gap = F.col("hi") - F.col("q") > F.greatest(F.lit(1.0), 0.25 * (F.col("q") - F.col("lo")))
    return q.select("n", F.coalesce(gap, F.lit(False)).alias("gap"), F.when(gap, F.col("q")).alias("gap_start"), F.when(gap, F.col("hi") - 0.35 * (F.col("hi") - F.col("q"))).alias("gap_end"))


def axis_range(df: DataFrame, y: str, ratio: bool) -> DataFrame:
    v = F.col(y).cast("double")
    lo, hi = F.min(v), F.max(v)
    if ratio:
        return df.agg(F.greatest(F.lit(0.0), lo - 0.05).alias("lo"), F.least(F.lit(1.2), hi + 0.05).alias("hi"))
    return df.agg(F.least(F.lit(0.0), lo).alias("lo"), hi.alias("hi"))


def encode_sample(df: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(n)


def thin_categories(df: DataFrame, x: str, most: int = 50) -> DataFrame:
    """Of more than ``most`` categories every step-th, in order; categories are few, rows are not."""
    names = df.select(x).distinct()
    step = F.greatest(F.lit(1), F.ceil(names.agg(F.count(F.lit(1))).scalar() / most).cast("int"))
    numbered = names.withColumn("__i", F.row_number().over(Window.orderBy(x)) - 1)
    return numbered.filter(F.pmod("__i", step) == 0).select(x)


def choose_columns(profile: list[dict]) -> dict[str, str | None]:
    """x: time-like, else categorical, else first; y: ratio or number with most distinct values; group: few values."""
    named = lambda c, tokens: any(t in c["name"].lower() for t in tokens)
    numbers = [c for c in profile if c["semantic"] == "quantitative"]
    texts = [c for c in profile if c["semantic"] == "categorical"]
    x = next((c for c in profile if c["semantic"] == "temporal" or named(c, TIME_NAMES)), None) or next(iter(texts), None) or (profile[0] if profile else None)
    ys = [c for c in numbers if c is not x]
    y = next((c for c in ys if named(c, RATIO_NAMES)), None) or max(ys, key=lambda c: c["distinct"], default=None)
    group = next((c for c in texts if c is not x and c["distinct"] <= 12), None)
    return {k: v["name"] if v else None for k, v in (("x", x), ("y", y), ("group", group))}


def overlay_role(name: str) -> str:
    words = re.split(r"[^a-z]+", name.lower())
    return next((role for role, tokens in ROLE_NAMES.items() if any(w.startswith(t) for w in words for t in tokens)), "main")
