"""Windows over the whole table without moving it to one task.

A window without ``PARTITION BY`` sorts all rows in a single task.  Here rows are cut into
ranges of the leading order column at approximate quantiles (text: at prefixes of values drawn
by chance); each range is its own window partition, and what the ranges before contribute (a sum, a count, a last value) is computed
over one row a range.  Ranges never split equal keys, so ranks and ties stay exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least and largest number of ranges; between them there are as many as shuffle partitions.  The small tables have
#: one row a range and one for NULL, so their size is bounded.
RANGES, MOST_RANGES = 64, 4096
_PART = "__range"


#: Characters of a text cut, and rows drawn for each cut; their product bounds what the driver gets.
CUT_CHARS, DRAWN = 64, 40


def place(key: Column, cuts: list, first: int = 1) -> Column:
    """The range of a key among sorted cuts (those up to it, and ``first``): a tree of comparisons, which generated code walks in log steps."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(key < F.lit(cuts[mid]), place(key, cuts[:mid], first)).otherwise(place(key, cuts[mid + 1 :], first + mid + 1))


def _text_cuts(df: DataFrame, key: str, ranges: int) -> list[str]:
    """Sorted prefixes of values of rows drawn by chance, at even distances.

    A prefix is a cut like any other, so long texts stay where they are.  A common value may take
    several cuts: they fall together, and the value's rows stay in one range, as ties must.
    """
    kept = df.filter(F.col(key).isNotNull()).select(F.substring(F.col(key).cast("string"), 1, CUT_CHARS).alias("k"))
    drawn = sorted((r.k for r in kept.orderBy(F.rand(7)).limit(ranges * DRAWN).collect()), key=lambda t: t.encode())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)} if drawn else set(), key=lambda t: t.encode())


def ranged(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Add the range number of ``key`` (NULL first, as range 0).  Text is in the order of its code points."""
    ranges = ranges or max(RANGES, min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kind = df.schema[key].dataType.typeName()
    if kind == "binary":
        raise TypeError(f"the leading order column {key!r} must be a number, a time, a boolean or text")
    if kind.startswith(("string", "varchar", "char")):
        return df.withColumn(_PART, F.when(F.col(key).isNull(), 0).otherwise(place(F.col(key), _text_cuts(df, key, ranges) if ranges > 1 else [])))
    number = F.col(key).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(key).cast("double")
    cuts = df.select(number.alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.3 / ranges) if ranges > 1 else []
    return df.withColumn(_PART, F.when(number.isNull(), 0).otherwise(place(number, sorted(set(cuts)))))


def _before(parts: DataFrame, value: Column, descending: bool) -> DataFrame:
    """Sum of ``value`` over the ranges that come earlier; at most ``RANGES + 1`` rows."""
    order = F.col(_PART).desc() if descending else F.col(_PART).asc()
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(_PART, F.coalesce(F.sum(value).over(w), F.lit(0)).alias("__before"))


def _finish(rows: DataFrame, before: DataFrame, out: str, make: Callable[[Column], Column]) -> DataFrame:
    # At most RANGES + 1 rows, so the broadcast has a fixed bound.
    return rows.join(F.broadcast(before), _PART, "left").withColumn(out, make(F.col("__before"))).drop(_PART, "__before", "__own")


def running_sum(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """Running total in order; a missing value has a missing total and adds nothing."""
    rows = ranged(df, order[0])
    w = Window.partitionBy(_PART).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    before = _before(rows.groupBy(_PART).agg(F.sum(value).alias("s")), F.col("s"), False)
    return _finish(rows.withColumn("__own", F.sum(value).over(w)), before, out, lambda b: F.when(F.col(value).isNotNull(), F.col("__own") + b))


def dense_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Dense rank, the highest value first; missing values have none."""
    rows = ranged(df, value)
    w = Window.partitionBy(_PART).orderBy(F.col(value).desc())
    before = _before(rows.groupBy(_PART).agg(F.count_distinct(value).alias("n")), F.col("n"), True)
    return _finish(rows.withColumn("__own", F.dense_rank().over(w)), before, out, lambda b: F.when(F.col(value).isNotNull(), F.col("__own") + b))


def rank_pct(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ascending average-method rank over the number of values; missing values have none."""
    rows = ranged(df, value)
    w, ties = Window.partitionBy(_PART).orderBy(F.col(value).asc()), Window.partitionBy(_PART, value)
    counts = rows.groupBy(_PART).agg(F.count(value).alias("n"))
    before = _before(counts, F.col("n"), False)
    total = counts.agg(F.sum("n")).scalar()
    own = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return _finish(rows.withColumn("__own", own), before, out, lambda b: F.when(F.col(value).isNotNull(), (F.col("__own") + b) / total))


def lagged(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """The value of the row before in order."""
    rows = ranged(df, order[0])
    keys = [F.col(c).asc_nulls_first() for c in order]
    last = rows.groupBy(_PART).agg(F.max(F.struct(*[F.col(c) for c in order], F.col(value).alias("__v")))["__v"].alias("v"))
    before = last.select(_PART, F.lag("v").over(Window.orderBy(_PART)).alias("__before"))
    w = Window.partitionBy(_PART).orderBy(*keys)
    first = F.row_number().over(w) == 1
    return _finish(rows.withColumn("__own", F.lag(value).over(w)).withColumn("__first", first), before, out, lambda b: F.when(F.col("__first"), b).otherwise(F.col("__own"))).drop("__first")


def numbered(df: DataFrame, order: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """The number of each row in order, from 1; ``ranges`` suits tables known to be small."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows = ranged(df, order[0], ranges)
    before = _before(rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")), F.col("n"), False)
    w = Window.partitionBy(_PART).orderBy(*keys)
    return _finish(rows.withColumn("__own", F.row_number().over(w)), before, out, lambda b: F.col("__own") + b)


def top_with_ties(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows whose descending rank is at most n: those from the n-th largest value on."""
    cutoff = df.select(value).filter(F.col(value).isNotNull()).orderBy(F.col(value).desc()).limit(n).agg(F.min(value)).scalar()
    return df.filter(F.col(value) >= cutoff)
