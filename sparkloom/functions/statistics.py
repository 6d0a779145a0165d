"""Tallies, splits and tags for evaluating detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import wilson
from sparkloom.operators import ordered

# Patterns that tag code with a family of operators, in order.
FAMILIES = {
    "groupby": r"\.groupby\(", "join": r"\.(merge|join)\(", "pivot": r"\.(pivot|pivot_table|unstack)\(", "rank": r"\.rank\(", "cumulative": r"\.(cumsum|cumcount|cumprod)\(",
    "window": r"\.(rolling|shift|diff|pct_change)\(", "resample": r"\.resample\(", "dedup": r"\.drop_duplicates\(", "fill": r"\.(fillna|dropna)\(", "sort": r"\.(sort_values|nlargest|nsmallest)\(",
    "clip": r"\.clip\(", "apply": r"\.(apply|map)\(",
}


def with_wilson(df: DataFrame, k: str, n: str, z: float = 1.96) -> DataFrame:
    lo, hi = wilson(F.col(k).cast("double"), F.col(n), z)
    return df.withColumns({"rate": F.try_divide(F.col(k).cast("double"), F.col(n)), "lo": lo, "hi": hi})


def confusion(df: DataFrame, by: list[str], wrong: str, fired: str, crashed: str) -> DataFrame:
    """Recall, false positives, silent errors and crashes for each group."""
    ok = ~F.col(crashed)
    return df.groupBy(*by).agg(
        F.count_if(ok & F.col(wrong) & F.col(fired)).alias("tp"),
        F.count_if(ok & F.col(wrong) & ~F.col(fired)).alias("fn"),
        F.count_if(ok & ~F.col(wrong) & F.col(fired)).alias("fp"),
        F.count_if(ok & ~F.col(wrong) & ~F.col(fired)).alias("tn"),
        F.count_if(crashed).alias("crashes"),
        F.try_divide(F.count_if(ok & F.col(wrong)), F.count_if(ok)).alias("silent_rate"),
    )


def attribution(df: DataFrame) -> DataFrame:
    """Rows (case, truth, contract, fired, wrong): own contract fires on wrong cases, others on right ones."""
    own = F.col("contract") == F.col("truth")
    return df.agg(
        F.count_if(own & F.col("wrong")).alias("n_own"), F.count_if(own & F.col("wrong") & F.col("fired")).alias("hit"),
        F.count_if(~own & ~F.col("wrong")).alias("n_other"), F.count_if(~own & ~F.col("wrong") & F.col("fired")).alias("cross"),
    )


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.stddev_pop(value).alias("std"))


def stratified_split(df: DataFrame, stratum: str, order: list[str], share: float = 0.3) -> DataFrame:
    """The last max(1, round(share n)) rows of each stratum are held out; none of a single row."""
    w = Window.partitionBy(stratum)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    held = F.when(n == 1, 0).otherwise(F.greatest(F.lit(1), F.bround(n * share, 0).cast("int")))
    return df.withColumn("held_out", i > n - held)


def code_families(code: Column) -> Column:
    tags = F.array(*[F.when(code.rlike(p), F.lit(name)) for name, p in FAMILIES.items()])
    return F.array_compact(tags)


def prevalence(df: DataFrame, code: str) -> DataFrame:
    tagged = df.select(F.explode(code_families(F.col(code))).alias("family"))
    return tagged.groupBy("family").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "family")


def even_stride(df: DataFrame, order: list[str], keep: int) -> DataFrame:
    """Rows at the places int(j N / keep) of N, in order; all rows if there are no more."""
    n = df.agg(F.count(F.lit(1)).cast("long")).scalar()
    numbered = ordered.numbered(df, order, "__p").withColumn("__p", F.col("__p") - 1)
    at = F.ceil(F.col("__p") * keep / n).cast("long")
    return numbered.filter((n <= keep) | ((at < keep) & (F.floor(at * n / keep) == F.col("__p")))).drop("__p")


def rule_precision(df: DataFrame, prompt: str, code: str, rule: str, confirm: str) -> DataFrame:
    hit, ok = F.col(prompt).rlike(rule), F.col(code).rlike(confirm)
    return df.agg(F.count_if(hit).alias("hits"), F.count_if(hit & ok).alias("confirmed"), F.count(F.lit(1)).alias("n"))
