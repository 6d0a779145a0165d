"""Comparing results: normalised equality, subset equality, scalars, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import safe_unions

NUMERIC = ("double", "float", "decimal", "long", "bigint", "integer", "int", "short", "byte")


def _is_numeric(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in NUMERIC


def normalised(df: DataFrame, digits: int = 6) -> DataFrame:
    """Columns by name, numbers as rounded doubles (NaN missing, no negative zero)."""
    safe_unions(df.sparkSession)  # normalised frames are compared by exceptAll
    out: list[Column] = []
    for c in sorted(df.columns):
        v = F.col(f"`{c}`")
        if _is_numeric(df, c):
            v = F.nullif(F.round(v.cast("double"), digits), F.lit(float("nan"))) + F.lit(0.0)
        out.append(v.alias(c))
    return df.select(*out)


def equal(a: DataFrame, b: DataFrame, digits: int = 6) -> bool:
    """Same columns and, in any order, the same rows."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    a, b = normalised(a, digits), normalised(b, digits)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def subset_equal(result: DataFrame, gold: DataFrame, digits: int = 6) -> bool:
    """The result has all gold columns and, on them, the same rows; more columns are forgiven."""
    if not set(gold.columns) <= set(result.columns):
        return False
    return equal(result.select(*gold.columns), gold, digits)


def scalar_cell(df: DataFrame, preferred: str | None = None) -> str | None:
    """The column that holds a one-row result's number."""
    if preferred in df.columns:
        return preferred
    numeric = [c for c in df.columns if _is_numeric(df, c)]
    return numeric[0] if len(numeric) == 1 else None


def scalar_equal(result: DataFrame, gold: float) -> bool:
    """The first column with exactly one number holds it, within max(1e-4 |gold|, 1e-6)."""
    for c in result.columns:
        values = result.select(F.col(f"`{c}`").try_cast("double").alias("v")).filter("v is not null").limit(2).collect()
        if len(values) == 1:
            return abs(values[0].v - gold) <= max(1e-4 * abs(gold), 1e-6)
    return False


def column_status(result: DataFrame, gold: DataFrame, digits: int = 4) -> dict[str, bool]:
    """For each gold column, whether the result has the same multiset of values."""
    out = {}
    for c in gold.columns:
        out[c] = c in result.columns and equal(result.select(c), gold.select(c), digits)
    return out


def signature(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row that does not depend on the order of rows: names, count, sum of row hashes."""
    n = normalised(df, digits)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in n.columns]).cast("decimal(20,0)")
    return n.agg(F.lit(",".join(n.columns)).alias("columns"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("h"))


def modal_result(results: list[DataFrame]) -> tuple[int | None, int]:
    """Index of a result in the largest agreeing group and its size; no index without a strict majority."""
    seen = [tuple(signature(r).first()) for r in results]
    best = max(seen, key=seen.count)
    n = seen.count(best)
    return (seen.index(best) if 2 * n > len(seen) else None), n


def cells(df: DataFrame, candidate: Column, row: Column, digits: int = 6) -> DataFrame:
    """A frame as long cells ``candidate, row, column, value``, values normalised as text (missing stays missing)."""
    n = normalised(df.withColumns({"__candidate": candidate.cast("string"), "__row": row.cast("string")}), digits)
    made = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in n.columns if c not in ("__candidate", "__row")]
    return n.select(F.col("__candidate").alias("candidate"), F.col("__row").alias("row"), F.inline(F.array(*made)))


def signatures(long: DataFrame) -> DataFrame:
    """``candidate, n, h``: the rows and an order-free fingerprint of each candidate's result, whatever its columns.

    A row is the sum of its cells' hashes, a result the sum of its rows' hashes (each hashed again), so
    both aggregate before the shuffle.  Results with other columns have other fingerprints.
    """
    cell = F.xxhash64("column", F.coalesce("value", F.lit("\0missing"))).cast("decimal(38,0)")
    rows = long.groupBy("candidate", "row").agg(F.sum(cell).alias("h"))
    return rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("h"))


def consensus(long: DataFrame) -> DataFrame:
    """Every candidate with the size of its agreeing group, whether that is the modal one, and whether it is a strict majority.

    All candidates in one plan: a grouping by candidate and one by signature.  Of equally large groups
    the one with the smallest candidate is the modal one.
    """
    s = signatures(long)
    groups = s.groupBy("n", "h").agg(F.count(F.lit(1)).alias("agree"), F.min("candidate").alias("first"))
    best = groups.agg(F.max(F.struct("agree")).alias("most"), F.sum("agree").alias("all")).select("most.agree", "all")
    top = groups.join(F.broadcast(best.withColumnRenamed("agree", "most")), F.col("agree") == F.col("most")).agg(F.min("first").alias("modal_first"), F.first("most").alias("most"), F.first("all").alias("all"))
    out = s.join(groups, ["n", "h"]).join(F.broadcast(top), F.lit(True))  # the top is one row
    modal = F.col("first") == F.col("modal_first")
    return out.select("candidate", "agree", modal.alias("modal"), (modal & (2 * F.col("most") > F.col("all"))).alias("majority"))


def new_error_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The different keys that are in ``after`` and were not in ``before``, as rows; missing parts of a key are equal."""
    safe_unions(before.sparkSession)
    return after.select(*key).distinct().exceptAll(before.select(*key).distinct())


def new_errors(before: set[str], after: set[str]) -> set[str]:
    return after - before


def multiset_differs(a: DataFrame, b: DataFrame, column_a: str, column_b: str, digits: int = 4) -> Column:
    """As a column: whether two columns hold different multisets of values, by counts of rounded values."""
    safe_unions(a.sparkSession)
    one = lambda d, c, s: d.select(F.round(F.col(c).cast("double"), digits).alias("v"), F.lit(s).alias("s"))
    counts = one(a, column_a, 1).unionByName(one(b, column_b, -1)).groupBy("v").agg(F.sum("s").alias("d")).filter("d <> 0")
    return counts.agg(F.count(F.lit(1))).scalar() > 0
