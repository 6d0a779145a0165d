"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind at the ends; ``trim`` strips blanks only.
EDGE_SPACE = r"^\s+|\s+$"


def close(a: Column, b: Column, relative: float = 1e-6, least: float = 1e-6) -> Column:
    """Equal within a relative and an absolute bound; never for a missing side."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.abs(b) * relative, F.lit(least)), F.lit(False))


def clip(v: Column, lo: float, hi: float) -> Column:
    """Capped to [lo, hi]; missing stays missing (``least`` and ``greatest`` skip NULL)."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def ieee_divide(a: Column, b: Column) -> Column:
    """Division as doubles do it: by zero it is infinite (0/0: NaN); missing only for a missing side."""
    return F.when(b == 0, a.cast("double") * F.pow(b.cast("double"), F.lit(-1.0))).otherwise(F.try_divide(a, b))


def rounded(v: Column, digits: int) -> Column:
    """The scaled double rounded, halves away from zero, and scaled back, as DuckDB does; ``round`` takes the decimal text."""
    scale = 10.0**digits
    near = F.round(v * scale, 0) / scale
    return F.when(F.isnan(near) | (F.abs(near) == float("inf")), v).otherwise(near)


def normal_key(k: Column) -> Column:
    """Text key without edge white space, in lower case."""
    return F.lower(F.regexp_replace(k.cast("string"), EDGE_SPACE, ""))


def number(text: Column, strip: str = "") -> Column:
    """A number from text, NULL where it is none; the characters in ``strip`` go first."""
    t = F.regexp_replace(text.cast("string"), EDGE_SPACE, "")
    if strip:
        t = F.translate(t, strip, "")
    return F.when(~t.rlike(r"[dDfF]$"), t.try_cast("double"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k successes in n trials; NULL for no trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    base = 1 + z * z / n
    return (p + z * z / (2 * n) - spread) / base, (p + z * z / (2 * n) + spread) / base


def half_even(v: Column) -> Column:
    """Rounding of halves to even, as integer."""
    return F.bround(v, 0).cast("int")


def slug(text: Column, most: int = 180) -> Column:
    """A safe file name: other characters become one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, most)


def si_number(v: Column) -> Column:
    """Short form with K, M, B, T and one decimal."""
    a = F.abs(v)
    out = F.format_string("%.1f", v)
    for power, mark in ((3, "K"), (6, "M"), (9, "B"), (12, "T")):
        out = F.when(a >= 10.0**power, F.format_string("%.1f" + mark, v / 10.0**power)).otherwise(out)
    return F.when(v.isNotNull(), out)


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_text(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
