"""Tasks generated from tables: operator, roles, and proof that the contract tells right from slip.

``generate`` takes one table and runs operators and contracts.  ``generate_many`` takes any number of
tables as long cells and makes and proves all their tasks in one plan: what the contracts of the seven
operators compare are sums of groups, so right, slip and verdict are aggregates by table, columns and group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.contracts.engine import verdict
from sparkloom.functions.expressions import close, number
from sparkloom.functions.quantiles import exact_quantiles
from sparkloom.operators.slips import SLIPS
from sparkloom.operators.transforms import OPERATORS
from sparkloom.params import Params
from sparkloom.session import safe_unions
from sparkloom.sources.profile import task_columns

CAP = 15


@dataclass(frozen=True)
class Task:
    operator: str
    params: Params


def candidates(df: DataFrame) -> Iterator[Task]:
    """Seven operators over the fit columns of a table."""
    use = {r.column: r.use for r in task_columns(df).collect()}
    categories = [c for c in df.columns if use.get(c) == "category"]
    numbers = [c for c in df.columns if use.get(c) == "number"]
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*categories, *numbers]]).first() if use else {}
    for a, b in zip(numbers, numbers[1:], strict=False):
        yield Task("weighted_mean", {"value": a, "weight": b})
        yield from (Task("pooled_rate", {"group": g, "num": a, "den": b}) for g in categories)
    for g in categories:
        for v in numbers:
            yield Task("within_group_share", {"group": g, "value": v})
            yield Task("median_not_mean", {"group": g, "value": v})
            yield Task("zscore_within_group", {"group": g, "value": v})
            if gaps[v]:
                yield Task("nan_as_zero_sum", {"group": g, "value": v})
            if gaps[g]:
                yield Task("groupby_dropna_key", {"group": g, "value": v})


def generate(df: DataFrame, cap: int = CAP) -> list[Task]:
    """The first ``cap`` candidates whose contract is silent on the right result and fires on the slip."""
    made = list(candidates(df))
    if not made:
        return []
    inputs, kept = {"df": df}, []
    for t in made:
        right, slip = (f[t.operator](inputs, t.params) for f in (OPERATORS, SLIPS))
        seen = {r.form: bool(r.fired) for r in _pair(t, inputs, right, slip).collect()}
        if not seen["right"] and seen["slip"]:
            kept.append(t)
        if len(kept) == cap:
            break
    return kept


def _pair(t: Task, inputs: dict[str, DataFrame], right: DataFrame, slip: DataFrame) -> DataFrame:
    rows = [verdict(t.operator, inputs, t.params, r).withColumn("form", F.lit(form)) for form, r in (("right", right), ("slip", slip))]
    return rows[0].unionByName(rows[1])


def as_cells(df: DataFrame, table: str, row: str) -> DataFrame:
    """A table as ``table, row, column, pos, value`` (text), ``row`` being a column that numbers the rows."""
    names = [c for c in df.columns if c != row]
    made = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)]
    return df.select(F.lit(table).alias("table"), F.col(row).cast("long").alias("row"), F.inline(F.array(*made)))


def column_uses(cells: DataFrame) -> DataFrame:
    """``table, column, pos, use, gaps, place``: the rules of ``task_columns`` on text, where a column is numeric if all that is there is a number."""
    v = number(F.col("value"))
    c = cells.groupBy("table", "column").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.count("value").alias("there"), F.count(v).alias("numbers"), F.count_distinct("value").alias("distinct")
    )
    text = F.col("numbers") < F.col("there")
    use = F.when(text & (F.col("distinct") >= 2) & (F.col("distinct") <= F.greatest(F.lit(3), F.col("n") / 3)), "category").when(~text & (F.col("there") >= 8), "number")
    used = c.withColumn("use", use).filter("use IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("table", "use").orderBy("pos"))  # the columns of a table
    return used.select("table", "column", "pos", "use", (F.col("there") < F.col("n")).alias("gaps"), place.alias("place"))


def generate_many(cells: DataFrame, cap: int = CAP) -> DataFrame:
    """The first ``cap`` proved tasks of each table: ``table, operator, params, place``, in the order of ``candidates``.

    ``cells``: table, row, column, pos, value; every row has a cell for every column.  A task is proved if
    the operator's contract is silent on the right result and fires on the slip.
    """
    safe_unions(cells.sparkSession)
    uses = column_uses(cells)
    of = lambda use, *names: uses.filter(F.col("use") == use).select("table", "column", *[F.col(a).alias(b) for a, b in names])
    numbers = cells.join(of("number", ("place", "v_place"), ("gaps", "v_gaps")), ["table", "column"]).select("table", "row", F.col("column").alias("v"), "v_place", "v_gaps", number(F.col("value")).alias("x"))
    groups = cells.join(of("category", ("place", "g_place"), ("gaps", "g_gaps")), ["table", "column"]).select("table", "row", F.col("column").alias("g"), "g_place", "g_gaps", F.col("value").alias("key"))
    second = numbers.select("table", "row", F.col("v").alias("w"), (F.col("v_place") - 1).alias("v_place"), F.col("x").alias("y"))
    both = numbers.drop("v_gaps").join(second, ["table", "row", "v_place"])
    differs = lambda got, want: ~close(got, want)  # a missing side differs
    keyed = F.col("key").isNotNull()
    proved = lambda right, slip: ~F.coalesce(right, F.lit(False)) & F.coalesce(slip, F.lit(False))
    params = lambda **roles: F.create_map(*[x for k, c in roles.items() for x in (F.lit(k), F.col(c))])
    made = []

    # Two numbers: a mean weighted by the next number, and pooled rates of groups.
    x, y = F.col("x"), F.col("y")
    want = F.try_divide(F.sum(x * y), F.sum(y))
    # The operator leaves out the weights of missing values, the contract does not.
    right = F.try_divide(F.sum(x * y), F.sum(F.when(x.isNotNull(), y)))
    means = both.groupBy("table", "v", "w", "v_place").agg(want.alias("e"), right.alias("r"), F.avg(x).alias("s"))
    made.append(means.filter(proved(differs(F.col("r"), F.col("e")), differs(F.col("s"), F.col("e")))).select("table", F.lit("weighted_mean").alias("operator"), params(value="v", weight="w").alias("params"), F.array(F.lit(0), F.col("v_place"), F.lit(0), F.lit(0)).alias("at")))
    rates = both.join(groups, ["table", "row"]).groupBy("table", "v", "w", "v_place", "g", "g_place", "key").agg(F.try_divide(F.sum(x), F.sum(y)).alias("e"), F.avg(F.try_divide(x, y)).alias("s"))
    rates = rates.filter(keyed).groupBy("table", "v", "w", "v_place", "g", "g_place").agg(F.bool_or(F.col("e").isNull()).alias("right"), F.bool_or(differs(F.col("s"), F.col("e"))).alias("slip"))
    made.append(rates.filter(proved(F.col("right"), F.col("slip"))).select("table", F.lit("pooled_rate"), params(group="g", num="v", den="w"), F.array(F.lit(0), F.col("v_place"), F.col("g_place"), F.lit(0))))

    # A group and a number: one row a group has all that five contracts compare.
    pairs = groups.join(numbers, ["table", "row"])
    ids = ["table", "g", "g_place", "g_gaps", "v", "v_place", "v_gaps"]
    by_key = pairs.groupBy(*ids, "key").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("there"), F.sum("x").alias("sum"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
    # The middle of each group, of any size.
    middle = exact_quantiles(pairs, ["table", "g", "v", "key"], "x", {"middle": 0.5}).select(*[F.col(c).alias(f"m_{c}") for c in ("table", "g", "v", "key")], "middle")
    by_key = by_key.join(middle, (F.col("table") == F.col("m_table")) & (F.col("g") == F.col("m_g")) & (F.col("v") == F.col("m_v")) & F.col("key").eqNullSafe(F.col("m_key")))
    whole = pairs.groupBy(*ids).agg(F.sum("x").alias("all_sum"), F.avg("x").alias("all_mean"), F.stddev_pop("x").alias("all_spread"))
    rows = by_key.join(whole, ids)
    off = lambda share: ~F.coalesce(F.abs(share - 1) <= 1e-4, F.lit(False))
    far = lambda z: F.coalesce(F.abs(z) > 1e-3, F.lit(True))
    total = F.col("sum")
    verdicts = rows.groupBy(*ids).agg(
        F.bool_or(total.isNull() | (total == 0)).alias("share_right"), F.bool_or(off(F.try_divide(total, F.col("all_sum")))).alias("share_slip"),
        F.bool_or(keyed & F.col("middle").isNull()).alias("median_right"), F.bool_or(keyed & differs(F.col("mean"), F.col("middle"))).alias("median_slip"),
        F.bool_or(F.col("spread").isNull() | (F.col("spread") == 0)).alias("z_right"), F.bool_or(far(F.try_divide(F.col("mean") - F.col("all_mean"), F.col("all_spread")))).alias("z_slip"),
        F.bool_or(keyed & (F.col("there") < F.col("n"))).alias("zero_slip"),
        F.sum(total).alias("all"), F.sum(F.when(keyed, total)).alias("kept"),
    )
    no, zero = F.lit(False), F.lit(0.0)
    lost = F.col("g_gaps") & differs(F.coalesce("kept", zero), F.coalesce("all", zero))
    kinds = [
        ("within_group_share", proved(F.col("share_right"), F.col("share_slip"))), ("median_not_mean", proved(F.col("median_right"), F.col("median_slip"))), ("zscore_within_group", proved(F.col("z_right"), F.col("z_slip"))),
        ("nan_as_zero_sum", F.col("v_gaps") & proved(no, F.col("zero_slip"))), ("groupby_dropna_key", proved(no, lost)),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(op).alias("operator"), F.lit(i).alias("i"), ok.alias("ok")) for i, (op, ok) in enumerate(kinds)]), lambda k: k["ok"])
    pairs_made = verdicts.select("table", params(group="g", value="v").alias("params"), "g_place", "v_place", F.inline(found))
    made.append(pairs_made.select("table", "operator", "params", F.array(F.lit(1), F.col("g_place"), F.col("v_place"), F.col("i"))))
    tasks = made[0].union(made[1]).union(made[2])
    place = F.row_number().over(Window.partitionBy("table").orderBy("at"))
    return tasks.withColumn("place", place).filter(F.col("place") <= cap).select("table", "operator", "params", "place")
