"""Contracts: does a result keep the invariants of its operator?  No reference answer is read.

A contract is a function of the input frames, the roles and the result.  It states what it measures
(``_one``: an aggregate of a frame; ``_differs``: an aggregate of a group against the result's cell) and
returns a Column over these measures.  All contracts of one pair of input and result share the
scans: one aggregate a frame, one grouping and join for each set of keys, however many contracts
there are.  Pairs are evaluated apart, some at a time, so the driver holds the plans of a few pairs.

Levels.  ``reference`` is the cheap, necessary condition that each operator is known by (a
total, a count, a range).  ``strict`` recomputes the operator and compares all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.compare import multiset_differs, normalised, scalar_cell, signature, subset_equal
from sparkloom.functions.expressions import close, normal_key
from sparkloom.operators import ordered
from sparkloom.operators.transforms import OPERATORS
from sparkloom.params import Inputs, MissingRole, Params, listed
from sparkloom.session import safe_unions

Contract = Callable[[Inputs, Params, DataFrame], Column]
CONTRACTS: dict[str, Contract] = {}
VERDICT = "contract string, applicable boolean, fired boolean, reason string"


class ShapeMissing(ValueError):
    """The result lacks a column that the contract reads."""


def contract(f: Contract) -> Contract:
    CONTRACTS[f.__name__] = f
    return f


def register_contract(name: str, build: Contract) -> None:
    """Add a contract of one's own; it must name columns only through its roles."""
    CONTRACTS[name] = build


def _need(df: DataFrame, *columns: str) -> None:
    if gone := [c for c in columns if c not in df.columns]:
        raise ShapeMissing(f"missing column {gone[0]}")


def _out(p: Params, name: str) -> str:
    return str(p.get("out") or OPERATORS[name].out)


class _Scans:
    """What the contracts of one pair measure, gathered by frame and by group."""

    def __init__(self) -> None:
        self.frames: list[tuple[DataFrame, list[Column]]] = []
        self.groups: list[tuple[DataFrame, DataFrame, list[str], list[tuple[Column, str]]]] = []

    def one(self, df: DataFrame, value: Column) -> Column:
        k = next((k for k, (f, _) in enumerate(self.frames) if f is df), len(self.frames))
        if k == len(self.frames):
            self.frames.append((df, []))
        self.frames[k][1].append(value)
        return F.col(f"__f{k}")[f"v{len(self.frames[k][1]) - 1}"]

    def differs(self, result: DataFrame, df: DataFrame, keys: list[str], value: Column, column: str) -> Column:
        k = next((k for k, (r, f, names, _) in enumerate(self.groups) if r is result and f is df and names == keys), len(self.groups))
        if k == len(self.groups):
            self.groups.append((result, df, keys, []))
        self.groups[k][3].append((value, column))
        return F.col(f"__g{k}")[f"v{len(self.groups[k][3]) - 1}"] > 0

    def row(self, spark: SparkSession) -> DataFrame:
        """One row that has all measures: a scalar for each frame and each grouping."""
        single = lambda df, values: df.agg(F.struct(*[v.alias(f"v{j}") for j, v in enumerate(values)]).alias("v")).scalar()
        made = [single(df, values).alias(f"__f{k}") for k, (df, values) in enumerate(self.frames)]
        for k, (result, df, keys, pairs) in enumerate(self.groups):
            want = df.groupBy(*keys).agg(*[v.alias(f"__w{j}") for j, (v, _) in enumerate(pairs)])
            bad = _bad_cells(result, want, keys, [(f"__w{j}", c) for j, (_, c) in enumerate(pairs)])
            made.append(single(*bad).alias(f"__g{k}"))
        return spark.range(1).select(F.col("id").alias("__id"), *made)


_SCANS: ContextVar[_Scans | None] = ContextVar("scans", default=None)


def _one(df: DataFrame, value: Column) -> Column:
    """An aggregate of a frame: shared where a pair's contracts are evaluated, else a scalar of its own."""
    scans = _SCANS.get()
    return scans.one(df, value) if scans else df.agg(value.alias("v")).scalar()


def _bad_cells(result: DataFrame, want: DataFrame, keys: list[str], cells: list[tuple[str, str]]) -> tuple[DataFrame, list[Column]]:
    """Expected groups beside the result's rows (keys compared as text, NULL keys left out), and counts of cells that are absent or not close."""
    names = [f"__k{i}" for i in range(len(keys))]
    texts = [F.col(k).cast("string").alias(n) for k, n in zip(keys, names)]
    got = result.select(*texts, *[F.col(c).cast("double").alias(f"__g{j}") for j, (_, c) in enumerate(cells)])
    expected = want.select(*texts, *[F.col(e).cast("double").alias(f"__e{j}") for j, (e, _) in enumerate(cells)]).dropna(subset=names)
    return expected.join(got, names, "left"), [F.count(F.when(~close(F.col(f"__g{j}"), F.col(f"__e{j}")), 1)) for j in range(len(cells))]


def _differs(result: DataFrame, df: DataFrame, keys: list[str], column: str, value: Column) -> Column:
    """Whether an aggregate of some group is absent from the result or not close to its cell."""
    _need(result, *keys, column)
    if scans := _SCANS.get():
        return scans.differs(result, df, keys, value, column)
    joined, counts = _bad_cells(result, df.groupBy(*keys).agg(value.alias("__w")), keys, [("__w", column)])
    return joined.agg(counts[0].alias("v")).scalar() > 0


def _count(df: DataFrame) -> Column:
    return _one(df, F.count(F.lit(1)))


# ---------------------------------------------------------------- the contracts


@contract
def weighted_mean(i, p, r):
    cell = scalar_cell(r, _out(p, "weighted_mean"))
    if cell is None:
        raise ShapeMissing("missing scalar")
    v, w = F.col(p["value"]), F.col(p["weight"])
    return ~close(_one(r, F.max(cell)).cast("double"), _one(i["df"], F.try_divide(F.sum(v * w), F.sum(w))))


@contract
def within_group_share(i, p, r):
    share = p.get("share_col") or _out(p, "within_group_share")
    _need(r, share, *listed(p["group"]))
    sums = r.groupBy(*listed(p["group"])).agg(F.sum(share).alias("s"))
    return _one(sums, F.coalesce(F.bool_or(~F.coalesce(F.abs(F.col("s") - 1) <= 1e-4, F.lit(False))), F.lit(False)))


@contract
def pct_point(i, p, r):
    _need(r, _out(p, "pct_point"))
    want = i["df"].select(((F.col(p["new"]) - F.col(p["old"])) * 100).alias("e"))
    return multiset_differs(r, want, _out(p, "pct_point"), "e")


@contract
def dedup_then_agg(i, p, r):
    _need(r, p["value"])
    one = OPERATORS["dedup_then_agg"].transform(i, p)
    return ~close(_one(r, F.sum(p["value"])).cast("double"), _one(one, F.sum(p["value"])).cast("double"))


@contract
def left_join_keep_all(i, p, r):
    return _count(r) != _count(i["df"])


@contract
def pooled_rate(i, p, r):
    return _differs(r, i["df"], listed(p["group"]), _out(p, "pooled_rate"), F.try_divide(F.sum(p["num"]), F.sum(p["den"])))


@contract
def median_not_mean(i, p, r):
    return _differs(r, i["df"], listed(p["group"]), p["value"], F.median(p["value"]))


@contract
def cumulative_running(i, p, r):
    out = _out(p, "cumulative_running")
    _need(r, out, *listed(p["order"]))
    last = _one(r, F.max_by(out, F.struct(*listed(p["order"])))).cast("double")
    return (_count(r) != _count(i["df"])) | ~close(last, _one(i["df"], F.sum(p["value"])).cast("double"))


@contract
def topn_with_ties(i, p, r):
    return _count(r) != _count(OPERATORS["topn_with_ties"].transform(i, p))


@contract
def nan_as_zero_sum(i, p, r):
    return _differs(r, i["df"], listed(p["group"]), p["value"], F.sum(F.coalesce(F.col(p["value"]), F.lit(0))))


@contract
def count_includes_empty(i, p, r):
    domain = i.get("domain", i["df"]).select(p["category"])
    return _count(r) < _one(domain, F.count_distinct(p["category"]))


@contract
def proportion_true(i, p, r):
    return _differs(r, i["df"], listed(p["group"]), _out(p, "proportion_true"), F.avg(F.col(p["flag"]).cast("int")))


@contract
def zscore_within_group(i, p, r):
    z = _out(p, "zscore_within_group")
    _need(r, z, *listed(p["group"]))
    means = r.groupBy(*listed(p["group"])).agg(F.avg(z).alias("m"))
    return _one(means, F.coalesce(F.bool_or(F.coalesce(F.abs("m") > 1e-3, F.lit(True))), F.lit(False)))


@contract
def dense_rank(i, p, r):
    k = _out(p, "dense_rank")
    _need(r, k)
    n = F.count_distinct(k)
    return _one(r, F.coalesce((F.min(k) != 1) | (F.max(k) != n), n > 0))


@contract
def cumcount_per_group(i, p, r):
    out, groups = _out(p, "cumcount_per_group"), listed(p["group"])
    _need(r, out, *groups)
    steps = r.select(*groups, (F.col(out) - F.lag(out).over(Window.partitionBy(*groups).orderBy(out))).alias("d"), out)
    per = steps.groupBy(*groups).agg(F.min(out).alias("a"), F.coalesce(F.bool_or(F.col("d") != 1), F.lit(False)).alias("bad"))
    return _one(per, F.bool_or("bad") | (F.min("a") != F.max("a")) | ~F.min("a").isin(0, 1))


@contract
def rank_pct(i, p, r):
    out = _out(p, "rank_pct")
    _need(r, out)
    return _one(r, F.coalesce((F.min(out) < 0) | (F.max(out) > 1), F.lit(False)))


@contract
def clip_outlier(i, p, r):
    _need(r, p["value"])
    v = F.col(p["value"])
    return (_count(r) != _count(i["df"])) | _one(r, F.coalesce((F.min(v) < p["lo"]) | (F.max(v) > p["hi"]), F.lit(False)))


@contract
def index_align(i, p, r):
    keys, out = listed(p["key"]), _out(p, "index_align")
    _need(r, *keys, out)
    want = OPERATORS["index_align"].transform(i, {**p, "out": "__w"}).select(*keys, "__w")
    joined, counts = _bad_cells(r, want, keys, [("__w", out)])
    return _one(joined, counts[0]) > 0


@contract
def dtype_coerce(i, p, r):
    out = _out(p, "dtype_coerce")
    _need(r, out)
    a = r.select(F.col(out).cast("string").alias("v"), F.lit(1).alias("s"))
    b = i["df"].select(F.col(p["id_col"]).cast("string").alias("v"), F.lit(-1).alias("s"))
    return _count(a.unionByName(b).groupBy("v").agg(F.sum("s").alias("d")).filter("d <> 0")) > 0


def _same_total(df: DataFrame, result: DataFrame, column: str) -> Column:
    _need(result, column)
    zero = lambda d: F.coalesce(_one(d, F.sum(column)).cast("double"), F.lit(0.0))
    return ~close(zero(result), zero(df))


@contract
def groupby_dropna_key(i, p, r):
    return _same_total(i["df"], r, p["value"])


@contract
def join_fanout(i, p, r):
    df = i["df"]
    if p.get("matched_on") and "df2" in i:
        df = df.join(i["df2"], listed(p["matched_on"]), "left_semi")
    return _same_total(df, r, p["measure"])


@contract
def order_dependent_dedup(i, p, r):
    keys, o = listed(p["key"]), listed(p["order"])[0]
    _need(r, *keys, o)
    want = i["df"].groupBy(*keys).agg(F.max(o).alias("__w"))
    got = r.groupBy(*keys).agg(F.max(o).alias("__g"), F.min(o).alias("__l"))
    bad = want.join(got, keys, "left").filter(~(F.col("__g").eqNullSafe(F.col("__w")) & F.col("__l").eqNullSafe(F.col("__w"))))
    return _count(bad) > 0


@contract
def resample_boundary(i, p, r):
    _need(r, p["value"])
    want = OPERATORS["resample_boundary"].transform(i, p).select(F.col(p["value"]).alias("__w"))
    return multiset_differs(r, want, p["value"], "__w")


@contract
def string_normalize_join(i, p, r):
    key, value = p["key"], p["lookup_value"]
    _need(r, key, value)
    right = i["df2"].filter(F.col(value).isNotNull()).select(normal_key(F.col(key)).alias("__k")).distinct()
    matchable = i["df"].select(normal_key(F.col(key)).alias("__k")).distinct().join(right, "__k", "left_semi")
    answered = r.filter(F.col(value).isNotNull()).select(normal_key(F.col(key)).alias("__k")).distinct()
    return _count(matchable.join(answered, "__k", "left_anti")) > 0


@contract
def null_in_agg_count(i, p, r):
    return _differs(r, i["df"], listed(p["group"]), _out(p, "null_in_agg_count"), F.count(F.lit(1)))


@contract
def scale_before_split_leakage(i, p, r):
    s = p.get("scaled") or "scaled"
    _need(r, s, p["split"])
    mean = _one(r.filter(F.col(p["split"]) == p["train_label"]), F.avg(s))
    return F.coalesce(F.abs(mean) > 0.05, F.lit(True))


@contract
def lookahead_return(i, p, r):
    out, price, order = _out(p, "lookahead_return"), p["price"], listed(p["order"])
    _need(r, out, price, *order)
    groups = listed(p.get("group"))
    plain = groups or r.schema[order[0]].dataType.typeName() in ("string", "binary", "boolean")
    back = r.withColumn("__back", F.lag(price).over(Window.partitionBy(*groups).orderBy(*order))) if plain else ordered.lagged(r, price, order, "__back")
    pairs = back.select(F.col(out).alias("o"), (F.try_divide(F.col(price), F.col("__back")) - 1).alias("e")).filter("e is not null")
    return _one(pairs, F.coalesce(F.bool_or(~F.coalesce(F.abs(F.col("o") - F.col("e")) <= 1e-6, F.lit(False))), F.lit(False)))


@contract
def latlon_swap(i, p, r):
    _need(r, p["lat"])
    return _one(r, F.coalesce(F.bool_or(F.abs(p["lat"]) > 90), F.lit(False)))


@contract
def array_difference(i, p, r):
    out = _out(p, "array_difference")
    _need(r, out)
    n = p.get("n")
    size = F.size(out) != (F.lit(n) if n is not None else F.size(p["a"]))
    return _one(r, F.coalesce(F.bool_or(size), F.lit(False)))


# ---------------------------------------------------------------- running them


def applicable(name: str, inputs: Inputs, params: Params) -> bool:
    """Whether the operator is known, has its roles, and these name columns of the input."""
    if name not in CONTRACTS:
        return False
    if name not in OPERATORS:
        return True
    op = OPERATORS[name]
    if any(f not in inputs for f in op.frames) or any(params.get(r) is None for r in op.constants) or (op.ordered and not params.get("order")):
        return False
    return all(params.get(r) is not None and set(listed(params[r])) <= set(inputs["df"].columns) for r in op.columns)


Case = tuple[str, Inputs, Params, DataFrame | None]
#: Pairs of input and result whose plans are made and run at once.
PAIRS_AT_ONCE = 4


def _judged(name: str, inputs: Inputs, params: Params, result: DataFrame | None, level: str) -> tuple[bool, Column | bool | None, str]:
    """Whether the contract applies, whether it fired (over the pair's measures), and why."""
    if not applicable(name, inputs, params):
        return False, None, "uncovered"
    if result is None:
        return True, True, "no result"
    try:
        if level == "strict":
            want = OPERATORS[name](inputs, params)
            if not set(want.columns) <= set(result.columns):
                return True, True, "columns"
            a, b = normalised(want), normalised(result.select(*want.columns))
            return True, (_count(a.exceptAll(b)) > 0) | (_count(b.exceptAll(a)) > 0), "strict"
        return True, F.coalesce(CONTRACTS[name](inputs, params, result), F.lit(True)), "invariant"
    except ShapeMissing:
        return True, True, "shape"
    except MissingRole:
        return False, None, "uncovered"
    except Exception as e:  # an error while planning is a fire
        return True, True, str(e)[:60]


def _pair(cases: list[Case], level: str) -> DataFrame:
    """The verdicts on one pair of input and result, a row a contract, over shared scans."""
    spark = cases[0][1]["df"].sparkSession
    safe_unions(spark)
    scans = _Scans()
    token = _SCANS.set(scans)
    try:
        judged = [(c[0], *_judged(*c, level)) for c in cases]
    finally:
        _SCANS.reset(token)
    rows = [
        F.struct(F.lit(n).alias("contract"), F.lit(ok).alias("applicable"), (f if isinstance(f, Column) else F.lit(f)).cast("boolean").alias("fired"), F.lit(why).cast("string").alias("reason"))
        for n, ok, f, why in judged
    ]
    return scans.row(spark).select(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _pairs(cases: list[Case]) -> list[list[int]]:
    """The cases' numbers, together where input and result are the same frames."""
    found: dict[tuple, list[int]] = {}
    for k, (_, inputs, _, result) in enumerate(cases):
        found.setdefault((id(result), *sorted((n, id(f)) for n, f in inputs.items())), []).append(k)
    return list(found.values())


def verdict(name: str, inputs: Inputs, params: Params, result: DataFrame | None, level: str = "reference") -> DataFrame:
    """One lazy row.  Abstains (``applicable`` false) where the gate says so or a column is absent."""
    return _pair([(name, inputs, params, result)], level)


def verdicts(cases: list[Case], level: str = "reference") -> DataFrame:
    """Many verdicts as one frame: lazy for one pair of input and result, else a table of ``evaluated`` rows."""
    if len(_pairs(cases)) == 1:
        return _pair(cases, level)
    spark = cases[0][1]["df"].sparkSession
    return spark.createDataFrame([tuple(r) for r in evaluated(cases, level)], VERDICT)


def evaluated(cases: list[Case], level: str = "reference") -> list[Row]:
    """The verdicts as rows in the cases' order.  If a pair's action fails, its contracts are run alone, and one that fails has fired."""

    def run(numbers: list[int]) -> list[Row]:
        some = [cases[k] for k in numbers]
        try:
            return _pair(some, level).collect()
        except Exception:
            return [_alone(c, level) for c in some]

    pairs = _pairs(cases)
    with ThreadPoolExecutor(PAIRS_AT_ONCE) as pool:
        found = dict(pair for numbers, rows in zip(pairs, pool.map(run, pairs)) for pair in zip(numbers, rows, strict=True))
    return [found[k] for k in range(len(cases))]


def _alone(case: Case, level: str) -> Row:
    try:
        return verdict(*case, level=level).first()
    except Exception as e:  # an error at run time is a fire
        return Row(contract=case[0], applicable=True, fired=True, reason=str(e)[:60])


def family(inputs: Inputs, result: DataFrame) -> str:
    """Row-keeping operators leave the number of rows; the others reduce it."""
    sides = inputs["df"].agg(F.count(F.lit(1)).alias("a")).select("a", result.agg(F.count(F.lit(1))).scalar().alias("b")).first()
    return "row" if sides.a == sides.b else "group"


def has_unit_column(result: DataFrame) -> bool:
    """Whether some number of the result stays in [0, 1] and is not only 0 and 1, as a rank in per cent does."""
    numeric = [c for c, t in result.dtypes if t in ("double", "float", "bigint", "int", "smallint", "tinyint") or t.startswith("decimal")]
    if not numeric:
        return False
    v = {c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in numeric}
    tests = [F.coalesce(F.min(x).between(-1e-9, 1 + 1e-9) & F.max(x).between(-1e-9, 1 + 1e-9) & F.bool_or((x != 0) & (x != 1)), F.lit(False)) for x in v.values()]
    return any(result.agg(*[t.alias(f"c{i}") for i, t in enumerate(tests)]).first())


def run_all(inputs: Inputs, params_of: dict[str, Params], result: DataFrame, prune: bool = True) -> dict[str, bool]:
    """Which contracts fire; shape mismatches count as abstaining.

    Pruned to the result's family: rows kept or reduced, and no rank in per cent without such a column.
    """
    names = [n for n in params_of if n in CONTRACTS]
    if prune:
        kind = family(inputs, result)
        names = [n for n in names if n not in OPERATORS or OPERATORS[n].family == kind]
        if "rank_pct" in names and not has_unit_column(result):
            names.remove("rank_pct")
    if not names:
        return {}
    rows = evaluated([(n, inputs, params_of[n], result) for n in names])
    return {r.contract: bool(r.fired) for r in rows if r.applicable and r.reason != "shape"}


def execution_pass(result: DataFrame | None) -> bool:
    return result is not None


def valid(result: DataFrame | None) -> bool:
    """A weak detector to compare with: not empty, and not all numbers missing."""
    if result is None or result.isEmpty():
        return False
    numeric = [c for c, t in result.dtypes if t in ("double", "float", "bigint", "int")]
    return not numeric or sum(result.agg(*[F.count(c) for c in numeric]).first()) > 0


def candidate_verdict(inputs: Inputs, params: Params, name: str, correct: DataFrame, slip: DataFrame, alternates: list[DataFrame]) -> str:
    """Whether a contract earns its place: fires on the slip, silent on every right form."""
    if subset_equal(slip, correct):
        return "NOT-SILENT"
    rows = evaluated([(name, inputs, params, r) for r in (slip, correct, *alternates)])
    fired = [bool(r.fired) for r in rows]
    if rows[0].reason not in ("invariant", "shape"):
        return "ERROR"
    if fired[1]:
        return "FALSE-POSITIVE"
    if not fired[0]:
        return "MISS"
    return "VIABLE-FRAGILE" if any(fired[2:]) else "VIABLE"


def contract_score(name: str, inputs: Inputs, params: Params, results: list[DataFrame], order: list[str]) -> tuple[int, int]:
    """Without an answer key: how many results of the largest agreeing group pass, and how many probes of it fire."""
    seen = [tuple(signature(r).first()) for r in results]
    most = max(seen, key=seen.count)
    agreed = [r for r, s in zip(results, seen, strict=True) if s == most]
    changed = list(probes(agreed[0], order).values())
    passes = verdicts([(name, inputs, params, r) for r in agreed]).filter("not fired").count()
    return passes, verdicts([(name, inputs, params, r) for r in changed]).filter("fired").count()


def probes(result: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Metamorphic changes of a right result that a contract should notice."""
    numeric = [c for c, t in result.dtypes if t in ("double", "float", "bigint", "int")]
    last = numeric[-1]
    numbered = ordered.numbered(result, order, "__n")
    top = result.agg(F.count(F.lit(1))).scalar()
    back = numbered.select((top + 1 - F.col("__n")).alias("__n"), F.col(last).alias("__v"))
    return {
        "scaled": result.withColumn(last, F.col(last) * 2 + 1),
        "reversed": numbered.join(back, "__n").withColumn(last, F.col("__v")).drop("__n", "__v"),
        "shortened": numbered.filter(F.col("__n") < top).drop("__n"),
        "spiked": numbered.withColumn(last, F.when(F.col("__n") == 1, F.col(last) + 1000).otherwise(F.col(last))).drop("__n"),
    }
