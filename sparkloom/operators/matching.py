"""Matching a predicted long table (series, x, value) to ground truth, and scoring it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import ordered
from sparkloom.operators.assignment import assigned
from sparkloom.session import safe_unions

RELATIVE, FLOOR = 0.015, 1.0


def infer_axes(df: DataFrame, overlay: dict[str, str] | None = None) -> tuple[str, str, str | None]:
    """x, y and group: those that the overlay names where they are columns, else the first column and the first number."""
    given = {k: v for k, v in (overlay or {}).items() if v in df.columns}
    plain = [c for c in df.columns if not c.startswith("_")] or df.columns
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return given.get("x") or plain[0], given.get("y") or (numbers or df.columns[-1:])[0], given.get("group") or given.get("series")


def wide_to_long(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """One block for each y; missing cells go."""
    return df.unpivot([x], ys, "series", "value").filter("value is not null").select("series", F.col(x).cast("string").alias("x"), F.col("value").cast("double").alias("value"))


def coerce_prediction(df: DataFrame, x: str | None = None, value: str | None = None, series: str | None = None) -> DataFrame:
    """To (series, x, value) by given or usual names; the last column is the value if none fits."""
    pick = lambda given, usual: given or next((c for c in df.columns if c.lower() in usual), None)
    x = pick(x, ("x", "category", "label")) or df.columns[0]
    value = pick(value, ("value", "y", "val")) or df.columns[-1]
    series = pick(series, ("series", "group", "legend"))
    return df.select((F.col(series).cast("string") if series else F.lit(None).cast("string")).alias("series"), F.col(x).cast("string").alias("x"), F.col(value).try_cast("double").alias("value"))


def fill_series(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """A missing series is that of the one truth row with this x, else the only series there is."""
    one = truth.groupBy("x").agg(F.count_distinct("series").alias("n"), F.min("series").alias("s")).filter("n = 1").select("x", "s")
    only = truth.agg(F.when(F.count_distinct("series") == 1, F.min("series"))).scalar()
    return pred.join(one, "x", "left").withColumn("series", F.coalesce("series", "s", only)).drop("s")


def fill_by_order(pred: DataFrame, lines: list[str], names: list[str], order: str) -> DataFrame:
    """Missing series by the place of the line (``series_order``), the rest by colour if there are several.

    Colours are taken in order of first appearance, one name each, as far as names go.
    """
    blank = F.coalesce(F.trim("series"), F.lit("")) == ""
    out = pred
    if lines and "series_order" in pred.columns:
        by_place = F.get(F.array(*map(F.lit, lines)), F.col("series_order").cast("int"))
        out = out.withColumn("series", F.when(blank & F.col("series_order").between(0, len(lines) - 1), by_place).otherwise(F.col("series")))
    if names and "color" in pred.columns:
        seen = out.filter(blank & F.col("color").isNotNull()).groupBy("color").agg(F.min(order).alias("o"))
        # As many colours as there are names (two at least, to see whether there are several).
        lead = seen.orderBy("o", "color").limit(max(2, len(names))).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "color"))), lambda c: c["color"])).scalar()
        by_colour = F.get(F.array(*map(F.lit, names)), F.array_position(lead, F.col("color")).cast("int") - 1)
        out = out.withColumn("series", F.when(blank & (F.size(lead) > 1) & (F.array_position(lead, F.col("color")) > 0), F.coalesce(by_colour, "series")).otherwise(F.col("series")))
    return out


def cohesion(overlays: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """How well the series of a chart go together, 0 to 1, and what does not.

    ``overlays``: (chart ..., x, y, axis, style, legend, ratio, shown_order).  Penalties: different x
    (0.35; 0.2 if only the shown order differs), several series without a legend (0.2), equal styles
    (0.25), ratios and amounts on one axis (0.35), names that are no column (0.05 each, 0.2 at most).
    One series alone is whole.
    """
    has = lambda c: F.col(c).isNotNull() & ~F.col(c).isin(*columns)
    axis = F.coalesce("axis", F.lit("left"))
    c = overlays.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("series"), F.count_distinct("x").alias("xs"), F.coalesce(F.bool_or("legend"), F.lit(False)).alias("legend"),
        F.count_distinct("style").alias("styles"), F.count("style").alias("styled"), F.coalesce(F.bool_and("shown_order"), F.lit(True)).alias("ordered"),
        F.arrays_overlap(F.collect_set(F.when(F.col("ratio"), axis)), F.collect_set(F.when(~F.col("ratio"), axis))).alias("mixed"),
        (F.sum(has("x").cast("int")) + F.sum(has("y").cast("int"))).alias("missing"),
    )
    rules = {
        "x.inconsistent": ((F.col("xs") > 1) | ~F.col("ordered"), F.when(F.col("xs") > 1, 0.35).otherwise(0.2)),
        "legend.missing.multi": ((F.col("series") > 1) & ~F.col("legend"), F.lit(0.2)),
        "series.style.conflict": ((F.col("styled") >= 2) & (F.col("styles") < F.least("styled", "series")), F.lit(0.25)),
        "ratio.axis.mismatch": (F.col("mixed"), F.lit(0.35)),
    }
    whole = (F.col("n") <= 1) & (F.col("series") <= 1)
    lost = sum((F.when(test, penalty).otherwise(0.0) for test, penalty in rules.values()), F.least(F.lit(0.2), 0.05 * F.col("missing")))
    keys = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, (test, _) in rules.items()]))
    return c.select(*by, F.when(whole, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - lost)).alias("score"), F.when(whole, F.array().cast("array<string>")).otherwise(keys).alias("diagnostics"))


def greedy_match(pred: DataFrame, truth: DataFrame, order: str, relative: float = RELATIVE, floor: float = FLOOR) -> DataFrame:
    """Every predicted and every left-over truth row with its kind.

    In prediction order each row takes the nearest unused truth row of its x and series (with
    none there, of its x; the lower one of equally near ones): ``match`` within max(|truth| * relative, floor),
    else ``wrong_value``.  No candidate, or all used: ``wrong_mapping``.  Truth rows not used: ``missing_series``.
    Series of an x are matched apart unless a prediction there has no series of its own; large ones by
    parts (``assignment``).
    """
    clean = lambda d, n: d.select(F.col("x").cast("string").alias("x"), F.col("series").cast("string").alias("pool"), F.col("value").cast("double").alias("v"), n.cast("long").alias("n")).dropna(subset=["x", "v"])
    safe_unions(pred.sparkSession)
    p, t = clean(pred, F.col(order)), clean(truth, F.lit(0))
    # Null is a series as well; the aggregate marks every (x, series) that has truth, and every x with a prediction that has none.
    both = p.withColumn("target", F.lit(False)).unionByName(t.withColumn("target", F.lit(True)))
    series = both.groupBy("x", "pool").agg((~F.bool_or("target")).alias("roams"))
    mixed = series.filter("roams").select("x").distinct().withColumn("mixed", F.lit(True))
    s = series.join(mixed, "x", "left").select(F.col("x").alias("__x"), F.col("pool").alias("__pool"), "roams", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    rows = both.join(s, (F.col("x") == F.col("__x")) & F.col("pool").eqNullSafe(F.col("__pool")))
    rows = rows.select("x", "target", "n", "v", "pool", "roams", F.when(~F.col("mixed"), F.col("pool")).alias("own"))
    found = assigned(rows, ["x", "own"])
    near = F.abs(F.col("gt") - F.col("v")) <= F.greatest(F.abs("gt") * relative, F.lit(floor))
    kind = F.when(F.col("target"), "missing_series").when(~F.col("used"), "wrong_mapping").when(near, "match").otherwise("wrong_value")
    return found.filter("NOT (target AND used)").select(
        kind.alias("type"), F.col("pool").alias("series"), "x", F.when(F.col("target"), F.col("v")).otherwise(F.col("gt")).alias("gt"), F.when(~F.col("target"), F.col("v")).alias("pred")
    )


def f1(matched: DataFrame) -> DataFrame:
    """Precision, recall (over used truth rows) and F1 of a match; a wrong value still uses its row."""
    kind = lambda *names: F.count_if(F.col("type").isin(*names))
    c = matched.agg(kind("match").alias("tp"), kind("wrong_value").alias("wrong"), kind("match", "wrong_value", "wrong_mapping").alias("n_pred"), kind("missing_series").alias("fn"))
    c = c.withColumn("fp", F.col("n_pred") - F.col("tp"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def rnss(pred: DataFrame, truth: DataFrame, order: str, relative: float = RELATIVE, floor: float = FLOOR, by: list[str] | None = None) -> DataFrame:
    """F1 on values alone: each prediction in order takes the nearest unused truth value, if that is in tolerance.

    A large chart (``by``) is matched in parts, as predictions look no farther than their tolerance (``assignment``).
    Without any tolerance each takes an equal value or none, in whatever order: of each value the lesser count is matched.
    """
    safe_unions(pred.sparkSession)
    keys = by or ["__chart"]
    side = lambda d, n, target: (d if by else d.withColumn("__chart", F.lit(1))).select(
        *keys, F.lit(target).alias("target"), n.cast("long").alias("n"), F.col("value").cast("double").alias("v"), F.lit(None).cast("string").alias("pool"), F.lit(False).alias("roams")
    )
    both = side(pred, F.col(order), False).unionByName(side(truth, F.lit(0), True)).dropna(subset=["v"])
    sides = (F.count_if(~F.col("target")).alias("n_pred"), F.count_if("target").alias("n_truth"))
    if relative == 0 and floor == 0:
        out = both.groupBy(*keys, "v").agg(*sides).groupBy(*keys).agg(F.sum(F.least("n_pred", "n_truth")).alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_truth").alias("n_truth"))
    else:
        found = assigned(both, keys, (relative, floor))
        out = found.groupBy(*keys).agg(F.count_if(F.col("used") & ~F.col("target")).alias("tp"), *sides)
    out = out.withColumn("rnss", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_pred") + F.col("n_truth")), F.lit(0.0)))
    return out if by else out.drop("__chart")


#: An axis of so many ticks is looked up row by row, by comparisons; one of more is merged with the points.
FEW_TICKS = 256


def snap_to_ticks(points: DataFrame, ticks: DataFrame, few: int = FEW_TICKS) -> DataFrame:
    """The label of the nearest tick for each x, the lower one of equally near ones; none for a missing x or without ticks.

    A point is between the last tick up to it and the first after it.  With ``few`` ticks or less (they are read
    while the plan is built) a tree of comparisons finds the two, and points stay where they are.  More ticks and
    the points are merged in order of place, cut in ranges (``ordered``), so an axis may have any number of ticks.
    """
    t = ticks.select(F.col("pos").cast("double").alias("pos"), "label").dropna(subset=["pos"]).groupBy("pos").agg(F.min("label").alias("label"))
    axis = sorted(t.limit(few + 1).collect(), key=lambda r: r.pos)
    return _merged_with_ticks(points, t) if len(axis) > few else _looked_up(points, axis, ticks.schema["label"].dataType)


def _nearer(x: Column, low: Column, high: Column) -> Column:
    """The label of one of two ticks (pos, label) around x; either may be missing."""
    lower = high.isNull() | (x - low["pos"] <= high["pos"] - x)
    return F.when(x.isNotNull(), F.when(lower & low.isNotNull(), low["label"]).otherwise(high["label"]))


def _looked_up(points: DataFrame, axis: list, kind: T.DataType) -> DataFrame:
    if not axis:
        return points.select("*", F.lit(None).cast(kind).alias("label"))
    all_ticks = F.array(*[F.struct(F.lit(r.pos).alias("pos"), F.lit(r.label).cast(kind).alias("label")) for r in axis])
    x = F.col("x").cast("double")
    placed = points.withColumn("__upto", ordered.place(x, [r.pos for r in axis], 0))  # ticks up to x
    low = F.get(all_ticks, F.col("__upto") - 1)
    return placed.select(*points.columns, _nearer(x, low, F.get(all_ticks, F.col("__upto"))).alias("label"))


def _merged_with_ticks(points: DataFrame, t: DataFrame) -> DataFrame:
    safe_unions(points.sparkSession)
    kind = T.StructType([T.StructField("pos", T.DoubleType()), T.StructField("label", t.schema["label"].dataType)])
    rows = points.select(F.col("x").cast("double").alias("__x"), F.struct(*points.columns).alias("__row"), F.lit(None).cast(kind).alias("__tick"))
    both = rows.unionByName(t.select(F.col("pos").alias("__x"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.struct("pos", "label").alias("__tick")))
    cut = ordered.ranged(both, "__x")
    # Two running windows: a frame up to the last row would be read again for each row.
    upward = Window.partitionBy("__range").orderBy("__x", F.col("__row").isNotNull())  # a tick comes before the points on it
    downward = Window.partitionBy("__range").orderBy(F.col("__x").desc(), F.col("__row").isNull())  # and after them
    last = lambda w: F.last("__tick", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = cut.groupBy("__range").agg(F.min("__tick").alias("first"), F.max("__tick").alias("last"))
    w = Window.orderBy("__range")  # a row a range
    ends = ends.select("__range", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    seen = cut.withColumn("__low", last(upward)).withColumn("__high", last(downward)).filter("__row IS NOT NULL").join(F.broadcast(ends), "__range")
    return seen.select("__row.*", _nearer(F.col("__x"), F.coalesce("__low", "__before"), F.coalesce("__high", "__after")).alias("label"))


def first_source(**sources: DataFrame | None) -> tuple[str, DataFrame] | None:
    """The first table there is, by order of trust."""
    return next(((k, v) for k, v in sources.items() if v is not None), None)


def best_source(truth: DataFrame, order: str, least: float = 0.75, **sources: DataFrame | None) -> tuple[str, float] | None:
    """The most trusted table; if its F1 is under ``least``, the first later one that does better."""
    best = None
    for name, pred in sources.items():
        if pred is None:
            continue
        score = f1(greedy_match(pred, truth, order)).first().f1
        if best is None or score > best[1]:
            best = (name, score)
        if best[1] >= least:
            break
    return best


def weighted_score(scores: dict[str, Column | None], weights: dict[str, float]) -> Column:
    """Mean of the scores there are, each cut to [0, 1], by weight."""
    there = {k: v for k, v in scores.items() if v is not None}
    total = sum(weights[k] for k in there)
    return sum((F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * weights[k] for k, v in there.items()), F.lit(0.0)) / (total or 1)


def order_agrees(shown: Column, expected: Column) -> Column:
    """Whether the common labels come in the expected order."""
    return F.filter(shown, lambda a: F.array_contains(expected, a)) == F.filter(expected, lambda a: F.array_contains(shown, a))


def ranked_candidates(df: DataFrame) -> DataFrame:
    """Best first: runs, score, fewer diagnostics, lower index."""
    return df.orderBy(F.col("ok").desc(), F.col("score").desc_nulls_last(), F.col("diagnostics").asc(), F.col("idx").asc())


def coverage_class(f: Column) -> Column:
    return F.when(f >= 0.99, "full").when(f >= 0.5, "partial").otherwise("none")


def ablation_means(df: DataFrame, config: str, score: str, ok: str) -> DataFrame:
    return df.groupBy(config).agg(F.coalesce(F.avg(F.when(F.col(ok), F.col(score))), F.lit(0.0)).alias("mean"), F.count_if(ok).alias("n_ok"))


# ---------------------------------------------------------------- corruptions, for tests of the match


def wrong_value(df: DataFrame, y: str, key: list[str], seed: int = 0) -> DataFrame:
    """One cell, chosen by a hash of its key (as text, with the seed), times 0.6 (42 for a zero)."""
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    chosen = df.agg(F.min(place)).scalar()
    v = F.when(F.col(y) == 0, F.lit(42.0)).otherwise(F.col(y) * 0.6)
    return df.withColumn(y, F.when(place == chosen, v).otherwise(F.col(y).cast("double")))


def scale_series(df: DataFrame, y: str, factor: float = 0.7) -> DataFrame:
    return df.withColumn(y, F.col(y) * factor)


def drop_series(df: DataFrame, ys: list[str], y: str) -> DataFrame:
    if len(ys) < 2:
        raise ValueError("dropping a series needs two")
    return df.withColumn(y, F.lit(0.0))


def swap_categories(df: DataFrame, y: str, order: str) -> DataFrame:
    """The values of the first and the last row change places."""
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.min_by(y, order).alias("va"), F.max_by(y, order).alias("vb"))
    at = lambda c: ends.select(c).scalar()
    return df.withColumn(y, F.when(F.col(order) == at("a"), at("vb")).when(F.col(order) == at("b"), at("va")).otherwise(F.col(y)))


def localised(mismatches: DataFrame, series: str) -> DataFrame:
    """Whether all mismatches point at the corrupted series."""
    return mismatches.filter("type <> 'match'").agg(F.coalesce(F.bool_and(F.col("series") == series), F.lit(False)).alias("localised"))
