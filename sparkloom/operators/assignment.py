"""Greedy assignment on an axis: seekers, in their order, each take the nearest free target.

Of equally near targets the lower one goes first.  The rule is sequential within a group, so a small
group is solved by one task, in n log n steps (pointers to the next free target on either side);
many small groups are dealt to a call together.
A group of more rows than ``part_rows`` is cut in parts by value.  Every part is solved for itself,
and each seeker states the interval it looked at: up to the target it took, or to its tolerance.  If no
interval reaches a target of another part, the parts had nothing to do with each other and the
results are those of the whole.  Where one does, the cut is moved to the last place in the lower part that
no interval covers, the two parts are solved again, and so on; after some rounds parts that
still meet become one.  So cuts never change the result; a group ends in one task only if its
seekers look past all other places, as when a group has far more seekers than targets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import ordered
from sparkloom.session import checkpointed, safe_unions

PART_ROWS = 200_000
#: Rows of small groups that one call solves, on average.
SHARD_ROWS = 200_000
#: Rounds in which cuts move before parts that meet become one.
MOVES = 3


class _Free:
    """Sorted targets and, for each place, the next free one on either side."""

    def __init__(self, values: list[float]) -> None:
        self.values, n = values, len(values)
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # shifted by one for down: 0 is none

    def _find(self, links: list[int], k: int) -> int:
        while links[k] != k:
            links[k] = links[links[k]]
            k = links[k]
        return k

    def take(self, k: int) -> None:
        self.up[k], self.down[k + 1] = k + 1, k

    def nearest(self, v: float) -> int | None:
        at, n = bisect_left(self.values, v), len(self.values)
        above, below = self._find(self.up, at), self._find(self.down, at) - 1
        if below < 0 or (above < n and self.values[above] - v < v - self.values[below]):
            return above if above < n else None
        return self._find(self.up, bisect_left(self.values, self.values[below]))  # the first of equal targets


def reach(v: np.ndarray, relative: float, floor: float) -> np.ndarray:
    """How far a target within max(|target| * relative, floor) may lie."""
    factor = relative / (1 - relative) if relative < 1 else np.inf
    return np.maximum(floor, factor * np.abs(v)) if factor else np.full(len(v), floor)


def greedy(value: list[float], pools: list, seekers: Iterable[tuple[float, object, bool, float]], tolerance: tuple[float, float] | None) -> Iterator[tuple[int, float]]:
    """For each seeker (place, pool, whether it roams, how far it may look) the target it takes, or -1, and how far it looked.

    Targets are sorted by place and pool.
    """
    one = len(set(pools)) < 2
    places: dict[object, Sequence[int]] = {pools[0]: range(len(value))} if one and pools else {}
    if not one:
        for k, pool in enumerate(pools):
            places.setdefault(pool, []).append(k)
    within = [0] * len(value)
    for found in places.values():
        for i, k in enumerate(found):
            within[k] = i
    free = {pool: _Free([value[k] for k in found]) for pool, found in places.items()}
    every = None
    if not one:
        seekers = list(seekers)
        every = _Free(list(value)) if any(s[2] for s in seekers) else None
    for x, pool, roam, bound in seekers:
        axis = (free[pools[0]] if one and pools else every) if roam else free.get(pool)
        k = axis.nearest(x) if axis else None
        if k is None:
            yield -1, bound
            continue
        distance = abs(axis.values[k] - x)
        if distance > bound:
            yield -1, bound
            continue
        if tolerance is not None and distance > max(abs(axis.values[k]) * tolerance[0], tolerance[1]):
            yield -1, distance
            continue
        j = k if roam else places[pool][k]
        free[pools[j]].take(within[j])
        if every:
            every.take(j)
        yield j, distance


def solve(rows: pd.DataFrame, tolerance: tuple[float, float] | None) -> pd.DataFrame:
    """One part: each seeker's target and interval, each target's use, and the place where the part may be cut."""
    is_target = rows["target"].to_numpy(dtype=bool)
    targets = rows[is_target].sort_values(["v", "pool"], na_position="first", kind="stable")
    seekers = rows[~is_target].sort_values("n", kind="stable")
    value = targets["v"].to_numpy()
    known = lambda pools: [None if pd.isna(p) else p for p in pools]
    v = seekers["v"].to_numpy()
    bound = np.full(len(v), np.inf) if tolerance is None else reach(v, *tolerance)
    taken = list(greedy(value.tolist(), known(targets["pool"]), zip(v.tolist(), known(seekers["pool"]), seekers["roams"].tolist(), bound.tolist(), strict=True), tolerance))
    got, looked = np.array([k for k, _ in taken], np.int64), np.array([far for _, far in taken], float)
    used = np.zeros(len(value), bool)
    used[got[got >= 0]] = True
    targets = targets.assign(gt=np.nan, used=used, lo=np.inf, hi=-np.inf)
    seekers = seekers.assign(gt=np.where(got >= 0, value[np.maximum(got, 0)] if len(value) else np.nan, np.nan), used=got >= 0, lo=v - looked, hi=v + looked)
    out = pd.concat([targets, seekers])
    # Neighbours in value between which no interval lies may be parted; the highest such place, if there is one.
    axis = np.sort(out["v"].to_numpy())
    cover = np.zeros(len(axis) + 1, np.int64)
    np.add.at(cover, np.minimum(np.searchsorted(axis, v - looked, "left"), np.searchsorted(axis, v, "left")), 1)
    np.add.at(cover, np.searchsorted(axis, v + looked, "right") - 1, -1)
    open_ = np.flatnonzero((np.cumsum(cover)[: len(axis) - 1] == 0) & (np.diff(axis) > 0))
    return out.assign(cut=axis[open_[-1]] if len(open_) else np.nan)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values (missing ones too) as equal numbers."""
    if pa.types.is_floating(column.type):
        column = pc.add(column, 0.0)  # one zero
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def solve_groups(rows: pa.Table, keys: list[str], tolerance: tuple[float, float] | None) -> pa.Table:
    """Many whole groups at once: the rows as they are, with ``gt`` and ``used``."""
    group = np.zeros(len(rows), np.int64)
    for k in keys:
        number = _numbers(rows[k])
        group = np.unique(group * (number.max(initial=0) + 1) + number, return_inverse=True)[1]
    target, v = rows["target"].to_numpy(), rows["v"].to_numpy()
    pools = np.array(rows["pool"].to_pylist(), dtype=object) if rows["pool"].null_count < len(rows) else np.full(len(rows), None)
    name = {p: i for i, p in enumerate(sorted({p for p in pools if p is not None}), 1)}
    rank = np.array([name.get(p, 0) for p in pools], np.int64) if name else np.zeros(len(rows), np.int64)
    t, s = np.flatnonzero(target), np.flatnonzero(~target)
    t, s = t[np.lexsort((rank[t], v[t], group[t]))], s[np.lexsort((rows["n"].to_numpy()[s], group[s]))]
    gt, used = np.full(len(rows), np.nan), np.zeros(len(rows), bool)
    bound = np.full(len(s), np.inf) if tolerance is None else reach(v[s], *tolerance)
    value, own, wanted = v[t].tolist(), rank[t].tolist(), list(zip(v[s].tolist(), rank[s].tolist(), rows["roams"].to_numpy()[s].tolist(), bound.tolist(), strict=True))
    got = np.full(len(s), -1, np.int64)
    groups = np.arange(group.max(initial=-1) + 2)
    t_ends, s_ends = np.searchsorted(group[t], groups).tolist(), np.searchsorted(group[s], groups).tolist()
    for a, b, c, d in zip(t_ends, t_ends[1:], s_ends, s_ends[1:], strict=False):
        if a < b and c < d:
            got[c:d] = [a + k if k >= 0 else -1 for k, _ in greedy(value[a:b], own[a:b], wanted[c:d], tolerance)]
    found = got >= 0
    gt[s[found]], used[s[found]], used[t[got[found]]] = v[t[got[found]]], True, True
    return rows.append_column("gt", pa.array(gt, mask=~used | target)).append_column("used", pa.array(used))


def assigned(rows: DataFrame, keys: list[str], tolerance: tuple[float, float] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``used`` and, for seekers, ``gt`` (the value taken).

    ``rows``: the keys, ``target`` (boolean), ``n`` (seekers' order), ``v``, ``pool`` (which targets a seeker
    may take) and ``roams`` (whether it may take all).  ``tolerance``: (relative, floor), as ``reach``;
    a seeker whose nearest free target is not within it takes none.
    """
    safe_unions(rows.sparkSession)
    rows = rows.select(*keys, "target", "n", "v", "pool", "roams")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = f"{kinds}, part long, gt double, used boolean, lo double, hi double, cut double"
    columns = [*rows.columns, "part", "gt", "used", "lo", "hi", "cut"]
    solved = lambda parts: parts.groupBy(*keys, "part").applyInPandas(lambda part: solve(part, tolerance)[columns], schema)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.filter(F.col("__n") > part_rows)
    n, most = sizes.agg(F.sum("__n"), F.sum(F.when(F.col("__n") > part_rows, F.col("__n")))).first()
    # Small groups share tasks' calls; a shard has about as many rows as a part.
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n or 0) // SHARD_ROWS)
    shard = F.pmod(F.xxhash64(*keys), F.lit(shards))

    def together(whole: DataFrame) -> DataFrame:
        out = whole.withColumn("shard", shard).groupBy("shard").applyInArrow(lambda shard: solve_groups(shard, keys, tolerance), f"{kinds}, shard long, gt double, used boolean")
        return out.select(*rows.columns, "gt", "used")

    if not most:
        return together(rows)
    same = [rows[k].eqNullSafe(large[k]) for k in keys]
    hot = ordered.ranged(rows.join(large, same, "left_semi"), "v", 1 + most // part_rows).withColumnRenamed("__range", "part")
    done = checkpointed(solved(hot.withColumn("part", F.col("part").cast("long"))))
    for round_ in range(1_000_000):
        moves = checkpointed(_moves(done, keys, round_ >= MOVES))
        if moves.isEmpty():
            break
        m = moves.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("part").alias("__part"), "above", "to")
        on = [done[k].eqNullSafe(m[f"__{k}"]) for k in keys] + [done["part"] == m["__part"]]
        touched = done.join(m, on, "inner").withColumn("part", F.when(F.col("above").isNull() | (F.col("v") > F.col("above")), F.col("to")).otherwise(F.col("part")))
        again = solved(touched.select(*rows.columns, "part"))
        done = checkpointed(done.join(m, on, "left_anti").unionByName(again))
    return together(rows.join(large, same, "left_anti")).unionByName(done.select(*rows.columns, "gt", "used"))


def _moves(done: DataFrame, keys: list[str], join_all: bool) -> DataFrame:
    """Parts that meet: ``keys, part, above, to``; what of a part lies above a value (null: all) goes to another, or stays (``to`` its own) to be solved again.

    A row a part; the parts of a group are as many as its cuts.
    """
    parts = done.groupBy(*keys, "part").agg(
        F.min(F.when(F.col("target"), F.col("v"))).alias("first"), F.max(F.when(F.col("target"), F.col("v"))).alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("cut").alias("cut")
    )
    w = Window.partitionBy(*keys).orderBy("part")
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    # The boundary above a part is crossed by an interval of its side that reaches a target of the other.
    up = (F.max("hi").over(before) >= F.min("first").over(after)) | (F.min("lo").over(after) <= F.max("last").over(before))
    flagged = parts.withColumn("up", F.coalesce(up, F.lit(False))).withColumn("next", F.lead("part").over(w))
    flagged = flagged.withColumn("from", F.coalesce(F.lag("up").over(w), F.lit(False)))
    if join_all:
        start = F.max(F.when(~F.col("from"), F.col("part"))).over(before)
        return flagged.withColumn("to", start).filter("up OR `from`").select(*keys, "part", F.lit(None).cast("double").alias("above"), "to")
    whole = F.col("cut").isNull() | F.isnan("cut")
    to = F.when(F.col("up"), F.col("next")).otherwise(F.col("part"))
    above = F.when(F.col("up") & ~whole, F.col("cut"))
    return flagged.withColumn("to", to).withColumn("above", above).filter("up OR `from`").select(*keys, "part", "above", "to")
