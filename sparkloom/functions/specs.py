"""Deep merge of JSON specifications, as entries by path.

A specification is its leaves: ``id, path, value``.  A path is the keys from the root on, each escaped as
in a JSON pointer; a value is JSON text.  Lists, numbers, strings and null are leaves, and so is an
object without keys.  Merging is then a matter of joins: no document is rebuilt on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import safe_unions

#: Levels of objects that are opened; what lies deeper stays as it is, a leaf.
MOST_LEVELS = 64


def _step(key: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def leaves(df: DataFrame, id_col: str, json_col: str, most_levels: int = MOST_LEVELS) -> DataFrame:
    """The leaves of each row's JSON text; text that does not parse, and null, has none.

    One round a level of the deepest row: each opens the objects of the level before.
    """
    safe_unions(df.sparkSession)
    level = df.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.try_parse_json(F.col(json_col)).alias("v")).filter("v IS NOT NULL")
    found = None
    for depth in range(most_levels + 1):
        keys = F.json_object_keys(F.to_json("v"))
        opened = level.select("id", "path", "v", keys.alias("keys"))
        inner = F.size("keys") > 0
        done = opened.filter(~F.coalesce(inner, F.lit(False)) if depth < most_levels else F.lit(True)).select("id", "path", F.to_json("v").alias("value"))
        found = done if found is None else found.unionByName(done)
        deeper = opened.filter(inner)
        if depth == most_levels or deeper.isEmpty():
            break
        entries = F.from_json(F.to_json("v"), "map<string,variant>")
        level = deeper.select("id", "path", F.explode(entries).alias("key", "v")).select("id", F.concat("path", _step(F.col("key"))).alias("path"), "v")
    return found


def _above(path: Column) -> Column:
    """The paths of all objects a path lies in, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def deep_merge(base: DataFrame, override: DataFrame) -> DataFrame:
    """The leaves of each id's merged specification: objects are merged key by key, of all else the override wins.

    A leaf of the base goes where the override has a value at its path, above it (unless an empty
    object, which adds nothing) or below it.  An empty object of the override counts only where the base has no object.
    """
    safe_unions(base.sparkSession)
    empty = F.col("value") == "{}"
    solid = override.filter(~empty).select("id", F.col("path").alias("at"))
    under = solid.select("id", F.explode(F.when(F.col("at") != "", _above(F.col("at")))).alias("path")).distinct()
    wide = base.select("id", "path", "value", F.when(F.col("path") != "", _above(F.col("path"))).alias("above"))
    beaten = wide.select("id", "path", F.explode(F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("path"))).alias("at")).join(solid, ["id", "at"], "left_semi").select("id", "path").distinct()
    kept = base.join(beaten, ["id", "path"], "left_anti").join(under, ["id", "path"], "left_anti")
    # An empty object of the override takes the place of a leaf, and is nothing where the base has an object, empty or not.
    objects = wide.select("id", F.explode(F.coalesce("above", F.array().cast("array<string>"))).alias("path")).unionByName(base.filter(empty).select("id", "path")).distinct()
    hollow = override.filter(empty).join(objects, ["id", "path"], "left_anti")
    kept = kept.join(hollow.select("id", "path"), ["id", "path"], "left_anti")
    taken = kept.select("id", "path", "value")
    inside = taken.select("id", F.col("path").alias("at"))
    # Above a new empty object there may be a leaf of the base.
    blocked = hollow.select("id", F.explode(F.when(F.col("path") != "", _above(F.col("path")))).alias("at")).join(inside, ["id", "at"], "left_semi").distinct()
    taken = taken.join(blocked.withColumnRenamed("at", "path"), ["id", "path"], "left_anti")
    return taken.unionByName(override.filter(~empty).select("id", "path", "value")).unionByName(hollow.select("id", "path", "value"))
