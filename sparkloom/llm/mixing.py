"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target, its share of the mix in words.  Its documents are shuffled and queue up,
epoch after epoch; a document's virtual finish time is the words its source has given up to and with
it, divided by the source's target.  The mix is all queued documents in the order of these times, cut
where the words reach the budget, which is near time 1 for every source, whatever the sizes.

Spark's part.  Only ids, sizes and hashes move; ``carry`` names the columns that go along.  A source
is cut in slices of its shuffle order, so that a source of any size is summed by many tasks; the
slices' offsets are one row a source and slice.  The global order is a range partitioning by (time,
source, place), which splits ties; the ranges' offsets are one row a range.

Defined results.  A null text has size 0.  Documents of size 0 and sources without words are never
taken.  Sources are in the order of their code points, null last.  Repeated rows are documents of
their own.  The order is by a hash of id and text, so reruns and other partitionings give the same mix.
The last document is taken in part, so that the words taken are the budget.  A source is off its target by
a document of its own, or by its share of what the others are off.  Columns of the result
that clash with carried ones get underscores.  An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.shared import short_batches, text_bytes, unused, written
from sparkloom.operators import ordered

WEIGHTS = (3, 1, 2)
#: The mix has this share of all words; no source gives more than ``MOST_EPOCHS`` times its words.
SHARE, MOST_EPOCHS = 1.5, 2
SEED = 20
#: Slices of a source's shuffle order: a power of two, so that a slice is the leading bits of the hash.
SLICE_BITS = 10
#: Sources that one task numbers.
SOURCES_A_RANGE = 100_000


def n_words(text: bytes, block: int = 1 << 20) -> int:
    """The number of words of a text: stretches without the six blank characters, on which ``bytes.split`` splits as well."""
    if len(text) <= block:
        return len(text.split())
    found, blank = 0, True
    for at in range(0, len(text), block):  # a long text in parts, as the list of its words would take many times its size
        part = np.frombuffer(text, np.uint8, min(block, len(text) - at), at)
        blanks = np.concatenate([[blank], (part == 32) | ((part >= 9) & (part <= 13))])
        found, blank = found + int((blanks[:-1] & ~blanks[1:]).sum()), bool(blanks[-1])
    return found


def with_size(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """The text column in place by its number of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            size = pa.array([n_words(t) for t in text_bytes(rb, text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in rest] + [size], names=[*rest, out])

    short_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField(out, T.LongType())])
    return docs.select(*rest, text_col).mapInArrow(run, schema)


def source_key(source: Column) -> Column:
    """The source as text that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("-"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``key, source_size`` of each source with ``target``: the budget dealt by weight, no target over ``most`` times the size.

    In rounds: what sources at their bound cannot take goes to the others by weight, until none is above.
    All others share one level (words a weight), so a round is one aggregate.
    """
    count = sizes.count()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = ordered.numbered(sizes, ["key"], "place", 1 + count // SOURCES_A_RANGE).select("key", "source_size", weight.alias("weight"))
    rows = rows.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    rows = written(rows.withColumn("level", F.col("bound") / F.col("weight")), "mix-weights")
    level, before = -1.0, None
    while level != before:
        full, before = F.col("level") <= F.lit(level), level
        sums = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        left = sums.size * float(share) - sums.used
        level = max(level, left / sums.weight) if sums.weight else level
    dealt = F.lit(left) * F.col("weight") / F.lit(sums.weight or 1.0)
    return rows.select("key", "source_size", F.when(F.col("level") <= level, F.col("bound")).otherwise(F.least(dealt, F.col("bound"))).alias("target"))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (), seed: int = SEED, **shares: object) -> DataFrame:
    """A row a document: ``id, key`` (of the source), ``size, source_size, target, place`` in its source's shuffle order, ``given`` (words up to and with it), and a struct ``carried``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"),
        source_key(F.col(source_col)).alias("key"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(text))).alias("shuffled"),
        text.alias("text"),
        F.struct(*[F.col(c) for c in carry], F.lit(0).alias("__")).alias("carried"),
    )
    bits = F.conv(F.substring("shuffled", 1, 5), 16, 10).cast("int")
    sized = written(with_size(sized, "text", "size").withColumn("slice", F.shiftright(bits, 20 - SLICE_BITS)), "mix-sized")
    slices = written(sized.groupBy("key", "slice").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "mix-slices")
    goals = targets(slices.groupBy("key").agg(F.sum("words").alias("source_size")), **shares)
    w = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select("key", "slice", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in ("words", "rows")]).join(goals, "key")
    # Source and slice are the key of the join and of the window, so a source of any size is spread.
    own = Window.partitionBy("key", "slice").orderBy("shuffled", "size").rowsBetween(Window.unboundedPreceding, 0)
    return sized.join(before, ["key", "slice"]).select(
        "id", "key", "size", "source_size", "target", "carried",
        (F.row_number().over(own) + F.col("rows_before")).alias("place"),
        (F.sum("size").over(own) + F.col("words_before")).alias("given"),
    )


def queue(scheduled: DataFrame, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """All documents of all epochs in global order, with ``finish`` (virtual time), ``start`` (words before it in the order) and ``words`` (taken of it)."""
    finish = F.try_divide(F.col("given") + F.col("epoch") * F.col("source_size"), F.col("target"))
    entries = scheduled.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(most)])))
    entries = entries.filter((F.col("size") > 0) | (F.col("epoch") == 0))  # a document without words is listed, not mixed
    order = ["finish", "key", "place", "epoch"]
    ranges = int(scheduled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.withColumn("finish", finish).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "mix-queue")
    sums = written(dealt.groupBy("range").agg(F.sum("size").alias("words"), F.sum(F.when(F.col("epoch") == 0, F.col("size"))).alias("once")), "mix-ranges")
    budget = int((sums.agg(F.sum("once")).first()[0] or 0) * min(float(share), most))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("before"))  # a row a range
    own = Window.partitionBy("range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(own), F.lit(0)) + F.col("before")
    placed = dealt.join(F.broadcast(before), "range").withColumn("start", start)
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(budget) - F.col("start")))
    return placed.withColumn("words", words)


def _queued(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: Sequence[str], options: dict) -> DataFrame:
    bounds = {k: v for k, v in options.items() if k in ("share", "most")}
    return queue(schedule(docs, id_col, text_col, source_col, carry, **options), **bounds)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (), **options: object) -> DataFrame:
    """The mix: ``id_col``, the carried columns, ``epoch, finish, start, words``; ``start`` is its order.  Options: ``weights, share, most, seed``."""
    rows = _queued(docs, id_col, text_col, source_col, carry, options).filter("words > 0")
    made, carry = ("epoch", "finish", "start", "words"), [c for c in carry if c != id_col]
    own = [F.col(c).alias(name) for c, name in zip(made, unused([id_col, *carry], *made))]
    return rows.select(F.col("id").alias(id_col), *[F.col("carried")[c].alias(c) for c in carry], *own)


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """A row a document: its id, ``size, source_size, target, taken`` (words that the mix takes, repeats counted)."""
    rows = _queued(docs, id_col, text_col, source_col, (), options)
    one = rows.groupBy("key", "place").agg(*[F.first(c).alias(c) for c in ("id", "size", "source_size", "target")], F.sum("words").alias("taken"))
    return one.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")
