"""Streaming twins of batch operators over an event stream: bins with a watermark, and skipping what is done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def resampled(stream: DataFrame, time: str, value: str, freq: str, late: str) -> DataFrame:
    """Right-closed, right-labelled sums; rows later than ``late`` are dropped."""
    shifted = stream.withColumn("__t", F.col(time).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))
    bins = shifted.withWatermark("__t", late).groupBy(F.window("__t", freq)).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
    return bins.select(F.col("window.end").alias(time), value, "n")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Gaps(StatefulProcessor):
    """For each key the end of the last bin that came out; empty bins before the next one are made up."""

    def __init__(self, freq: str) -> None:
        self.step = pd.Timedelta(freq)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        bins = pd.concat(list(rows)).sort_values("bin_end")
        last = pd.Timestamp(self.last.get()[0], unit="us") if self.last.exists() else None
        for end, v, n in bins[["bin_end", "total", "n"]].itertuples(index=False):
            if last is not None and last + self.step < end:
                gaps = pd.date_range(last + self.step, end - self.step, freq=self.step)
                yield pd.DataFrame({"of_key": [key[0]] * len(gaps), "bin_end": gaps, "total": 0.0, "n": 0})
            yield pd.DataFrame({"of_key": [key[0]], "bin_end": [end], "total": [0.0 if pd.isna(v) else v], "n": [n]})
            last = end
        self.last.update((int(last.timestamp() * 1_000_000),))

    def close(self) -> None:
        pass


def resampled_with_gaps(stream: DataFrame, time: str, value: str, freq: str, late: str, by: str | None = None) -> DataFrame:
    """As ``resampled``, with a row of 0 for every empty bin between two others (of each ``by``), as the batch operator has.

    Bins are summed by window, spread over tasks, and come out once the watermark has passed them.  A
    second state, one time for each key, knows the last bin that came out; when the next one comes,
    the empty ones between go before it.  Bins come out in order of time, so a gap is final when it is seen;
    rows later than ``late`` are dropped by the first state alone.  A restart goes on from the checkpoint.
    """
    shifted = stream.withColumn("__t", F.col(time).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).withColumn("of_key", F.col(by) if by else F.lit(0))
    bins = shifted.withWatermark("__t", late).groupBy("of_key", F.window("__t", freq)).agg(F.sum(value).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the second state needs it
    ends = bins.select("of_key", F.window_time("window").alias("bin_at"), F.col("window.end").alias("bin_end"), "total", "n")
    schema = f"of_key {bins.schema['of_key'].dataType.simpleString()}, bin_end timestamp, total double, n long"
    out = ends.groupBy("of_key").transformWithStateInPandas(_Gaps(freq), schema, "Append", "None")
    named = [F.col("bin_end").alias(time), F.col("total").alias(value), F.col("n")]
    return out.select(*([F.col("of_key").alias(by)] if by else []), *named)


def first_seen(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Each key once, within the watermark: the streaming form of skipping processed keys."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """An exactly-once file sink; the checkpoint folder lets a lost query go on."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
