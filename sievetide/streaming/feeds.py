"""Structured Streaming over item events: windows, sessions, change feeds, deduplication and active jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..tables import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of one table in a folder as a stream. ts without a zone is cast: watermarks need one."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet") if single else spark.readStream.schema(schema)
    return reader.parquet(folder if single else path).withColumn("ts", F.col("ts").cast("timestamp"))


def collected(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and gives its result as a table in the shared folder, which also holds the stream's own checkpoint.

    Each batch writes a folder of its own, or in complete mode the one result, so a batch that is repeated changes nothing.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/epoch={0 if mode == 'complete' else epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")


def tumbling(stream: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, width: str, step: str, late: str, *keys: str) -> DataFrame:
    w = F.window("ts", width, step)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Sessions of a key that end after a gap; on a stream or on a table."""
    out = events.withWatermark("ts", gap) if events.isStreaming else events
    w = F.session_window("ts", gap)
    return out.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def once_per_key(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def on_change(stream: DataFrame, key: str, column: str) -> DataFrame:
    """Events that change their key's value, by state for each key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        before = rows[column].shift(1)
        before.iloc[0] = last
        yield rows[rows[column] != before][["event_id", key, column]]
        state.update((rows[column].iloc[-1],))

    return stream.groupBy(key).applyInPandasWithState(step, f"event_id long, {key} long, {column} string", "last string", "append", GroupStateTimeout.NoTimeout)


def snapshot_feed(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], seconds: float | None = 1.5):
    """Emits the whole aggregate whenever it differs from the one before, every so many seconds, or once over what there is (seconds None).

    The snapshots are compared by one number, an order-free sum of row hashes with the count; no row comes to the driver.
    """
    last: list = [None]

    def batch(df: DataFrame, epoch: int) -> None:
        sign = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        if sign != last[0]:
            last[0] = sign
            emit(df, epoch)

    folder = f"{shared_folder(stream.sparkSession)}/feed-{uuid.uuid4().hex}"
    writer = aggregate(stream).writeStream.outputMode("complete").option("checkpointLocation", folder).foreachBatch(batch)
    return writer.trigger(**({"availableNow": True} if seconds is None else {"processingTime": f"{int(seconds * 1000)} milliseconds"})).start()
