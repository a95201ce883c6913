"""Running a streaming computation over files to the end, with a result that survives retries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.session import work_path

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

CLOSING = "closing"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event file as a stream, its time an event-time TIMESTAMP."""
    stream = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def closed_event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events and, two days after the last of them, two events of a source of their own, one just before noon and one
    at noon. They carry the watermark past every window of the real events, so a drained stream emits all of them; their
    own windows stay open and are never emitted."""
    schema = spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/{name}")
    day = F.date_trunc("day", F.max("ts")) + F.expr("INTERVAL 2 DAYS")
    late = schema.agg(day.alias("day")).where("day is not null").select(F.explode(F.array(*[F.col("day") + F.expr(f"INTERVAL {m} MINUTES") for m in (715, 720)])).alias("ts"))
    path = work_path(spark, "closing")
    late.select(
        F.lit(-1).cast("bigint").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("user_id"),
        F.lit(CLOSING).alias("event_type"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("props"),
    ).coalesce(1).write.parquet(path)
    closing = spark.readStream.schema(EVENT_SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return event_stream(spark, folder, name).unionByName(closing)


def run_until_silent(stream: DataFrame, label: str, sources: int, seconds: int = 300) -> DataFrame:
    """Run a stream with processing-time timers until `sources` rows without a `next_us` have come, and return its rows.

    Such a stream has no end of its own: its timers fire in batches without input. The newest batch of a repeated id wins.
    """
    spark = stream.sparkSession
    path = work_path(spark, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={batch_id}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/table/batch=-1")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # timers live in a store that keeps them sorted
    try:
        query = (
            stream.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime="500 milliseconds").start()
        )
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    found = spark.read.schema(stream.schema)
    try:
        until = time.monotonic() + seconds
        while sources and found.parquet(f"{path}/table/*").where("next_us is null").count() < sources:
            if not query.isActive or time.monotonic() > until:
                raise RuntimeError(f"stream ended before all sources fell silent: {query.exception()}")
            query.awaitTermination(1)
    finally:
        query.stop()
    return found.parquet(f"{path}/table/*")


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain an append-mode stream into a table below the shared folder and return it."""
    spark = stream.sparkSession
    path = work_path(spark, label)
    query = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_updates(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Drain an update-mode stream and return the newest row per key.

    Every batch lands under its id, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    path = work_path(spark, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/table/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    saved = spark.read.parquet(f"{path}/table")
    newest = saved.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
