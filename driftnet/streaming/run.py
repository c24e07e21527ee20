"""Runs of streams: sources over the stored tables and sinks for results and rejects."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from driftnet.session import ensure_shared_folder

#: State that grows with the stream lies on disk, and a batch writes what it adds to it, not all of
#: it. Bounded: what an executor holds of it in memory, and the versions kept of a run that is never resumed.
STATE = "spark.sql.streaming.stateStore"
STATE_ON_DISK = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE}.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A stored table, one file or a folder of them, as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern, since the source takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_folder(spark: SparkSession) -> str:
    """A new folder for what a stream leaves, where all executors see it."""
    return f"{ensure_shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """All that a stream gives until its source is read, by way of the shared folder. The
    settings hold for this stream only."""
    spark, folder = stream.sparkSession, stream_folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    finally:  # a stream that has begun has a session of its own
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", T.IntegerType())).parquet(f"{folder}/out")


def to_sinks(stream: DataFrame, accepted: Column, on_result: Callable[[DataFrame], None], on_error: Callable[[DataFrame], None], log: str):
    """Starts a query that hands the accepted rows of each micro-batch to one sink
    and the others (rejected or null) to another. Each batch is read twice."""

    def both(batch: DataFrame, _: int) -> None:
        marked = batch.withColumn("__ok", accepted)
        on_result(marked.where("__ok").drop("__ok"))
        on_error(marked.where("not coalesce(__ok, false)").drop("__ok"))

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", log).trigger(availableNow=True).start()
