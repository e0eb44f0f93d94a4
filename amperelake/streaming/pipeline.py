"""Streams over files of telemetry: duplicates, minute aggregates, per-vehicle state, idempotent writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperelake.common import cut, scratch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def telemetry_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files under `path` (a file or a folder); files per trigger bound what a batch takes in."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path + "*")


def without_repeats(stream: DataFrame, within: str = "10 minutes") -> DataFrame:
    """The first arrival of each (vin, seq); repeats are recognised while the ingest clock is within `within` of it."""
    s = stream.withColumn("_ingest", F.timestamp_millis("ts_ingest_ms")).withWatermark("_ingest", within)
    return s.dropDuplicatesWithinWatermark(["vin", "seq"]).drop("_ingest")


def corrected_minutes(stream: DataFrame, path: str) -> DataFrame:
    """Minute aggregates of what `stream` delivers, published at once and corrected by later batches until the cut-off:
    each batch goes through a `SeenStore`, which keeps first arrivals only, into a `MinuteStore`. Both are under `path`
    and know which batches they have, so a batch that is run again after a crash changes nothing. Nothing waits for a
    watermark, so the last minutes are there too. Returns the minutes as they stand.
    """
    from amperelake.operators import late, seen

    spark = stream.sparkSession
    known, store = seen.SeenStore(spark, f"{path}/seen"), late.MinuteStore(spark, f"{path}/minutes")

    def write(batch, n):
        batch = cut(batch.select("vin", "seq", "log_offset", "ts_event_ms", "ts_ingest_ms", *late.INPUT))
        store.apply(seen.kept_rows(batch, known.apply(batch, n).kept), n)

    each_batch(stream, write, f"{path}/checkpoint")
    return store.minutes()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read back what it wrote; each batch replaces its own folder, so a batch that
    is run again leaves no second copy."""
    spark = stream.sparkSession
    base = scratch(spark)
    names = stream.schema
    each_batch(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/checkpoint", mode)
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out").getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")):
        return spark.createDataFrame([], names)
    return spark.read.schema(names).parquet(f"{base}/out/batch=*")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """`write(batch, id)` for every batch there is now; `write` must give the same result when it gets an id again."""
    spark = stream.sparkSession
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if had is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def upsert(now: DataFrame | None, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A table of newest rows per key after a batch: a merge for sinks that hold the live state of each vehicle."""
    from amperelake.operators.registry import latest

    return latest(batch if now is None else now.unionByName(batch), key, order)
