"""Structured Streaming over change events and the outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.rows import table
from wrenfold.operators.workflow import _CH, _WAKE, parsed_changes, raw_changes, wakes
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder
from wrenfold.sources.manifest import ManifestTable, read_table
from wrenfold.streaming.stateful import drained


def change_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of webhook rows; a trigger takes so many files (the flush size)."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw_changes(stream)


def follow(changes: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True) -> None:
    """The follow loop: each micro-batch of wakes goes to ``handle`` with its number; a repeated number is the same batch."""
    writer = wakes(parsed_changes(changes)).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start().awaitTermination()


def once_only(sent_path: str, send: Callable[[DataFrame], None], key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """A handler that records messages under their batch before it sends, and never sends one that is recorded: at most once."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = f"{sent_path}/batch={number}"
        path = spark._jvm.org.apache.hadoop.fs.Path(sent_path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(mine)):
            return  # recorded before: perhaps sent, so not again
        fresh = batch.dropDuplicates([key])
        if fs.exists(path):
            fresh = fresh.join(spark.read.parquet(sent_path).select(key), key, "left_anti")
        fresh.write.parquet(mine)
        send(spark.read.schema(fresh.schema).parquet(mine))

    return handle


def wake_counts(changes: DataFrame, window: str = "5 minutes", late: str = "2 hours") -> DataFrame:
    """Wakes per window of event time; later rows than the watermark allows are dropped by it."""
    rows = wakes(parsed_changes(changes)).withColumn("at", F.timestamp_micros(F.col("updated").cast("long"))).withWatermark("at", late)
    return rows.groupBy(F.window("at", window), "wake").agg(F.count(F.lit(1)).alias("n"))


@query("e05_stream_wakes", """SELECT wake, count(*) AS n FROM (SELECT CASE WHEN topic = 'thread' AND state = 'terminal' THEN 'learn' WHEN topic = 'outbox' AND state = 'pending' THEN 'send' WHEN topic = 'lead' AND state = 'pending' THEN 'work' END AS wake FROM
(SELECT event_id, CASE event_type WHEN 'view' THEN 'lead' WHEN 'click' THEN 'thread' WHEN 'purchase' THEN 'outbox' END AS topic, CASE WHEN value > 50 THEN 'terminal' ELSE 'pending' END AS state FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)) WHERE wake IS NOT NULL GROUP BY 1""")
def stream_wakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream drained once: its wakes land by micro-batch and are counted by kind."""
    found = wakes(parsed_changes(change_stream(spark, sf_dir)))
    out = work_folder(spark, "wakes")
    drained(found, out, work_folder(spark, "wakes-state"), "append")
    return spark.read.schema(found.schema).parquet(out).groupBy("wake").agg(F.count(F.lit(1)).alias("n"))


@query("e04_heartbeat_windows", f"SELECT epoch_us(ts) // 300000000 * 300 AS began_s, {_WAKE} AS wake, count(*) AS n FROM ({_CH}) WHERE verdict = 'event' AND {_WAKE} IS NOT NULL GROUP BY 1, 2")
def heartbeat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wakes in windows of five minutes, the interval of heartbeats.  Each micro-batch lands the windows that it changed; of a window the last, and highest, count holds, and the watermark ends its state."""
    found = wake_counts(change_stream(spark, sf_dir)).select(F.unix_seconds("window.start").alias("began_s"), "wake", "n")
    out = work_folder(spark, "beats")
    drained(found, out, work_folder(spark, "beats-state"))
    return spark.read.schema(found.schema).parquet(out).groupBy("began_s", "wake").agg(F.max("n").alias("n"))


@query("q08_outbox_sink", "SELECT event_id // 4 AS message_id, event_id FROM events WHERE event_type NOT IN ('error', 'purchase')")
def outbox_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox streamed into a manifest table, and once more after its checkpoint was lost: micro-batches that are there add nothing."""
    out = work_folder(spark, "outbox")
    spark.dataSource.register(ManifestTable)
    schema = table(spark, sf_dir, "events").schema
    for _ in range(2):
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).filter("event_type NOT IN ('error', 'purchase')").select(F.expr("event_id div 4").alias("message_id"), "event_id")
        sink = rows.writeStream.format("manifest_table").option("path", out).option("stream", "outbox").option("checkpointLocation", work_folder(spark, "outbox-state"))
        sink.trigger(availableNow=True).start().awaitTermination()
    return read_table(spark, out)
