"""The run log as a stream: final records are kept once per key, rates come by window of event time. Results go to tables in the shared folder, never to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import new_path

#: The same results by DuckDB over the whole table.
ORACLE = """
    SELECT call_id, count(*) AS records, min(event_id) AS first_id, max(event_id) AS last_id FROM
      (SELECT concat(CAST(user_id AS STRING), '-', event_type) AS call_id, event_id FROM events WHERE event_type <> 'error') t
    GROUP BY call_id"""
RATES_ORACLE = """
    WITH t AS (SELECT date_trunc('hour', ts) AS start_, event_type, value FROM events), last_ AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
    SELECT epoch_us(start_) AS start_us, event_type, count(*) AS n, round(avg(value), 6) + 0e0 AS mean FROM t, last_ WHERE start_ + INTERVAL 1 HOUR <= mark GROUP BY start_, event_type"""


def final_stream(events: DataFrame) -> DataFrame:
    """Final records of a streaming (or batch) log: retries left out, one row per key."""
    final = events.where("event_type <> 'error'").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("call_id"), "event_id")
    return final.groupBy("call_id").agg(F.count("*").alias("records"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def windowed_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Records and their mean value by window of event time, with a watermark for late ones."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def latest(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Drain what is available of an aggregated stream: each batch writes the rows it changed, and the last row of a key is its result.

    With a ``folder`` of one's own, its checkpoint and changes stay: the next call, of this
    driver or of a later one, reads only files that came since, and goes on from the state that was kept.
    ``_read`` of the result is the number of rows that this call read.
    """
    spark = stream.sparkSession
    path, checkpoint = (f"{folder}/changes", f"{folder}/checkpoint") if folder else (new_path(spark, "changes"), new_path(spark, "checkpoint"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again replaces its rows

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/batch=*")
    values = [c for c in stream.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
    out._read = sum(p.numInputRows for p in q.recentProgress)
    return out


def closed_windows(stream: DataFrame) -> DataFrame:
    """Drain a windowed stream into a Parquet sink: windows that the watermark has closed, each written once."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "windows")
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def stream_final_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file stream of events, drained; equal to the batch query over the same rows."""
    return latest(final_stream(_events(spark, sf_dir)), ["call_id"])


def stream_window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rates of the stream, of the windows that the watermark has closed."""
    t = closed_windows(windowed_rates(_events(spark, sf_dir)))
    return t.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))
