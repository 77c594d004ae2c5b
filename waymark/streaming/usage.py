"""Streams: usage by day and provider, sessions, and records that no earlier batch has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import resolve


def usage(events: DataFrame, ts: str, provider: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Calls by window and provider; rows later than the watermark are dropped by the engine."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counted = stamped.groupBy(F.window("__ts", size), F.col(provider).alias("provider")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.select(F.col("window.start").alias("start"), "provider", "calls")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of a key's events with gaps under the given one."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    run = stamped.groupBy(F.session_window("__ts", gap), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_events"))
    return run.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def keep_new(records: DataFrame, known_path: str, checkpoint: str, id_col: str = "seq") -> StreamingQuery:
    """Appends to known_path, batch by batch, the records none of whose keys is known.

    A batch writes its own folder, overwritten if the batch is retried, so a
    restart after a lost driver neither loses nor repeats records.
    """
    spark = records.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        try:
            known = spark.read.parquet(known_path).where(F.col("batch") < number)
            fresh = resolve.new_records(batch, known.drop("batch"), id_col)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            fresh = batch
        once = resolve.merge_connected(fresh, id_col)[0].select(id_col)
        fresh.join(once, id_col, "left_semi").write.mode("overwrite").parquet(f"{known_path}/batch={number}")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
