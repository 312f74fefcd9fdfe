"""Streams of file changes and of events (ST4, ST13-ST15, ST20)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_changes(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST15: a path and hash once within the watermark; restamps alone do not count."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["note_path", "hash"])


def search_sessions(events: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """ST14: a user's searches with pauses below ``gap``."""
    own = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def batch_sessions(events: DataFrame, gap_seconds: int = 600) -> DataFrame:
    """The same sessions over a finished log, by lag and running sum."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= gap_seconds * 1_000_000) | F.lag("ts").over(w).isNull()
    marked = events.withColumn("s", F.sum(new.cast("int")).over(w))
    return marked.groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("s")


def drain(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files_per_burst: int = 50) -> StreamingQuery:
    """ST20: work off all that is there in bursts; what was committed decides where the next run begins."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_burst).parquet(source)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_sink(root: str, key: str = "note_path") -> Callable[[DataFrame, int], None]:
    """ST4: merge each burst into the newest version and commit the next; a repeated burst changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        from notelake.sources import logs

        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max(F.struct("ts", *[c for c in batch.columns if c not in (key, "ts")])).alias("r")).select(key, "r.*")
        try:
            old = logs.latest(spark, root)
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        merged = newest if old is None else old.join(newest.select(key), key, "left_anti").unionByName(newest)
        logs.commit(merged, root, number)

    return run
