"""Update logs, event logs and stores as tables (IO6-IO18)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYNC = "id string, device string, dim int, shard string, seq long, off long, mtime long, tombstone boolean, _corrupt_record string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; below a temporary folder only in local mode without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.TemporaryDirectory(prefix="notelake-index-")
        atexit.register(made.cleanup)
        root = made.name
    return f"{root.rstrip('/')}/notelake-{uuid.uuid4().hex}"


def write_sync_log(records: DataFrame, path: str, batch: int) -> None:
    """IO11: every flush is a new, numbered folder; a number is never used again."""
    records.write.mode("errorifexists").option("maxRecordsPerFile", 8_000).json(f"{path}/seq={batch:012d}")


def read_sync_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO12: (records, invalid lines): torn and malformed lines are set apart, not fatal."""
    rows = spark.read.schema(SYNC).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").json(path).cache()
    return rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record"), rows.where("_corrupt_record is not null or id is null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """IO14: entries of all devices; unreadable lines are skipped. The payload stays a JSON string."""
    lines = spark.read.text(path)
    e = lines.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.device").alias("device"), F.try_to_timestamp(F.get_json_object("value", "$.ts")).alias("ts"), F.col("value").alias("payload"))
    return e.where("type is not null and ts is not null")


def write_events(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("device", "day").json(path)


def commit(table: DataFrame, root: str, version: int) -> None:
    """IO7, IO17: a version is written whole beside the others, compressed; readers see it once its marker is there."""
    table.write.mode("overwrite").option("compression", "gzip").parquet(f"{root}/v={version}")
    table.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{root}/_versions")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """ST19: the newest committed version."""
    v = spark.read.schema("version long").json(f"{root}/_versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v={v}")


def by_ids(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """IO8."""
    return store.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """IO9."""
    return store.join(ids.select(key).distinct(), key, "left_anti")


def as_cli(results: DataFrame, query: str) -> DataFrame:
    """IO18: one JSON object of a page of results."""
    rows = results.agg(F.sort_array(F.collect_list(F.struct("rank", "note_path", "score"))).alias("results"))  # a page: at most a few dozen rows
    return rows.select(F.to_json(F.struct(F.lit(query).alias("query"), F.size("results").alias("count"), "results")).alias("json"))


def report(counts: list[tuple[str, dict]]) -> str:
    """IO16: a Markdown report of small roll-ups."""
    out = ["# Report"]
    for title, rows in counts:
        out += [f"\n## {title}", "| name | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in rows.items()]]
    return "\n".join(out)
