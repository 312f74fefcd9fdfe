"""Change detection, update logs and their upkeep (ST1-ST20, IO6-IO17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(files: DataFrame, live: DataFrame, version: str) -> DataFrame:
    """ST1-ST2: ``(note_path, state)``: dirty, clean or deleted.

    ``files`` (note_path, mtime, hash, failed_version), ``live`` (note_path, mtime, hash).
    """
    f = files.select("note_path", F.col("mtime").alias("m0"), F.col("hash").alias("h0"), F.col("failed_version").alias("v0"), F.lit(True).alias("had"))
    both = f.join(live.select("note_path", "mtime", "hash", F.lit(True).alias("has")), "note_path", "full")
    state = (
        F.when(F.col("has").isNull(), "deleted")
        .when(F.col("had").isNull(), "dirty")
        .when(F.col("v0").isNotNull() & (F.col("v0") != version), "dirty")
        .when(F.col("m0") == F.col("mtime"), "clean")
        .when(F.col("h0").isNull(), "dirty")
        .when(F.col("h0") == F.col("hash"), "clean")
        .otherwise("dirty")
    )
    return both.select("note_path", state.alias("state"))


def chunk_lanes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ST3: per chunk what must be done; both sides (chunk_id, meta_hash, row_hash)."""
    o = old.select("chunk_id", F.col("meta_hash").alias("m0"), F.col("row_hash").alias("r0"))
    n = new.select("chunk_id", F.col("meta_hash").alias("m1"), F.col("row_hash").alias("r1"))
    lane = F.when(F.col("m1").isNull(), "remove").when(F.col("m0").isNull(), "embed").when(F.col("r0") != F.col("r1"), "reindex").when(F.col("m0") != F.col("m1"), "patch").otherwise("keep")
    return o.join(n, "chunk_id", "full").select("chunk_id", lane.alias("lane"))


def apply(table: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """ST4: removals first, then additions, each id once; live ids win over added ones."""
    left = table.join(removed.select("chunk_id").distinct(), "chunk_id", "left_anti")
    fresh = added.dropDuplicates(["chunk_id"]).join(left.select("chunk_id"), "chunk_id", "left_anti")
    return left.unionByName(fresh)


def needs_compaction(rows: DataFrame, share: float = 0.25) -> DataFrame:
    """ST5."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("tombstone").cast("long")).alias("dead")).select("n", "dead", (F.col("dead") >= share * F.col("n")).alias("rebuild"))


def incoherent(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST6: ids that stand on one side only."""
    return a.select("chunk_id").join(b.select("chunk_id"), "chunk_id", "left_anti").withColumn("missing_in", F.lit("b")).unionByName(b.select("chunk_id").join(a.select("chunk_id"), "chunk_id", "left_anti").withColumn("missing_in", F.lit("a")))


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """ST7: vectors of equal embedding inputs are taken over, whatever their chunk was called."""
    digest = lambda d: d.withColumn("input_hash", F.sha2("embed_input", 256))
    kept = digest(old).groupBy("input_hash").agg(F.max_by("vector", "chunk_id").alias("vector"))
    return digest(new).join(kept, "input_hash", "left").drop("input_hash")


def resolve(log: DataFrame) -> DataFrame:
    """ST8: the record that holds for each id.

    Within a device the latest by mtime (a tombstone wins a tie, then seq, then
    off); across devices the latest live one, the larger device on a tie.
    """
    own = log.groupBy("id", "device").agg(F.max_by(F.struct("mtime", "tombstone", "seq", "off"), F.struct("mtime", "tombstone", "seq", "off")).alias("r")).select("id", "device", "r.*")
    return own.where("not tombstone").groupBy("id").agg(F.max(F.struct("mtime", "device", "seq", "off")).alias("r")).select("id", "r.*")


def hydrate(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """ST9, JN5-JN6: notes all of whose chunks the log has."""
    met = notes.join(resolved.select(F.col("id").alias("chunk_id"), F.lit(True).alias("have")), "chunk_id", "left")
    return met.groupBy("note_path").agg(F.count("*").alias("n_chunks"), F.bool_and(F.coalesce("have", F.lit(False))).alias("complete")).where("complete").select("note_path", "n_chunks")


def rank_producers(metas: DataFrame, expect: dict, own_version: int) -> DataFrame:
    """ST10: accepted devices, newest full index first, those without one last; and whether one is ahead of us."""
    ok = F.lit(True)
    for k, v in expect.items():
        ok = ok & (F.col(k) == F.lit(v))
    ahead = metas.agg(F.coalesce(F.bool_or(F.col("chunker_version") > own_version), F.lit(False)).alias("peer_ahead"))
    return metas.where(ok).crossJoin(F.broadcast(ahead)).orderBy(F.desc_nulls_last("last_full"), F.asc("device"))  # one row


def compact_log(log: DataFrame, live: DataFrame, least_bytes: int = 2 << 20, dead_share: float = 0.5) -> tuple[DataFrame, bool]:
    """ST11: the log without dead ids, if it is large and dead enough to be worth it."""
    kept = log.join(live.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    size = log.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    worth = (size.b or 0) >= least_bytes and (size.n - kept.count()) >= dead_share * size.n
    return (kept if worth else log), worth


def small_shards(shards: DataFrame, least: int = 16, below: int = 256 << 10) -> DataFrame:
    """ST12: devices whose small shards are enough to be folded into one."""
    return shards.where(F.col("bytes") < below).groupBy("device").agg(F.count("*").alias("n_small"), F.sum("bytes").alias("bytes")).where(F.col("n_small") >= least)


def signature(files: DataFrame) -> DataFrame:
    """ST13: changes when any file of the directory does."""
    return files.agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum("bytes"), F.max("mtime"), F.sum(F.xxhash64("name", "bytes", "mtime").cast("decimal(38,0)"))), 256).alias("signature"))


def should_reconcile(live: str, kept: str | None, empty: bool) -> bool:
    return empty or live != kept


def may_stamp(mode: str, store_was_empty: bool) -> bool:
    """ST16."""
    return mode == "full" or store_was_empty


def drift(now: float, last_warm: float, cooldown: float) -> dict[str, bool]:
    """ST18: always invalidate; warm again only after the cool-down."""
    return {"invalidate": True, "warm": now - last_warm >= cooldown}


def record_crc(q: Column, scale: Column, sign: Column) -> Column:
    """IO13: CRC of a record's bytes."""
    return F.crc32(F.concat_ws("|", F.array_join(q.cast("array<string>"), ","), scale.cast("string"), F.array_join(sign.cast("array<string>"), ",")).cast("binary"))


def valid_records(records: DataFrame) -> DataFrame:
    return records.where(record_crc(F.col("q"), F.col("scale"), F.col("sign")) == F.col("crc"))


def store_sizes(**stores: DataFrame) -> DataFrame:
    """IO10: rows and logical bytes of each store."""
    out = None
    for name, d in stores.items():
        row = d.agg(F.lit(name).alias("store"), F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*d.columns)))), F.lit(0)).cast("long").alias("bytes")).select("store", "n", "bytes")
        out = row if out is None else out.unionByName(row)
    return out


def retained_devices(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """IO15: entries of devices that have written within the last ``days``."""
    last = log.groupBy("device").agg(F.max("ts").alias("last")).where(F.col("last") >= now - F.make_dt_interval(F.lit(days)))
    return log.join(last.select("device"), "device", "left_semi")


def keep_tail(log: DataFrame, keep: int = 512 << 10, limit: int = 1 << 20) -> DataFrame:
    """IO15: once a device's log passes ``limit`` bytes, its newest ``keep`` bytes stay."""
    w = Window.partitionBy("device").orderBy(F.desc("ts"), F.desc("event_id"))
    sized = log.withColumn("_after", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("bytes").over(Window.partitionBy("device")))
    return sized.where((F.col("_all") <= limit) | (F.col("_after") <= keep)).drop("_after", "_all")
