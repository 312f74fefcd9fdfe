"""Roll-ups of the event log (LG1-LG14)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, by: list[str], value: str, **quantiles: float) -> DataFrame:
    """The value at index floor(q (n - 1)) of each group, by a window: no group is collected."""
    w = Window.partitionBy(*by).orderBy(value)
    placed = rows.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    return placed.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == F.floor(q * (F.col("_n") - 1)), F.col(value))).alias(name) for name, q in quantiles.items()])


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """LG1."""
    plain = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return plain.join(nearest_rank(rows, by, value, p50=0.5, p95=0.95), by)


def stalls(rows: DataFrame) -> DataFrame:
    """LG2: by context."""
    return rows.groupBy("context").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def idle_frames(rows: DataFrame) -> DataFrame:
    """LG3: idle stalls by frame."""
    return rows.where("context = 'idle'").groupBy(F.coalesce("frame", F.lit("unknown")).alias("frame")).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))


def patches(rows: DataFrame, by: str) -> DataFrame:
    """LG4: share applied, p95 at floor(0.95 n), slowest, distinct reasons."""
    w = Window.partitionBy(by).orderBy("duration_ms")
    placed = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    at = F.least(F.floor(F.col("_n") * 0.95), F.col("_n") - 1)
    return placed.groupBy(by).agg(F.avg(F.col("applied").cast("double")).alias("applied"), F.max(F.when(F.col("_i") == at, F.col("duration_ms"))).alias("p95_ms"), F.max("duration_ms").alias("max_ms"), F.countDistinct("reason").alias("n_reasons"))


def latest_by_type(rows: DataFrame, caps: DataFrame, default: int = 50) -> DataFrame:
    """LG5: the newest entries of each type, as many as its cap says."""
    w = Window.partitionBy("type").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("_k", F.row_number().over(w)).join(F.broadcast(caps), "type", "left").where(F.col("_k") <= F.coalesce("cap", F.lit(default))).drop("_k", "cap")


def device_counts(rows: DataFrame) -> DataFrame:
    """LG6."""
    return rows.groupBy("device").agg(F.count("*").alias("n"))


def error_milestones(rows: DataFrame) -> DataFrame:
    """LG7: of each message the first, second, fourth, eighth ... occurrence."""
    w = Window.partitionBy("message").orderBy("ts", "event_id")
    return rows.withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k").bitwiseAND(F.col("k") - 1) == 0)


def gaps(rows: DataFrame, by: str) -> DataFrame:
    """LG8, first part: time since the entry before."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    return rows.withColumn("gap_s", F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)))


def find_period(starts: list[float], durations: list[float]) -> dict | None:
    """LG8: the longest run of four or more heavy stalls whose gaps all lie close to the run's mean gap."""
    floor = max([1000.0, *(d / 2 for d in durations)])
    heavy = sorted((s, d) for s, d in zip(starts, durations, strict=True) if d >= floor)
    steps = [b[0] - a[0] for a, b in zip(heavy, heavy[1:], strict=False)]
    best = None
    for i in range(len(steps)):
        total, low, high = 0.0, steps[i], steps[i]
        for j in range(i, len(steps)):
            total, low, high = total + steps[j], min(low, steps[j]), max(high, steps[j])
            mean = total / (j - i + 1)
            jitter = max(high - mean, mean - low)
            if jitter > max(250.0, 0.02 * mean):
                break
            if best is None or j - i + 1 > best[1]:
                best = (i, j - i + 1, mean, jitter)
    if best is None or best[1] < 3:
        return None
    first, n, mean, jitter = best
    return {"n": n + 1, "period_ms": mean, "jitter_ms": jitter, "median_ms": sorted(d for _, d in heavy[first : first + n + 1])[(n + 1) // 2]}


def periodic_stalls(rows: DataFrame, by: str) -> DataFrame:
    """LG8 for each device's session; only its heavy stalls, which are few, come together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = find_period(pdf["start_ms"].tolist(), pdf["duration_ms"].tolist())
        return pd.DataFrame([{by: pdf[by].iloc[0], **found}] if found else [], columns=[by, "n", "period_ms", "jitter_ms", "median_ms"])

    kind = rows.schema[by].dataType.simpleString()
    worst = rows.groupBy(by).agg(F.max("duration_ms").alias("worst"))
    heavy = rows.join(worst, by).where(F.col("duration_ms") >= F.greatest(F.lit(1000.0), F.col("worst") / 2)).drop("worst")
    return heavy.groupBy(by).applyInPandas(run, f"{by} {kind}, n long, period_ms double, jitter_ms double, median_ms double")


def attribute(tasks: DataFrame, spans: DataFrame, bucket: int = 60_000) -> DataFrame:
    """LG9, JN8: the span that overlaps a task most, the later start on a tie, else ``idle``.

    Tasks (task_id, start, end) and spans (context, start, end; a null end is
    open) meet on time buckets; an open span reaches to the last task's end.
    """
    last = tasks.agg(F.max("end").alias("last"))
    closed = spans.crossJoin(F.broadcast(last)).select("context", F.col("start").alias("s"), F.coalesce("end", "last").alias("e"))  # one row
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(b), F.col(a)) / bucket)))
    left = tasks.withColumn("b", buckets("start", "end"))
    met = left.join(closed.withColumn("b", buckets("s", "e")), "b").select("task_id", "start", "end", "context", "s", "e").distinct()
    overlap = F.least("end", "e") - F.greatest("start", "s")
    best = met.where(overlap > 0).groupBy("task_id").agg(F.max(F.struct(overlap.alias("o"), F.col("s").alias("s"), F.col("context").alias("c"))).alias("x"))
    return tasks.join(best, "task_id", "left").select("task_id", F.coalesce("x.c", F.lit("idle")).alias("context"))


def crash_verdict(beats: DataFrame, by: str) -> DataFrame:
    """LG10: the last beat that is no visibility change, and the last visibility."""
    seen = F.col("type") == "visibility"
    return beats.groupBy(by).agg(F.max_by("type", F.when(~seen, F.struct("ts", "event_id"))).alias("last_type"), F.max_by("detail", F.when(seen, F.struct("ts", "event_id"))).alias("visibility"))


def stable_token(value: Column, salt: str, kind: str = "path") -> Column:
    """LG11: the same value, the same token; nothing of the value shows."""
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 10))


def query_shape(query: Column) -> Column:
    """LG11: a query's length and number of words."""
    return F.concat(F.length(query).cast("string"), F.lit("/"), F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")).cast("string"))


def scrub_paths(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\s\"']*/[^\s\"']+", "<path>")


def clicks(searches: DataFrame, clicked: DataFrame) -> DataFrame:
    """LG12: searches with their clicks."""
    return searches.join(clicked, "search_id", "left").groupBy("search_id").agg(F.count("rank").alias("n_clicks"), F.min("rank").alias("best_rank"))


def percent(done: Column, total: Column, step: int = 5) -> Column:
    """LG13."""
    return F.when(total > 0, F.floor(100.0 * done / total / step) * step).otherwise(0).cast("long")


def index_rates(passes: DataFrame, by: list[str]) -> DataFrame:
    """LG14."""
    return passes.groupBy(*by).agg((F.sum("chunks") / F.sum("seconds")).alias("chunks_per_s"), (F.sum("files") / F.sum("seconds")).alias("files_per_s"))
