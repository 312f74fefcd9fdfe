"""Sharding by a Feistel permutation of global row numbers (op 7).

Rows are numbered 0 to n - 1 in the order of their id (ties by content).  A
Feistel network over pairs of residues permutes the numbers of a square a * a
>= n; results outside the n rows walk the cycle on until they fall inside, so
the whole is a permutation of the rows.  Position p goes to shard p mod s, slot
p div s: shard sizes differ by one at most and slots have no gaps.  Anyone who
knows n, s and the seed can compute either way where a row goes.

Numbering: rows are dealt into ranges of the sort keys, numbered within their
range, written to the shared folder, and shifted by the sizes of the ranges
before.  Only one count per range reaches the driver.  The last sort key is the
row's place in the input, so equal rows spread over ranges like any others.

Defined cases: a null id sorts first; null text has size 16 and CRC 0 (of no
bytes); repeated rows each have a number of their own; an empty table gives an
empty result; further columns are kept, but for those named like the four that
are added, which these replace.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import U64, durable, mix

ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed % (1 << 64)))


def _side(n: int) -> int:
    a = max(1, math.isqrt(n))
    return a if a * a >= n else a + 1


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the Feistel permutation of 0..n-1 sends each of ``x``."""
    a, keys = U64(_side(n)), _keys(seed)
    out = np.asarray(x, dtype=U64).copy()
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] // a, out[walk] % a
        for k in keys:
            left, right = right, (left + mix(right + k) % a) % a
        out[walk] = left * a + right
        walk = walk[out[walk] >= U64(n)]
    return out


def invert(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row numbers that :func:`permute` sends to ``y``."""
    a, keys = U64(_side(n)), _keys(seed)
    out = np.asarray(y, dtype=U64).copy()
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] // a, out[walk] % a
        for k in keys[::-1]:
            left, right = (right + a - mix(left + k) % a) % a, left
        out[walk] = left * a + right
        walk = walk[out[walk] >= U64(n)]
    return out


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _numbered(docs: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """``(row, number)``: whole rows with their numbers in the order of ``by``; and how many there are."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("row")[c] for c in by]
    placed = docs.select(_row(docs).alias("row"), F.monotonically_increasing_id().alias("place"))
    ranged = placed.repartitionByRange(parts, *keys, "place").sortWithinPartitions(*keys, "place")
    held = durable(ranged.select("row", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = sorted((r["range"], r["n"]) for r in held.groupBy("range").agg(F.count("*").alias("n")).collect())  # one row per range
    total, before = 0, []
    for k, n in sizes:
        before.append((k, total))
        total += n
    offsets = spark.createDataFrame(before or [(0, 0)], "range int, before long")
    return held.join(F.broadcast(offsets), "range").select("row", (F.col("before") + F.col("at")).alias("number")), total


def _with(rows: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The fields of ``row`` and ``more``, which replace fields of the same names."""
    return rows.select(*[F.col("row")[c].alias(c) for c in columns if c not in more], *[c.alias(n) for n, c in more.items()])


def numbered(docs: DataFrame, by: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``docs`` with a global row number from 0 in the order of ``by``, and the number of rows."""
    rows, total = _numbered(docs, by)
    return _with(rows, docs.columns, **{name: F.col("number")}), total


def _permuted(n: int, seed: int):
    def run(rows: pa.Array) -> pa.Array:
        return pa.array(permute(rows.to_numpy(zero_copy_only=False).astype(U64), n, seed).astype(np.int64))

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard(docs: DataFrame, by: list[str], n_shards: int = 40, seed: int = 42) -> DataFrame:
    """``docs`` with ``row_number``, ``position``, ``shard`` and ``slot``: a reproducible global shuffle."""
    rows, n = _numbered(docs, by)
    placed = rows.withColumn("position", _permuted(n, seed)("number"))
    at = F.col("position")
    return _with(placed, docs.columns, row_number=F.col("number"), position=at, shard=F.pmod(at, F.lit(n_shards)).cast("int"), slot=F.expr(f"position div {n_shards}"))
