"""Dictionaries for completion (SG1-SG7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CARDINALITY, MAX_VALUE = 40, 40
_IN_TAG = r"[\s\p{Punct}\x{2000}-\x{206F}\x{2E00}-\x{2E7F}&&[^_-]]"
TAG = f"^(?:(?!{_IN_TAG}).)+(?:/(?:(?!{_IN_TAG}).)+)*$"


def tag_counts(notes: DataFrame) -> DataFrame:
    """SG1: notes per valid tag; tags that stand on excluded notes only do not show."""
    t = notes.where(~F.coalesce("excluded", F.lit(False)) if "excluded" in notes.columns else F.lit(True))
    return t.select("note_path", F.explode("tags").alias("tag")).where(F.regexp_like("tag", F.lit(TAG)) & F.regexp_like("tag", F.lit("[^0-9/]"))).groupBy("tag").agg(F.countDistinct("note_path").alias("n"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folder_counts(notes: DataFrame) -> DataFrame:
    """SG2."""
    return notes.groupBy(folder(F.col("note_path")).alias("folder")).agg(F.count("*").alias("n")).where("folder <> ''")


def value_counts(properties: DataFrame, blocked: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    """SG3: ``(key, value, n)`` of ``(note_path, key, value)``."""
    keys = [*(blocked or []), *(dates or [])]
    own = properties.where(~F.lower("key").isin(keys) if keys else F.lit(True))
    own = own.where((F.length("value") <= MAX_VALUE) & ~F.regexp_like("value", F.lit(r"^\d{4}-\d{2}-\d{2}|[\[\]]")) & (F.col("value") != ""))
    return own.groupBy("key", "value").agg(F.countDistinct("note_path").alias("n"))


def suggested_keys(values: DataFrame) -> DataFrame:
    """SG4-SG5: keys whose values repeat, by total."""
    total = values.groupBy("key").agg(F.count("*").alias("n_values"), F.sum("n").alias("total"))
    return total.where((F.col("n_values") <= MAX_CARDINALITY) | (F.col("total") >= 2 * F.col("n_values")))


def complete(words: DataFrame, typed: str, k: int = 8) -> DataFrame:
    """SG6: strict extensions of what is typed, in any case, busiest first."""
    own = words.where(F.lower("word").startswith(typed.lower()) & (F.length("word") > len(typed)))
    return own.orderBy(F.desc("n"), F.asc("word")).limit(k)


def declared(types: DataFrame, kind: str) -> DataFrame:
    """SG7: property names of a declared type."""
    return types.where(F.col("type") == kind).select("key").distinct()
