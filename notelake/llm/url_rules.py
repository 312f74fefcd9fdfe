"""URL filters by expression expansion and a hashed equi-join (op 4).

A rule is (host, path, action).  It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's path; the longest rule
wins (its whole text; then the longer host; then block before allow).  Each
distinct URL is expanded into its host suffixes and path prefixes, only for the
numbers of labels and the path lengths that occur among the rules, so a URL with
thousands of labels or a very long path has no more expressions than any other.
Expressions join the rules on the first ``PREFIX_BITS`` bits of their SHA-256;
what meets is then confirmed by the full digest.

A very common host costs one row per distinct URL; the rules' side is broadcast
only while it is small and joins by shuffle (with adaptive skew splitting) above.

Defined cases: a null URL or one without ``://`` has an empty host and path and
no rule; repeated URLs are judged once and each row gets the verdict; without a
rule the method's verdict is ``allow``; an empty table or rule list gives the
obvious result; further columns pass through, apart from those named like the
four of the result, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_BITS = 32
#: Rules up to which their side is broadcast (about 200 bytes each).
BROADCAST_RULES = 50_000
#: (host, path, action)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_BITS // 4), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has columns host, path, action.
    """
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")).first()
    table = rules.select("host", "path", "action", _digest(F.col("host"), F.col("path")).alias("digest")).select("*", _short(F.col("digest")).alias("short"))
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    own = pages.select(row.alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    parts = own.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    sizes = F.array(*[F.lit(n) for n in sorted(shape.labels)]) if shape.labels else F.array().cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in sorted(shape.lengths)]) if shape.lengths else F.array().cast("array<int>")
    suffixes = F.transform(F.filter(sizes, lambda n: n <= F.size("labels")), lambda n: F.array_join(F.slice("labels", -n, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    wide = parts.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("prefixes")).select("host", "path", "h", F.explode("prefixes").alias("p"))
    keyed = wide.select("host", "path", _digest(F.col("h"), F.col("p")).alias("full")).select("host", "path", "full", _short(F.col("full")).alias("short"))
    met = keyed.join(F.broadcast(table.select("short", "digest", F.col("host").alias("rh"), F.col("path").alias("rp"), "action")) if shape.n <= BROADCAST_RULES else table.select("short", "digest", F.col("host").alias("rh"), F.col("path").alias("rp"), "action"), "short")
    fits = met.where("full = digest")
    order = F.struct(F.length("rh") + F.length("rp"), F.length("rh"), F.when(F.col("action") == "block", 1).otherwise(0))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(order.alias("o"), F.concat("rh", "rp").alias("rule"), F.col("action").alias("action"))).alias("b"))
    chosen = best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.action").alias("action"))
    judged = own.join(chosen, ["host", "path"], "left")
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(*kept, "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
