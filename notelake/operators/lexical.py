"""The fielded BM25+ index and its search (LX1-LX15)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.config import RankingConfig
from notelake.functions.analyzer import fuzzy_distance, query_terms, terms

EXEMPT = ("title", "aliases")


def field_terms(chunks: DataFrame, fields: dict[str, Column], derived: bool = False) -> DataFrame:
    """``(chunk_id, field, terms)``: stopwords stay in names only (AN8); glued and case forms come along if ``derived``."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), terms(F.coalesce(c, F.lit("")), f in EXEMPT, derived).alias("terms")) for f, c in fields.items()])
    return chunks.select("chunk_id", F.explode(parts).alias("f")).select("chunk_id", "f.field", "f.terms")


def postings(by_field: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """LX1: ``(term, field, chunk_id, tf)``.

    With ``only`` (a bounded set of terms, from queries) every text keeps just
    those before anything is exploded or shuffled.
    """
    own = F.col("terms")
    if only is not None:
        wanted = only.select(F.collect_set("term").alias("wanted"))
        by_field = by_field.crossJoin(F.broadcast(wanted))  # one row: the terms of the queries
        own = F.filter("terms", lambda x: F.array_contains("wanted", x))
    return by_field.select("chunk_id", "field", F.explode(own).alias("term")).groupBy("term", "field", "chunk_id").agg(F.count("*").alias("tf"))


def field_lengths(by_field: DataFrame) -> DataFrame:
    return by_field.select("chunk_id", "field", F.size("terms").cast("long").alias("len"))


def field_stats(by_field: DataFrame) -> DataFrame:
    """LX2: chunks and mean length of each field."""
    return by_field.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term", "field").agg(F.count("*").alias("df"))


def doc_fraction(posted: DataFrame, n: int | Column) -> DataFrame:
    """LX12: the largest share of chunks a term has in any field."""
    return document_frequency(posted).groupBy("term").agg((F.max("df") / n).alias("fraction"))


def weight(cfg: RankingConfig) -> Column:
    """One term's BM25+ share: boost, idf, saturated frequency with the floor delta."""
    boost = F.create_map(*[F.lit(x) for kv in cfg.weights.items() for x in kv])[F.col("field")]
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1.0 - cfg.b + cfg.b * F.col("len") / F.col("avg_len")
    return boost * idf * (cfg.delta + F.col("tf") * (cfg.k1 + 1.0) / (F.col("tf") + cfg.k1 * norm))


@dataclass(frozen=True)
class Index:
    """A kept index: ``postings`` (term, field, chunk_id, tf, len, bucket), ``terms`` (term, field, df, bucket), ``fields`` (field, n_docs, avg_len)."""

    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    buckets: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


def write_index(by_field: DataFrame, path: str, stamp: dict, buckets: int = 64) -> None:
    """IO6, LX15: the texts are analysed once; postings lie in buckets of terms, sorted by term.

    Of every text a row under the empty term is kept, from which lengths and
    counts of texts follow. Rows are dealt to files by bucket and size, so that
    a word of every text fills several files instead of one task.
    """
    spark = by_field.sparkSession
    own = F.explode(F.array_append("terms", F.lit("")))
    posted = by_field.select("chunk_id", "field", F.size("terms").cast("long").alias("len"), own.alias("term")).groupBy("term", "field", "chunk_id", "len").agg(F.count("*").alias("tf"))
    bucketed = posted.withColumn("bucket", _bucket(F.col("term"), buckets)).hint("rebalance", "bucket")
    bucketed.sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").parquet(f"{path}/postings")
    kept = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    kept.groupBy("bucket", "term", "field").agg(F.count("*").alias("df")).write.partitionBy("bucket").parquet(f"{path}/terms")
    kept.where("term = ''").groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).coalesce(1).write.parquet(f"{path}/fields")
    rows = [(k, str(v)) for k, v in {**stamp, "buckets": buckets}.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{path}/stamp")  # last: an index without it is torn


_POSTINGS = "term string, field string, chunk_id long, len long, tf long, bucket int"


def read_index(spark: SparkSession, path: str, stamp: dict) -> Index:
    """LX15: the kept index; a ``ValueError`` if its stamp differs from ``stamp`` in any of the five keys."""
    stored = {r.key: r.value for r in spark.read.parquet(f"{path}/stamp").collect()}  # six rows
    if not stamp_matches(stored, {k: str(v) for k, v in stamp.items()}):
        raise ValueError("the index was built under another stamp")
    terms_ = spark.read.schema("term string, field string, df long, bucket int").parquet(f"{path}/terms").where("term <> ''")
    return Index(spark.read.schema(_POSTINGS).parquet(f"{path}/postings"), terms_, spark.read.parquet(f"{path}/fields"), int(stored["buckets"]))


def _kept_scores(index: Index, wanted: DataFrame, cfg: RankingConfig) -> DataFrame:
    """:func:`term_scores` from a kept index: only buckets of the wanted terms are read."""
    asked = F.broadcast(wanted.select("term", _bucket(F.col("term"), index.buckets)))  # terms of the queries
    df = F.broadcast(index.terms.join(asked, ["bucket", "term"]).select("term", "field", "df"))
    full = index.postings.join(asked, ["bucket", "term"]).join(df, ["term", "field"]).join(F.broadcast(index.fields), "field")
    return full.groupBy("term", "chunk_id").agg(F.sum(weight(cfg)).alias("score"))


def term_scores(by_field: DataFrame | Index, wanted: DataFrame, cfg: RankingConfig) -> DataFrame:
    """``(term, chunk_id, score)`` of single terms, added up over fields, for the wanted terms."""
    if isinstance(by_field, Index):
        return _kept_scores(by_field, wanted, cfg)
    posted = postings(by_field, wanted)
    stats = F.broadcast(field_stats(by_field))  # a row for each field
    df = F.broadcast(document_frequency(posted))  # rows: terms of the queries times fields
    full = posted.join(field_lengths(by_field), ["chunk_id", "field"]).join(df, ["term", "field"]).join(stats, "field")
    return full.groupBy("term", "chunk_id").agg(F.sum(weight(cfg)).alias("score"))


def query_terms_of(queries: DataFrame) -> DataFrame:
    """``(query_id, pos, term)``: every occurrence counts."""
    return queries.select("query_id", F.posexplode(query_terms(F.col("text"))).alias("pos", "term"))


def search(by_field: DataFrame | Index, expanded: DataFrame, cfg: RankingConfig) -> DataFrame:
    """LX3-LX5: ``(query_id, chunk_id, score, coverage)``.

    ``expanded`` has (query_id, source, term, weight); terms are exact, prefix,
    fuzzy or synonym forms, credited to their source.
    """
    scored = term_scores(by_field, expanded.select("term").distinct(), cfg)
    indexed = scored.select("term").distinct().join(F.broadcast(expanded.where("weight = 1 and term = source").select("query_id", "term").distinct()), "term").groupBy("query_id").agg(F.count("*").alias("n_terms"))
    hits = scored.join(F.broadcast(expanded), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("score") * F.col("weight")).alias("score"), F.countDistinct("source").alias("met"))
    cover = F.when(F.coalesce(F.col("n_terms"), F.lit(0)) <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.col("met") / F.col("n_terms")))
    return hits.join(F.broadcast(indexed), "query_id", "left").select("query_id", "chunk_id", "score", cover.alias("coverage"))


def exact(query_term_rows: DataFrame) -> DataFrame:
    return query_term_rows.select("query_id", F.col("term").alias("source"), "term").distinct().withColumn("weight", F.lit(1.0))


def bound(by_field: DataFrame | Index, query_term_rows: DataFrame, cfg: RankingConfig) -> DataFrame:
    """LX6: for every query token's occurrence the best single-term score in the index, added up."""
    best = term_scores(by_field, query_term_rows.select("term").distinct(), cfg).groupBy("term").agg(F.max("score").alias("top"))
    return query_term_rows.join(F.broadcast(best), "term", "left").groupBy("query_id").agg(F.sum(F.coalesce("top", F.lit(0.0))).alias("bound"))


def vocabulary(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.max("df").alias("df")) if "df" in posted.columns else posted.select("term").distinct()


def fuzzy(words: DataFrame, vocab: DataFrame, cfg: RankingConfig) -> DataFrame:
    """LX7: ``(source, term, weight)`` within the allowed edits.

    The words of the stated queries travel as one row; every distinct term of
    ``vocab`` is measured where it lies, and nothing is shuffled.
    """
    asked = words.select(F.col("term").alias("source"), fuzzy_distance(F.col("term")).alias("k")).distinct().where("k > 0")
    one = F.broadcast(asked.agg(F.collect_list(F.struct("source", "k", F.length("source").alias("n"))).alias("asked")))
    edits = lambda x: F.when(F.abs(F.length("term") - x["n"]) <= x["k"], F.levenshtein(x["source"], F.col("term"), 2)).otherwise(-1)
    met = F.filter(F.transform("asked", lambda x: F.struct(x["source"].alias("source"), x["k"].alias("k"), edits(x).alias("d"))), lambda y: y["d"].between(1, y["k"]))
    near = vocab.select("term").crossJoin(one).select("term", F.explode(met).alias("m"))
    return near.select("m.source", "term", (cfg.fuzzy_weight * F.length("term") / (F.length("term") + F.col("m.d"))).alias("weight"))


def prefix(words: DataFrame, vocab: DataFrame, cfg: RankingConfig) -> DataFrame:
    """LX8: terms that extend a word of three letters or more; an equi-join on its first three."""
    left = words.select(F.col("term").alias("source")).distinct().where(F.length("source") >= 3).withColumn("head", F.substring("source", 1, 3))
    right = vocab.select("term", F.substring("term", 1, 3).alias("head"))
    longer = right.join(F.broadcast(left), "head").where(F.col("term").startswith(F.col("source")) & (F.col("term") != F.col("source")))
    return longer.select("source", "term", (cfg.prefix_weight * F.length("source") / F.length("term")).alias("weight"))


def expand(query_term_rows: DataFrame, vocab: DataFrame, cfg: RankingConfig, synonyms: DataFrame | None = None, fuzzily: bool = True, last_prefix: bool = True) -> DataFrame:
    """LX7, LX8, LX11: ``(query_id, source, term, weight)`` for :func:`search`.

    Every query term is met exactly and within its edits, the last one also by
    the terms it begins (a term reached both ways counts as begun). Mates from
    ``synonyms`` (token, mate) are met exactly.
    """
    own = exact(query_term_rows)
    out = own if synonyms is None else expand_synonyms(own, synonyms, cfg)
    sources = own.select("query_id", "source")
    last = query_term_rows.groupBy("query_id").agg(F.max_by("term", "pos").alias("source"))
    near = []
    if last_prefix:
        near.append(last.join(prefix(last.select(F.col("source").alias("term")), vocab, cfg), "source").withColumn("way", F.lit(1)))
    if fuzzily:
        near.append(sources.join(fuzzy(sources.select(F.col("source").alias("term")), vocab, cfg), "source").withColumn("way", F.lit(0)))
    for part in near[1:]:
        near[0] = near[0].unionByName(part)
    if not near:
        return out
    best = near[0].groupBy("query_id", "source", "term").agg(F.max_by("weight", "way").alias("weight"))
    return out.unionByName(best.select("query_id", "source", "term", "weight"))


def synonym_classes(names: DataFrame) -> DataFrame:
    """LX9: ``(note_path, token)`` of notes that have two single-token names or more.

    ``names`` has (note_path, name); tokens of two letters or more, not numbers.
    """
    own = names.select("note_path", terms(F.col("name"), True).alias("t")).where("size(t) = 1").select("note_path", F.col("t")[0].alias("token"))
    own = own.where((F.length("token") >= 2) & ~F.regexp_like("token", F.lit(r"^[\p{N}]+$"))).distinct()
    many = own.groupBy("note_path").agg(F.count("*").alias("n")).where("n >= 2").select("note_path")
    return own.join(many, "note_path")


def synonym_map(classes: DataFrame, fractions: DataFrame, cfg: RankingConfig) -> DataFrame:
    """LX10: ``(token, mate)``; tokens of several classes, and too common ones, go."""
    single = classes.groupBy("token").agg(F.countDistinct("note_path").alias("n")).where("n = 1").select("token")
    common = fractions.where(F.col("fraction") > cfg.synonym_df).select(F.col("term").alias("token"))
    own = classes.join(single, "token").join(common, "token", "left_anti")
    return own.join(own.select("note_path", F.col("token").alias("mate")), "note_path").where("token <> mate").select("token", "mate").distinct()


def expand_synonyms(exact_rows: DataFrame, synonyms: DataFrame, cfg: RankingConfig) -> DataFrame:
    """LX11: mates at their weight, never a term the query has; each once for a query."""
    mates = exact_rows.join(synonyms, exact_rows["term"] == synonyms["token"]).select("query_id", "source", F.col("mate").alias("term"))
    fresh = mates.join(exact_rows.select("query_id", "term"), ["query_id", "term"], "left_anti")
    once = fresh.groupBy("query_id", "term").agg(F.min("source").alias("source"))
    return exact_rows.unionByName(once.withColumn("weight", F.lit(cfg.synonym_weight)))


def apply_delta(posted: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """LX13: postings without the removed chunks, with those of the added ones."""
    return posted.join(removed.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(added, allowMissingColumns=False)


def same_document(a: DataFrame, b: DataFrame) -> DataFrame:
    """LX14: ``(chunk_id, same)`` by a digest of what would be indexed."""
    digest = lambda d, n: d.groupBy("chunk_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("field", "terms")))), 256).alias(n))
    return digest(a, "x").join(digest(b, "y"), "chunk_id").select("chunk_id", (F.col("x") == F.col("y")).alias("same"))


STAMP = ("analyzer", "model", "dim", "with_properties", "with_headings")


def stamp_matches(stored: dict, live: dict) -> bool:
    """LX15: a kept index may be used when all five fields agree."""
    return all(k in stored and stored[k] == live.get(k) for k in STAMP)
