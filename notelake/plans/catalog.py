"""The queries of the engine over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.config import FilterContext, RankingConfig, pool_caps
from notelake.functions import analyzer as A
from notelake.functions import passages as P
from notelake.functions import scoring as S
from notelake.functions import vectors as V
from notelake.operators import candidates as C
from notelake.operators import dense as D
from notelake.operators import filters as FL
from notelake.operators import lexical as L
from notelake.operators import maintenance as M
from notelake.operators import suggest as SG
from notelake.operators import telemetry as T
from notelake.plans.search import browse, hybrid_search
from notelake.sources import logs
from notelake.sources import notes as N
from notelake.streaming import changes as ST

CFG = RankingConfig()
QUERIES = [(1, "the tion reat"), (2, "erndes things ention"), (3, "anon heat of")]
NOW = "2024-02-01 00:00:00"
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is folder and title, the language a tag, hours since 2024 the date."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("note_path"),
        F.col("source").alias("title"),
        F.array("lang").alias("tags"),
        F.array(F.concat("lang", F.lit(" "), "source")).alias("aliases"),
        F.col("text").alias("content"),
        F.create_map(F.lit("lang"), F.array("lang"), F.lit("size"), F.array(F.col("n_chars").cast("string"))).alias("properties"),
        F.lit(None).cast("string").alias("created"),
        F.when(F.col("doc_id") % 10 != 9, F.timestamp_seconds(1704067200 + F.col("doc_id") * 3600)).alias("modified"),
    )


def by_field(c: DataFrame) -> DataFrame:
    return L.field_terms(N.spread(c), {"title": F.col("title"), "tags": F.array_join("tags", " "), "content": F.col("content")})


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id long, text string")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("chunk_id < 3").select((F.col("chunk_id") + 1).alias("query_id"), "vector")


def every_50th(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of the pure vector searches over a table of any size."""
    return vectors(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


# --- search ----------------------------------------------------------------
@query
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    q = asked(spark).join(vector_queries(spark, sf_dir), "query_id")
    out = hybrid_search(c, by_field(c), vectors(spark, sf_dir).select("chunk_id", "vector"), q, CFG, NOW)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "note_path", "chunk_id", *rounded("score", "dense", "bm25", "recency", "boost"))


STAMP = {"analyzer": 1, "model": "none", "dim": 64, "with_properties": True, "with_headings": True}


def six_fields(c: DataFrame) -> DataFrame:
    """All fields of the index with their derived forms; these chunks have no headings of their own."""
    fields = {"title": A.note_name(F.col("title")), "aliases": F.array_join("aliases", " "), "tags": F.array_join("tags", " "), "content": F.col("content"), "properties": A.properties_text(F.col("properties")), "headings": F.lit("")}
    return L.field_terms(N.spread(c), fields, derived=True)


def kept_index(spark: SparkSession, sf_dir: str) -> L.Index:
    """An index written to the shared folder, where it stays as any table does, and read back."""
    path = logs.shared_folder(spark)
    L.write_index(six_fields(chunks(spark, sf_dir)), path, STAMP)
    return L.read_index(spark, path, STAMP)


@query
def hybrid_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over a kept index of all fields; words met with typos, by beginnings and by synonyms."""
    index = kept_index(spark, sf_dir)
    q = asked(spark).join(vector_queries(spark, sf_dir), "query_id")
    mates = spark.createDataFrame([("tion", "ention"), ("tion", "reat"), ("heat", "thing")], "token string, mate string")
    out = hybrid_search(chunks(spark, sf_dir), index, vectors(spark, sf_dir).select("chunk_id", "vector"), q, CFG, NOW, vocab=index.terms.select("term").distinct(), synonyms=mates)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "note_path", "chunk_id", *rounded("score", "dense", "bm25", "recency", "boost"))


@query
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept index: texts that have a term, and occurrences, by field."""
    posted = kept_index(spark, sf_dir).postings.where("term <> ''")
    return posted.groupBy("term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    ctx = FilterContext(date_field="modified", numeric_keys=frozenset({"size"}))
    text, chosen = FL.parse("tion #en [size>1000] -junkword", ctx)
    hits = L.search(by_field(c), L.exact(L.query_terms_of(spark.createDataFrame([(1, text)], "query_id long, text string"))), CFG)
    kept = hits.join(FL.select(c, chosen, ctx).select("chunk_id"), "chunk_id", "left_semi")
    return C.top_n(kept, 10, F.desc(F.round("score", 6)), F.asc("chunk_id")).select("chunk_id", *rounded("score"))


@query
def browse_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chosen = FL.parse("path:src1/* #en")
    return browse(chunks(spark, sf_dir), chosen).select("chunk_id", "note_path")


# --- analysis --------------------------------------------------------------
@query
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    low = F.transform(A.tokens(F.col("text")), F.lower)
    return d.select("doc_id", F.size(low).cast("long").alias("n_tokens"), F.size(F.filter(low, lambda x: ~x.isin(A.STOPWORDS))).cast("long").alias("n_content"))


@query
def plural_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    w = d.select(F.explode(F.transform(A.tokens(F.col("text")), F.lower)).alias("word")).where(F.col("word").endswith("s"))
    counted = w.groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", A.depluralize(F.col("word")).alias("stem"), "n")


@query
def derived_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", A.tokenize_udf(F.col("url")).alias("t")).select("page_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query
def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    w = d.select(F.explode(A.tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("w")).where(F.regexp_like("w", F.lit("[^\\x00-\\x7F]"))).groupBy("w").agg(F.count("*").alias("n"))
    return w.select(F.col("w").alias("word"), A.fold(F.col("w")).alias("folded"), "n")


@query
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    path = F.concat(F.lit("log/"), F.col("day"), F.lit(" entry.md"))
    return e.select("event_id", F.date_format(A.parse_date(F.col("day")), "yyyy-MM-dd").alias("parsed"), F.date_format(A.period_end(F.substring("day", 1, 7)), "yyyy-MM-dd").alias("month_end"), A.filename_date(path).alias("named"))


# --- lexical ---------------------------------------------------------------
@query
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.field_stats(by_field(chunks(spark, sf_dir))).select("field", "n_docs", *rounded("avg_len"))


@query
def postings_topdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.document_frequency(L.postings(by_field(chunks(spark, sf_dir))))
    return C.top_n(df, 100, F.desc("df"), F.asc("term"), F.asc("field"))


@query
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    hits = L.search(by_field(c), L.exact(L.query_terms_of(asked(spark))), CFG).select("query_id", "chunk_id", *rounded("score", "coverage"))
    return C.top_n_by(hits, "query_id", 10, F.desc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "score", "coverage", F.col("rank").cast("long").alias("rank"))


@query
def bm25_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return L.bound(by_field(c), L.query_terms_of(asked(spark)), CFG).select("query_id", *rounded("bound"))


@query
def doc_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    posted = L.postings(by_field(c), L.query_terms_of(asked(spark)).select("term").distinct())
    return L.doc_fraction(posted, c.count()).select("term", *rounded("fraction"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(A.terms(F.col("text"))).alias("term")).distinct()


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("tions",), ("heta",), ("reat",), ("thing",), ("on",)], "term string")


@query
def fuzzy_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fuzzy(_words(spark), _vocabulary(spark, sf_dir), CFG).select("source", "term", *rounded("weight"))


@query
def prefix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prefix(_words(spark), _vocabulary(spark, sf_dir), CFG).select("source", "term", *rounded("weight"))


@query
def synonym_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    names = n.select(F.col("n_nationkey").cast("string").alias("note_path"), F.explode(F.array("n_name", F.substring("n_name", 1, 3), F.concat("n_name", F.lit("n")))).alias("name"))
    common = spark.createDataFrame([("kenyan", 0.2), ("chi", 0.01)], "term string, fraction double")
    return L.synonym_map(L.synonym_classes(names), common, CFG)


@query
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    syn = spark.createDataFrame([("tion", "ention"), ("tion", "reat"), ("heat", "thing")], "token string, mate string")
    return L.expand_synonyms(L.exact(L.query_terms_of(asked(spark))), syn, CFG).select("query_id", "source", "term", "weight")


@query
def index_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings changed by a delta equal those built anew; dealt by chunk once, so postings are not moved before they are counted."""
    return _changed(by_field(chunks(spark, sf_dir)).repartition("chunk_id"))


def _changed(f: DataFrame) -> DataFrame:
    posted, moved = L.postings(f), f.where("chunk_id % 7 = 0").select("chunk_id")
    again = L.postings(f.where("chunk_id % 7 = 0").withColumn("terms", F.array(F.lit("moved"))))
    return L.apply_delta(posted, moved, again).groupBy("term", "field").agg(F.count("*").alias("df"))


# --- vectors ---------------------------------------------------------------
@query
def sign_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("chunk_id", F.array_join(V.sign_bytes(F.col("vector")), ",").alias("bytes"))


@query
def sign_scan_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sign_scan_top(vectors(spark, sf_dir), every_50th(spark, sf_dir))


def _sign_scan_top(v: DataFrame, q: DataFrame) -> DataFrame:
    out = D.scan(v, q, 20)
    return out.select("query_id", "chunk_id", *rounded("score"))


@query
def packed_scan_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed_scan_top(vectors(spark, sf_dir), every_50th(spark, sf_dir))


def _packed_scan_top(v: DataFrame, q: DataFrame) -> DataFrame:
    out = D.scan_packed(v, q, 20)
    return out.select("query_id", "chunk_id", *rounded("score"))


@query
def int8_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select("chunk_id", F.round(V.int8_scale(F.col("vector")), 9).alias("scale"), F.aggregate(V.int8_codes(F.col("vector")), F.lit(0), lambda a, x: a + x).cast("long").alias("code_sum"))


@query
def int8_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int8_rerank(vectors(spark, sf_dir), every_50th(spark, sf_dir))


def _int8_rerank(v: DataFrame, q: DataFrame) -> DataFrame:
    return D.scan_int8(v, q, 20).select("query_id", "chunk_id", *rounded("score"))


@query
def background_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.background_mean(vectors(spark, sf_dir)).select("n", *rounded("mean"))


@query
def background_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.calibration(vectors(spark, sf_dir)).select(*rounded("mean", "std"))


@query
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidences(vectors(spark, sf_dir), every_50th(spark, sf_dir))


def _confidences(v: DataFrame, q: DataFrame) -> DataFrame:
    cos = D.scan(v, q, 50, V.dot)
    conf = V.confidence(F.col("score"), F.lit(0.01), F.lit(0.125))
    return cos.select("query_id", "chunk_id", F.round(conf, 6).alias("confidence"), F.round(V.match_strength(conf, F.lit(0.4), 0.85, F.col("chunk_id") % 2 == 0), 6).alias("strength"))


@query
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("chunk_id")
    return D.with_vectors(c, vectors(spark, sf_dir)).groupBy("lexical_only").agg(F.count("*").alias("n"))


@query
def vector_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    odd = F.when(F.col("chunk_id") % 5 == 0, F.slice("vector", 1, 63)).when(F.col("chunk_id") % 5 == 1, F.transform("vector", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("vector"))
    return v.select(V.usable(odd, 64).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reservoir(vectors(spark, sf_dir), 64).agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_distinct"))


@query
def length_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(D.rung(F.size(A.tokens(F.col("text")))).cast("long").alias("rung"))
    return d.groupBy("rung").agg(F.count("*").alias("n"))


@query
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", D.hash_embedder(F.col("text")).alias("v"))
    return b.select("item_id", F.round(V.dot(F.col("v"), F.col("v")), 4).alias("norm"))


# --- filters ---------------------------------------------------------------
@query
def filter_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(FL.has_tag(F.col("tags"), ["EN", "fr"])).select("chunk_id")


@query
def filter_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(FL.on_path(F.col("note_path"), ["SRC1/*5.md", "src2/??.md"])).select("chunk_id")


@query
def filter_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("properties")
    return chunks(spark, sf_dir).where(FL.property_is(p, "Lang", "e", False) & ~FL.property_is(p, "lang", "de", True)).select("chunk_id")


@query
def filter_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = FilterContext(numeric_keys=frozenset({"size"}))
    return chunks(spark, sf_dir).where(FL.predicate(FL.parse("[size>1000] [size:<3000]", ctx)[1], ctx)).select("chunk_id")


@query
def filter_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(FL.predicate(FL.parse("[lang>3]")[1])).select("chunk_id")


@query
def filter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = FilterContext(date_field="modified")
    return chunks(spark, sf_dir).where(FL.predicate(FL.parse("after:2024-01-05 before:2024-01-20", ctx)[1], ctx)).select("chunk_id")


@query
def negate_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.without_words(chunks(spark, sf_dir), ["reat", "heat"]).select("chunk_id")


# --- candidates ------------------------------------------------------------
@query
def caps_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    return spark.createDataFrame([(k, v) for k, v in pool_caps(n).items()], "arm string, cap long")


@query
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = chunks(spark, sf_dir), vector_queries(spark, sf_dir)
    lexical = C.top_n_by(L.search(by_field(c), L.exact(L.query_terms_of(asked(spark))), CFG).withColumn("score", F.round("score", 6)), "query_id", 30, F.desc("score"), F.asc("chunk_id"))
    recent = C.recency_arm(c, 10).crossJoin(F.broadcast(q.select("query_id")))  # ten rows for each stated query
    return C.union_arms(dense=D.scan(vectors(spark, sf_dir), q, 30), lexical=lexical, recency=recent).groupBy("query_id", "first_arm", "n_arms").agg(F.count("*").alias("n"))


@query
def best_per_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.lit(1).alias("query_id"), F.col("conv_id").alias("note_path"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.length("text").cast("long").alias("score"))
    return C.best_per_note(t, 25).select("note_path", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query
def browse_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.browse_order(chunks(spark, sf_dir)).limit(60).select("chunk_id", "note_path")


@query
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(chunks(spark, sf_dir), 1, 10, F.desc_nulls_last("modified"), F.asc("chunk_id")).select("chunk_id")


@query
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    files = c.where("chunk_id % 3 > 0").groupBy("title").agg(F.collect_list("chunk_id").alias("chunk_ids"))
    return C.orphans(c.select("chunk_id"), files)


@query
def delta_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("old"), F.array_sort(F.collect_set("l_suppkey")).alias("new"))
    d = t.select("l_orderkey", C.delta_ids(F.col("old"), F.col("new")).alias("d"))
    return d.select("l_orderkey", *[F.size(f"d.{k}").cast("long").alias(k) for k in ("stale", "fresh", "stable")])


@query
def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "ts", F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))).alias("query"))
    return C.recent_queries(e, "user_id").select("user_id", "query", F.col("rank").cast("long").alias("rank"))


# --- ranking ---------------------------------------------------------------
@query
def title_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(S.title_boost(F.lit("the green forests"), F.col("p_name"), F.array("p_brand"), 0.5), 6).alias("boost"), F.round(S.title_cover(F.substring_index("p_name", " ", 1), F.col("p_name")), 6).alias("own"))


@query
def recency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    when = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", F.round(S.recency(when, F.lit("1998-01-01").cast("timestamp"), 180.0), 6).alias("recency"))


@query
def lexical_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical_floor(vectors(spark, sf_dir), every_50th(spark, sf_dir))


def _lexical_floor(v: DataFrame, q: DataFrame) -> DataFrame:
    v = D.scan(v, q, 40, V.dot)
    only = F.col("chunk_id") % 4 == 0
    return v.select("query_id", "chunk_id", F.round(S.dense_norm(S.lexical_floor(F.col("score"), only)), 6).alias("dense"))


# --- completion ------------------------------------------------------------
@query
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.tag_counts(chunks(spark, sf_dir))


@query
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.folder_counts(chunks(spark, sf_dir))


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("p_brand", "p_type", "p_size", "p_name")]))
    return p.select(F.col("p_partkey").alias("note_path"), each.alias("x")).select("note_path", "x.key", "x.value")


@query
def suggest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.value_counts(_properties(spark, sf_dir), ["p_name"])


@query
def suggest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.suggested_keys(SG.value_counts(_properties(spark, sf_dir)))


@query
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.complete(SG.value_counts(_properties(spark, sf_dir)).groupBy(F.col("value").alias("word")).agg(F.sum("n").alias("n")), "b")


# --- logs ------------------------------------------------------------------
@query
def dist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distribution(events(spark, sf_dir), ["event_type"], "value").select("event_type", "n", *rounded("min", "max", "mean", "p50", "p95"))


def _stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", "ts", F.when(F.col("event_type") == "view", "idle").otherwise(F.col("event_type")).alias("context"), F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).alias("frame"), F.col("value").alias("duration_ms"), (F.col("value") > 40).alias("applied"), (F.col("event_id") % 4).alias("reason"), F.col("event_type").alias("type"))


@query
def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stalls(_stalls(spark, sf_dir)).select("context", "n", *[F.round(x, 3).alias(x) for x in ("total_ms", "max_ms")])


@query
def frame_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.idle_frames(_stalls(spark, sf_dir)).select("frame", "n", F.round("total_ms", 3).alias("total_ms"))


@query
def patch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.patches(_stalls(spark, sf_dir), "context").select("context", *rounded("applied", "p95_ms", "max_ms"), "n_reasons")


@query
def log_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = spark.createDataFrame([("click", 5), ("purchase", 3)], "type string, cap int")
    return T.latest_by_type(_stalls(spark, sf_dir), caps, 10).select("type", "event_id")


@query
def device_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.device_counts(events(spark, sf_dir).withColumn("device", F.col("user_id") % 7))


@query
def error_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.error_milestones(events(spark, sf_dir).withColumn("message", F.col("event_type"))).select("message", "event_id", "k")


@query
def stall_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.gaps(events(spark, sf_dir), "user_id").groupBy("user_id").agg(F.count("gap_s").alias("n"), F.max("gap_s").alias("longest"))


@query
def periodic_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the stalls of seven devices, a minute for each key."""
    p = table(spark, sf_dir, "part")
    e = p.select((F.col("p_partkey") % 7).alias("device"), (F.col("p_partkey") * 60_000.0 + F.col("p_size")).alias("start_ms"), F.col("p_retailprice").cast("double").alias("duration_ms"))
    return T.periodic_stalls(e, "device")


@query
def span_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event takes part: views and clicks open a span, all others are tasks."""
    e = events(spark, sf_dir).withColumn("ms", F.floor(F.unix_micros("ts") / 1000).cast("long"))
    opens = F.coalesce(F.col("event_type").isin("view", "click"), F.lit(False))
    tasks = e.where(~opens).select(F.col("event_id").alias("task_id"), F.col("ms").alias("start"), (F.col("ms") + F.floor(F.col("value") * 100).cast("long")).alias("end"))
    spans = e.where(opens).select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("context"), F.col("ms").alias("start"), (F.col("ms") + 20_000).alias("end"))
    return T.attribute(tasks, spans)


@query
def crash_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "view", "visibility").otherwise(F.col("event_type")).alias("type"), F.col("event_id").cast("string").alias("detail"))
    return T.crash_verdict(e, "user_id")


@query
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.stable_token(F.col("url"), "salt").alias("token"), T.query_shape(F.col("url")).alias("shape"))


@query
def click_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    s = e.where("event_type = 'view'").select(F.col("event_id").alias("search_id"))
    k = e.where("event_type = 'click'").select((F.col("event_id") - 1).alias("search_id"), (F.col("event_id") % 10).alias("rank"))
    return T.clicks(s, k)


@query
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").agg(F.count("*").alias("t"), F.sum((F.col("o_orderkey") % 3 == 0).cast("long")).alias("d"))
    return o.select(T.percent(F.col("d"), F.col("t")).alias("percent"))


@query
def index_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.col("n_chars") / 1000.0).alias("chunks"), F.count("*").alias("files"), (F.count("*") * 2.0).alias("seconds"))
    return T.index_rates(p, ["lang"]).select("lang", *rounded("chunks_per_s", "files_per_s"))


# --- maintenance -----------------------------------------------------------
@query
def delta_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("note_path", "chunk_id", F.md5("content").alias("hash"))
    files = c.where("chunk_id % 10 <> 1").select("note_path", F.col("chunk_id").alias("mtime"), F.when(F.col("chunk_id") % 10 != 5, F.when(F.col("chunk_id") % 10 == 6, F.lit("old")).otherwise(F.col("hash"))).alias("hash"), F.when(F.col("chunk_id") % 10 == 3, "1.0").when(F.col("chunk_id") % 10 == 4, "2.0").alias("failed_version"))
    live = c.where("chunk_id % 10 <> 2").select("note_path", (F.col("chunk_id") + F.when(F.col("chunk_id") % 10 >= 5, 1).otherwise(0)).alias("mtime"), "hash")
    return M.classify(files, live, "2.0").groupBy("state").agg(F.count("*").alias("n"))


@query
def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("meta_hash"), F.md5("text").alias("row_hash"), (F.col("doc_id") % 7).alias("k"))
    new = d.where("k <> 2").select("chunk_id", F.when(F.col("k") == 3, "x").otherwise(F.col("meta_hash")).alias("meta_hash"), F.when(F.col("k") == 4, "y").otherwise(F.col("row_hash")).alias("row_hash"))
    return M.chunk_lanes(d.where("k <> 1"), new).groupBy("lane").agg(F.count("*").alias("n"))


@query
def apply_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("chunk_id", "title")
    added = c.where("chunk_id % 4 = 0").select("chunk_id", F.lit("new").alias("title")).unionByName(c.where("chunk_id % 4 = 1").select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), F.lit("more").alias("title")))
    return M.apply(c, c.where("chunk_id % 8 = 0"), added).groupBy("title").agg(F.count("*").alias("n"))


@query
def compaction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.needs_compaction(table(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "F").alias("tombstone")))


@query
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return M.incoherent(d.select(F.col("doc_id").alias("chunk_id")), e.select(F.col("vec_id").alias("chunk_id"))).groupBy("missing_in").agg(F.count("*").alias("n"))


@query
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("embed_input"))
    old = d.where("chunk_id % 2 = 0").withColumn("vector", F.col("chunk_id"))
    return M.carry_over(d.where("chunk_id % 2 = 1"), old).where("vector is not null").select("chunk_id", "vector")


def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 3).alias("device"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("mtime"), (F.col("l_linestatus") == "F").alias("tombstone"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_partkey").alias("off"), F.lit(444).alias("bytes"))


@query
def log_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resolve(_sync(spark, sf_dir)).select("id", "mtime", "device", "seq", "off")


@query
def hydrate_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note_path"), F.col("o_orderkey").alias("chunk_id"))
    return M.hydrate(o, M.resolve(_sync(spark, sf_dir)))


@query
def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("chunk_id"))
    kept, worth = M.compact_log(_sync(spark, sf_dir), live, least_bytes=1 << 20)
    return kept.groupBy("device").agg(F.count("*").alias("n")).withColumn("compacted", F.lit(worth))


@query
def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sync(spark, sf_dir).groupBy("device", F.pmod("id", F.lit(40)).alias("shard")).agg(F.sum("bytes").alias("bytes"))
    return M.small_shards(s, 16, 1 << 30)


@query
def producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    metas = s.select(F.col("s_suppkey").alias("device"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey")).alias("last_full"), (F.col("s_suppkey") % 3 + 9).alias("chunker_version"), F.lit(64).alias("dim"))
    return M.rank_producers(metas, {"chunker_version": 10, "dim": 64}, 10).select("device", "last_full", "peer_ahead")


@query
def store_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.store_sizes(region=table(spark, sf_dir, "region").select("r_regionkey", "r_name"), nation=table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 3).alias("device"), F.lit(100).cast("long").alias("bytes"))
    return M.keep_tail(e, 20_000, 50_000).groupBy("device").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query
def device_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("device"))
    return M.retained_devices(e, F.lit("2024-02-28 00:00:00").cast("timestamp")).groupBy("device").agg(F.count("*").alias("n"))


@query
def record_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    r = v.select("chunk_id", V.int8_codes(F.col("vector")).alias("q"), V.int8_scale(F.col("vector")).alias("scale"), V.sign_bytes(F.col("vector")).alias("sign"))
    stored = r.withColumn("crc", M.record_crc(F.col("q"), F.col("scale"), F.col("sign")) + F.when(F.col("chunk_id") % 9 == 0, 1).otherwise(0))
    return M.valid_records(stored).select("chunk_id")


@query
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(N.indexable(F.col("note_path"), ["src1"], ["src2", "/[37][.]md$/"])).select("chunk_id")


@query
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.batch_sessions(events(spark, sf_dir), 3600).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query
def directory_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.length("html").alias("bytes"), F.col("page_id").alias("mtime"))
    return M.signature(p)


# --- ingest and presentation -----------------------------------------------
@query
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = N.chunk_notes(N.documents_as_notes(N.spread(table(spark, sf_dir, "documents"))))
    return c.select("chunk_id", "note_path", "title", F.length("content").alias("n_chars"), F.array_join("tags", ",").alias("tags"), "part")


@query
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = N.chunk_notes(N.conversations_as_notes(table(spark, sf_dir, "conversations")))
    return c.select("chunk_id", "note_path", "title", "start_line", "end_line", F.length("content").alias("n_chars"))


@query
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.chunk_notes(N.pages_as_notes(N.spread(table(spark, sf_dir, "pages")))).select("chunk_id", "note_path", F.length("content").alias("n_chars"), "part")


@query
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a query's results with snippet and highlights; only the page's texts are read."""
    c = chunks(spark, sf_dir)
    hits = C.top_n(L.search(by_field(c), L.exact(L.query_terms_of(spark.createDataFrame(QUERIES[:1], "query_id long, text string"))), CFG), 10, F.desc("score"), F.asc("chunk_id"))
    page = hits.select("chunk_id").join(c.select("chunk_id", "content", "note_path"), "chunk_id")
    text, words = QUERIES[0][1], [w for w, _ in P.passage_terms(QUERIES[0][1])]

    def show(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "snippet": [P.snippet(t, text) for t in pdf["content"]], "n_marks": [len(P.highlights(t, words)) for t in pdf["content"]], "link": [P.link(p.split("/")[-1].removesuffix(".md")) for p in pdf["note_path"]]})

    return page.mapInPandas(show, "chunk_id long, snippet string, n_marks long, link string")


@query
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = N.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_sentences": [len(P.sentences(t or "")) for t in pdf["text"]]})

    return d.mapInPandas(run, "doc_id long, n_sentences long")


@query
def cli_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = C.top_n(chunks(spark, sf_dir), 5, F.desc_nulls_last("modified"), F.asc("chunk_id")).select(F.col("chunk_id").cast("int").alias("rank"), "note_path", F.lit(0.0).alias("score"))
    return logs.as_cli(top, "recent")


def entry(spark: SparkSession) -> DataFrame:
    return hybrid(spark, "/root/testdata/sf0.001")


