"""Sources, streams, equivalences, and every query against its SQL."""

import os
import time
from collections import Counter

import __spark_entry__
import duckdb
import numpy as np
import pytest
from notelake.operators import dense as D
from notelake.operators import lexical as L
from notelake.plans import catalog, oracles
from notelake.sources import logs, notes
from notelake.streaming import changes as ST
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    sql = con.sql(oracles.ORACLES[name])
    names = sql.columns
    got = catalog.REGISTRY[name](spark, SF)
    assert set(got.columns) == set(names)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, sql.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY) - set(oracles.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.REGISTRY[name](spark, SF).collect() is not None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_packed_scan_equals_plain(spark):
    v, q = catalog.vectors(spark, SF), catalog.vector_queries(spark, SF)
    rows = lambda d: sorted((r.query_id, r["rank"], r.chunk_id) for r in d.collect())
    assert rows(D.scan(v, q, 15)) == rows(D.scan_packed(v, q, 15))


def test_all_events_are_attributed(spark):
    rows = catalog.events(spark, SF).select("event_id", "event_type", "value", F.floor(F.unix_micros("ts") / 1000).alias("ms")).collect()
    spans = [(r.ms, f"c{r.event_id}") for r in rows if r.event_type in ("view", "click")]
    want = {}
    for r in rows:
        if r.event_type not in ("view", "click"):
            end = r.ms + int(r.value * 100 // 1)
            met = [(min(end, s + 20_000) - max(r.ms, s), s, c) for s, c in spans if min(end, s + 20_000) > max(r.ms, s)]
            want[r.event_id] = max(met)[2] if met else "idle"
    assert len(want) + len(spans) == len(rows) and {"idle"} < set(want.values())
    assert sorted(map(tuple, catalog.REGISTRY["span_attribution"](spark, SF).select("task_id", "context").collect())) == sorted(want.items())


def test_delta_reaches_texts(spark):
    want = Counter()
    for r in catalog.by_field(catalog.chunks(spark, SF)).collect():
        want.update((t, r.field) for t in (set(r.terms) if r.chunk_id % 7 else {"moved"}))
    got = {(r.term, r.field): r.df for r in catalog.REGISTRY["index_delta"](spark, SF).collect()}
    assert got == dict(want)
    assert sum(f == "content" for _, f in got) > 1000


def test_scans_in_blocks(spark, monkeypatch):
    v, q = catalog.vectors(spark, SF), catalog.every_50th(spark, SF)
    rows = lambda d: sorted((r.query_id, r["rank"], r.chunk_id) for r in d.collect())
    want = rows(D.scan(v, q, 15))
    monkeypatch.setattr(D, "MAX_QUERIES", 4)
    assert [b.count() for b in D._blocks(q)] == [4, 4, 2]
    assert rows(D.scan(v, q, 15)) == want == rows(D.scan_packed(v, q, 15))


def test_int8_scan_equals_column_form(spark, monkeypatch):
    """Odd vectors, ties, blocks and small steps: rows and scores to the last bit."""
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.standard_normal(7).astype(np.float32)]) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(30)] + [(300, [0.0] * 7), (301, None), (302, [1.0] * 6), (303, [1.0, None] + [0.5] * 5), (304, [float("inf")] + [1.0] * 6)]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(3)
    q = v.where("chunk_id % 50 < 4 and chunk_id <> 304").select(F.col("chunk_id").alias("query_id"), "vector")
    key = lambda d: sorted((x.query_id, x["rank"], x.chunk_id, str(x.score)) for x in d.collect())
    want = key(D.scan(v, q, 12, D._by_int8))
    assert key(D.scan_int8(v, q, 12)) == want
    monkeypatch.setattr(D, "STEP", 64)
    monkeypatch.setattr(D, "MAX_QUERIES", 5)
    assert key(D.scan_int8(v, q, 12)) == want
    assert key(D.scan_int8(v, q.limit(0), 12)) == key(D.scan_int8(v.limit(0), q, 12)) == []


def test_int8_scan_of_many_rows(spark):
    """2,500,000 pairs."""
    rows = spark.range(25_000).select(F.col("id").alias("chunk_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (F.xxhash64("id", i) % 1000 / 1000).cast("float")).alias("vector"))
    began = time.monotonic()
    assert D.scan_int8(rows, rows.where("chunk_id < 100").withColumnRenamed("chunk_id", "query_id"), 20).count() == 2000
    assert time.monotonic() - began < 30


def test_vector_searches_of_every_50th_row(spark):
    rows = catalog.vectors(spark, SF).collect()
    ids, m = np.array([r.chunk_id for r in rows]), np.array([r.vector for r in rows], dtype=np.float64)
    scale = np.abs(m).max(axis=1, keepdims=True) / 127
    matrices = {"sign_scan_top": (np.where(m >= 0, 1.0, -1.0), 20), "packed_scan_top": (np.where(m >= 0, 1.0, -1.0), 20), "int8_rerank": (np.floor(m / scale + 0.5) * scale, 20), "confidences": (m, 50), "lexical_floor": (m, 40)}
    asked = {int(i) for i in ids if i % 50 == 0}
    for name, (other, k) in matrices.items():
        got = {}
        for r in catalog.REGISTRY[name](spark, SF).collect():
            got.setdefault(r.query_id, set()).add(r.chunk_id)
        assert set(got) == asked and len(asked) == 10
        for i in asked:
            s = other @ m[ids == i][0]
            least = np.sort(s)[-k]
            assert len(got[i]) == k and all(s[ids == c][0] >= least - 1e-9 for c in got[i])


def test_bound_is_the_best_single_term_score(spark):
    f = catalog.by_field(catalog.chunks(spark, SF)).cache()
    q = spark.createDataFrame([(1, "reat")], "query_id long, text string")
    top = L.search(f, L.exact(L.query_terms_of(q)), catalog.CFG).agg(F.max("score")).first()[0]
    assert L.bound(f, L.query_terms_of(q), catalog.CFG).first()["bound"] == pytest.approx(top)


def test_notes_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("---\ntags: [x]\n---\n# H\n" + "body " * 30)
    (tmp_path / "b.base").write_text("views:\n  - type: table\n    name: Mine\n")
    (tmp_path / "c.txt").write_text("no")
    read = notes.read_notes(spark, str(tmp_path))
    assert read.count() == 2
    got = {r.title: r.tags for r in notes.chunk_notes(read).collect()}
    assert got == {"n > H": ["x"], "b": [], "b > Mine": []}
    odd = spark.createDataFrame([("x.md", None), ("y.md", "")], "note_path string, raw string")
    assert notes.chunk_notes(odd).where("lexical_only").count() == 2
    assert notes.chunk_notes(odd.limit(0)).count() == 0


def test_sync_log(spark, tmp_path):
    rows = spark.createDataFrame([("i", "d", 64, "s", 1, 0, 5, False)], "id string, device string, dim int, shard string, seq long, off long, mtime long, tombstone boolean")
    logs.write_sync_log(rows, str(tmp_path), 1)
    with pytest.raises(Exception, match="exists"):
        logs.write_sync_log(rows, str(tmp_path), 1)
    (tmp_path / "torn.json").write_text('{"id": "j", "dev')
    good, bad = logs.read_sync_log(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (1, 1)


def test_versions_and_events(spark, tmp_path):
    logs.commit(spark.range(3), str(tmp_path / "t"), 1)
    logs.commit(spark.range(5), str(tmp_path / "t"), 2)
    assert logs.latest(spark, str(tmp_path / "t")).count() == 5
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "d.ndjson").write_text('{"type":"search","device":"d","ts":"2024-01-01T00:00:00Z"}\nbroken\n')
    assert logs.read_events(spark, str(tmp_path / "log")).count() == 1
    assert "| a | 1 |" in logs.report([("x", {"a": 1})])


CHANGES = "note_path string, hash string, ts timestamp"


def test_stream_drain_and_dedupe(spark, tmp_path):
    src, root, cp = (str(tmp_path / n) for n in ("src", "root", "cp"))
    make = lambda rows: spark.createDataFrame(rows, "note_path string, hash string, t string").select("note_path", "hash", F.to_timestamp("t").alias("ts"))
    make([("a", "1", "2024-01-01 00:00:00"), ("b", "1", "2024-01-01 00:00:00")]).coalesce(1).write.mode("append").parquet(src)
    ST.drain(spark, src, CHANGES, cp, ST.versioned_sink(root)).awaitTermination()
    make([("a", "2", "2024-01-02 00:00:00")]).coalesce(1).write.mode("append").parquet(src)
    ST.drain(spark, src, CHANGES, cp, ST.versioned_sink(root)).awaitTermination()
    assert {(r.note_path, r.hash) for r in logs.latest(spark, root).collect()} == {("a", "2"), ("b", "1")}
    stream = spark.readStream.schema(CHANGES).parquet(src)
    q = ST.distinct_changes(stream.unionByName(spark.readStream.schema(CHANGES).parquet(src))).writeStream.format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("changes").count() == 3


def test_stream_sessions(spark, tmp_path):
    e = catalog.events(spark, SF).select("ts", "user_id", "event_id")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = ST.search_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = {(r.user_id, r.start): r.n for r in ST.batch_sessions(e).collect()}
    seen = spark.table("sessions").collect()
    assert seen and all(whole[r.user_id, r.start] == r.n for r in seen)
