"""The pipeline, stage by stage, against plain Python."""

import random
import re
from collections import Counter

import corpus_pipeline as p
from notelake.llm import entry
from tests.llm.test_operators import base_secrets, brute_components, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, seen = docs, []
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == docs.columns
        seen.append((before.collect(), after.collect()))
        before = after
    kept = {x.doc_id for x in entry.op3_fertility(spark, SF).where("kept").collect()}
    assert {x.doc_id for x in seen[0][1]} == kept
    groups = brute_components([(x.doc_id, x.text) for x in seen[1][0]])
    assert sorted(x.doc_id for x in seen[1][1]) == sorted({c for _, _, c in groups})
    hits = brute_hits([x.text for x in seen[2][0]], items)
    assert {x.doc_id for x in seen[2][1]} == {x.doc_id for x, h in zip(seen[2][0], hits, strict=True) if not h[1]}
    assert len(seen[3][0]) == len(seen[3][1])
    assert all(not base_secrets(x.text) and x.n_chars == len(x.text) for x in seen[3][1])
    assert [x.doc_id for x in seen[4][1]] == [x.doc_id for x in seen[4][0]]
    assert {tuple(x) for x in p.run(spark, SF).collect()} == {tuple(x) for x in seen[4][1]}


def prose(r, n):
    return " ".join("".join(r.choice("aeioumnrst") for _ in range(r.randint(3, 8))) for _ in range(n))


def odd_documents(spark):
    """Repeated and null ids, nulls in every column, copies under other ids, a column with a clashing name."""
    r = random.Random(21)
    a, b, c, d = (prose(r, 80) for _ in range(4))
    rows = [(3, a), (8, a), (8, b), (9, c), (9, d), (9, c.upper()), (None, a), (None, prose(r, 70)), (None, None), (5, None), (5, ""), (6, "--- !"), (7, d + " more"), (10, b), (10, b)]
    return spark.createDataFrame([(i, t, "en" if i else None, None, len(t or ""), "clash", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, row long, q string")


def plain_near_duplicates(rows):
    """Row by row: what stays of (doc_id, text, ...) rows."""
    sets = []
    for x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x.text or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for g in set(group):
        own = [i for i in range(len(rows)) if group[i] == g]
        if not sets[own[0]]:
            out += own
        else:
            ids = [rows[i].doc_id for i in own if rows[i].doc_id is not None]
            out.append(next(i for i in own if rows[i].doc_id == (min(ids) if ids else None)))
    return Counter((rows[i].doc_id, (rows[i].text or "").lower()) for i in out)


def test_near_duplicates_judges_rows(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    out = p.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((x.doc_id, (x.text or "").lower()) for x in got) == plain_near_duplicates(rows)
    assert {(x.doc_id, x.text) for x in rows} >= {(x.doc_id, x.text) for x in got}
    assert p.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_cuts_only_shared_rows_again_and_once(spark):
    """Two evaluations side by side, each over the rows with shared or null ids; none above another (a further worker for each task)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = p.near_duplicates(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    at = [i for i, x in enumerate(plan) if "ArrowEvalPython" in x]
    assert len(at) == 2
    for i in at:
        below = plan[i + 1 : next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))]
        assert any("LeftSemi" in x for x in below) and not any("ArrowEvalPython" in x for x in below)


def test_stages_take_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    for i, (_, stage) in enumerate(p.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == docs.columns
        assert spark.read.parquet(f"{tmp_path}/{i}").count() <= 15


def test_pipeline_leaves_one_table(spark):
    out = p.run(spark, SF)
    with_files = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
    assert len(with_files) == 1 and out.count() > 0
