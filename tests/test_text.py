"""Analysis, Markdown, passages and the query language, by their documented behaviour."""

import pytest
from notelake import config
from notelake.config import FilterContext
from notelake.functions import analyzer as A
from notelake.functions import markdown as M
from notelake.functions import passages as P
from notelake.functions import scoring as S
from notelake.operators import filters as FL
from notelake.operators import lexical as L
from notelake.operators import maintenance as MT
from notelake.operators import telemetry as T
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("GPT-4", ["GPT", "4", "GPT4"]),
        ("U.S.A", ["U", "S", "A", "USA"]),
        ("TCP/IP", ["TCP", "IP", "TCPIP"]),
        ("theVerge", ["theVerge", "the", "Verge"]),
        ("graniteR2", ["graniteR2", "granite", "R2"]),
        ("ryan's note", ["ryan", "note"]),
        ("ryan’s", ["ryan"]),
        ("1990's music", ["1990", "s", "1990s", "music"]),
        ("C++", ["C"]),
        ("a,b", ["a", "b"]),
        ("gpt 4", ["gpt", "4"]),
        ("", []),
    ],
)
def test_tokens(text, want):
    assert A.tokenize(text) == want


def test_plain_tokens():
    assert A.tokenize("GPT-4 theVerge", derived=False) == ["GPT", "4", "theVerge"]
    assert any(t == "tokyo" for t in A.tokenize("東京-tokyo"))


@pytest.mark.parametrize(("word", "want"), [("cars", "car"), ("countries", "country"), ("movies", "movie"), ("classes", "class"), ("boxes", "box"), ("theses", "thesis"), ("alias", "alias"), ("aliases", "alias"), ("bus", "bus"), ("is", "is"), ("lenses", "lens"), ("news", "news"), ("glass", "glass")])
def test_plurals(spark, word, want):
    assert spark.range(1).select(A.depluralize(F.lit(word))).first()[0] == want


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(A.camel_parts(F.lit("XMLParser"))) == ["XML", "Parser"]
    assert one(A.camel_parts(F.lit("blogs"))) == []
    assert one(A.query_terms(F.lit("the of"))) == ["the", "of"]
    assert str(one(A.parse_date(F.lit("2024-02-30")))) == "2024-03-01 00:00:00"
    assert str(one(A.period_end(F.lit("2024")))) == "2025-01-01 00:00:00"
    assert str(one(A.period_end(F.lit("2024-05")))) == "2024-06-01 00:00:00"
    assert one(A.parse_num(F.lit(' "3.5" '))) == 3.5
    assert one(A.parse_num(F.lit("3 apples"))) is None
    assert one(A.fold_udf(F.lit("Zürich"))) == "Zurich"
    assert one(A.properties_text(F.create_map(F.lit("place"), F.array(F.lit("[[Notes/Places/Zurich|Z]]")), F.lit("icon"), F.array(F.lit("x")), F.lit("d"), F.array(F.lit("2024-01-01"))))) == "Zurich"
    assert one(A.filename_date(F.lit("a/2024-13-01 x.md"))) is None
    assert one(A.fuzzy_distance(F.lit("ab"))) == 0 and one(A.fuzzy_distance(F.lit("abcd"))) == 1 and one(A.fuzzy_distance(F.lit("abcdef"))) == 2 and one(A.fuzzy_distance(F.lit("ab2cdef"))) == 0


def test_atoms_and_headings():
    text = "para one\nstill\n\n```py\n# no heading\n\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> quote\n> more\n\n~~~\n```\nopen"
    assert [a.kind for a in M.atoms(text)] == ["paragraph", "fence", "table", "callout", "fence"]
    assert [h[2] for h in M.headings("# A\n```\n# no\n```\n## B ##\n")] == ["A", "B"]


def test_frontmatter_and_tags():
    raw = "﻿---\ntags: [a, B]\nalias: X, y\ncreated: 2024-01-02T10:00\nplace:\n  - one\n  - two\n---\nbody #c/d `#no` %%#hid%% #12 x#y\n"
    props, body, lines = M.frontmatter(raw)
    assert props["place"] == ["one", "two"] and lines == 8
    assert M.tags(props, body) == ["a", "B", "c/d"]
    assert M.aliases(props) == ["X", "y"]
    assert M.created(props) == "2024-01-02"
    assert set(M.properties(props)) == {"created", "place"}


def test_sections_and_cleaning():
    long = "word " * 20
    chunks, _ = M.chunk_note(f"# One\nshort\n# Two\n{long}\n## Three\n{long}\ntiny\n# End\nx", "dir/Note.md")
    assert [c.title for c in chunks] == ["Note > Two", "Note > Two > Three"]
    assert "short" in chunks[0].content and "End" in chunks[-1].content
    assert M.chunk_note("", "a.md")[0][0].lexical_only
    assert M.clean("see [[a/b|c]] ![[i.png]] [t](u) <b>x</b> https://www.example.com/5th+St?q") == "see c t x example 5th St"
    assert M.clean_body("```\n[[x]]\n```") == "```\n[[x]]\n```"
    assert "a/b" in M.link_terms("[[a/b|c]]")
    assert M.dense_suffix("Note", {"place": ["Zurich"], "again": ["zurich"], "d": ["2024-01-01"]}) == "Zurich"
    assert M.base_views('filters:\n  and:\n    - file.hasTag("book")\nviews:\n  - type: table\n    name: Reading\n    filters:\n      - status == "open"\n')[1] == ("Reading", "open")


def test_budget_parts_stay_within():
    count = lambda t: len(t.split())
    c = M.Chunk("T", "\n\n".join(["p " * 30] * 8 + ["```\n" + "code line here\n" * 40 + "```", "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 60]))
    parts = M.within_budget(c, count, 100)
    assert len(parts) > 3
    assert all(count(p.content) <= 100 for p in parts)
    assert all(a.text.startswith("```") and a.text.endswith("```") for p in parts for a in M.atoms(p.content) if a.kind == "fence")


def test_passages():
    text = "First one here. The second has a Reat in it! Third.\nLine four"
    assert [text[a:b] for a, b in P.sentences(text)] == ["First one here.", "The second has a Reat in it!", "Third.", "Line four"]
    a, b, _ = P.best_passage(text, P.passage_terms("reat"))
    assert "Reat" in text[a:b]
    assert P.snippet("x " * 300 + "needle " + "y " * 300, "needle").count("needle") == 1
    assert P.highlights("of reat `reat` Reating", ["reat", "of", "x"]) == [(3, 7), (15, 22)]
    assert P.shown_aliases(["Base", "a", "A", "b", "c"], "base", 2, "c") == (["c", "a"], 1)
    assert P.link("n", "h", "a") == "[[n#h|a]]"
    assert len(P.mask("---\na: b\n---\nx `c`")) == len("---\na: b\n---\nx `c`")


def test_query_language():
    ctx = FilterContext(date_field="created", numeric_keys=frozenset({"price"}))
    text, f = FL.parse('reat #a/b tag:c path:"x y/*" [k:v] [k:"w"] [price>50] after:2024 before:2024-05 -junk -#t', ctx)
    assert text == "reat" and f.tags == ["a/b", "c"] and f.paths == ["x y/*"]
    assert f.properties == [("k", "v", False), ("k", "w", True)] and f.numeric == [("price", ">", 50.0)]
    assert (f.after, f.before, f.exclude) == ("2024", "2024-05", ["junk"])
    assert FL.parse(FL.serialise(f, text), ctx) == (text, f)
    assert FL.parse("after:2024 x") == ("after:2024 x", None)
    assert FL.parse("[name>5]")[1].impossible
    assert FL.parse("-the x") == ("-the x", None)
    assert FL.pill_error("name", ">5", ctx) and not FL.pill_error("price", ">5", ctx)


def test_config():
    assert config.pool_caps(5000) == {"dense": 200, "lexical": 100, "recency": 50}
    assert config.pool_caps(10**9) == {"dense": 800, "lexical": 400, "recency": 50}
    assert config.nearest_preset(0.09) == "high"
    assert config.migrate_settings({"rev": 1, "a": 1}, [(1, lambda s: {**s, "a": 0}), (3, lambda s: {**s, "b": 2})]) == {"rev": 3, "a": 1, "b": 2}
    with pytest.raises(ValueError):
        config.RankingConfig(epsilon=-1)
    assert L.stamp_matches({k: 1 for k in L.STAMP}, {k: 1 for k in L.STAMP}) and not L.stamp_matches({}, {})
    assert MT.should_reconcile("a", "a", True) and not MT.should_reconcile("a", "a", False)
    assert MT.may_stamp("delta", True) and not MT.may_stamp("delta", False)


def test_periodic():
    found = T.find_period([i * 60_000.0 for i in range(8)], [2000.0] * 8)
    assert found["n"] == 8 and found["period_ms"] == 60_000
    assert T.find_period([0.0, 5.0], [2000.0, 2000.0]) is None


def test_names_as_the_index_reads_them(spark):
    cover = lambda q, t: spark.range(1).select(S.title_cover(F.lit(q), F.lit(t)).alias("x")).first().x
    for query, title, want in [("the forest", "the forest park", 1 / 3), ("parks", "City Park", 1 / 2), ("cafe", "Café", 1), ("gpt4", "GPT-4", 1 / 2), ("of the", "of the", 1), ("forest lake", "forest", 0)]:
        assert cover(query, title) == pytest.approx(want), (query, title)
    got = spark.range(1).select(S.title_boost(F.lit("green park"), F.lit("a/b/Green Park.md"), F.array(F.lit("x")), 0.5).alias("b"), S.title_match(F.lit("x"), F.lit("a/Green.md"), F.array(F.lit("x"), F.lit("x y"))).alias("m")).first()
    assert got.b == 0.5 and tuple(got.m) == (0.0, "x")


def test_sentences_of_any_script():
    text = 'Привет мир. Как дела? "Хорошо." (Да!) ok. no\nx. Y'
    assert [text[a:b] for a, b in P.sentences(text)] == ["Привет мир.", "Как дела?", '"Хорошо."', "(Да!) ok. no", "x.", "Y"]


def test_tags_suffixes_and_views():
    assert M.inline_tags("#ok #2026/06 #12 #a\u2019b x#y `#c` %%#d%% #e/f/ #g//h") == ["ok", "a", "e/f", "g"]
    props = {"a": ["2024-01-02 trip to Rome"], "b": ["yes"], "c": ["see https://x.y/z"], "d": ["48.1, 11.5"], "e": ["2024-01-02"], "f": ["Notes"]}
    assert M.dense_suffix("Note", props) == "2024-01-02 trip to Rome"
    assert M.clean("[![alt](i.png)](https://x.y) <https://a.b/c> end") == "alt end"
    assert M.clean_body("---\n\ntext\n\n<br>\n\nmore") == "text\n\nmore"
    assert M.link_terms("[[a/b#c|d]] [t](u/v) https://e.f/g") == "a/b#c u/v https://e.f/g"
    raw = "filters:\n  and:\n    - 'tag == \"plan\"'\n    - \"!x.isEmpty()\"\nviews:\n  - type: table\n    name: Grid\n    filters:\n      or:\n        - kind == \"loose\"\n  - type: cards\n    name: View 2\n    filters:\n      and:\n        - kind == \"own\"\n        - n == \"12\"\n"
    assert [(c.title, c.content) for c in M.base_docs(raw, "d/Base.base")] == [("Base", "Base plan loose"), ("Base > View 2", "Base plan own View 2")]


def test_periods_as_runs():
    found = T.find_period([i * 60_000.0 for i in range(5)], [5000.0] * 5)
    assert (found["n"], found["period_ms"], found["median_ms"], found["jitter_ms"]) == (5, 60_000, 5000, 0)
    assert T.find_period([0.0, 10_000.0, 20_000.0, 30_300.0, 40_600.0], [2000.0] * 5)["n"] == 5
    assert T.find_period([0.0, 10_000.0, 20_600.0, 31_200.0], [2000.0] * 4) is None


def test_query_forms_side_by_side():
    ctx = FilterContext(numeric_keys=frozenset({"n"}))
    text, f = FL.parse('[a:b][n: >5]#x x#y tag:#p/q path:"a b" [bad [k:"v w"] end', ctx)
    assert f.properties == [("a", "b", False), ("k", "v w", True)] and f.numeric == [("n", ">", 5.0)]
    assert f.tags == ["p/q"] and f.paths == ["a b"] and text == "#x x#y [bad end"
