"""Operators of notelake.llm against brute force, round trips and odd inputs."""

import hashlib
import itertools
import json
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.llm import bpe_automaton, chat_tree, common, components, decontaminate, entry, feistel, fertility, jaccard_join, pii_boost, secret_cnn, trie_counts, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, node long, pii string"
LONG = "very " * 30_000 + "x" * 50_000 + " 1" * 20_000 + " a@b" + ".c" * 20_000 + " " + "9" * 30_000


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, "clash") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "One TWO"), (6, "\u00e9t\u00e9 \u65e5\u672c \U0001f600"), (7, LONG), (None, "no id here at all and more"), (8, "a b c d e f g h"), (8, "another text under the same id")]


# --- chats -----------------------------------------------------------------
def chat_digests(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for c, own in convs.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_tree.format_turn(r, t)) for _, r, t in own))
    return out


def test_turns_round_trip():
    for text in ("", "\\", "\\### Assistant: </turn> ok", "###", " </turn>\n", "a\n# b: c\\", "</turn></turn>"):
        assert chat_tree.read_turn(chat_tree.format_turn("us:er\\#", text)) == ("us:er\\#", text)


@pytest.mark.parametrize("pack", [1, 200, 10**6])
def test_chats_share_and_read_back(spark, pack):
    r = random.Random(5)
    rows = [(c, k, ["user", "assistant"][k % 2], f"t{r.randint(0, 2)} </turn> #" if k else "same start") for c in range(40) for k in range(r.randint(1, 5))]
    rows += [(100, 0, None, None), (101, None, "user", "x"), (101, 0, "assistant", "\u00e9" * 3000), (102, 1, "user", "tie"), (102, 1, "user", "tie"), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, leaf string")
    stream, ends = chat_tree.format_chats(df, pack)
    got = {x.conv_id: tuple(x[2:]) for x in ends.join(chat_tree.read_back(stream), "leaf").select("conv_id", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert got == chat_digests(rows)
    nodes = stream.collect()
    for own in {n.pack for n in nodes}:
        pack_nodes = {n.seq: n for n in nodes if n.pack == own}
        for n in pack_nodes.values():
            above, at = [], n.parent
            while at is not None:
                above.append(pack_nodes[at])
                at = pack_nodes[at].parent
            assert n.position == sum(a.chars for a in above)
            assert {i for s in n.attends for i in range(s.start, s.end)} == {i for a in above for i in range(a.start, a.start + a.chars)}
        assert len({(n.parent, n.segment) for n in pack_nodes.values()}) == len(pack_nodes)
    assert chat_tree.read_back(chat_tree.format_chats(df.limit(0))[0]).count() == 0


# --- token counts ----------------------------------------------------------
def test_trie_counts_match_plain_search(spark):
    scores = trie_counts.Scores(open(entry.PIECES, "rb").read())
    r = random.Random(1)
    words = ["".join(r.choice("abeinrst\u00e9\u65e5") for _ in range(r.randint(1, 9))) for _ in range(300)]

    def plain(text):
        best = [(0, 0)] + [None] * len(text)
        for j in range(1, len(text) + 1):
            n = len(text[j - 1].encode())
            options = [(best[j - 1][0] + n * scores.byte, best[j - 1][1] - n)]
            options += [(best[i][0] + scores.of[text[i:j]], best[i][1] - 1) for i in range(j) if text[i:j] in scores.of]
            best[j] = max(options)
        return -best[-1][1]

    assert trie_counts.trie_counts(scores, words) == {w: plain("\u2581" + w) for w in words}
    df = docs_of(spark, ODD)
    got = df.select("text", trie_counts.token_counts(df, entry.PIECES).alias("c")).collect()
    for x in got:
        own = (x.text or "").encode().split()
        assert x.c.n_pretokens == len(own)
        if len(own) < 100:
            assert x.c.n_tokens == sum(plain("\u2581" + w.decode()) for w in own)
    assert df.limit(0).select(trie_counts.token_counts(df, entry.PIECES)).count() == 0


# --- quality ---------------------------------------------------------------
def base_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_figures(spark):
    r = random.Random(3)
    texts = [*ODD, *[(100 + i, "".join(r.choice(["a ", "b ", "c\n", "d ", "#x ", "\n", "\u00e9 "]) for _ in range(r.randint(0, 300)))) for i in range(80)]]
    df = docs_of(spark, texts)
    for x in df.select("text", fertility.quality(df, entry.PIECES).alias("q")).collect():
        want = base_figures(x.text or "")
        assert tuple(x.q)[:5] == want
        assert x.q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x.q.kept and x.q.base_failed)
    assert df.limit(0).select(fertility.quality(df, entry.PIECES)).count() == 0


def test_separators_between_words_are_rejected(spark):
    """Distinct words with a mark after every word go, in each fitted language; the same words as prose stay."""
    plain = {
        "en": "when the old ship came back from sea all people of our town went down to meet her crew, because nobody had heard news since early spring; some brought bread, others flowers or warm coats, while children ran along a narrow wall and shouted names they knew well before any sailor could set foot on land again that quiet autumn evening.",
        "de": "als das alte Schiff vom Meer wieder kam, gingen alle Leute unserer Stadt hinunter zum Hafen, denn niemand hatte seit dem Winter Nachricht von ihm; einige brachten Brot, andere Blumen oder warme Decken, und Kinder liefen auf der Mauer entlang, riefen laut bekannte Namen, bevor ein Matrose seinen Fuß an Land setzen konnte, was sehr lange dauerte.",
        "es": "cuando el viejo barco regresó del mar toda la gente de nuestro pueblo bajó al puerto, porque nadie tenía noticias desde hace meses; unos llevaban pan, otros flores o mantas, mientras varios niños corrían sobre un muro estrecho y gritaban nombres conocidos antes que algún marinero pudiera poner pie en tierra firme aquella tranquila tarde sin viento.",
        "fr": "quand le vieux bateau revint de la mer tous les gens du village descendirent au port, car personne ne savait rien depuis cet hiver; certains portaient pain, d'autres fleurs ou manteaux chauds, pendant que des enfants couraient sur un mur étroit et criaient leurs noms avant qu'aucun marin puisse poser pied à terre ce soir-là sans vent.",
    }
    rows = [(10 * i + k, mark.join(dict.fromkeys(text.split())), lang) for i, (lang, text) in enumerate(plain.items()) for k, mark in enumerate((" ", " | "))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = df.select("doc_id", fertility.quality(df, entry.PIECES).alias("q")).collect()
    assert not any(x.q.base_failed for x in got)
    assert [x.q.kept for x in got] == [True, False] * 4
    assert all((x.q.same_end > 0.45) == (x.doc_id % 10 == 1) for x in got)


# --- URLs ------------------------------------------------------------------
def test_columns_with_clashing_names(spark):
    """Ops 4, 7 and 8 keep columns of any names, but for those of their results."""
    pages = spark.createDataFrame([(1, "http://b.org/es/", "r", "a", "v", "d.t", 1)], "page_id long, url string, rule string, action string, digest string, `a.b` string, full long")
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, action string")
    got = url_rules.judge_urls(pages, rules)
    assert got.columns == ["page_id", "url", "action", "digest", "a.b", "full", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == (1, "http://b.org/es/", "a", "v", "d.t", 1, "b.org", "/es/", "org/es/", "block")
    docs = spark.createDataFrame([(1, "x", 5, 6, 7, 8, 9), (None, None, 5, 6, 7, 8, 9)], "doc_id long, text string, _before long, _at long, _place long, row_number long, row long")
    got = feistel.shard(docs, ["doc_id"], 2)
    assert got.columns == ["doc_id", "text", "_before", "_at", "_place", "row", "row_number", "position", "shard", "slot"]
    assert sorted((x.row_number, x.doc_id, x["_before"], x["_at"], x["_place"], x.row) for x in got.collect()) == [(0, None, 5, 6, 7, 9), (1, 1, 5, 6, 7, 9)]
    docs = spark.createDataFrame([(1, "a@b.c", "x", "y", "z")], "doc_id long, text string, _p_text string, pii string, _row string")
    assert pii_boost.personal_data(docs).columns == ["doc_id", "text", "_p_text", "_row", "pii"]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q#f", "http://example.com/en/6", "https://net/de/", "https://xnet/de/", "http://a.example.net/de/81", "http://example.net/de/9", "ftp://b.org/es", "ftp://b.org/es/#", "http://b.org?x=/es/", "x://" + "a." * 20000 + "com/en/" + "y" * 50000, "http://b.org/es/"]
    rows = [(i, u, "clash") for i, u in enumerate([*urls, urls[4]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, short string")
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, action string")

    def plain(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), a, h + p) for h, p, a in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, "allow")))

    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_rules.judge_urls(pages, rules).collect()}
    assert got == {i: plain(u) for i, u, _ in rows}
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {x.verdict for x in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# --- BPE -------------------------------------------------------------------
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(entry.WORD_BPE)
    lib.no_padding()
    lib.no_truncation()
    r = random.Random(2)
    parts = ["aaa", "the", "'s", "don't", "\u0391\u03a3", "\u0130", "e\u0301", "\u65e5\u672c", "<|endoftext|>", " ", "\n", "\x85", "\u00bd", "%%%", "\U0001f600", "ab", "ing", "9"]
    texts = [*ODD, *[(i + 50, "".join(r.choice(parts) for _ in range(r.randint(1, 14)))) for i in range(400)]]
    df = docs_of(spark, texts)
    out = df.select("text", bpe_automaton.bpe_digests(df, entry.WORD_BPE).alias("d"), bpe_automaton.bpe_encode(df, entry.WORD_BPE)["ids"].alias("ids"))
    for x in out.collect():
        want = lib.encode(x.text or "", add_special_tokens=False).ids
        assert x.ids == want
        decoded = lib.decode(want, skip_special_tokens=False)
        assert tuple(x.d) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert df.limit(0).select(bpe_automaton.bpe_digests(df, entry.WORD_BPE)).count() == 0


def test_automaton_is_deterministic():
    e = bpe_automaton.encoder(open(entry.WORD_BPE, encoding="utf-8").read())
    r = random.Random(4)
    for _ in range(200):
        word = [*[r.choice("abeinrst") for _ in range(r.randint(1, 12))]]
        own = e.automaton.encode([*word[:-1], word[-1] + "</w>"])
        assert "".join(e.labels[i] for i in own) == "".join(word) + "</w>"
        state = e.automaton.start
        for token in own:
            state = e.automaton.step(state, token)
            assert state == e.automaton.target[token]


def test_runs_side_by_side_equal_single_runs():
    e = bpe_automaton.encoder(open(entry.WORD_BPE, encoding="utf-8").read())
    r = random.Random(5)
    words = [*{"".join(r.choice("abeinrst\u00e9\u65e5'%9") for _ in range(r.randint(1, 20))).encode() for _ in range(2_000)}, "\u00ff".encode(), b"a", b"a" * 300]
    for _ in range(2):  # once with cells read from the differences, once with those remembered
        ids, ends = e.automaton.encode_all(words)
        for w, own in zip(words, np.split(ids, ends[:-1]), strict=True):
            alone = [e.bytes[b] for b in w]
            assert own.tolist() == e.automaton.encode([*alone[:-1], alone[-1] + "</w>"])


def test_memory_of_chunks_turns_over(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe_automaton, "REMEMBERED", 40)
    monkeypatch.setattr(bpe_automaton, "WORDS", 20)
    monkeypatch.setattr(bpe_automaton, "CHUNKS", 15)
    monkeypatch.setattr(bpe_automaton, "AT_ONCE", 300)
    lib = Tokenizer.from_file(entry.WORD_BPE)
    e = bpe_automaton.Encoder(open(entry.WORD_BPE, encoding="utf-8").read())
    single = []
    monkeypatch.setattr(e.automaton, "encode", lambda w, f=e.automaton.encode: single.append(w) or f(w))
    r = random.Random(6)
    texts = [None, "", *["".join(r.choice(["ab", "ing", "\u00c9", "9", "'s", "%", " ", " ", "\x85", "Er"]) for _ in range(r.randint(1, 60))) for _ in range(300)]]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [list(map(int, x.split())) for x in bpe_automaton._lines(e, pa.array(texts))] == want
    assert len(e.ids) <= 40 and len(e.words) <= 20 and not single
    odd = ["x" * 70 + "<|endoftext|>y", "<|endoftext|>\x85", "<|endoftext|>", "<a>"]
    assert list(bpe_automaton._lines(e, pa.array(odd))) == [" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)).encode() for t in odd]


def test_newer_letters_equal_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(entry.WORD_BPE)
    lib.no_padding()
    lib.no_truncation()
    e = bpe_automaton.encoder(open(entry.WORD_BPE, encoding="utf-8").read())
    for c in (0x558, 0x58B, 0x1C89, 0x208F, 0xA7CB, 0xA7DC, 0x10940, 0x10D50, 0x16EA0, 0x18D80, 0x1E6C0, 0x323B0, 0xE0FFF):
        text = f"a{chr(c)}b {chr(c)} 1{chr(c)}"
        assert e.encode(text) == lib.encode(text, add_special_tokens=False).ids


# --- secrets ---------------------------------------------------------------
def base_secrets(text):
    out = []
    for k, (name, p) in enumerate((("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))):
        for m in re.finditer(p, text, re.A):
            if (k == 0 and len(m[2]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24):
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secret_spans(spark):
    r = random.Random(6)
    parts = ["token = ", "api_key:", "Secret='", "x", "\u00e9\u65e5 ", "AKIA", "ABCD1234" * 3, "0123abcd" * 4, "/path/to/file ", "\n", "pass", "word", '"', "ghp_A8s9dKq2LmZ7xW4eRt6YuIoP3bN5", " "]
    texts = [*ODD, *[(i + 50, "".join(r.choice(parts) for _ in range(r.randint(1, 12)))) for i in range(300)]]
    df = docs_of(spark, texts)
    for x in df.select("text", secret_cnn.secret_spans(df).alias("s")).collect():
        want = base_secrets(x.text or "")
        assert x.s.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(x.s.spans.split(",")) | {""}
    assert df.limit(0).select(secret_cnn.secret_spans(df)).count() == 0
    assert secret_cnn.redact_secrets(df.limit(0)).columns == df.columns
    red = secret_cnn.redact_secrets(docs_of(spark, [(1, 'a token = "11acdfb36bb72224148e6160f674b4be45601bff" b'), (2, None), (3, "plain")])).collect()
    assert [x.text for x in red] == ['a [secret]" b', None, "plain"]


def test_recall_is_kept_where_precision_is_low():
    r = np.random.default_rng(1)
    scores, y = r.random(2_000), (r.random(2_000) < 0.5).astype(float)  # scores that say nothing
    assert (scores[y > 0.5] >= secret_cnn.calibrate(scores, y)).mean() >= secret_cnn.RECALL


def test_secrets_anywhere_in_a_run(spark):
    key = "A8s9dKq2LmZ7xW4eRt6YuIoP3bN5vQ1z"
    hidden = [f"see /api/v1/projects/customer-data/export/backup/{key} now", f"the_long_name_of_a_variable_in_the_code_base={key}", f"/srv/{'0123abcd' * 4}/projects/customer-data/{key}", "then pwd=hQ7x2Zk39dT and", 'auth: "Zk39dkQ1xW7"']
    plain = ["see /api/v1/projects/customer-data/export/backup/2024 now", "a-long-and-hyphenated-name-of-a-page-that-goes-on-2023-and-on-for-ever", "auth: required2day", "pwd=/home/user1"]
    got = [x.text for x in secret_cnn.redact_secrets(docs_of(spark, [*enumerate(hidden + plain)])).orderBy("doc_id").collect()]
    assert not [t for t in got[: len(hidden)] if key in t or "hQ7x2Zk39dT" in t or "Zk39dkQ1xW7" in t]
    assert got[len(hidden) :] == plain


def test_network_on_held_out_findings():
    net = secret_cnn.trained()
    x, y = secret_cnn.labelled(1500, seed=99)
    taken = net.score(x) >= net.threshold
    assert (y[taken] > 0.5).mean() > 0.97
    assert taken[y > 0.5].mean() > 0.9


# --- sharding --------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_permutes(n):
    p = feistel.permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    assert feistel.invert(p, n, 5).tolist() == list(range(n))


def test_shards(spark):
    df = docs_of(spark, [*ODD, *[(20, "same")] * 300, *[(i, f"t{i}") for i in range(100, 400)]]).select("doc_id", "text", "h")
    out = feistel.shard(df.withColumn("size", feistel.text_size(F.col("text"))), ["doc_id", "text"], 7).collect()
    assert sorted((x.row_number for x in out)) == list(range(len(out)))
    n = len(out)
    assert all(x.position == int(feistel.permute(np.array([x.row_number]), n, 42)[0]) for x in out)
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert feistel.shard(df.limit(0), ["doc_id"], 7).count() == 0


# --- personal data ---------------------------------------------------------
def base_personal(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))

    def luhn(d):
        t = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            t += v - 9 if v > 9 else v
        return t % 10 == 0

    def fits(k, m):
        d = re.sub("[^0-9]", "", m)
        return k == "email" or (k == "ip" and all(int(p) <= 255 for p in m.split("."))) or (k == "card" and 13 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 9 <= len(d) <= 15)

    return [f"{k}:{m.start()}:{m.end()}" for k, p in kinds for m in re.finditer(p, text) if fits(k, m[0])]


def test_personal_data(spark):
    r = random.Random(8)
    parts = ["a", ".b", "@c", "_d", "-", "1", "22", ".", "4111 1111 1111 1111", "+1 (555) 222-3333", "192.168.0.1", "300.1.2.3", "\u00e9\U0001f600", " ", "\n", "call ", "x@y.z", "007.08.009.255"]
    texts = [*ODD, (9, "1.2.3.4 " * 2_000), *[(i + 50, "".join(r.choice(parts) for _ in range(r.randint(1, 25)))) for i in range(300)]]
    df = docs_of(spark, texts)
    out = pii_boost.personal_data(df).select("text", pii_boost.span_text().alias("base"), pii_boost.span_text(more=True).alias("spans"))
    for x in out.collect():
        want = base_personal(x.text or "")
        assert x.base == ",".join(want), x.text[:200]
        assert set(want) - {""} <= set(x.spans.split(","))
    more = docs_of(spark, [(1, "please call 555-123-4567 today"), (2, "her SSN 123-45-6789 is"), (3, "nothing at 12 o'clock")])
    assert [x.s for x in pii_boost.personal_data(more.drop("pii")).select(pii_boost.span_text(more=True).alias("s")).collect()] == ["nphone:12:24", "ssn:8:19", ""]
    assert pii_boost.personal_data(df.limit(0)).count() == 0


def test_features_agree_with_sql(spark):
    own = pii_boost.findings(300, seed=77)
    df = spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(own)], "i int, kind string, t string, b string, a string")
    for kind in pii_boost.PROPOSED:
        cols = pii_boost._feature_columns(kind, F.col("t"), F.expr(f"right(b, {pii_boost.CONTEXT})"), F.substring("a", 1, pii_boost.AFTER))
        for x in df.where(F.col("kind") == kind).select("i", F.array(*cols).alias("x")).collect():
            assert x.x == pii_boost.features(*own[x.i][:4]), own[x.i]


def test_ensemble_on_held_out_findings():
    trees, threshold = pii_boost.fitted()
    x, y = pii_boost.labelled(1_500, seed=99)
    taken = [sum(pii_boost.RATE * pii_boost.run_tree(t, row) for t in trees) >= threshold for row in x]
    right = sum(1 for a, b in zip(taken, y, strict=True) if a and b)
    assert right / sum(taken) > 0.95
    assert right / sum(y) > 0.85


def test_overlapping_proposals_go_left_to_right(spark):
    """A drops B, which it overlaps; C, which only B overlaps, stays."""
    text = "call 555-234-5678 or (212) 555-0188; bank account no 5551234567, IBAN DE89370400440532013000."
    got = pii_boost.personal_data(docs_of(spark, [(1, text)])).select(pii_boost.span_text(more=True).alias("s")).first().s.split(",")
    spans = sorted(tuple(map(int, x.split(":")[1:])) for x in got)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {x.split(":")[0] for x in got} == {"nphone", "number", "iban"} and len(got) == 4


# --- joins -----------------------------------------------------------------
def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [j for m, (j, _) in enumerate(sets) if find(m) == find(k) and j is not None]
        out.append((i, len(s), min(ids) if ids else None))
    return Counter(out)


def near_copies(seed, n=120):
    r = random.Random(seed)
    bases = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        own = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = r.choice(["x", "Y", f"w{r.randint(0, 400)}"])
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("group", "block"), [(1, 300), (32_768, 262_144)])
def test_jaccard_components(spark, monkeypatch, group, block):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [*ODD, *near_copies(1), *[(900 + i, "the same few words again and again here") for i in range(60)]]
    got = Counter(map(tuple, jaccard_join.jaccard_join(docs_of(spark, rows)).collect()))
    assert got == brute_components(rows)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_join(docs_of(spark, ODD).limit(0)).count() == 0


def test_blocks_of_passages_and_chains(spark, monkeypatch):
    """Texts around one long passage, and copies that drift away from each other; parts of a few sets each."""
    monkeypatch.setattr(jaccard_join, "GROUP", 200)
    monkeypatch.setattr(jaccard_join, "BLOCK", 400)
    r = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):
        own = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([8, 12, 18, 30]))]
        rows.append((i, " ".join(own + passage)))
    words = [f"c{i}" for i in range(100)]
    for i in range(100, 220):
        words = list(words)
        words[r.randrange(len(words))] = f"d{i}"
        rows.append((i, " ".join(words)))
    got = Counter(map(tuple, jaccard_join.jaccard_join(docs_of(spark, rows)).collect()))
    assert got == brute_components(rows)


def test_search_block_is_exact():
    r = random.Random(13)
    for _ in range(60):
        base = [r.sample(range(120), r.randint(4, 40)) for _ in range(4)]
        sets = []
        for _ in range(r.randint(2, 30)):
            own = set(r.choice(base))
            for _ in range(r.randint(0, 6)):
                own ^= {r.randrange(120)}
            sets.append(np.array(sorted(own or {1}), dtype=np.uint64))
        labels = [r.randrange(6) if r.random() < 0.5 else 100 + i for i in range(len(sets))] if r.random() < 0.5 else None

        def components(links):
            up = list(range(len(sets)))

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            first = {}
            for i, label in enumerate(labels or ()):
                up[find(i)] = find(first.setdefault(label, i))
            for a, b in links:
                up[find(a)] = find(b)
            return [[find(i) == find(j) for j in range(len(sets))] for i in range(len(sets))]

        whole = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(both := np.intersect1d(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - len(both))]
        assert components(jaccard_join.search_block(sets, 75, labels)) == components(whole)


def test_occurrences():
    r = random.Random(9)
    for _ in range(300):
        lists = [np.array(sorted(r.sample(range(60), r.randint(1, 40)))) for _ in range(r.randint(1, 15))]
        t = r.randint(1, 12)
        many = Counter(x for own in lists for x in own.tolist())
        want = sorted(x for x, n in many.items() if n >= t)
        assert jaccard_join.occurrences(lists, t).tolist() == want
        entries, counts = jaccard_join.heap_merge(lists, t, r.randint(1, 70))
        assert entries.tolist() == want and counts.tolist() == [many[x] for x in want]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (10, 9), (9, 8), (8, 11), *[(100 + i, 101 + i) for i in range(40)]]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 9: 8, 10: 8, 11: 8, **{i: 100 for i in range(101, 141)}}


# --- decontamination -------------------------------------------------------
def brute_hits(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for i, text in items:
            own = cut(text)
            for k in range(max(1, len(own) - 9) if own else 0):
                x = own[k : k + 10]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        found.add(str(i))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_decontamination(spark, monkeypatch, held):
    """By a shuffled join, and with the items held by every worker."""
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", held)
    r = random.Random(10)
    words = ["a", "b", "c", "D", "\u00e9"]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(1, some(14)), (2, some(3)), (3, None), (4, ""), (5, some(10)), (5, some(11)), (6, "b"), (10, some(12) + "."), (None, some(11))]
    texts = [None, "", "--", "b", *[some(r.randint(1, 60)) for _ in range(60)], items[0][1] + "! " + items[4][1], *[items[7][1]] * 3]
    df = docs_of(spark, list(enumerate(texts)))
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, node string")
    got = decontaminate.judged(df, bench).select("row.*", F.col("contamination").alias("d")).orderBy("doc_id").collect()
    want = brute_hits(texts, [("null" if i is None else i, t) for i, t in items])
    assert [(x.d.n_words, x.d.n_hit, x.d["items"]) for x in got] == want
    assert decontaminate.decontaminate(df, bench).count() == sum(1 for x in want if not x[1])
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(texts)
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(df, bench, drop=False).columns == [*df.columns, "contamination"]


def test_jaccard_passes(spark, monkeypatch):
    """Each pass holds a part of the tokens only; together they are all of them, and the links do not depend on their number."""
    rows = [*ODD, *near_copies(4)]
    texts = docs_of(spark, rows).select("text").coalesce(1)
    names = [f"t{i}" for i in range(jaccard_join.PARTS)]
    got = texts.mapInArrow(jaccard_join._prefixes(5, 75), "node long, n long" + "".join(f", {t} array<long>" for t in names)).collect()
    want = {jaccard_join.node_of(s): s for _, t in rows for _, s in jaccard_join.shingle_sets(pa.array([t], pa.string()), 5) if len(s)}
    assert len(got) == len(want) > 20
    for r in got:
        own, parts = want[r.node].view(np.int64), [r[t] for t in names]
        whole = own[: r.n - jaccard_join.required(r.n, 75) + jaccard_join.extra(r.n)]
        assert r.n == len(own) and sorted(sum(parts, [])) == sorted(whole.tolist())
        assert all(x % len(names) == i for i, t in enumerate(parts) for x in t)
    assert 0.15 < min(sum(len(r[t]) for r in got) for t in names) / sum(len(r[t]) for r in got for t in names)
    monkeypatch.setattr(jaccard_join, "PARTS", 3)
    assert Counter(map(tuple, jaccard_join.jaccard_join(docs_of(spark, rows)).collect())) == brute_components(rows)


def test_jaccard_tokens_travel_packed(spark):
    """Texts that share nothing: no row is moved for each of their tokens, and no more rows for longer texts."""
    r = random.Random(21)
    status = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def moved(words):
        stages = lambda: (x.apply(i) for x in [status.stageList(None, False, False, none, None)] for i in range(x.size()))
        rows = [(i, " ".join(str(r.random()) for _ in range(words))) for i in range(40)]
        docs = docs_of(spark, rows)
        last = max((x.stageId() for x in stages()), default=-1)
        got = Counter(map(tuple, jaccard_join.jaccard_join(docs).collect()))
        assert got == Counter((i, words - 4, i) for i, _ in rows)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > last)

    assert moved(400) < 40 * 0.25 * 400 / 2  # 64 buckets for each chunk, and rows of nodes


@pytest.mark.parametrize("bits", [1, 6, 24])
def test_jaccard_lists(monkeypatch, bits):
    """The tokens on lists of two nodes or more, from chunks of a few nodes; a node that comes twice counts once."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 50)
    r = random.Random(22)
    pool = [r.getrandbits(64) for _ in range(150)]
    sets = {i - 30: np.array(sorted({*r.sample(pool, r.randint(0, 8)), *(r.getrandbits(64) for _ in range(r.randint(1, 5)))}), dtype=np.uint64) for i in range(80)}
    nodes = [*sets, *list(sets)[:20]]
    rows = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(sets[i]) for i in nodes], pa.int64()), pa.array([2] * len(nodes), pa.int64()), jaccard_join._packed([sets[i] for i in nodes])], names=["node", "n", "least", "tokens"])
    chunks = list(jaccard_join._chunks(iter([rows])))
    assert len(chunks) > 5 and sum(c.column(1)[0].as_py() for c in chunks) == sum(map(len, sets.values()))
    asked = [x for c in chunks for b in jaccard_join._asked(bits)(iter([c.select(["chunk", "tokens"])])) for x in b.to_pylist()]
    asked.sort(key=lambda x: x["bucket"])
    assert max(x["bucket"] for x in asked) < 1 << bits
    answers = [x for b in jaccard_join._answered(pa.Table.from_pylist(asked, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("marks", pa.binary()), ("times", pa.binary())])).to_batches(7)) for x in b.to_pylist()]
    many = Counter(x for own in sets.values() for x in own.view(np.int64).tolist())
    got, lengths = {}, {}
    for c in chunks:
        own = [{"bucket": x["bucket"], "lengths": x["lengths"]} for x in sorted(answers, key=lambda x: x["bucket"]) if x["chunk"] == c.column(0)[0].as_py()]
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("lengths", pa.binary())]))
        full = pa.RecordBatch.from_arrays([c.column(2), c.column(3), pa.array([own], kind)], names=["nodes", "tokens", "answers"])
        for x in (x for b in jaccard_join._shared(bits)(iter([full])) for x in b.to_pylist()):
            assert x["n"] == len(sets[x["node"]]) and x["least"] == 2 and x["node"] not in got
            got[x["node"]] = sorted(y["token"] for y in x["on"])
            for y in x["on"]:
                assert lengths.setdefault(y["token"], y["df"]) == y["df"]
    want = {i: sorted(x for x in own.view(np.int64).tolist() if many[x] > 1) for i, own in sets.items()}
    assert got == {i: x for i, x in want.items() if len(x) >= 2} and 20 < len(got) < 80
    assert all(lengths[x] <= lengths[y] for x in lengths for y in lengths if many[x] <= many[y])


def test_a_tokenizer_worker_stays_small():
    words = ["".join(x) for x in itertools.islice(itertools.product("etaoinshrdlu", repeat=5), 100_000)]
    spec = json.dumps(json.load(open(entry.WORD_BPE, encoding="utf-8")) | {"newer": bpe_automaton.newer()})
    tracemalloc.start()
    try:
        e = bpe_automaton.Encoder(spec)
        for w in words:
            e.ids[(w + ",").encode()]
        held = tracemalloc.get_traced_memory()[0] / 1e6
    finally:
        tracemalloc.stop()
    assert held < 75, held
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(entry.WORD_BPE)
    for text in (words[7] + ",", words[7] + "7", words[7] + "'s", words[7] + "'", "a\x1c", "\x00", words[7] + "</w>", "<|endoftext|>x,<|endoftext|>"):
        want = lib.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == want
        assert b" ".join(filter(None, (e.ids[c] for c in text.encode().split()))).split() == [b"%d" % i for i in want]


def test_cutting_texts_takes_little_memory():
    texts = pa.array([" ".join(f"w{i}x{j}" for i in range(1_000)) for j in range(500)])
    tracemalloc.start()
    try:
        common._powers.clear()
        n = sum(len(s) for _, s in jaccard_join.shingle_sets(texts, 5))
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert n == 500 * 996
    assert most < 30, most
