"""Queries that SQL cannot express, over a whole table, against plain Python."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from notelake.llm import entry, feistel, pii_boost, secret_cnn, trie_counts
from tests.llm.test_operators import base_figures, base_personal, base_secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_token_counts(spark, texts):
    """The forward search, word by word, without a trie."""
    scores = trie_counts.Scores(open(entry.PIECES, "rb").read())
    known = {}

    def count(word):
        best = [(0, 0)]
        for j in range(1, len(word) + 1):
            n = len(word[j - 1].encode())
            options = [(best[j - 1][0] + n * scores.byte, best[j - 1][1] - n)]
            options += [(best[i][0] + scores.of[word[i:j]], best[i][1] - 1) for i in range(max(0, j - scores.longest), j) if word[i:j] in scores.of]
            best.append(max(options))
        return -best[-1][1]

    got = {x.doc_id: (x.n_pretokens, x.n_tokens) for x in entry.op2_token_counts(spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        own = [w.decode() for w in t.encode().split()]
        for w in set(own) - set(known):
            known[w] = count("\u2581" + w)
        want[i] = (len(own), sum(known[w] for w in own))
    assert got == want


def test_quality(spark, texts):
    got = entry.op3_fertility(spark, SF).collect()
    assert {x.doc_id for x in got} == set(texts)
    for x in got:
        want = base_figures(texts[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x.kept and x.base_failed)


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(entry.WORD_BPE)
    lib.no_padding()
    lib.no_truncation()
    got = {x.doc_id: tuple(x)[1:] for x in entry.op5_bpe_automaton(spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_secrets(spark, texts):
    got = entry.op6_secret_cnn(spark, SF).collect()
    assert {x.doc_id for x in got} == set(texts)
    for x in got:
        want = base_secrets(texts[x.doc_id])
        kinds = Counter(w.split(":")[0] for w in want)
        assert (x.n_assign, x.n_access, x.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert x.base_sha256 == sha(",".join(want))
        more = [w for w in x.spans.split(",") if w and w not in want]
        assert len([w for w in x.spans.split(",") if w]) == len(want) + len(more)
        assert all(w.startswith(secret_cnn.KINDS[3] + ":") for w in more)


def test_shards(spark, texts):
    got = entry.op7_feistel(spark, SF).collect()
    n = len(texts)
    order = sorted((i, zlib.crc32(t.encode()), len(t.encode()) + 16) for i, t in texts.items())
    at = feistel.permute(np.arange(n), n, 42).tolist()
    want = {i: (size, crc, "rows", p % 40, p // 40, None) for (i, crc, size), p in zip(order, at, strict=True)}
    assert {x.doc_id: tuple(x)[1:] for x in got} == want
    counts = Counter(x.shard for x in got)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts.get(k, 0) for k in range(40)) <= 1
    assert all(sorted(x.slot for x in got if x.shard == k) == list(range(counts[k])) for k in counts)


def test_personal_data(spark, texts):
    got = entry.op8_pii_boost(spark, SF).collect()
    assert {x.doc_id for x in got} == set(texts)
    for x in got:
        want = base_personal(texts[x.doc_id])
        kinds = Counter(w.split(":")[0] for w in want)
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(kinds[k] for k in pii_boost.BASE)
        assert x.base_sha256 == sha(",".join(want))
        spans = [w for w in x.spans.split(",") if w]
        assert spans[: len(want)] == want
        assert all(w.split(":")[0] in pii_boost.PROPOSED for w in spans[len(want) :])
