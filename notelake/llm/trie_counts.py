"""Token counts by trie-shared dynamic programming (op 2).

A unigram vocabulary gives every piece a score; a pre-token is cut so that the
sum of scores is largest (then so that it has fewest tokens).  The best score up
to a place depends only on the letters before it, so the distinct pre-tokens of
a batch go into a trie, in sorted order, and the forward step is done once for
each trie node.  Only the nodes on the way to the current pre-token are held.
Each terminal node's count is kept and the texts' counts are sums of those.

Scores come from the order of a public vocabulary, -ln(rank + 2) in millionths,
as integers, so sums are exact and ties are true ties.  A letter outside the
vocabulary costs its UTF-8 bytes as byte tokens.

Defined cases: null text counts as empty (no pre-tokens, no tokens); a very long
pre-token takes linear time; rows are counted one by one, so repeated rows, ties,
empty tables and further columns need no rule.
"""

from __future__ import annotations

import math
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import held, small_batches

REMEMBERED = 300_000
RESULT = "struct<n_pretokens: long, n_tokens: long>"
MARK = "▁"


class Scores:
    """The pieces of a vocabulary file, their scores and the cost of a byte."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.of = {sp.id_to_piece(i): -round(1e6 * math.log(i + 2)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.byte = -round(1e6 * math.log(n + 2))
        self.longest = max(map(len, self.of))


def forward(scores: Scores, text: str, best: list[tuple[int, int]]) -> None:
    """Extend ``best`` (score, minus tokens; by prefix length) to the whole of ``text``."""
    of, longest = scores.of, scores.longest
    for j in range(len(best), len(text) + 1):
        n = len(text[j - 1].encode("utf-8", "replace"))
        s, c = best[j - 1]
        top = (s + n * scores.byte, c - n)
        for i in range(max(0, j - longest), j):
            own = of.get(text[i:j])
            if own is not None and (new := (best[i][0] + own, best[i][1] - 1)) > top:
                top = new
        best.append(top)


def trie_counts(scores: Scores, words: list[str]) -> dict[str, int]:
    """Tokens of each distinct word; forward scores are shared along common beginnings."""
    best: list[tuple[int, int]] = [(0, 0)]
    before, out = "", {}
    for w in sorted(words):
        text = MARK + w
        same = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(before, text, strict=False)))
        del best[same + 1 :]
        forward(scores, text, best)
        out[w] = -best[-1][1]
        before = text
    return out


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text") -> Column:
    """A column of ``RESULT`` for ``docs``."""
    with open(model_path, "rb") as f:
        model = small_batches(docs).sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: less than a MB

    def run(texts: pa.Array) -> pa.Array:
        scores, counts = held(("trie", model.value), lambda: (Scores(model.value), {}))
        pre, tokens, at = [], [], 0
        while at < len(texts):
            cut, n_words = [], 0
            while at < len(texts) and n_words < 400_000:
                cut.append(texts[at].as_buffer().to_pybytes().split() if texts[at].is_valid else [])
                n_words += len(cut[-1])
                at += 1
            if len(counts) > REMEMBERED:
                counts.clear()
            fresh = {w: w.decode("utf-8", "replace") for own in cut for w in own if w not in counts}
            made = trie_counts(scores, list(set(fresh.values())))
            counts.update({w: made[t] for w, t in fresh.items()})
            for own in cut:
                pre.append(len(own))
                tokens.append(int(np.fromiter(map(counts.__getitem__, own), np.int64, len(own)).sum()))
        return pa.StructArray.from_arrays([pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], names=["n_pretokens", "n_tokens"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT).asNondeterministic()(F.col(text_col))
