"""Snippets, passages, highlights and display forms (PR1-PR11)."""

from __future__ import annotations

import math
import re

import regex
from notelake.functions.analyzer import STOPWORDS, tokenize

# What may close a sentence behind its last mark, and open the next one beside capitals and numbers.
CLOSERS, OPENERS = "\"'”’)]}»", "\"'“‘([{«"
_END = regex.compile(rf"[.!?…][.!?…{regex.escape(CLOSERS)}]*+(?=\s*\Z|\s+[\p{{Lu}}\p{{N}}{regex.escape(OPENERS)}])")


def sentences(text: str) -> list[tuple[int, int]]:
    """PR1: trimmed spans; a sentence ends at a line end, or at closing marks before a capital, number or opening mark of any script."""
    out, at = [], 0
    for line in text.split("\n"):
        start = 0
        for cut in [*[m.end() for m in _END.finditer(line)], len(line)]:
            piece = line[start:cut]
            a, b = at + start + len(piece) - len(piece.lstrip()), at + start + len(piece.rstrip())
            if b > a:
                out.append((a, b))
            start = cut
        at += len(line) + 1
    return out


def passage_terms(query: str, fraction=None) -> list[tuple[str, float]]:
    """PR2: (lower-case token of two letters or more, idf); idf is 1 where no fraction is known."""
    out = {}
    for t in tokenize(query, derived=False):
        low = t.lower()
        f = fraction(low) if fraction else None
        if len(low) > 1:
            out[low] = math.log(1 + (1 - f) / f) if f else 1.0
    return list(out.items())


def passage_score(sentence: str, start: int, terms: list[tuple[str, float]]) -> float:
    """PR3."""
    words = [w.lower() for w in tokenize(sentence, derived=False)]
    total = sum(idf * (tf := min(32, words.count(t))) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(sentence) / 87)) for t, idf in terms if t in words)
    return total * (1 + 1 / math.log(87 + start))


def best_passage(text: str, terms: list[tuple[str, float]]) -> tuple[int, int, float] | None:
    best = None
    for a, b in sentences(text):
        s = passage_score(text[a:b], a, terms)
        if s > 0 and (best is None or s > best[2]):
            best = (a, b, s)
    return best


def window(text: str, terms: list[tuple[str, float]], size: int) -> tuple[int, int]:
    """PR4: from the best sentence; slid to 40 before the first match if that would fall outside."""
    found = best_passage(text, terms)
    if not found:
        return 0, min(size, len(text))
    start = found[0]
    m = re.search("|".join(rf"\b{re.escape(t)}" for t, _ in terms), text[start:], re.I)
    if m and m.end() > size:
        start = max(0, start + m.start() - 40)
    return start, min(len(text), start + size)


def sanitise(md: str) -> str:
    """PR6: no display mathematics, embeds, table lines or fence marks."""
    t = re.sub(r"\$\$[\s\S]*?\$\$|!\[\[[^\]]*\]\]", " ", md)
    return "\n".join(x for x in t.split("\n") if not re.match(r"^\s*(\|.*\|\s*$|`{3,}|~{3,})", x))


def snippet(content: str, query: str, size: int = 200) -> str:
    """PR5."""
    text = sanitise(content) or re.sub(r"\s+", " ", content)
    a, b = window(text, passage_terms(query), size)
    return ("…" if a else "") + re.sub(r"\s+", " ", text[a:b]).strip() + ("…" if b < len(text) else "")


def mask(content: str) -> str:
    """PR7: what is not body text is blanked, length kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    for p in (r"\A---\n[\s\S]*?\n---(?=\n|\Z)", r"!\[\[[^\]]*\]\]", r"(?<=\]\()[^)]*(?=\))", r"```[\s\S]*?```", r"`[^`\n]*`"):
        content = re.sub(p, blank, content)
    return content


def highlights(content: str, words: list[str], start: int = 0, end: int | None = None, limit: int = 32) -> list[tuple[int, int]]:
    """PR8: sorted, disjoint ranges of words that begin with a token; no more than ``limit`` for each."""
    text = mask(content).lower()
    end = len(text) if end is None else end
    found = []
    for w in words:
        if len(w) < 2 or w in STOPWORDS:
            continue
        spans = [m.span() for m in re.finditer(rf"\b{re.escape(w)}\w*", text) if start <= m.start() < end]
        found += spans[:limit]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def shown_aliases(names: list[str], base: str, limit: int, matched: str | None = None) -> tuple[list[str], int]:
    """PR10: aliases other than the name, the matched one first if it would be hidden; and how many are."""
    own = list({a.lower(): a for a in reversed(names) if a.strip() and a.lower() != base.lower()}.values())[::-1]
    if matched in own and own.index(matched) >= limit:
        own.remove(matched)
        own.insert(0, matched)
    return own[:limit], max(0, len(own) - limit)


def link(base: str, heading: str | None = None, alias: str | None = None) -> str:
    """PR11."""
    return f"[[{base}{'#' + heading if heading else ''}{'|' + alias if alias else ''}]]"
