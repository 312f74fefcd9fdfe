"""Markdown as plain functions: atoms, sections, frontmatter, cleaning, budget (CH1-CH24, IO4-IO5)."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from notelake.functions.analyzer import DATE_ONLY, MACHINERY, is_tag, singular, tag_end, tokenize

MIN_SECTION = 50
BUDGET, OVERLAP = 512, 0.15
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FRONT = re.compile(r"^---\n(.*?\n)?---(?:\n|$)", re.S)


def normalise(text: str) -> str:
    """CH1."""
    return text.replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Atom:
    kind: str
    text: str


def atoms(text: str) -> list[Atom]:
    """CH2: paragraphs, fences, tables and callouts, in order; an open fence runs to the end."""
    out: list[Atom] = []
    lines, at = normalise(text).split("\n"), 0
    while at < len(lines):
        line, start = lines[at], at
        if not line.strip():
            at += 1
            continue
        fence = _FENCE.match(line)
        if fence:
            mark = fence[1]
            at += 1
            while at < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[at]):
                at += 1
            at += 1
            kind = "fence"
        elif line.lstrip().startswith(">"):
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                at += 1
            kind = "callout"
        elif "|" in line and at + 1 < len(lines) and "-" in lines[at + 1] and "|" in lines[at + 1] and _DELIMITER.match(lines[at + 1]):
            at += 2
            while at < len(lines) and "|" in lines[at] and lines[at].strip():
                at += 1
            kind = "table"
        else:
            while at < len(lines) and lines[at].strip() and not (at > start and (_FENCE.match(lines[at]) or lines[at].lstrip().startswith(">"))):
                at += 1
            kind = "paragraph"
        out.append(Atom(kind, "\n".join(lines[start : min(at, len(lines))])))
    return out


def headings(text: str) -> list[tuple[int, int, str]]:
    """CH3: (line, level, text) of ATX headings outside fences."""
    out, closing = [], None
    for i, line in enumerate(normalise(text).split("\n")):
        fence = _FENCE.match(line)
        if closing:
            if fence and fence[1][0] == closing[0] and len(fence[1]) >= len(closing) and not line.strip().strip(closing[0]):
                closing = None
        elif fence:
            closing = fence[1]
        elif m := _HEADING.match(line):
            out.append((i, len(m[1]), m[2]))
    return out


def frontmatter(raw: str) -> tuple[dict[str, list[str]], str, int]:
    """IO4: (properties, body, lines taken). Scalars, [a, b] and block lists only."""
    text = normalise(raw).removeprefix("﻿")
    m = _FRONT.match(text)
    if not m:
        return {}, text, 0
    out: dict[str, list[str]] = {}
    key = None
    for line in (m[1] or "").split("\n"):
        item, pair = re.match(r"^\s*-\s+(.*)$", line), re.match(r"^([^\s:#][^:]*):\s*(.*)$", line)
        if item and key is not None:
            out[key].append(_unquote(item[1]))
        elif pair:
            key, value = pair[1].strip(), pair[2].strip()
            if value.startswith("[") and value.endswith("]") and not value.startswith("[["):
                out[key] = [_unquote(v) for v in value[1:-1].split(",") if v.strip()]
            else:
                out[key] = [_unquote(value)] if value else []
    return out, text[m.end() :], text[: m.end()].count("\n")


def _unquote(v: str) -> str:
    v = v.strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def aliases(props: dict[str, list[str]]) -> list[str]:
    """CH9: aliases, and the older alias key split at commas, each once whatever its case."""
    own = [v for k, vs in props.items() if k.lower() == "aliases" for v in vs]
    own += [p.strip() for k, vs in props.items() if k.lower() == "alias" for v in vs for p in v.split(",")]
    return list({a.lower(): a for a in reversed(own) if a}.values())[::-1]


def inline_tags(body: str) -> list[str]:
    """CH11: free-standing tags outside fences, comments and code spans; not numbers."""
    text = "\n".join(a.text for a in atoms(body) if a.kind != "fence")
    found, at, before = [], 0, "\n"
    while at < len(text):
        if text.startswith("%%", at):
            close = text.find("%%", at + 2)
            at, before = (len(text) if close < 0 else close + 2), "."
        elif text[at] == "`" and (close := text.find("`", at + 1)) > 0 and "\n" not in text[at:close]:
            at, before = close + 1, "."
        elif text[at] == "#" and before.isspace() and (end := tag_end(text, at + 1)) > at + 1:
            found.append(text[at + 1 : end])
            at, before = end, text[end - 1]
        else:
            before = text[at]
            at += 1
    return _first([t for t in found if is_tag(t)])


def _first(values: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for v in values:
        seen.setdefault(v.lower(), v)
    return list(seen.values())


def tags(props: dict[str, list[str]], body: str) -> list[str]:
    """CH10."""
    own = [t.lstrip("#") for k, vs in props.items() if k.lower() in ("tags", "tag") for v in vs for t in re.split(r"[,\s]+", v) if t]
    return _first([*own, *inline_tags(body)])


def properties(props: dict[str, list[str]]) -> dict[str, list[str]]:
    """CH12."""
    return {k: v for k, v in props.items() if k.lower() not in ("tags", "aliases", "alias")}


def created(props: dict[str, list[str]]) -> str | None:
    """CH13."""
    m = re.search(r"\d{4}-\d{2}-\d{2}", " ".join(props.get("created", [])))
    return m[0] if m else None


_ASSET = re.compile(r"\.(png|jpe?g|gif|svg|webp|bmp|pdf|mp3|mp4|mov|wav|m4a|zip)$", re.I)


def _shown(inner: str, embed: bool = False) -> str:
    if "|" in inner:
        return inner.split("|", 1)[1].strip()
    target = re.split(r"[#^]", inner)[0].strip()
    return "" if embed and _ASSET.search(target) else target.split("/")[-1].strip()


def url_words(url: str) -> str:
    """CH17: a URL's readable words."""
    bare = re.split(r"[?#]", re.sub(r"(?i)^www\.", "", re.sub(r"(?i)^https?://", "", url)))[0]
    host, _, path = bare.partition("/")
    return re.sub(r"[^\w]+|_", " ", f"{re.sub(r'(?i)[.][a-z]{2,24}$', '', host)} {path}").strip()


#: Markup that shows less than it holds: embeds and wikilinks, images and links, addresses, HTML tags. Innermost ones first.
_MARKUP = re.compile(r"(?P<embed>!?)\[\[(?P<inner>[^\[\]]+)\]\]|!?\[(?P<label>[^\[\]]*)\]\((?P<address>[^()]*)\)|<(?P<auto>https?://[^\s<>]+)>|(?P<html></?[a-z][^>]*>)|(?P<url>\bhttps?://[^\s)<>\]]+)", re.I)


def _read(md: str) -> tuple[str, list[str]]:
    """What a reader sees of the markup, and what is dropped of it: a scan, repeated while markup stood within markup."""
    dropped: list[str] = []

    def show(m: re.Match) -> str:
        if m["inner"]:
            shown, target = _shown(m["inner"], bool(m["embed"])), m["inner"].split("|")[0].strip()
            if target != shown:
                dropped.append(target)
            return shown
        if m["label"] is not None:
            dropped.append(m["address"].strip())
            return m["label"].strip()
        if m["html"]:
            return " "
        dropped.append(m["auto"] or m["url"])
        return " " if m["auto"] else url_words(m["url"])

    while (shown := _MARKUP.sub(show, md)) != md:
        md = shown
    return md, [d for d in dropped if d]


def _is_rule(line: str) -> bool:
    marks = re.sub(r"[ \t]", "", line)
    return len(marks) > 2 and marks[0] in "-*_" and marks == marks[0] * len(marks)


def clean(md: str) -> str:
    """CH15: what a reader sees, without rules, with single spaces and one blank line at most."""
    lines = ["" if _is_rule(x) else re.sub(r"[^\S\n]+", " ", x).strip() for x in _read(md)[0].split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def clean_body(md: str) -> str:
    """CH16: fences stay as they are; what cleans to nothing goes."""
    return "\n\n".join(t for a in atoms(md) if (t := a.text if a.kind == "fence" else clean(a.text))).strip()


def link_terms(md: str) -> str:
    """CH18: link targets and addresses that cleaning drops, for the lexical side only."""
    return " ".join(d for a in atoms(md) if a.kind != "fence" for d in _read(a.text)[1])


# Words that say yes or no.
_SWITCHES = ("true", "false", "yes", "no", "on", "off")


def _says_nothing(value: str) -> bool:
    """A date, number, list of numbers, switch, address or file: no words to search for."""
    number = r"[+-]?\d+(?:\.\d+)?"
    parts = [p for p in re.split(r"[,\s]+", value) if p]
    return bool(value.lower() in _SWITCHES or re.match(DATE_ONLY, value) or re.search(r"(?i)https?://", value) or _ASSET.search(value) or all(re.fullmatch(number, p) for p in parts))


def dense_suffix(title: str, props: dict[str, list[str]], cap: int = 48) -> str:
    """CH14: frontmatter values that add words the chunk's title does not have."""
    words_of = lambda t: [singular(w.lower()) for w in tokenize(t, derived=False)]
    seen, out = set(words_of(title)), []
    for key, values in props.items():
        for v in values if key.lower() not in MACHINERY else ():
            shown = re.sub(r"\s+", " ", re.sub(r"\[\[([^\]]+)\]\]", lambda m: _shown(m[1].split("|")[0]), v)).strip()
            words = words_of(shown)
            if shown and not _says_nothing(shown) and not (words and seen.issuperset(words)):
                seen.update(words)
                out += shown.split(" ")
    return " ".join(out[:cap])


@dataclass
class Chunk:
    title: str
    content: str
    heading_path: list[str] = field(default_factory=list)
    start_line: int = 0
    end_line: int = 0
    lexical_only: bool = False
    dense_suffix: str = ""
    link_terms: str = ""
    part: int = 0


def chunk_id(path: str, c: Chunk) -> str:
    """An id that the path and what is embedded decide, nothing else."""
    return hashlib.sha256("\n".join([path, c.title, "", c.content, *([c.dense_suffix] if c.dense_suffix else [])]).encode("utf-8", "replace")).hexdigest()[:16]


def sections(body: str, note: str, shift: int = 0) -> list[Chunk]:
    """CH4-CH7: a chunk for each heading; short ones are carried into the next, or back at the end."""
    lines = body.split("\n")
    marks = headings(body)
    stack: list[tuple[int, str]] = []
    raw: list[Chunk] = []
    for k, (at, level, text) in enumerate([(-1, 0, ""), *marks]):
        end = marks[k][0] if k < len(marks) else len(lines)
        if level:
            stack = [s for s in stack if s[0] < level] + [(level, clean(text))]
        content = "\n".join(lines[at + 1 : end]).strip()
        path = [s[1] for s in stack]
        if content or level:
            raw.append(Chunk(" > ".join([note, *path]), content, path, at + 1 + shift, end - 1 + shift))
    out: list[Chunk] = []
    held: list[Chunk] = []
    for c in raw:
        if len(c.content) < MIN_SECTION:
            held.append(c)
            continue
        if held:
            c.content = "\n\n".join([*[_with_heading(h) for h in held if _with_heading(h)], c.content])
            c.start_line = held[0].start_line
            held = []
        out.append(c)
    if held:
        text = "\n\n".join(t for h in held if (t := _with_heading(h)))
        if out:
            out[-1].content = f"{out[-1].content}\n\n{text}".strip()
            out[-1].end_line = held[-1].end_line
        elif text:
            out.append(Chunk(note, text, [], held[0].start_line, held[-1].end_line))
    return out or [Chunk(note, "", lexical_only=True)]


def _with_heading(c: Chunk) -> str:
    return "\n".join(t for t in ([c.heading_path[-1]] if c.heading_path else []) + [c.content] if t)


def chunk_note(raw: str, path: str) -> tuple[list[Chunk], dict]:
    """A note's chunks and metadata."""
    props, body, shift = frontmatter(raw)
    names = aliases(props)
    note = " | ".join([re.sub(r"\.md$", "", path.split("/")[-1]), *names])
    own = properties(props)
    out = []
    for c in sections(body, note, shift):
        c.link_terms = link_terms(c.content)
        c.content = clean_body(c.content)
        c.lexical_only = c.lexical_only or not c.content
        c.dense_suffix = dense_suffix(c.title, own)
        out.append(c)
    return out, {"tags": tags(props, body), "aliases": names, "created": created(props), "properties": own}


# Names that views have when nobody names them.
GENERIC_VIEWS = "table view list untitled cards board grid".split()


def _literals(scalar: str) -> list[str]:
    """Quoted words of a filter expression, which may itself be quoted; not numbers, nor code."""
    bare = scalar.strip()
    if len(bare) > 1 and bare[0] == bare[-1] == "'":
        bare = bare[1:-1].replace("''", "'")
    elif len(bare) > 1 and bare[0] == bare[-1] == '"':
        bare = bare[1:-1].replace('\\"', '"') if '\\"' in bare else ""
    found = [x.strip() for x in re.findall(r'"([^"]+)"', bare)]
    return [x for x in found if len(x) > 1 and not x.isdigit() and all(c.isalnum() or c in " '&/-" for c in x)]


def _view_words(raw: str) -> tuple[list[str], list[str], list[tuple[str, list[str]]]]:
    """Filter words of the file, of its views without a name of their own, and of each named view; a small YAML subset."""
    whole: list[str] = []
    views: list[tuple[str, list[str]]] = []
    part, within = "", None
    for line in normalise(raw).split("\n"):
        body = line.strip()
        if line[:1] not in ("", " ", "-", "\t"):
            part, within = body.split(":")[0], None
        elif part == "views" and re.match(r"- *(type|name):", body):
            views.append(("", []))
            within = None
        if part == "views" and views and (m := re.match(r"(?:- *)?name:\s*(.*)$", body)):
            views[-1] = (_unquote(m[1]), views[-1][1])
        key = re.match(r"(?:- *)?(\w+):\s*(.*)$", body)
        if key and key[1] in ("filters", "and", "or", "not"):
            within, body = True, key[2]
        elif key and not body.startswith("- "):
            within = None
        if within and (part == "filters" or (part == "views" and views)):
            (whole if part == "filters" else views[-1][1]).extend(_literals(body.removeprefix("- ")))
    named = [(n, w) for n, w in views if n and n.lower() not in GENERIC_VIEWS]
    loose = [x for n, w in views if not n or n.lower() in GENERIC_VIEWS for x in w]
    return whole, loose, named


def base_views(raw: str) -> list[tuple[str | None, str]]:
    """IO5: the words of the file with its unnamed views, then those of each named view."""
    whole, loose, named = _view_words(raw)
    return [(None, " ".join(dict.fromkeys([*whole, *loose]))), *[(n, " ".join(dict.fromkeys(w))) for n, w in named]]


def base_docs(raw: str, path: str) -> list[Chunk]:
    """CH8: a view file's documents: its name and words, and one for each named view, with the file's own words."""
    base = re.sub(r"\.base$", "", path.split("/")[-1])
    whole, loose, named = _view_words(raw)
    text = lambda *words: " ".join(dict.fromkeys(words))
    return [Chunk(base, text(base, *whole, *loose)), *[Chunk(f"{base} > {n}", text(base, *whole, *w, n)) for n, w in named]]


def embed_input(c: Chunk) -> str:
    """CH20."""
    text = "\n\n".join([c.title, c.content, *([c.dense_suffix] if c.dense_suffix else [])])
    return re.sub(r"[ \t\n]{16,}", " ", text)[: BUDGET * 64]


def count_tokens(text: str, count: Callable[[str], int], gate: int = BUDGET * 16) -> int:
    """CH24: over-long text is estimated."""
    return math.ceil(len(text) / 4.5) if len(text) > gate else count(text)


def split_atom(a: Atom, budget: int, count: Callable[[str], int]) -> list[Atom]:
    """CH23: fences are closed and reopened, tables repeat their head, others split at lines, then at spaces."""
    if count_tokens(a.text, count) <= budget:
        return [a]
    lines = a.text.split("\n")
    head, tail = [], []
    if a.kind == "fence" and len(lines) > 2:
        head, tail = lines[:1], [_FENCE.match(lines[0])[1]]
        lines = lines[1:-1] if _FENCE.match(lines[-1]) else lines[1:]
    elif a.kind == "table" and len(lines) > 2:
        head, lines = lines[:2], lines[2:]
    out, own = [], []
    wrap = lambda body: Atom(a.kind, "\n".join([*head, *body, *tail]))
    for line in lines:
        if own and count_tokens("\n".join([*head, *own, line, *tail]), count) > budget:
            out.append(wrap(own))
            own = []
        if not head and count_tokens(line, count) > budget:
            size = max(1, int(len(line) * budget / count_tokens(line, count) * 0.9))
            while len(line) > size:
                cut = line.rfind(" ", 1, size)
                cut = cut if cut > 0 else size
                out.append(Atom(a.kind, line[:cut]))
                line = line[cut:].lstrip()
        own.append(line)
    return [*out, wrap(own)] if own else out


def within_budget(c: Chunk, count: Callable[[str], int], budget: int = BUDGET) -> list[Chunk]:
    """CH21-CH22: pack atoms greedily; up to 15 % of closing paragraphs are carried into the next part."""
    if count_tokens(embed_input(c), count) <= budget:
        return [c]
    room = max(budget // 4, budget - count_tokens(c.title + c.dense_suffix, count))
    parts: list[list[Atom]] = [[]]
    used = 0
    for a in [p for own in atoms(c.content) for p in split_atom(own, room, count)]:
        n = count_tokens(a.text, count)
        if parts[-1] and used + n > room:
            seed: list[Atom] = []
            size = 0
            for x in reversed(parts[-1]):
                m = count_tokens(x.text, count)
                if x.kind != "paragraph" or size + m > OVERLAP * budget:
                    break
                seed.insert(0, x)
                size += m
            if len(seed) == len(parts[-1]) or size + n > room:
                seed, size = [], 0
            parts.append(seed)
            used = size
        parts[-1].append(a)
        used += n
    return [Chunk(c.title, "\n\n".join(a.text for a in p), c.heading_path, c.start_line, c.end_line, c.lexical_only, c.dense_suffix, c.link_terms, i + 1) for i, p in enumerate(parts) if p]


def html_text(html: str) -> str:
    """Pages as text: scripts, styles and comments go, blocks end lines, entities are read."""
    import html as entities

    t = re.sub(r"(?is)<(script|style|head|nav)\b.*?</\1\s*>|<!--.*?-->", " ", html)
    t = re.sub(r"(?i)<(?:/?(?:p|div|br|h[1-6]|li|tr|article|section)\b)[^>]*>", "\n", t)
    t = entities.unescape(re.sub(r"<[^>]*>", " ", t))
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[^\S\n]+", " ", t)).strip()
