"""Text analysis: tokens, terms, filters' text forms, dates (AN1-AN20)."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[\n\r\p{Z}\p{P}\p{Sm}]+"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"

# Fixed values that must equal the reference's: stopwords, irregular plurals,
# singulars that end in s, and nouns in -ie.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
IRREGULAR = {
    "analyses": "analysis",
    "theses": "thesis",
    "crises": "crisis",
    "diagnoses": "diagnosis",
    "prognoses": "prognosis",
    "hypotheses": "hypothesis",
    "parentheses": "parenthesis",
    "syntheses": "synthesis",
    "emphases": "emphasis",
    "oases": "oasis",
    "neuroses": "neurosis",
    "psychoses": "psychosis",
    "lenses": "lens",
}
S_FINAL = "alias bias atlas canvas lens news".split()
IE_NOUNS = "movie cookie zombie calorie genie pixie sortie selfie smoothie hoodie newbie rookie goalie veggie birdie foodie freebie indie junkie oldie quickie talkie townie yuppie".split()


def tokens(text: Column) -> Column:
    """AN1, canonical form: runs between separators, punctuation and mathematical signs."""
    return F.filter(F.split(text, SPLIT), lambda x: x != "")


def strip_possessive(text: Column) -> Column:
    """AN4: drop 's after a letter, not after a digit."""
    return F.regexp_replace(text, r"(?<=\p{L})['’]s(?![\p{L}\p{N}])", "")


def camel_parts(word: Column) -> Column:
    """AN3: parts at case changes; empty when there is no change."""
    parts = F.split(word, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def has_cjk(text: Column) -> Column:
    return F.regexp_like(text, F.lit(CJK))


_GLUE = set("-/.'’")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


class _Spaced(dict):
    """For str.translate: separators, punctuation and mathematical signs become spaces; each character is judged once."""

    def __missing__(self, code: int) -> int:
        kind = unicodedata.category(chr(code))
        self[code] = 32 if code in (10, 13) or kind[0] in "ZP" or kind == "Sm" else code
        return self[code]


_SPACED = _Spaced()
_WORD = re.compile("[^ ]+")


def _segments(fragment: str) -> list[str]:
    """AN5: no dictionary is at hand, so runs of CJK letters become overlapping pairs."""
    out = []
    for run in re.findall("[぀-ヿ㐀-鿿가-힯]+|[^぀-ヿ㐀-鿿가-힯]+", fragment):
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))] if _CJK.match(run) else [run]
    return out


def tokenize(text: str, derived: bool = True) -> list[str]:
    """AN1-AN5 in full, with glued compounds and case parts if ``derived``."""
    text = re.sub(r"(?<=[^\W\d_])['’]s(?!\w)", "", text)
    spaced = text.translate(_SPACED)
    cjk = _CJK.search(text) is not None
    if not derived and not cjk:
        return [w for w in spaced.split(" ") if w]
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if derived and len(run) > 1:
            out.append("".join(run))
        run.clear()

    last = 0
    for m in _WORD.finditer(spaced):
        word, at = m[0], m.start()
        if at - last != 1 or text[last] not in _GLUE:
            close()
        last = m.end()
        if cjk and _CJK.search(word):
            close()
            out += _segments(word)
            continue
        out.append(word)
        run.append(word)
        if derived and len(parts := _CAMEL.split(word)) > 1:
            out += parts
    close()
    return out


def tokenize_udf(text: Column, derived: bool = True) -> Column:
    """:func:`tokenize` over Arrow batches, for the forms SQL cannot give."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else tokenize(t, derived) for t in texts.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(text)


def fold_udf(text: Column) -> Column:
    """AN7: decompose and drop marks; CJK text is left alone."""

    def fold(t: str) -> str:
        return t if _CJK.search(t) else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M")

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text)


def _folds() -> tuple[str, str]:
    """Characters below U+2000 that decompose into a letter and marks, what is left of them, and last the marks that go."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x2000))]
    pairs = [(c, "".join(x for x in d if unicodedata.category(x)[0] != "M")) for c, d in pairs if d != c and not _CJK.search(c)]
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.category(c)[0] == "M")
    single = [(c, d) for c, d in pairs if len(d) == 1]
    return "".join(c for c, _ in single) + marks, "".join(d for _, d in single)


_MARKED, _PLAIN = _folds()


def fold(text: Column) -> Column:
    """AN7 inside the JVM: letters with marks below U+2000 lose them, and so do letters followed by combining marks."""
    return F.translate(text, _MARKED, _PLAIN)


def depluralize(w: Column) -> Column:
    """AN9."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    irregular = F.lit(None).cast("string")
    for plural, singular in IRREGULAR.items():
        irregular = F.when(w == plural, singular).otherwise(irregular)
    return (
        F.when(n <= 3, w)
        .when(irregular.isNotNull(), irregular)
        .when(w.isin(S_FINAL), w)
        .when(w.endswith("ies") & (n > 4), F.when(cut(1).isin(IE_NOUNS), cut(1)).otherwise(F.concat(cut(3), F.lit("y"))))
        .when(w.endswith("sses"), cut(2))
        .when(F.regexp_like(w, F.lit("(ch|sh|x|z|s)es$")) & (n > 4), cut(2))
        .when(w.endswith("s") & ~F.regexp_like(w, F.lit("(ss|us|is|os)$")), cut(1))
        .otherwise(w)
    )


def singular(w: str) -> str:
    """AN9 for plain text."""
    if len(w) <= 3:
        return w
    if w in IRREGULAR or w in S_FINAL:
        return IRREGULAR.get(w, w)
    if w.endswith("ies") and len(w) > 4:
        return w[:-1] if w[:-1] in IE_NOUNS else w[:-3] + "y"
    if w.endswith("sses") or (len(w) > 4 and w.endswith(("ches", "shes", "xes", "zes", "ses"))):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith(("ss", "us", "is", "os")) else w


def derived_forms(text: Column) -> Column:
    """AN2-AN3 inside the JVM: what stands on both sides of one glue mark, joined, and the parts of words at case changes."""
    word = r"[^\n\r\p{Z}\p{P}\p{Sm}]+"
    bare = strip_possessive(text)
    glued = F.transform(F.regexp_extract_all(bare, F.lit(rf"{word}(?:[-/.'’]{word})+"), F.lit(0)), lambda x: F.regexp_replace(x, "[-/.'’]", ""))
    return F.concat(glued, F.flatten(F.transform(tokens(bare), camel_parts)))


def name_terms(text: Column, derived: bool = False) -> Column:
    """The distinct terms of a name, stopwords kept; with its derived forms, if asked."""
    own = tokens(strip_possessive(text))
    own = F.concat(own, derived_forms(text)) if derived else own
    return F.array_distinct(F.transform(own, lambda x: depluralize(fold(F.lower(x)))))


# Characters that cannot stand in a tag are white space, ASCII punctuation but - and _, and two blocks of punctuation.
NOT_IN_TAGS = frozenset("!\"#$%&'()*+,./:;<=>?@[\\]^`{|}~")
PUNCTUATION_BLOCKS = (("\u2000", "\u206f"), ("\u2e00", "\u2e7f"))


def in_tag(c: str) -> bool:
    return not (c.isspace() or c in NOT_IN_TAGS or any(a <= c <= b for a, b in PUNCTUATION_BLOCKS))


def tag_end(text: str, at: int) -> int:
    """Where the tag (runs of letters with single slashes between) that begins at ``at`` ends; ``at`` if there is none."""
    end = at
    while end < len(text) and (in_tag(text[end]) or (text[end] == "/" and end > at and text[end - 1] != "/" and end + 1 < len(text) and in_tag(text[end + 1]))):
        end += 1
    return end


def is_tag(tag: str) -> bool:
    """A whole tag that has a character other than digits and slashes."""
    return 0 < tag_end(tag, 0) == len(tag) and any(c not in "0123456789/" for c in tag)


def cjk_pieces(words: Column) -> Column:
    """AN5 inside the JVM: words with CJK letters fall into runs, and runs of those letters into overlapping pairs."""
    run = rf"{CJK}+|[^\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}]+"
    pairs = lambda r: F.when(has_cjk(r) & (F.length(r) > 1), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))
    return F.flatten(F.transform(words, lambda w: F.when(has_cjk(w), F.flatten(F.transform(F.regexp_extract_all(w, F.lit(run), F.lit(0)), pairs))).otherwise(F.array(w))))


def terms(text: Column, keep_stopwords: bool = False, derived: bool = False) -> Column:
    """AN1, AN7-AN10: tokens, with glued forms and case parts if ``derived``, folded and lower-cased, without stopwords, plurals folded."""
    own = tokens(strip_possessive(text))
    own = F.concat(own, derived_forms(text)) if derived else own
    own = F.when(has_cjk(text), cjk_pieces(own)).otherwise(own)
    low = F.transform(own, lambda x: fold(F.lower(x)))
    return F.transform(low if keep_stopwords else F.filter(low, lambda x: ~x.isin(STOPWORDS)), depluralize)


def query_terms(text: Column) -> Column:
    """AN10: as :func:`terms`, but a query of stopwords alone keeps them."""
    own = terms(text)
    return F.when(F.size(own) == 0, terms(text, keep_stopwords=True)).otherwise(own)


def fuzzy_distance(term: Column) -> Column:
    """AN11: edits allowed for a term."""
    return F.when(has_cjk(term) | F.regexp_like(term, F.lit(r"\p{N}")) | (F.length(term) <= 2), 0).when(F.length(term) <= 5, 1).otherwise(2)


def note_name(title: Column) -> Column:
    """AN13: what stands before the heading or alias part of a title."""
    return F.element_at(F.split(title, r" > | \| "), 1)


# Whole values that are dates or numbers.
DATE_ONLY = r"(?i)^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
# Keys whose values are not searched.
MACHINERY = "icon coordinates cssclasses cssclass protected version completed completeddate position banner banner_y".split()
EXCLUDED_KEYS = ["tags", "aliases", "alias", "created", "modified", "datelink", *MACHINERY]


def display_form(value: Column) -> Column:
    """CH19: wikilinks collapse to the target's base name."""
    linked = F.regexp_replace(value, r"\[\[(?:[^\]|#^]*/)?([^\]|#^/]*)[^\]]*\]\]", "$1")
    return F.trim(F.regexp_replace(linked, r"\s+", " "))


def bind_form(value: Column) -> Column:
    """CH19: what property filters compare."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"\[\[|\]\]|\|", " "), r"\s+", " "))


def properties_text(properties: Column) -> Column:
    """AN14: searchable property values in display form."""
    kept = F.map_filter(properties, lambda k, _: ~F.lower(k).isin(EXCLUDED_KEYS))
    values = F.transform(F.flatten(F.map_values(kept)), lambda v: display_form(F.regexp_replace(v, "^[\"']|[\"']$", "")))
    return F.array_join(F.filter(values, lambda v: (v != "") & ~F.regexp_like(v, F.lit(DATE_ONLY)) & ~F.regexp_like(v, F.lit(r"^-?[\d., ]+$"))), " ")


def glob_regex(pattern: str) -> str:
    """AN15: an anchored, case-insensitive glob; also fits below any folder."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?i)^(?:.*/)?{body}$"


def parse_num(value: Column) -> Column:
    """AN16: a strict number, quotes and spaces trimmed; null otherwise."""
    return F.trim(F.regexp_replace(F.trim(value), "^[\"']|[\"']$", "")).try_cast("double")


def parse_date(value: Column) -> Column:
    """AN18: a bare date with valid month and day rolls over the month's end; else a timestamp; else an embedded date."""
    part = lambda k: F.regexp_extract(value, r"^\s*(\d{4})-(\d{2})-(\d{2})\s*$", k).try_cast("int")
    rolled = F.when(part(2).between(1, 12) & part(3).between(1, 31), F.date_add(F.make_date(part(1), part(2), F.lit(1)), part(3) - 1).cast("timestamp"))
    whole = F.try_to_timestamp(F.when(F.regexp_like(value, F.lit(r"^\s*\d{4}(-\d{2}){0,2}")), F.trim(value)))
    inner = F.try_to_timestamp(F.regexp_extract(value, r"(\d{4}-\d{2}-\d{2})", 1))
    return F.coalesce(rolled, whole, inner)


def period_end(value: Column) -> Column:
    """AN19: the first instant after a year, month or day."""
    v = F.trim(value)
    start = parse_date(v)
    return (
        F.when(F.regexp_like(v, F.lit(r"^\d{4}$")), F.to_timestamp(F.concat((v.try_cast("int") + 1).cast("string"), F.lit("-01-01"))))
        .when(F.regexp_like(v, F.lit(r"^\d{4}-\d{2}$")), F.add_months(F.try_to_timestamp(F.concat(v, F.lit("-01"))).cast("date"), 1).cast("timestamp"))
        .otherwise(start + F.expr("INTERVAL 1 DAY"))
    )


def filename_date(path: Column) -> Column:
    """AN20: a date in the last path segment, ranges checked."""
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))", 1)
    return F.when(found != "", found)
