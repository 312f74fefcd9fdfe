"""Personal data by candidate gradient boosting (op 8), in SQL functions only.

Four base patterns give spans that always stay.  Further generators with high
recall propose spans that may overlap each other and the base ones: numbers in
phone, social-security and account shape, bank account codes, spelled-out mail
addresses.  Each proposal gets features of its format (length, digits, separators,
brackets, whether its check digits or number blocks are valid ones) and context
(words before it, words and marks right behind it), and a gradient-boosted
ensemble of depth-3 trees, written out as SQL CASE expressions, gives it a score.
Proposals above a calibrated threshold that overlap no base span are added; of
those that overlap each other the first stays, from left to right.

The ensemble is fitted on the driver on ``EXAMPLES`` seeded labelled findings, in
which telling words also stand before plain numbers and are missing before
personal ones; its threshold keeps ``PRECISION`` on held-out ones.  Scanning,
scoring and selection run inside the JVM: no Python function touches a row.

Matches are located by splitting the text at the pattern and adding up lengths,
in blocks, so many matches cost little more than in proportion.  Patterns are
anchored or possessive so that long runs take linear time and constant stack.

Defined cases: null text is empty and has no spans; texts are scanned whole;
rows are scanned one by one, so repeated rows, ties, empty tables need no rule;
further columns pass through, but for one named ``pii``, which the result replaces.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES, HELD_OUT, TREES, DEPTH, RATE, PRECISION = 2_400, 1_200, 24, 3, 0.4, 0.97
_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (pattern, what a text must contain)
BASE = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digits"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "digits"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"contains(text, '+')"),
}
PROPOSED = {
    "nphone": (r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "digits"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digits"),
    "number": (r"(?<![0-9A-Za-z.-])[0-9]{8,12}(?![0-9A-Za-z-])", "digits"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "digits"),
    "spelled": (rf"(?<!{_LOCAL}){_LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++", r"contains(text, 'at)') or contains(text, 'at]')"),
}
NAMED = {
    "phone": r"(?i)(?:phone|tel|mobile|cell|call|fax|whatsapp)[^0-9]{0,8}$",
    "person": r"(?i)(?:ssn|social security|tax id|national id|passport)[^0-9]{0,12}$",
    "money": r"(?i)(?:account|acct|iban|konto|bank)[^0-9]{0,12}$",
    "mail": r"(?i)(?:mail|contact|write|reach)[^@]{0,12}$",
    "other": r"(?i)(?:order|item|isbn|page|version|part|sku|ref|no|invoice|serial)[.:#\x20]{0,4}$",
}
#: What right behind a number says that it counts or measures something, or goes on.
BEHIND = r"(?i)^(?:\x20?(?:kg|km|mm|cm|ms|mb|gb|eur|usd|items|units|pages|views|people|copies|parts|bytes|percent)\b|\x20?[%$€]|[:/_=]|[.,][0-9])"
FEATURES = ["kind", "length", "n_digits", "n_marks", "brackets", "valid", "behind", *(f"near_{k}" for k in NAMED), "distinct"]
CONTEXT, AFTER = 28, 12


def _kind_number(kind: str) -> int:
    return list(PROPOSED).index(kind)


def valid(kind: str, text: str) -> float:
    """Whether check digits (bank codes: ISO 7064) or number blocks can be real ones; 1 where a kind has none."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "iban":
        bare, left = text.replace(" ", ""), 0
        for c in bare[4:] + bare[:4]:
            left = (left * 10 + int(c) if c.isdigit() else left * 100 + ord(c) - 55) % 97
        return float(left == 1)
    if kind == "ssn":
        return float(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    return float(kind != "nphone" or (digits[0] in "23456789" and digits[3] in "23456789"))


def _valid_column(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "iban":
        bare = F.regexp_replace(text, r"\x20", "")
        turned = F.filter(F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), ""), lambda c: c != "")
        step = lambda left, c: F.when(F.regexp_like(c, F.lit("[0-9]")), left * 10 + F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(left * 100 + F.ascii(c) - 55) % 97
        return (F.aggregate(turned, F.lit(0), step) == 1).cast("double")
    if kind == "ssn":
        return (~F.regexp_like(digits, F.lit("^(?:000|666|9|[0-9]{3}00)|0000$"))).cast("double")
    return F.regexp_like(digits, F.lit("^[2-9][0-9]{2}[2-9]")).cast("double") if kind == "nphone" else F.lit(1.0)


def features(kind: str, text: str, before: str, after: str) -> list[float]:
    """What :func:`_feature_columns` computes, for the labelled findings."""
    digits = re.sub("[^0-9]", "", text)
    return [
        float(_kind_number(kind)),
        float(len(text)),
        float(len(digits)),
        float(len(re.findall(r"[\x20().-]", text))),
        float(text.startswith("(")),
        valid(kind, text),
        float(bool(re.search(BEHIND, after[:AFTER]))),
        *(float(bool(re.search(p, before[-CONTEXT:]))) for p in NAMED.values()),
        float(len(set(digits))),
    ]


def _feature_columns(kind: str, text: Column, before: Column, after: Column) -> list[Column]:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return [
        F.lit(float(_kind_number(kind))),
        F.length(text).cast("double"),
        F.length(digits).cast("double"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[\x20().-]", ""))).cast("double"),
        text.startswith("(").cast("double"),
        _valid_column(kind, text),
        F.regexp_like(after, F.lit(BEHIND)).cast("double"),
        *(F.regexp_like(before, F.lit(p)).cast("double") for p in NAMED.values()),
        F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda c: c != ""))).cast("double"),
    ]


def iban(country: str, rest: str) -> str:
    """A bank account code with its check digits."""
    left = 0
    for c in rest + country + "00":
        left = (left * 10 + int(c) if c.isdigit() else left * 100 + ord(c) - 55) % 97
    return f"{country}{98 - left:02d}{rest}"


def findings(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """Seeded findings: kind, text, what stands before and behind, label (1: personal data).

    Words of :data:`NAMED` stand before two thirds of the personal ones and before
    a quarter of the others, where what stands behind or an invalid format tells.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    prose = lambda: " ".join(word() for _ in range(r.randint(3, 6))) + r.choice([" ", ". ", ", "])
    block = lambda k: r.choice("23456789") + d(k - 1)
    out = []
    for _ in range(n):
        kind, good, told = r.choice(list(PROPOSED)), r.random() < 0.5, r.random()
        after = r.choice(["", ".", ",", " " + word(), "\n"])
        unit = r.choice([" kg", " items", "%", ":", "/" + word(), " pages", ",50", " views"])
        near = {
            "nphone": ["phone: ", "call ", "tel. ", "mobile ", "Phone number ", "fax "],
            "ssn": ["SSN ", "ssn: ", "social security ", "tax id ", "passport "],
            "number": ["account ", "acct: ", "bank account no ", "phone is ", "call ", "passport ", "national id "],
            "iban": ["IBAN ", "account ", "bank: "],
            "spelled": ["mail ", "contact ", "write to ", "e-mail: "],
        }[kind]
        plain = ["order ", "part no. ", "item ", "serial ", "sku ", "ref ", "version ", "invoice "]
        if kind == "nphone":
            a, b = (block(3), block(3)) if good and told >= 0.67 else (d(3), d(3))
            text = r.choice([f"({a}) {b}-{d(4)}", f"{a}-{b}-{d(4)}", f"{a}.{b}.{d(4)}", f"{a} {b} {d(4)}"] if good else [f"{a} {b} {d(4)}", f"{a}.{b}.{d(4)}", f"{a}-{b}-{d(4)}"])
        elif kind == "ssn":
            text = f"{r.choice('12345678')}{d(2)}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" if good else r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"000-{d(2)}-{d(4)}"])
        elif kind == "number":
            text = d(r.randint(8, 12))
        elif kind == "iban":
            text = iban(r.choice(["DE", "FR", "ES", "GB", "NL"]), d(r.choice([16, 18, 20])))
            if not good:
                text = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + d(2) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        else:
            text = f"{word()} (at) {word()}" + (r.choice([f".{word()}", f" (dot) {word()}"]) if good else f".{d(1)}")
        if good:
            before = r.choice(near) if told < 0.67 or kind == "number" else ""
        elif told < 0.25:
            before, after = r.choice(near), unit if kind in ("number", "nphone", "ssn") else after
        else:
            before, after = r.choice([*plain, "", ""]), r.choice([after, unit])
        out.append((kind, text, prose() + before, after, int(good)))
    return out


def labelled(n: int, seed: int) -> tuple[list[list[float]], list[int]]:
    own = findings(n, seed)
    return [features(*x[:4]) for x in own], [x[4] for x in own]


def _leaf(rows: list[int], g: list[float], h: list[float]) -> float:
    return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)


def _split(rows: list[int], x: list[list[float]], g: list[float], h: list[float]) -> tuple[int, float] | None:
    best, found = 1e-6, None
    gain = lambda s, w: s * s / (w + 1.0)
    all_g, all_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
    for f in range(len(FEATURES)):
        order = sorted(rows, key=lambda i: x[i][f])
        s = w = 0.0
        for a, b in zip(order, order[1:], strict=False):
            s, w = s + g[a], w + h[a]
            if x[a][f] < x[b][f] and (v := gain(s, w) + gain(all_g - s, all_h - w) - gain(all_g, all_h)) > best:
                best, found = v, (f, (x[a][f] + x[b][f]) / 2)
    return found


def fit_tree(rows: list[int], x: list[list[float]], g: list[float], h: list[float], depth: int):
    cut = _split(rows, x, g, h) if depth else None
    if cut is None:
        return _leaf(rows, g, h)
    low = [i for i in rows if x[i][cut[0]] <= cut[1]]
    high = [i for i in rows if x[i][cut[0]] > cut[1]]
    return (*cut, fit_tree(low, x, g, h, depth - 1), fit_tree(high, x, g, h, depth - 1))


def run_tree(tree, x: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=1)
def fitted() -> tuple[list, float]:
    """(trees, threshold on the summed score)."""
    x, y = labelled(EXAMPLES, seed=3)
    score, trees = [0.0] * len(x), []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = fit_tree(list(range(len(x))), x, [b - a for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], DEPTH)
        trees.append(tree)
        score = [s + RATE * run_tree(tree, row) for s, row in zip(score, x, strict=True)]
    hx, hy = labelled(HELD_OUT, seed=4)
    held = sorted(((sum(RATE * run_tree(t, row) for t in trees), b) for row, b in zip(hx, hy, strict=True)), reverse=True)
    threshold, right = held[0][0], 0
    for n, (s, b) in enumerate(held, 1):
        right += b
        if right >= PRECISION * n:
            threshold = s
    return trees, max(threshold, 0.0)


def _tree_column(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[FEATURES[tree[0]]] <= tree[1], _tree_column(tree[2], x)).otherwise(_tree_column(tree[3], x))


def score_column(x: Column) -> Column:
    """The ensemble's summed score of a struct of features."""
    total = F.lit(0.0)
    for t in fitted()[0]:
        total = total + F.lit(RATE) * _tree_column(t, x)
    return total


_NO_SPANS = "cast(array() as array<struct<start: int, end: int, m: string>>)"


def located(text: str, found: str, pattern: str) -> str:
    """SQL for the spans of the matches ``found`` of ``pattern``, in code points, block by block."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    pairs = f"zip_with(slice(split({text}, '{quoted}', -1), 1, size({found})), {found}, (p, q) -> named_struct('skip', length(p), 'm', q))"
    inner = "aggregate(b, named_struct('at', acc.at, 'out', cast(array() as array<struct<start: int, end: int, m: string>>)), (c, q) -> named_struct('at', c.at + q.skip + length(q.m), 'out', concat(c.out, array(named_struct('start', c.at + q.skip, 'end', c.at + q.skip + length(q.m), 'm', q.m)))))"
    blocks = f"transform(sequence(0, (size({found}) - 1) div 256), i -> slice(z, i * 256 + 1, 256))"
    outer = (
        f"flatten(aggregate({blocks.replace('slice(z,', f'slice({pairs},')}, named_struct('at', 0, 'out', cast(array() as array<array<struct<start: int, end: int, m: string>>>)), "
        f"(acc, b) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(acc.out, array(r.out))))[0]).out)"
    )
    return f"case when size({found}) > 0 then {outer} else {_NO_SPANS} end"


_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LUHN = (
    "pmod(aggregate(transform(split(reverse(regexp_replace(s.m, '[^0-9]', '')), ''), (c, i) -> case when c = '' then 0 when i % 2 = 0 then cast(c as int) when cast(c as int) > 4 then cast(c as int) * 2 - 9 else cast(c as int) * 2 end), 0, (a, v) -> a + v), 10) = 0"
)
_KEPT = {
    "email": None,
    "ip": f"s -> s.m rlike '^{_OCTET}([.]{_OCTET}){{3}}$'",
    "card": f"s -> length(s.m) <= 40 and case when length(regexp_replace(s.m, '[^0-9]', '')) between 13 and 19 then {_LUHN} else false end",
    "phone": "s -> length(regexp_replace(s.m, '[^0-9]', '')) between 9 and 15",
}


def _with_features(kind: str):
    def run(s: Column) -> Column:
        before = F.substring(F.col("_p_text"), F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        after = F.substring(F.col("_p_text"), s["end"] + 1, F.lit(AFTER))
        x = [c.alias(n) for n, c in zip(FEATURES, _feature_columns(kind, s["m"], before, after), strict=True)]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), F.lit(kind).alias("kind"), F.struct(*x).alias("x"))

    return run


def _named(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: a struct of the base kinds' spans and ``more``, the spans the ensemble adds.

    Spans are structs (start, end, m) in code points, the end exclusive; those of
    ``more`` have a ``kind`` too.
    """
    threshold = fitted()[1]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(row.alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_p_text"))
    own = own.withColumn("_p_digits", F.regexp_like("_p_text", F.lit("[0-9]")))
    kinds = BASE | PROPOSED
    found = own
    for k, (pattern, needs) in kinds.items():
        gate = F.col("_p_digits") if needs == "digits" else F.expr(needs.replace("text", "_p_text"))
        found = found.withColumn(f"_f_{k}", F.when(gate, F.regexp_extract_all("_p_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    spans = found
    for k, (pattern, _) in kinds.items():
        spans = spans.withColumn(f"_s_{k}", F.expr(located("_p_text", f"_f_{k}", pattern)))
    for k, keep in _KEPT.items():
        if keep:
            spans = spans.withColumn(f"_s_{k}", F.expr(f"filter(_s_{k}, {keep})"))
    scored = [F.filter(F.transform(f"_s_{k}", _with_features(k)), lambda s: score_column(s["x"]) >= threshold) for k in PROPOSED]
    base_spans = F.concat(*[F.col(f"_s_{k}") for k in BASE])
    chosen = spans.withColumn("_more", F.when(F.col("_p_digits") | F.expr("size(_s_spelled) > 0"), F.concat(*scored)).otherwise(F.concat(*[F.filter(s, lambda _: F.lit(False)) for s in scored])))
    chosen = chosen.withColumn("_all", base_spans)
    alone = F.filter(F.array_sort(F.transform("_more", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), s["kind"].alias("kind")))), lambda s: ~F.exists("_all", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    chosen = chosen.withColumn("_alone", alone)
    clear = lambda kept, s: (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["end"] <= s["start"])
    first = F.aggregate("_alone", F.filter("_alone", lambda _: F.lit(False)), lambda kept, s: F.when(clear(kept, s), F.concat(kept, F.array(s))).otherwise(kept))
    pii = F.struct(*[F.col(f"_s_{k}").alias(k) for k in BASE], first.alias("more"))
    return chosen.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "pii"], pii.alias("pii"))


def span_text(pii: str = "pii", more: bool = False) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    base = [F.transform(F.col(pii)[k], _named(k)) for k in BASE]
    if more:
        base += [F.transform(F.filter(F.col(pii)["more"], _of_kind(k)), _named(k)) for k in PROPOSED]
    return F.array_join(F.concat(*base), ",")
