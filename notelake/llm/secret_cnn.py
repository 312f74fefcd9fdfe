"""Secret scans with a character convolutional network (op 6).

Base spans come from three fixed patterns and always stay.  Further candidates
are unbroken runs of 20 letters, digits and ``+/_=-`` or more that hold a digit
and a letter, less the base spans in them, and such runs of 8 or more after a name
like ``pwd`` or ``auth``.  A run is judged by its highest score over windows that
start every ``STEP`` characters, after each ``/`` and ``=``, and end with it, so a
secret anywhere in it counts.  Every candidate is scored by a small
convolutional network over its characters and the context on both sides: an
embedding of character classes, one convolution, the maximum over places, and a
logistic output.  It is written in numpy and trained on the driver on labelled
findings (``EXAMPLES`` of them, made by a seeded generator: keys, hashes, tokens
and passwords against identifiers, paths, dates, words and numbers, each within
code or prose).  The threshold is the largest one that still keeps ``RECALL`` of the
held-out secrets of each group (findings, long runs, short named values).

Only words of 20 bytes or more, found for whole slices of texts at once, are
looked at for the run-like kinds; nothing is cut off or sampled.

Defined cases: null text is empty and has no spans; texts of any length are
scanned whole; rows are scanned one by one, so repeated rows, ties, empty tables
and further columns need no rule.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import SPACED, slices, small_batches, words

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
NAMED = re.compile(r"""(?:(?:pwd|passphrase|passcode|auth|credentials?|bearer|private_?key|access_?key)["']?(?:\x20*[:=]\x20*|\x20is\x20)|bearer\x20)["']?([A-Za-z0-9+/_=-]{8,})""", re.I)
NAMES = (b"pwd", b"passphrase", b"passcode", b"auth", b"credential", b"bearer", b"private", b"access")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
RESULT = "struct<n_assign: long, n_access: long, n_hex: long, base_sha256: string, spans: string>"

#: Labelled findings to train on, and the held-out ones to calibrate on.
EXAMPLES, HELD_OUT = 3_000, 1_500
RECALL = 0.98
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Windows of a run start so far apart; one after a separator needs so many characters left.
STEP, LEAST = 20, 16
_EMBED, _FILTERS, _SPAN = 6, 24, 5


def _classes() -> np.ndarray:
    """Each byte's class: letters and digits by value in small groups, else by kind."""
    table = np.full(256, 1, np.int64)
    for i, group in enumerate(("", "", "0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "aeiou", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " \t", "\n\r", "\"'`", "=:", "/\\", "-_", ".", "+", "()[]{}<>", ",;", "#*$%&|")):
        table[[ord(c) for c in group]] = i
    return table


_CLASS = _classes()
N_CLASSES = 20


def window(text: str, start: int, end: int) -> np.ndarray:
    """Class codes of the context before, the candidate's start and the context after; 0 pads."""
    out = np.zeros(WIDTH, np.int64)
    for place, part, right in ((0, text[max(0, start - BEFORE) : start], BEFORE), (BEFORE, text[start : min(end, start + INSIDE)], 0), (BEFORE + INSIDE, text[end : end + AFTER], 0)):
        codes = _CLASS[np.frombuffer(part.encode("ascii", "replace"), np.uint8)]
        at = place + right - len(codes) if right else place
        out[at : at + len(codes)] = codes
    return out


def starts(text: str, start: int, end: int) -> list[int]:
    """Where the windows of a run start: together they see all of it."""
    last = max(start, end - INSIDE)
    anew = (i + 1 for i in range(start, end - LEAST) if text[i] in "/=")
    return sorted({*range(start, last, STEP), start, last, *anew})


class Network:
    """Embedding, convolution, maximum, logistic; trained with Adam."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (N_CLASSES, _EMBED)),
            "w": r.normal(0, 0.25, (2, _SPAN * _EMBED, _FILTERS)),
            "b": np.zeros((2, _FILTERS)),
            "o": r.normal(0, 0.2, 4 * _FILTERS),
            "c": np.zeros(1),
        }
        self.threshold = 0.5

    @staticmethod
    def _patches(e: np.ndarray, x: np.ndarray) -> np.ndarray:
        v = e[x]
        return np.concatenate([v[:, i : x.shape[1] - _SPAN + 1 + i] for i in range(_SPAN)], axis=2)

    def _forward(self, x: np.ndarray) -> tuple:
        kept, parts = [], []
        for side, at in ((0, slice(0, BEFORE)), (1, slice(BEFORE - 4, WIDTH))):
            patches = self._patches(self.p["e"], x[:, at])
            a = np.maximum(patches @ self.p["w"][side] + self.p["b"][side], 0)
            parts += [a.max(axis=1), a.mean(axis=1)]
            kept.append((patches, a))
        h = np.concatenate(parts, axis=1)
        return kept, h, 1 / (1 + np.exp(-np.clip(h @ self.p["o"] + self.p["c"], -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 2048])[2] for i in range(0, len(x), 2048)]) if len(x) else np.empty(0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, size: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m, v, t = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), size):
                pick, t = order[i : i + size], t + 1
                for k, g in self._gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept, h, out = self._forward(x)
        d = (out - y) / len(x)
        g = {k: np.zeros_like(a) for k, a in self.p.items()}
        g["o"], g["c"] = h.T @ d, np.array([d.sum()])
        dh = d[:, None] * self.p["o"]
        for side, first in ((0, 0), (1, BEFORE - 4)):
            patches, a = kept[side]
            n, places, f = a.shape
            da = np.broadcast_to(dh[:, None, (2 * side + 1) * f : (2 * side + 2) * f] / places, a.shape).copy()
            top = a.argmax(axis=1)
            np.add.at(da, (np.arange(n)[:, None], top, np.arange(f)[None]), dh[:, 2 * side * f : (2 * side + 1) * f])
            da *= a > 0
            g["w"][side] = patches.reshape(-1, patches.shape[2]).T @ da.reshape(-1, f)
            g["b"][side] = da.sum(axis=(0, 1))
            dp = da @ self.p["w"][side].T
            for j in range(_SPAN):
                np.add.at(g["e"], x[:, first + j : first + j + places], dp[:, :, j * _EMBED : (j + 1) * _EMBED])
        return g


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded findings: windows and labels (1: a secret)."""
    r = np.random.default_rng(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    of = lambda options: options[int(r.integers(0, len(options)))]
    word = lambda: "".join(some("bcdfghklmnprst", 1) + some("aeiou", 1) for _ in range(int(r.integers(1, 4))))
    prose = lambda k: " ".join(word() for _ in range(k)) + " "
    names = ("password", "passwd", "secret", "token", "api_key", "auth", "access_key", "private_key", "bearer", "credential")
    plain = ("id", "path", "url", "file", "commit", "name", "version", "page", "order", "ref", "date", "image")
    x, y = [], []
    for _ in range(n):
        secret = bool(r.integers(0, 2))
        if secret:
            value = of(
                (
                    lambda: some("0123456789abcdef", int(r.integers(32, 65))),
                    lambda: "AKIA" + some(upper + digits, 16),
                    lambda: some(upper + lower + digits + "+/", int(r.integers(24, 64))),
                    lambda: of(("ghp_", "sk-", "xoxb-", "pk_")) + some(upper + lower + digits, int(r.integers(24, 44))),
                    lambda: some(upper + lower + digits + "-_", int(r.integers(20, 44))),
                )
            )()
            before = of((prose(4) + of(names) + of((" = ", ": ", '="', ' = "', "=", " is ")), prose(3) + "key ", of(names) + " ", prose(4)))
        else:
            value = of(
                (
                    lambda: "-".join(word() for _ in range(int(r.integers(4, 8)))) + "-" + some(digits, 2),
                    lambda: "/".join(word() for _ in range(int(r.integers(4, 8)))) + "/" + some(digits, int(r.integers(1, 5))),
                    lambda: some(digits, 4) + "-" + some(digits, 2) + "-" + some(digits, 2) + "_" + "_".join(word() for _ in range(3)),
                    lambda: "_".join(word() for _ in range(4)) + some(digits, int(r.integers(1, 4))),
                    lambda: "=" * int(r.integers(10, 30)) + word() + some(digits, 1) + "=" * 10,
                    lambda: "".join(word().capitalize() for _ in range(5)) + some(digits, int(r.integers(1, 5))),
                    lambda: some(digits, int(r.integers(20, 30))) + of(("", "x", "km")),
                )
            )()
            before = of((prose(4), prose(3) + of(plain) + of((" = ", ": ", '="', "=", " ")), prose(2) + "see ", "\n"))
        after = of((" ", '"', "\n", ", ", ".", " " + word()))
        text = before + value + after + prose(2)
        x.append(window(text, len(before), len(before) + len(value)))
        y.append(float(secret))
    return np.array(x), np.array(y)


def labelled_runs(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Seeded long runs and short named values: each one's windows, their labels (-1: only part of a secret) and its own label."""
    r = np.random.default_rng(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    of = lambda options: options[int(r.integers(0, len(options)))]
    word = lambda: "".join(some("bcdfghklmnprst", 1) + some("aeiou", 1) + of(("", "", "n", "r", "s", "t")) for _ in range(int(r.integers(1, 4))))
    part = lambda: of((word(), word(), word(), some(digits, int(r.integers(1, 5))), "v" + some(digits, 1), word() + some(digits, 2), word().capitalize(), "2024-01-" + some(digits, 2)))
    windows, labels, whole = [], [], []
    for _ in range(n):
        secret, short = bool(r.integers(0, 2)), r.random() < 0.3
        before = " ".join(word() for _ in range(3)) + " "
        if short:
            before += of(("pwd", "auth", "access_key", "private_key", "bearer", "credential", "passphrase")) + of(("=", ": ", " = ", '="', ' is '))
            front, back = "", ""
            plain = of((word() + some(digits, 1), word() + "-" + word() + some(digits, 2), word() + "/" + word() + some(digits, 1), "oauth2-" + word(), word() + "_v" + some(digits, 1), "2024-01-" + some(digits, 2) + "T"))
            plain = plain if len(plain) >= 8 else plain + "_" + word() + word()
            value = some(upper + lower + digits, int(r.integers(8, 20))) if secret else plain
        else:
            glue = of(("/", "/", "-", "_"))
            front = of(("", "/")) + glue.join(part() for _ in range(int(r.integers(3, 16))))
            front += of(("/", "=")) if r.random() < 0.8 else glue
            back = of(("", "", "/" + part())) if secret else ""
            value = some(of((upper + lower + digits, upper + lower + digits + "+", digits + "abcdef")), int(r.integers(24, 44))) if secret else glue.join(part() for _ in range(int(r.integers(3, 9))))
        text = before + front + value + back + of((" ", '"', "\n", ", ", ".")) + word()
        s, e = len(before), len(before) + len(front) + len(value) + len(back)
        k = s + len(front), s + len(front) + len(value)
        at = [s] if short else starts(text, s, e)
        seen = [min(k[1], i + INSIDE) - max(k[0], i) for i in at]
        windows.append(np.array([window(text, i, e) for i in at]))
        labels.append(np.array([0.0 if not secret or m <= 0 else 1.0 if short or m >= 20 else -1.0 for m in seen]))
        whole.append(float(secret))
    return windows, labels, np.array(whole)


def best(net: Network, windows: list[np.ndarray]) -> np.ndarray:
    """The highest score of each candidate's windows."""
    if not windows:
        return np.empty(0)
    n = np.cumsum([0, *map(len, windows)])
    return np.maximum.reduceat(net.score(np.concatenate(windows)), n[:-1])


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """The largest threshold with ``RECALL``."""
    secret = np.sort(scores[y > 0.5])
    return float(secret[int((1 - RECALL) * len(secret))])


@lru_cache(maxsize=1)
def trained() -> Network:
    net = Network()
    x, y = labelled(EXAMPLES, seed=1)
    windows, labels, _ = labelled_runs(EXAMPLES, seed=3)
    x, y = np.concatenate([x, *windows]), np.concatenate([y, *labels])
    net.train(x[y >= 0], y[y >= 0])
    scores, y, group = held_out(net, HELD_OUT, seed=2)
    net.threshold = min(calibrate(scores[group == g], y[group == g]) for g in range(3))
    return net


def held_out(net: Network, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, labels and groups (0: findings, 1: long runs, 2: those with one window, nearly all short named values) of what was not trained on."""
    x, y = labelled(n, seed)
    windows, _, whole = labelled_runs(n, seed + 1_000)
    return np.concatenate([net.score(x), best(net, windows)]), np.concatenate([y, whole]), np.concatenate([np.zeros(n, int), [1 + (len(w) == 1) for w in windows]])


def assignments(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]


def _runs(text: str) -> tuple[list, list, list]:
    access = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    hexes = [m.span() for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    other = [m.span() for m in RUN.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    return access, hexes, other


def _mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def _outside(s: int, e: int, base: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """What sorted base spans leave of s to e, in pieces of ``least`` characters or more."""
    out = []
    for a, _, b in base:
        if a < e and s < b:
            out.append((s, a))
            s = b
    return [(a, b) for a, b in [*out, (s, e)] if b - a >= least]


def find(texts: pa.Array, net: Network) -> list[tuple[list, list]]:
    """For each text its base spans (start, kind number, end) and those the network adds."""
    out = []
    x: list[np.ndarray] = []
    asked: list[tuple[int, int, int]] = []
    for lo, hi, data, offsets in slices(texts):
        _, row, start, end = words(data, offsets, SPACED, fold=False)
        long = np.flatnonzero(end - start >= 20)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        by_row: dict[int, list[int]] = {}
        for i in long.tolist():
            by_row.setdefault(int(row[i]), []).append(i)
        raw = data.tobytes()
        for r in range(hi - lo):
            own = raw[offsets[r] : offsets[r + 1]]
            folded = own.lower()
            named = any(k in folded for k in WORDS) or not own.isascii()
            called = any(k in folded for k in NAMES)
            base: list[tuple[int, int, int]] = []
            others: list[tuple[int, int]] = []
            text = own.decode("utf-8", "replace") if named or called or r in by_row else ""
            if named:
                base += [(s, 0, e) for s, e in assignments(text)]
            for i in by_row.get(r, ()):
                at = int(chars[start[i]] - chars[offsets[r]])
                for kind, spans in enumerate(_runs(raw[start[i] : end[i]].decode("utf-8", "replace")), 1):
                    if kind < 3:
                        base += [(s + at, kind, e + at) for s, e in spans]
                    else:
                        others += [(s + at, e + at) for s, e in spans]
            base.sort()
            runs = [p for s, e in others for p in _outside(s, e, base, 20) if _mixed(text[p[0] : p[1]])]
            for s, e in runs:
                x.append(np.array([window(text, i, e) for i in starts(text, s, e)]))
                asked.append((lo + r, s, e))
            for s, e in (m.span(1) for m in NAMED.finditer(text)) if called else ():
                if _mixed(text[s:e]) and _outside(s, e, base, 1) == [(s, e)] and (s, e) not in runs:
                    x.append(window(text, s, e)[None])
                    asked.append((lo + r, s, e))
            out.append((base, []))
    for (r, s, e), score in zip(asked, best(net, x), strict=True):
        if score >= net.threshold and not any(a <= s and e <= b for a, _, b in out[r][1]):
            out[r][1].append((s, 3, e))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secret_spans(docs: DataFrame, text_col: str = "text") -> Column:
    """A column of ``RESULT`` for ``docs``."""
    net = small_batches(docs).sparkSession.sparkContext.broadcast(trained())  # a few KB

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for base, more in find(texts, net.value):
            n = [sum(1 for b in base if b[1] == k) for k in range(3)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined([*base, *more])))
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT).asNondeterministic()(F.col(text_col))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; texts without spans, and nulls, stay as they are."""
    net = small_batches(docs).sparkSession.sparkContext.broadcast(trained())  # a few KB

    def run(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, (base, more) in enumerate(find(texts, net.value)):
            if base or more:
                pieces, at = [], 0
                for s, _, e in sorted([*base, *more]):
                    if e <= at:
                        continue
                    if s >= at:
                        pieces += [out[i][at:s], mark]
                    at = e
                out[i] = "".join([*pieces, out[i][at:]])
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(text_col, F.arrow_udf(run, "string").asNondeterministic()(F.col(text_col)))
