"""Byte-pair encoding by a tokenization automaton (op 5).

The merges are compiled into a deterministic automaton over tokens that accepts
exactly the token sequences byte-pair encoding can produce.  Construction is by
successive merge gadgets.  At first one state has an arc to itself for every
base symbol.  A merge (u, v) -> w of rank i

* adds a state s, a copy of the state that u leads to, without its arc for v;
* lets every arc for u lead to s;
* gives w's arc, wherever an arc for u leaves, the state that v led to.

So all arcs of one label lead to one state, ``target``.  Rows of the transition
table are kept as differences: the states that u's merges add, one after the
other, each lack one arc more of the row that u's first state was copied from
(``below``), namely those that went at the state's rank or before (``gone``).
49,000 states with 49,000 arcs each would not fit a worker; a cell is read from
the differences once and stays in the table (``cells``) from then on.

A pre-split word is encoded by one run of transitions: of the arcs whose labels
stand in the word where the run is (a trie of the vocabulary finds them) it
follows the longest that its state has, and steps back where none leads on.  The
automaton being exact, one run reaches each position, so no position is come
upon twice and long words take linear time.  Many words run side by side
(``encode_all``): the arcs of all of them, by the position they end at, with the
tables in numpy.  Decoding emits the arcs' labels.

Code points that Python's tables do not know yet are letters, numbers or neither
as in the library's own (``newer``); canonical compositions among them are not.

Defined cases: null counts as empty text, which has no tokens; added tokens
standing literally in a text are single tokens, as the library has them; very
long words take linear time; rows are encoded one by one, so ties, repeated rows,
empty tables and further columns need no rule.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import held, small_batches

#: Entries after which a worker's memory of chunks, words (each kept in two such parts) or cells starts anew: just below those at which a dictionary's table doubles.
REMEMBERED, WORDS, CELLS = 87_000, 43_000, 43_000
#: Cells that runs side by side remember, as a power of 2; and the bytes of texts and the chunks that are learned at once.
CELL_BITS, AT_ONCE, CHUNKS = 19, 1 << 18, 16_000
#: The symbol of no place: words in UTF-8 do not end with the byte 0xFF.
NONE = 511
RESULT = "struct<n_tokens: long, ids: array<int>>"
DIGEST = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Letters below this are letters for every Unicode version; and the ASCII marks, a run of which is one word.
_OLD, _MARKS = "\u0250", bytes(c for c in range(128) if not chr(c).isalnum() and not 9 <= c <= 13 and c != 32)
_WORD = "(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letters}+|{numbers}|[^" + _SPACE + "{letters}{numbers}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def newer() -> dict:
    """Code points that the tables at hand and the library's judge differently, all of them unassigned in Python's.

    For letters and for numbers those to add and those to drop; and letters' lower case.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    unknown = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    out: dict = {}
    for name, kind in (("letters", r"[\p{L}]"), ("numbers", r"[\p{N}]")):
        split = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
        theirs = [c for i in range(0, len(unknown), 4_096) for c, _ in split.pre_tokenize_str("".join(unknown[i : i + 4_096]))]
        ours = regex.findall(kind, "".join(unknown))
        out[name] = [_ranges(set(theirs) - set(ours)), _ranges(set(ours) - set(theirs))]
    lower = normalizers.Lowercase()
    out["lower"] = {c: x for c in unknown if (x := lower.normalize_str(c)) != c}
    return out


def _ranges(chars: set[str]) -> str:
    """The inside of a character class, as ranges."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _kind(base: str, add: str, drop: str) -> str:
    """A character class of ``base`` with and without some."""
    return f"[{base}{add}]" if not drop else f"[[{base}{add}]--[{drop}]]"


@lru_cache(maxsize=1)
def _newer() -> dict:
    return newer()


def _spread(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of 2^bits rows."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class _Table:
    """A number of 0 or more for each of some keys, looked up for many keys at once by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = _spread(keys, self.bits)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 for what is not there."""
        at = _spread(keys, self.bits)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there, own = self.keys[at[left]], keys[left]
            out[left[there == own]] = self.values[at[left[there == own]]]
            left = left[(there != own) & (there != -1)]
        return out


class Automaton:
    """The compiled merges. ``start`` is the state before the first token."""

    start = 0

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.labels = {i: t for t, i in vocabulary.items()}
        self.left: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        # by state: the label that leads to it, the rank it was added at, the row its label's first state is a copy of
        self.label, self.born, self.below = [-1], [-1], [0]
        n_ids = max(vocabulary.values(), default=0) + 1
        self.target, self.size = [self.start] * n_ids, [1] * n_ids
        self.gone: dict[int, int] = {}
        for i, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            before, after = self.target[u], self.target[v]
            self.gone[u << 20 | v] = i
            self.target[u] = len(self.label)
            self.below.append(self.below[before] if self.label[before] == u else before)
            self.label.append(u)
            self.born.append(i)
            self.target[w] = after
            self.left[w], self.rank[w] = u, i
        self.trie: dict = {}
        for t, i in vocabulary.items():
            at, own = self.trie, symbols(t)
            self.size[i] = len(own)
            for c in own:
                at = at.setdefault(c, {})
            at[""] = i
        # a node that only ends a label is the label's id: most are, and a dictionary for each takes 184 bytes
        codes = {c: b for b, c in enumerate(byte_alphabet())}
        codes |= {c + "</w>": b + 256 for c, b in codes.items()}
        nodes, n, edges, ends = [(0, self.trie)], 1, [], [-1]
        for k, at in nodes:
            for c, below in at.items():
                if not c:
                    continue
                ends.append(below.get("", -1))
                if codes.get(c, NONE) != NONE:
                    edges.append((k << 9 | codes[c], n))
                if below.keys() == {""}:
                    at[c] = below[""]
                else:
                    nodes.append((n, below))
                n += 1
        self.cells: dict[int, int] = {}
        # the same for runs side by side: nodes of the trie by parent << 9 | symbol, and tables by state or token
        of = np.array(edges, np.int64).reshape(-1, 2)
        self.nodes, self.ends = _Table(of[:, 0], of[:, 1]), np.array(ends, np.int32)
        self.roots, self.pairs = np.full(512, -1, np.int32), np.full(1 << 18, -1, np.int32)
        top = of[:, 0] < 512
        self.roots[of[top, 0]] = of[top, 1]
        by_node = np.full(n, -1, np.int64)
        by_node[of[top, 1]] = of[top, 0]
        second = by_node[of[:, 0] >> 9] >= 0
        self.pairs[by_node[of[second, 0] >> 9] << 9 | of[second, 0] & 511] = of[second, 1]
        self.inner = np.zeros(n, bool)
        self.inner[[k for k, _ in nodes]] = True
        self.went = _Table(np.fromiter(self.gone, np.int64, len(self.gone)), np.fromiter(self.gone.values(), np.int64, len(self.gone)))
        self.states = np.array([self.label, self.born, self.below], np.int32)
        self.tokens = np.full((4, n_ids), -1, np.int32)  # target, left part, rank, symbols
        self.tokens[0], self.tokens[3] = self.target, self.size
        for row, known in zip(self.tokens[1:3], (self.left, self.rank), strict=True):
            row[np.fromiter(known, np.int64, len(known))] = np.fromiter(known.values(), np.int32, len(known))
        self.read = np.full(1 << CELL_BITS, -1, np.int64)

    def step(self, state: int, token: int) -> int:
        """The state that the arc for ``token`` leads to, or -1."""
        key = state << 20 | token
        known = self.cells.get(key)
        if known is None:
            if len(self.cells) > CELLS:
                self.cells.clear()
            known = self.cells[key] = self.target[token] if self._has_arc(state, token) else -1
        return known

    def _has_arc(self, state: int, token: int) -> bool:
        """Read a cell from the differences.

        A row lacks an arc if it went at the row's rank or before.  An arc of a
        later merge was added where its left part then had one, so the left parts
        of ``token`` are looked up too, for what had gone when it was added.
        """
        while state != self.start:
            label, until, t = self.label[state], self.born[state], token
            while True:
                went = self.gone.get(label << 20 | t)
                if went is not None and went <= until:
                    return False
                if t not in self.left:
                    break
                until, t = min(until, self.rank[t]), self.left[t]
            state = self.below[state]
        return True

    def encode(self, word: list[str]) -> list[int]:
        """Token ids of one word, given as base symbols."""
        n, i, row = len(word), 0, self.start
        out: list[int] = []
        ways: list[list[int]] = []  # by token of the run: shorter arcs at its beginning, not tried yet
        size, step, cells, target = self.size, self.step, self.cells, self.target
        while i < n:
            at, arcs = self.trie, []
            for j in range(i, n):
                at = at.get(word[j])
                if at is None:
                    break
                if at.__class__ is not dict:
                    arcs.append(at)
                    break
                token = at.get("")
                if token is not None:
                    arcs.append(token)
            while True:
                while arcs:
                    token = arcs.pop()
                    to = cells.get(row << 20 | token)
                    if to is None:
                        to = step(row, token)
                    if to != -1:
                        break
                else:
                    last = out.pop()
                    i -= size[last]
                    arcs = ways.pop()
                    row = target[out[-1]] if out else self.start
                    continue
                break
            out.append(token)
            ways.append(arcs)
            i += size[token]
            row = to
        return out


    def have_arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token beside it."""
        key = states.astype(np.int64) << 20 | tokens
        at = _spread(key, CELL_BITS)
        known = self.read[at]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            out[new] = self._read_cells(states[new], tokens[new])
            self.read[at[new]] = key[new] << 1 | out[new]
        return out

    def _read_cells(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """:meth:`_has_arc` for many cells."""
        (labels, born, below), (_, left, rank, _) = self.states, self.tokens
        out = np.ones(len(states), bool)
        on = np.flatnonzero(states != self.start)
        while len(on):
            row = states[on]
            at, label, until, t = on, labels[row].astype(np.int64), born[row], tokens[on]
            while len(at):
                went = self.went.get(label << 20 | t)
                lost = (went != -1) & (went <= until)
                out[at[lost]] = False
                more = ~lost & (left[t] != -1)
                at, label, until, t = at[more], label[more], np.minimum(until[more], rank[t[more]]), left[t[more]]
            states = states.copy()
            states[on] = below[row]
            on = on[out[on] & (states[on] != self.start)]
        return out

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and where each word's end; every byte must be a label of its own."""
        target, _, _, size = self.tokens
        long = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(long + 1) - 1  # a word has a place for each symbol and one for its end
        first = last - long
        sym = np.full(int(long.sum()) + len(words), NONE, np.int64)
        place = np.ones(len(sym), bool)
        place[last] = False
        sym[place] = np.frombuffer(b"".join(words), np.uint8)
        sym[last - 1] += 256
        deep = np.arange(len(sym)) - np.repeat(first, long + 1)
        at, n, arcs = np.flatnonzero(place), 1, []
        node = self.roots[sym[at]]
        while len(at):
            n += 1
            end = self.ends[node]
            is_arc = np.flatnonzero(end != -1)
            arcs.append((at[is_arc], at[is_arc] + (n - 1), end[is_arc]))
            more = np.flatnonzero(self.inner[node])
            at, node = at[more], node[more]
            node = self.pairs[sym[at] << 9 | sym[at + 1]] if n == 2 else self.nodes.get(node.astype(np.int64) << 9 | sym[at + n - 1])
            there = np.flatnonzero(node != -1)
            at, node = at[there], node[there]
        begin, end, token = (np.concatenate(x) for x in zip(*arcs, strict=True))
        depth = deep[end].astype(np.uint16)
        order = np.argsort(depth, kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(depth))))
        state, come = np.full(len(sym), -1, np.int32), np.full(len(sym), -1, np.int32)
        state[first] = self.start
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, t, to = state[begin[a:b]], token[a:b], end[a:b]
            led = (own != -1) & ((own == self.start) | self.have_arcs(own, t))
            state[to[led]], come[to[led]] = target[t[led]], t[led]
        run = np.zeros(len(sym), bool)
        at, start = last, first
        while len(at):
            run[at] = True
            at = at - size[come[at]]
            at, start = at[at > start], start[at > start]
        return come[run], np.cumsum(run)[last]


def symbols(token: str, end: str = "</w>") -> list[str]:
    """A token's base symbols; the end-of-word mark belongs to the last one."""
    if token.endswith(end) and len(token) > len(end):
        body = token[: -len(end)]
        return [*body[:-1], body[-1] + end]
    return list(token)


class Encoder:
    """A tokenizer file of the word-end kind, run by its automaton."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        more = spec.get("newer") or newer()
        model = spec["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges)
        self.labels = self.automaton.labels
        self.labels.update({i: t for t, i in self.added.items()})
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.word = regex.compile(_WORD.format(letters=_kind(r"\p{L}", *more["letters"]), numbers=_kind(r"\p{N}", *more["numbers"])))
        self.lower = str.maketrans(more["lower"])
        self.bytes = byte_alphabet()
        self.words = _Memory(self.encode_word, WORDS)
        self.ids = _Memory(self.chunk, REMEMBERED)
        self.by_text = {b"%d" % i: t.encode() for i, t in self.labels.items()}
        self.names = [b""] * (max(self.labels, default=0) + 1)
        for i in self.by_text:
            self.names[int(i)] = i
        self.whole = all(c in model["vocab"] and c + "</w>" in model["vocab"] for c in self.bytes) and all("<" in t for t in self.added)

    def chunk(self, chunk: bytes) -> bytes:
        """Ids, joined by spaces, of a stretch without ASCII white space; nothing reaches across such space."""
        out: list[bytes] = []
        for k, part in enumerate(self.split.split(chunk.decode("utf-8", "replace")) if self.split else [chunk.decode("utf-8", "replace")]):
            if k % 2:
                out.append(b"%d" % self.added[part])
            else:
                out.extend(map(self.words.__getitem__, self.cut(part.encode())))
        return b" ".join(out)

    def cut(self, part: bytes) -> tuple[bytes, ...]:
        """The words of a stretch without added tokens."""
        if part.isascii():
            low = part.lower()
            body = low.rstrip(_MARKS)
            if body.isalpha():
                return (body,) if len(body) == len(low) else (body, low[len(body) :])
            folded = low.decode()
        else:
            folded = unicodedata.normalize("NFC", part.decode("utf-8", "replace")).replace("Σ", "σ").lower()
            if max(folded) >= _OLD:
                folded = folded.translate(self.lower)
            elif folded.isalpha():
                return (folded.encode(),)
        return tuple([w.encode() for w in self.word.findall(folded)])

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids, joined by spaces, of chunks that are not in the newer part of what is remembered; all words that are new run side by side."""
        out, plain, rare, known, cut, split = {}, [], [], self.ids.older.get, self.cut, self.split
        for c in chunks:
            x = known(c)
            if x is not None:
                out[c] = x
            elif self.whole and len(c) < 64 and (b"<" not in c or not split):
                plain.append(c)
            else:
                rare.append(c)  # very long ones, and what may hold added tokens
        for i in range(0, len(plain), CHUNKS):
            part = plain[i : i + CHUNKS]
            cuts = [cut(c) for c in part]
            words = self.words.known({w for x in cuts for w in x})
            own = [w for w, x in words.items() if x is None]
            if own:
                ids, ends = self.automaton.encode_all(own)
                labels, a = list(map(self.names.__getitem__, ids.tolist())), 0
                for w, b in zip(own, ends.tolist(), strict=True):
                    words[w] = b" ".join(labels[a:b])
                    a = b
            self.words.keep_all(words)
            get = words.__getitem__
            out.update({c: get(x[0]) if len(x) == 1 else b" ".join(map(get, x)) for c, x in zip(part, cuts, strict=True)})
        self.ids.keep_all(out)
        for c in rare:
            out[c] = self.ids[c]
        return out

    def encode_word(self, w: bytes) -> bytes:
        """A word's ids, joined by spaces."""
        own = [self.bytes[b] for b in w]
        own[-1] += "</w>"
        return b" ".join([b"%d" % i for i in self.automaton.encode(own)])

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in text.encode().split() for i in self.chunk(c).split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.labels[i] for i in ids)


class _Memory(dict):
    """What ``work`` makes of keys; what is missing is worked out.

    Of two parts of ``most`` entries the older one is let go whenever the newer one
    is full, so that keys asked for again and again stay.
    """

    def __init__(self, work, most: int) -> None:
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.work(key)
        self.keep(key, out)
        return out

    def keep(self, key, out) -> None:
        if len(key) >= 64:
            return
        if len(self) >= self.most:
            self.older = {}
            self.older = dict(self)
            self.clear()
        self[key] = out

    def keep_all(self, more: dict) -> None:
        """The same for many short keys."""
        if len(more) > self.most:
            more = dict(itertools.islice(more.items(), self.most))
        if len(self) + len(more) > self.most:
            self.older = {}
            self.older = dict(self)
            self.clear()
        self.update(more)

    def known(self, keys) -> dict:
        """What is remembered of the keys, else None."""
        get, older = self.get, self.older.get
        return {k: older(k) if (x := get(k)) is None else x for k in keys}


def encoder(spec: str) -> Encoder:
    return held(("bpe", spec), lambda: Encoder(spec))


def _lines(e: Encoder, texts: pa.Array):
    """The ids of each text, joined by spaces; null counts as empty."""
    get, own, new, n = e.ids.get, [], set(), 0
    for i, t in enumerate(texts, 1):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        chunks = raw.split()
        ids = list(map(get, chunks))
        unknown = [(k, chunks[k]) for k, x in enumerate(ids) if x is None]
        new.update([c for _, c in unknown])
        own.append((ids, unknown))
        n += len(raw)
        if n > AT_ONCE or i == len(texts):
            made = e.learn(new)
            for ids, unknown in own:
                for k, c in unknown:
                    ids[k] = made[c]
                yield b" ".join(filter(None, ids))
            own, new, n = [], set(), 0


def _spec(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        spec = json.dumps(json.load(f) | {"newer": _newer()})
    return docs.sparkSession.sparkContext.broadcast(spec)  # a tokenizer file: a few MB


def bpe_digests(docs: DataFrame, path: str, text_col: str = "text") -> Column:
    """Per text the number of tokens, and SHA-256 of the ids and of the decoded text."""
    spec = _spec(small_batches(docs), path)

    def run(texts: pa.Array) -> pa.Array:
        e = encoder(spec.value)
        n, ids_sha, text_sha = [], [], []
        for ids in _lines(e, texts):
            n.append(ids.count(b" ") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(b" ".join(map(e.by_text.__getitem__, ids.split()))).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, DIGEST).asNondeterministic()(F.col(text_col))


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text") -> Column:
    """Per text the token ids."""
    spec = _spec(small_batches(docs), path)

    def run(texts: pa.Array) -> pa.Array:
        e = encoder(spec.value)
        ids = [[int(x) for x in own.split()] for own in _lines(e, texts)]
        return pa.StructArray.from_arrays([pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["n_tokens", "ids"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT).asNondeterministic()(F.col(text_col))


def bpe_decode(docs: DataFrame, path: str, ids_col: str = "ids") -> Column:
    """Per row the labels of its ids, joined by a space; null for null."""
    spec = _spec(small_batches(docs), path)

    def run(ids: pa.Array) -> pa.Array:
        e = encoder(spec.value)
        return pa.array([None if x is None else e.decode(x) for x in ids.to_pylist()], pa.string())

    run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string").asNondeterministic()(F.col(ids_col))
