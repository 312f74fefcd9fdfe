"""Benchmark decontamination by a prefix-filtered set join (op 10).

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded.
An item is cut into windows of ``window`` consecutive words (an item with fewer
words, but not none, is one window).  A document contains a window when all of
the window's shingles stand in one item-sized stretch of it, so with shingles
ordered by rarity one prefix shingle, the rarest, is enough to join on:

1. all documents are counted for the shingles of the items (corpus rarity);
2. every window is put on a list under its rarest shingle, with its offset;
3. each document's shingles are looked up; a hit gives a window and a place.
   Length and position bounds drop windows that would not fit the document;
4. the stretch is compared word by word.

Items of up to ``ITEM_BYTES`` of text are held by every worker: documents are only
scanned, and nothing about them is shuffled but shingle counts.  Larger sets of
items stay tables: the places of documents whose shingle may be an item's (a bit
map of ``BITS`` bits, the only thing that is broadcast) meet the prefix lists by a
shuffled join, each with the words around it, against which the window is compared.

Defined cases: null or wordless documents have no words and no hits; null or
wordless items have no windows; a null item_id is written "null"; repeated items
count once by item_id; repeated documents are judged row by row; further columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import ALNUM, LOWER, U64, durable, grams, let_go, mix, slices, small_batches, words

SHINGLE = 3
#: Bytes of item texts up to which the windows are held by every worker (about 150 bytes for each byte of text).
ITEM_BYTES = 1 << 20
#: Bits of the map of item shingles that larger sets of items are sifted by (8 MB).
BITS = 1 << 26
RESULT = "struct<n_words: long, n_hit: long, items: array<string>>"


def item_words(text: str | None) -> list[bytes]:
    for _, _, data, offsets in slices(pa.array([text], pa.string())):
        _, _, start, end = words(data, offsets, ALNUM)
        folded = LOWER[data].tobytes()
        return [folded[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    return []


def windows_of(items: list[tuple], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Distinct windows and the ids of the items they come from."""
    out: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item_id, text in items:
        own = item_words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            out[tuple(own[i : i + window])].add("null" if item_id is None else str(item_id))
    return out


def shingle_hashes(window: tuple[bytes, ...]) -> tuple[int, np.ndarray]:
    """(shingle size, hashes of the window's shingles in order)."""
    data = b" ".join(window)
    h, row, _, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM)
    k = min(SHINGLE, len(window))
    return k, grams(h, row, k)[0]


class Part:
    """The windows of a bounded set of items: their shingles and, once rarity is known, the prefix lists."""

    def __init__(self, items: list[tuple], window: int) -> None:
        found = windows_of(items, window)
        self.windows = list(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.shingles = [shingle_hashes(w) for w in self.windows]
        self.by_size = {k: np.unique(np.concatenate([h for s, h in self.shingles if s == k])) for k in {s for s, _ in self.shingles}}
        self.prefix: dict = {}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        lists: dict[tuple[int, int], list] = defaultdict(list)
        for i, (k, h) in enumerate(self.shingles):
            keys = [(counts.get((k, int(x)), 0), int(x), at) for at, x in enumerate(h)]
            _, rarest, at = min(keys)
            lists[k, rarest].append((i, at))
        for k in self.by_size:
            own = np.array(sorted(h for s, h in lists if s == k), dtype=np.uint64)
            self.prefix[k] = (own, [lists[k, int(h)] for h in own])
        del self.shingles


def _look_up(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, place in h) of equal entries."""
    if not len(keys) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == h)
    return at[hit], hit


def _count(part: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        totals: dict[tuple[int, int], int] = defaultdict(int)
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                h, row, _, _ = words(data, offsets, ALNUM)
                for k, keys in part.value.by_size.items():
                    at, _ = _look_up(keys, grams(h, row, k)[0])
                    place, n = np.unique(at, return_counts=True)
                    for x, c in zip(keys[place].tolist(), n.tolist(), strict=True):
                        totals[k, x] += c
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in totals], pa.int32()),
                pa.array(np.array([x for _, x in totals], dtype=np.uint64).view(np.int64)),
                pa.array(list(totals.values()), pa.int64()),
            ],
            names=["k", "shingle", "n"],
        )

    return run


def _hits(part: Part, data: np.ndarray, h: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray, mask: np.ndarray, found: dict[int, set[str]]) -> None:
    folded = None
    for k, (keys, lists) in part.prefix.items():
        g, at = grams(h, row, k)
        which, where = _look_up(keys, g)
        for w, p in zip(which.tolist(), at[where].tolist(), strict=True):
            r = int(row[p])
            for i, offset in lists[w]:
                first, n = p - offset, len(part.windows[i])
                if first < bounds[r] or first + n > bounds[r + 1]:
                    continue
                if folded is None:
                    folded = LOWER[data].tobytes()
                if all(folded[start[first + j] : end[first + j]] == x for j, x in enumerate(part.windows[i])):
                    mask[first : first + n] = True
                    found[r].update(part.items[i])


def _judge(part: Broadcast):
    def run(texts: pa.Array) -> pa.Array:
        let_go()
        n_words, n_hit, items = [], [], []
        for lo, hi, data, offsets in slices(texts):
            h, row, start, end = words(data, offsets, ALNUM)
            bounds = np.searchsorted(row, np.arange(hi - lo + 1))
            mask = np.zeros(len(h), dtype=bool)
            found: dict[int, set[str]] = defaultdict(set)
            _hits(part.value, data, h, row, start, end, bounds, mask, found)
            total = np.concatenate([[0], np.cumsum(mask)])
            n_words.extend(np.diff(bounds).tolist())
            n_hit.extend((total[bounds[1:]] - total[bounds[:-1]]).tolist())
            items.extend(sorted(found.get(i, ())) for i in range(hi - lo))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["n_words", "n_hit", "items"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run


def _held_by_workers(docs: DataFrame, items: DataFrame, text_col: str, window: int) -> Column:
    sc = docs.sparkSession.sparkContext
    part = Part([(r.item, r.text) for r in items.toLocalIterator()], window)  # no more than ITEM_BYTES
    first = sc.broadcast(part)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    counted = texts.mapInArrow(_count(first), "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n"))
    part.order({(r.k, r.shingle % (1 << 64)): r.n for r in counted.toLocalIterator()})  # no more than the items have shingles
    first.unpersist()
    return F.arrow_udf(_judge(sc.broadcast(part)), RESULT).asNondeterministic()(F.col(f"`{text_col}`"))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = list(windows_of([(item, text)], window))
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join(w).decode() for w in own], pa.string()), pa.array([item] * len(own), pa.string())], names=["words", "item"])

    return run


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for w in b.column(0).to_pylist():
            own = tuple(w.encode().split(b" "))
            k, h = shingle_hashes(own)
            rows += [(w, len(own), k, x, at) for at, x in enumerate(h.view(np.int64).tolist())]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["words", "size", "k", "shingle", "at"])


def _bit(k: int, shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles + U64(k)) % U64(BITS)).astype(np.int64)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits set by this task's shingles, as bytes of the map that are not 0."""
    bits = np.zeros(BITS // 8, np.uint8)
    for b in batches:
        k, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(U64)
        for own in np.unique(k):
            at = _bit(int(own), h[k == own])
            np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
    where = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(bits[where].astype(np.int32))], names=["byte", "bits"])


def _met(bits: Broadcast, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                h, row, start, end = words(data, offsets, ALNUM)
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                raw, folded, rows, keys = data.tobytes(), LOWER[data].tobytes(), [], {}
                for k in range(1, SHINGLE + 1):
                    g, at = grams(h, row, k)
                    bit = _bit(k, g)
                    hit = np.flatnonzero(bits.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    for p, x in zip(at[hit].tolist(), g[hit].view(np.int64).tolist(), strict=True):
                        r = int(row[p])
                        if r not in keys:
                            keys[r] = hashlib.md5(raw[offsets[r] : offsets[r + 1]]).hexdigest()
                        first, last = max(int(bounds[r]), p - window + 1), min(int(bounds[r + 1]), p + window)
                        rows.append((keys[r], k, x, p - int(bounds[r]), first - int(bounds[r]), [folded[start[j] : end[j]].decode("utf-8", "replace") for j in range(first, last)]))
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "k", "shingle", "place", "first", "around"])

    return run


def _joined(docs: DataFrame, items: DataFrame, text_col: str, window: int) -> DataFrame:
    """``(key, hit, items)`` by the MD5 of a text, for texts with hits; nothing is held but the bit map."""
    sc = docs.sparkSession.sparkContext
    cut = durable(items.mapInArrow(_cut(window), "words string, item string").distinct())
    forms = durable(cut.select("words").distinct().mapInArrow(_forms, "words string, size int, k int, shingle long, at int"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in forms.select("k", "shingle").mapInArrow(_map, "byte long, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # BITS / 8 rows at most
        bits[r["byte"]] = r["bits"]
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    met = durable(texts.mapInArrow(_met(sc.broadcast(bits), window), "key string, k int, shingle long, place int, first int, around array<string>"))
    rarity = met.groupBy("k", "shingle").agg(F.count("*").alias("n"))
    prefix = forms.join(rarity, ["k", "shingle"]).groupBy("words", "size").agg(F.min(F.struct("n", "shingle", "at", "k")).alias("p"), F.count("*").alias("m"), F.first("k").alias("of"))
    whole = prefix.where("m = size - of + 1")  # every shingle of the window occurs somewhere
    lists = whole.select("words", "size", "p.k", "p.shingle", "p.at")
    stretch = F.array_join(F.slice("around", (F.col("place") - F.col("at") - F.col("first") + 1).cast("int"), F.col("size")), " ")
    fits = F.when((F.col("place") - F.col("at") >= F.col("first")) & (F.col("place") - F.col("at") - F.col("first") + F.col("size") <= F.size("around")), stretch == F.col("words"))
    hits = durable(met.join(lists, ["k", "shingle"]).where(fits).select("key", (F.col("place") - F.col("at")).alias("begin"), "size", "words").distinct())
    places = hits.select("key", "begin", "size").distinct().groupBy("key").agg(F.collect_list(F.struct("begin", "size")).alias("w"))
    places = places.select("key", F.size(F.array_distinct(F.flatten(F.transform("w", lambda x: F.sequence(x["begin"], x["begin"] + x["size"] - 1))))).cast("long").alias("n_hit"))
    named = hits.select("key", "words").distinct().join(cut, "words").select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return places.join(named, "key")


def judged(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``(row, contamination)``: whole rows, and words, words inside any occurring window, ids of the items (sorted)."""
    small_batches(docs)
    own = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    if (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= ITEM_BYTES:
        return docs.select(row.alias("row"), _held_by_workers(docs, own, text_col, window).alias("contamination"))
    found = _joined(docs, own, text_col, window)
    lower = F.translate(F.coalesce(F.col("row")[text_col], F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.size(F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    keyed = docs.select(row.alias("row")).withColumn("key", F.md5(F.col("row")[text_col].cast("binary"))).join(found, "key", "left")
    none = F.array().cast("array<string>")
    return keyed.select("row", F.struct(n_words.alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")).alias("contamination"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", drop: bool = True, **kinds) -> DataFrame:
    """``docs`` without the rows that hold a window of an item, or (``drop=False``) with a column ``contamination``."""
    rows = judged(docs, items, text_col, **kinds)
    if drop:
        return rows.where("contamination.n_hit = 0").select("row.*")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "contamination"], "contamination")
