"""N-gram Jaccard self join by T-occurrence search (op 9).

A document is the set of its distinct k-word shingles.  Two documents link when
100 * intersection >= 75 * union.  The join is exact up to equality of 64-bit
hashes of shingles and sets and works in these steps.

1. Texts with equal sets share one *node*; links are sought between nodes only,
   so a group of copies of any size costs one node.
2. A partner of x shares at least T = ceil(3/4 |x|) shingles with it.  In hash
   order the first l shared shingles lie among the first |x| - T + l of either
   set, so only those are counted.  They travel packed: a *chunk* is a row with
   the tokens of many nodes, sends each of its distinct tokens once, as 32 bits, to
   the bucket that the token's last bits name, and gets back a byte for the length
   of the token's list over all chunks.  Two tokens with the same bits count as
   one: a list may then seem longer, never shorter, so no link is lost.
3. A node with fewer than l tokens on lists of two nodes or more has no partner
   and goes.  The rest meet again, now only where their sizes allow a link, and
   the same rule is applied again.  Of a node's lists the l - 1 longest are only
   to be probed; the shorter ones tie it to their hub, the smallest node on the
   list.  Two partners share a hub at least.
4. The nodes of a hub are dealt into groups of about ``GROUP`` shingles, the hub
   in each, and every group is searched.  What has met now bears one label.
5. Where all nodes tied to a hub bear one label, every pair of them is settled.
   The rest, few as a rule, send out all their shingles: step 3 is repeated with
   l = T, where the T - 1 longest lists, those of passages that many documents
   share, tie nothing.  Nodes that hubs with several labels still tie form
   blocks (connected components).  A block is dealt into parts of about
   ``BLOCK`` shingles by label, and each pair of parts that does not bear one
   label throughout is searched in a task of its own: exact, in bounded memory.

A search takes the sets by size.  DivideSkip merges the short lists with a heap,
keeps the nodes seen T - L times, binary-probes the L long lists and so retains
the nodes that reach the required overlap.

Defined cases: null or wordless text has an empty set and links with nothing;
fewer than k words make one shingle of the whole sequence; repeated rows and
equal texts link (their sets are equal); an empty table gives an empty result;
further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import SPACED, U64, discard, durable, grams, let_go, mix, slices, small_batches, words
from notelake.llm.components import connected_components

#: Shingles of one group around a hub, and of one part of a block; 8 bytes each.
GROUP, BLOCK = 32_768, 32_768
#: Nodes up to which a list of them is broadcast (8 bytes each).
BROADCAST_NODES = 1_000_000
#: Parts by the tokens' last bits in which prefixes can be had as lists.
PARTS = 4
#: Tokens of one chunk, and about as many of a bucket, when lists are counted.
CHUNK, BUCKET = 262_144, 524_288
#: Places that a step of the heap covers.
SPAN = 4_096
_SHARE = 10


def required(n: int, percent: int) -> int:
    """The least overlap that a set of n shingles needs with any partner."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """l: how many shared tokens the prefixes of two partners must have, if both have n."""
    return 1 + n // _SHARE


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for lo, hi, data, offsets in slices(texts):
        h, row, _, _ = words(data, offsets, SPACED)
        g, at = grams(h, row, k)
        first = np.searchsorted(row[at], np.arange(hi - lo + 1))
        word_at = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            own = g[first[i] : first[i + 1]]
            if len(own):
                yield lo + i, np.unique(own)
            elif word_at[i] < word_at[i + 1]:
                whole = U64(word_at[i + 1] - word_at[i])
                with np.errstate(over="ignore"):
                    for x in h[word_at[i] : word_at[i + 1]]:
                        whole = mix(np.array([whole * U64(0xA0761D6478BD642F) + x]))[0]
                yield lo + i, np.array([whole], dtype=U64)
            else:
                yield lo + i, own


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _packed(arrays: list[np.ndarray | None], width: int = 8) -> pa.Array:
    """Binary values of the arrays' bytes, ``width`` to a number; null for None."""
    ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) * width for x in arrays])]).astype(np.int32)
    own = [x for x in arrays if x is not None and len(x)]
    data = pa.py_buffer(np.concatenate(own) if own else b"")
    valid = None if len(own) == len(arrays) else pa.array([x is not None for x in arrays], pa.bool_()).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(arrays), [valid, pa.py_buffer(ends), data])


def _unpacked(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=kind) for x in column]


def _told(k: int, percent: int):
    """Of rows (id, text, digest of the text): id, size, node, digest, and the prefix of each set that is new in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: set[int] = set()
        for b in batches:
            n: list[int] = []
            node: list[int | None] = []
            prefix: list[np.ndarray | None] = []
            held = lo = 0

            def batch(b=b):
                own = [b.column(i).slice(lo, len(n)) for i in (0, 2)]
                return pa.RecordBatch.from_arrays([own[0], pa.array(n, pa.int64()), pa.array(node, pa.int64()), own[1], _packed(prefix)], names=["id", "n_shingles", "node", "digest", "prefix"])

            for _, s in shingle_sets(b.column(1), k):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                new = len(s) > 0 and node[-1] not in seen
                prefix.append(s[: len(s) - required(len(s), percent) + extra(len(s))] if new else None)
                if new:
                    seen.add(node[-1])
                    held += len(prefix[-1])
                if held > 300_000:
                    yield batch()
                    lo += len(n)
                    n, node, prefix, held = [], [], [], 0
            if n:
                yield batch()

    return run


def _prefixes(k: int, percent: int):
    """Nodes of texts with their prefixes as lists, in ``PARTS`` by the tokens' last bits; the join itself packs them (``_told``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: set[int] = set()
        for b in batches:
            tokens, nodes, sizes = [], [], []
            held = 0
            for _, s in shingle_sets(b.column(0), k):
                n = len(s)
                if not n or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                own = s[: n - required(n, percent) + extra(n)]
                tokens.append(own)
                nodes.append(node)
                sizes.append((n, len(own)))
                held += len(own)
                if held > 300_000:
                    yield _prefix_batch(tokens, nodes, sizes)
                    tokens, nodes, sizes, held = [], [], [], 0
            if tokens:
                yield _prefix_batch(tokens, nodes, sizes)

    return run


def _prefix_batch(tokens: list, nodes: list, sizes: list) -> pa.RecordBatch:
    flat = np.concatenate(tokens).view(np.int64)
    at = np.repeat(np.arange(len(nodes)), [x[1] for x in sizes])
    columns = [pa.array(nodes, pa.int64()), pa.array([x[0] for x in sizes], pa.int64())]
    for part in range(PARTS):
        own = flat % PARTS == part
        ends = np.concatenate([[0], np.cumsum(np.bincount(at[own], minlength=len(nodes)))])
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[own])))
    return pa.RecordBatch.from_arrays(columns, names=["node", "n", *(f"t{i}" for i in range(PARTS))])


def _sets(k: int):
    def batch(nodes: list, sets: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _packed(sets)], names=["node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: set[int] = set()
        for b in batches:
            nodes, sets, held = [], [], 0
            for _, s in shingle_sets(b.column(0), k):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                sets.append(s)
                held += len(s)
                if held > 300_000:
                    yield batch(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield batch(nodes, sets)

    return run


def heap_merge(lists: list[np.ndarray], least: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Entries that occur on at least ``least`` of the sorted lists, and how often (MergeSkip by spans).

    The heap holds the lists' heads.  The lists whose heads lie within ``span``
    of the smallest one give up their entries there, which are counted together;
    if they are fewer than ``least``, nothing in the span can occur often enough
    and it is passed over.  The heads then jump, by binary search, past the span.
    """
    heap = [(int(x[0]), i, 0) for i, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    entries, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while heap and len(heap) >= least:
        low = heap[0][0]
        taken, back = [], []
        while heap and heap[0][0] < low + span:
            _, i, at = heapq.heappop(heap)
            end = at + int(np.searchsorted(lists[i][at:], low + span))
            taken.append(lists[i][at:end])
            if end < len(lists[i]):
                back.append((int(lists[i][end]), i, end))
        if len(taken) >= least:
            n = np.bincount(np.concatenate(taken) - low)
            often = np.flatnonzero(n >= max(1, least))
            entries.append(often + low)
            counts.append(n[often])
        for x in back:
            heapq.heappush(heap, x)
    return np.concatenate(entries), np.concatenate(counts)


def occurrences(lists: list[np.ndarray], t: int, needed=None) -> np.ndarray:
    """Entries on at least ``t`` of the sorted lists, or on ``needed(entries)`` (``t`` or more for each), by DivideSkip."""
    if len(lists) < t or t < 1:
        return np.empty(0, np.int64)
    lists = sorted(lists, key=len)
    n_long = min(t - 1, int(t / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
    found, count = heap_merge(lists[: len(lists) - n_long], t - n_long)
    least = np.full(len(found), t) if needed is None else needed(found)
    for left, x in zip(range(n_long, -1, -1), [*lists[len(lists) - n_long :], None], strict=True):
        live = count + left >= least
        found, count, least = found[live], count[live], least[live]
        if x is None or not len(found):
            break
        at = np.minimum(np.searchsorted(x, found), len(x) - 1)
        count = count + (x[at] == found)
    return found


def search_block(sets: list[np.ndarray], percent: int = 75, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the components of the sets (indices); exact.

    Sets are taken by size; each queries the lists of those before it that are
    large enough.  Sets of one label (if any are given) are joined already.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    ends = np.cumsum(sizes)
    _, ids, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    # A list holds the places of the sets with its token; where[i] is the place of the group's i-th shingle in all lists.
    by_token = np.argsort(ids, kind="stable")
    entries = np.repeat(np.arange(len(sets)), sizes)[by_token]
    begin = np.cumsum(times) - times
    where = np.empty(len(ids), np.int64)
    where[by_token] = np.arange(len(ids))
    root = np.arange(len(sets)) if labels is None else np.unique([labels[i] for i in order], return_inverse=True)[1]
    links = []
    for at, n in enumerate(sizes.tolist()):
        t = required(n, percent)
        low = int(np.searchsorted(sizes, t))
        if (root[low:at] == root[at]).all():
            continue
        own = slice(ends[at] - n, ends[at])
        lists = [x for b, e in zip(begin[ids[own]].tolist(), where[own].tolist(), strict=True) if len(x := entries[b:e]) and x[-1] >= low]
        lists = [x[np.searchsorted(x, low) :] for x in lists] if low and len(lists) >= t else lists
        near = occurrences(lists, t, lambda y, n=n: -(-percent * (n + sizes[y]) // (100 + percent)))
        for other, first in zip(*np.unique(root[near], return_index=True), strict=True):
            if other != root[at]:
                links.append((order[at], order[int(near[first])]))
                root[root == other] = root[at]
    return links


def _search(percent: int):
    def groups(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for task, node, label, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), _unpacked(b.column(3), U64), strict=True):
                yield task, node, label, s.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        u: list[int] = []
        v: list[int] = []
        for _, rows in groupby(groups(batches), key=lambda x: x[0]):
            own = {node: (label, s) for _, node, label, s in rows}
            if len(own) > 1:
                nodes, labels = list(own), [x[0] for x in own.values()]
                for i, j in search_block([x[1] for x in own.values()], percent, labels):
                    u.append(nodes[i])
                    v.append(nodes[j])
            if len(u) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def searched(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(u, v)`` of ``placed`` rows ``(task, node, label)``: a search in each task."""
    full = placed.join(sets, "node").select("task", "node", "label", "shingles")
    return full.repartition("task").sortWithinPartitions("task").mapInArrow(_search(percent), "u long, v long")


def node_column(text: Column, k: int = 5) -> Column:
    """The node of each text's set; null without words."""

    def run(texts: pa.Array) -> pa.Array:
        let_go()
        out: list[int | None] = [None] * len(texts)
        for i, s in shingle_sets(texts, k):
            out[i] = node_of(s) if len(s) else None
        return pa.array(out, pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # As nondeterministic it is worked out once and where it stands: a filter on it that moved down would run it
    # a second time beside it, over every row and in a second worker for each task.
    return F.arrow_udf(run, "long").asNondeterministic()(text)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, least, tokens), those of a node in one task, to chunks of many nodes, each node once."""
    let_go()
    seen: set[int] = set()
    rows: list[tuple[int, int, int]] = []
    tokens: list[np.ndarray] = []
    held = 0

    def chunk() -> pa.RecordBatch:
        name = int.from_bytes(os.urandom(8), "little", signed=True)
        what = np.array([(*x, len(t)) for x, t in zip(rows, tokens, strict=True)], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([held], pa.int64()), _packed([what.ravel()]), _packed([np.concatenate(tokens)])], names=["chunk", "m", "nodes", "tokens"])

    for b in batches:
        for node, n, least, own in zip(*(b.column(i).to_pylist() for i in range(3)), _unpacked(b.column(3), U64), strict=True):
            if node not in seen:
                seen.add(node)
                rows.append((node, n, least))
                tokens.append(own.copy())
                held += len(own)
            if held >= CHUNK:
                yield chunk()
                rows, tokens, held = [], [], 0
    if rows:
        yield chunk()


def _turned(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Tokens with their last bits, which name the bucket, in front."""
    return (tokens >> U64(bits)) | (tokens << U64(64 - bits))


def _asked(bits: int):
    """Chunks to rows (bucket, chunk, marks, times): 32 bits of each distinct token and how often the chunk has it, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for chunk, own in zip(b.column(0).to_pylist(), _unpacked(b.column(1), U64), strict=True):
                u, times = np.unique(_turned(own, bits), return_counts=True)
                at = np.searchsorted(u >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
                bucket = np.flatnonzero(np.diff(at))
                at = np.append(at[bucket], len(u))
                columns = [pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), chunk), pa.int64())]
                for x in ((u >> U64(32 - bits)).astype(np.uint32), np.minimum(times, 255).astype(np.uint8)):
                    columns.append(pa.Array.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]))
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "marks", "times"])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_asked`` by bucket to (chunk, bucket, lengths): a byte for each mark, 0 for a list of one node, else growing with the list."""
    let_go()
    rows = ((bucket, x) for b in batches for bucket, *x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _unpacked(b.column(2), np.uint32), _unpacked(b.column(3), np.uint8), strict=True))
    for bucket, group in groupby(rows, key=lambda x: x[0]):
        chunks, marks, times = zip(*((c, m.copy(), t.copy()) for _, (c, m, t) in group), strict=True)
        ends = np.cumsum([len(x) for x in marks])
        every = np.concatenate(marks)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.diff(every[order], prepend=every[order[:1]] ^ 1))
        total = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), first)
        lengths = np.empty(len(every), np.uint8)
        lengths[order] = np.repeat(np.where(total > 1, np.minimum(255, 8 * np.log2(total)), 0).astype(np.uint8), np.diff(first, append=len(every)))
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), _packed(np.split(lengths, ends[:-1]), 1)], names=["chunk", "bucket", "lengths"])


def _shared(bits: int):
    """Chunks with their answers to (node, n, least, on): the tokens (df, token) of lists of two nodes or more, if there are ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for what, tokens, answers in zip(_unpacked(b.column(0), np.int64), _unpacked(b.column(1), U64), b.column(2), strict=True):
                node, n, least, size = what.reshape(-1, 4).T
                own = _turned(tokens, bits)
                lengths = np.frombuffer(b"".join(x["lengths"] for x in answers.as_py()), np.uint8)[np.searchsorted(np.unique(own), own)]
                at = np.repeat(np.arange(len(node)), size)
                many = np.bincount(at[lengths > 0], minlength=len(node))
                enough = many >= least
                taken = (lengths > 0) & enough[at]
                on = pa.StructArray.from_arrays([pa.array(lengths[taken], pa.int32()), pa.array(tokens[taken].view(np.int64))], names=["df", "token"])
                ends = np.concatenate([[0], np.cumsum(many[enough])])
                yield pa.RecordBatch.from_arrays([pa.array(x[enough]) for x in (node, n, least)] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), on)], names=["node", "n", "least", "on"])

    return run


def listed(packed: DataFrame, least: str, source: DataFrame | None = None) -> DataFrame:
    """``(node, n, least, on)`` of rows (node, n, tokens): nodes on ``least`` lists or more that other nodes are on too, and these lists."""
    dealt = packed.select("node", "n", F.expr(least).alias("least"), "tokens").repartition("node")
    chunks = durable(dealt.mapInArrow(_chunks, "chunk long, m long, nodes binary, tokens binary"))
    if source is not None:
        discard(source)
    # 64 buckets at least and 2^24 at most: the marks are the 32 bits behind those that name the bucket.
    bits = min(24, max(6, math.ceil(math.log2(max(1, (chunks.agg(F.sum("m")).first()[0] or 0) / BUCKET)))))
    asked = chunks.select("chunk", "tokens").mapInArrow(_asked(bits), "bucket int, chunk long, marks binary, times binary")
    answers = durable(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answered, "chunk long, bucket int, lengths binary"))
    # Put in order by bucket: a chunk's own order.
    of = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "lengths"))).alias("answers"))
    out = durable(chunks.join(of, "chunk").select("nodes", "tokens", "answers").mapInArrow(_shared(bits), "node long, n long, least long, on array<struct<df: int, token: long>>"))
    for done in (chunks, answers):
        discard(done)
    return out


def candidate_ties(packed: DataFrame, least: str, percent: int, source: DataFrame | None = None) -> DataFrame:
    """``(u, n, v)``: the nodes that may have partners and the hubs of their short lists.

    ``packed`` has rows (node, n, tokens), the tokens as 8 bytes each; two partners share
    ``least`` (SQL, of n) of them or more. ``source``, the table they are read
    from, is removed once they have been.
    """
    held = listed(packed, least, source)
    # Partners' sizes differ by a factor of 100 / percent at most, so they share one of two neighbouring bands.
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    rows = held.select("node", "n", "least", F.explode("on").alias("t"), band.alias("b")).select("node", "n", "least", "t.df", "t.token", F.explode(F.array("b", F.col("b") + 1)).alias("band"))
    near = rows.groupBy("token", "band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("token", "band", "hub")
    met = rows.join(near, ["token", "band"]).groupBy("node", "n", "least").agg(F.collect_list(F.struct("df", "token", "hub")).alias("all"), F.sort_array(F.collect_set(F.struct("df", "token"))).alias("tokens"))
    ranked = met.where(F.size("tokens") >= F.col("least"))
    last = F.element_at("tokens", (F.size("tokens") - F.col("least") + 1).cast("int"))
    short = ranked.withColumn("last", last).withColumn("hubs", F.array_distinct(F.transform(F.filter("all", lambda x: F.struct(x["df"].alias("df"), x["token"].alias("token")) <= F.col("last")), lambda x: x["hub"])))
    ties = durable(short.select(F.col("node").alias("u"), "n", F.explode("hubs").alias("v")))
    discard(held)
    return ties


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows


def unsettled(ties: DataFrame, labels: DataFrame) -> DataFrame:
    """``(u, n, label, v)``: the ties of hubs whose nodes do not all bear one label."""
    named = ties.join(labels.select(F.col("node").alias("u"), "root"), "u", "left").select("u", "n", F.coalesce("root", "u").alias("label"), "v")
    several = named.groupBy("v").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a < z").select("v")
    return named.join(several, "v", "left_semi").select("u", "n", "label", "v")


def around_hubs(ties: DataFrame) -> DataFrame:
    """``(task, node, label)``: every node once, in a group of its smallest hub; the hub in each of its groups."""
    of = ties.groupBy("u", "n").agg(F.min("v").alias("hub"))
    dealt = of.groupBy("hub").agg(F.ceil(F.sum("n") / GROUP).alias("groups"), F.count("*").alias("m"))
    dealt = dealt.join(of.select(F.col("u").alias("hub"), F.col("hub").alias("above")), "hub", "left").where("m > 1 or above <> hub").select("hub", "groups")
    dealt = _few(durable(dealt))
    members = of.join(dealt, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("u"), F.col("groups"))).alias("task"), F.col("u").alias("node"))
    heads = dealt.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part")).select(F.xxhash64("hub", "part").alias("task"), F.col("hub").alias("node"))
    return members.unionByName(heads).distinct().withColumn("label", F.col("node"))


def pairs_of_parts(open_ties: DataFrame) -> DataFrame:
    """``(task, node, label)``: each block dealt into parts by label, a task for each pair of parts with several labels."""
    blocks = connected_components(open_ties.select("u", "v"))
    nodes = open_ties.select(F.col("u").alias("node"), "n", "label").distinct()
    nodes = nodes.join(blocks, "node", "left").select("node", "n", "label", F.coalesce("root", "node").alias("block"))
    heavy = nodes.groupBy("block", "label").agg(F.sum("n").alias("w")).withColumn("heavy", F.col("w") > BLOCK)
    light = heavy.where("not heavy").groupBy("block").agg(F.ceil(F.sum("w") / BLOCK).alias("parts"))
    sized = heavy.join(light, "block", "left").select("block", "label", F.when(F.col("heavy"), F.col("label")).alias("of"), F.when(F.col("heavy"), F.ceil(F.col("w") / BLOCK)).otherwise(F.col("parts")).alias("parts"))
    own = nodes.join(sized, ["block", "label"]).select("block", "node", "label", "of", F.pmod(F.xxhash64(F.when(F.col("of").isNull(), F.col("label")).otherwise(F.col("node"))), F.col("parts")).alias("part"))
    own = durable(own.withColumn("id", F.xxhash64("block", "of", "part")))
    parts = own.select("block", "of", "id").distinct()
    other = parts.select("block", F.col("of").alias("of2"), F.col("id").alias("id2"))
    pairs = parts.join(other, "block").where("(id < id2 or (id = id2 and of is null)) and not (of <=> of2 and of is not null)")  # a block has few parts
    tasks = pairs.select("id", F.xxhash64("id", "id2").alias("task")).unionByName(pairs.select(F.col("id2").alias("id"), F.xxhash64("id", "id2").alias("task"))).distinct()
    return own.join(tasks, "id").select("task", "node", "label")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own
    included.  ``percent`` is the least Jaccard similarity in hundredths.
    """
    rows, components = components_of(docs, id_col, text_col, k, percent)
    return rows.join(components, "node", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """``(id, n_shingles, node)`` for every row, and ``(node, root, component_id)`` for every distinct set.

    A node is a 64-bit digest of a set: among 10^9 distinct texts two unequal ones
    bear the same with a chance of 0.03.
    """
    # The digest finds the texts of the nodes that are left again without cutting all of them a second time.
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    told = durable(texts.mapInArrow(_told(k, percent), f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, node long, digest long, prefix binary"))
    rows = durable(told.select("id", "n_shingles", "node", "digest"))
    full = f"cast(ceil({percent}D * n / 100) as long)"
    ties = candidate_ties(told.where("prefix is not null").select("node", F.col("n_shingles").alias("n"), F.col("prefix").alias("tokens")), f"1 + {full} div {_SHARE}", percent, told)
    left = rows.join(_few(ties.select(F.col("u").alias("node")).distinct()), "node", "left_semi")
    wanted = _few(durable(left.groupBy("node").agg(F.min("digest").alias("digest")).select("digest").distinct()))
    sets = durable(texts.join(wanted, "digest", "left_semi").select("text").mapInArrow(_sets(k), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")))
    labels = connected_components(searched(around_hubs(ties), sets, percent))
    rest = durable(unsettled(ties, labels))
    more = None
    if not rest.isEmpty():
        left = sets.join(_few(rest.select(F.col("u").alias("node")).distinct()), "node", "left_semi")
        again = candidate_ties(left.select("node", F.expr("octet_length(shingles) div 8").alias("n"), F.col("shingles").alias("tokens")), full, percent)
        still = durable(unsettled(again, labels))
        if not still.isEmpty():
            more = _between_labels(searched(pairs_of_parts(still), sets, percent), labels)
        discard(again)
        discard(still)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if more is not None:
        named = named.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", "least", F.coalesce("top", "root").alias("root"))
    components = durable(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id"))
    for done in (ties, sets, rest):
        discard(done)
    return rows.select("id", "n_shingles", "node"), components


def _between_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Components ``(node, root)`` of the labels that links join."""
    for end in ("u", "v"):
        own = labels.select(F.col("node").alias(end), F.col("root").alias("_root"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return connected_components(links.select("u", "v"))
