"""Chat formatting as prefix trees (op 1).

Conversations that begin with the same turns share them: a turn is a node whose
parent is the turn before, and equal beginnings are one node.  Conversations are
sorted by the digests of their turns, which is depth-first order; what a
conversation shares with the one before it has been emitted already, so only the
rest is.  Each emitted turn carries its place in the stream, the position of its
first character within its conversation (the sum of what stands above it) and
the intervals of the stream that it may attend to: those of its ancestors, with
neighbours joined, so a conversation without branches has a single interval.
An assistant's turn has the interval of its (escaped) text under the loss mask,
without the template around it.  Places, positions and intervals count characters.

The stream is dealt into packs of about ``PACK`` characters that stand alone (a
training sequence cannot attend outside itself): where a pack or a range of the
sort begins, shared turns are emitted anew.

The template writes ``### Role: text </turn>`` and a line end.  In roles and
texts a backslash comes before every backslash, ``#`` and the ``<`` of
``</turn>``, and in roles before ``:`` also; reading drops it.

Equal conversations are laid out once however many there are.  Defined cases: a
null role or text is empty; a null turn comes first; equal turn numbers are
ordered by role, then text; repeated rows are turns of their own; a null conv_id
is a conversation; an empty table gives an empty stream; further columns are not
read.  A conversation is a record: it must fit a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a new pack begins (at a conversation's start).
PACK = 1_000_000
HEAD, TAIL = "### ", " </turn>\n"
STREAM = "pack string, seq long, parent long, depth int, segment string, start long, chars long, position long, attends array<struct<start: long, end: long>>, loss struct<start: long, end: long>, leaf string"
_TEXT = re.compile(r"[\\#]|<(?=/turn>)")
_ROLE = re.compile(r"[\\#:]|<(?=/turn>)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.S)
_MARK = r"\\\g<0>"
_ESCAPED = re.compile(r"\\(.)", re.S)


def format_turn(role: str, text: str) -> str:
    return "".join(turn_parts(role, text))


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the escaped text, and what stands after it."""
    return f"{HEAD}{_ROLE.sub(_MARK, role)}: ", _TEXT.sub(_MARK, text), TAIL


def read_turn(segment: str) -> tuple[str, str]:
    role, text = _TURN.fullmatch(segment).groups()
    return _ESCAPED.sub(r"\1", role), _ESCAPED.sub(r"\1", text)


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, leaf, path, turns)``: a row for each conversation; ``path`` is 16 bytes a turn."""
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    digest = F.transform("turns", lambda t: F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])))
    return rows.withColumn("path", F.array_join(digest, "")).select("conv_id", F.sha2("path", 256).alias("leaf"), "path", "turns")


def _shared(a: str, b: str) -> int:
    """Turns that two paths (32 hexadecimal digits a turn) have in common at the start."""
    n = 0
    while n < min(len(a), len(b)) and a[n : n + 32] == b[n : n + 32]:
        n += 32
    return n // 32


def _layout(pack_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, stack, pack, seq, at, first = "", [], None, 0, 0, ""
        for b in batches:
            out: list[tuple] = []
            for path, leaf, turns in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                keep = _shared(before, path)
                if pack is None or at >= pack_chars:
                    pack, seq, at, stack, keep = leaf, 0, 0, [], 0
                del stack[keep:]
                for k in range(keep, len(turns)):
                    head, text, tail = turn_parts(turns[k]["role"], turns[k]["text"])
                    segment, begin = head + text + tail, at + len(head)
                    loss = {"start": begin, "end": begin + len(text)} if turns[k]["role"] == "assistant" else None
                    parent = stack[-1] if stack else None
                    attends = [] if parent is None else _joined(parent[3], (parent[1], parent[2]))
                    position = parent[4] + parent[2] - parent[1] if parent else 0
                    out.append((pack, seq, parent[0] if parent else None, k, segment, at, len(segment), position, [{"start": s, "end": e} for s, e in attends], loss, leaf if k == len(turns) - 1 else None))
                    stack.append((seq, at, at + len(segment), attends, position))
                    seq += 1
                    at += len(segment)
                before = path
            yield _batch(out)

    return run


def _joined(intervals: list[tuple[int, int]], last: tuple[int, int]) -> list[tuple[int, int]]:
    if intervals and intervals[-1][1] == last[0]:
        return [*intervals[:-1], (intervals[-1][0], last[1])]
    return [*intervals, last]


_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_KINDS = {"pack": pa.string(), "seq": pa.int64(), "parent": pa.int64(), "depth": pa.int32(), "segment": pa.string(), "start": pa.int64(), "chars": pa.int64(), "position": pa.int64(), "attends": pa.list_(_INTERVAL), "loss": _INTERVAL, "leaf": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS.values())], names=list(_KINDS))


def tree_stream(convs: DataFrame, pack_chars: int = PACK) -> DataFrame:
    """The depth-first streams of the trees of :func:`conversations`; a row for each emitted turn."""
    distinct = convs.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    ordered = distinct.select("path", "leaf", "turns").repartitionByRange("path").sortWithinPartitions("path")
    return ordered.mapInArrow(_layout(pack_chars), STREAM)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read conversations off packs that come one after the other, each in the order of ``seq``."""
    pack, stack = None, []
    for b in batches:
        out = []
        for own, depth, segment, start, chars, position, loss, leaf in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if own != pack:
                pack, stack = own, []
            del stack[depth:]
            turns_sha, loss_sha, loss_chars = (stack[-1][0].copy(), stack[-1][1].copy(), stack[-1][2]) if stack else (hashlib.sha256(), hashlib.sha256(), 0)
            role, text = read_turn(segment)
            turns_sha.update(f"{role}\n{text}\n".encode())
            if loss:
                masked = _ESCAPED.sub(r"\1", segment[loss["start"] - start : loss["end"] - start])
                loss_sha.update(masked.encode())
                loss_chars += len(masked)
            stack.append((turns_sha, loss_sha, loss_chars))
            if leaf is not None:
                out.append((leaf, depth + 1, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), position + chars))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(stream: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from the stream: ``leaf`` and the columns of the contract.

    The running digests of shared turns are taken once, like the turns themselves.
    """
    own = stream.select("pack", "depth", "segment", "start", "chars", "position", "loss", "leaf", "seq")
    packs = own.repartition("pack").sortWithinPartitions("pack", "seq").drop("seq")
    return packs.mapInArrow(_read, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(turns: DataFrame, pack_chars: int = PACK) -> tuple[DataFrame, DataFrame]:
    """The emitted stream, and ``(conv_id, leaf)`` to find a conversation's last turn in it."""
    convs = conversations(turns)
    return tree_stream(convs, pack_chars), convs.select("conv_id", "leaf")
