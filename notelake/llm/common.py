"""Shared pieces: vectorised word hashing over Arrow text and durable tables.

Words are cut and hashed for a whole slice of texts at once on the raw UTF-8
bytes.  That is exact for the word classes used here because every byte of a
multi-byte character is 0x80 or above and those bytes always belong to a word.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Texts are worked on in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark, "_notelake_dir", None)
    if made is None:
        folder = tempfile.TemporaryDirectory(prefix="notelake-")
        atexit.register(folder.cleanup)
        made = spark._notelake_dir = folder.name
    return made


#: Folders that durable() has made and nobody has removed.
_made: list[str] = []

#: Lets Spark remove a finished write's shuffle files at once instead of when the driver collects garbage.
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/notelake-{uuid.uuid4().hex}"
    schema = df.schema
    _made.append(path)
    before = spark.conf.get(_CLEANUP_KEY, None)
    with contextlib.suppress(Exception):
        spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        with contextlib.suppress(Exception):
            spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)
    out = spark.read.schema(schema).parquet(path)
    out._notelake_path = path
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`durable` once nothing reads it any more."""
    folder = df.__dict__.get("_notelake_path")
    if folder:
        remove(df.sparkSession, folder)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """At the end removes the tables that were made within, for work whose result has been written elsewhere."""
    before = set(_made)
    try:
        yield
    finally:
        for folder in [m for m in _made if m not in before]:
            remove(spark, folder)


#: Rows of texts that pass between the JVM and a worker at once, unless the session names a number.
BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut from Spark's default to ``BATCH_ROWS`` rows of text."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == "10000":
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df


_state: dict = {}


def held(key: tuple, make):
    """A worker's state for one operator, made once; that of any other operator is let go.

    Workers outlive stages, so what one stage remembers would otherwise stay
    beside what the next one does.
    """
    if key not in _state:
        _state.clear()
        _powers.clear()
        _trim()  # also what work without state has left, such as a broadcast's value or tables of powers
        _state[key] = make()
        _trim()  # what making it took besides
    return _state[key]


def let_go() -> None:
    """Called by work that holds no state of its own: frees what another operator's left in this worker."""
    if _state:
        _state.clear()
        _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def byte_class(separators: bytes) -> np.ndarray:
    """A table of 256 flags: True where the byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = byte_class(bytes([32, *range(9, 14)]))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool = True):
    """Hashes, rows and byte spans of the words of a slice.

    Returns (hash uint64, row int64, start int64, end int64), in text order.
    """
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return np.empty(0, U64), empty, empty, empty
    folded = LOWER[data] if fold else data
    inside = kind[folded]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = _powers_to(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((folded.astype(U64) + U64(1)) * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    row = np.searchsorted(offsets, start, side="right") - 1
    return h, row, start, end


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of every run of k words within one row."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    out = h[:m].copy()
    for i in range(1, k):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[i : i + m])
    at = np.flatnonzero(row[:m] == row[k - 1 :])
    return out[at], at
