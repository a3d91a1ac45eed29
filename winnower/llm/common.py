"""Pieces shared by the corpus operators: shared-folder tables, column hygiene and word kernels.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D, the class that every contract in
this subpackage uses.  All six are single bytes in UTF-8 and never part of a longer sequence, so the kernels
work on the UTF-8 bytes of an Arrow batch directly.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word, for Spark (Java) and DuckDB (RE2).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at a time inside a Python worker; temporaries take about 40 times this.
CHUNK_BYTES = 1 << 20


#: Folders of the tables that this process has stored and not deleted yet.
_STORED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` or the context's checkpoint folder names.

    Without one, a local session (one machine) sets a temporary folder; on a cluster it is an error, as executors would
    write where nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="winnower-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def spool(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the table.

    Cuts the lineage: a lost executor costs at most the tasks it ran, and nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnower-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unspool(*tables: DataFrame) -> None:
    """Delete spooled tables that no later plan reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getName().startswith("winnower-"):
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _STORED[:] = [p for p in _STORED if p.rsplit("/", 1)[1] != where.getName()]


def stored() -> list[str]:
    """The tables not deleted so far."""
    return list(_STORED)


def tidy(spark: SparkSession, paths: list[str]) -> None:
    """Delete the given tables; for a caller who knows that everything made of them has been written."""
    for path in paths:
        _delete(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished plans now; it finds them when the driver's garbage is collected."""
    spark._jvm.System.gc()


def release_memory() -> None:
    """Give memory that Python and Arrow hold for later use back to the system; for after work that needed much more than what follows."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def parts_for(rows: int, per_task: int) -> int:
    """Number of tasks so that none is dealt more than about ``per_task`` rows."""
    return max(1, -(-rows // per_task))


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of documents that no model may learn from; false for a null id, which no model learns from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def held_out_id(doc_id: int) -> bool:
    """The same in Python."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# ---- word kernels -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the public splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
_factors = np.zeros(0, np.uint64)


def place_factors(n: int) -> np.ndarray:
    """An odd factor for each of ``n`` places, without the structure of powers: patterns like Thue and Morse's don't cancel out."""
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1, max(n, 2 * len(_factors), 256) + 1, dtype=np.uint64) * _PRIME) | _U(1)
    return _factors[:n]


_BYTE[_SPACE] = 0


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) for runs of rows with about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, for each row and the end the index of its first word); ``blank``: bytes between words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = blank[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = space[:-1]
    cut[offsets] = True
    starts = np.flatnonzero(~space & cut[:-1])
    cut[1:n] = space[1:]
    cut[n] = True
    cut[offsets[offsets > 0]] = True
    ends = np.flatnonzero(~space & cut[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: As _BYTE, but white space counts too: for runs that are compared as they stand.
_EVERY = mix(np.arange(1001, 1257, dtype=np.uint64) * _PRIME)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, with A-Z lowered if asked.  Between words there must be nothing but white space."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first, last = int(starts[0]), int(ends[-1])
    body = data[first:last]
    spans = np.diff(np.append(starts, last))
    at = np.arange(last - first, dtype=np.int64) - np.repeat(starts - first, spans)
    value = _BYTE[_LOWER[body] if lower else body]
    value *= place_factors(int(spans.max()))[at]
    h = np.add.reduceat(value, starts - first)
    return mix(h + (ends - starts).astype(np.uint64))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run, white space included; runs lie in order and don't overlap, empty ones hash to one value."""
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        a, b = starts[full], ends[full]
        spans = b - a
        at = np.arange(int(spans.sum()), dtype=np.int64) - np.repeat(np.cumsum(spans) - spans, spans)
        value = _EVERY[data[np.repeat(a, spans) + at]]
        value *= place_factors(int(spans.max()))[at]
        out[full] = np.add.reduceat(value, np.cumsum(spans) - spans)
    return mix(out + (ends - starts).astype(np.uint64))


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = _U(1)
    for k in range(size):
        total += hashes[k : k + n] * factor
        with np.errstate(over="ignore"):
            factor = factor * _PRIME
    return mix(total + _U(size))


class Block:
    """Texts of some rows as bytes, with what has been worked out about them so far."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1

    def take(self, rows: np.ndarray) -> Block:
        """The given rows alone."""
        counts = (self.offsets[1:] - self.offsets[:-1])[rows]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offsets[:-1][rows] - (ends - counts), counts)
        return Block(self.data[at], np.concatenate([[0], ends]).astype(np.int64))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words_of(self.data, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def word_row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.n_words)

    @cached_property
    def hashes(self) -> np.ndarray:
        """Of each word as it stands."""
        return word_hashes(self.data, self.words[0], self.words[1], lower=False)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes in each row."""
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.offsets])
