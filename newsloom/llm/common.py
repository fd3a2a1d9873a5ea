"""Shared helpers: table reading, written intermediate tables, Arrow slices and vectorised word kernels."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path

#: Bytes of text that the numpy kernels hold at once; one longer text is taken alone.
SLICE_BYTES = 1_000_000
#: Rows of an Arrow batch between the JVM and Python, so that batches of long texts stay small beside the heap.
BATCH_ROWS = 1_000
#: Bounds what the driver broadcasts; larger tables take the other way of each operator.
BROADCAST_BYTES = 32_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learn_row(doc_id: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the decimal id is not 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def smallest_hashes(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with about the `most` smallest hashes of the column, never more: where there are many, a bound on the hash cuts them before they are sorted."""
    n, h = rows.agg(F.approx_count_distinct(column)).first()[0], F.xxhash64(column)
    if n > 2 * most:
        rows = rows.where(h <= int(-(2**63) + 2**64 * min(1.0, (1.2 * most + 6 * most**0.5) / n)))
    return rows.orderBy(h, column).limit(most)


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(name)
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Gives memory that a finished task has freed back to the system, as idle Python workers live on beside the heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds at most that many bytes of text, or one row."""
    for batch in batches:
        col = batch.column(name)
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
            end = max(at + 1, end)
            yield batch.slice(at, end - at)
            at = end
    release()


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by keys: tables of whole groups, with the row offsets of the groups."""
    left: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(len(t) - 1, 0), bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(t)]]).astype(np.int64)

    for batch in batches:
        if not len(batch):
            continue
        left.append(batch)
        t = pa.Table.from_batches(left)
        b = bounds(t)
        if len(b) > 2:
            yield t.slice(0, int(b[-2])).combine_chunks(), b[:-1]
            left = t.slice(int(b[-2])).to_batches()
    if left:
        t = pa.Table.from_batches(left).combine_chunks()
        yield t, bounds(t)
    release()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit integers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space ends.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Bytes of words of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LOWER_CODES = _CODES[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of them."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            p = np.full(n + n // 4, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def find_words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of words before it."""
    n = len(data)
    inside = member[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | cut[1:n]
        end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e); never 0."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_CODES if lower else _CODES)[data] * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)) | np.uint64(1)


def word_hashes(col: pa.Array, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the offsets of the rows among them."""
    data, off = buffers(col)
    s, e, rows = find_words(data, off, member)
    return span_hashes(data, s, e), rows


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])
