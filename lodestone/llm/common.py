"""Shared pieces: memory of workers, row keys, vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.staging import shared_dir, stage

__all__ = ["shared_dir", "stage"]

#: Bytes of text handled at once by the vectorised code; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Returns what this process has freed to the system: workers live on from stage to stage."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def freed(run):
    """run, a function of batches for mapInArrow, giving memory back when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(id_col: str, text_col: str) -> Column:
    """A long by which samples are chosen: evenly spread, the same for equal rows."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def text_key(text: Column) -> Column:
    """16 bytes of the text's SHA-256 (null as empty): with the id the key of a row's own results."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def as_row(columns: list[str]) -> Column:
    """The caller's columns in one struct, so that no name of an operator's own can clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of the struct in the batch's first column."""
    return pc.struct_field(batch.column(0), [name])


def smallest(rows: DataFrame, at: str, want: int) -> list:
    """The want rows with the smallest hashes in column at (a long, about evenly spread), in that order.

    Only rows below a hash that about four times as many should lie below are sorted, however many there are; if too
    few lie there after all, all are.
    """
    share = 4 * want / max(1, rows.count())
    if share < 1:
        got = rows.where(F.col(at) < int(-(2**63) + 2**64 * share)).orderBy(at).limit(want).collect()
        if len(got) == want:
            return got
    return rows.orderBy(at).limit(want).collect()


# ---------------------------------------------------------------------------------------------------------------
# Words as arrays

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Marks every ASCII byte but letters and digits: words are then what punctuation leaves.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        table_ = np.multiply.accumulate(out)
        if n > 2 * CHUNK_BYTES:
            return table_
        _powers[key] = table_
    return _powers[key]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals U+00C0-U+00DE as small letters."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    low = (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low[1:] &= data[:-1] == 0xC3
    low[:1] = False
    out[low] += 32
    return out


class Words:
    """The words of some texts: runs of bytes that gap doesn't mark, by default other than space and 0x09-0x0D.

    starts, ends: byte places in data; doc: index of the text; h: 64-bit hash of the word's bytes;
    first: index of each text's first word (one longer than the texts).
    """

    __slots__ = ("data", "doc", "ends", "first", "h", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _IS_SPACE):
        n = len(data)
        self.data = data
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        word = ~gap[data]
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _power(_R, n, "r")[:n], out=total[1:])
        self.h = mix((total[self.ends] - total[self.starts]) * _power(_R_INV, n + 1, "i")[self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def second(self) -> np.ndarray:
        """Another hash of each word's bytes that has nothing in common with h: the sum of scrambled (byte, place)."""
        length = self.ends - self.starts
        first = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(first, length)
        byte = self.data[np.repeat(self.starts, length) + place]
        total = np.r_[np.uint64(0), np.cumsum(mix(byte.astype(np.uint64) * _ODD + (place.astype(np.uint64) << np.uint64(8))))]
        return mix(total[first + length] - total[first])


def grams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes (shorter by n - 1 than h)."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    step = np.uint64(seed * 2 + 1)
    h = mix(h + np.uint64(seed))
    for i in range(n):
        out = out * step + h[i : i + m]
    return mix(out)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of rows with about CHUNK_BYTES of text; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK_BYTES, "right")) - 1)
        b = min(b, len(texts))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
