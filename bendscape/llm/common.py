"""What the operators of this subpackage share: table access, checkpoints and byte-level text helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bendscape.sources.shared import cut, shared_folder  # noqa: F401

#: Java and RE2 pattern of what separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Java and RE2 pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch handed to Python; texts may be long, so batches are short.
BATCH_ROWS = 1000
#: And bytes in it, about.
BATCH_BYTES = "32m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; also keeps Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to all tasks as a list, of some 16 bytes each.
LISTED = 1 << 20


def listed(df: DataFrame, rows: int = LISTED) -> DataFrame:
    """``df``, cut off from its lineage, and with a hint to broadcast it if it has no more than ``rows`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def fresh(taken, *names: str) -> list[str]:
    """Names, one for each of ``names``, that no column of ``taken`` has."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used |= {name.lower(), f"{name}2".lower()}
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, however often the body (and its lambdas) use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


# ---------------------------------------------------------------- numpy on the bytes of a batch of texts

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that stand in a word; UTF-8 bytes of characters beyond ASCII are all 0x80 and over.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, ``n`` at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`between` takes the hash of any range."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges start..end; equal content gives equal hashes wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _VALUES[data]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more at the end). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return body, at - at[0]


def blocks(offsets: np.ndarray, size: int = 1 << 21):
    """Ranges of texts (first, last + 1) of about ``size`` bytes together; a longer text stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that ``inside`` marks, never across texts: start, end, and the first run of each text."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = inside[data]
    starts, ends = (flags[1:-1] & ~flags[:-2]).astype(bool), (flags[1:-1] & ~flags[2:]).astype(bool)
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    both = edge[(flags[edge] & flags[edge + 1]).astype(bool)]
    starts[both] = True
    ends[both - 1] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its smallest, the leftmost of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, reach = values, np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        keep = left <= right
        best, at = np.where(keep, left, right), np.where(keep, at[:-step], at[step:])
        reach += step
    return at[:n]
