"""Fingerprints of documents from their improbable features, and how well these survive an edit.

A feature is a window of 16 bytes. Its entropy is one of some 200 levels, and a level is the rarer the fewer windows of
all documents have it. Among each 16 neighbouring features the rarest, leftmost one gets a vote; features with four votes
or more are selected (a text without such a one gives its rarest feature, a text shorter than a feature gives itself).
Each different selected feature sets five bits of a Bloom filter of 2,048 bits; after 160 features a further filter is
chained to it. Two chains are compared filter by filter: bits in common, less what filters so full share by chance, over
the most that they could share; the likeness is the average of each filter's best match, from the smaller chain.

A null text is an empty one; it has no filter, is fully like another empty text and not like any other. Texts of any
length are read in slices that overlap. Rows without a key come first in the order of documents, and rows that repeat a
key are ordered by a hash of their texts, so equal rows follow each other. The only document is its own next one. An empty
table gives no rows. Further columns are not read. Keys are integers; others raise a TypeError.
"""

from __future__ import annotations

import base64
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendscape.llm.common import between, byte_values, prefix

WIDTH = 16
NEAR = 16
VOTES = 4
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Share of the range between chance and full agreement, and standard deviations of chance, that count as nothing.
FLOOR, SIGMA = 0.3, 3.0
#: Features that are looked at together; longer texts are sliced.
SLICE = 1 << 20

#: c * log2(c) in sixteenths, for c equal bytes in a window. Sums over a window are its level: the higher, the less entropy.
_SHARE = np.round(16 * np.arange(WIDTH + 1) * np.log2(np.maximum(np.arange(WIDTH + 1), 1))).astype(np.int32)
_GAIN = np.diff(_SHARE, prepend=0).astype(np.int32)
LEVELS = int(_SHARE[-1]) + 1
#: From this level on (under one bit a byte) windows are mostly one byte over and over: they come after all others.
DULL = LEVELS * 3 // 4


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of each window of ``data``, from counts of equal bytes ahead and behind."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, dtype=np.int32)
    ahead, behind = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)
    for d in range(1, WIDTH):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    out = np.empty(n - WIDTH + 1, dtype=np.int32)
    out[0] = _SHARE[np.bincount(data[:WIDTH])].sum()
    # One byte further on, the first byte's share goes and the new byte's comes.
    np.subtract(_GAIN[behind[WIDTH:]], _GAIN[ahead[: n - WIDTH]], out=out[1:])
    return np.cumsum(out, dtype=np.int32)


def ranks(counts: dict[int, int]) -> np.ndarray:
    """The place of each level among all, rarest first, from how many windows have it."""
    order = sorted(range(LEVELS), key=lambda v: (v >= DULL, counts.get(v, 0), v))
    out = np.empty(LEVELS, dtype=np.int32)
    out[order] = np.arange(LEVELS, dtype=np.int32)
    return out


@dataclass(frozen=True)
class Print:
    """``filters``: a row of 64-bit words for each filter; ``features``: how many were set in all of them."""

    features: int
    filters: np.ndarray

    def __str__(self) -> str:
        return f"{self.features}:{base64.b64encode(self.filters.tobytes()).decode()}"


def parse(text: str) -> Print:
    """The fingerprint that a string stands for."""
    features, _, body = text.partition(":")
    return Print(int(features), np.frombuffer(base64.b64decode(body), dtype="<u8").reshape(-1, FILTER_BITS // 64))


def _rarest(rank: np.ndarray) -> np.ndarray:
    """For each NEAR neighbours the place of the smallest rank, the leftmost of equal ones."""
    low = (rank.astype(np.int64) << 32) | np.arange(len(rank))
    reach = 1
    while reach < NEAR:
        step = min(reach, NEAR - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return low & 0xFFFFFFFF


def selected(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Hashes of the different selected features of a text, as they first come."""
    n = len(data) - WIDTH + 1
    if n < 1:
        return between(prefix(byte_values(data)), np.array([0]), np.array([len(data)])) if len(data) else np.zeros(0, np.uint64)
    found, best = [], (LEVELS, 0)
    for start in range(0, n, SLICE):
        # Votes depend on the features up to NEAR - 1 away.
        lo, hi = max(0, start - NEAR + 1), min(n, start + SLICE + NEAR - 1)
        part = data[lo : hi + WIDTH - 1]
        rank = order[levels(part)]
        votes = np.bincount(_rarest(rank), minlength=len(rank))
        votes[: start - lo] = 0
        votes[start - lo + SLICE :] = 0
        at = np.flatnonzero(votes >= VOTES)
        if not len(at) and not found:
            rarest = int(np.argmin(rank))
            if rank[rarest] < best[0]:
                best = int(rank[rarest]), lo + rarest
        if len(at):
            found.append(between(prefix(byte_values(part)), at, at + WIDTH))
    if not found:
        part = data[best[1] : best[1] + WIDTH]
        found.append(between(prefix(byte_values(part)), np.array([0]), np.array([WIDTH])))
    hashes = np.concatenate(found)
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def fingerprint(text: bytes, order: np.ndarray) -> Print:
    """The chained filters of a text."""
    hashes = selected(np.frombuffer(text, dtype=np.uint8), order)
    chain, step = [], 256 * FILTER_FEATURES
    for lo in range(0, len(hashes), step):
        part = hashes[lo : lo + step]
        bits = np.zeros((-(-len(part) // FILTER_FEATURES), FILTER_BITS), dtype=bool)
        row = np.arange(len(part)) // FILTER_FEATURES
        for k in range(HASHES):
            bits[row, (part >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
        chain.append(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
    return Print(len(hashes), np.concatenate(chain) if chain else np.zeros((0, FILTER_BITS // 64), dtype="<u8"))


def _scores(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each filter of ``f`` its best match in ``g``, from 0 to 1."""
    there = {row.tobytes() for row in g}
    best = np.array([float(row.tobytes() in there) for row in f])
    todo = np.flatnonzero(best == 0)
    full = np.bitwise_count(g).sum(axis=1, dtype=np.int64).astype(float)
    step = max(1, (1 << 15) // max(1, len(g)))
    for lo in range(0, len(todo), step):
        rows = todo[lo : lo + step]
        own = np.bitwise_count(f[rows]).sum(axis=1, dtype=np.int64).astype(float)[:, None]
        common = np.bitwise_count(f[rows][:, None] & g[None]).sum(axis=2, dtype=np.int64)
        chance = own * full / FILTER_BITS
        spread = np.sqrt(chance * (1 - full / FILTER_BITS) * (FILTER_BITS - own) / (FILTER_BITS - 1))
        most = np.minimum(own, full)
        least = chance + np.maximum(FLOOR * (most - chance), SIGMA * spread)
        score = np.where(most > least, (common - least) / np.where(most > least, most - least, 1.0), 0.0)
        best[rows] = np.clip(score, 0, 1).max(axis=1)
    return best


def likeness(a: Print, b: Print) -> float:
    """From 0 to 1, the same either way round: how much of the smaller chain is in the other."""
    if not a.features or not b.features:
        return float(a.features == b.features)

    def seen(x: Print, y: Print) -> float:
        weights = np.full(len(x.filters), float(FILTER_FEATURES))
        weights[-1] = x.features - FILTER_FEATURES * (len(weights) - 1)
        return float((_scores(x.filters, y.filters) * weights).sum() / weights.sum())

    if a.features != b.features:
        return seen(*sorted((a, b), key=lambda p: p.features))
    return 1.0 if np.array_equal(a.filters, b.filters) else (seen(a, b) + seen(b, a)) / 2


# ---------------------------------------------------------------- over a table of documents

def rarity(docs: DataFrame, text: str = "text") -> DataFrame:
    """(level, n): how many windows of all texts have each entropy level, some 200 rows."""

    def run(batches):
        for batch in batches:
            total = np.zeros(LEVELS, dtype=np.int64)
            for value in batch.column(0):
                data = np.frombuffer(value.as_buffer() or b"", dtype=np.uint8)
                for start in range(0, len(data), SLICE):
                    total += np.bincount(levels(data[start : start + SLICE + WIDTH - 1]), minlength=LEVELS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["level", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("t")).where("t is not null").mapInArrow(run, "level int, n long")
    return rows.groupBy("level").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The order of levels, rarest first, over all documents; one number a level goes to the driver."""
    return ranks({r.level: r.n for r in rarity(docs, text).collect()})


def fingerprints(docs: DataFrame, order: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each document."""

    def run(batches):
        for batch in batches:
            prints = [str(fingerprint(v.as_buffer() or b"", order)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, T.StructType([rows.schema["key"]]).add("fingerprint", "string")).withColumnRenamed("key", key)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key`` (0 for null): first by every so-manieth of them, then among those after it."""
    if not bounds:
        return F.lit(0)
    wide = max(1, math.isqrt(len(bounds)))
    reached = lambda a: F.coalesce(F.size(F.filter(a, lambda b: b <= key)), F.lit(0))
    coarse = F.when(key.isNull(), F.lit(0)).otherwise(reached(F.array(*[F.lit(b) for b in bounds[wide - 1 :: wide]]))) * wide
    return F.when(key.isNull(), F.lit(0)).otherwise(coarse + reached(F.slice(F.array(*[F.lit(b) for b in bounds]), coarse + 1, F.lit(wide))))


def in_order(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """(bucket, guest, key, h, text): documents dealt by ranges of keys, and at each range's end, as a guest, the first
    document of the next range (after the last: of the first). Texts are shuffled once."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else None
    cuts = rows.agg(F.percentile_approx("key", shares, 10_000)).first()[0] if parts > 1 else None
    rows = rows.withColumn("bucket", _bucket(F.col("key"), sorted(set(cuts or []))))
    # One row for each range: its first document, and the range before, to which it goes as a guest.
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("f")).orderBy("bucket").collect()
    guests = [(r.f.key, r.f.h, firsts[i - 1].bucket) for i, r in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(guests, "key2 long, h2 long, host int")
    met = rows.join(F.broadcast(heads), F.col("key").eqNullSafe(F.col("key2")) & (F.col("h") == F.col("h2")), "left")
    own, guest = F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))
    dealt = met.select(F.explode(places).alias("_p"), "key", "h", "text").select("_p.bucket", "_p.guest", "key", "h", "text")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.col("key").asc_nulls_first(), "h")


def robustness(docs: DataFrame, order: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text has its last quarter of code points replaced by as many from the next document's start, or by all it
    has. ``near_edited`` and ``near_next`` are the likeness of the document's fingerprint to the edited text's and to the
    next document's.
    """
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be an integer column")
    order = learned(docs, text) if order is None else order
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("key", T.LongType())]).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def run(batches):
        out, held = [], 0
        last = None  # bucket, guest, key, text, fingerprint

        def done():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema=arrow)

        for batch in batches:
            bucket, guest, keys, texts = (batch.column(k) for k in (0, 1, 2, 4))
            for i in range(len(batch)):
                b, g = bucket[i].as_py(), guest[i].as_py()
                if g and last and last[1] and last[0] == b:
                    continue  # a guest that repeats
                t = texts[i].as_py()
                own = fingerprint(t.encode(), order)
                if last and not last[1] and last[0] == b:
                    _, _, k, before, print_before = last
                    quarter = len(before) // 4
                    edited = (before[: len(before) - quarter] + t[:quarter]).encode()
                    other = fingerprint(edited, order)
                    row = (k, len(before), hashlib.sha256(edited).hexdigest(), str(print_before), str(other), likeness(print_before, other), likeness(print_before, own))
                    out.append(row)
                    held += len(row[3]) + len(row[4])
                    if held > 1 << 22:
                        yield done()
                        out, held = [], 0
                last = (b, g, keys[i].as_py(), t, own)
        if out:
            yield done()

    arrow = pa.schema([("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return in_order(docs, key, text, parts).mapInArrow(run, schema).withColumnRenamed("key", key)
