"""SimHash near-duplicates, by tiled exact comparison.

Fingerprints: every shingle (repeats included) of a text is hashed with XXH64; a bit of the fingerprint is set if it is
set in over half the hashes. Links: two fingerprints that differ in at most ``radius`` bits. Distinct fingerprints, not
documents, are compared, so copies cost nothing. They are dealt by runs of bits that agree: of ``radius + 2`` runs a
linked pair differs in at most ``radius``, so it meets where the two others are equal. A group of more than ``group``
fingerprints is dealt again by runs of its remaining bits, until these are too few for so many different numbers; so no
group is ever too large, and a fingerprint is copied a fixed number of times at each depth. In a group, fingerprints are
sorted by population count and cut into tiles; two tiles are compared (numpy exclusive-or and bit counts, every
fingerprint against every other) unless their population counts differ by more than the radius, which no linked pair's
can. A group yields the links of a spanning forest, not all its pairs, so that big ones stay small; no link between
components is lost.

Defined results: a null or empty text, or one without words, has fingerprint zero, which is linked like any other. A
text of fewer words than a shingle is one shingle. Repeated rows get a row each. Documents with a null id get a
fingerprint and the component of their group, but never name a component (null if nobody else is in it). Further
columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendscape.llm.common import cut
from bendscape.llm.components import components

BITS = 64
#: Fingerprints in a tile.
TILE = 512
#: Fingerprints in a group that is compared as it is; larger ones are dealt again.
GROUP = 4096
#: A fingerprint of more than one in this many rows is hot.
HOT = 1024


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> list[int]:
    """XXH64 of each space-joined run of ``size`` words, A-Z lower-cased."""
    found = (text or "").encode().lower().split()
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else []
    joined = b" ".join(found)
    ends = list(itertools.accumulate([len(w) + 1 for w in found]))
    starts = [0, *ends[: 1 - size - 1]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=True)]


#: Each bit of a byte as a byte of its own, in a 64-bit number; 255 of these add up without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes; run i is ``hashes[first[i]:first[i + 1]]``. An empty run gives zero."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(first, first[i] + (1 << 17), side="right")) - 1)
        sizes = np.diff(first[i : j + 1])
        some = np.flatnonzero(sizes)
        if len(some):
            view = np.ascontiguousarray(hashes[first[i] : first[j]]).view(np.uint8).reshape(-1, 8)
            parts = -(-sizes[some] // 255)
            begin = np.cumsum(parts) - parts
            at = np.repeat((first[i:j] - first[i])[some], parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(begin, parts))
            counts = np.empty((len(some), 64), dtype=np.int64)
            for byte in range(8):
                sums = np.add.reduceat(_SPREAD[view[:, byte]], at).view(np.uint8).reshape(-1, 8)
                counts[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(sums, begin, axis=0, dtype=np.int64)
            marked = (2 * counts > sizes[some][:, None]).astype(np.uint8)
            out[i + some] = np.packbits(marked, axis=1, bitorder="little").view(np.uint64)[:, 0]
        i = j
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed 64-bit number."""
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            all_hashes, first = [], [0]
            for t in batch.column(1).to_pylist():
                all_hashes.append(np.array(shingle_hashes(t, size, seed), dtype=np.uint64))
                first.append(first[-1] + len(all_hashes[-1]))
            fp = majority(np.concatenate(all_hashes) if all_hashes else np.zeros(0, np.uint64), np.array(first))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, schema)


def narrowed(free: list[int], radius: int) -> list[list[int]]:
    """The free bits that are left for each choice of two runs of them that must agree."""
    runs = [r.tolist() for r in np.array_split(np.array(free), radius + 2)]
    return [[b for k, r in enumerate(runs) if k not in pair for b in r] for pair in itertools.combinations(range(len(runs)), 2)]


def _mask(free: list[int]) -> int:
    """The bits as a signed 64-bit number."""
    return int(np.array(sum(1 << b for b in free), dtype=np.uint64).view(np.int64))


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places whose fingerprints differ in at most ``radius`` bits."""
    left, right = [], []
    for i in range(0, len(a), 256):
        x, y = np.nonzero(np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius)
        left.append(x + i)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given links connect: each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def tiled(fps: np.ndarray, radius: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints within the radius of each other; tiles too far apart in population count are skipped."""
    ones = np.bitwise_count(fps)
    order = np.argsort(ones, kind="stable")
    fps, ones = fps[order], ones[order].astype(np.int64)
    left, right = [], []
    for i in range(0, len(fps), tile):
        most = ones[min(i + tile, len(fps)) - 1]
        for j in range(i, len(fps), tile):
            if ones[j] - most > radius:
                break
            x, y = near(fps[i : i + tile], fps[j : j + tile], radius)
            differ = x + i != y + j
            if differ.any():
                u, v = forest(fps[i : i + tile][x[differ]], fps[j : j + tile][y[differ]])
                left.append(u)
                right.append(v)
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(distinct: DataFrame, radius: int = 2, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect all within the radius of each other.

    ``group`` is at least 2 ** (radius + 1), so that bits too few for another deal can't name more fingerprints.
    """
    spark, group = distinct.sparkSession, max(group, 2 ** (radius + 1))

    def run(batches):
        for batch in batches:
            found = [tiled(np.asarray(fps.values).view(np.uint64), radius, tile) for fps in batch.column(0)]
            if found:
                columns = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    levels, rest, found = [list(range(BITS))], distinct.select(F.lit(_mask(list(range(BITS)))).alias("mask"), "fp"), None
    while True:
        # How the free bits narrow hangs on radius and depth alone: 1, 6, at most 36, 216 rows for a radius of 2, whatever the input.
        steps = [(free, narrowed(free, radius)) for free in levels]
        deals = spark.createDataFrame([(_mask(free), [_mask(n) for n in new]) for free, new in steps], "mask long, masks array<long>")
        levels = list({tuple(n): n for _, new in steps for n in new}.values())
        dealt = rest.join(F.broadcast(deals), "mask").select(F.explode("masks").alias("mask"), "fp")
        if found is not None:  # two ways may lead to the same free bits
            dealt = dealt.distinct()
        dealt = dealt.withColumn("head", F.col("fp").bitwiseAND(F.bitwise_not("mask")))
        sizes = dealt.groupBy("mask", "head").agg(F.count("*").alias("n")).where("n > 1")
        sized = cut(dealt.join(sizes, ["mask", "head"]))
        groups = sized.where(F.col("n") <= group).groupBy("mask", "head").agg(F.collect_list("fp").alias("fps")).select("fps")
        here = groups.mapInArrow(run, "a long, b long")
        found = here if found is None else found.unionByName(here)
        rest = sized.where(F.col("n") > group).select("mask", "fp")
        if rest.isEmpty():
            return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2, hot: int = HOT) -> DataFrame:
    """(key, fp, component_id): every row with its fingerprint and the smallest key that links reach from it."""
    rows = cut(fingerprints(docs, key, text, size))
    distinct = cut(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    linked = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    joined = linked.join(distinct, "fp").select("component", "fp", "least")
    smallest = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    named = joined.join(smallest, "component").select("fp", "smallest")
    known = distinct.join(named, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"), "n")
    # A fingerprint of more than one in ``hot`` rows is looked up where its rows are; there are fewer than ``hot`` of these.
    total = distinct.agg(F.sum("n")).first()[0] or 0
    known = cut(known)
    often = known.where(F.col("n") * hot > total).select("fp", "component_id")
    met = rows.join(F.broadcast(often), "fp").select(key, "fp", "component_id")
    rest = rows.join(F.broadcast(often.select("fp")), "fp", "left_anti").join(known, "fp").select(key, "fp", "component_id")
    return met.unionByName(rest)
