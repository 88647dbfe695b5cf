"""Near copies by SimHash: documents of whose word shingles, taken together, four fifths or more are in both.

This is the tiled comparison of :mod:`bendscape.llm.simhash` with a radius wide enough for that similarity, and an exact
check. Of each distinct set of shingles (A-Z lower-cased, no repeats) there is a fingerprint of ``WORDS`` words of 64 bits.
Texts at four fifths differ in a seventh of the bits on average: in 9.7 of 64 (deviation 2.9) and in 39 of 256 (5.7).
``NEAR`` and ``RADIUS`` lie 3.6 and 4.4 deviations beyond, so about one link in 5,000 at the very limit is missed, and
fewer above; tests and the README have the recall against brute force. Unlike texts differ in half the bits.

Sets meet by ``BANDS`` keys of ``HASHES`` min-hashes each: sets at four fifths have a key in common but for one pair in
thirty million, unlike texts hardly ever have. Most keys are those of one set and go no further, so what is shuffled grows
with the documents. Small buckets of equal keys are packed together, those of one smallest member side by side, into packs
of bounded size. In a large bucket all sets are first held against its smallest: what that joins is not compared with each
other, but in tiles with the rest only, and the tiles of the rest with each other.

In a pack or pair of tiles, strips whose sizes or population counts are too far apart are skipped, and the rest is compared
by exclusive-or and bit counts. Candidates are held against parity bits, which differ in as many places as the sets in
shingles, less those that fall together (four deviations are allowed). Pairs do not grow with the square of a group: from a
pack only links come that join what is not joined yet, the nearest first. These are settled by the whole sets. Where one of
them fails, its pack is compared once more for what still may join different components, until no link fails; so no link
between components is lost either.

A pack takes as many comparisons for each of its sets as it has sets, ``tile`` / 4 or so: some 300 million in a second of one
core. Only more than ``tile`` sets that share a key and of which most are not linked to the smallest are shuffled once for
each tile that they meet.

Defined results: a text of fewer words than a shingle is one shingle; texts without words are copies of each other; rows
without a key stay; rows of one key with texts that nothing links all stay, if they are the smallest of their components;
rows that repeat key and text are one row. Further columns are carried along. An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendscape.llm.common import LOWER, NOT_SPACE, between, blocks, byte_values, cut, fresh, listed, mix, prefix, spans, texts
from bendscape.llm.components import components, merged
from bendscape.llm.simhash import majority

SIZE = 5
WORDS = 4
#: Bits in which linked sets differ at most, in the first word and in all.
NEAR, RADIUS = 20, 64
#: Parity bits of a set: whether an odd number of its shingles falls to each place.
BITS = 2048
#: Keys of a set, and min-hashes in each: at four fifths (1 - 0.8 ** 3) ** 24 = 3.3e-8 of the pairs have none in common.
BANDS, HASHES = 24, 3
#: Sets in a tile, about; packs and buckets that are packed have a fourth of that.
TILE = 1 << 14
#: Rows of a tile that are compared at once, and candidates that are checked at once.
STRIP, CHUNK = 256, 1 << 15
#: Further links of a pair of tiles that are checked all at once; of more, only those that join.
AT_ONCE = 1 << 16

_PAIR = ["pack", "ta", "tb"]
_PAIR_TYPES = ["long", "int", "int"]
_SKETCH = ["n", *[f"p{k}" for k in range(WORDS)], "parity"]
_FLIP, _SPREAD = np.random.Generator(np.random.PCG64(824)).integers(0, 1 << 64, (2, BANDS, HASHES), dtype=np.uint64)


# ---------------------------------------------------------------- sets and their sketches

def shingle_sets(column: pa.Array, size: int = SIZE):
    """The shingles of each text, as sorted distinct 64-bit hashes."""
    data, offsets = texts(column)
    for i, j in blocks(offsets):
        body = LOWER[data[offsets[i] : offsets[j]]]
        start, end, first = spans(body, offsets[i : j + 1] - offsets[i], NOT_SPACE)
        sums = prefix(between(prefix(byte_values(body)), start, end))
        at = np.arange(max(0, len(start) - size + 1))
        runs = between(sums, at, at + size)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            else:
                yield between(sums, np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 9)).view(np.int64))


def fingerprint_words(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of sets, a row of WORDS words for each."""
    first = np.cumsum([0, *map(len, sets)])
    hashes = np.concatenate([np.zeros(0, np.uint64), *sets])
    return np.stack([majority(mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))), first) for k in range(WORDS)], axis=1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Keys of sets, a row of BANDS for each: hashes of the band and of HASHES smallest shingles by orders of its own."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    some = np.flatnonzero([len(s) > 0 for s in sets])
    first = np.cumsum([0, *[len(sets[k]) for k in some]])
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(first, first[i] + (1 << 15), side="right")) - 1)
        hashes, begin = np.concatenate([sets[k] for k in some[i:j]]), first[i:j] - first[i]
        part = np.empty_like(hashes)
        for band in range(BANDS):
            key = np.full(j - i, band, np.uint64)
            for flip, spread in zip(_FLIP[band], _SPREAD[band] | np.uint64(1), strict=True):
                np.bitwise_xor(hashes, flip, out=part)
                part *= spread
                key = mix(key * np.uint64(3) + np.minimum.reduceat(part, begin))
            out[some[i:j], band] = key
        i = j
    return out


def sketches(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, h, id, n, p0.., parity, bands) of rows (key, h, text): the number of each text's set, its size, bits and keys."""
    schema = T.StructType([rows.schema["key"], rows.schema["h"]]).add("id", T.LongType()).add("n", T.IntegerType())
    for k in range(WORDS):
        schema.add(f"p{k}", T.LongType())
    schema.add("parity", T.BinaryType()).add("bands", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), size))
            words = fingerprint_words(sets).view(np.int64)
            parity = [np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes() for s in sets]
            ids = pa.array([set_id(s) for s in sets], pa.int64())
            n = pa.array([len(s) for s in sets], pa.int32())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sets).view(np.int64).ravel()))
            columns = [batch.column(0), batch.column(1), ids, n, *[pa.array(words[:, k]) for k in range(WORDS)], pa.array(parity, pa.binary()), bands]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("key", "h", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- comparing two tiles

class Side:
    """The sets of a tile, in order of their sizes if ``nodes`` has the places of their ids; else as they come."""

    def __init__(self, table: pa.Table, nodes: np.ndarray | None = None):
        if nodes is not None:
            table = table.sort_by([("n", "ascending"), ("id", "ascending")])
            self.node = np.searchsorted(nodes, table.column("id").to_numpy())
        self.n = table.column("n").to_numpy().astype(np.int64)
        self.words = np.stack([table.column(f"p{k}").to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
        self.first = np.ascontiguousarray(self.words[:, 0])
        self.count = np.bitwise_count(self.first).astype(np.int64)
        self.parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), dtype=np.uint64).reshape(len(self.n), -1)


def candidates(a: Side, b: Side):
    """(places in a, places in b) of all pairs whose sizes and fingerprints are near: a strip of ``a`` at a time, the nearest first."""
    for i in range(0, len(a.n), STRIP):
        j = min(i + STRIP, len(a.n))
        low = int(np.searchsorted(5 * b.n, 4 * a.n[i]))
        high = int(np.searchsorted(4 * b.n, 5 * a.n[j - 1], side="right"))
        if a is b:
            low = max(low, i)
        if low >= high:
            continue
        one, two = a.count[i:j], b.count[low:high]
        if max(one.min() - two.max(), two.min() - one.max()) > NEAR:
            continue
        x, y = np.nonzero(np.bitwise_count(a.first[i:j, None] ^ b.first[None, low:high]) <= NEAR)
        x, y = x + i, y + low
        near = (5 * a.n[x] >= 4 * b.n[y]) & (5 * b.n[y] >= 4 * a.n[x])
        if a is b:
            near &= x < y
        x, y = x[near], y[near]
        if len(x):
            differ = np.concatenate([np.bitwise_count(a.words[x[k : k + CHUNK]] ^ b.words[y[k : k + CHUNK]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), CHUNK)])
            near = np.argsort(differ, kind="stable")[: int((differ <= RADIUS).sum())]
            yield x[near], y[near]


def possible(a: Side, b: Side, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs the parity bits do not rule out, by the number of bits in which sets just alike would differ."""
    parts = [np.zeros(0, bool)]
    for k in range(0, len(x), CHUNK):
        u, v = x[k : k + CHUNK], y[k : k + CHUNK]
        differ = np.bitwise_count(a.parity[u] ^ b.parity[v]).sum(axis=1, dtype=np.int64)
        most = (a.n[u] + b.n[v]) / 9
        odd = (1 - np.exp(-2 * most / BITS)) / 2
        parts.append(differ <= np.minimum(most, BITS * odd + 4 * np.sqrt(BITS * odd * (1 - odd))))
    return np.concatenate(parts)


def spanning(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of links that join all labels which the given links join, and close no ring."""
    chosen = [np.zeros(0, np.int64)]
    while True:
        u, v = label[x], label[y]
        between_labels = np.flatnonzero(u != v)
        if not len(between_labels):
            return np.concatenate(chosen)
        best = np.full(len(label), len(x))
        np.minimum.at(best, u[between_labels], between_labels)
        np.minimum.at(best, v[between_labels], between_labels)
        pick = np.unique(best[best < len(x)])
        chosen.append(pick)
        label = merged(label, x[pick], y[pick])


def joining(a: Side, b: Side, label: np.ndarray, failed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes (places in ``label``) that join all labels which possible, not failed pairs join.

    Where links have failed before, all that are left, if they are not very many.
    """
    if len(failed):
        every = [(np.zeros(0, np.int64),) * 2]
        for x, y in candidates(a, b):
            keep = label[a.node[x]] != label[b.node[y]]
            x, y = x[keep], y[keep]
            keep = possible(a, b, x, y)
            u, v = a.node[x[keep]], b.node[y[keep]]
            new = ~np.isin(np.minimum(u, v) * len(label) + np.maximum(u, v), failed)
            every.append((u[new], v[new]))
            if sum(len(x) for x, _ in every) > AT_ONCE:
                break
        else:
            return tuple(np.concatenate(x) for x in zip(*every, strict=True))
    found_x, found_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in candidates(a, b):
        u, v = a.node[x], b.node[y]
        keep = label[u] != label[v]
        if len(failed):
            keep &= ~np.isin(np.minimum(u, v) * len(label) + np.maximum(u, v), failed)
        x, y, u, v = x[keep], y[keep], u[keep], v[keep]
        while len(x):
            pick = spanning(u, v, label)
            good = possible(a, b, x[pick], y[pick])
            found_x.append(u[pick][good])
            found_y.append(v[pick][good])
            label = merged(label, u[pick][good], v[pick][good])
            rest = np.ones(len(x), bool)
            rest[pick] = False
            rest &= label[u] != label[v]
            if 2 * good.sum() < len(pick):  # many are ruled out: see about all others at once
                at = np.flatnonzero(rest)
                rest[at] = possible(a, b, x[at], y[at])
            x, y, u, v = x[rest], y[rest], u[rest], v[rest]
    return np.concatenate(found_x), np.concatenate(found_y)


def _compared(table: pa.Table, failed: pa.Table) -> pa.Table:
    """New links of a pair of tiles."""
    side = table.column("side").to_numpy()
    alone = bool(len(table)) and table.column("ta")[0].as_py() == table.column("tb")[0].as_py()
    if not (side == 0).any() or not (alone or (side == 1).any()):
        return pa.table({c: pa.array([], t) for c, t in [("pack", pa.int64()), ("ta", pa.int32()), ("tb", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]})
    ids = table.column("id").to_numpy()
    nodes, at = np.unique(ids, return_index=True)
    _, label = np.unique(table.column("label").to_numpy()[at], return_inverse=True)
    a = Side(table.filter(pa.array(side == 0)), nodes)
    b = a if alone else Side(table.filter(pa.array(side == 1)), nodes)
    u, v = (np.searchsorted(nodes, failed.column(c).to_numpy()) for c in ("a", "b"))
    x, y = joining(a, b, label, np.minimum(u, v) * len(nodes) + np.maximum(u, v))
    key = {c: pa.array([table.column(c)[0].as_py()] * len(x), table.schema.field(c).type) for c in _PAIR}
    return pa.table({**key, "a": nodes[x], "b": nodes[y]})


# ---------------------------------------------------------------- all packs and tiles

def buckets(sets: DataFrame) -> DataFrame:
    """(bucket, id, m, least): the sets that share a key, how many these are, and the smallest."""
    members = sets.where("n > 0").select(F.explode("bands").alias("bucket"), "id")
    shared = listed(members.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("least")).where("m > 1"))
    return cut(members.join(shared, "bucket").select("bucket", "id", "m", "least"))


def packed(shared: DataFrame, most: int) -> DataFrame:
    """(pack, id, ta, tb, side) of buckets of up to ``most`` sets, in packs of about as many."""
    small = shared.where(F.col("m") <= most)
    packs = max(1, -(-small.count() // most))
    rows = small.select(F.pmod(F.xxhash64("least"), F.lit(packs)).cast("long").alias("pack"), "id").distinct()
    return rows.select("pack", "id", *[F.lit(0).alias(c) for c in ("ta", "tb", "side")])


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets that fingerprints and parity bits do not rule out."""
    ends = {}
    for c in ("a", "b"):
        few = listed(pairs.select(F.col(c).alias("id")).distinct())
        ends[c] = sets.join(few, "id", "left_semi").select(F.col("id").alias(c), F.struct("id", *_SKETCH).alias(f"s{c}"))

    def run(batches):
        for batch in batches:
            a, b = (Side(pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column(k))])) for k in (2, 3))
            keep = (5 * a.n >= 4 * b.n) & (5 * b.n >= 4 * a.n)
            keep &= np.bitwise_count(a.words ^ b.words).sum(axis=1, dtype=np.int64) <= RADIUS
            at = np.flatnonzero(keep)
            keep[at] = possible(a, b, at, at)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.join(ends["b"], "b").join(ends["a"], "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def starred(large: DataFrame, sets: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(a, b): links of sets of large buckets to the smallest set of a bucket in which they are."""
    pairs = large.groupBy(F.col("id").alias("b")).agg(F.min("least").alias("a")).where("a <> b").select("a", "b")
    return alike(cut(likely(cut(pairs), sets)), sets, rows, size)


def tiled(large: DataFrame, named: DataFrame, tile: int) -> DataFrame:
    """(pack, id, ta, tb, side) of large buckets: what is joined to the smallest set meets the rest, and the rest itself."""
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    met = large.join(of("id"), "id", "left").join(of("least"), "least", "left")
    met = met.select("bucket", "id", (F.coalesce("id_in", "id") == F.coalesce("least_in", "least")).alias("inside"))
    tiles = lambda inside: F.ceil(F.count_if(F.col("inside") == inside) / tile).cast("int")
    counts = listed(met.groupBy("bucket").agg(tiles(False).alias("rest"), tiles(True).alias("joined")).where("rest > 0"))
    pair = lambda ta, tb, side: F.struct(ta.alias("ta"), tb.alias("tb"), side.cast("int").alias("side"))
    rest, joined, own = F.col("rest"), F.col("joined"), F.col("own")
    numbers = lambda first, n: F.transform(F.array_repeat(F.lit(0), n), lambda _, i: first + i)
    within = F.transform(numbers(F.lit(0), rest), lambda u: pair(F.least(own, u), F.greatest(own, u), own > u))
    beside = F.transform(numbers(rest, joined), lambda u: pair(own, u, F.lit(0)))
    against = F.transform(numbers(F.lit(0), rest), lambda u: pair(u, own, F.lit(1)))
    own_tile = F.when(F.col("inside"), rest + F.pmod(F.xxhash64("id"), joined)).otherwise(F.pmod(F.xxhash64("id"), rest)).cast("int")
    dealt = met.join(counts, "bucket").withColumn("own", own_tile)
    dealt = dealt.select(F.col("bucket").alias("pack"), "id", F.explode(F.when(F.col("inside"), against).otherwise(F.concat(within, beside))).alias("_m"))
    return dealt.select("pack", "id", "_m.*")


def alike(pairs: DataFrame, sets: DataFrame, rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Those of the pairs (a, b, ...) of sets that share four fifths of their union; ``rows`` has (key, h, text)."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = listed(sets.join(ends, "id", "left_semi").select("key", "h"))

    def shingled(batches):
        for batch in batches:
            found = list(shingle_sets(batch.column(0), size))
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), lists], names=["id", "s"])

    whole = cut(rows.join(wanted, ["key", "h"], "left_semi").select("text").mapInArrow(shingled, "id long, s array<long>").dropDuplicates(["id"]))
    met = pairs.join(whole.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(whole.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(9 * both >= 4 * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return cut(met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def meetings(sets: DataFrame, rows: DataFrame, size: int = SIZE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(pack, id, ta, tb, side): where sets meet; and the links (a, b) that are known by then."""
    shared, most = buckets(sets), max(2, tile // 4)
    met, large = packed(shared, most), shared.where(F.col("m") > most)
    if large.isEmpty():
        return cut(met), sets.sparkSession.createDataFrame([], "a long, b long")
    found = starred(large, sets, rows, size)
    return cut(met.unionByName(tiled(large, components(found), tile))), found


def links(sets: DataFrame, rows: DataFrame, size: int = SIZE, tile: int = TILE) -> DataFrame:
    """(a, b): links between sets that connect all that share four fifths of their union, but for the misses of keys and bits."""
    link = ", ".join(f"{c} {t}" for c, t in zip(_PAIR, _PAIR_TYPES, strict=True)) + ", a long, b long"
    all_failed = sets.sparkSession.createDataFrame([], link)
    met, all_found = meetings(sets, rows, size, tile)
    again = met
    sketch = sets.join(listed(met.select("id").distinct()), "id", "left_semi").select("id", *_SKETCH)
    while True:
        named = components(all_found).withColumnRenamed("node", "id")
        sketched = again.join(sketch, "id").join(named, "id", "left")
        todo = sketched.withColumn("label", F.coalesce("component", "id")).drop("component")
        groups = todo.groupBy(*_PAIR).cogroup(all_failed.groupBy(*_PAIR))
        new = cut(groups.applyInArrow(_compared, link))
        found = alike(new.select("a", "b").distinct(), sets, rows, size)
        all_found = all_found.union(found)
        failed = cut(new.join(found, ["a", "b"], "left_anti").select(*new.columns))
        if failed.isEmpty():
            return all_found
        # Packs with a link that failed are compared again, knowing which links hold.
        all_failed = all_failed.union(failed)
        again = met.join(failed.select(*_PAIR).distinct(), _PAIR, "left_semi")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, tile: int = TILE) -> DataFrame:
    """``docs`` with one document, that with the smallest key, of each component of linked sets."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    known = cut(sketches(rows, size))
    bits = [*_SKETCH, "bands"]
    least = known.groupBy("id").agg(F.min(F.struct("key", "h")).alias("least"), *[F.any_value(c).alias(c) for c in bits])
    sets = cut(least.select("id", "least.*", *bits))
    named = components(links(sets, rows, size, tile)).withColumnRenamed("node", "id")
    placed = sets.select("id", "key", "h").join(named, "id", "left").select("key", "h", F.coalesce("component", "id").alias("c"))
    stay = placed.groupBy("c").agg(F.min(F.struct("key", "h")).alias("s")).select("s.*")
    times = known.groupBy("key", "h").agg(F.count("*").alias("times"))
    judged = times.join(stay.withColumn("stays", F.lit(True)), ["key", "h"], "left")
    gone = listed(judged.where("stays is null or times > 1").select("key", "h", F.coalesce("stays", F.lit(False)).alias("stays")))
    k, h = fresh(docs.columns, "key", "h")
    tagged = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = (F.col(key) == F.col(k)) & (F.col(h) == F.col(f"{h}2"))
    out = gone.select(F.col("key").alias(k), F.col("h").alias(f"{h}2"), "stays")
    single = tagged.join(out.drop("stays"), same, "left_anti").select(*docs.columns)
    # Of rows that repeat key and text one stays, chosen by all its columns.
    repeated = tagged.join(out.where("stays").drop("stays"), same, "left_semi")
    first = repeated.groupBy(key, h).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(k)).select(f"{k}.*")
    return single.unionByName(first)
