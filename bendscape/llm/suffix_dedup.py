"""Removal of long repeated byte strings, by sampled anchors and deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a smaller document, or earlier in
the same one). Sorting every suffix of the corpus would move many times its size, so:

1. Each window of ``length`` bytes picks its smallest ``gram``-byte hash, the leftmost of equal ones, as its anchor.
   Equal windows pick equal anchors, so only suffixes with a common anchor can be equal. Neighbouring windows mostly
   pick the same anchor; such a run of windows, with all bytes that they cover (its extent), is one row.
2. Runs with equal extents are counted together: the first stays, all windows of the others start earlier too. This
   settles the inside of every copied passage without looking at single suffixes.
3. What is left are first runs whose anchor also occurs in other extents: the borders of copied passages. Their
   bytes are fetched, and the suffixes that start at the anchors, and the reversed prefixes that end there, are sorted
   within each anchor: multikey quicksort to ``shallow`` bytes, eight at a time, then a blind trie for each group that
   still ties. Two windows with the anchor at place d are equal if their prefixes agree in d bytes and their suffixes
   in ``length`` - d, which the sorted order and its common prefixes tell for all rows and each d at once. A hot
   anchor's rows are dealt over several tasks, each of which settles its own equal windows and reports the first of
   them with a 128-bit digest; a ranking by digest then finds the first of all.

Matches never cross documents. Runs are compared by 64-bit hashes (steps 1 and 2), borders by their bytes.

Defined results: a null text is empty; an empty table gives no rows; a text of fewer bytes than ``length`` keeps all.
Keys are integers, others raise a TypeError; a null key comes before all others. Rows that repeat a key are told apart by a hash of their text,
which also orders them; wholly equal rows count as one row and give one row. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from bendscape.llm.common import between, blocks, byte_values, mix, prefix, sliding_argmin, texts

LENGTH = 100
GRAM = 24
SHALLOW = 32
#: Extents of one anchor that are sorted together, on average; a hotter anchor is dealt out.
GROUP = 1024
#: Rows that a task sorts at once, whole groups of them.
CHUNK = 1 << 14
#: Parts that quicksort no longer parts.
SMALL = 24
#: The extent of runs that a task has found to be later ones.
LATER = 0
#: Stands for a null key.
NO_KEY = -(1 << 63)


# ---------------------------------------------------------------- step 1

def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchored runs of windows: text number, anchor place, first and last window (places in their text), hashes."""
    sums = prefix(byte_values(data))
    n = len(data) - gram + 1
    if n <= 0 or len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(n)
    grams = between(sums, at, at + gram)
    anchor = sliding_argmin(grams, length - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.maximum(0, np.diff(offsets)))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= offsets[text + 1]
    window = np.flatnonzero(inside)
    a, t = anchor[window].astype(np.int64), text[window]
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    s, e, p, t = window[first], window[last], a[first], t[first]
    extent = between(sums, s, e + length)
    extent = extent ^ ((p - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ ((e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    begin = offsets[t]
    return t, p - begin, s - begin, e - begin, grams[p], extent


# ---------------------------------------------------------------- step 3: deep-shallow sorting of one group

class _Node:
    """A node of a blind trie: ``at`` is the first place where its branches differ."""

    __slots__ = ("at", "branch", "leaf")

    def __init__(self, at: int, leaf: list[int] | None = None):
        self.at, self.branch, self.leaf = at, {}, leaf


def blind_trie(suffixes: list[bytes], members: list[int]) -> list[list[int]]:
    """Groups of equal suffixes (all of one length), in order. Only branching places are stored.

    Each suffix is led down blindly to some leaf, compared with it once to find where they part, and hung in there.
    """
    root = None
    for m in members:
        x = suffixes[m]
        if root is None:
            root = _Node(len(x), [m])
            continue
        path, node = [], root
        while node.leaf is None:
            path.append(node)
            node = node.branch.get(x[node.at]) or next(iter(node.branch.values()))
        y = suffixes[node.leaf[0]]
        if x == y:
            node.leaf.append(m)
            continue
        low, high = 0, len(x)
        while high - low > 1:  # the longest common prefix, by halving
            mid = (low + high) // 2
            low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid)
        lcp = low
        above = None
        for above_next in path:
            if above_next.at >= lcp:
                break
            above = above_next
        below = root if above is None else above.branch[x[above.at]]
        if below.leaf is None and below.at == lcp:
            below.branch[x[lcp]] = _Node(len(x), [m])
            continue
        fork = _Node(lcp)
        fork.branch[y[lcp]] = below
        fork.branch[x[lcp]] = _Node(len(x), [m])
        if above is None:
            root = fork
        else:
            above.branch[x[above.at]] = fork
    groups, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if node.leaf is not None:
            groups.append(node.leaf)
        else:
            stack.extend(node.branch[c] for c in sorted(node.branch, reverse=True))
    return groups


def deep_shallow(suffixes: list[bytes], shallow: int = SHALLOW) -> list[list[int]]:
    """Places of the given suffixes (all of one length) in suffix order, equal ones in one list."""
    if len(suffixes) < 2:
        return [[i] for i in range(len(suffixes))]
    depth = min(shallow, len(suffixes[0])) // 8 * 8
    head = np.frombuffer(b"".join(s[:depth] for s in suffixes), dtype=">u8").reshape(len(suffixes), -1).astype(np.uint64)
    out: list[list[int]] = []
    stack = [(np.arange(len(suffixes)), 0)]
    while stack:
        members, word = stack.pop()
        if len(members) == 1:
            out.append([int(members[0])])
        elif len(members) <= SMALL:  # as in any quicksort, small parts are sorted directly
            ordered = sorted(members.tolist(), key=suffixes.__getitem__)
            out.append(ordered[:1])
            for a, b in itertools.pairwise(ordered):
                if suffixes[a] == suffixes[b]:
                    out[-1].append(b)
                else:
                    out.append([b])
        elif word == head.shape[1]:
            out.extend(blind_trie(suffixes, members.tolist()))
        else:  # multikey quicksort: part by the key at this depth, go deeper only among equals
            key = head[members, word]
            pivot = key[len(key) // 2]
            parts = ((members[key < pivot], word), (members[key == pivot], word + 1), (members[key > pivot], word))
            stack.extend(p for p in reversed(parts) if len(p[0]))
    return out


# ---------------------------------------------------------------- the operator

def anchored(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, h, at, anchor, extent): one row for each run of windows with one anchor.

    ``at`` holds the first window, and how far behind it the anchor and the last window start, in 32, 16 and 16 bits.
    An ``extent`` of LATER marks a run that is known to repeat an earlier one.
    """
    schema = "key long, h long, at long, anchor long, extent long"
    names = ["key", "h", "at", "anchor", "extent"]

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(2))
            parts = []
            for i, j in blocks(offsets):
                t, *more = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                parts.append((t + i, *more))
            if not parts:
                continue
            t, p, s, e, anchor, extent = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = (s << 32) | ((p - s) << 16) | (e - s)
            # Of equal extents in a batch all but the first are later ones whatever else there is. They go on under a
            # hash of their own place, so that a very common extent does not meet in one task.
            order = np.lexsort((at, np.asarray(batch.column(1))[t], np.asarray(batch.column(0))[t]))
            first = np.zeros(len(t), dtype=bool)
            first[order[np.unique(extent[order], return_index=True)[1]]] = True
            own = mix(t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ at.astype(np.uint64) ^ np.asarray(batch.column(0)).view(np.uint64)[t])
            anchor = np.where(first, anchor, own).view(np.int64)
            extent = np.where(first, np.maximum(extent, np.uint64(1)), np.uint64(LATER)).view(np.int64)
            ids = pa.array(t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), *[pa.array(x) for x in (at, anchor, extent)]], names=names)

    return rows.select("key", "h", "text").mapInArrow(run, schema)


def _borders(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, deal, hot, key, h, s, left, more, body): the bytes of each border run, fetched from its text."""
    schema = "anchor long, deal int, hot boolean, key long, h long, s int, left int, more int, body binary"

    def run(batches):
        for batch in batches:  # of which the last column is not needed here
            out = [[] for _ in range(9)]
            for key, h, text, borders in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), strict=True):
                data = text.encode()
                for b in borders.as_py() or ():
                    s, left, more = b["at"] >> 32, b["at"] >> 16 & 65535, b["at"] & 65535
                    deals = -(-b["n"] // GROUP)
                    row = (b["anchor"], (key * 2654435761 + h) % deals, deals > 1, key, h, s, left, more, data[s : s + more + length])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            if out[0]:
                types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    names = ["anchor", "deal", "hot", "key", "h", "s", "left", "more", "body"]
    # The same columns as in _removed, so that Spark computes the join's inputs once for both.
    return rows.where("size(borders) > 0").select("key", "h", "text", "borders", "whole").mapInArrow(run, schema)


def _ranked(strings: list[bytes], group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order within groups, as each row's rank, and the common prefix of each rank with the one before."""
    tagged = [int(g).to_bytes(8, "big") + s for g, s in zip(group, strings, strict=True)]
    order = np.array([m for equal in deep_shallow(tagged, shallow + 8) for m in equal])
    grid = np.frombuffer(b"".join(tagged), dtype=np.uint8).reshape(len(tagged), -1)[order]
    differ = grid[1:] != grid[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), grid.shape[1]) - 8
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.concatenate([[-1], common])


def later_windows(group: np.ndarray, bodies: list[bytes], left: np.ndarray, more: np.ndarray, length: int, gram: int, shallow: int):
    """For rows in the order of their places: which windows repeat one of an earlier row of the group.

    Yields (d, rows with a window that has the anchor at d, whether each is a repeat).
    """
    reach = length - gram
    suffixes = [b[n : n + length].ljust(length, b"\0") for b, n in zip(bodies, left, strict=True)]
    prefixes = [b[:n][::-1].ljust(reach, b"\0") for b, n in zip(bodies, left, strict=True)]
    rank_s, common_s = _ranked(suffixes, group, shallow)
    rank_p, common_p = _ranked(prefixes, group, shallow)
    for d in range(reach + 1):
        rows = np.flatnonzero((d <= left) & (d >= left - more))
        if len(rows):
            kind_s = np.cumsum(common_s < length - d)[rank_s[rows]]
            kind_p = np.cumsum(common_p < d)[rank_p[rows]] if d else np.zeros(len(rows), dtype=np.int64)
            _, first, at = np.unique(kind_s << 32 | kind_p, return_index=True, return_inverse=True)
            yield d, rows, first[at] != np.arange(len(rows))


def _settled(borders: DataFrame, length: int, gram: int, shallow: int) -> DataFrame:
    """(key, h, s, e, digest): ranges to remove (null digest), and of hot anchors the first of equal windows."""
    schema = "key long, h long, s int, e int, digest binary"
    names = ["key", "h", "s", "e", "digest"]

    def settle(table: pa.Table):
        table = table.sort_by([(c, "ascending") for c in ("key", "h", "s")])
        col = {c: table.column(c).to_numpy() for c in ("anchor", "deal", "key", "h", "s", "left", "more", "hot")}
        bodies = table.column("body").to_pylist()
        _, group = np.unique(np.stack([col["anchor"], col["deal"].astype(np.int64)], axis=1), axis=0, return_inverse=True)
        group = group.reshape(-1)
        low, high = np.full(len(bodies), 1 << 30), np.full(len(bodies), -1)
        firsts_row, firsts_at = [], []
        for d, rows, later in later_windows(group, bodies, col["left"], col["more"], length, gram, shallow):
            gone = rows[later]
            low[gone] = np.minimum(low[gone], d)
            high[gone] = np.maximum(high[gone], d)
            first = rows[~later]
            first = first[col["hot"][first]]
            firsts_row.append(first)
            firsts_at.append(col["left"][first] - d)
        # The marked windows of a row all hold its anchor, so together they are one range.
        gone = np.flatnonzero(high >= 0)
        anchor = col["s"] + col["left"]
        yield pa.RecordBatch.from_arrays([pa.array(col["key"][gone]), pa.array(col["h"][gone]), pa.array((anchor - high)[gone].astype(np.int32)), pa.array((anchor - low)[gone].astype(np.int32) + length), pa.nulls(len(gone), pa.binary())], names=names)
        rows, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts_row, firsts_at))
        if len(rows):
            digests = [hashlib.blake2b(bodies[r][a : a + length], digest_size=16).digest() for r, a in zip(rows.tolist(), at.tolist(), strict=True)]
            start = (col["s"][rows] + at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(col["key"][rows]), pa.array(col["h"][rows]), pa.array(start), pa.array(start + length), pa.array(digests, pa.binary())], names=names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor, deal = table.column("anchor").to_numpy(), table.column("deal").to_numpy()
                same = (anchor == anchor[-1]) & (deal == deal[-1])
                keep = int(np.argmax(same))  # rows come sorted by group: the last may go on in the next batch
                if keep:
                    yield from settle(table.slice(0, keep))
                held = table.slice(keep).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    return borders.repartition("anchor", "deal").sortWithinPartitions("anchor", "deal").mapInArrow(run, schema)


def _removed(rows: DataFrame, length: int) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) from a text, its whole runs to remove and its further ranges."""
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept binary"
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for key, text, whole, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.encode()
                at = np.asarray(whole.values) if whole.is_valid else np.zeros(0, np.int64)
                pairs = more.as_py() or ()
                start = np.concatenate([at >> 32, np.array([p["s"] for p in pairs], dtype=np.int64)])
                end = np.concatenate([(at >> 32) + (at & 65535) + length, np.array([p["e"] for p in pairs], dtype=np.int64)])
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order]) if len(order) else end
                new = np.append(True, start[1:] > end[:-1])[: len(start)]
                begin, stop = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(end) else end
                kept, last = [], 0
                for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                    kept.append(data[last:a])
                    last = b
                kept.append(data[last:])
                row = (None if key == NO_KEY else key, len(data), int((stop - begin).sum()), len(begin), b"".join(kept))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return rows.select("key", "text", "whole", "more", "borders").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, shallow: int = SHALLOW) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): each document without the bytes of repeated strings.

    ``length`` is at most 65,000. Documents' texts are shuffled once (both joins use one exchange); the runs of step 1,
    about one for 36 bytes of text, once.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer column")
    ids = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    total, distinct = docs.agg(F.count("*"), F.countDistinct(ids)).first()
    h = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if total > distinct else F.lit(0).cast("long")
    rows = docs.select(ids.alias("key"), h.alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if total > distinct:
        rows = rows.groupBy("key", "h").agg(F.first("text").alias("text"))
    # Step 2: everything about an anchor meets in one place; extents with one anchor are neighbours there.
    dealt = anchored(rows, length, gram).repartition("anchor")
    order = Window.partitionBy("anchor", "extent").orderBy("key", "h", "at")
    dealt = dealt.select("*", F.row_number().over(order).alias("rank"))
    of_anchor = Window.partitionBy("anchor")
    first = (F.col("rank") == 1) & (F.col("extent") != LATER)
    dealt = dealt.select("*", F.sum(first.cast("int")).over(of_anchor).alias("n"))
    border = F.struct("at", "anchor", "n")
    found = dealt.where(~first | (F.col("n") > 1)).groupBy("key", "h").agg(F.collect_list(F.when(~first, F.col("at"))).alias("whole"), F.collect_list(F.when(first, border)).alias("borders"))
    met = rows.join(found, ["key", "h"], "left")
    # Step 3
    settled = _settled(_borders(met, length), length, gram, shallow)
    tag = F.coalesce("digest", F.to_binary(F.concat_ws(",", "key", "h", "s"), F.lit("utf-8")))
    ranked = settled.select("*", F.row_number().over(Window.partitionBy(tag).orderBy("key", "h", "s")).alias("nth")).where("digest is null or nth > 1")
    more = ranked.groupBy("key", "h").agg(F.collect_list(F.struct("s", "e")).alias("more"))
    return _removed(met.join(more, ["key", "h"], "left"), length).withColumnRenamed("key", key)
