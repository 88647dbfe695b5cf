"""Sequences in blocks of two bits a base, for sequences that don't fit into a row.

A block has 32,768 bases: 8 kB of bits, and a bit mask of unknown bases only where it has any. Bases are A, T, G and C in
either case, all else is unknown. Nothing here holds a sequence: pieces are runs of known bases, found in each block and
joined where blocks meet; curvature, scores and sums are computed from a block and the ends of its neighbours; and a slice
is looked up in the blocks that it lies in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendscape.functions.matrices import BASES
from bendscape.operators.curvature import CHUNK
from bendscape.sources.shared import cut

_LETTERS = np.frombuffer(BASES.encode(), dtype=np.uint8)
_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[_LETTERS] = _CODE[_LETTERS + 32] = np.arange(4)


#: Blocks that are decoded at once, so that a task of Python holds no whole batch of them twice.
FEW = 256


def _few(batches):
    """The rows of ``batches``, ``FEW`` at a time."""
    for batch in batches:
        for i in range(0, len(batch), FEW):
            yield batch.slice(i, FEW)


def encode(text: bytes) -> tuple[bytes, bytes | None]:
    """Two bits for each base, four to a byte, and the mask of unknown ones."""
    codes = _CODE[np.frombuffer(text, dtype=np.uint8)]
    unknown = codes == 4
    codes = np.where(unknown, 0, codes)
    codes = np.append(codes, np.zeros(-len(codes) % 4, dtype=np.uint8)).reshape(-1, 4)
    bits = (codes << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return bits.tobytes(), np.packbits(unknown).tobytes() if unknown.any() else None


def decode(n: int, bits: bytes, unknown: bytes | None) -> np.ndarray:
    """The letters that two bits stand for; N for unknown ones."""
    codes = (np.frombuffer(bits, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    text = _LETTERS[codes.ravel()[:n]]
    if unknown is not None:
        text = np.where(np.unpackbits(np.frombuffer(unknown, dtype=np.uint8), count=n).astype(bool), np.uint8(ord("N")), text)
    return text


def pack(parts: DataFrame, size: int = CHUNK) -> Store:
    """The store of parts (seq_id, at, bases), which may be of any length and come in any order, but don't overlap."""
    block = lambda place: F.floor(place / F.lit(size))
    n = F.octet_length("bases")
    split = parts.where(n > 0).select("seq_id", "at", "bases", F.explode(F.sequence(block(F.col("at")), block(F.col("at") + n - 1))).alias("block"))
    low = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
    length = F.least(F.lit(size), (F.col("block") + 1) * size - F.col("at"))
    piece = F.substring("bases", (low + 1).cast("int"), (F.least(length, (F.col("block") + 1) * size - F.col("at") - low)).cast("int"))
    groups = split.select("seq_id", F.col("block").cast("int").alias("block"), F.struct((F.col("at") + low).alias("at"), piece.alias("bases")).alias("p"))
    groups = groups.groupBy("seq_id", "block").agg(F.sort_array(F.collect_list("p")).alias("parts"))

    def run(batches):
        for batch in _few(batches):
            rows = []
            for parts in batch.column(2).to_pylist():
                text = b"".join(p["bases"] for p in parts)
                rows.append((len(text), *encode(text)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True))], names=schema.names)

    schema = T.StructType([groups.schema["seq_id"], groups.schema["block"]]).add("n", "integer").add("bits", "binary").add("unknown", "binary")
    return Store(groups.mapInArrow(run, schema), size)


@dataclass(frozen=True)
class Store:
    """``blocks`` (seq_id, block, n, bits, unknown), as :func:`pack` makes them or as they were written before.

    Curvature, distances, scores, sums and averages take a store where they take pieces; ``shift`` in their rows is the
    place of a piece in its sequence.
    """

    blocks: DataFrame
    size: int = CHUNK

    def kept(self) -> Store:
        """The same with its blocks kept in the shared folder, for several uses of them; runs a job."""
        return Store(cut(self.blocks), self.size)

    def text(self) -> DataFrame:
        """(seq_id, block, n, seq): the bases of each block, N for unknown ones."""

        def run(batches):
            for batch in _few(batches):
                texts = [decode(n, b, u).tobytes() for n, b, u in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

        schema = T.StructType(self.blocks.schema.fields[:3]).add("seq", "string")
        return self.blocks.select("seq_id", "block", "n", "bits", "unknown").mapInArrow(run, schema)

    def runs(self) -> DataFrame:
        """(seq_id, block, low, high, piece, start, end): runs of known bases in each block, from 0 and half open, each with
        the number and the place of the piece that it is part of."""
        size = self.size

        def run(batches):
            for batch in _few(batches):
                row, low, high = [], [], []
                for i, (block, n, bits, unknown) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)):
                    known = np.ones(n, dtype=bool) if unknown is None else ~np.unpackbits(np.frombuffer(unknown, dtype=np.uint8), count=n).astype(bool)
                    edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
                    begins = np.flatnonzero(edge == 1)
                    row.append(np.full(len(begins), i))
                    low.append(begins + block * size)
                    high.append(np.flatnonzero(edge == -1) + block * size)
                at = pa.array(np.concatenate(row or [np.zeros(0, dtype=np.int64)]))
                places = [pa.array(np.concatenate(v or [np.zeros(0, dtype=np.int64)]).astype(np.int64)) for v in (low, high)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *places], names=schema.names)

        schema = T.StructType(self.blocks.schema.fields[:2]).add("low", "long").add("high", "long")
        found = self.blocks.select("seq_id", "block", "n", "bits", "unknown").mapInArrow(run, schema)
        along = Window.partitionBy("seq_id").orderBy("low")
        # A run goes on with the one before if nothing lies between; else it begins a piece.
        new = F.coalesce(F.col("low") > F.lag("high").over(along), F.lit(True)).cast("int")
        numbered = found.withColumn("_new", new).withColumn("piece", (F.sum("_new").over(along) - 1).cast("int"))
        of = Window.partitionBy("seq_id", "piece")
        return numbered.withColumns({"start": F.min("low").over(of), "end": F.max("high").over(of)}).drop("_new")

    def pieces(self) -> DataFrame:
        """(seq_id, piece, start, end): maximal runs of known bases, numbered from 0; 1-based inclusive ends. No bases."""
        return self.runs().groupBy("seq_id", "piece").agg((F.min("low") + 1).alias("start"), F.max("high").alias("end"))

    def sequences(self) -> DataFrame:
        """(seq_id, offset, strand, size) of each sequence; no bases."""
        ends = self.blocks.groupBy("seq_id").agg(F.max(F.col("block").cast("long") * self.size + F.col("n")).alias("size"))
        return ends.select("seq_id", F.lit(0).cast("long").alias("offset"), F.lit("+").alias("strand"), "size")

    def slices(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (seq_id, start, end, ...; 1-based inclusive) with ``seq``, from the blocks that each lies in.

        Places before or behind the sequence are left out.
        """
        names, size = wanted.columns, self.size
        block = lambda place: F.floor((place - 1) / F.lit(size))
        asked = wanted.withColumn("block", F.explode(F.sequence(block(F.greatest(F.col("start"), F.lit(1))), block(F.greatest(F.col("end"), F.lit(1))))))
        asked = asked.withColumn("block", F.col("block").cast("int"))
        met = asked.join(self.text().select("seq_id", "block", F.col("seq").cast("binary").alias("_s")), ["seq_id", "block"])
        low = F.greatest(F.col("start") - F.col("block") * size, F.lit(1))
        high = F.least(F.col("end") - F.col("block") * size, F.lit(size))
        part = F.struct("block", F.substring("_s", low.cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int")).alias("s"))
        whole = F.concat_ws("", F.transform(F.sort_array(F.collect_list(part)), lambda p: p["s"].cast("string")))
        return met.groupBy(*names).agg(whole.alias("seq"))

    def as_chunks(self, left: int, right: int, size: int, spread: int | None, ordered: bool) -> DataFrame:
        """(seq_id, piece, shift, n, a, from, body): each block's part of a piece with the bases around it, from its neighbours."""
        if size != self.size or max(left, right) > size:
            raise ValueError(f"a store in blocks of {self.size} can't be cut into chunks of {size} with {max(left, right)} bases around")
        n, eight = F.col("n"), lambda k: -(-k // 8) * 8
        # A block goes to itself, and to those beside it with the bases that these need, in whole bytes of bits and mask.
        part = lambda to, side, low, high: F.struct(F.lit(to).alias("to"), F.lit(side).alias("side"), (high - low).cast("int").alias("n"), F.substring("bits", (low / 4 + 1).cast("int"), F.ceil((high - low) / 4).cast("int")).alias("bits"), F.substring("unknown", (low / 8 + 1).cast("int"), F.ceil((high - low) / 8).cast("int")).alias("unknown"))
        zero = F.lit(0)
        end = F.greatest(zero, F.floor((n - left) / 8) * 8)
        sides = [part(0, 1, zero, n), F.when(n >= size, part(1, 0, end, n)), F.when(F.col("block") > 0, part(-1, 2, zero, F.least(n, F.lit(eight(right)))))]
        dealt = self.blocks.select("seq_id", "block", F.explode(F.array_compact(F.array(*sides))).alias("_e"))
        dealt = dealt.select("seq_id", (F.col("block") + F.col("_e.to")).alias("block"), F.struct("_e.side", "_e.n", "_e.bits", "_e.unknown").alias("_e"))
        runs = self.runs().select("seq_id", "block", F.struct("low", "high", "piece", "start", "end").alias("_r"))
        if spread and not ordered:
            # What is put together by block then is dealt as chunks are to be, so these are not shuffled as bases.
            dealt, runs = (rows.repartition(spread, "seq_id", "block") for rows in (dealt, runs))
        near = dealt.groupBy("seq_id", "block").agg(F.collect_list("_e").alias("near"))
        rows = runs.groupBy("seq_id", "block").agg(F.sort_array(F.collect_list("_r")).alias("runs")).join(near, ["seq_id", "block"])

        def run(batches):
            for batch in _few(batches):
                at, out = [], []
                for i, (block, runs, near) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                    by = {e["side"]: decode(e["n"], e["bits"], e["unknown"]) for e in near}
                    before = by[0][max(0, len(by[0]) - left) :] if 0 in by else by[1][:0]
                    text = np.concatenate([before, by[1], by[2][:right] if 2 in by else by[1][:0]]).tobytes()
                    origin = block * size - len(before)
                    for r in runs:
                        begin = max(r["start"], block * size - left)
                        body = text[begin - origin : min(r["end"], (block + 1) * size + right) - origin]
                        at.append(i)
                        out.append((r["piece"], r["start"], r["end"] - r["start"], block * size - r["start"], begin - r["start"], body))
                if at:
                    columns = zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in columns)], names=schema.names)

        schema = T.StructType([self.blocks.schema["seq_id"]]).add("piece", "integer").add("shift", "long")
        for name in ("n", "a", "from"):
            schema.add(name, "integer")
        out = rows.mapInArrow(run, schema.add("body", "binary"))
        if ordered:
            parts = spread or int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return out.repartitionByRange(parts, "seq_id", "piece", "a").sortWithinPartitions("seq_id", "piece", "a")
        return out
