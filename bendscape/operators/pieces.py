"""From sequences to pieces without unknown bases, and to triplets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bendscape.functions.matrices import BUILTIN, Matrices, matrix_table
from bendscape.operators.curvature import CHUNK, chunks, emit


def _starts(lengths: Column, block: int = 256) -> Column:
    """Where each of consecutive strings begins, from 1, given their lengths.

    An array grows by being copied, so sums run within blocks first: the work is in proportion to the strings.
    """
    begin = lambda at: F.struct(F.array().cast("array<bigint>").alias("starts"), at.cast("bigint").alias("at"))
    step = lambda acc, n: F.struct(F.concat(acc["starts"], F.array(acc["at"])).alias("starts"), (acc["at"] + n).alias("at"))
    run = lambda numbers, at: F.aggregate(numbers, begin(at), step, lambda acc: acc["starts"])
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    number = F.greatest(F.floor((F.size(lengths) - 1) / block), F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), number), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))

    def joined(parts: Column) -> Column:
        firsts = run(F.transform(parts, total), F.lit(1))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("n"), firsts.alias("at")), lambda z: run(z["n"], z["at"])))

    return F.transform(F.array(blocks), joined)[0]


def split_by_n(sequences: DataFrame, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(keep..., piece, start, end, seq): maximal runs without N of (seq_id, seq), numbered from 0; 1-based inclusive ends.

    Runs of N and other runs alternate, so the array of starts is as short as there are pieces. No shuffle.
    """
    tokens = F.regexp_extract_all(F.col("seq"), F.lit("(N+|[^N]+)"), F.lit(1))
    lengths = lambda t: F.transform(t, lambda x: F.length(x))
    starts = F.transform(F.array(tokens), lambda t: F.arrays_zip(t.alias("seq"), F.transform(F.array(lengths(t)), lambda n: _starts(n))[0].alias("start")))[0]
    found = F.filter(starts, lambda z: ~z["seq"].startswith("N"))
    rows = sequences.select(*keep, F.posexplode(found).alias("piece", "_z"))
    return rows.select(*keep, "piece", F.col("_z.start").alias("start"), (F.col("_z.start") + F.length("_z.seq") - 1).alias("end"), F.col("_z.seq").alias("seq"))


def piece_sequence(sequences: DataFrame, pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """``pieces`` (seq_id, piece, start, end) with ``seq``, cut from their sequences: (seq_id, piece, start, end, seq).

    Sequences are cut into blocks; each piece looks up those that it lies in, and its parts are joined. So a long sequence
    is spread over tasks, and the work is in proportion to the bases however many pieces there are.
    """
    blocks = chunks(sequences.select("seq_id", F.lit(0).alias("piece"), "seq"), 0, 0, size).select("seq_id", F.col("a").alias("_a"), F.col("body").alias("_body"))
    block = lambda place: F.floor((place - 1) / size)
    names = ("seq_id", "piece", "start", "end")
    wanted = pieces.select(*names, F.explode(F.sequence(block(F.col("start")), block(F.col("end")))).alias("_b")).withColumn("_a", (F.col("_b") * size).cast("int"))
    low = F.greatest(F.col("start") - F.col("_a"), F.lit(1)).cast("int")
    high = F.least(F.col("end") - F.col("_a"), F.lit(size)).cast("int")
    parts = wanted.join(blocks, ["seq_id", "_a"]).select(*names, F.struct("_a", F.substring(F.col("_body"), low, high - low + 1).alias("s")).alias("_p"))
    whole = F.concat_ws("", F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["s"].cast("string")))
    return parts.groupBy(*names).agg(whole.alias("seq"))


def label(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``description``, the name and range of each."""
    return pieces.withColumn("description", F.concat(F.col("seq_id").cast("string"), F.lit(" "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def triplet_windows(pieces: DataFrame, size: int = CHUNK, spread: int | None = None) -> DataFrame:
    """(seq_id, piece, pos, triplet): the n - 2 triplets of each piece, by their first base, from 0.

    Made from chunks of bases, batch by batch; no row holds the triplets of a piece.
    """

    def run(n, a, start, bodies, _):
        whole = bodies.cast(pa.large_binary())
        _, offsets, data = whole.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
        base = np.frombuffer(data, dtype=np.uint8)
        length = np.minimum(size, n - 2 - a).clip(0)  # triplets that begin in the chunk
        row = np.repeat(np.arange(len(n)), length)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        first = at[:-1][row] + inside
        three = np.stack([base[first], base[first + 1], base[first + 2]], axis=1)
        ends = pa.py_buffer(np.arange(0, 3 * len(row) + 1, 3, dtype=np.int32))
        return row, a[row] + inside, {"triplet": pa.StringArray.from_buffers(len(row), ends, pa.py_buffer(three))}

    return emit(chunks(pieces.select("seq_id", "piece", "seq"), 0, 2, size, spread), {"triplet": "string"}, run, size)


def with_matrix(triplets: DataFrame, matrices: Matrices = BUILTIN) -> DataFrame:
    """``triplets`` with both rolls, twist and tilt, from a table of 64 rows; null for what is no triplet."""
    return triplets.join(F.broadcast(matrix_table(triplets.sparkSession, matrices)), "triplet", "left")
