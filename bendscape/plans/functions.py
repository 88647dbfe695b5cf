"""Table functions for SQL: ``SELECT * FROM curvature(TABLE(pieces))``.

Each takes a table with ``seq_id``, ``piece`` and ``seq`` in any order and of any types of ids, and gives rows with the same
ids, so what comes out depends on what goes in. Pieces are handed over one by one: ``TABLE(pieces) PARTITION BY seq_id``
spreads them over tasks by sequence; without it they stay in the partitions that they are in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from bendscape.functions.matrices import BUILTIN
from bendscape.operators.curvature import CHUNK, curved, distances, track
from bendscape.operators.symmetry import dyads, measures, reach_of
from bendscape.params import DEFAULT

#: Bases of pieces that go through the kernel at once.
TOGETHER = 1 << 16


def _described(table: AnalyzeArgument, columns: dict) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("a table is expected: TABLE(...) with seq_id, piece and seq")
    types = {f.name: f.dataType for f in table.dataType.fields}
    for name in ("seq_id", "piece", "seq"):
        if name not in types:
            raise ValueError(f"the table has no column {name}")
    if not isinstance(types["seq"], StringType):
        raise ValueError("seq is not a string")
    schema = StructType().add("seq_id", types["seq_id"]).add("piece", types["piece"]).add("pos", IntegerType())
    for name, kind in columns.items():
        schema.add(name, kind)
    return AnalyzeResult(schema)


class _Pieces:
    """Pieces are held until they have ``TOGETHER`` bases, or their partition ends, and go through the kernel together."""

    halo = 0

    def __init__(self):
        self.held, self.size = [], 0

    def eval(self, row):
        data = (row["seq"] or "").encode()
        self.held.append((row["seq_id"], row["piece"], data))
        self.size += len(data)
        if self.size >= TOGETHER:
            yield from self.rows()

    def terminate(self):
        yield from self.rows()

    def rows(self):
        held, self.held, self.size = self.held, [], 0
        todo, size = [], 0
        for seq_id, piece, data in held:
            for a in range(0, len(data), CHUNK):
                start = max(0, a - self.halo)
                body = data[start : a + CHUNK + self.halo]
                todo.append((seq_id, piece, len(data), a, start, body))
                size += len(body)
                if size >= TOGETHER:
                    yield from self.made(todo)
                    todo, size = [], 0
        if todo:
            yield from self.made(todo)

    def made(self, todo):
        ids, numbers, n, a, start, bodies = zip(*todo, strict=True)
        t = track(np.array(n), np.array(a), np.array(start), pa.array(bodies, pa.binary()), CHUNK, ("active", "simple"), BUILTIN, DEFAULT)
        at, found = self.values(t)
        at = np.flatnonzero(at & t.owned)
        row = t.row[at].tolist()
        return zip(map(ids.__getitem__, row), map(numbers.__getitem__, row), t.pos[at].tolist(), *(v[at].tolist() for v in found), strict=True)


class Curvature(_Pieces):
    """(seq_id, piece, pos, curv_active, curv_simple)"""

    halo = DEFAULT.reach + 2

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _described(table, {"curv_active": DoubleType(), "curv_simple": DoubleType()})

    def values(self, t):
        return curved(t, DEFAULT), [DEFAULT.curve_scale * distances(t, k, DEFAULT) for k in ("active", "simple")]


class Symmetry(_Pieces):
    """(seq_id, piece, pos, score_active, score_simple)"""

    halo = reach_of(DEFAULT)

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _described(table, {"score_active": DoubleType(), "score_simple": DoubleType()})

    def values(self, t):
        return dyads(t, DEFAULT), [measures(t, k, DEFAULT)["score"] for k in ("active", "simple")]


def register(spark: SparkSession) -> None:
    """Makes ``curvature`` and ``symmetry`` known to SQL."""
    spark.udtf.register("curvature", udtf(Curvature, useArrow=True))
    spark.udtf.register("symmetry", udtf(Symmetry, useArrow=True))
