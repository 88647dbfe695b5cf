"""Curvature of sequences that arrive in parts, over many micro-batches.

Of every sequence a state is kept between batches: how far it has been read, the bases at the end that further curvature
depends on, and parts that came before those in front of them. So a record may be spread over any number of files, and
what is kept of it does not grow with its length as long as parts come about in order. Rows are those of the whole
sequence; each is given out once, as soon as the bases on both of its sides are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bendscape.functions.matrices import BUILTIN, Matrices
from bendscape.operators.curvature import curved, distances, track
from bendscape.params import DEFAULT, Params

ROLLS = ("active", "simple")
OUT = "seq_id string, piece int, pos int, curv_active double, curv_simple double"
#: at: bases read; piece: number of the open piece; length: its bases so far; tail: those at its end; waits: parts to come after a gap.
STATE = "at long, piece int, length long, tail binary, waits array<struct<at: long, bases: binary>>"
_UPPER = bytes.maketrans(b"acgt", b"ACGT")


class Progress:
    """A sequence as far as it is known. ``take`` adds the part at a place and gives the rows that are new."""

    def __init__(self, params: Params, matrices: Matrices, state: tuple | None = None):
        self.params, self.matrices = params, matrices
        self.at, self.piece, self.length, self.tail, waits = state or (0, -1, 0, b"", ())
        self.tail = bytes(self.tail)
        self.waits = {int(at): bytes(bases) for at, bases in waits or ()}

    def state(self) -> tuple:
        return self.at, self.piece, self.length, self.tail, sorted(self.waits.items())

    def take(self, at: int, bases: bytes) -> list[tuple]:
        """Rows (piece, pos, curvature by each matrix). A part that is there already, or its beginning, is passed over."""
        if at > self.at:
            self.waits[at] = max(bases, self.waits.get(at, b""), key=len)
            return []
        out, todo = [], bases[self.at - at :]
        while todo:
            out += self._read(todo)
            ready = sorted(a for a in self.waits if a <= self.at)
            todo = b""
            for a in ready:
                more = self.waits.pop(a)[self.at - a :]
                todo = max(todo, more, key=len)
        return out

    def _read(self, bases: bytes) -> list[tuple]:
        self.at += len(bases)
        text = np.frombuffer(bases.translate(_UPPER), dtype=np.uint8)
        known = np.isin(text, np.frombuffer(b"ACGT", dtype=np.uint8))
        edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
        out, end = [], 0
        for low, high in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if low > 0 or not self.length:
                self.piece, self.length, self.tail = self.piece + 1, 0, b""
            out += self._grow(text[low:high].tobytes())
            end = high
        if end < len(text):  # the open piece ends here
            self.length, self.tail = 0, b""
        return out

    def _grow(self, run: bytes) -> list[tuple]:
        reach = self.params.reach
        body = self.tail + run
        start, before = self.length - len(self.tail), self.length
        self.length += len(run)
        # Up to where curvature was known already; the rest of the places is given out now.
        first = max(reach + 1, before - 1 - reach) if before else reach + 1
        one = lambda v: np.array([v])
        t = track(one(self.length), one(start), one(start), pa.array([body], pa.binary()), len(body), ROLLS, self.matrices, self.params)
        keep = np.flatnonzero(curved(t, self.params) & (t.pos >= first))
        found = [self.params.curve_scale * distances(t, k, self.params)[keep] for k in ROLLS]
        self.tail = body[-(2 * reach + 4) :]
        return [(self.piece, int(p), float(a), float(s)) for p, a, s in zip(t.pos[keep], *found, strict=True)]


def _processor(params: Params, matrices: Matrices) -> StatefulProcessor:
    class Records(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("kept", STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            progress = Progress(params, matrices, self.kept.get() if self.kept.exists() else None)
            out = []
            parts = sorted((int(at), bytes(bases)) for part in rows for at, bases in zip(part["at"], part["bases"], strict=True) if bases is not None)
            for at, bases in parts:
                out += progress.take(at, bases)
            self.kept.update(progress.state())
            if out:
                frame = pd.DataFrame(out, columns=["piece", "pos", "curv_active", "curv_simple"])
                frame.insert(0, "seq_id", key[0])
                yield frame.astype({"piece": "int32", "pos": "int32"})

        def close(self) -> None:
            pass

    return Records()


def curvature_of_parts(parts: DataFrame, params: Params = DEFAULT, matrices: Matrices = BUILTIN) -> DataFrame:
    """(seq_id, piece, pos, curv_active, curv_simple) of a stream of (seq_id, at, bases); ``at``: the base, from 0, that a part begins with.

    Parts may come in any order and more than once; those of a sequence's start first keep the state small. The session
    needs the RocksDB state store, see :func:`keep_state`.
    """
    rows = parts.selectExpr("cast(seq_id as string) as seq_id", "cast(at as bigint) as at", "cast(bases as binary) as bases").groupBy("seq_id")
    return rows.transformWithStateInPandas(_processor(params, matrices), OUT, "Append", "None")


def keep_state(spark) -> None:
    """Sets the state store that processors of sequences need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
