"""The whole analysis of a table of sequences, as tables that are made when they are asked for."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bendscape.functions import bases
from bendscape.functions.matrices import BUILTIN, Matrices
from bendscape.operators import calls, curvature, pieces, symmetry
from bendscape.params import DEFAULT, Params
from bendscape.sources.shared import cut
from bendscape.sources.store import Store

ROLLS = ("active", "simple")


class _ByRoll(Mapping):
    """A table for each matrix, made when it is first asked for."""

    def __init__(self, make: Callable[[str], DataFrame]):
        self._make, self._made = make, {}

    def __getitem__(self, roll: str) -> DataFrame:
        if roll not in ROLLS:
            raise KeyError(roll)
        if roll not in self._made:
            self._made[roll] = self._make(roll)
        return self._made[roll]

    def __iter__(self):
        return iter(ROLLS)

    def __len__(self) -> int:
        return len(ROLLS)


class Analysis:
    """Tables of an analysis. Only ``final`` runs jobs when it is asked for, as the greedy choice goes in rounds.

    ``shift`` in all of them is what to add to a place in a piece to get its published position.
    """

    def __init__(self, pieces: DataFrame | Store, params: Params = DEFAULT, matrices: Matrices = BUILTIN, legacy_bug: bool = False, spread: int | None = None, in_order: bool = False):
        self.pieces, self.params, self.matrices, self.legacy_bug = pieces, params, matrices, legacy_bug
        self._dealt = {"params": params, "matrices": matrices, "spread": spread, "ordered": in_order}
        #: Whether scores are kept, so that reading them is less work than making calls from the bases.
        self.kept = False

    @cached_property
    def curvature(self) -> DataFrame:
        return curvature.curvature_dual(self.pieces, base=True, **self._dealt)

    @cached_property
    def scores(self) -> DataFrame:
        return symmetry.symmetry(self.pieces, **self._dealt)

    @cached_property
    def runsums(self) -> DataFrame:
        return symmetry.symmetry(self.pieces, runsum=True, **self._dealt)

    @cached_property
    def averages(self) -> DataFrame:
        return symmetry.symmetry_averages(self.pieces, params=self.params, matrices=self.matrices, spread=self._dealt["spread"])

    @cached_property
    def initial(self) -> Mapping[str, DataFrame]:
        if self.kept:
            return _ByRoll(lambda k: calls.calls_overlapping(self.scores, self.pieces, k, self.params, self.legacy_bug))
        return _ByRoll(lambda k: calls.called(self.pieces, k, legacy_bug=self.legacy_bug, **self._dealt))

    @cached_property
    def final(self) -> Mapping[str, DataFrame]:
        return _ByRoll(lambda k: calls.calls_greedy(self.initial[k], self.params))

    def cores(self, roll: str) -> DataFrame:
        """The initial calls of a matrix with ``seq``, the bases of their cores, in one pass over the bases."""
        return calls.called(self.pieces, roll, legacy_bug=self.legacy_bug, cores=True, **self._dealt)

    def published(self, rows: DataFrame, place: str = "pos") -> DataFrame:
        """``rows`` with ``position``: the place in the sequence, from 0, plus the sequence's offset."""
        return rows.withColumn("position", F.col(place) + F.col("shift")).drop("shift")

    def ordered(self) -> Analysis:
        """The same with curvature, scores and sums in the order of sequence and place, each dealt by ranges of chunks."""
        return Analysis(self.pieces, self.params, self.matrices, self.legacy_bug, self._dealt["spread"], True)

    def stored(self) -> Analysis:
        """The same with its scores kept in the shared folder, for several tables made from them; runs a job."""
        out = copy.copy(self)
        for name in ("initial", "final"):
            out.__dict__.pop(name, None)
        out.scores, out.kept = cut(self.scores), True
        return out


def analyse_blocks(store: Store, params: Params = DEFAULT, matrices: Matrices = BUILTIN, legacy_bug: bool = False, spread: int | None = None) -> Analysis:
    """The same of sequences in blocks (:mod:`bendscape.sources.store`), none of which is ever held whole: forward strands,
    split at unknown bases. Runs no job."""
    if params.bounds != "legacy":
        raise ValueError("sequences in blocks have legacy bounds only")
    spread = spread or int(store.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Analysis(store, params, matrices, legacy_bug, spread)


def analyse(sequences: DataFrame, params: Params = DEFAULT, matrices: Matrices = BUILTIN, n_policy: str = "split", legacy_bug: bool = False, spread: int | None = None) -> Analysis:
    """Curvature, symmetry and calls of (seq_id, offset, strand, seq). Runs no job.

    Sequences are read along their strand in upper case. ``n_policy``: ``split`` them at unknown bases, or take every
    sign that is no base ``to_a``. With ``split`` other signs than A, C, G, T and N are unknown too. Chunks are dealt over
    ``spread`` partitions, by default as many as a shuffle has.
    """
    if n_policy not in ("split", "to_a"):
        raise ValueError(f"n_policy is split or to_a, not {n_policy!r}")
    spread = spread or int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = bases.normalize_seq(F.col("seq")) if n_policy == "to_a" else bases.known_or_n(F.col("seq"))
    ready = sequences.select("seq_id", "offset", bases.on_strand(clean, F.col("strand")).alias("seq"))
    split = pieces.split_by_n(ready, ("seq_id", "offset")).withColumn("shift", F.col("start") - 1 + F.col("offset"))
    return Analysis(split.drop("offset"), params, matrices, legacy_bug, spread)
