"""Symmetry of curvature around local minima.

Curvature is rounded to nine digits first: on homopolymers it is constant, and without rounding the noise of the last
bits would decide whether a sum of differences is zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bendscape.functions.matrices import BUILTIN, Matrices
from bendscape.operators.curvature import CHUNK, Track, chunks, curved, distances, emit, track
from bendscape.params import CORE, DEFAULT, HALF, SCORE_CAP, WEIGHT_FLOOR, Params

DIGITS = 9


def _shift(v: np.ndarray, by: int) -> np.ndarray:
    """``v`` at the place ``by`` further on; zero beyond the ends."""
    out = np.zeros_like(v)
    if abs(by) >= len(v):
        return out
    if by >= 0:
        out[: len(v) - by] = v[by:]
    else:
        out[-by:] = v[:by]
    return out


def dyads(t: Track, params: Params) -> np.ndarray:
    """Where symmetry is defined: by default a whole window inside the defined curvature, else wherever it can be computed."""
    first, last = dyad_range(t.n, params)
    step = params.symmetry_step if params.bounds == "legacy" else 1
    return (t.pos >= first) & (t.pos <= last) & ((t.pos - first) % step == 0)


def dyad_range(n, params: Params):
    """First and last dyad of a piece of n bases; the last is before the first if it has none."""
    edge = params.reach + 1 + params.half_window
    if params.bounds == "full":
        return edge, n - 1 - edge
    return params.symmetry_win, n - params.reach - 2 - params.symmetry_win


def measures(t: Track, kind: str, params: Params) -> dict[str, np.ndarray]:
    """sym_sum, depth, weight and score over all places of the track; right at dyads."""
    k = np.where(curved(t, params), np.round(params.curve_scale * distances(t, kind, params), DIGITS), 0.0)
    total, part, half, m = np.zeros_like(k), np.empty_like(k), params.half_window, len(k)
    wide = np.concatenate([np.zeros(half), k, np.zeros(half)])
    for j in range(params.symmetry_step, half + 1, params.symmetry_step):
        np.subtract(wide[half + j : half + j + m], wide[half - j : half - j + m], out=part)
        total += np.abs(part, out=part)
    total = np.round(total, DIGITS)
    before, after = np.round(_shift(k, -1) - k, DIGITS), np.round(_shift(k, 1) - k, DIGITS)
    depth = np.round(before + after, DIGITS)
    lowest = (before > 0) & (after > 0) & (depth >= WEIGHT_FLOOR)
    weight = np.where(lowest, 1.0 / np.where(lowest, depth, 1.0), 0.0)
    flat = np.where(lowest | (params.flat_policy == "literal"), SCORE_CAP, 0.0)
    score = np.where(total > 0, weight / np.where(total > 0, total, 1.0), flat)
    return {"sym_sum": total, "weight": weight, "score": score}


def core_sums(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sums over the places up to HALF away in the same row. Only additions, by doubling, so that a sum of zeros is zero."""
    place = np.arange(len(values)) + HALF * (1 + row)  # zeros between rows
    padded = np.zeros(len(values) + HALF * (int(row[-1]) + 3) if len(row) else 0)
    padded[place] = values
    total, done, run, width = np.zeros_like(padded), 0, padded, 1
    while done < CORE:  # run: sums of so many places from each on
        if CORE & width:
            total[: len(total) - done] += run[done:]
            done += width
        run = run + _shift(run, width)
        width *= 2
    return total[place - HALF]


def reach_of(params: Params, more: int = 0) -> int:
    """How many bases on each side scores depend on."""
    return params.reach + params.half_window + 3 + more


def symmetry(pieces: DataFrame, rolls: tuple[str, ...] = ("active", "simple"), params: Params = DEFAULT, matrices: Matrices = BUILTIN, runsum: bool = False, spread: int | None = None, size: int = CHUNK, ordered: bool = False) -> DataFrame:
    """(seq_id, piece, pos, and sym_sum, weight and score of each roll) at all dyads.

    ``runsum``: instead (seq_id, piece, pos, runsum of each roll), the sums of scores over the bases of a core, for the
    bases from 1 up to one behind the last dyad. ``ordered``: rows come by place.
    """
    names = ("runsum",) if runsum else ("sym_sum", "weight", "score")
    columns = [f"{m}_{k}" for k in rolls for m in names]
    halo = reach_of(params, HALF if runsum else 0)

    def run(n, a, start, bodies, part):
        t = track(n, a, start, bodies, size, rolls, matrices, params, part)
        at = dyads(t, params)
        values, keep = {}, at & t.owned
        if runsum:
            first, last = dyad_range(t.n, params)
            keep = t.owned & (t.pos >= 1) & (t.pos <= last + 1) & (last >= first)
        for k in rolls:
            found = measures(t, k, params)
            if runsum:
                found = {"runsum": core_sums(np.where(at, found["score"], 0.0), t.row)}
            values |= {f"{m}_{k}": found[m] for m in names}
        keep = np.flatnonzero(keep)
        return t.row[keep], t.pos[keep], {c: values[c][keep] for c in columns}

    return emit(chunks(pieces, halo, halo, size, spread, ordered), dict.fromkeys(columns, "double"), run, size)


def symmetry_averages(pieces: DataFrame, rolls: tuple[str, ...] = ("active", "simple"), params: Params = DEFAULT, matrices: Matrices = BUILTIN, spread: int | None = None, size: int = CHUNK) -> DataFrame:
    """What :func:`symmetry_avg` makes of scores, but straight from the bases: a chunk gives one row of sums."""
    halo, edge = reach_of(params), params.reach + 1

    def run(n, a, start, bodies, part):
        t = track(n, a, start, bodies, size, rolls, matrices, params, part)
        at = np.flatnonzero(dyads(t, params) & t.owned)
        total = lambda v: np.bincount(t.row[at], weights=v, minlength=len(n)).astype(float)
        values = {f"sum_{k}": total(measures(t, k, params)["score"][at]) for k in rolls}
        return np.arange(len(n)), a, values | {"n": n.astype(np.int32), "dyads": np.bincount(t.row[at], minlength=len(n))}

    kinds = {f"sum_{k}": "double" for k in rolls} | {"n": "integer", "dyads": "long"}
    sums = emit(chunks(pieces, halo, halo, size, spread), kinds, run, size).groupBy("seq_id", "piece")
    sums = sums.agg(F.max("n").alias("n"), F.sum("dyads").alias("dyads"), *[F.sum(f"sum_{k}").alias(f"sum_{k}") for k in rolls]).where(F.col("n") > 2 * edge)
    return sums.select("seq_id", "piece", "n", *[F.when(F.col("dyads") > 0, F.col(f"sum_{k}") / (F.col("n") - edge)).alias(f"avg_{k}") for k in rolls])


def symmetry_avg(scores: DataFrame, pieces: DataFrame, rolls: tuple[str, ...] = ("active", "simple"), params: Params = DEFAULT) -> DataFrame:
    """(seq_id, piece, n, avg of each roll): the sum of scores over n - reach - 1, for pieces with any defined curvature; null where it has no dyad."""
    sums = scores.groupBy("seq_id", "piece").agg(*[F.sum(f"score_{k}").alias(f"sum_{k}") for k in rolls])
    edge = params.reach + 1
    lengths = pieces.select("seq_id", "piece", F.length("seq").alias("n")).where(F.col("n") > 2 * edge)
    return lengths.join(sums, ["seq_id", "piece"], "left").select("seq_id", "piece", "n", *[(F.col(f"sum_{k}") / (F.col("n") - edge)).alias(f"avg_{k}") for k in rolls])
