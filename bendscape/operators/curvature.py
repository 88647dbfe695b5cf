"""Coordinates, moving means, distances and curvature along pieces.

Everything is computed by one numpy kernel over chunks of pieces. A chunk owns the positions [a, a + CHUNK) of its piece
and comes with as many bases on both sides as they depend on, so a chromosome is many independent rows and no sort,
window or shuffle over positions is needed. Distances, and so curvature and symmetry, don't depend on where a chunk's
coordinates begin and how they are turned. Coordinates and means themselves do: there each chunk's own turn and steps are
summed first, in all tasks; these sums, one row a chunk, are scanned along the piece, and each chunk gets what lies before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendscape.functions.matrices import BASES, BUILTIN, Matrices
from bendscape.params import DEFAULT, Params

CHUNK = 1 << 15


def mean_weights(params: Params) -> np.ndarray:
    """Weights of the moving mean over [-half, half]: 1 up to ``curve_step_two``, and at both ends a half.

    Where the inner part does not reach up to the ends, these weigh 2 / ``curve_step_two``, and what lies between nothing.
    """
    half, inner = params.half_mean, params.curve_step_two
    weights = (np.abs(np.arange(-half, half + 1)) <= inner).astype(float)
    weights[[0, -1]] = 0.5 if inner == half - 1 else 2.0 / inner
    return weights / (2 * half)


def taps(params: Params) -> np.ndarray:
    """What the difference of the two means at a base's sides takes of each step (dx, dy), from -reach to reach - 1."""
    w, c = mean_weights(params), params.curve_step
    on_x = np.zeros(2 * params.reach + 1)
    on_x[2 * c :] += w
    on_x[: len(w)] -= w
    return np.cumsum(on_x[::-1])[::-1][1:]


def chunks(pieces: DataFrame, left: int, right: int, size: int = CHUNK, spread: int | None = None, ordered: bool = False) -> DataFrame:
    """(seq_id, piece, n, a, from, body): the chunks of pieces, each with the bases around it; with ``shift`` if pieces have it.

    ``spread``: deal the chunks over that many partitions, for few and long sequences. ``ordered``: deal them by ranges of
    (seq_id, piece, a) instead and sort them, so that what is made of them comes in order. A store of blocks
    (:mod:`bendscape.sources.store`) cuts its own.
    """
    if not isinstance(pieces, DataFrame):
        return pieces.as_chunks(left, right, size, spread, ordered)
    # Of bytes, unlike of text, a slice is taken without a walk from the start; they are made once for a piece.
    start = lambda a: F.greatest(F.lit(0), a - left)
    body = lambda b, a: F.substring(b, start(a) + 1, a - start(a) + size + right)
    slices = lambda b: F.transform(F.sequence(F.lit(0), F.octet_length(b) - 1, F.lit(size)), lambda a: F.struct(F.octet_length(b).alias("n"), a.alias("a"), start(a).alias("from"), body(b, a).alias("body")))
    found = F.transform(F.array(F.col("seq").cast("binary")), lambda b: slices(b))[0]
    names = ["seq_id", "piece", *(c for c in ("shift",) if c in pieces.columns)]
    # The length goes in with each slice, since a column beside them would take the whole sequence along to each.
    out = pieces.where(F.length("seq") > 0).select(*names, F.explode(found).alias("_c")).select(*names, "_c.*")
    if ordered:
        spread = spread or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return out.repartitionByRange(spread, "seq_id", "piece", "a").sortWithinPartitions("seq_id", "piece", "a")
    return out.repartition(spread, "seq_id", "piece", "a") if spread else out


@dataclass
class Track:
    """The bases of a batch of chunks in a row, and the arrays over them."""

    row: np.ndarray  # which chunk
    pos: np.ndarray  # place in the piece
    owned: np.ndarray
    n: np.ndarray
    roll: dict[str, np.ndarray]
    angle: np.ndarray  # summed twist, from the chunk's own start
    twist: np.ndarray
    dx: dict[str, np.ndarray]
    dy: dict[str, np.ndarray]
    first: np.ndarray
    a: np.ndarray
    codes: np.ndarray


_CODES = np.full(256, -1, dtype=np.int64)
_CODES[[ord(b) for b in "ATGC"]] = range(4)


def track(n: np.ndarray, a: np.ndarray, start: np.ndarray, bodies: pa.Array, size: int, kinds: tuple[str, ...], matrices: Matrices, params: Params, part: pa.RecordBatch | None = None) -> Track:
    """Steps (dx, dy) of every triplet of a batch of chunks. ``part`` names their sequences in errors."""
    whole = bodies.cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    codes = _CODES[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]]
    first = at - at[0]
    length = np.diff(first)
    row = np.repeat(np.arange(len(length)), length)
    pos = np.arange(len(codes)) - first[:-1][row] + start[row]
    if (codes < 0).any():
        bad = int(np.argmax(codes < 0))
        of = f"piece {part.column(1)[int(row[bad])]} of sequence {part.column(0)[int(row[bad])]}" if part is not None else "a piece"
        raise ValueError(f"Error: triplet must be of length 3; base {pos[bad]} of {of} is none of A, T, G and C")
    index = np.zeros(len(codes), dtype=np.int64)
    index[:-2] = 16 * codes[:-2] + 4 * codes[1:-1] + codes[2:]
    ok = pos + 2 < np.minimum(start + length, n)[row]
    twist = np.where(ok, matrices.twist[index], 0.0)
    if (one := matrices.constant_twist) is not None:
        angle = (pos - a[row] + 1) * one
    else:
        total = np.cumsum(twist)
        before = np.append(0.0, total)[first[:-1] + np.maximum(a - start, 0)]
        angle = total - before[row]
    sin, cos = np.sin(angle), np.cos(angle)
    tilt = matrices.tilt[index]
    if tilt.any():
        phase = np.pi * params.tilt_phase
        tilt_x, tilt_y = tilt * np.sin(angle + phase), tilt * np.cos(angle + phase)
    else:
        tilt_x = tilt_y = 0.0
    roll = {k: np.where(ok, matrices.roll(k)[index], 0.0) for k in kinds}
    dx = {k: np.where(ok, r * sin + tilt_x, 0.0) for k, r in roll.items()}
    dy = {k: np.where(ok, r * cos + tilt_y, 0.0) for k, r in roll.items()}
    return Track(row, pos, (pos >= a[row]) & (pos < a[row] + size), n[row], roll, angle, twist, dx, dy, first, a, codes)


def distances(t: Track, kind: str, params: Params) -> np.ndarray:
    """Distance between the means on a base's two sides, over all places of the track; right where it is defined."""
    h, reach = taps(params), params.reach
    one = lambda d: np.convolve(d, h[::-1])[reach - 1 : reach - 1 + len(d)]
    return np.hypot(one(t.dx[kind]), one(t.dy[kind])) if len(t.pos) else np.zeros(0)


def curved(t: Track, params: Params) -> np.ndarray:
    """Where distance and curvature are defined."""
    return (t.pos >= params.reach + 1) & (t.pos <= t.n - 2 - params.reach)


def emit(rows: DataFrame, columns: dict[str, str], make, size: int = CHUNK) -> DataFrame:
    """(seq_id, piece, pos, columns...): runs ``make(n, a, from, bodies, batch)`` over batches of chunks.

    ``make`` returns (row of the batch, pos, {column: values}). ``shift`` goes along, after ``pos``, if chunks have it. Rows
    come in the order of the chunks.
    """
    schema = T.StructType([rows.schema["seq_id"], rows.schema["piece"]]).add("pos", T.IntegerType())
    along = [c for c in ("shift",) if c in rows.columns]
    for name in along:
        schema.add(rows.schema[name])
    for name, kind in columns.items():
        schema.add(name, kind)
    names = schema.names
    order = ["seq_id", "piece", "n", "a", "from", "body"]
    order += [c for c in rows.columns if c not in order]
    places = [order.index(c) for c in along]
    step = 1 << 16  # bases at once: arrays of doubles over them stay in a core's cache

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(5)), dtype=np.int64))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + step)))
                part = batch.slice(i, j - i)
                number = [np.asarray(part.column(k)).astype(np.int64) for k in (2, 3, 4)]
                row, pos, values = make(*number, part.column(5), part)
                if len(row):
                    ids = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(ids) for k in (0, 1)), pa.array(pos.astype(np.int32)), *(part.column(k).take(ids) for k in places), *[v if isinstance(v := values[c], pa.Array) else pa.array(v) for c in columns]], names=names)
                i = j

    return rows.select(*order).mapInArrow(run, schema)


def _local(pieces: DataFrame, columns: tuple[str, ...] | dict[str, str], halo: int, make, matrices: Matrices, params: Params, kinds: tuple[str, ...], spread: int | None, size: int, ordered: bool = False) -> DataFrame:
    def run(n, a, start, bodies, part):
        t = track(n, a, start, bodies, size, kinds, matrices, params, part)
        keep, values = make(t)
        keep = np.flatnonzero(keep & t.owned)
        return t.row[keep], t.pos[keep], {c: values[c][keep] for c in columns}

    return emit(chunks(pieces, halo, halo, size, spread, ordered), columns if isinstance(columns, dict) else dict.fromkeys(columns, "double"), run, size)


def euc_dist(pieces: DataFrame, roll: str = "simple", params: Params = DEFAULT, matrices: Matrices = BUILTIN, spread: int | None = None, size: int = CHUNK) -> DataFrame:
    """(seq_id, piece, pos, dist)"""
    return _local(pieces, ("dist",), params.reach + 2, lambda t: (curved(t, params), {"dist": distances(t, roll, params)}), matrices, params, (roll,), spread, size)


def curvature(pieces: DataFrame, roll: str = "simple", params: Params = DEFAULT, matrices: Matrices = BUILTIN, spread: int | None = None, size: int = CHUNK) -> DataFrame:
    """(seq_id, piece, pos, dist, curv) where curvature is defined."""

    def make(t: Track):
        d = distances(t, roll, params)
        return curved(t, params), {"dist": d, "curv": params.curve_scale * d}

    return _local(pieces, ("dist", "curv"), params.reach + 2, make, matrices, params, (roll,), spread, size)


def curvature_dual(pieces: DataFrame, params: Params = DEFAULT, matrices: Matrices = BUILTIN, spread: int | None = None, size: int = CHUNK, base: bool = False, ordered: bool = False) -> DataFrame:
    """(seq_id, piece, pos, curv_active, curv_simple) from one pass; with ``base``, the base there too; ``ordered``: by place."""
    kinds = ("active", "simple")

    def make(t: Track):
        found = {f"curv_{k}": params.curve_scale * distances(t, k, params) for k in kinds}
        return curved(t, params), found | ({"base": np.array(list(BASES), dtype=object)[t.codes]} if base else {})

    columns = {"curv_active": "double", "curv_simple": "double"} | ({"base": "string"} if base else {})
    return _local(pieces, columns, params.reach + 2, make, matrices, params, kinds, spread, size, ordered)


# ---------------------------------------------------------------- what has an origin

def _placed_chunks(pieces: DataFrame, halo: int, roll: str, matrices: Matrices, params: Params, size: int, spread: int | None) -> DataFrame:
    """Chunks with turn, x0 and y0: how far the coordinates before a chunk have turned and come.

    A scan in two levels over (turn, x, y), where a chunk's steps are turned by all the turn before it. Each chunk is
    summed on its own; the sums, a row a chunk, are added along the piece. Of a piece with one chunk nothing is summed.
    """
    # A number of its own keeps the short rows of bases from being put together into few tasks.
    spread = spread or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sums(n, a, start, bodies, part):
        t = track(n, a, start, bodies, size, (roll,), matrices, params, part)
        total = lambda v: np.bincount(t.row[t.owned], weights=v[t.owned], minlength=len(n)).astype(float)
        return np.arange(len(n)), a, {"turn": total(t.twist), "dx": total(t.dx[roll]), "dy": total(t.dy[roll])}

    names = ("seq_id", "piece", "pos")
    long = chunks(pieces.where(F.length("seq") > size).select("seq_id", "piece", "seq"), 4, 4, size, spread)
    own = emit(long, {"turn": "double", "dx": "double", "dy": "double"}, sums, size)
    before = Window.partitionBy("seq_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    turned = own.withColumn("_turn", gone("turn"))
    c, s = F.cos("_turn"), F.sin("_turn")
    turned = turned.select(*names, "_turn", (F.col("dx") * c + F.col("dy") * s).alias("_x"), (F.col("dy") * c - F.col("dx") * s).alias("_y"))
    placed = turned.select("seq_id", "piece", F.col("pos").alias("a"), F.col("_turn").alias("turn"), gone("_x").alias("x0"), gone("_y").alias("y0"))
    rows = chunks(pieces, halo, halo, size, spread).join(placed, ["seq_id", "piece", "a"], "left")
    return rows.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("turn", "x0", "y0")})


def _walked(t: Track, roll: str, part: pa.RecordBatch, turn: np.ndarray, x0: np.ndarray, y0: np.ndarray):
    """Coordinates (x, y) of every place of the track that has a triplet before it."""
    x, y = np.zeros(len(t.pos)), np.zeros(len(t.pos))
    for i in range(len(t.a)):
        lo, hi = t.first[i], t.first[i + 1]
        lead = int(t.a[i] - t.pos[lo]) if hi > lo else 0
        sums = []
        for d in (t.dx[roll][lo:hi], t.dy[roll][lo:hi]):
            s = np.cumsum(d)
            s = np.append(0.0, s[:-1])  # the coordinate of a place is the sum of the steps before it
            sums.append(s - s[lead] if lead < len(s) else s)
        c, s = np.cos(turn[i]), np.sin(turn[i])
        x[lo:hi] = x0[i] + sums[0] * c + sums[1] * s
        y[lo:hi] = y0[i] + sums[1] * c - sums[0] * s
    return x, y


def coords(pieces: DataFrame, roll: str = "simple", params: Params = DEFAULT, matrices: Matrices = BUILTIN, spread: int | None = None, size: int = CHUNK) -> DataFrame:
    """(seq_id, piece, pos, x, y) for 1 <= pos <= n - 2: where the steps of all triplets before lead."""

    def make(t: Track, x, y):
        return (t.pos >= 1) & (t.pos <= t.n - 2), {"x": x, "y": y}

    return _placed(pieces, ("x", "y"), 4, make, roll, params, matrices, spread, size)


def roll_mean(pieces: DataFrame, roll: str = "simple", params: Params = DEFAULT, matrices: Matrices = BUILTIN, spread: int | None = None, size: int = CHUNK) -> DataFrame:
    """(seq_id, piece, pos, x_bar, y_bar): weighted moving means of the coordinates."""
    w, half = mean_weights(params), params.half_mean

    def make(t: Track, x, y):
        mean = lambda v: np.convolve(v, w)[half : half + len(v)]
        return (t.pos >= half + 1) & (t.pos <= t.n - 2 - half), {"x_bar": mean(x), "y_bar": mean(y)}

    return _placed(pieces, ("x_bar", "y_bar"), half + 4, make, roll, params, matrices, spread, size)


def _placed(pieces, columns, halo, make, roll, params, matrices, spread, size) -> DataFrame:
    rows = _placed_chunks(pieces, halo, roll, matrices, params, size, spread)

    def run(n, a, start, bodies, part):
        t = track(n, a, start, bodies, size, (roll,), matrices, params, part)
        turn, x0, y0 = (np.asarray(part.column(k)) for k in ("turn", "x0", "y0"))
        keep, values = make(t, *_walked(t, roll, part, turn, x0, y0))
        keep = np.flatnonzero(keep & t.owned)
        return t.row[keep], t.pos[keep], {c: values[c][keep] for c in columns}

    return emit(rows, dict.fromkeys(columns, "double"), run, size)


def triplet_params(pieces: DataFrame, roll: str = "simple", params: Params = DEFAULT, matrices: Matrices = BUILTIN, spread: int | None = None, size: int = CHUNK) -> DataFrame:
    """(seq_id, piece, pos, roll, twist, twist_sum, dx, dy) of each triplet, with twist summed from the piece's start."""
    rows = _placed_chunks(pieces, 4, roll, matrices, params, size, spread)
    columns = ("roll", "twist", "twist_sum", "dx", "dy")

    def run(n, a, start, bodies, part):
        t = track(n, a, start, bodies, size, (roll,), matrices, params, part)
        turn = np.asarray(part.column("turn"))
        c, s, turn = np.cos(turn)[t.row], np.sin(turn)[t.row], turn[t.row]
        dx, dy = t.dx[roll], t.dy[roll]
        values = {"roll": t.roll[roll], "twist": t.twist, "twist_sum": turn + t.angle, "dx": dx * c + dy * s, "dy": dy * c - dx * s}
        keep = np.flatnonzero(t.owned & (t.pos <= t.n - 3))
        return t.row[keep], t.pos[keep], {k: values[k][keep] for k in columns}

    return emit(rows, dict.fromkeys(columns, "double"), run, size)
