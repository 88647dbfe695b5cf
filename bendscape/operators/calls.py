"""Nucleosome calls: candidates, and a greedy choice of those that keep their distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bendscape.functions.matrices import BUILTIN, Matrices
from bendscape.operators.curvature import CHUNK, chunks, emit, track
from bendscape.operators.symmetry import dyads, measures, reach_of
from bendscape.params import CORE, DEFAULT, HALF, SCORE_CAP, Params
from bendscape.sources.shared import cut

#: Places in a block of the greedy choice: in its first round, and at most.
BLOCK, WIDEST = 1 << 17, 1 << 20
#: Calls that a task settles at once, at least, where blocks have few.
TOGETHER = 1 << 16
#: What is known of a call: nothing yet, kept in this round or in one before, excluded.
OPEN, KEPT, BEFORE, OUT = range(4)

FEATURES = {"active": "stat_nucleosome", "simple": "act_nucleosome"}


def calls_overlapping(scores: DataFrame, pieces: DataFrame, roll: str = "active", params: Params = DEFAULT, legacy_bug: bool = False) -> DataFrame:
    """(seq_id, piece, dyad, start, end, score, score_capped) of dyads with a score over 0 whose core lies in the piece.

    ``start`` and ``end`` count from 0 in the piece. ``legacy_bug``: for the simple matrix, take scores at or over the
    cap from where the active matrix has them, as older programs did.
    """
    score = F.col(f"score_{roll}")
    called, capped = score > 0, F.least(score, F.lit(SCORE_CAP))
    if legacy_bug and roll == "simple":
        other = F.col("score_active") >= SCORE_CAP
        called, capped = ((score > 0) & (score < SCORE_CAP)) | other, F.when(other, F.lit(SCORE_CAP)).otherwise(score)
    dyad = F.col("pos")
    along = [c for c in ("shift",) if c in scores.columns]
    found = scores.where(called & (dyad > HALF)).select("seq_id", "piece", *along, dyad.alias("dyad"), (dyad - HALF).alias("start"), (dyad + HALF).alias("end"), score.alias("score"), capped.alias("score_capped"))
    # Symmetry is only defined where a core fits if its window is as wide; else lengths decide.
    if params.bounds == "legacy" and params.reach + 1 + params.symmetry_win >= HALF:
        return found
    lengths = pieces.select("seq_id", "piece", F.length("seq").alias("_n"))
    return found.join(lengths, ["seq_id", "piece"]).where("end < _n").drop("_n")


def called(pieces: DataFrame, roll: str = "active", params: Params = DEFAULT, matrices: Matrices = BUILTIN, legacy_bug: bool = False, cores: bool = False, spread: int | None = None, size: int = CHUNK, ordered: bool = False) -> DataFrame:
    """What :func:`calls_overlapping` makes of scores, but straight from the bases: by one matrix, and only calls leave a chunk.

    ``cores``: with ``seq``, the bases of each core, which the chunk has too. ``ordered``: rows come by place.
    """
    other = legacy_bug and roll == "simple"
    halo = max(reach_of(params), HALF)

    def run(n, a, start, bodies, part):
        t = track(n, a, start, bodies, size, ("active", "simple") if other else (roll,), matrices, params, part)
        score = measures(t, roll, params)["score"]
        found, capped = score > 0, np.minimum(score, SCORE_CAP)
        if other:
            over = measures(t, "active", params)["score"] >= SCORE_CAP
            found, capped = (found & (score < SCORE_CAP)) | over, np.where(over, SCORE_CAP, score)
        keep = np.flatnonzero(found & dyads(t, params) & t.owned & (t.pos > HALF) & (t.pos + HALF < t.n))
        values = {"score": score[keep], "score_capped": capped[keep]}
        if cores:
            whole = bodies.cast(pa.large_binary())
            _, offsets, data = whole.buffers()
            base = np.frombuffer(data, dtype=np.uint8)[np.frombuffer(offsets, dtype=np.int64)[whole.offset] :]
            text = base[keep[:, None] + np.arange(-HALF, HALF + 1)]
            values["seq"] = pa.StringArray.from_buffers(len(keep), pa.py_buffer(np.arange(0, CORE * len(keep) + 1, CORE, dtype=np.int32)), pa.py_buffer(text))
        return t.row[keep], t.pos[keep], values

    columns = {"score": "double", "score_capped": "double"} | ({"seq": "string"} if cores else {})
    rows = emit(chunks(pieces, halo, halo, size, spread, ordered), columns, run, size)
    along = [c for c in ("shift",) if c in rows.columns]
    dyad = F.col("pos")
    return rows.select("seq_id", "piece", *along, dyad.alias("dyad"), (dyad - HALF).alias("start"), (dyad + HALF).alias("end"), *columns)


def with_sequence(calls: DataFrame, pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """``calls`` with ``seq``, the bases of each core, looked up in the chunk that the core begins in (of a store: in its blocks)."""
    if not isinstance(pieces, DataFrame):
        first = F.col("shift") + F.col("start") + 1
        asked = calls.withColumns({"_start": F.col("start"), "_end": F.col("end"), "start": first, "end": first + CORE - 1})
        return pieces.slices(asked).withColumns({"start": F.col("_start"), "end": F.col("_end")}).select(*calls.columns, "seq")
    bodies = chunks(pieces.select("seq_id", "piece", "seq"), 0, CORE - 1, size).select("seq_id", "piece", F.col("a").alias("_a"), F.col("body").alias("_body"))
    met = calls.withColumn("_a", (F.floor(F.col("start") / size) * size).cast("int")).join(bodies, ["seq_id", "piece", "_a"])
    return met.withColumn("seq", F.substring(F.col("_body"), F.col("start") - F.col("_a") + 1, F.lit(CORE)).cast("string")).select(*calls.columns, "seq")


def calls_greedy(calls: DataFrame, params: Params = DEFAULT, sentinel: bool = True, digits: int = 6, block: int = BLOCK, widest: int = WIDEST) -> DataFrame:
    """The calls of each piece that a greedy choice keeps: by falling score (rounded to ``digits``), then by dyad, each
    one that is over ``spacing`` from all kept before. ``sentinel``: as if a call at 0 had been kept first.

    A piece is cut into blocks of ``block`` places, each with the calls around it, so a task holds one block at a time
    however long the piece. What a block can tell from these alone is final: a call is kept if none above it within
    ``spacing`` is open, and excluded if one within ``spacing`` is kept. Calls whose fate hangs on others further away stay
    open and go into another round, with the calls just kept and blocks four times as wide (``widest`` at most). Every
    round settles at least the best open call of each neighbourhood; mostly the first settles all. Rounds end in the
    shared folder, so this runs jobs when called.
    """
    spacing, names = params.spacing, calls.columns
    todo = (calls.where(F.col("dyad") > spacing) if sentinel else calls).withColumn("_state", F.lit(OPEN))
    done = None
    while True:
        settled = cut(_settled(todo, spacing, digits, block))
        kept = settled.where(F.col("_state") == KEPT).select(*names)
        done = kept if done is None else done.union(kept)
        if settled.where(F.col("_state") == OPEN).isEmpty():
            return done
        todo = settled.withColumn("_state", F.when(F.col("_state") == KEPT, BEFORE).otherwise(OPEN))
        block = min(4 * block, widest)


def _dealt(todo: DataFrame, around: int, block: int) -> DataFrame:
    """``todo`` with ``_block``, once for each block that a call lies in or within ``around`` of."""
    number = lambda c: F.floor(c / F.lit(block))
    # There is nothing before a piece that a block could own.
    first = F.greatest(number(F.col("dyad") - around), F.least(number(F.col("dyad")), F.lit(0)))
    return todo.withColumn("_block", F.explode(F.sequence(first, number(F.col("dyad") + around))))


def _settled(todo: DataFrame, spacing: int, digits: int, block: int) -> DataFrame:
    """The calls of ``todo`` that this round keeps or leaves open."""
    around = max(block // 8, 2 * spacing)
    dealt = _dealt(todo, around, block).repartition("seq_id", "piece", "_block")
    dealt = dealt.sortWithinPartitions("seq_id", "piece", "_block", "dyad", "score")
    keys = ("seq_id", "piece", "_block")

    def begins(table):
        """Which rows begin another block."""
        start = np.zeros(len(table), dtype=bool)
        start[:1] = True
        for c in keys:
            here, last = table.column(c).slice(1), table.column(c).slice(0, len(table) - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(here, last), False), pc.xor(pc.is_null(here), pc.is_null(last)))
            start[1:] |= differs.to_numpy()
        return start

    def run(batches):
        held, rows, enough = [], 0, TOGETHER
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < enough:
                continue
            table = pa.Table.from_batches(held)
            start = begins(table)
            # The last block may go on in the next batch.
            upto = int(np.flatnonzero(start)[-1])
            if upto:
                yield from settle(table.slice(0, upto), start[:upto])
            held, rows = table.slice(upto).to_batches(), len(table) - upto
            enough = max(TOGETHER, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held)
            yield from settle(table, begins(table))

    def settle(table, start):
        """Settles many blocks at once: their places are put so far apart that none is in reach of another's."""
        table = table.combine_chunks()
        place = table.column("dyad").to_numpy().astype(np.int64)
        begin = table.column("_block").to_numpy().astype(np.int64) * block
        waits = (place - spacing < begin - around) | (place + spacing >= begin + block + around)  # others outside of what is seen here may reach these
        apart = place - begin + (np.cumsum(start) - 1) * (block + 2 * around + spacing + 1)
        low, high = np.searchsorted(apart, apart - spacing).tolist(), np.searchsorted(apart, apart + spacing, side="right").tolist()
        state, waits = bytearray(table.column("_state").to_numpy().astype(np.uint8).tobytes()), bytearray(waits.astype(np.uint8).tobytes())
        score = np.round(table.column("score").to_numpy(), digits)

        def exclude(i):
            state[low[i] : high[i]] = state[low[i] : high[i]].replace(bytes([OPEN]), bytes([OUT]))

        for i in np.flatnonzero(np.frombuffer(bytes(state), dtype=np.uint8) == BEFORE).tolist():
            exclude(i)
        for i in np.lexsort((apart, -score)).tolist():
            if state[i] != OPEN:
                continue
            if waits[i]:
                waits[low[i] : high[i]] = b"\1" * (high[i] - low[i])
                continue
            exclude(i)
            state[i] = KEPT
        state = np.frombuffer(bytes(state), dtype=np.uint8)
        core = (place >= begin) & (place < begin + block) & ((state == OPEN) | (state == KEPT))
        table = table.set_column(table.schema.get_field_index("_state"), "_state", pa.array(state.astype(np.int32)))
        yield from table.drop_columns(["_block"]).take(pa.array(np.flatnonzero(core))).to_batches()

    return dealt.mapInArrow(run, todo.schema)


def gff_lines(calls: DataFrame, roll: str = "active", final: bool = False, offset: Column | int = 0, one_based: bool = False) -> DataFrame:
    """(seq_id, piece, dyad, line): nine tab-separated fields of each call with its bases; overlapping calls show capped scores."""
    shift = (offset if isinstance(offset, Column) else F.lit(offset)) + (1 if one_based else 0)
    score = F.col("score") if final else F.col("score_capped")
    fields = [F.col("seq_id").cast("string"), F.lit("evidence"), F.lit(FEATURES[roll]), (F.col("start") + shift).cast("string"), (F.col("end") + shift).cast("string"), F.format_string("%.6f", score), F.lit("+"), F.lit("."), F.col("seq")]
    return calls.select("seq_id", "piece", "dyad", F.concat_ws("\t", *fields).alias("line"))


def best_in_reach(calls: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The calls that beat all others within ``spacing``: the first round of the greedy choice, as one window."""
    near = Window.partitionBy("seq_id", "piece").orderBy("dyad").rangeBetween(-params.spacing, params.spacing)
    rank = F.struct(F.round("score", 6).alias("s"), (-F.col("dyad")).alias("d"))
    return calls.withColumn("_best", F.max(rank).over(near)).where(F.col("_best") == rank).drop("_best")
