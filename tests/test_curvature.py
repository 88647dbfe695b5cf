import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bendscape.functions import bases, matrices
from bendscape.operators import calls, curvature, pieces, symmetry
from bendscape.params import Params
from bendscape.plans.analysis import analyse

SHORT = "CCAACATTTTGACTTTTTGGGAGGGCACTAGCACCTATCTACCCTGAATC"
RNG = np.random.RandomState(5)
LONG = "".join(RNG.choice(list("ACGT"), 3000))


def frame(spark, *seqs):
    return pieces.split_by_n(spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(seqs)], "seq_id string, seq string"))


def column(df, name, order=("seq_id", "piece", "pos")):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_triplets_of_a_known_sequence(spark):
    rows = curvature.triplet_params(frame(spark, SHORT)).orderBy("pos").collect()
    assert len(rows) == 48
    for at, dx, dy in ((0, 0.3945, 0.5783), (1, 5.7725, 2.2622), (46, 0, 0), (47, -1.6006, -3.2246)):
        assert rows[at].dx == pytest.approx(dx, abs=1e-4) and rows[at].dy == pytest.approx(dy, abs=1e-4)
    assert pieces.triplet_windows(frame(spark, SHORT, "AC")).count() == 48


def test_coordinates_means_and_curvature_of_a_known_sequence(spark):
    df = frame(spark, SHORT)
    rows = curvature.coords(df).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 49))
    assert (rows[0].x, rows[0].y) == pytest.approx((0.3945, 0.5783), abs=1e-4)
    assert (rows[47].x, rows[47].y) == pytest.approx((21.8975, 14.4425), abs=1e-4)
    rows = curvature.roll_mean(df).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(6, 44))
    assert (rows[0].x_bar, rows[0].y_bar) == pytest.approx((9.3566, -3.7097), abs=1e-4)
    assert (rows[37].x_bar, rows[37].y_bar) == pytest.approx((10.3540, 14.8940), abs=1e-4)
    rows = curvature.curvature(df).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(21, 29))
    assert [r.dist for r in rows] == pytest.approx([19.1012, 17.7494, 16.4319, 15.0647, 13.2434, 11.3172, 10.0444, 9.3122], abs=1e-4)
    assert [r.curv for r in rows] == pytest.approx([6.3674, 5.9168, 5.4776, 5.0218, 4.4147, 3.7726, 3.3483, 3.1042], abs=1e-4)
    assert column(curvature.curvature(df, "active"), "curv") == pytest.approx([6.861739, 6.601186, 6.305849, 5.991799, 5.575239, 5.104788, 4.813392, 4.692560], abs=1e-6)


@pytest.mark.parametrize("size", [64, 500])
def test_chunks_do_not_matter(spark, size):
    df = frame(spark, LONG, LONG[:700])
    for run, names in ((curvature.coords, ("x", "y")), (curvature.roll_mean, ("x_bar", "y_bar")), (curvature.curvature, ("dist",)), (curvature.triplet_params, ("dx", "dy", "twist_sum"))):
        for name in names:
            assert np.allclose(column(run(df, size=size), name), column(run(df), name), atol=1e-7)
    for runsum, name in ((False, "score_simple"), (True, "runsum_active")):
        a, b = (column(symmetry.symmetry(df, runsum=runsum, **o), name) for o in ({"size": size, "spread": 3}, {}))
        assert np.allclose(a, b, rtol=1e-5, atol=1e-6)


def test_variable_twist_and_tilt_match_a_plain_loop(spark):
    rng = np.random.RandomState(3)
    m = matrices.Matrices(matrices.BUILTIN.roll_active, matrices.BUILTIN.roll_simple, rng.uniform(0.5, 0.7, 64), rng.uniform(-1, 1, 64))
    seq, params = LONG[:300], Params()
    t = x = y = 0.0
    xs = []
    for i in range(len(seq) - 2):
        at = matrices.TRIPLETS.index(seq[i : i + 3])
        t += m.twist[at]
        x += m.roll_simple[at] * np.sin(t) + m.tilt[at] * np.sin(t - np.pi / 2)
        y += m.roll_simple[at] * np.cos(t) + m.tilt[at] * np.cos(t - np.pi / 2)
        xs.append(x)
    assert np.allclose(column(curvature.coords(frame(spark, seq), matrices=m, params=params, size=90), "x"), xs, atol=1e-8)


@pytest.mark.parametrize("n, curves, dyads", [(42, 0, 0), (43, 1, 0), (223, 181, 0), (224, 182, 1)])
def test_lengths_at_which_values_begin(spark, n, curves, dyads):
    df = frame(spark, LONG[:n])
    assert curvature.curvature(df).count() == curves
    scores = symmetry.symmetry(df)
    assert scores.count() == dyads
    avg = symmetry.symmetry_avg(scores, df).collect()
    assert len(avg) == (n > 42) and all((r.avg_simple is None) == (dyads == 0) for r in avg)


def plain_scores(k, n, policy="observed"):
    out = {}
    for d in range(101, n - 122):
        s = round(sum(abs(k[d + j] - k[d - j]) for j in range(51)), 9)
        depth = round(k[d - 1] + k[d + 1] - 2 * k[d], 9)
        low = k[d] < k[d - 1] and k[d] < k[d + 1] and depth >= 0.01
        out[d] = (1 / depth if low else 0) / s if s > 0 else 100.0 if low or policy == "literal" else 0.0
    return out


@pytest.mark.parametrize("policy", ["observed", "literal"])
def test_scores_match_a_plain_loop(spark, policy):
    flat = LONG[:200] + "A" * 300 + LONG[200:400]
    half = LONG[:260]
    palindrome = half + half[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for seq in (flat, palindrome):
        df = frame(spark, seq)
        k = {r.pos: round(r.curv, 9) for r in curvature.curvature(df).collect()}
        got = {r.pos: r.score_simple for r in symmetry.symmetry(df, params=Params(flat_policy=policy)).collect()}
        want = plain_scores(k, len(seq), policy)
        assert got.keys() == want.keys()
        assert np.allclose([got[d] for d in sorted(want)], [want[d] for d in sorted(want)], rtol=1e-4)


def test_full_bounds_contain_the_legacy_ones(spark):
    df = frame(spark, LONG[:600])
    full = {r.pos: r.score_simple for r in symmetry.symmetry(df, params=Params(bounds="full")).collect()}
    old = {r.pos: r.score_simple for r in symmetry.symmetry(df).collect()}
    assert min(full) == 71 and max(full) == 600 - 72
    assert all(full[p] == pytest.approx(s) for p, s in old.items())


def test_reverse_complement_mirrors_the_simple_matrix(spark):
    df = frame(spark, LONG[:400])
    back = df.withColumn("seq", bases.reverse_complement(F.col("seq")))
    # Curvature at i looks at bases i - 20 to i + 21, so the mirror of i is n - 2 - i.
    assert np.allclose(column(curvature.curvature(df), "curv")[:-1], column(curvature.curvature(back), "curv")[::-1][1:], atol=1e-9)


def test_greedy_calls_match_a_plain_scan(spark):
    df = frame(spark, *[LONG[i : i + 1500] for i in range(0, 1500, 300)])
    scores = symmetry.symmetry(df)
    found = calls.calls_overlapping(scores, df, "simple")
    kept = {(r.seq_id, r.dyad) for r in calls.calls_greedy(found).collect()}
    want = set()
    rows = found.collect()
    for s in {r.seq_id for r in rows}:
        taken = [0]
        for r in sorted((r for r in rows if r.seq_id == s), key=lambda r: (-round(r.score, 6), r.dyad)):
            if all(abs(r.dyad - p) > 177 for p in taken):
                taken.append(r.dyad)
                want.add((s, r.dyad))
    assert kept == want and want
    assert {(r.seq_id, r.dyad) for r in calls.best_in_reach(found.where("dyad > 177")).collect()} <= want
    first = [r.dyad for r in calls.calls_greedy(found, sentinel=False).collect()]
    assert min(first) <= 177
    assert all(len(r.seq) == 147 for r in calls.with_sequence(found, df).collect())


def plain_greedy(rows, spacing=177, first=(0,)):
    """(seq_id, dyad) of the calls that a greedy choice over all of a sequence keeps."""
    out = set()
    for s in {r[0] for r in rows}:
        taken = list(first)
        for _, _, dyad, score in sorted((r for r in rows if r[0] == s), key=lambda r: (-round(r[3], 6), r[2])):
            if all(abs(dyad - p) > spacing for p in taken):
                taken.append(dyad)
                out.add((s, dyad))
    return out


@pytest.mark.parametrize("block", [300, 1000, 1 << 17])
def test_greedy_calls_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [("random", 0, d, rng.choice([1.0, 2.0, rng.random() * 9])) for d in sorted(rng.sample(range(9000), 3000))]
    # Each call hangs on the one before it, or behind it, to the end of the sequence.
    rows += [("falling", 0, d, 9000.0 - d) for d in range(0, 9000, 50)]
    rows += [("rising", 0, d, 1.0 + d) for d in range(0, 9000, 50)]
    rows += [("level", 0, d, 1.0) for d in range(178, 6000, 7)]
    rows += [("apart", 0, d, 1.0 + d % 3) for d in range(178, 400_000, 30_000)]
    rows += [(None, 0, d, 1.0 + d % 5) for d in range(178, 4000, 60)]
    df = spark.createDataFrame(rows, "seq_id string, piece int, dyad int, score double").repartition(3)
    for sentinel in (True, False):
        got = [(r.seq_id, r.dyad) for r in calls.calls_greedy(df, sentinel=sentinel, block=block, widest=2000 if block < 2000 else block).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_greedy(rows, first=(0,) if sentinel else ())
    twice = df.where("seq_id = 'random'")
    assert sorted(r.dyad for r in calls.calls_greedy(twice.union(twice), block=block).collect()) == sorted(d for s, d in plain_greedy(rows) if s == "random")
    assert calls.calls_greedy(df.limit(0), block=block).count() == 0


def test_legacy_cap_of_the_simple_matrix(spark):
    df = spark.createDataFrame([("a", 0, 200, 150.0, 3.0), ("a", 0, 300, 1.0, 120.0)], "seq_id string, piece int, pos int, score_active double, score_simple double")
    seqs = spark.createDataFrame([("a", 0, LONG[:600])], "seq_id string, piece int, seq string")
    plain = {r.dyad: r.score_capped for r in calls.calls_overlapping(df, seqs, "simple").collect()}
    old = {r.dyad: r.score_capped for r in calls.calls_overlapping(df, seqs, "simple", legacy_bug=True).collect()}
    assert plain == {200: 3.0, 300: 100.0} and old == {200: 100.0}


def test_analysis_shifts_positions_by_offset_and_piece(spark):
    rows = spark.createDataFrame([("chr", 1000, "+", "ACGTNN" + LONG[:400].lower()), ("rev", 0, "-", LONG[:400])], "seq_id string, offset long, strand string, seq string")
    found = analyse(rows)
    got = found.published(found.curvature).where("seq_id = 'chr'").orderBy("position").collect()
    assert got[0].position == 1000 + 6 + 21 and got[0].base == LONG[21]
    back = found.published(found.curvature).where("seq_id = 'rev'").orderBy("position").collect()
    assert back[0].base == LONG[:400][::-1].translate(str.maketrans("ACGT", "TGCA"))[21]
    assert analyse(rows, n_policy="to_a").pieces.count() == 2
    with pytest.raises(ValueError):
        analyse(rows, n_policy="drop")


def test_pieces_of_very_many_runs(spark):
    seq = "".join("ACGT"[: 1 + i % 4] + "N" * (1 + i % 3) for i in range(1500))
    rows = frame(spark, seq, "NN", "", "N", "A").collect()
    assert len(rows) == 1501 and all(seq[r.start - 1 : r.end] == r.seq for r in rows[:-1])
    assert [r.piece for r in rows[:-1]] == list(range(1500)) and (rows[-1].start, rows[-1].end) == (1, 1)


def test_sums_over_a_core():
    rng = np.random.RandomState(4)
    row = np.repeat([0, 1, 2], [300, 1, 90])
    values = rng.choice([0.0, 0.0, 1.5, 100.0], len(row))
    want = [values[max(0, i - 73) : i + 74][row[max(0, i - 73) : i + 74] == row[i]].sum() for i in range(len(row))]
    assert np.allclose(symmetry.core_sums(values, row), want)
    assert len(symmetry.core_sums(np.zeros(0), np.zeros(0, dtype=int))) == 0


def test_chunks_are_cut_in_linear_time(spark):
    import time

    def took(n):
        df = spark.createDataFrame([("s", 0, "ACGTTGCA" * (n // 8))], "seq_id string, piece int, seq string").cache()
        df.count()
        t = time.time()
        assert curvature.chunks(df, 30, 30).selectExpr("sum(length(body))").first()[0] >= n
        return time.time() - t

    took(1 << 20)
    assert took(1 << 25) < 8 * max(took(1 << 22), took(1 << 22), 0.5)
