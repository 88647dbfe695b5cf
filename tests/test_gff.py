"""Files of overlapping calls are made from the bases in one pass, in order."""

import random

import pytest

from bendscape.operators import calls, symmetry
from bendscape.params import Params
from bendscape.plans.analysis import analyse
from bendscape.sources import sinks


def _rows(spark):
    rng = random.Random(11)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [(i, 100 * i, rng.choice("+-"), bases(rng.randint(0, 700)) + rng.choice(["", "N"]) + bases(rng.randint(0, 700))) for i in range(40)]
    return spark.createDataFrame([*seqs, (90, 5, "+", bases(3000)), (91, 0, "+", ""), (92, 0, "+", "A" * 600)], "seq_id long, offset long, strand string, seq string").repartition(3)


@pytest.mark.parametrize("bounds, bug, size", [("legacy", False, 1 << 15), ("legacy", True, 256), ("full", False, 100), ("full", True, 1 << 15)])
def test_calls_from_bases_are_those_of_scores(spark, bounds, bug, size):
    params = Params(bounds=bounds)
    pieces = analyse(_rows(spark)).pieces
    scores = symmetry.symmetry(pieces, params=params)
    for roll in ("active", "simple"):
        old = calls.with_sequence(calls.calls_overlapping(scores, pieces, roll, params, bug), pieces)
        new = calls.called(pieces, roll, params, legacy_bug=bug, cores=True, size=size)
        assert new.columns == old.columns and [t for _, t in new.dtypes] == [t for _, t in old.dtypes]
        key = lambda r: (r.seq_id, r.piece, r.dyad)
        got, want = sorted(new.collect(), key=key), sorted(old.collect(), key=key)
        assert len(want) > 50 and [key(r) + (r.start, r.end, r.shift, r.seq) for r in got] == [key(r) + (r.start, r.end, r.shift, r.seq) for r in want]
        assert [(r.score, r.score_capped) for r in got] == [pytest.approx((r.score, r.score_capped), rel=1e-9) for r in want]


def test_overlapping_calls_take_one_shuffle_of_bases(spark, tmp_path, monkeypatch):
    found = analyse(_rows(spark))
    seen = []
    monkeypatch.setattr(calls, "gff_lines", lambda rows, *a, _old=calls.gff_lines, **k: (seen.append(rows), _old(rows, *a, **k))[1])
    sinks.write_gff(found, str(tmp_path / "one"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and plan.count("MapInArrow") == 1
    monkeypatch.undo()
    sinks.write_gff(found.stored(), str(tmp_path / "two"))
    one, two = ([x for p in sorted((tmp_path / name).glob("part-*")) for x in p.read_text().splitlines()] for name in ("one", "two"))
    assert one and one == two
