"""What queries put into the shared folder and into shuffles is no more than they need."""

import gzip
import random
from pathlib import Path

import pytest

from bendscape.operators import calls
from bendscape.plans import registry
from bendscape.sources import bigwig, fasta, shared, store

RNG = random.Random(23)
TEXTS = [(k, "\n".join("".join(RNG.choice("ACGT") for _ in range(n)) for n in RNG.choices((30, 250, 700), k=3))) for k in range(30)] + [(30, ""), (31, None)]


@pytest.fixture
def documents(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_of_scores_only_those_of_calls_are_kept(spark, documents, monkeypatch):
    kept = []
    monkeypatch.setattr(shared, "cut", None)
    monkeypatch.setattr(shared, "new_folder", lambda *a, _old=shared.new_folder: (kept.append(_old(*a)), kept[-1])[1])
    got = registry._dyads(spark, documents)
    scores = registry._scores(spark, documents)
    for dyads, roll in zip(got, ("active", "simple"), strict=True):
        want = calls.calls_overlapping(scores, scores, roll).select("seq_id", "piece", "dyad").collect()
        assert sorted(want) == sorted(dyads.select("seq_id", "piece", "dyad").collect()) and len(want) > 20
    assert len(kept) == 1 and spark.read.parquet(kept[0]).count() == scores.where("score_active > 0 or score_simple > 0").count() < scores.count() / 2


@pytest.mark.parametrize("name, column", [("sink_curvature", -1), ("sink_bedgraph", -1)])
def test_tracks_of_queries_have_the_digits_that_are_shown(spark, documents, monkeypatch, name, column):
    kept = []
    monkeypatch.setattr(shared, "new_folder", lambda *a, _old=shared.new_folder: (kept.append(_old(*a)), kept[-1])[1])
    got = sorted((r.seq_id, r.position, r.curv_simple) for r in registry.QUERIES[name](spark, documents).collect())
    lines = [x.split("\t") for p in sorted(Path(kept[0].removeprefix("file:")).glob("part-*.gz")) for x in gzip.open(p, "rt").read().splitlines()]
    assert sorted((int(x[0]), int(x[1]), float(x[column])) for x in lines) == got and max(len(x[column].split("E")[0]) for x in lines) <= 10
    pieces = registry.all_pieces(spark, documents).select("seq_id", "piece", "start")
    curved = registry.QUERIES["curvature_dual"](spark, documents).join(pieces, ["seq_id", "piece"]).selectExpr("seq_id", "pos + start - 1 + seq_id as position", "curv_simple")
    assert sorted(map(tuple, curved.collect())) == got and len(got) > 1000


@pytest.mark.parametrize("block", [1, 7, 1 << 22])
def test_parts_of_bigwig_files_are_moved_not_copied(spark, tmp_path, monkeypatch, block):
    bodies = [bytes(RNG.randrange(256) for _ in range(n)) for n in (20, 1, 9)]
    target = tmp_path / "whole"
    target.write_bytes(b"")
    for i, body in enumerate(bodies):
        source = tmp_path / f"part{i}"
        source.write_bytes(body)
        sync, lengths = bigwig.os.fsync, []

        def stopped(n, source=source):
            lengths.append(source.stat().st_size)
            sync(n)
            if len(lengths) == 3:
                raise OSError("stopped")

        monkeypatch.setattr(bigwig.os, "fsync", stopped)
        try:
            bigwig._move(str(source), str(target), 5 + sum(map(len, bodies[:i])), block)
        except OSError:
            assert source.stat().st_size == len(body) - 2 * block
        monkeypatch.undo()
        bigwig._move(str(source), str(target), 5 + sum(map(len, bodies[:i])), block)
        assert source.stat().st_size == 0 and lengths[0] == len(body)
    assert target.read_bytes() == bytes(5) + b"".join(bodies)
    source.write_bytes(b"abc")
    with pytest.raises(OSError, match="not whole"):
        bigwig._place(spark, [(str(source), str(target), 0, 4)], 1)
    bigwig._place(spark, [(str(source), str(target), 0, 3)], 1)
    assert source.stat().st_size == 0 and target.read_bytes()[:6] == b"abc\0\0" + bodies[0][:1]


def test_blocks_send_their_neighbours_only_ends(spark, monkeypatch):
    seqs = {1: "".join(RNG.choices("ACGTN", (9, 9, 9, 9, 1), k=1000)), 2: "ACGTTGCA" * 32 + "NN" + "GATTACA" * 3, 3: "A" * 255 + "C", 4: "ACG", 5: "N" * 300}
    parts = spark.createDataFrame([(k, 0, bytearray(s.encode())) for k, s in seqs.items()], "seq_id long, at long, bases binary")
    kept = store.pack(parts, 256).kept()
    want = []
    for k, s in seqs.items():
        at = piece = 0
        for run in s.replace("N", " ").split(" "):
            if run:
                for b in range(at // 256, (at + len(run) - 1) // 256 + 1):
                    low, high = max(at, b * 256 - 13), min(at + len(run), b * 256 + 256 + 21)
                    want.append((k, piece, at, len(run), b * 256 - at, low - at, s[low:high]))
                piece += 1
            at += len(run) + 1
    for spread in (None, 3):
        rows = kept.as_chunks(13, 21, 256, spread, False)
        assert sorted((*r[:6], r.body.decode()) for r in rows.select("seq_id", "piece", "shift", "n", "a", "from", "body").collect()) == sorted(want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition")  # bits are dealt, not the bases made of them
    sent, frame = [], type(kept.blocks)
    monkeypatch.setattr(frame, "groupBy", lambda self, *c, _old=frame.groupBy: (sent.append(self), _old(self, *c))[1])
    kept.as_chunks(13, 21, 256, 3, False)
    (ends,) = (x for x in sent if "_e" in x.columns)
    assert all(len(r._e.bits) <= (64 if r._e.side == 1 else 6) for r in ends.collect())


def test_fasta_goes_once_blocks_are_kept(spark, documents, monkeypatch):
    kept = []
    monkeypatch.setattr(fasta, "new_folder", lambda *a, _old=fasta.new_folder: (kept.append(_old(*a)), kept[-1])[1])
    got, want = (registry.QUERIES[name](spark, documents) for name in ("stored_curvature", "curvature_dual"))
    assert len(kept) == 1 and not Path(kept[0].removeprefix("file:")).exists()
    key = lambda r: (r.seq_id, r.piece, r.pos)
    assert [(*key(r), r.curv_simple) for r in sorted(got.collect(), key=key)] == [(*key(r), pytest.approx(r.curv_simple, abs=2e-6)) for r in sorted(want.collect(), key=key)]
