"""Records that can't be used, counts as they go by, records that arrive in parts, and table functions of SQL."""

import random
import time

import numpy as np
import pytest

from bendscape import cli
from bendscape.functions.matrices import BUILTIN
from bendscape.operators import curvature, pieces, symmetry
from bendscape.params import DEFAULT
from bendscape.plans import functions
from bendscape.sources import checked
from bendscape.streaming import records

SCHEMA = "seq_id string, offset long, strand string, seq string, problem string"
ROWS = [
    ("fine", 0, "+", "ACGT\nnRy", None), ("odd", 5, "-", "AC GX T-", None), (None, 0, "+", "A", None), ("", 0, "+", "A", None), ("none", 0, "+", None, None),
    ("strand", 0, "*", "A", None), ("nostrand", 0, None, "A", None), ("offset", -1, "+", "A", None), ("said", 0, "+", "A", "no # at the end"), ("empty", 0, "+", "", None),
]


def test_quarantine(spark):
    found = checked.checked(spark.createDataFrame(ROWS, SCHEMA))
    assert {r.seq_id: r.seq for r in found.good.collect()} == {"fine": "ACGT\nnRy", "empty": ""}
    assert found.counts() == {"records": 10, "bad": 8, "bases": 7}
    assert sorted((r.seq_id or "", r.problem, r.place) for r in found.bad.collect()) == sorted([
        ("odd", "no base: X", 4), ("", "no name", None), ("", "no name", None), ("none", "no sequence", None), ("strand", "strand is neither + nor -", None),
        ("nostrand", "strand is neither + nor -", None), ("offset", "no offset", None), ("said", "no # at the end", None),
    ], key=lambda r: (r[0], r[1]))
    none = checked.checked(spark.createDataFrame([], SCHEMA))
    assert none.good.collect() == [] and none.counts() == {"records": 0, "bad": 0, "bases": 0}


def test_strict(spark):
    with pytest.raises(Exception, match="sequence odd, place 4: no base: X"):
        checked.checked(spark.createDataFrame(ROWS[:2], SCHEMA), "strict").good.collect()
    assert checked.checked(spark.createDataFrame(ROWS[:1], SCHEMA), "strict").good.count() == 1
    with pytest.raises(ValueError, match="mode"):
        checked.checked(spark.createDataFrame(ROWS, SCHEMA), "loose")
    # The kernels name the sequence too.
    bad = spark.createDataFrame([("chr7", 3, "ACGT" * 20 + "R" + "ACGT" * 20)], "seq_id string, piece int, seq string")
    with pytest.raises(Exception, match="base 80 of piece 3 of sequence chr7"):
        curvature.curvature(bad).collect()


def test_runtime():
    with checked.Runtime() as t:
        time.sleep(1.1)
    assert t.seconds == 1


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "a.fa"
    path.write_text(">good\n" + "ACGTTGCA" * 40 + "\n>bad\nAC!T\n")
    assert cli.main([str(path), str(tmp_path / "out"), "--bad", str(tmp_path / "bad")]) == 0
    said = capsys.readouterr().err
    assert "2 records, 1 of them bad, 320 bases" in said and "seconds" in said
    assert [(r.seq_id, r.place) for r in spark.read.json(str(tmp_path / "bad")).collect()] == [("bad", 3)]
    with pytest.raises(Exception, match="sequence bad, place 3"):
        cli.main([str(path), str(tmp_path / "out2"), "--strict"])


def _whole(seq):
    """Curvature rows of a sequence in plain Python state: one part."""
    return records.Progress(DEFAULT, BUILTIN).take(0, seq.encode())


def _sequence(n, seed=3, letters="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_progress():
    """Parts of any size, in any order, twice, and cut inside of unknown bases."""
    rng = random.Random(5)
    seq = _sequence(300) + "NNN" + _sequence(41, 4) + "n" + _sequence(200, 5).lower() + "N" + _sequence(7) + "NN" + _sequence(120, 6)
    want = _whole(seq)
    assert len({p for p, *_ in want}) == 3 and len(want) == 258 + 158 + 78
    for _ in range(20):
        cuts = sorted({0, len(seq), *(rng.randint(0, len(seq)) for _ in range(rng.choice([1, 5, 200])))})
        parts = [(a, seq[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        parts += parts[:2]
        if rng.random() < 0.5:
            rng.shuffle(parts)
        state, got = None, []
        for at, bases in parts:
            p = records.Progress(DEFAULT, BUILTIN, state)
            got += p.take(at, bases)
            state = p.state()
            assert len(p.tail) <= 2 * DEFAULT.reach + 4
        assert [r[:2] for r in got] == [r[:2] for r in want] and not state[4]
        assert np.allclose([r[2:] for r in got], [r[2:] for r in want])


def test_a_record_in_ten_files(spark, tmp_path):
    """The curvature of a record that arrives over ten micro-batches is that of the whole."""
    seqs = {"chr": _sequence(900) + "NN" + _sequence(300, 8), "other": _sequence(200, 9)}
    for i in range(10):
        rows = []
        for name, seq in seqs.items():
            step = -(-len(seq) // 10)
            rows.append((name, i * step, bytearray(seq[i * step : (i + 1) * step].encode())))
        spark.createDataFrame(rows, "seq_id string, at long, bases binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    records.keep_state(spark)
    stream = spark.readStream.schema("seq_id string, at long, bases binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = records.curvature_of_parts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert len(run.recentProgress) >= 10
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    table = pieces.split_by_n(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"))
    want = sorted(map(tuple, curvature.curvature_dual(table).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want])


def test_table_functions(spark):
    """Ids keep their types; columns may come in any order."""
    functions.register(spark)
    table = pieces.split_by_n(spark.createDataFrame([(7, _sequence(400) + "N" + _sequence(90, 2)), (8, _sequence(50, 3))], "seq_id long, seq string"))
    table.select("seq", "piece", "seq_id").createOrReplaceTempView("some_pieces")
    place = lambda r: r[:3]
    for name, want in (("curvature", curvature.curvature_dual(table)), ("symmetry", symmetry.symmetry(table).select("seq_id", "piece", "pos", "score_active", "score_simple"))):
        for form in ("TABLE(some_pieces)", "TABLE(some_pieces) PARTITION BY seq_id"):
            got = spark.sql(f"SELECT * FROM {name}({form})")
            assert got.schema["seq_id"].dataType.typeName() == "long" and got.columns == want.columns
            a, b = (sorted(map(tuple, df.collect()), key=place) for df in (got, want))
            assert list(map(place, a)) == list(map(place, b)) and np.allclose([r[3:] for r in a], [r[3:] for r in b]) and a
    with pytest.raises(Exception, match="no column piece"):
        spark.sql("SELECT * FROM curvature(TABLE(SELECT seq_id, seq FROM some_pieces))")
