import json
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from bendscape import cli
from bendscape.functions import bases, matrices
from bendscape.operators import pieces
from bendscape.params import Params
from bendscape.plans.analysis import analyse
from bendscape.sources import fasta, sinks
from bendscape.streaming import tracks


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_records_and_pieces(spark, tmp_path):
    path = put(tmp_path / "a.fa", ">sq0 first one\nAC\nGT\r\n>sq1\nN\n>empty\n\n>chr42\nATGCATGCNNNNATGCA\n")
    rows = {r.seq_id: r for r in fasta.read_fasta(spark, path).collect()}
    assert {k: r.seq for k, r in rows.items()} == {"sq0": "ACGT", "sq1": "N", "empty": "", "chr42": "ATGCATGCNNNNATGCA"}
    assert rows["sq0"].description == "first one" and rows["sq1"].description is None
    cut = pieces.label(pieces.split_by_n(fasta.read_fasta(spark, path))).orderBy("seq_id", "piece").collect()
    assert [(r.seq_id, r.piece, r.start, r.end, r.seq) for r in cut] == [("chr42", 0, 1, 8, "ATGCATGC"), ("chr42", 1, 13, 17, "ATGCA"), ("sq0", 0, 1, 4, "ACGT")]
    assert cut[1].description == "chr42 13-17"


def test_legacy_fasta(spark, tmp_path):
    path = put(tmp_path / "a.fa", ">a:b:100:-\nac\r\ngn\n#\njunk\n>plain\nACGT\nTT\n#\n>open\nACGT\n>x:1\nA\n#\n>h#\nA\n#\n")
    rows = {r.seq_id: r for r in fasta.read_fasta_legacy(spark, path).collect()}
    assert (rows["a:b"].offset, rows["a:b"].strand, rows["a:b"].seq, rows["a:b"].problem) == (100, "-", "acgn", None)
    assert (rows["plain"].offset, rows["plain"].strand, rows["plain"].seq) == (0, "+", "ACGTTT")
    assert rows["open"].problem and rows["x:1"].problem and rows["h#"].problem


def test_bases(spark):
    row = spark.createDataFrame([("acg tnXß\n", "AGCTN")], "a string, b string").select(
        bases.normalize_seq(F.col("a")).alias("n"), bases.reverse_complement(F.col("b")).alias("r"), bases.encode_bases(F.col("b")).alias("e")
    ).first()
    assert row.n == "ACGTAAA" and row.r == "NAGCT" and row.e == "0231N"


def test_matrix_values_and_errors(spark, tmp_path):
    assert matrices.lookup("TGA", matrices.BUILTIN.roll_active) == 7.7
    assert matrices.lookup("CCA", matrices.BUILTIN.roll_simple) == 0.7
    assert matrices.lookup("AAA", matrices.BUILTIN.twist) == 0.598647428
    for bad in ("AA", "AAAA", "AAN", "aaa"):
        with pytest.raises(matrices.MatrixLookupError, match="Error: triplet must be of length 3"):
            matrices.lookup(bad, matrices.BUILTIN.twist)
    df = spark.createDataFrame([("TGA",), ("AAN",), ("AA",)], "t string")
    assert [r.v for r in df.select(matrices.matrix_lookup(F.col("t"), matrices.BUILTIN.roll_active).alias("v")).collect()] == [7.7, None, None]
    with pytest.raises(Exception, match="triplet must be of length 3"):
        df.select(matrices.matrix_lookup(F.col("t"), matrices.BUILTIN.roll_active, strict=True)).collect()
    assert matrices.matrix_table(spark).count() == 64
    found = matrices.read(put(tmp_path / "m.json", json.dumps({"twist": 0.6, "roll_simple": {"AAA": 9}})))
    assert found.constant_twist == 0.6 and found.roll_simple[0] == 9 and found.roll_simple[1] == 0
    pytest.importorskip("yaml")
    found = matrices.read(put(tmp_path / "m.yaml", "twist:\n  AAT: 0.7\nroll_active:\n  TGA: 1.5\n  CCC: 2\ntilt: 0.1\n"))
    assert found.constant_twist is None and list(found.twist[:3]) == [0.598647428, 0.7, 0.598647428]
    assert matrices.lookup("TGA", found.roll_active) == 1.5 and matrices.lookup("CCC", found.roll_active) == 2 and matrices.lookup("AAA", found.roll_active) == 0.0633
    assert set(found.tilt) == {0.1} and (found.roll_simple == matrices.BUILTIN.roll_simple).all()
    with pytest.raises(matrices.MatrixLookupError):
        matrices.read(put(tmp_path / "bad.yaml", "twist:\n  AAN: 1\n"))
    with pytest.raises(ValueError, match="keys"):
        matrices.read(put(tmp_path / "worse.yaml", "turn: 1\n"))


def test_all_cells_of_the_matrices():
    """Every cell against the list of values in FIXTURES.md."""
    text = (pathlib.Path(__file__).parent.parent / "FIXTURES.md").read_text()
    for name in ("roll_active", "roll_simple"):
        block = re.search(rf"^{name}\n(.*?)^(?:roll_|```)", text, re.M | re.S).group(1)
        cells = {pair + last: float(v) for pair, row in re.findall(r"([ATGC]{2})\*:(\S+)", block) for last, v in zip("ATGC", row.split(","), strict=True)}
        assert len(cells) == 64
        assert cells == {t: matrices.lookup(t, matrices.BUILTIN.roll(name[5:])) for t in cells}


def test_parameters():
    with pytest.raises(ValueError):
        Params(curve_step=0)
    for scale in (1.1, -1, float("nan"), "abc"):
        with pytest.raises(ValueError):
            Params(curve_scale=scale)
    for scale in (0, 0.33, 1):
        Params(curve_scale=scale)
    args = cli.parser().parse_args("input.fasta output --verbose --matrices matrices.yaml --curve-step 20".split())
    assert args.verbose and args.matrices == "matrices.yaml" and args.curve_step == 20
    for bad in ("--matrices", "--curve-step 0", "--curve-scale 1.1", "--curve-scale -1", "--curve-scale abc"):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["in", "out", *bad.split()])


def lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_outputs(spark, tmp_path):
    import numpy as np

    seq = "".join(np.random.RandomState(2).choice(list("ACGT"), 900))
    path = put(tmp_path / "a.fa", f">t:10:+\n{seq}\n#\n")
    rows = fasta.read_fasta_legacy(spark, path).where("problem is null")
    found = analyse(rows, n_policy="to_a")
    sinks.write_all(found, rows, str(tmp_path / "out"))
    curve = [x.split("\t") for x in lines(tmp_path / "out/out_curv.dat")]
    assert len(curve) == 900 - 42 and curve[0][:3] == ["t", "31", seq[21]]
    assert lines(tmp_path / "out/out_symmetry_aggr.dat")[0].startswith("t:10:+:879\t")
    assert len(lines(tmp_path / "out/out_symmetry.dat")) == 900 - 223
    assert len(lines(tmp_path / "out/out_symmetry_avr.dat")) == 900 - 122
    for name, final in (("init", False), ("fin", True)):
        gff = [x.split("\t") for x in lines(tmp_path / f"out/out_{name}_calls_dnase.gff")]
        assert gff and all(len(g) == 9 and g[1:3] == ["evidence", "act_nucleosome"] and int(g[4]) - int(g[3]) == 146 and g[8] == seq[int(g[3]) - 10 : int(g[4]) - 9] for g in gff)
        dyads = [int(g[3]) + 73 for g in gff]
        assert dyads == sorted(dyads) and (not final or min(np.diff(dyads), default=999) > 177)
    sinks.write_bedgraph(found, str(tmp_path / "out/b"))
    assert lines(tmp_path / "out/b")[0].split("\t")[:3] == ["t", "31", "32"]


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.fa", ">s\n" + "ACGTTGCA" * 40 + "n" + "GATTACA" * 20 + "\n")
    rows = tracks.curvature_stream(tracks.fasta_stream(spark, str(tmp_path / "in")))
    tracks.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.piece, r.pos): r.curv_simple for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.piece, r.pos): r.curv_simple for r in tracks.curvature_stream(fasta.read_fasta(spark, str(tmp_path / "in"))).collect()}
    assert got == want and want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq_id string, offset long, strand string, seq string")
    found = analyse(none)
    for df in (found.pieces, found.curvature, found.scores, found.runsums, found.averages, found.final["active"]):
        assert df.count() == 0
