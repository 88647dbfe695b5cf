"""Tracks take little disk: text is compressed, and bigWig is made without sorting rows."""

import random

import pytest

from bendscape.plans.analysis import analyse
from bendscape.sources import bigwig, sinks

RNG = random.Random(5)
SEQS = [(k, 10 * k, "+", "".join(RNG.choice("ACGT") for _ in range(n)) + "N" + "ACGGT" * 20) for k, n in ((10, 90), (9, 300), (2, 41), (11, 160))]


@pytest.mark.parametrize("write", [sinks.write_curvature, sinks.write_symmetry, sinks.write_runsums, sinks.write_bedgraph])
def test_compressed_parts_hold_the_same_rows(spark, tmp_path, write):
    found = analyse(spark.createDataFrame(SEQS, "seq_id long, offset long, strand string, seq string"))
    write(found, str(tmp_path / "plain"))
    write(found, str(tmp_path / "packed"), compression="gzip")
    read = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / name)).collect())
    assert read("packed") == read("plain") and any(tmp_path.glob("packed/*.gz"))


def test_bigwig_of_an_analysis_sorts_no_rows(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(SEQS, "seq_id long, offset long, strand string, seq string")
    found = analyse(rows)
    sinks.write_bigwig(found, rows, str(tmp_path / "sorted.bw"), track=found.curvature)
    monkeypatch.setattr(bigwig, "write_bigwig", None)
    sinks.write_bigwig(found, rows, str(tmp_path / "made.bw"))
    read = lambda name: sorted(map(tuple, bigwig.read_bigwig(spark, str(tmp_path / name)).collect()))
    assert read("made.bw") == read("sorted.bw") and len(read("made.bw")) > 400
    with pytest.raises(Exception, match="outside of sequence"):
        sinks.write_bigwig(found, rows.selectExpr("seq_id", "50L as size"), str(tmp_path / "short.bw"))
