"""FASTA by ranges of bytes, and sequences in blocks, against whole files and whole sequences."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bendscape.operators import curvature, pieces, symmetry
from bendscape.sources import fasta, fasta_ranges, store

TEXT = (
    ">one  the first\r\nACGTN\r\nacgt\r\n>two\n>three none at all \nA\n\nCC GT\n>" + "long" * 30 + " name\nACGTTGCA" * 1 + "\n" + "GATTACA" * 40 + "\n>last\n" + "\n".join("ACGT" * 3 for _ in range(20))
)


def plain(text):
    out = []
    for line in text.split("\n"):
        if line.startswith(">"):
            out.append([line[1:].rstrip("\r"), ""])
        elif out:
            out[-1][1] += "".join(line.split())
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 64, 1000])
def test_scan(size):
    """Ranges that begin anywhere, in steps of any size, give together what the whole text does."""
    data = TEXT.encode()
    got, record, in_head = [], -1, False
    for lo in range(0, len(data), size):
        for p in fasta_ranges.scan(io.BytesIO(data), lo, min(lo + size, len(data)), step=max(1, size // 2)):
            if not isinstance(p, fasta_ranges.Part):
                first, ends = len(got) - 1, p
            elif p.open and in_head:
                continue
            elif p.record and not p.bases:
                got.append([p.head, ""])
            else:
                got[-1][1] += p.bases.decode()
        in_head = in_head if ends is None else ends
    assert got == plain(TEXT) and first >= record


@pytest.mark.parametrize("size", [1 << 20, 37])
def test_read_parts(spark, tmp_path, size):
    folder = tmp_path / "fa"
    folder.mkdir()
    (folder / "a.fa").write_bytes(TEXT.encode())
    (folder / "b.fa").write_bytes(b">other\n" + b"ACGT" * 200)
    (folder / "_SUCCESS").write_bytes(b"")
    parts = fasta_ranges.read_parts(spark, str(folder), size)
    got = fasta_ranges.whole(parts).collect()
    want = fasta.read_fasta(spark, str(folder)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(got) == 6
    if size == 37:
        assert parts.where("seq_id = 'other' and octet_length(bases) > 0").count() > 15  # one record, many ranges
    for bad in ("absent.fa",):
        with pytest.raises(Exception, match="absent"):
            fasta_ranges.read_parts(spark, str(tmp_path / bad)).collect()
    (tmp_path / "junk.fa").write_text("no header\nACGT\n>x\nAC\n")
    assert [(r.seq_id, r.seq) for r in fasta_ranges.whole(fasta_ranges.read_parts(spark, str(tmp_path / "junk.fa"), 4)).collect()] == [("x", "AC")]


def test_bits():
    for text in (b"", b"A", b"ACGTN", b"acgtrykm" * 9 + b"A"):
        want = "".join(c if c in "ACGT" else "N" for c in text.decode().upper())
        assert store.decode(len(text), *store.encode(text)).tobytes().decode() == want
    assert len(store.encode(b"ACGT" * 100)[0]) == 100 and store.encode(b"ACGT")[1] is None


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(4)
    dna = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    rows = {"long": dna(3000), "gaps": dna(700) + "N" * 900 + dna(300) + "N" + dna(511) + "nnn" + dna(1200), "n": "N" * 600, "short": dna(5), "mixed": dna(900, "ACGTACGTACGTN"), "edge": dna(256) + "N" + dna(255) + dna(256)}
    return rows


def test_store(spark, sequences):
    """Blocks of 256 bases: pieces, slices, curvature, scores, sums and averages as from whole sequences."""
    rng = random.Random(9)
    parts = []
    for name, seq in sequences.items():
        at = 0
        while at < len(seq):
            n = rng.choice([1, 7, 100, 256, 700])
            parts.append((name, at, seq[at : at + n].encode()))
            at += n
    rng.shuffle(parts)
    kept = store.pack(spark.createDataFrame(parts, "seq_id string, at long, bases binary"), 256)
    assert {(r.seq_id, r.block): r.seq for r in kept.text().collect()} == {(k, i // 256): s.upper()[i : i + 256] for k, s in sequences.items() for i in range(0, len(s), 256)}
    rows = spark.createDataFrame([(k, s.upper()) for k, s in sequences.items()], "seq_id string, seq string")
    whole = pieces.split_by_n(rows)
    take = lambda df, *names: sorted(map(tuple, df.select(*names).collect()))
    assert take(kept.pieces(), "seq_id", "piece", "start", "end") == take(whole, "seq_id", "piece", "start", "end")
    assert take(kept.slices(kept.pieces()), "seq_id", "piece", "start", "end", "seq") == take(whole, "seq_id", "piece", "start", "end", "seq")
    odd = spark.createDataFrame([("edge", -3, 5), ("edge", 250, 9999), ("short", 2, 2), ("absent", 1, 4)], "seq_id string, start long, end long")
    assert take(kept.slices(odd), "seq_id", "seq") == [("edge", sequences["edge"][249:]), ("edge", sequences["edge"][:5]), ("short", sequences["short"][1])]
    shift = {(r.seq_id, r.piece): r.start - 1 for r in whole.collect()}
    for make, names in (
        (lambda p, **o: curvature.curvature_dual(p, **o), ("curv_active", "curv_simple")),
        (lambda p, **o: symmetry.symmetry(p, **o), ("sym_sum_active", "score_simple")),
        (lambda p, **o: symmetry.symmetry(p, runsum=True, **o), ("runsum_active",)),
    ):
        got, want = make(kept, size=256, spread=3).collect(), make(whole).collect()
        place = lambda r: (r.seq_id, r.piece, r.pos)
        assert all(shift[r.seq_id, r.piece] == r.shift for r in got) and len(want) > 500
        got, want = sorted(got, key=place), sorted(want, key=place)
        assert list(map(place, got)) == list(map(place, want))
        for name in names:
            assert np.allclose([r[name] for r in got], [r[name] for r in want], rtol=1e-5, atol=1e-6)
    assert take(symmetry.symmetry_averages(kept, size=256), "seq_id", "piece", "n") == take(symmetry.symmetry_averages(whole), "seq_id", "piece", "n")
    with pytest.raises(ValueError, match="blocks of 256"):
        curvature.curvature(kept)


def test_one_long_record_by_many_tasks(spark, tmp_path):
    """Two million bases in one line: every range reads its own, and blocks are made by all tasks."""
    letters = np.frombuffer(b"ACGT", dtype=np.uint8)[np.random.RandomState(3).randint(0, 4, 2_000_000)].tobytes()
    (tmp_path / "chr.fa").write_bytes(b">chr\n" + letters)
    parts = fasta_ranges.read_parts(spark, str(tmp_path / "chr.fa"), 1 << 17)
    assert parts.rdd.getNumPartitions() == 16
    kept = store.pack(parts)
    assert kept.blocks.agg(F.sum("n"), F.max(F.octet_length("bits"))).first() == (2_000_000, 8192)
    wanted = [("chr", 1, 50), ("chr", 32_700, 32_800), ("chr", 1_999_990, 2_000_000), ("chr", 100_000, 300_000)]
    got = kept.slices(spark.createDataFrame(wanted, "seq_id string, start long, end long")).collect()
    assert {(r.start, r.end): r.seq for r in got} == {(s, e): letters[s - 1 : e].decode() for _, s, e in wanted}


def test_command_line_in_blocks(spark, tmp_path):
    """All outputs of sequences in blocks are those of sequences in rows."""
    from bendscape import cli

    rng = random.Random(12)
    text = "".join(f">{name}\n" + "\n".join(seq[i : i + 50] for i in range(0, len(seq), 50)) + "\n" for name, seq in (
        ("a", "".join(rng.choice("ACGT") for _ in range(33_500)) + "NN" + "".join(rng.choice("ACGT") for _ in range(700))), ("b", "ACGTTGCAAT" * 60), ("c", "NNNN"),
    ))
    (tmp_path / "a.fa").write_text(text)
    for flags, out in ((["--blocks", "--bigwig", str(tmp_path / "a.bw")], "x"), ([], "y")):
        assert cli.main([str(tmp_path / "a.fa"), str(tmp_path / out), *flags]) == 0
    lines = lambda folder: [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]
    names = sorted(p.name for p in (tmp_path / "x").iterdir())
    assert len(names) == 9 and names == sorted(p.name for p in (tmp_path / "y").iterdir())
    for name in names:
        a, b = (lines(tmp_path / out / name) for out in "xy")
        assert len(a) == len(b) and (a or "fin" in name)
        for x, y in zip(a, b, strict=True):
            for v, w in zip(x.split("\t"), y.split("\t"), strict=True):
                assert v == w or float(v) == pytest.approx(float(w), rel=1e-5, abs=1e-6), (name, x, y)


def test_coordinates_from_one_and_from_many_tasks(spark):
    """The scan over chunks gives the same wherever a piece is cut and however it is dealt."""
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(60_000))
    rows = pieces.split_by_n(spark.createDataFrame([("s", seq)], "seq_id string, seq string"))
    one = curvature.coords(rows, spread=1, size=1 << 16).orderBy("pos").select("x", "y").collect()
    many = curvature.coords(rows, spread=64, size=1000)
    assert many.rdd.getNumPartitions() == 64
    many = many.orderBy("pos").select("x", "y").collect()
    assert len(one) == 59_998 and np.allclose(one, many, rtol=0, atol=1e-9)


def test_blocks_are_decoded_few_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    parts = list(store._few([batch, batch.slice(0, 0), batch.slice(5, 3)]))
    assert max(map(len, parts)) <= store.FEW and [x for p in parts for x in p.column(0).to_pylist()] == [*range(1000), 5, 6, 7]
