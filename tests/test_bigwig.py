"""bigWig files against a plain reader of the published format."""

import random
import struct
import zlib

import pytest

from bendscape.plans.analysis import analyse
from bendscape.sources import bigwig, sinks


class Plain:
    """Reads a bigWig file on its own: header, tree of names, index, sections and zoom levels."""

    def __init__(self, path):
        self.d = open(path, "rb").read()
        g = struct.unpack_from
        assert g("<I", self.d)[0] == g("<I", self.d, len(self.d) - 4)[0] == 0x888FFC26
        _, self.version, zooms, tree, self.data, self.index, _, _, _, summary, self.buffer, _ = g("<IHHQQQHHQQIQ", self.d)
        self.summary = g("<Qdddd", self.d, summary)
        self.zooms = [g("<IIQQ", self.d, 64 + 24 * i) for i in range(zooms)]
        magic, _, key, value, n, _ = g("<IIIIQQ", self.d, tree)
        assert magic == 0x78CA8C91 and value == 8
        self.chroms = {}
        self.names(tree + 32, key)
        assert len(self.chroms) == n

    def names(self, at, key):
        leaf, _, n = struct.unpack_from("<BBH", self.d, at)
        last = b""
        for i in range(n):
            name = self.d[at + 4 + i * (key + 8) :][:key]
            assert last < name or not i
            last = name
            if leaf:
                number, size = struct.unpack_from("<II", self.d, at + 4 + i * (key + 8) + key)
                self.chroms[number] = name.rstrip(b"\0").decode(), size
            else:
                child = struct.unpack_from("<Q", self.d, at + 4 + i * (key + 8) + key)[0]
                assert self.d[child + 4 :][:key] == name
                self.names(child, key)

    def blocks(self, at, inside=None):
        """(chrom, start, chrom2, end, body) of all leaves below a node, each inside of what its parents say."""
        leaf, _, n = struct.unpack_from("<BBH", self.d, at)
        for i in range(n):
            c, s, c2, e, offset = struct.unpack_from("<IIIIQ", self.d, at + 4 + i * (32 if leaf else 24))
            if inside:
                assert inside[:2] <= (c, s) and (c2, e) <= inside[2:] or c2 < inside[2]
            if leaf:
                size = struct.unpack_from("<Q", self.d, at + 4 + i * 32 + 24)[0]
                yield c, s, c2, e, zlib.decompress(self.d[offset : offset + size])
            else:
                yield from self.blocks(offset, (c, s, c2, e))

    def rows(self):
        magic, _, n = struct.unpack_from("<IIQ", self.d, self.index)
        out, count, edge = [], 0, (0, 0)
        for c, s, c2, e, body in self.blocks(self.index + 48):
            chrom, first, last, step, span, kind, _, items = struct.unpack_from("<IIIIIBBH", body)
            assert (chrom, first, chrom, last) == (c, s, c2, e) and (c, s) >= edge and len(body) <= self.buffer and items <= 1024
            edge, count = (c, e), count + 1
            for i in range(items):
                if kind == 1:
                    lo, hi, v = struct.unpack_from("<IIf", body, 24 + 12 * i)
                elif kind == 2:
                    lo, v = struct.unpack_from("<If", body, 24 + 8 * i)
                    hi = lo + span
                else:
                    lo, v = first + i * step, struct.unpack_from("<f", body, 24 + 4 * i)[0]
                    hi = lo + span
                out.append((self.chroms[chrom][0], lo, hi, v))
        assert magic == 0x2468ACE0 and count == n == struct.unpack_from("<I", self.d, self.data)[0]
        return out

    def zoom(self, i):
        records = [struct.unpack_from("<IIIIffff", body, 32 * k) for *_, body in self.blocks(self.zooms[i][3] + 48) for k in range(len(body) // 32)]
        assert len(records) == struct.unpack_from("<I", self.d, self.zooms[i][2])[0]
        return records


f32 = lambda v: struct.unpack("<f", struct.pack("<f", v))[0]


@pytest.mark.parametrize("parts,node", [(1, 256), (5, 3)])
def test_file(spark, tmp_path, monkeypatch, parts, node):
    """Intervals of all kinds, many parts, indexes of several levels; the driver writes no data."""
    monkeypatch.setattr(bigwig, "NODE", node)
    rng = random.Random(2)
    rows = [("chr2", i, i + 1, rng.gauss(0, 5)) for i in range(100, 4300)]  # one step
    rows += [("chr10", 7 * i, 7 * i + 5, float(i)) for i in range(3000)]  # wider steps
    at = 0
    for _ in range(2500):  # intervals of all widths
        at += rng.randint(0, 50)
        end = at + rng.randint(1, 300)
        rows.append(("é", at, end, rng.random()))
        at = end
    rows += [("chr2", 5000, 5001, None)] + [(f"n{i}", i, i + 2, 1.0) for i in range(40)]
    sizes = [("chr2", 6000), ("chr10", 30_000), ("é", at), ("none", 10)] + [(f"n{i}", 50) for i in range(40)]
    path = str(tmp_path / "a.bw")
    df = spark.createDataFrame(rows, "chrom string, start long, end long, value double").repartition(4)
    bigwig.write_bigwig(df, spark.createDataFrame(sizes, "chrom string, size long"), f"file://{path}", parts)
    plain = Plain(path)
    assert set(plain.chroms.values()) == set(sizes)
    want = sorted((c, s, e, f32(v)) for c, s, e, v in rows if v is not None)
    assert sorted(plain.rows()) == want
    covered = sum(e - s for _, s, e, _ in want)
    assert plain.summary[0] == covered and plain.summary[1] == min(v for *_, v in want) and plain.summary[2] == max(v for *_, v in want)
    assert plain.summary[3] == pytest.approx(sum((e - s) * v for _, s, e, v in want)) and plain.summary[4] == pytest.approx(sum((e - s) * v * v for _, s, e, v in want))
    bases = {}
    for c, s, e, v in want:
        bases.setdefault(c, {}).update(dict.fromkeys(range(s, e), v))
    assert len(plain.zooms) == bigwig.ZOOMS and [z[0] for z in plain.zooms] == [32 * 4**k for k in range(8)]
    for i, (width, *_) in enumerate(plain.zooms):
        records = plain.zoom(i)
        assert sum(r[3] for r in records) == covered
        for c, s, e, n, low, high, total, squares in records:
            inside = [v for p in range(s, e) if (v := bases[plain.chroms[c][0]].get(p)) is not None]
            assert s // width == (e - 1) // width and n == len(inside)
            assert (low, high) == (min(inside), max(inside)) and total == pytest.approx(sum(inside), rel=1e-4, abs=1e-2) and squares == pytest.approx(sum(v * v for v in inside), rel=1e-4, abs=1e-2)
    assert sorted(map(tuple, bigwig.read_bigwig(spark, path).collect())) == want
    assert sorted(map(tuple, bigwig.read_bigwig(spark, path, "chr10").collect())) == [r for r in want if r[0] == "chr10"]
    assert bigwig.read_bigwig(spark, path, "absent").collect() == []
    assert not [p for p in tmp_path.iterdir() if p.name != "a.bw"]


def test_bad_and_empty(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "chrom string, start long, end long, value double")
    sizes = spark.createDataFrame([("a", 10)], "chrom string, size long")
    for bad, say in (([("a", 1, 4, 1.0), ("a", 3, 5, 1.0)], "overlaps"), ([("a", 8, 11, 1.0)], "outside"), ([("a", 4, 4, 1.0)], "empty")):
        with pytest.raises(Exception, match=say):
            bigwig.write_bigwig(make(*bad), sizes, str(tmp_path / "bad.bw"))
        assert not (tmp_path / "bad.bw").exists()
    bigwig.write_bigwig(make(), sizes, str(tmp_path / "none.bw"))
    plain = Plain(str(tmp_path / "none.bw"))
    assert plain.rows() == [] and plain.chroms == {0: ("a", 10)} and plain.zooms == []
    assert bigwig.read_bigwig(spark, str(tmp_path / "none.bw")).collect() == []
    with pytest.raises(ValueError, match="share"):
        bigwig.write_bigwig(make(), sizes, "hdfs://x/y.bw")


def test_same_as_bedgraph(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{i}", 5 * i, "+", "".join(rng.choice("ACGTN" if i % 2 else "ACGT") for _ in range(300 * i))) for i in range(1, 6)]
    rows = spark.createDataFrame(rows, "seq_id string, offset long, strand string, seq string")
    found = analyse(rows)
    sinks.write_bedgraph(found, str(tmp_path / "bed"))
    sinks.write_bigwig(found, rows, str(tmp_path / "t.bw"))
    bed = spark.read.option("sep", "\t").schema("c string, s long, e long, v double").csv(str(tmp_path / "bed")).collect()
    assert bed and sorted((c, s, e, pytest.approx(f32(v), rel=1e-6)) for c, s, e, v in bed) == sorted(Plain(str(tmp_path / "t.bw")).rows())
    sinks.write_sizes(rows, str(tmp_path / "sizes"))
    assert [line for p in sorted((tmp_path / "sizes").glob("part-*")) for line in p.read_text().splitlines()] == [f"s{i}\t{305 * i}" for i in range(1, 6)]
