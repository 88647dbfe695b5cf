"""What queries do for each base: nothing that takes many times as long as it needs to."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from bendscape.functions import bases, matrices
from bendscape.operators import calls
from bendscape.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_texts_become_bases_by_a_table(spark):
    texts = [None, "", "Ab c\nZ é😀ßK n-x\r\n", "".join(map(chr, range(1, 300)))]
    to = dict(zip("BDEFHIJKLMNOPQRSUVWXYZ\nACGT", "CGTATCGATCGATCGATCGATCNACGT", strict=True))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", bases.from_text(F.col("text")).alias("prose"), bases.known_or_n(F.col("text")).alias("known")).orderBy("i")
    for r, text in zip(got.collect(), texts, strict=True):
        up = [c.upper() if c.isascii() else c for c in text or ""]
        assert r.prose == "".join(to[c] for c in up if c.isascii() and (c.isalpha() or c == "\n"))
        assert r.known == (None if text is None else "".join(c if c in "ACGT" else "N" for c in up if c not in " \t\n\x0b\x0c\r"))
    assert "translate" not in plan(got) and "regexp" not in plan(got)


def test_six_digits_in_doubles(spark):
    values = [0.0, -0.0, 5e-7, -5e-7, 4.9e-7, 1.5e-6, -2.0000005, 123456.7654321, 1e12 + 0.5, -3e10]
    rows = registry.shown(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"))
    got = {r.i: r.v for r in rows.collect()}
    for i, v in enumerate(values):
        assert got[i] == float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) and str(got[i]) != "-0.0"
    odd = registry.shown(spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")).collect()
    assert odd[0].v is None and odd[1].v != odd[1].v and odd[2].v == float("inf")
    assert "CASE WHEN (abs(" in plan(rows)


def test_triplets_are_looked_up_by_their_bits(spark):
    names = [*matrices.TRIPLETS, "", "A", "ACGT", "acg", "NNN", "CEA", None]
    found = spark.createDataFrame([(t,) for t in names], "t string").withColumn("v", matrices.matrix_lookup(F.col("t"), matrices.BUILTIN.roll_simple))
    want = dict(zip(matrices.TRIPLETS, matrices.BUILTIN.roll_simple.tolist(), strict=True))
    assert {r.t: r.v for r in found.collect()} == {t: want.get(t) for t in names}
    assert "conv(" not in plan(found)


@pytest.mark.parametrize("together", [1, 7, 1 << 16])
def test_short_pieces_are_settled_together(spark, monkeypatch, together):
    """Calls of a short piece go to one block, and blocks that are settled together don't reach each other."""
    rows = [(s, p, d, float(1 + (7 * d + s) % 5)) for s in range(6) for p in range(3) for d in range(200, 900, 31 + s)]
    todo = spark.createDataFrame(rows, "seq_id long, piece int, dyad int, score double")
    assert calls._dealt(todo, calls.BLOCK // 8, calls.BLOCK).count() == len(rows)
    monkeypatch.setattr(calls, "TOGETHER", together)
    want = set()
    for s, p, d, _ in sorted(rows, key=lambda r: (-r[3], r[2])):
        if all((s, p) != k[:2] or abs(d - k[2]) > 177 for k in want):
            want.add((s, p, d))
    assert {(r.seq_id, r.piece, r.dyad) for r in calls.calls_greedy(todo).collect()} == want
