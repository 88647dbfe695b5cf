"""The audit of filter interactions against plain loops, with nulls, copies, ties and hashes that collide."""

import itertools
import re

import duckdb
import pytest

from bendscape.llm import filter_audit, queries

SCHEMA = "doc_id long, text string, lang string, n int, failed string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    said = {}
    for key, good, toxic in labels:
        g, t = said.get(key, (False, False))
        said[key] = (g or good == 1, t or toxic == 1)
    least = {}
    for key, text, *_ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    rows = []
    for key, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": key is not None and least[t] < key,
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, *(said.get(key, (False, False)) if key is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                shapley[f] += len(gone)
                kept = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                out[part, order, step] = [len(kept), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                left = kept
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return {(*k, *v) for k, v in out.items()}


LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, None, "en"), (2, "", "en"), (3, LONG, None), (4, LONG, "en"), (4, LONG, "en"), (4, LONG + "!", "en"), (None, LONG, "en"), (5, LONG + " # ABC", "de"), (6, LONG + " # ABC", "de"),
    (7, "ABCDE " * 300, "de"), (8, "x " * 5000, "fr"), (9, "x " * 4999 + "y ", "fr"), (10, "x " * 4999 + "y ", "fr"), (11, "é" * 700, "fr"), (12, "è" * 700, "fr"), (13, " \t\n", "en"),
    (14, "a b c d", ""), (15, "a b d c", None), (16, "a b c d", "en"),
]
SAID = [(1, 1, 0), (1, 0, 1), (3, None, None), (4, 1, 1), (10, 1, None), (99, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("bits", [64, 1])
def test_audit(spark, bits):
    """With one bit of each hash, only the comparison of full texts tells texts apart."""
    docs = spark.createDataFrame([(*r, 0, "x") for r in DOCS], SCHEMA)
    got = filter_audit.audit(filter_audit.masks(docs, bits=bits), spark.createDataFrame(SAID, LABELS))
    assert {tuple(r) for r in got.collect()} == plain(DOCS, SAID)


def test_audit_of_nothing(spark):
    got = filter_audit.audit(filter_audit.masks(spark.createDataFrame([], SCHEMA)), spark.createDataFrame([], LABELS))
    assert got.collect() == []


def test_audit_sql(spark, tmp_path):
    spark.createDataFrame([(*r, 0, "x") for r in DOCS if r[0] is not None], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([r for r in SAID if r[0] is not None], LABELS).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op12_filter_audit"])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES["op12_filter_audit"](spark, str(tmp_path)).select(*columns).collect()
    assert {tuple(r) for r in got} == set(want.fetchall())
