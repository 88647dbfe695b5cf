"""Queries against their SQL on a small table with odd rows."""

import random

import duckdb
import pytest

from bendscape.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé€") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    texts = [None, "", " \t\n", "One", "one", "one two", "é" * 60, "€" * 200, "aaaa " * 80, "aaaa " * 80, shared, shared.upper(), "x" * 99, "x" * 100, "x" * 101]
    texts += [prose(30) + "\n" + shared + "\r\n" + prose(30) for _ in range(6)] + [shared + " " + shared]
    texts += [prose(200) for _ in range(4)] + ["! " * 30 + prose(20), "- item\n" * 12, "- item one...\n- item two\n", "#" * 40 + prose(12)]
    texts += [t + " tail" for t in texts[-8:-4]]
    path = tmp_path_factory.mktemp("sql")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op2_quality_rules", "quality_ablations", "op9_simhash", "op10_suffix_dedup"])
def test_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
