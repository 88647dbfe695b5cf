"""Components of few links, settled in one task, and of more, in rounds."""

import random

import pytest

from bendscape.llm import components


def test_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few links", "")
    try:
        found = components.components(links).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(301)}
    assert len(sc.statusTracker().getJobIdsForGroup("few links")) <= 8


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_one_task_and_rounds_agree(spark, kind, monkeypatch):
    rng = random.Random(5)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(None, 1), (2, None), (3, 3)]
    df = spark.createDataFrame(links, "a long, b long").selectExpr(f"cast(a AS {kind}) AS a", f"cast(b AS {kind}) AS b")
    found = []
    for few in (1 << 14, 0):
        monkeypatch.setattr(components, "FEW", few)
        got = components.components(df)
        assert got.schema["node"].dataType == got.schema["component"].dataType == df.schema["a"].dataType
        found.append(sorted(got.collect()))
        assert len(found[-1]) > 100
        assert components.components(df.limit(0)).count() == 0
    assert found[0] == found[1]
