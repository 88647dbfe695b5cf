"""Joins of intervals against loops over all pairs."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from bendscape.operators import intervals
from bendscape.plans import registry  # noqa: F401
from bendscape.plans.analysis import analyse

SCHEMA = "seq_id string, piece int, start long, end long, name string"


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([rng.randint(-50, 400), 100])
        rows.append((rng.choice("ab"), rng.randint(0, 1), start, start + rng.choice([0, 0, 3, 90]), f"r{i}"))
    return rows + [(None, 0, 1, 500, "null"), ("a", None, 1, 500, "null piece"), ("a", 0, 9, 3, "turned"), ("a", 0, None, 9, "none"), rows[0], rows[0]]


def gap(x, y):
    if None in (*x[:4], *y[:4]) or x[:2] != y[:2] or x[2] > x[3] or y[2] > y[3]:
        return None
    return max(y[2] - x[3], x[2] - y[3], 0)


@pytest.mark.parametrize("within,width,cell", [(0, 1 << 14, 1 << 15), (5, 16, 3), (40, 50, 10)])
def test_against_all_pairs(spark, within, width, cell):
    """Bins of many sizes, crowded ones split into grids."""
    a, b = made(1, 120), made(2, 90)
    left, right = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (a, b))
    near = lambda x, y: (g := gap(x, y)) is not None and g <= within
    want = collections.Counter((x[0], x[1], x[4], y[4], gap(x, y)) for x in a for y in b if near(x, y))
    got = intervals.pairs(left, right, within, width=width, cell=cell).select("seq_id", "piece", "left.name", "right.name", "distance")
    assert collections.Counter(map(tuple, got.collect())) == want
    counts = collections.Counter((*x, sum(near(x, y) for y in b)) for x in a)
    assert collections.Counter(map(tuple, intervals.partners(left, right, within, width=width).collect())) == counts
    for f, keep in ((intervals.near, True), (intervals.apart, False)):
        want = collections.Counter(x for x in a if any(near(x, y) for y in b) == keep)
        assert collections.Counter(map(tuple, f(left, right, within, width=width).collect())) == want


def test_none(spark):
    rows, none = spark.createDataFrame(made(3, 4), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert intervals.pairs(rows, none).count() == intervals.pairs(none, rows).count() == intervals.near(rows, none).count() == intervals.partners(none, rows).count() == 0
    assert intervals.apart(rows, none).count() == rows.count()


def test_no_cross_join(spark):
    rows = spark.createDataFrame(made(3, 4), SCHEMA)
    for df in (intervals.pairs(rows, rows, 5), intervals.partners(rows, rows, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_building_an_analysis_runs_no_job(spark):
    rows = spark.createDataFrame([("s", 0, "+", "ACGT" * 100)], "seq_id string, offset long, strand string, seq string")
    spark.sparkContext.setJobGroup("building", "building")
    found = analyse(rows)
    tables = [found.curvature, found.scores, found.runsums, found.averages, found.initial["active"], found.ordered().curvature]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup(None, None)
    assert len(tables) == 6 and not jobs
    assert found.averages.agg(F.count("*")).first()[0] == 1 and found.final["active"].count() >= 0
