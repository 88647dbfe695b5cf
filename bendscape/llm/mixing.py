"""Mixing sources to target weights, by systematic sampling.

Targets: sources, in order of their names by code point with null last, have the given weights in turn, and share
``share`` times the size of everything by weight; a target stops at ``cap`` times its source's size, and what is too much
is shared again by weight among the others. That is water-filling: one level, at which each source gets weight times
level or its cap. The level is found from the table of sources (a row for each source) with window sums.

Sampling: within a source, ordered by size and id, each document expects target / source size copies. The prefix sum of
these, plus one random offset for all, crosses an integer as often as the document is emitted. Copies thus differ from
the expectation by less than one, sizes are spread evenly over the sample, and no document is emitted more than ``cap``
times (rounded up).

Targets need one order of all sources, so the table of sources (a row each) passes through one task; rows do not.
A source may hold most rows, so prefix sums are not taken in one task: rows are dealt by ranges of (source, size, id)
and written; ranks within a range are then shifted by the counts of the ranges before it.

Defined results: a null text has size 0; documents of a null source form one source; rows may repeat and are then
emitted each on their own account; a null id sorts first; rows of one id and size are ordered by a hash of their text; a
source of size 0 has target 0 and is not emitted; all columns are carried along; an empty table gives no rows. Reruns with
one seed agree.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bendscape.llm.common import WORD, cut, fresh, listed

WEIGHTS = (5, 2, 1)
SEED = 20240607


def offset(seed: int = SEED) -> float:
    """The random offset that a seed stands for."""
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source."""
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("most"), (F.sum("source_size").over(everything) * share).alias("total"), place.alias("place"))
    rising = Window.orderBy(F.col("most") / F.col("w"), "place")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.select("*", level.alias("here"))
    # The level of the first source that its own level does not fill is the level of all that follow.
    free = F.when(F.col("most") >= F.col("here") * F.col("w"), F.col("here"))
    rows = rows.select("*", F.first(free, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("level"))
    return rows.select("source", "source_size", F.least("most", F.col("w") * F.coalesce("level", F.lit(float("inf")))).alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None) -> DataFrame:
    """(key, h, source, size, source_size, target, copies, taken): what the mix takes of each row; ``h`` is a hash of its text."""
    size = word_count(F.col(text)) if size is None else size
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    rows = cut(rows.repartitionByRange("source", "size", "id", "h").withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sized = targets(parts.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, cap)
    shifts = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    shifts = shifts.join(sized.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("part").alias("at"), "shift", "source_size", "target")
    # Ranges do not share rows, so there are fewer (source, range) pairs than sources and ranges together.
    met = rows.join(listed(shifts), F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy("size", "id", "h")) + F.col("shift")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("rank") * F.col("rate") + offset(seed)) - F.floor((F.col("rank") - 1) * F.col("rate") + offset(seed))
    out = met.select("id", "h", "source", "size", "source_size", "target", rank.alias("rank"), rate.alias("rate")).withColumn("copies", crossed.cast("long"))
    return out.select(F.col("id").alias(key), "h", F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns and ``copy``, the number of the copy.

    If ``docs`` has a column ``copy``, the number is called ``_copy``. Texts are shuffled once, by a hash of what tells
    rows apart; rows that agree in it share their copies evenly.
    """
    same, copy, copies, times, k, s, h = fresh(docs.columns, "same", "copy", "copies", "times", "k", "s", "h")
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    of = lambda *c: F.xxhash64(*[F.col(x) for x in c])
    taken = mix(docs, key=key, source=source, text=text, **options).select(F.col(key).alias(k), F.col(source).alias(s), F.col("h").alias(h), F.col("copies").alias(copies))
    taken = taken.groupBy(k, s, h).agg(F.sum(copies).alias(copies), F.count("*").alias(times)).where(F.col(copies) > 0).withColumn(same, of(k, s, h))
    left = docs.withColumn(same, F.xxhash64(F.col(key), F.col(source), digest))
    # Not as keys of the join, so that one shuffle by the hash serves the join and the numbering.
    agree = F.when(F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (digest == F.col(h)), F.lit(True)).otherwise(F.lit(False))
    met = left.join(taken, same).where(agree).select(*docs.columns, same, copies, times)
    number = F.row_number().over(Window.partitionBy(same).orderBy(F.xxhash64(*docs.columns)))
    each = F.floor(F.col(copies) / F.col(times)) + F.when(number <= F.col(copies) % F.col(times), F.lit(1)).otherwise(F.lit(0))
    return met.withColumn(copies, each.cast("int")).where(F.col(copies) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy))
