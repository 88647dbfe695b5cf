"""Joins of intervals that lie within a distance of each other: pairs, counts, and those with or without a partner.

Intervals are (keys..., start, end, ...), with inclusive ends. Places are cut into bins. For pairs, an interval goes to every
bin that it reaches, and a pair is made in the first bin that both reach. A bin with very many intervals is split into a
grid: those of one side are dealt over its rows, those of the other over its columns, so a task meets two bounded lists.
Counts, and so semi and anti joins, make no pairs at all: an interval's partners are those that begin before its end but
for those that end before its start, and both numbers come from running counts within bins and over bins.

A null key meets nothing, as in any join: such rows have no pairs and no partners. An interval with a null or whose end is
before its start counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a bin; intervals of one side that a cell of a bin's grid has, about.
BIN, CELL = 1 << 14, 1 << 15

KEYS = ("seq_id", "piece")


def _bin(place: Column, width: int) -> Column:
    return F.floor(place / F.lit(width))


def _sound() -> Column:
    return F.coalesce(F.col("start") <= F.col("end"), F.lit(False))


def pairs(a: DataFrame, b: DataFrame, within: int = 0, keys: tuple[str, ...] = KEYS, width: int = BIN, cell: int = CELL) -> DataFrame:
    """(keys..., left, right, distance): each pair of rows of ``a`` and ``b``, as structs, that are ``within`` or fewer places
    apart; overlapping ones are 0 apart, ``[1, 3]`` and ``[5, 6]`` are 2."""
    sides = []
    for df, reach, name in ((a, within, "left"), (b, 0, "right")):
        rest = [F.col(c) for c in df.columns if c not in keys]
        low, high = F.col("start") - reach, F.col("end") + reach
        rows = df.where(_sound()).select(*keys, F.struct(*rest).alias(name), low.alias("low"), F.explode(F.sequence(_bin(low, width), _bin(high, width))).alias("bin"))
        sides.append(rows.withColumn("low", _bin(F.col("low"), width)))
    left, right = sides
    # How many cells the grid of a crowded bin has on each side.
    at = [*keys, "bin"]
    number = lambda rows, name: rows.groupBy(*at).agg(F.ceil(F.count("*") / cell).alias(name))
    grids = number(left, "rows").join(number(right, "columns"), at).where("rows > 1 or columns > 1")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), one(c) - 1))
    # The hash is of the row's content, so that a task that is run again deals it alike.
    left = left.join(grids, at, "left").withColumns({"i": F.pmod(F.xxhash64("left"), one("rows"))}).withColumn("j", every("columns"))
    right = right.join(grids, at, "left").withColumns({"j": F.pmod(F.xxhash64("right"), one("columns"))}).withColumn("i", every("rows"))
    met = left.select(*at, "i", "j", "left", "low").join(right.select(*at, "i", "j", "right", F.col("low").alias("low2")), [*at, "i", "j"])
    gap = F.greatest(F.col("right.start") - F.col("left.end"), F.col("left.start") - F.col("right.end"), F.lit(0))
    return met.where((F.col("bin") == F.greatest("low", "low2")) & (gap <= within)).select(*keys, "left", "right", gap.alias("distance"))


def partners(a: DataFrame, b: DataFrame, within: int = 0, keys: tuple[str, ...] = KEYS, width: int = BIN) -> DataFrame:
    """``a`` with ``n_partners``: how many rows of ``b`` are ``within`` or fewer places apart. Every row of ``a`` stays."""
    # Keys are beside the row, so it is without them.
    rest = a.select(*(c for c in a.columns if c not in keys))
    row = F.struct(*rest.columns)
    asked = a.select(row.alias("row"), F.monotonically_increasing_id().alias("id"), *keys, _sound().alias("sound"), "start", "end")
    # Two questions a row: how many begin up to its end, and how many end before its start. One takes the row along.
    event = lambda place, sign, *more: F.struct(place.alias("place"), F.lit(sign).alias("sign"), *more)
    both = F.array(event(F.col("end") + within, 1, F.col("row")), event(F.col("start") - within, -1, F.lit(None).cast(rest.schema).alias("row")))
    questions = asked.where("sound").select(*keys, "id", F.explode(both).alias("q")).select(*keys, "id", "q.*")
    facts = b.where(_sound()).select(*keys, F.explode(F.array(event(F.col("start"), 1), event(F.col("end"), -1))).alias("e")).select(*keys, "e.*")
    facts = facts.withColumn("bin", _bin(F.col("place"), width))
    # What all bins before hold, a row a bin and sign that has any.
    sums = facts.groupBy(*keys, "bin", "sign").agg(F.count("*").alias("n"))
    events = facts.select(*keys, "bin", "sign", "place", F.lit(0).alias("after"), F.lit(1).alias("fact"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(rest.schema).alias("row"))
    events = events.unionByName(questions.select(*keys, _bin(F.col("place"), width).alias("bin"), "sign", "place", F.when(F.col("sign") > 0, 2).otherwise(-1).alias("after"), F.lit(0).alias("fact"), "id", "row"))
    running = Window.partitionBy(*keys, "bin", "sign").orderBy("place", "after").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("here", F.sum("fact").over(running)).where("id is not null")
    # A question's bin may hold no fact, so bins of both are scanned.
    asked_bins = questions.select(*keys, _bin(F.col("place"), width).alias("bin"), "sign").distinct().withColumn("n", F.lit(0).cast("long"))
    along = Window.partitionBy(*keys, "sign").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sums.unionByName(asked_bins).groupBy(*keys, "bin", "sign").agg(F.sum("n").alias("n"))
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    answered = counted.join(bins, [*keys, "bin", "sign"]).groupBy(*keys, "id").agg(F.any_value("row", True).alias("row"), F.sum(F.col("sign") * (F.col("here") + F.col("before"))).alias("n"))
    # Rows that meet nothing: with a null key, or that are no interval.
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    none = a.where(~(_sound() & known)).select(*keys, row.alias("row"), F.lit(0).cast("long").alias("n"))
    return answered.select(*keys, "row", "n").unionByName(none).select(*keys, "row.*", F.col("n").alias("n_partners")).select(*a.columns, "n_partners")


def near(a: DataFrame, b: DataFrame, within: int = 0, keys: tuple[str, ...] = KEYS, width: int = BIN) -> DataFrame:
    """The rows of ``a`` with a partner in ``b``, each once."""
    return partners(a, b, within, keys, width).where("n_partners > 0").drop("n_partners")


def apart(a: DataFrame, b: DataFrame, within: int = 0, keys: tuple[str, ...] = KEYS, width: int = BIN) -> DataFrame:
    """The rows of ``a`` without a partner in ``b``."""
    return partners(a, b, within, keys, width).where("n_partners = 0").drop("n_partners")
