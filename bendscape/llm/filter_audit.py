"""How document filters interact: what each filter removes, and what it costs, in every order of filters.

Every document gets a mask with a bit for each filter that it fails. Four filters look at the text alone; the fifth is
for exact copies, found by refining a partition: documents are split by their number of code points, then by the hash of
one block of text after another (blocks grow, so there are few), and a class with one document is dropped at once. What
is left is compared by its full texts, so hashes decide nothing. Masks are then counted by part, and all orders of
filters are answered from these counts alone, at most 32 for a part.

A null text is an empty one, and all empty texts are copies of each other. A null language is the part ``""``. A row
without a key is no copy of anything, and makes nothing a copy. Rows that repeat key and text are each counted, and are
no copies of each other, as neither key is smaller; rows of one key with different texts are rows of their own. Of
repeated labels of a document, one that says so is enough. Labels of unknown documents say nothing. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bendscape.llm.common import cut, let, listed, words

FILTERS = "ABCDE"
#: Code points in the first block of a text, and how much longer than the one before each further block is.
FIRST, GROWTH = 128, 8
#: Where blocks begin and how long they are; the last begins beyond the longest string.
BLOCKS = [(FIRST * (GROWTH**k - 1) // (GROWTH - 1), FIRST * GROWTH**k) for k in range(9)]
#: In how many of the 120 orders a given one of so many filters comes before the others.
FIRST_IN = [0, 120, 60, 40, 30, 24]


def failing(text: Column) -> Column:
    """The bits of filters A to D: few words, repeated words, capitals, signs."""
    t = F.coalesce(text, F.lit(""))
    size = lambda a: F.size(a).cast("long")
    bit = lambda k, c: F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    counts = let(words(t), lambda w: F.struct(size(w).alias("n"), size(F.array_distinct(w)).alias("different")))
    by_words = let(counts, lambda c: bit(0, c["n"] < 200) + bit(1, 100 * c["different"] < 50 * c["n"]))
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return by_words + bit(2, 100 * capitals.cast("long") > 3 * F.length(t).cast("long")) + bit(3, t.rlike(r"[#$%&*|]"))


def block_hashes(text: Column, bits: int) -> Column:
    """A hash of each block of the text; ``bits``: how many of its 64 bits count."""
    t = F.coalesce(text, F.lit(""))
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(min(n, (1 << 31) - 1)).alias("n")) for a, n in BLOCKS if a < 1 << 31])
    held = F.filter(spans, lambda s: s["a"] < F.length(t))
    return F.transform(held, lambda s: F.shiftrightunsigned(F.xxhash64(F.substring(t, s["a"] + 1, s["n"])), 64 - bits))


def _chained(chain: Column, block: Column) -> Column:
    return F.xxhash64(chain, block)


def measured(docs: DataFrame, bits: int, key: str, text: str, part: str, whole: bool = False) -> DataFrame:
    """(key, part, failed, n, blocks) of each document; ``whole``: and its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        failing(t).alias("failed"),
        F.length(t).alias("n"),
        block_hashes(t, bits).alias("blocks"),
        *([t.alias("text")] if whole else []),
    )


def refined(rows: DataFrame) -> DataFrame:
    """(n, chain): the classes of equal length and block hashes that more than one document has."""
    repeated = lambda alive: listed(alive.groupBy("n", "chain").agg(F.count("*").alias("k")).where("k > 1").drop("k"))
    alive = rows.select("n", "blocks", F.lit(0).cast("long").alias("chain"))
    shared = repeated(alive)
    for block, (start, _) in enumerate(BLOCKS):
        if start >= (shared.agg(F.max("n")).first()[0] or 0):
            break
        alive = alive.join(shared, ["n", "chain"], "left_semi")
        here = F.get("blocks", F.lit(block))
        alive = alive.withColumn("chain", F.when(here.isNotNull(), _chained(F.col("chain"), here)).otherwise(F.col("chain")))
        shared = repeated(alive)
    return shared


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", bits: int = 64) -> DataFrame:
    """(key, part, failed): the mask of each document, with the bit of filter E for copies of a smaller key's text."""
    chain = F.aggregate("blocks", F.lit(0).cast("long"), _chained)
    rows = cut(measured(docs, bits, key, text, part))
    shared = refined(rows)
    rows = rows.withColumn("chain", chain).drop("blocks")
    full = measured(docs, bits, key, text, part, whole=True).withColumn("chain", chain).drop("blocks")
    # The full texts: a row for each different one, combined before the shuffle.
    texts = full.select("key", "n", "chain", "text").join(shared, ["n", "chain"], "left_semi").groupBy("n", "chain", "text").agg(F.min("key").alias("least"))
    classes = cut(texts.groupBy("n", "chain").agg(F.count("*").alias("texts"), F.min("least").alias("least")))
    failed = F.col("failed") + F.when(F.col("key") > F.col("least"), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    out = rows.join(listed(classes.where("texts = 1").drop("texts")), ["n", "chain"], "left")
    mixed = classes.where("texts > 1").select("n", "chain")
    if not mixed.isEmpty():  # different texts of equal hashes: only the texts themselves tell their rows apart
        again = full.join(texts.join(mixed, ["n", "chain"], "left_semi"), ["n", "chain", "text"])
        out = out.join(mixed, ["n", "chain"], "left_anti").select("key", "part", "failed", "least").unionByName(again.select("key", "part", "failed", "least"))
    return out.select("key", "part", failed.alias("failed"))


def audit(masked: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from :func:`masks`.

    For each part, each of the 120 orders of all filters, and each step of it.
    """
    said = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.groupBy(F.col(key).alias("key")).agg(said(quality).alias("good"), said(toxic).alias("toxic"))
    rows = masked.join(known, "key", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    cells = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), total("good"), total("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.array(*[F.lit(k) for k in range(1, len(FILTERS) + 1)])).alias("step"))
    bit = lambda letter: F.expr(f"shiftleft(1, instr('{FILTERS}', {letter}) - 1)")
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.select(
        "part", "cells", "filter_order", "step",
        bit("letter").alias("bit"),
        F.expr(f"aggregate(sequence(1, step), 0, (acc, k) -> acc | shiftleft(1, instr('{FILTERS}', substring(filter_order, k, 1)) - 1))").alias("through"),
    )
    before = F.col("through").bitwiseXOR(F.col("bit"))
    has = lambda x, m: x["failed"].bitwiseAND(m) != 0
    own = lambda x: has(x, F.col("bit"))
    here = lambda x: own(x) & ~has(x, before)
    count = lambda which, field="n": F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda acc, x: acc + x[field])
    weights = F.array(*[F.lit(w).cast("long") for w in FIRST_IN])
    return steps.select(
        "part", "filter_order", "step",
        count(lambda x: ~has(x, F.col("through"))).alias("kept"),
        count(here).alias("removed"),
        count(lambda x: own(x) & has(x, before)).alias("redundant"),
        count(lambda x: x["failed"] == F.col("bit")).alias("unique_fails"),
        count(here, "good").alias("good_lost"),
        count(here, "toxic").alias("toxic_lost"),
        F.aggregate(F.filter("cells", own), F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * F.get(weights, F.bit_count(x["failed"]))).alias("shapley"),
    )
