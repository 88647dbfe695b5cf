"""Connected components of a link table: of a few links in one task, of more by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendscape.llm.common import cut

#: Distinct links up to which one task settles them. Rounds over so few would cost their jobs and files, not their rows.
FEW = 1 << 14
#: Types of nodes whose order is the same in numpy as in Spark, besides strings.
_NUMBERS = {"byte": np.int8, "short": np.int16, "integer": np.int32, "long": np.int64}


def merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the links x-y between nodes."""
    new = np.arange(len(label))
    u, v = label[x], label[y]
    while True:
        low = np.minimum(new[u], new[v])
        after = new.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        np.minimum.at(after, new, after)
        after = after[after]
        if (after == new).all():
            return new[label]
        new = after


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, component) of few links, read by one task."""
    kind = edges.schema["u"].dataType

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        u, v = pa.Table.from_batches(batches).columns
        nodes, at = np.unique(np.concatenate([u.to_numpy(), v.to_numpy()]), return_inverse=True)
        least = merged(np.arange(len(nodes)), *np.split(at, 2))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, u.type), pa.array(nodes[least], u.type)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, T.StructType().add("node", kind).add("component", kind))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node hands its smallest neighbour to its larger (large star) or smaller neighbours.

    The smallest neighbour is a plain aggregate, combined before the shuffle, so a node with very many links is
    never gathered in one place; Spark splits the join that hands it back if it is skewed.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = sides.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach, itself included.

    Links need no order and may repeat; rows with a null end, and links of a node to itself, say nothing. Nodes
    without a link are not in the result. No links give no rows. Up to ``FEW`` links are settled in one task. With more,
    rounds end when the stars no longer change; their number grows with the logarithm of the longest chain. Each round is
    cut off by a checkpoint, so lost executors cost one round.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct())

    def sign(e: DataFrame):
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    seen = sign(edges)
    kind = edges.schema["u"].dataType
    if seen[0] <= FEW and (kind == T.StringType() or kind.typeName() in _NUMBERS):
        return _at_once(edges)
    while seen[0]:
        edges = cut(_star(_star(edges, True), False))
        now = sign(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
