"""Connected components by distributed union-find: alternating large-star and small-star rounds, native joins only.

Each round hooks every node to the least node it knows; the number of rounds grows with the logarithm of the longest
chain. Minima are combined before shuffles, and the joins are plain equi-joins, which AQE splits on hot nodes. Edges that one task
would hold are counted first and solved on the driver: there the rounds are only jobs and plans, which fill its memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import durable

#: Edges that one task holds at least: few edges make few shuffle files, many make many tasks. So many integers go to the driver at most.
TASK_ROWS = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that an edge links to another; root is the least node of its component.

    Loops, repeated and null-ended edges change nothing; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    e = durable(e.distinct())
    if {kind for _, kind in e.dtypes} <= {"int", "bigint"} and e.count() <= TASK_ROWS:
        return _solved(e)
    seen = _state(e)
    tasks = 1 + seen[0] // TASK_ROWS
    while True:
        e = e.coalesce(tasks)
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v").alias("n"), F.col("u").alias("m"))).coalesce(tasks)
        least = both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("lo").alias("v")).coalesce(tasks).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = large.join(root, "u").where("v != lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        e = durable(small.union(root.select("u", F.col("lo").alias("v"))).coalesce(tasks).distinct())
        now = _state(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _solved(e: DataFrame) -> DataFrame:
    """``components`` of few edges (u, v), u > v, in the driver's memory."""
    table = e.toArrow()
    nodes, ends = np.unique(np.concatenate([table[c].to_numpy() for c in "uv"]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    schema = e.select(F.col("u").alias("node"), F.col("v").alias("root")).schema
    return e.sparkSession.createDataFrame(pa.table({"node": nodes[hung], "root": nodes[root[hung]]}), schema)


def _state(e: DataFrame) -> tuple:
    """The number of edges first; equal before and after a round only if the edges are the same."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
