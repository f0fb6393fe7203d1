"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.llm.common import materialise


ONE_TASK = 200_000


def _neighbours_min(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours link to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _neighbours_min(both).select("u", F.least("u", "_low").alias("_low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("_low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours link to the smallest of them; edges lead from larger to smaller."""
    joined = edges.join(_neighbours_min(edges), "u")
    own = joined.select("u", F.col("_low").alias("v"))
    others = joined.where("v <> _low").select(F.col("v").alias("u"), F.col("_low").alias("v"))
    return own.unionByName(others).distinct()


def _union_find(edges: DataFrame) -> DataFrame:
    """(node, component) in one task, for a table of bounded size."""
    types = {f.name: f.dataType.simpleString() for f in edges.schema}

    def work(it):
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        kind = None
        for batch in it:
            kind = batch.schema.field("u").type
            for pair in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                for x in pair:
                    up.setdefault(x, x)
                u, v = map(top, pair)
                up[max(u, v)] = min(u, v)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in list(up)], kind)],
                                             names=["node", "component"])

    return edges.coalesce(1).mapInArrow(work, f"node {types['u']}, component {types['u']}")


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node that each node of an edge is connected with. Loops, repeated edges and
    nulls add nothing. A node of any degree costs one partial minimum per task; the joins that carry it back are ones
    that Spark splits where they are skewed. Each round is written to the shared folder; the number of rounds grows
    with the logarithm of the number of nodes. Up to ``one_task`` edges are joined in one task instead: a bounded table
    that needs no rounds."""
    rows = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    rows, mark = materialise(rows, "edges"), None
    while True:
        seen = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        if seen[0] <= one_task:
            return _union_find(rows)
        mark = tuple(seen)
        rows = materialise(_small_star(_large_star(rows)), "edges")
    low = rows.select("v").distinct()
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        low.select(F.col("v").alias("node"), F.col("v").alias("component")))
