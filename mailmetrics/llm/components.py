"""Connected components of a large graph, by alternating star operations on DataFrames.

Each round links every vertex's larger neighbours to its smallest one and then
its smaller neighbours and itself to the smallest, until the edges no longer
change; the edges are then stars around the smallest vertex of each component.
Smallest neighbours come from partial minima, and a vertex with very many
neighbours costs no more than its edges.  Each round's edges are written to
the shared folder, so the plan stays short and a lost executor costs a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _smallest(directed: DataFrame, name: str) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias(name))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges (u, v), any order -> (v, root): for every vertex of an edge except roots themselves, its root."""
    now = scratch.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    seen = None
    turn = 0
    while True:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that both sides of the join are shuffled and a hot vertex can be split
        least = scratch.stage(_smallest(both, "m"), f"{name}{turn}least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = scratch.stage(large, f"{name}{turn}large")
        low = scratch.stage(_smallest(large, "m"), f"{name}{turn}low")
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").distinct()
        new = scratch.stage(small, f"{name}{turn}")
        mark = new.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        scratch.drop(f"{name}{turn - 1}", *(f"{name}{turn}{x}" for x in ("least", "large", "low")))
        now = new
        if seen is not None and tuple(mark) == seen:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = tuple(mark)
