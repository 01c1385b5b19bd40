"""Connected components of an edge table, by contraction.

Each round every node takes the least of itself and its neighbours as its parent, parents are followed to their roots, and the edges
are contracted onto the roots; it ends when no edge is left. Only minima are aggregated, so a node with any number of
neighbours costs one value a task. What a round makes is written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spent


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that it reaches, for every node of edges (u, v); null ends and self edges are left out."""
    e = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    known = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent")), "parents")
        while True:  # parents never rise, so following them ends
            above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            last, parent = parent, cut(parent.join(above, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
            spent(last)
            if parent.where("moved").isEmpty():
                break
        root = parent.select("node", F.col("parent").alias("root"))
        u, v = root.toDF("u", "ru"), root.toDF("v", "rv")
        last, e = e, cut(e.join(u, "u").join(v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        spent(last)
        if known is None:
            known = root.select("node", F.col("root").alias("component"))
        else:
            step = root.select(F.col("node").alias("component"), "root")
            last, known = known, cut(known.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")
            spent(last, parent)
    return known if known is not None else e.select(F.col("u").alias("node"), F.col("v").alias("component"))
