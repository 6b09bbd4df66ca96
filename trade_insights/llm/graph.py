"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root of every node of ``edges`` (columns a and b, long): root is
    the smallest node of its component. Rounds of smallest-neighbour labels and
    label jumps, each written to the shared folder, run until none changes."""
    both = stored(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    roots = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"{name}-roots")
    turn = 0
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        turned = stored(least.join(jump, "root").select("node", F.least("root", "next").alias("root"), "old"), f"{name}-round{turn}")
        roots, turn = turned.select("node", "root"), turn + 1
        if turned.where("root <> old").isEmpty():
            return roots
