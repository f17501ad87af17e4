"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``: root is its component's smallest node.

    Each round a node takes the smallest root among its neighbours', and then its
    root's root, so long chains halve.  Roots are written out after every round.
    Sums by node are aggregated before the shuffle; links are never gathered.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    roots = materialize(
        both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).withColumnRenamed("x", "node"), "roots"
    )
    while True:
        of = roots.select(F.col("node").alias("y"), F.col("root").alias("near"))
        nearest = both.join(of, "y").groupBy("x").agg(F.min("near").alias("near"))
        step = roots.join(nearest, F.col("node") == F.col("x")).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root")
        )
        up = roots.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        jumped = step.join(up, step["root"] == up["mid"], "left").select(
            "node", "was", F.least("root", F.coalesce("far", "root")).alias("root")
        )
        new = materialize(jumped, "roots")
        roots = new.select("node", "root")
        if new.where("was <> root").isEmpty():
            return roots
