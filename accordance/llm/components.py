"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import Scratch, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge (a, b).

    Labels pass along edges as minima and are then replaced by their own labels (pointer
    jumping), so that rounds grow with the logarithm of the longest chain. Every round is a
    table in the shared folder; minima combine before the shuffle, so a hub costs little.
    Null ends are ignored; no edges give an empty table.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.saved(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = scratch.saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        new = scratch.saved(labels.join(near, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was")), "labels")
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = scratch.saved(new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"), "was"), "labels")
        changed = new.filter("component <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    out = saved(labels, "components")
    scratch.clear()
    return out
