"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.store import materialise


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(id, component) for each end of a link; component is the smallest id reachable.

    Every round takes the smallest label among the neighbours, then jumps to that label's label, so long chains
    shorten by half. Each round is one table in the shared folder. Rows of links may repeat; no links give no rows.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).filter("id is not null and other is not null and id <> other")
    both = materialise(both.union(both.select("other", "id")).distinct(), "links")
    labels = materialise(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("far"))
        step = materialise(step.join(jump, "to", "left").select("id", F.least("to", "far").alias("component"), "was"), "labels")
        done = step.filter("component <> was").isEmpty()
        labels = step.select("id", "component")
        if done:
            return labels
    raise RuntimeError(f"components did not settle within {rounds} rounds")
