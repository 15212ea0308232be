"""Connected components of a table of links, on Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklake.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node in a link.

    Each round takes the least label of the neighbours and then the label of that label, so the rounds grow with
    the logarithm of a component's diameter. A hub's links are pre-aggregated on one side and split by adaptive
    execution on the other; each round is a table in the shared folder. Links to itself, repeated ones and an
    empty table are fine; null ends are left out.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    edges = written(pairs.union(pairs.select("other", "node")).distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("other"), F.col("component").alias("heard")), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        step = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        jumped = step.join(jump, F.col("component") == F.col("via")).select("node", F.least("component", "beyond").alias("component"), "before")
        done = written(jumped, "labels")
        labels = done.drop("before")
        if done.where("component != before").isEmpty():
            return labels
