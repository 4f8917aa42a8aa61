"""Connected components of a table of links, without bringing links to the driver.

Every node takes the smallest label among its neighbours and itself, then the label of its label (pointer jumping),
until nothing changes; paths halve in each round. Minima are pre-aggregated before each shuffle, so a node with
very many links is no hot key of the aggregation. Both joins are of stored tables, shuffled for that join alone, so
adaptive execution can split a node with very many links (or labels) over tasks. Each round's tables are written to
the shared folder; they are deleted at the end, all but the last.

Defined results: links to oneself, repeated links and links in either direction are harmless; rows with a null end
are ignored; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import durable, like_stored, scratch


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for each end of a link, the smallest node that it reaches."""
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    with scratch(links.sparkSession) as keep:
        both = durable(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
        while True:
            heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
            nearer = labels.join(heard, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
            nearer = durable(nearer)
            jump = nearer.select(F.col("node").alias("component"), F.col("component").alias("further"))
            after = durable(nearer.join(jump, "component").select("node", F.col("further").alias("component"), (F.col("further") != F.col("before")).alias("moved")))
            labels = like_stored(after.select("node", "component"), after)
            if not after.where("moved").limit(1).count():
                return keep(labels)
