"""Connected components of a link table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (a, b).

    Every round a node takes the least label among itself and its neighbours, then
    its label's label, so chains halve. Both sides of each join are plain tables, so
    Spark splits the partitions of a hub. Ends when no label changes.
    """
    both = links.filter("a is not null and b is not null and a <> b")
    edges = stored(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        lower = stored(labels.unionByName(heard).groupBy("node").agg(F.min("label").alias("label")), "heard")
        roots = lower.withColumnsRenamed({"node": "n2", "label": "l2"})
        jumped = lower.join(roots, lower["label"] == roots["n2"], "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"))
        after = stored(jumped, "labels")
        old = labels.withColumnsRenamed({"label": "old"})
        changed = after.join(old, "node").filter("label <> old").limit(1).count()
        labels = after
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
