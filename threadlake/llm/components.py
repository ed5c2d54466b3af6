"""Connected components of a table of links, by spreading least ids and jumping along them; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadlake.llm.storage import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the least node that each node is linked to, over any number of steps.

    In a round each node takes the least label around it and then its label's own label, so chains shrink by powers of
    two. Every round is written to the shared folder."""
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("near"))
        of = labels.select(F.col("node").alias("near"), F.col("component").alias("further"))
        moved = durable(nearer.join(of, "near", "left").select("node", "was", F.least("near", "further").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """components of all links so far, from those before (node, component) and the links (a, b) that came after. Only classes
    that the new links join go through rounds."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    known = durable(links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("a_of", "a").alias("a_of"), F.coalesce("b_of", "b").alias("b_of")), "links")
    joined = components(known.select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))
    # A node without links before is a class of its own.
    new = known.select(F.col("a").alias("node"), F.col("a_of").alias("component")).union(known.select("b", "b_of")).filter("node = component").distinct()
    every = labels.union(new.join(labels, "node", "left_anti"))
    return durable(every.join(joined.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component")), "labels")
