"""Connected components of an edge table."""

from pyspark.sql import functions as F

from barwise.llm.common import stored


def components(edges):
    """``edges``: a, b (long). One row per vertex with an edge: vertex, label (its component's smallest vertex).

    Every round a vertex takes the smallest label among its neighbours' labels and its own, then that label's own label;
    rounds go on until no label changes. Minima combine before the shuffle, so a vertex of any degree is spread."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["vertex"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("vertex") == F.col("a")).select("vertex", "label", F.least("label", "near").alias("next"))
        hop = step.select(F.col("vertex").alias("via"), F.col("next").alias("further"))
        step = stored(step.join(hop, F.col("next") == F.col("via")).select("vertex", "label", F.least("next", "further").alias("next")))
        changed = not step.filter("next <> label").isEmpty()
        labels = step.select("vertex", F.col("next").alias("label"))
        if not changed:
            return labels
