"""Connected components of a table of links, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import drop_table, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, class) for every node of ``links(a, b)``; class is the smallest node of its component.

    Each round a node takes the least label among its own, its neighbours' and its label's label
    (pointer jumping). All steps are equi-joins and minima that combine before the shuffle. Ends when
    no label changes. Null ends are ignored; repeated and reversed links do no harm; an empty table
    gives an empty one.
    """
    both = links.where("a is not null and b is not null")
    both = materialize(both.select("a", "b").union(both.select("b", "a")).distinct(), "links", narrow=True)
    most = both.count()  # a node has a link, so no table of nodes has more rows
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels", narrow=True, rows=most)
    while True:
        # Both halves of a round are written: a plan that reads the first several times would repeat it as often.
        heard = materialize(_heard(labels, both), "heard", narrow=True, rows=most)
        new = materialize(_jumped(heard), "labels", narrow=True, rows=most)
        changed = new.where("label <> old").limit(1).count()
        drop_table(labels)
        drop_table(heard)
        labels = new.select("node", "label")
        if not changed:
            drop_table(both)
            return labels.withColumnRenamed("label", "class")


def _heard(labels: DataFrame, both: DataFrame) -> DataFrame:
    """(node, label, old): the least label at a node of labels(node, label) and its neighbours in both(a, b)."""
    near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).alias("old"))
    return labels.withColumn("old", F.col("label")).union(near).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))


def _jumped(heard: DataFrame) -> DataFrame:
    """heard(node, label, old) after each node's old label has heard the node's, and each node its label's label."""
    # What is told to the old label lets whole chains hook at once.
    told = heard.select(F.col("old").alias("node"), "label", F.lit(None).alias("old"))
    low = heard.union(told).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
    up = low.select(F.col("node").alias("label"), F.col("label").alias("up"))
    return low.join(up, "label", "left").select("node", F.least("label", "up").alias("label"), "old")
