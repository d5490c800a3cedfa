"""Connected components of a link table by least labels and pointer jumping, all in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """From (a, b): (node, comp) with the least node reachable, for every node of a link.

    Each round takes the least label over a node's links, then lets labels take their own label; a chain of n links
    needs a number of rounds that grows with log n. Rounds go on until no label moves, which ends as labels only fall.
    Only a flag reaches the driver. A link with a null end, and an empty table, give no node; repeated links count once.
    """
    links = links.select("a", "b").dropna()
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    held = labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        # Hook the old label's own node as well, so that whole trees move at once.
        hooked = lower.select(F.col("comp").alias("node"), "low").union(lower.select("node", "low")).groupBy("node").agg(F.min("low").alias("low"))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        stepped = hooked.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("low"))
        new = labels.join(stepped, "node").select("node", F.least("comp", "low").alias("new"), "comp")
        new = cut(new)
        moved = new.filter("new < comp").limit(1).count()
        discard(held)
        held, labels = new, new.select("node", F.col("new").alias("comp"))
        if not moved:
            discard(both)
            return labels
