"""Connected components of a table of links, by hooking to smaller labels and pointer jumping.

Each round every node takes the least label among its neighbours' labels, then its label's
own label; rounds end when nothing changes. Links stay in tables; what reaches the driver is
one count a round. A hub's links are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the least node reachable, for every node of ``links`` (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.table(both.filter("a <> b").distinct())
    now = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        labels = now.select(F.col("node").alias("of"), F.col("label").alias("other"))
        # the least label next to each node; the same for the node it hangs from
        near = both.join(labels, F.col("b") == F.col("of")).groupBy(F.col("a").alias("node")).agg(F.min("other").alias("label"))
        hung = near.withColumnRenamed("label", "via").join(now, "node").select(F.col("label").alias("node"), F.col("via").alias("label"))
        hooked = scratch.table(
            now.unionByName(near.select("node", "label")).unionByName(hung).groupBy("node").agg(F.min("label").alias("label"))
        )
        up = hooked.select(F.col("node").alias("of"), F.col("label").alias("above"))
        jumped = scratch.table(
            hooked.join(up, F.col("label") == F.col("of"), "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"))
        )
        old = now.select(F.col("node").alias("of"), F.col("label").alias("before"))
        changed = jumped.join(old, F.col("node") == F.col("of")).filter("label <> before").limit(1).count()
        scratch.drop(now, hooked)
        now = jumped
        if not changed:
            return now
