"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each end of a link (u, v): the smallest node that it reaches.

    A round takes the least label among a node and its neighbours, then the
    label of that label, so chains shrink by a factor each round. Rounds go to
    the shared folder; the driver sees only the count of changes. Links are
    taken once, in both directions; an empty table gives no rows."""
    both = stored(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    now = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = both.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        least = now.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        jump = now.select(F.col("node").alias("least"), F.col("label").alias("far"))
        then = stored(least.join(jump, "least").select("node", F.least("least", "far").alias("label"), (F.least("least", "far") < F.col("label")).alias("moved")))
        still = then.where("moved").count() == 0
        forget(now)
        now = then
        if still:
            forget(both)
            return now.select("node", "label")
