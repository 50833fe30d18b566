"""Connected components of an edge table, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of every node of ``edges`` (a, b).

    Every round hooks each node's label to the smallest label next to it and
    then lets labels jump to their own labels, so that long chains take a
    logarithmic number of rounds. Rounds are written to the shared folder.
    A self-loop only names its node; an edge may repeat.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = stored(both.where("node <> other").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        far = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        hooked = labels.join(far, "node").select("node", "label", F.least("label", "near").alias("low"))
        # The old label's own node learns of the smaller label too.
        learned = hooked.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("told"))
        spread = hooked.join(learned, "node", "left").select("node", "label", F.least("low", F.coalesce("told", "low")).alias("low"))
        spread = stored(spread, "spread")
        up = spread.select(F.col("node").alias("low"), F.col("low").alias("up"))
        jumped = stored(spread.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("next"), "label"), "jumped")
        moved = jumped.where("next <> label").limit(1).count()
        discard(spread)
        discard(labels)
        labels = jumped.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
