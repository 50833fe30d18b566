"""Connected components of links that lie in tiles, and numbers for rows of any number."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orogen import scratch


def components(links: DataFrame, u: str, v: str, tile: list[str]) -> DataFrame:
    """``links`` with ``component``, equal for links that hang together by their nodes ``u`` and ``v`` (long).

    Each tile's links are labelled in one call. Labels that meet at a node of
    several tiles are links again, one for a few thousand, and are contracted.
    No links give none.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([pdf[u], pdf[v]]), return_inverse=True)
        a, b = at[: len(pdf)], at[len(pdf) :]
        low = np.arange(len(nodes))
        while True:
            near, new = np.minimum(low[a], low[b]), low.copy()
            np.minimum.at(new, low[a], near)
            np.minimum.at(new, low[b], near)
            while (new[new] != new).any():
                new = new[new]
            if (new == low).all():
                return pdf.assign(component=nodes[low[a]])
            low = new

    own = scratch.stored(links.groupBy(*tile).applyInPandas(label, StructType([*links.schema.fields, StructField("component", LongType())])), "tiles")
    ends = own.select(F.explode(F.array(u, v)).alias("node"), "component").distinct()
    low = F.min("component").over(Window.partitionBy("node"))
    across = ends.select(F.col("component").alias("a"), low.alias("b")).where("a <> b").distinct()
    roots = _contracted(across)
    if roots is None:
        return own
    return own.join(roots, own["component"] == roots["name"], "left").withColumn("component", F.coalesce("root", "component")).drop("name", "root")


def _contracted(edges: DataFrame) -> DataFrame | None:
    """(name, root) of the nodes of ``edges`` (a, b); None without edges.

    Every node takes the name of its neighbour, or itself, that is first in a
    random order of the round: about half the names are left after it.
    """
    edges, names, turn = scratch.stored(edges, "across"), None, 0
    while edges.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("order"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        chosen = scratch.stored(best.select(F.col("a").alias("node"), F.least("near", rank("a"))["to"].alias("to")), "names")
        if names is None:
            names = chosen.select(F.col("node").alias("name"), F.col("to").alias("root"))
        else:
            names = scratch.stored(names.join(chosen, names["root"] == chosen["node"], "left").select("name", F.coalesce("to", "root").alias("root")), "roots")
        a, b = (chosen.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in "ab")
        edges = scratch.stored(edges.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct(), "across")
        turn += 1
    return names


def numbered(df: DataFrame, keys: list[str], name: str, after: Column) -> DataFrame:
    """``df`` with ``name``: ``after`` plus 1, 2, ... in the order of ``keys``, whose values differ; ranges are numbered apart."""
    dealt = scratch.stored(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each range.
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return dealt.join(sizes.select("__part", before.alias("__before")), "__part").withColumn(name, (after + F.col("__before") + place).cast("long")).drop("__part", "__before")
