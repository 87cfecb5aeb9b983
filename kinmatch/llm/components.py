"""Connected components by alternating large-star and small-star rounds.

Each round is two pre-aggregated minimums and two joins on the node, so neither
a large component nor a node with very many links meets in one task; rounds are
cut by tables in shared storage, each written and summed up in one query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.shared import observed


def stars(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node with a smaller one in its component; root is the smallest. A written table.

    ``links`` has the bigint columns a and b, without nulls, and is read several times; loops and repeated links do no harm.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    state = None
    for k in range(1, 200):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # m <= u < v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges, now = observed(small, f"{folder}/links-{k}", rows=F.count("*"), digest=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if now == state or not now["rows"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node that has a link to another; see ``stars``."""
    found = stars(links, folder)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
