"""Operators over ordered traces: rows of (keys..., order columns, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(steps: DataFrame, keys: Sequence[str], order: Sequence[str], boundary: Column, item: str) -> DataFrame:
    """(keys, seg_no, n_blocks, items): traces cut after each boundary.

    What follows the last boundary is dropped; a trace without a boundary keeps its first item only.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    every = Window.partitionBy(*keys)
    marked = steps.withColumn("_b", F.coalesce(boundary, F.lit(False)).cast("int"))
    numbered = marked.select(*keys, F.col(item).alias("_item"), F.row_number().over(w).alias("_pos"), (F.sum("_b").over(w) - F.col("_b")).alias("seg_no"), F.sum("_b").over(every).alias("_all"))
    kept = numbered.where("seg_no < _all or (_all = 0 and _pos = 1)")
    out = kept.groupBy(*keys, "seg_no").agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_s"))
    return out.select(*keys, F.col("seg_no").cast("bigint").alias("seg_no"), F.size("_s").cast("bigint").alias("n_blocks"), F.transform("_s", lambda s: s["_item"]).alias("items"))


def segment_edges(segs: DataFrame, keys: Sequence[str], node: Column) -> DataFrame:
    """(src, dst): the graph of consecutive segments; a trace's first segment hangs below the root, '0'."""
    w = Window.partitionBy(*keys).orderBy("seg_no")
    named = segs.select(*keys, "seg_no", node.alias("dst"))
    return named.select(F.coalesce(F.lag("dst").over(w), F.lit("0")).alias("src"), "dst").distinct()


def segment_lengths(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_segments, length): blocks of all segments of a trace."""
    return segs.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.sum("n_blocks").alias("length"))


def enclosing(points: DataFrame, starts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For every point the last start at or before it, by one sort of both: (keys, order of the point, found struct).

    This joins each point with the interval [start, next start) that holds it; points before the first start have none.
    """
    a = points.select(*keys, *order, F.lit(1).alias("_kind"), F.lit(None).cast(starts.select(F.struct(*order)).schema[0].dataType).alias("_start"))
    b = starts.select(*keys, *order, F.lit(0).alias("_kind"), F.struct(*order).alias("_start"))
    w = Window.partitionBy(*keys).orderBy(*order, "_kind")
    both = a.unionByName(b).withColumn("found", F.last("_start", ignorenulls=True).over(w))
    return both.where("_kind = 1 and found is not null").select(*keys, *order, "found")


def running_offsets(sizes: DataFrame, keys: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """(keys, pos, offset): running sums of sizes from the last to the first."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return sizes.select(*keys, F.row_number().over(w).cast("bigint").alias("pos"), F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("offset"))


def longest_wins(lists: DataFrame, key: str, source: str, length: str, payload: Sequence[str]) -> DataFrame:
    """Per key the row of greatest length; among equal ones that of the smallest source."""
    best = F.max_by(F.struct(source, length, *payload), F.struct(F.col(length), -F.col(source)))
    return lists.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def sampled(paths: DataFrame, keys: Sequence[str], path: Column, n: int) -> DataFrame:
    """At most n rows of each key, by the MD5 of the path: a sample that is the same everywhere."""
    w = Window.partitionBy(*keys).orderBy(F.md5(path), path)
    return paths.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
