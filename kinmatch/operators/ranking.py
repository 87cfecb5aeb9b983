"""Ranking candidates, and holding rankings against known answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, top: int | None = None) -> DataFrame:
    """scores (f0, f1, score, diff) with ``rank`` from 1: score falling, diff rising, then f1."""
    w = Window.partitionBy("f0").orderBy(F.col("score").desc(), F.col("diff").asc(), F.col("f1").asc())
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


def match_index(ranking: DataFrame, is_match: Column) -> DataFrame:
    """(f0, match_index): the last place, from 0, of a true counterpart in the ranking (f0, rank, ...); -1 if there is none."""
    return ranking.groupBy("f0").agg(F.coalesce(F.max(F.when(is_match, F.col("rank") - 1)), F.lit(-1)).cast("bigint").alias("match_index"))


def top_hits(indexes: DataFrame, tops: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row: how many functions have a counterpart, and for how many it is among the first n."""
    valid = F.col("match_index") >= 0
    return indexes.agg(F.count_if(valid).alias("valid"), *[F.count_if(valid & (F.col("match_index") < n)).alias(f"top{n}") for n in tops])


def false_negatives(solver: DataFrame, functions: DataFrame, is_self: Column) -> DataFrame:
    """One row: functions (f0) that are missing from their own results (f0, f1), and functions in all."""
    hit = solver.where(is_self).select("f0").distinct().withColumn("hit", F.lit(1))
    return functions.select("f0").distinct().join(hit, "f0", "left").agg(F.count_if(F.col("hit").isNull()).alias("n_missed"), F.count("*").alias("n_total"))


def best_partner(scores: DataFrame) -> DataFrame:
    """Per f0 the partner of greatest score; among equal ones of least diff, then of smallest f1."""
    best = F.max_by(F.struct("f1", "score", "diff"), F.struct("score", -F.col("diff"), -F.col("f1")))
    return scores.groupBy("f0").agg(best.alias("b")).select("f0", "b.*")


def caller_score(callers0: DataFrame, callers1: DataFrame, scores: DataFrame, pairs: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(f0, f1, score, diff) of pairs (f0, f1) by their callers.

    callers0 and callers1 are (node, caller, depth); scores (f0, f1, score, diff) compare callers. Each caller of f0 counts
    with its best partner among f1's callers, weakened by gamma for every step beyond the first; the mean over all callers
    of f0 is the score, the difference in the number of callers is diff. Pairs whose f0 has no caller have no row.
    """
    n0 = callers0.groupBy(F.col("node").alias("f0")).agg(F.count("*").alias("n0"))
    n1 = callers1.groupBy(F.col("node").alias("f1")).agg(F.count("*").alias("n1"))
    a = callers0.select(F.col("node").alias("f0"), F.col("caller").alias("c0"), "depth")
    b = callers1.select(F.col("node").alias("f1"), F.col("caller").alias("c1"))
    known = scores.select(F.col("f0").alias("c0"), F.col("f1").alias("c1"), "score", "diff")
    best = pairs.select("f0", "f1").join(a, "f0").join(known, "c0").join(b, ["f1", "c1"])
    best = best.groupBy("f0", "f1", "c0", "depth").agg(F.max("score").alias("s"))
    total = best.groupBy("f0", "f1").agg(F.sum(F.col("s") * F.pow(F.lit(gamma), F.col("depth") - 1)).alias("total"))
    out = pairs.select("f0", "f1").join(n0, "f0").join(n1, "f1", "left").join(total, ["f0", "f1"], "left")
    return out.select("f0", "f1", (F.coalesce("total", F.lit(0.0)) / F.col("n0")).alias("score"), F.abs(F.col("n0") - F.coalesce("n1", F.lit(0))).alias("diff"))


def path_score(lcs: DataFrame) -> DataFrame:
    """(f0, f1, score): summed alignment over summed length of the compared paths (f0, f1, lcs, length)."""
    return lcs.groupBy("f0", "f1").agg((F.sum("lcs") / F.sum("length")).alias("score"))
