"""Merging a solver's results with the ranking of a second method."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(solver: DataFrame, second: DataFrame, insert_from: float = 0.29, insert: bool = True) -> DataFrame:
    """(f, g, use_score, second_score, rank) from solver (f, g, score) and second (f, g, score, pos).

    Functions that both have: second's rows with the solver's score or 0, and the solver's other rows from ``insert_from``
    on with a second score of 0, by both scores falling. Functions that only second has keep its order, with a null solver
    score. Functions that only the solver has are left out.
    """
    a = solver.select("f", "g", F.col("score").alias("use"))
    b = second.select("f", "g", F.col("score").alias("other"), "pos")
    in_solver = solver.select("f").distinct().withColumn("known", F.lit(True))
    own = b.join(a, ["f", "g"], "left").join(in_solver, "f", "left")
    rows = own.select("f", "g", F.when(F.col("known"), F.coalesce("use", F.lit(0.0))).alias("use_score"), F.col("other").alias("second_score"), F.col("pos").cast("bigint").alias("pos"))
    if insert:
        more = a.where(F.col("use") >= insert_from).join(b.select("f", "g"), ["f", "g"], "left_anti").join(b.select("f").distinct(), "f", "left_semi")
        rows = rows.unionByName(more.select("f", "g", F.col("use").alias("use_score"), F.lit(0.0).alias("second_score"), F.lit(None).cast("bigint").alias("pos")))
    # unknown functions keep their order: their use_score is null for all rows, so second's position decides
    w = Window.partitionBy("f").orderBy(F.col("use_score").desc_nulls_last(), F.when(F.col("use_score").isNotNull(), F.col("second_score")).desc_nulls_last(), F.col("pos").asc_nulls_last(), F.col("g").asc())
    return rows.select("f", "g", "use_score", "second_score", F.row_number().over(w).cast("bigint").alias("rank"))
