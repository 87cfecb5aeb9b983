"""Set similarity of entities of two collections.

Candidates come from an inverted index: both sides are exploded to features and
joined on them, so only pairs that share a feature exist, and counts are
combined before they are shuffled. The smaller side is broadcast behind a check
of its size; beyond it the join shuffles both sides by feature and adaptive
execution splits frequent ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.names import LIBRARY, Rules, normalised
from kinmatch.functions.scalars import counts_alike, jaccard_of_counts
from kinmatch.storage import small_enough

#: Feature rows that may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 500_000


def tokens(text) -> "F.Column":
    """The distinct tokens of a text, split at single spaces; empty ones don't count."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " ", -1), lambda t: t != ""))


def jaccard_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(f0, f1, common, n0, n1, score) of all pairs of left (f0, feats) and right (f1, feats) that share a feature.

    Set sizes travel with the features, so each side is read once and the only shuffle is that of counts already
    combined in each task.
    """
    # sizes are taken before, not beside, the explosion: beside it, each row would carry its whole set along
    a = left.select("f0", F.size("feats").alias("n0"), "feats").select("f0", "n0", F.explode("feats").alias("feat"))
    b = right.select("f1", F.size("feats").alias("n1"), "feats").select("f1", "n1", F.explode("feats").alias("feat"))
    if small_enough(a, BROADCAST_ROWS):
        a = F.broadcast(a)
    elif small_enough(b, BROADCAST_ROWS):
        b = F.broadcast(b)
    pairs = a.join(b, "feat").groupBy("f0", "f1", "n0", "n1").agg(F.count("*").alias("common"))
    return pairs.select("f0", "f1", "common", "n0", "n1", jaccard_of_counts(F.col("common"), F.col("n0"), F.col("n1")).alias("score"))


def gated_pairs(left: DataFrame, right: DataFrame, rules: Rules = LIBRARY, threshold: float = 0.01) -> DataFrame:
    """(f0, f1, score) of the pairs that pass the gate, from raw feature sets (id, feats).

    Sets are compared in normalised form. If one of them only is empty in that form, the raw sets are compared; if both
    are, they count as equal, unless both raw sets are empty: such pairs never pass.
    """
    a = left.select("f0", "feats", normalised(F.col("feats"), rules).alias("form"))
    b = right.select("f1", "feats", normalised(F.col("feats"), rules).alias("form"))
    a = a.withColumn("none", F.size("form") == 0).withColumn("bare", F.size("feats") == 0)
    b = b.withColumn("none", F.size("form") == 0).withColumn("bare", F.size("feats") == 0)
    raw = lambda side, want: side.where(F.col("none") == want).select(side.columns[0], "feats")
    usual = jaccard_pairs(a.where("not none").select("f0", F.col("form").alias("feats")), b.where("not none").select("f1", F.col("form").alias("feats")))
    mixed = jaccard_pairs(raw(a, True), raw(b, False)).unionByName(jaccard_pairs(raw(a, False), raw(b, True)))
    empty = a.where("none").select("f0", F.col("bare").alias("bare0"), "none").join(b.where("none").select("f1", F.col("bare").alias("bare1"), "none"), "none").where("not (bare0 and bare1)")
    out = usual.unionByName(mixed).select("f0", "f1", "score").unionByName(empty.select("f0", "f1", F.lit(1.0).alias("score")))
    return out.where(F.col("score") >= threshold)


def pairs_of_like_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(f0, f1, n0, n1) of the pairs (id, n) that pass the count gate.

    Counts are grouped first, so the gate is decided once for each pair of counts; the pairs themselves are the result.
    """
    n0, n1 = left.select(F.col("n").alias("n0")).distinct(), right.select(F.col("n").alias("n1")).distinct()
    alike = n0.join(n1, counts_alike(F.col("n0"), F.col("n1")))
    return left.withColumnRenamed("n", "n0").join(alike, "n0").join(right.withColumnRenamed("n", "n1"), "n1").select("f0", "f1", "n0", "n1")


#: Names that work on memory alike: any of them matches any other.
MEMORY_NAMES = (".malloc", ".memset", ".calloc")


def similar_ends(left: DataFrame, right: DataFrame, rules: Rules = LIBRARY) -> DataFrame:
    """(i, j) of paths (i, name) and (j, name) whose last calls are alike.

    Alike are equal names, names of equal normalised sets, two names that both touch memory, and an unknown (null) name
    with any other. Each condition is an equi-join; the unknown ones are joined with a constant.
    """
    memory = F.array(*[F.lit(x) for x in MEMORY_NAMES])

    def keys(side: DataFrame, id_: str) -> DataFrame:
        form = F.array_sort(normalised(F.array("name"), rules))
        k = F.array(F.concat(F.lit("="), F.col("name")), F.concat(F.lit("~"), F.array_join(form, "\x01")), F.when(F.arrays_overlap(form, memory), F.lit("memory")))
        return side.where("name is not null").select(id_, F.explode(F.array_compact(k)).alias("k"))

    known = keys(left, "i").join(keys(right, "j"), "k").select("i", "j").distinct()
    any_left = left.where("name is null").select("i", F.lit(1).alias("k")).join(right.select("j", F.lit(1).alias("k")), "k").select("i", "j")
    any_right = left.where("name is not null").select("i", F.lit(1).alias("k")).join(right.where("name is null").select("j", F.lit(1).alias("k")), "k").select("i", "j")
    return known.unionByName(any_left).unionByName(any_right)
