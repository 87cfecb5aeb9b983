"""Comparing two programs: gate, pairs of paths, formula equality, matching, scores, ranking."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions import expr_udfs
from kinmatch.functions.names import LIBRARY, Rules, normalised
from kinmatch.operators import pair_blocks, ranking, similarity


@dataclass(frozen=True)
class Comparison:
    """mode: ``formulas`` (equality under renamings) or ``trees`` (equal trees under renamings)."""

    mode: str = "formulas"
    gate: float = 0.01
    accept: float = 0.5
    unknown_is_equal: bool = True
    rules: Rules = LIBRARY


def _decider(p: Comparison):
    """Whether two formulas count as equal; too many variables count as a match at the threshold."""
    trees, accept, unknown = p.mode == "trees", p.accept, 1.0 if p.unknown_is_equal else 0.0

    def decide(a: str, b: str) -> bool:
        prove = expr_udfs.tree_equal if trees else expr_udfs.formula_equal
        v = prove.func(pd.Series([a]), pd.Series([b])).iloc[0]
        score = float(bool(v)) if trees else {"equal": 1.0, "too_many_vars": accept, "unknown": unknown}.get(v, 0.0)
        return score >= accept

    return decide


def _functions(features: DataFrame, paths: DataFrame, id_: str, rules: Rules) -> DataFrame:
    """A side as ``compared_blocks`` takes it: one row for each function that has a feature set."""
    name = normalised(F.array("name"), rules)
    memory = F.arrays_overlap(name, F.array(*[F.lit(x) for x in similarity.MEMORY_NAMES]))
    # names are alike if their normal forms are equal; equal names have equal forms
    path = F.struct(F.col("no").cast("bigint").alias("no"), F.when(F.col("name").isNotNull(), F.array_join(F.array_sort(name), "\x01")).alias("form"), memory.alias("memory"), "formula")
    own = paths.groupBy(id_).agg(F.collect_list(path).alias("paths"))
    form = features.where("feats is not null").select(id_, "feats", normalised(F.col("feats"), rules).alias("form"))
    sets = pair_blocks.feature_columns(form, id_, "feats", "form")
    return sets.join(own, id_, "left").withColumn("paths", F.coalesce("paths", F.array().cast(own.schema["paths"].dataType)))


def compared(features0: DataFrame, features1: DataFrame, paths0: DataFrame, paths1: DataFrame, p: Comparison = Comparison(), top: int | None = None) -> DataFrame:
    """(f0, f1, score, diff, solved, status) of the pairs that pass the gate.

    features are (f0 or f1, feats), paths (f0 or f1, no, name, formula): a path's number, last call and formula. Paths
    are compared if their last calls are alike; an unknown last call is like any. A worker decides equal formula pairs once.
    Functions without paths are invalid: their pairs have status ``invalid`` and no score. With ``top`` invalid pairs and
    such that can't be among the first so many of their f0 in ``ranked_comparison`` are left off where they are made.
    """
    n0, n1 = pair_blocks.blocks_of(features0), pair_blocks.blocks_of(features1)
    left, right = _functions(features0, paths0, "f0", p.rules), _functions(features1, paths1, "f1", p.rules)
    out = pair_blocks.compared_blocks(left, right, n0, n1, p.gate, _decider(p), f"{p.mode} {p.accept} {p.unknown_is_equal}", top)
    ok = F.col("score").isNotNull()
    return out.select("f0", "f1", "score", F.when(ok, 1 - F.col("gate")).alias("diff"), ok.alias("solved"), F.when(ok, "ok").otherwise("invalid").alias("status"))


def ranked_comparison(results: DataFrame, top: int | None = None) -> DataFrame:
    """The solved pairs ranked for each f0."""
    return ranking.ranked(results.where("solved"), top)
