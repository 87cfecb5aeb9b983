"""Greedy one-to-one matching inside groups, and the scores made of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit(left: Sequence, right: Sequence, accept: Callable[[object, object], bool]) -> list[tuple[int, int]]:
    """Each left element, in order, with the first right element that is free and accepted."""
    free, out = list(range(len(right))), []
    for i, x in enumerate(left):
        for k, j in enumerate(free):
            if accept(x, right[j]):
                out.append((i, j))
                del free[k]
                break
    return out


def greedy_pairs(candidates: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(keys, i, j, score): greedy one-to-one pairs of scored candidates (keys, i, j, score).

    Left elements go by rising i; each takes the free right element of smallest j whose score reaches the threshold.
    A group is one comparison of two functions, so it is bounded by what two functions hold.
    """
    schema = candidates.select(*keys, F.col("i").cast("bigint"), F.col("j").cast("bigint"), F.col("score").cast("double")).schema

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["score"] >= threshold].sort_values(["i", "j"], kind="stable")
        taken, keep, last = set(), [], None
        for at, i, j in zip(rows.index, rows["i"], rows["j"], strict=True):
            if i != last and j not in taken:
                keep.append(at)
                taken.add(j)
                last = i
        return rows.loc[keep, schema.names]

    return candidates.select(*schema.names).groupBy(*keys).applyInPandas(match, schema)


def function_scores(pairs: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score): matched right paths over the number of left paths, from pairs (keys, i, j) and totals (keys, n_left).

    Left paths count with their repeats, right paths once. A function without left paths is invalid and has no row.
    """
    n = pairs.groupBy(*keys).agg(F.countDistinct("j").alias("matched"))
    return totals.where("n_left > 0").join(n, list(keys), "left").select(*keys, (F.coalesce("matched", F.lit(0)) / F.col("n_left")).alias("score"))


def block_score(formulas: int, constraints: int, n_formulas: int, n_constraints: int, ratio: float = 1.0) -> float:
    """Matched formulas and constraints over those of the left block; 0 for an empty block."""
    total = n_formulas + ratio * n_constraints
    return (formulas + ratio * constraints) / total if total else 0.0


def compare_blocks(left: dict, right: dict, equal: Callable[[object, object], bool], mode: str = "both", ratio: float = 1.0) -> float:
    """Score of two blocks {formulas, constraints}; mode: both, formulas, constraints or first (first formula only)."""
    f = len(first_fit(left["formulas"], right["formulas"], equal)) if mode in ("both", "formulas") else 0
    c = len(first_fit(left["constraints"], right["constraints"], equal)) if mode in ("both", "constraints") else 0
    if mode == "first":
        return float(bool(left["formulas"] and right["formulas"]) and equal(left["formulas"][0], right["formulas"][0]))
    n_f = len(left["formulas"]) if mode in ("both", "formulas") else 0
    n_c = len(left["constraints"]) if mode in ("both", "constraints") else 0
    return block_score(f, c, n_f, n_c, ratio)


def least_distance_sum(left: Sequence, right: Sequence, distance: Callable[[object, object], float]) -> float:
    """Sum of each left tree's least distance to a right one; right trees at distance 0 are used once. -n if right is empty, -m if left is."""
    if not left or not right:
        return -float(len(left) + len(right))
    total, used = 0.0, set()
    for x in left:
        options = [(distance(x, y), j) for j, y in enumerate(right) if j not in used]
        if not options:
            options = [(distance(x, y), j) for j, y in enumerate(right)]
        d, j = min(options)
        total += d
        if d == 0:
            used.add(j)
    return total
