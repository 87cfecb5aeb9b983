"""Comparing functions by their paths: each path of the left one is aligned with the right one's graph.

Blocks are compared first, each distinct pair of contents once; paths then only look verdicts up.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions import exprs as x
from kinmatch.operators import matching, paths, ranking
from kinmatch.operators.alignment import ROOT, align

#: Difference of a pair that isn't worth comparing.
INVALID_DIFFERENCE = 100_000


@dataclass(frozen=True)
class PathComparison:
    """mode: what a path's steps are and how they count.

    ``blocks``: single blocks, valid if they have formulas; each counts 1, and the difference is 0.
    ``segments``: runs of blocks, valid if they have formulas or constraints, that count with their blocks; at most
    ``most_sampled`` paths are taken; the difference is that of the graphs' sizes.
    ``prefixes``: a step stands for the path up to it; nothing matches before the first valid one, and all steps count
    in the length; functions of more than ``most_prefixed`` paths aren't compared: score 0 and INVALID_DIFFERENCE.
    """

    mode: str = "blocks"
    gate: float = 0.01
    accept: float = 0.5
    most_sampled: int = 100
    most_prefixed: int = 20
    constraints_ratio: float = 1.0
    unknown_is_equal: bool = True


def _block_scores(p: PathComparison):
    """Score of two blocks' contents; a block without any scores 0."""

    @F.pandas_udf(T.DoubleType())
    def score(f0: pd.Series, c0: pd.Series, f1: pd.Series, c1: pd.Series) -> pd.Series:
        known: dict = {}

        def equal(a: str, b: str) -> bool:
            if (a, b) not in known:
                try:
                    verdict = x.prove_equal(x.parsed(a), x.parsed(b))
                except x.TooManyVariables:
                    verdict = "different"
                known[a, b] = verdict == "equal" or verdict == "unknown" and p.unknown_is_equal
            return known[a, b]

        def one(*parts) -> float:
            a, b, c, d = map(list, parts)
            left, right = {"formulas": a, "constraints": b}, {"formulas": c, "constraints": d}
            if p.mode != "prefixes":
                return matching.compare_blocks(left, right, equal, "both", p.constraints_ratio)
            # the first formula decides; without one, the constraints must all be matched
            return matching.compare_blocks(left, right, equal, "first") if a else float(bool(b) and len(b) == len(d) == len(matching.first_fit(b, d, equal)))

        return pd.Series([one(*row) for row in zip(f0, c0, f1, c1, strict=True)], dtype="float64")

    return score


def _aligned(steps: DataFrame, facts: DataFrame, p: PathComparison) -> DataFrame:
    """(f0, f1, path_no, lcs, length) from steps and facts: edges (kind 0) and equal blocks (kind 1)."""
    ids = ", ".join(f"{c} {steps.schema[c].dataType.simpleString()}" for c in ("f0", "f1"))
    weighted = p.mode != "blocks"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        children: dict = {}
        same: set = set()
        for kind, a, b in zip(right["kind"], right["a"], right["b"], strict=True):
            if kind:
                same.add((a, b))
            else:
                children.setdefault(ROOT if a == "0" else a, []).append(b)
        for c in children.values():
            c.sort()
        out = []
        for number, part in left.sort_values(["path_no", "pos"]).groupby("path_no") if len(left) else []:
            valid = part["valid"].tolist()
            if True not in valid:
                continue
            blocks = list(zip(part["block"], part["weight"], strict=True))
            weight = (lambda b: int(b[1])) if weighted else lambda _: 1
            score, _ = align(blocks, children, lambda b, node: (b[0], node) in same, weight, first=valid.index(True))
            out.append((part["f0"].iloc[0], part["f1"].iloc[0], number, score, sum(weight(b) for b in blocks)))
        return pd.DataFrame(out, columns=["f0", "f1", "path_no", "lcs", "length"])

    other = facts.select(F.col("f0").alias("_f0"), F.col("f1").alias("_f1"), "kind", "a", "b")
    return steps.groupBy("f0", "f1").cogroup(other.groupBy("_f0", "_f1")).applyInPandas(run, f"{ids}, path_no bigint, lcs bigint, length bigint")


def compared_paths(pairs: DataFrame, paths0: DataFrame, paths1: DataFrame, graph0: DataFrame, graph1: DataFrame, blocks0: DataFrame, blocks1: DataFrame, p: PathComparison = PathComparison()) -> DataFrame:
    """(f0, f1, score, diff, solved, status) of pairs (f0, f1, score) of functions, whose score is that of the gate.

    The gate holds in all modes but ``blocks``; pairs that fail it have no row. Of program i, paths (fi, path_no, pos,
    block, weight) count the blocks of a step as its weight, graphs (fi, src, dst) begin at "0", and blocks (fi, block,
    formulas, constraints) hold the contents. A left function without a valid path is invalid: no score.
    """
    pairs = (pairs if p.mode == "blocks" else pairs.where(F.col("score") >= p.gate)).select("f0", "f1").distinct()
    n0, n1 = paths0.groupBy("f0").agg(F.countDistinct("path_no").alias("n0")), paths1.groupBy("f1").agg(F.countDistinct("path_no").alias("n1"))
    pairs = pairs.join(n0, "f0", "left").join(n1, "f1", "left")
    too_many = F.lit(p.mode == "prefixes") & F.coalesce(F.greatest("n0", "n1") > p.most_prefixed, F.lit(False))
    pairs = pairs.select("f0", "f1", too_many.alias("too_many"))
    going = pairs.where("not too_many").select("f0", "f1")

    if p.mode == "segments":
        whole = paths0.groupBy("f0", "path_no").agg(F.to_json(F.sort_array(F.collect_list(F.struct("pos", "block")))).alias("path"))
        paths0 = paths0.join(paths.sampled(whole, ["f0"], F.col("path"), p.most_sampled).select("f0", "path_no"), ["f0", "path_no"], "left_semi")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    has = size("formulas") > 0 if p.mode == "blocks" else size("formulas") + size("constraints") > 0
    good = blocks0.where(has).select("f0", "block", F.lit(True).alias("valid"))
    steps = paths0.select("f0", "path_no", "pos", "block", "weight").join(good, ["f0", "block"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    if p.mode != "prefixes":
        steps = steps.where("valid")

    texts = lambda c, name: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(name)  # noqa: E731  contents are joined on: never null
    left = steps.where("valid").select("f0", F.col("block").alias("a")).distinct().join(blocks0.select("f0", F.col("block").alias("a"), texts("formulas", "l0"), texts("constraints", "l1")), ["f0", "a"])
    right = graph1.select("f1", F.col("dst").alias("b")).distinct().join(blocks1.select("f1", F.col("block").alias("b"), texts("formulas", "r0"), texts("constraints", "r1")), ["f1", "b"])
    meet = going.join(left, "f0").join(right, "f1")
    contents = ["l0", "l1", "r0", "r1"]
    known = meet.select(*contents).distinct().withColumn("s", _block_scores(p)(*contents)).where(F.col("s") >= p.accept)
    equal = meet.join(known, contents, "left_semi")
    facts = going.join(graph1, "f1").select("f0", "f1", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(equal.select("f0", "f1", F.lit(1).alias("kind"), "a", "b"))
    scores = ranking.path_score(_aligned(going.join(steps, "f0"), facts, p))

    out = pairs.join(scores, ["f0", "f1"], "left")
    difference = F.lit(0)
    if p.mode != "blocks":
        nodes = lambda g, f, n: g.select(f, F.explode(F.array("src", "dst")).alias("node")).groupBy(f).agg(F.countDistinct("node").alias(n))
        out = out.join(nodes(graph0, "f0", "nodes0"), "f0", "left").join(nodes(graph1, "f1", "nodes1"), "f1", "left")
        difference = F.abs(F.coalesce("nodes1", F.lit(1)) - F.coalesce("nodes0", F.lit(1)))
    score = F.when(F.col("too_many"), 0.0).otherwise(F.col("score"))
    diff = F.when(F.col("too_many"), INVALID_DIFFERENCE).when(F.col("score").isNotNull(), difference).cast("double")
    solved = F.col("score").isNotNull()
    return out.select("f0", "f1", score.alias("score"), diff.alias("diff"), solved.alias("solved"), F.when(F.col("too_many"), "too_hard").when(solved, "ok").otherwise("invalid").alias("status"))
