from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.operators import alignment, matching, merge, ranking
from tests.conftest import rows


@given(st.lists(st.integers(0, 4), max_size=8), st.lists(st.integers(0, 4), max_size=8))
def test_first_fit_is_one_to_one(a, b):
    got = matching.first_fit(a, b, lambda x, y: x == y)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert all(a[i] == b[j] for i, j in got)
    assert len(got) == sum(min(a.count(x), b.count(x)) for x in set(a))  # equality: greedy is optimal


def test_greedy_pairs(spark):
    c = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.9), (1, 1, 0, 0.9), (1, 2, 1, 0.4), (1, 3, 1, 0.5), (2, 0, 0, 0.1)], "k int, i int, j int, score double")
    assert rows(matching.greedy_pairs(c, ["k"])) == [(1, 0, 0, 0.9), (1, 3, 1, 0.5)]
    totals = spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "k int, n_left int")
    assert rows(matching.function_scores(matching.greedy_pairs(c, ["k"]), totals, ["k"])) == [(1, 0.5), (2, 0.0)]


def test_block_scores():
    same = lambda a, b: a == b
    left, right = {"formulas": [1, 2], "constraints": [3]}, {"formulas": [2, 2], "constraints": [3]}
    assert matching.compare_blocks(left, right, same) == pytest.approx(2 / 3)
    assert matching.compare_blocks(left, right, same, "formulas") == 0.5
    assert matching.compare_blocks(left, right, same, "constraints") == 1.0
    assert matching.compare_blocks(left, right, same, "first") == 0.0
    assert matching.compare_blocks({"formulas": [], "constraints": []}, right, same) == 0.0
    assert matching.least_distance_sum([1, 5], [1, 4], lambda x, y: abs(x - y)) == 1 and matching.least_distance_sum([], [1], lambda x, y: 0) == -1


def test_alignment_keeps_or_fixes_lost_scores():
    path = [("a", 10), ("b", 1)]
    args = (path, {0: ["X"]}, lambda b, n: True, lambda b: b[1])
    assert alignment.align(*args)[0] == 1
    assert alignment.align(*args, best=True)[0] == 10


def test_alignment_traceback():
    score, steps = alignment.align("abc", {0: ["a"], "a": ["x"], "x": ["c"], "c": []}, lambda b, n: b == n)
    assert score == 2
    assert [s[0] for s in steps] == ["MATCH", "SKIP", "NO-MATCH", "MATCH"] or [s[0] for s in steps].count("MATCH") == 2
    assert alignment.align("abc", {0: []}, lambda b, n: True) == (0, [])


@settings(max_examples=60)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_alignment_with_a_chain_is_the_longest_common_subsequence(a, b):
    nodes = {0: [1] if b else []} | {i: [i + 1] if i < len(b) else [] for i in range(1, len(b) + 1)}
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
    assert alignment.align(a, nodes, lambda x, n: x == b[n - 1], best=True)[0] == lcs[-1][-1]


def test_rank_and_match_index(spark):
    s = spark.createDataFrame([(1, 10, 0.5, 0.3), (1, 11, 0.9, 0.4), (1, 12, 0.5, 0.1)], "f0 int, f1 int, score double, diff double")
    assert [r["f1"] for r in ranking.ranked(s).orderBy("rank").collect()] == [11, 12, 10]
    names = spark.createDataFrame([(1, "x", 1), (1, "f", 2), (1, "y", 3), (1, "f", 4), (2, "x", 1)], "f0 int, name string, rank int")
    idx = ranking.match_index(names, F.col("name") == "f")
    assert rows(idx) == [(1, 3), (2, -1)]
    hits = spark.createDataFrame([(1, 0), (2, 2), (3, 4), (4, -1)], "f0 int, match_index int")
    assert tuple(ranking.top_hits(hits).first()) == (3, 1, 2, 3)


def test_caller_score(spark):
    a = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "node int, caller int, depth int")
    b = spark.createDataFrame([(2, 21, 1), (2, 22, 1), (2, 23, 1)], "node int, caller int, depth int")
    s = spark.createDataFrame([(11, 21, 0.8, 0.0), (11, 22, 0.1, 0.0), (12, 22, 0.5, 0.0)], "f0 int, f1 int, score double, diff double")
    out = ranking.caller_score(a, b, s, spark.createDataFrame([(1, 2), (1, 3)], "f0 int, f1 int"))
    assert {(r["f0"], r["f1"]): (round(r["score"], 6), r["diff"]) for r in out.collect()} == {(1, 2): (0.625, 1), (1, 3): (0.0, 2)}


def test_merge(spark):
    solver = spark.createDataFrame([("f", "f", 0.9), ("f", "g", 0.3), ("f", "h", 0.1), ("f", "k", 0.4), ("only", "x", 0.9)], "f string, g string, score double")
    second = spark.createDataFrame([("f", "g", 0.8, 0), ("f", "x", 0.7, 1), ("f", "f", 0.6, 2), ("z", "b", 0.1, 0), ("z", "a", 0.9, 1)], "f string, g string, score double, pos int")
    got = [tuple(r)[1:] for r in merge.merged(solver, second).where("f = 'f'").orderBy("rank").collect()]
    assert got == [("f", 0.9, 0.6, 1), ("k", 0.4, 0.0, 2), ("g", 0.3, 0.8, 3), ("x", 0.0, 0.7, 4)]
    assert [tuple(r)[1:] for r in merge.merged(solver, second).where("f = 'z'").orderBy("rank").collect()] == [("b", None, 0.1, 1), ("a", None, 0.9, 2)]
    assert merge.merged(solver, second).where("f = 'only'").count() == 0
    missed = ranking.false_negatives(solver.withColumnRenamed("f", "f0"), solver.select(F.col("f").alias("f0")), F.col("f0") == F.col("g"))
    assert tuple(missed.first()) == (1, 2)
