from __future__ import annotations

import random

import pytest

from kinmatch.functions.names import LIBRARY
from kinmatch.operators import similarity as sim
from tests.conftest import rows


def gate(spark, a, b):
    left = spark.createDataFrame([(0, a)], "f0 int, feats array<string>")
    right = spark.createDataFrame([(1, b)], "f1 int, feats array<string>")
    out = sim.gated_pairs(left, right, LIBRARY).collect()
    assert len(out) <= 1
    return out[0]["score"] if out else None


@pytest.mark.parametrize("a, b, expected", [([], [], None), ([".free"], [".strcmp"], 1.0), ([".free"], [".free", ".printf"], 0.5), ([".free"], [], 1.0), ([".printf"], [".malloc"], None), ([".printf", ".malloc"], [".__printf_chk"], 0.5)])
def test_gate(spark, a, b, expected):
    assert gate(spark, a, b) == expected


def test_pairs_match_brute_force(spark):
    r = random.Random(4)
    sets = {k: [(i, sorted({r.choice("abcdefghijk") for _ in range(r.randrange(6))})) for i in range(25)] for k in "xy"}
    got = sim.jaccard_pairs(spark.createDataFrame(sets["x"], "f0 int, feats array<string>"), spark.createDataFrame(sets["y"], "f1 int, feats array<string>"))
    expected = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in sets["x"] for j, b in sets["y"] if set(a) & set(b)}
    assert {(g["f0"], g["f1"]): g["score"] for g in got.collect()} == pytest.approx(expected)


def test_similar_ends(spark):
    left = spark.createDataFrame([(0, ".printf"), (1, None), (2, ".malloc"), (3, ".open")], "i int, name string")
    right = spark.createDataFrame([(0, ".__printf_chk"), (1, ".calloc"), (2, None), (3, ".free"), (4, ".open64")], "j int, name string")
    got = set(rows(sim.similar_ends(left, right)))
    assert got == {(0, 0), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 2), (3, 4)}


def test_empty_sides(spark):
    left = spark.createDataFrame([], "f0 int, feats array<string>")
    right = spark.createDataFrame([(1, ["a"])], "f1 int, feats array<string>")
    assert sim.gated_pairs(left, right).count() == 0
    counts = sim.pairs_of_like_counts(spark.createDataFrame([(1, 0), (2, 9)], "f0 int, n int"), spark.createDataFrame([(7, 3), (8, 4)], "f1 int, n int"))
    assert rows(counts) == [(1, 7, 0, 3)]
