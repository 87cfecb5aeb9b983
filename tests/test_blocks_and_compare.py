from __future__ import annotations

from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinmatch import model
from kinmatch.operators import blocks, graph
from kinmatch.plans import compare, path_modes
from tests.conftest import rows

FORMULA = f"STRUCT<lhs: STRING, nodes: ARRAY<{model.NODE}>>"


def node(op, *args, value=None, name=None, width=64):
    return (op, width, list(args), None if value is None else Decimal(value), name)


def test_formula_filters(spark):
    one = [("a", [node("BVS", name="reg_rax_1_64")]), ("b", [node("BVS", name="x"), node("Extract", 0)]), ("c", [node("BVS", name="x"), node("BVV", value=1), node("__add__", 0, 1)])]
    df = spark.createDataFrame([(one,)], f"f ARRAY<{FORMULA}>")
    names = lambda c: [x["lhs"] for x in df.select(c.alias("f")).first()["f"]]
    assert names(blocks.without_assignments(F.col("f"))) == ["c"]
    assert names(blocks.without_bare_targets(F.col("f"))) == ["b", "c"]
    c = spark.createDataFrame([([[node("BVV", value=1, width=0)], [node("BVS", name="rip")], [node("BVS", name="x")]],)], f"c ARRAY<ARRAY<{model.NODE}>>")
    assert len(c.select(blocks.valid_constraints(F.col("c"), ["rip"])).first()[0]) == 1


def test_block_graph_and_bypass(spark):
    b = spark.createDataFrame([(0, [10], False, False, None), (10, [99], True, False, 20), (20, [30], False, True, None), (30, [], False, False, None)], "block bigint, succs array<bigint>, is_call boolean, is_return boolean, return_to bigint")
    assert rows(blocks.block_graph(b)) == [(0, 10), (10, 20)]
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src bigint, dst bigint")
    spans = spark.createDataFrame([(0, 0, 5), (1, 5, 20), (2, 10, 20), (3, 20, 30)], "block bigint, lo bigint, hi bigint")
    assert rows(blocks.bypassed(edges, spans)) == [(0, 2), (2, 3)]


def test_function_paths(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i, i == 3) for i in range(4)], "node bigint, is_call boolean")
    paths, status = blocks.function_paths(nodes, edges, 0)
    assert status == "ok" and sorted(r["path"] for r in paths.collect()) == [[0, 1, 2], [0, 1, 3]]
    many = spark.range(blocks.MAX_NODES).select(F.col("id").alias("node"), F.lit(False).alias("is_call"))
    assert blocks.function_paths(many, edges, 0) == (None, "too_hard")
    assert rows(blocks.end_blocks(nodes, edges).where("is_leaf").select("node")) == [(2,), (3,)]


def test_caps_count_finished_paths(spark):
    edges = spark.createDataFrame([(i, j) for i in range(9) for j in (i + 1, 100 + i)], "src bigint, dst bigint")  # a leaf at each step
    got = graph.simple_paths(edges, spark.createDataFrame([(0,)], "node bigint"), max_paths=2).collect()
    assert 1 <= len(got) <= 3


def test_limits():
    run = lambda *steps: tuple(blocks.limited.func(pd.Series([list(steps)])).iloc[0])
    assert run("a", "b", "a", "b", "a", "b") == (5, "loop")
    assert run("call f", "call f", "call f") == (2, "recursion")
    assert run("call f", "ret", "call f", "ret", "call f") == (5, "end")
    assert run(*[str(i) for i in range(1001)]) == (1000, "too_long")
    assert run() == (0, "end")


def test_comparison(spark):
    f0 = spark.createDataFrame([(1, [".printf"]), (2, [".printf"])], "f0 int, feats array<string>")
    f1 = spark.createDataFrame([(7, [".__printf_chk"]), (8, [".open"]), (9, [".printf", ".open"])], "f1 int, feats array<string>")
    p0 = spark.createDataFrame([(1, 0, ".printf", "(add x:8 1:8)"), (1, 1, ".printf", "(add x:8 1:8)"), (1, 2, None, "(mul y:8 3:8)")], "f0 int, no int, name string, formula string")
    p1 = spark.createDataFrame([(7, 0, ".__printf_chk", "(add 1:8 q:8)"), (7, 1, ".open", "(add 1:8 q:8)"), (7, 2, ".open", "(mul y:8 3:8)"), (9, 0, ".printf", "(sub z:8 1:8)")], "f1 int, no int, name string, formula string")
    for mode, score in (("formulas", 2 / 3), ("trees", 1 / 3)):
        got = {(r["f0"], r["f1"]): (r["score"], r["diff"], r["status"]) for r in compare.compared(f0, f1, p0, p1, compare.Comparison(mode=mode)).collect()}
        assert got == {(1, 7): (score, 0.0, "ok"), (1, 9): (0.0, 0.5, "ok"), (2, 7): (None, None, "invalid"), (2, 9): (None, None, "invalid")}
    assert [r["f1"] for r in compare.ranked_comparison(compare.compared(f0, f1, p0, p1)).orderBy("rank").collect()] == [7, 9]


def test_comparison_by_paths(spark):
    pairs = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.001), (2, 7, 0.5)], "f0 int, f1 int, score double")
    paths0 = spark.createDataFrame([(1, 0, 0, "a", 2), (1, 0, 1, "r", 1), (1, 0, 2, "b", 3), (1, 1, 0, "a", 2), (1, 1, 1, "c", 1)], "f0 int, path_no bigint, pos int, block string, weight int")
    paths1 = spark.createDataFrame([(7, 0), (7, 1), (8, 0)], "f1 int, path_no bigint")
    graph0 = spark.createDataFrame([(1, "0", "a"), (1, "a", "r"), (1, "r", "b"), (1, "a", "c")], "f0 int, src string, dst string")
    graph1 = spark.createDataFrame([(7, "0", "A"), (7, "A", "X"), (7, "X", "B"), (7, "A", "C"), (8, "0", "A")], "f1 int, src string, dst string")
    contents = lambda f, names: spark.createDataFrame([(f, n, *c) for n, c in names.items()], "f int, block string, formulas array<string>, constraints array<string>")
    b, c = (["(add x:8 1:8)"], []), ([], ["(eq x:8 3:8)"])
    blocks0 = contents(1, {"a": (["(mul x:8 3:8)"], []), "r": (None, None), "b": b, "c": c}).withColumnRenamed("f", "f0")
    blocks1 = contents(7, {"A": (["(mul 3:8 q:8)"], []), "X": ([], []), "B": b, "C": c}).withColumnRenamed("f", "f1")
    run = lambda mode, **k: {(r["f0"], r["f1"]): tuple(r)[2:4] + (r["status"],) for r in path_modes.compared_paths(pairs, paths0, paths1, graph0, graph1, blocks0, blocks1, path_modes.PathComparison(mode=mode, **k)).collect()}
    # single blocks: c has no formula and isn't valid
    assert run("blocks") == {(1, 7): (1.0, 0.0, "ok"), (1, 8): (0.0, 0.0, "ok"), (2, 7): (None, None, "invalid")}
    assert run("segments") == {(1, 7): (1.0, 0.0, "ok"), (2, 7): (None, None, "invalid")}
    assert run("segments", gate=0.0)[1, 8] == (0.0, 3.0, "ok")
    # the step without contents counts in the length
    assert run("prefixes")[1, 7] == (pytest.approx(8 / 9), 0.0, "ok")
    assert run("prefixes", most_prefixed=1)[1, 7] == (0.0, 100000.0, "too_hard")
