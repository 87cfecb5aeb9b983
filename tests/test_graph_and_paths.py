from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinmatch.operators import graph, paths
from tests.conftest import rows


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_closure_takes_the_least_depth(spark):
    got = {(a, b): d for a, b, d in rows(graph.closure(edges(spark, ("A", "B"), ("A", "D"), ("B", "P"), ("P", "Q"), ("Q", "Z"), ("D", "Z"))))}
    assert got["A", "Z"] == 2 and got["A", "Q"] == 3


def test_closure_on_a_cycle(spark):
    assert rows(graph.closure(edges(spark, ("A", "B"), ("B", "A")))) == [("A", "A", 2), ("A", "B", 1), ("B", "A", 1), ("B", "B", 2)]


def test_closure_matches_search(spark):
    r = random.Random(2)
    pairs = sorted({(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(22)})
    expected = {}
    for start in {a for a, _ in pairs}:
        level, depth = {b for a, b in pairs if a == start}, 1
        while level:
            for x in level:
                expected.setdefault((start, x), depth)
            level, depth = {b for a, b in pairs if a in level and (start, b) not in expected}, depth + 1
    assert {(a, b): d for a, b, d in rows(graph.closure(edges(spark, *pairs)))} == expected
    bounded = {(a, b): d for a, b, d in rows(graph.closure(edges(spark, *pairs), 2))}
    assert bounded == {k: d for k, d in expected.items() if d <= 2}


def test_closure_of_nothing(spark):
    assert graph.closure(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_leaves_and_trim(spark):
    nodes = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d", False), ("e", False)], "node string, is_call boolean")
    e = edges(spark, ("a", "b"), ("a", "c"), ("c", "d"), ("b", "e"))
    assert rows(graph.leaves(nodes, e).select("node")) == [("d",), ("e",)]
    assert rows(graph.trimmed(nodes, e).select("node")) == [("a",), ("b",)]


def test_simple_paths(spark):
    e = spark.createDataFrame([(0, 1), (1, 3), (1, 2), (2, 6), (6, 3), (3, 7), (7, 9)], "src int, dst int")
    got = sorted(r["path"][1:] for r in graph.simple_paths(e, spark.createDataFrame([(0,)], "node int")).collect())
    assert got == [[1, 2, 6, 3, 7, 9], [1, 3, 7, 9]]


def test_paths_that_end_in_a_loop(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "src int, dst int")
    root = spark.createDataFrame([(0,)], "node int")
    assert graph.simple_paths(e, root).count() == 0
    assert [r["path"] for r in graph.simple_paths(e, root, keep_loops=True).collect()] == [[0, 1, 2]]


def test_capped_paths_stay_simple_and_complete(spark):
    layers = [(f"{i}{a}", f"{i + 1}{b}") for i in range(6) for a in "xy" for b in "xy"]
    e = edges(spark, ("r", "0x"), ("r", "0y"), *layers)
    got = [r["path"] for r in graph.simple_paths(e, spark.createDataFrame([("r",)], "node string"), max_paths=8).collect()]
    assert 1 <= len(got) <= 8 and all(len(p) == 8 and len(set(p)) == 8 for p in got)


def test_callers_by_data(spark):
    refs = spark.createDataFrame([(100, 50), (200, 100), (300, 200), (60, 50), (60, 60)], "src int, dst int")
    funcs = spark.createDataFrame([("f", 300, 310), ("g", 60, 70)], "func string, lo int, hi int")
    target = spark.createDataFrame([(50,)], "node int")
    assert rows(graph.callers_by_data(target, refs, funcs)) == [(50, "f"), (50, "g")]
    assert rows(graph.callers_by_data(target, refs, funcs, max_hops=2)) == [(50, "g")]


def trace(spark, n, boundaries):
    return spark.createDataFrame([(1, p, p in boundaries) for p in range(1, n + 1)], "k int, pos int, b boolean")


def test_segments(spark):
    cut = lambda n, b: [r["items"] for r in paths.segments(trace(spark, n, b), ["k"], ["pos"], F.col("b"), "pos").orderBy("seg_no").collect()]
    assert cut(5, {2, 4}) == [[1, 2], [3, 4]]
    assert cut(3, set()) == [[1]]
    assert cut(3, {3}) == [[1, 2, 3]]


def test_interval_lookup_is_a_real_range_join(spark):
    starts = spark.createDataFrame([(1, 0), (1, 10), (1, 20), (1, 30)], "k int, at int")
    points = spark.createDataFrame([(1, 11), (1, 12), (1, 25), (2, 5)], "k int, at int")
    got = rows(paths.enclosing(points, starts, ["k"], ["at"]).select("at", "found.at"))
    assert got == [(11, 10), (12, 10), (25, 20)]


def test_offsets_and_longest(spark):
    sizes = spark.createDataFrame([(1, 1, 4), (1, 2, 8), (1, 3, 4)], "k int, pos int, size int").withColumnRenamed("pos", "at")
    assert rows(paths.running_offsets(sizes, ["k"], ["at"], "size").select("pos", "offset")) == [(1, 4), (2, 12), (3, 16)]
    lists = spark.createDataFrame([("f", 2, 1, "4"), ("f", 1, 2, "4 8"), ("f", 3, 2, "1 2"), ("g", 1, 0, "")], "name string, src int, n int, offsets string")
    assert rows(paths.longest_wins(lists, "name", "src", "n", ["offsets"])) == [("f", 1, 2, "4 8"), ("g", 1, 0, "")]


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(k, f"p{i}") for k in (1, 2) for i in range(9)], "k int, p string")
    one, two = rows(paths.sampled(df, ["k"], F.col("p"), 4)), rows(paths.sampled(df.repartition(3), ["k"], F.col("p"), 4))
    assert one == two and len(one) == 8
