from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinmatch.functions import scalars as s
from kinmatch.functions.names import LIBRARY, STRICT_STOP, arguments, normalised


@pytest.mark.parametrize(
    "names, expected",
    [
        (["printf", ".__printf_chk", ".free"], {".printf"}),
        ([".calloc"], {".malloc", ".memset"}),
        ([".malloc", ".memset", ".calloc"], {".malloc", ".memset", ".calloc"}),
        (["calloc"], {".calloc"}),
        (["strcmp"], set()),
        ([".strcpy", ".bsearch"], {".strcpy", ".bsearch"}),
        ([], set()),
    ],
)
def test_normalised_names(spark, names, expected):
    df = spark.createDataFrame([(names,)], "n array<string>")
    assert set(df.select(normalised(F.col("n"))).first()[0]) == expected


def test_strict_stop_list(spark):
    df = spark.createDataFrame([([".strcpy", ".bsearch", ".open64"],)], "n array<string>")
    assert df.select(normalised(F.col("n"), replace(LIBRARY, stop=STRICT_STOP))).first()[0] == [".open"]


def test_arguments(spark):
    df = spark.createDataFrame([(".fwrite",), (".abort",), (".other",)], "n string")
    got = [r[0] for r in df.select(arguments(F.col("n"), "x86", F.array(F.lit("?")))).collect()]
    assert got == [["4", "8", "12", "16"], [], ["?"]]


@pytest.mark.parametrize("x, y, expected", [(["a", "b"], ["b", "c"], 1 / 3), ([], [], 0.0), (["a"], [], 0.0), (["a", "a"], ["a"], 1.0)])
def test_jaccard(spark, x, y, expected):
    df = spark.createDataFrame([(x, y)], "x array<string>, y array<string>")
    assert df.select(s.jaccard(F.col("x"), F.col("y"))).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize("n, m, keep", [(0, 3, True), (0, 4, False), (2, 5, True), (2, 6, False), (3, 6, True), (4, 9, False), (0, 0, True)])
def test_count_gate(spark, n, m, keep):
    df = spark.createDataFrame([(n, m)], "n int, m int")
    for a, b in (("n", "m"), ("m", "n")):
        assert df.select(s.counts_alike(F.col(a), F.col(b))).first()[0] is keep


def test_ranges_and_addresses(spark):
    df = spark.createDataFrame([(5,), (10,), (99,)], "v int")
    got = df.select(s.classified(F.col("v"), (("exe", ((0, 6),)), ("data", ((0, 11),))), F.lit("x"))).collect()
    assert [r[0] for r in got] == ["exe", "data", "x"]
    big = spark.createDataFrame([("0xffffffffffffffff",), ("10",), ("zz",)], "a string").select(s.from_hex(F.col("a")).alias("v"))
    assert [None if r[0] is None else int(r[0]) for r in big.collect()] == [2**64 - 1, 16, None]
    assert big.select(s.to_hex(F.col("v"))).first()[0] == "0xffffffffffffffff"
    ranges = F.array(F.struct(F.lit(1).alias("lo"), F.lit(6).alias("hi")))
    assert [r[0] for r in df.select(s.in_ranges(F.col("v"), ranges)).collect()] == [True, False, False]


def test_instructions_and_traces(spark):
    df = spark.createDataFrame([("call",), ("bl",), ("ret",), ("jmp",), ("jne",)], "m string")
    got = df.select(s.is_call(F.col("m")), s.is_return(F.col("m")), s.is_conditional_jump(F.col("m")), s.is_boundary(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(True, False, False, True), (True, False, False, True), (False, True, False, True), (False, False, False, False), (False, False, True, False)]
    t = spark.createDataFrame([([9, 1, 2, 1, 2],), ([1, 2, 2],), ([],)], "t array<int>")
    assert [r[0] for r in t.select(s.repeats_its_tail(F.col("t"), 2, 2)).collect()] == [True, False, False]
    n = spark.createDataFrame([("reg_rax_1_64",), ("plain",)], "n string")
    assert [r[0] for r in n.select(s.symbol_name(F.col("n"))).collect()] == ["rax", "plain"]
