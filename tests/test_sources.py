from __future__ import annotations

import json

from pyspark.sql import functions as F

from kinmatch.sources import flowchart as fc
from kinmatch.sources import report
from kinmatch.sources.cache import TableCache
from kinmatch.streaming.progress import append_reports
from tests.conftest import rows

CHART = {
    "func_addr": 4096, "callees": {"4100": [8192, [4097, 4098]], "4120": [12288, None]},
    "cfg": [{"start": 4096, "end": 4104, "preds": [], "succs": [1, 2]}, {"start": 4104, "end": 4112, "preds": [0], "succs": []}, {"start": 4112, "end": 4124, "preds": [0], "succs": [1]}],
}


def test_flow_charts(spark, tmp_path):
    (tmp_path / "0x1000.json").write_text(json.dumps(CHART))
    charts = fc.read_charts(spark, str(tmp_path))
    assert charts.select("addr").first()[0] == 4096
    assert rows(fc.callees(charts, 16)) == [(4112, 4116, 8208, [4113, 4114]), (4112, 4136, 12304, None)]
    assert rows(fc.callee_counts(fc.callees(charts))) == [(4096, 2)]
    assert rows(fc.block_edges(charts).select("src", "dst")) == [(0, 4096), (4096, 4104), (4096, 4112), (4112, 4104)]
    cuts = spark.createDataFrame([(4096, 4100)], "func_addr bigint, at bigint")
    assert rows(fc.split_at(charts, cuts).select("src", "dst")) == [(0, 4096), (4096, 4100), (4100, 4104), (4100, 4112), (4112, 4104)]
    fc.write_json(charts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_trailing_empty_block_goes(spark):
    one = CHART | {"cfg": [*CHART["cfg"], {"start": 9, "end": 9, "preds": [1], "succs": []}]}
    one["cfg"][1] = one["cfg"][1] | {"succs": [3]}
    charts = spark.createDataFrame([(json.dumps(one),)], "j string").select(F.from_json("j", fc.model.FLOW_CHART).alias("c")).select("c.*")
    got = fc.cleaned_blocks(charts).first()["cfg"]
    assert len(got) == 3 and got[1]["succs"] == []


def test_name_maps(spark, tmp_path):
    (tmp_path / "func_map").write_text("0x10 : a\n0x20 : b : c\nnonsense\n0x10 : d\n0x30 : d\n")
    lines = fc.read_lines(spark, str(tmp_path / "func_map"))
    assert rows(fc.name_map(lines)) == [(16, "d"), (48, "d")]
    assert rows(fc.address_of_name(lines)) == [("a", 16), ("d", 48)]


def test_references(spark, tmp_path):
    (tmp_path / "0x20.json").write_text("[16, 17, 16]")
    assert rows(fc.reference_edges(spark, str(tmp_path))) == [(16, 32), (17, 32)]


def test_argument_offsets(spark):
    a = spark.createDataFrame([("f", 1, 1, 4), ("f", 1, 2, 8), ("f", 1, 3, 4), ("g", 1, 1, 9), ("g", 2, 5, 4)], "callee string, call bigint, inst bigint, size bigint")
    assert rows(fc.argument_offsets(a)) == [("f", [4, 12, 16]), ("g", [4])]


def test_sections(spark):
    s = spark.createDataFrame([(0, ".bss", 5, 9, 100, False, True, True), (0, ".rodata", 10, 20, 0, False, True, False), (0, ".text", 20, 60, 0, True, True, False), (0, ".got", 60, 62, 0, False, True, True)], fc.model.SECTION)
    assert [tuple(r)[1:] for r in fc.data_ranges(s).collect()] == [(".rodata", 10, 20), (".bss", 100, 104), (".got", 60, 62)]
    f = spark.createDataFrame([(0, 20), (0, 60)], "pid int, addr bigint")
    assert rows(fc.in_section(f, s).select("addr")) == [(20,)]
    assert [r["name"] for r in fc.flag_ranges(s, "x").collect()] == [".text"]


REPORT = """Match foo(0x10) at 0 ((0.5, 0.25))
foo : [('foo', (0.5, 0.25)), ('bar', (0.0, 0.5)), ('baz', (0.0, 100000))]
qux(0x20) finds no counterpart
qux : [('foo', (0.9, 0.1))]
zap : [('foo', (0.0, 100000))]
nil : [('foo', (0.0, 0.4))]
a:b : [('c:d', (0.25, 0.5))]
""".splitlines()


def test_report_parsing(spark):
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(REPORT)], "file string, line_no int, line string")
    got = {r["f"]: [tuple(i) for i in r["items"]] for r in report.parsed(lines).collect()}
    assert got == {"foo": [("foo", 0.5)], "nil": [], "a:b": [("c:d", 0.25)]}


def test_report_round_trip_and_stream(spark, tmp_path):
    ranking = spark.createDataFrame([(1, "g1", 1, 0.5, 0.25, True), (1, "g2", 2, 0.0, 1.0, False), (2, "g1", 1, 1.0, 0.0, True)], "f0 int, g string, rank int, score double, diff double, solved boolean")
    index = spark.createDataFrame([(1, 0), (2, -1)], "f0 int, match_index int")
    lines = report.report_lines(ranking, index, F.concat(F.lit("f"), F.col("f0").cast("string")), F.lit("0x1"))
    text = [r["line"] for r in lines.orderBy("f0", "part").collect()]
    assert text == ["Match f1(0x1) at 0 ((0.5, 0.25))", "f1 : [('g1', (0.5, 0.25)), ('g2', (0.0, 100000))]", "f2(0x1) finds no counterpart", "f2 : [('g1', (1.0, 0.0))]"]
    report.write(lines, str(tmp_path / "r"))
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    append_reports(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.text(str(tmp_path / "r")).count() == spark.read.text(str(tmp_path / "s")).count() == 4


def test_cache(spark, tmp_path):
    cache = TableCache(spark, str(tmp_path / "cache"))
    assert cache.load("t") is None and cache.missing(["t"]) == ["t"]
    made = []
    for _ in range(2):
        assert cache.get("t", lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
