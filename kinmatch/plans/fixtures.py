"""Queries of the sources, filters and expressions that no test table has: small inputs are made inside the query.

Most inputs follow a rule over the rows of ``nation`` (k is the nation's key), written out in Python here and, apart
from it, in the SQL, so that the SQL holds the operator and not its own output.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch import model
from kinmatch.functions import expr_udfs, exprs, names, scalars
from kinmatch.operators import blocks, graph
from kinmatch.plans import adapters as ad
from kinmatch.plans import path_modes
from kinmatch.plans.registry import query
from kinmatch.sources import flowchart, report
from kinmatch.sources.cache import TableCache
from kinmatch.storage import fresh_folder, put_text

N = 25
_SQL_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else str(value)


def _values(rows: Sequence[tuple], schema: str) -> str:
    """A SELECT of rows in SQL; schema is that of Spark, with scalar types."""
    columns = [c.split() for c in schema.split(", ")]
    casts = ", ".join(f"CAST({n} AS {_SQL_TYPES[t]}) AS {n}" for n, t in columns)
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in columns)})"


# flow charts


def _chart(k: int) -> dict:
    """Function k: up to three calls, two to five blocks of 16 bytes, and in each fifth an empty block behind them."""
    at, n = 4096 * (k + 1), k % 4 + 2
    calls = {str(at + 4 * j): [4096 * ((k * 7 + j * 3) % N + 1), None if j == 0 else [at + 4 * j - 1, at + 4 * j - 2]] for j in range(k % 3 + 1)}
    succs = [[i + 1] * (i + 1 < n) + [i + 2] * (i % 2 == 0 and i + 2 < n) for i in range(n)]
    cfg = [{"start": at + 16 * i, "end": at + 16 * i + 16, "preds": [p for p in range(n) if i in succs[p]], "succs": succs[i]} for i in range(n)]
    if k % 5 == 0:
        cfg[-1]["succs"] = [n]
        cfg.append({"start": at + 16 * n, "end": at + 16 * n, "preds": [n - 1], "succs": []})
    return {"func_addr": at, "callees": calls, "cfg": cfg}


def _charts(spark: SparkSession) -> DataFrame:
    folder = fresh_folder(spark, "charts")
    for k in range(N):
        chart = _chart(k)
        put_text(spark, f"{folder}/{chart['func_addr']:#x}.json", json.dumps(chart))
    return flowchart.read_charts(spark, folder)


_K = "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation"
_CALLS_SQL = f"calls AS (SELECT k, j, 4096 * (k + 1) AS fn, 4096 * (k + 1) + 4 * j AS inst, 4096 * ((k * 7 + j * 3) % 25 + 1) AS callee FROM ({_K}), (SELECT unnest([0, 1, 2]) AS j) WHERE j <= k % 3)"
_BLOCKS_SQL = f"b AS (SELECT k, 4096 * (k + 1) AS fn, k % 4 + 2 AS n, i FROM ({_K}), (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE i < k % 4 + 2)"


@query(f"""WITH {_CALLS_SQL} SELECT fn AS file_addr, fn + 16 AS func_addr, inst + 16 AS inst, callee + 16 AS callee, CASE WHEN j > 0 THEN (inst + 15) || ',' || (inst + 14) END AS args FROM calls""")
def chart_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of a folder of exported flow charts, moved by the load offset, with the address in the file's name."""
    charts = _charts(spark)
    calls = flowchart.callees(charts, 16).withColumn("args", F.array_join("args", ","))
    return calls.join(charts.select(F.col("addr").alias("file_addr"), (F.col("func_addr") + 16).alias("func_addr")), "func_addr").select("file_addr", "func_addr", "inst", "callee", "args")


@query(f"WITH {_CALLS_SQL} SELECT fn AS func_addr, count(DISTINCT callee) AS n FROM calls GROUP BY fn")
def callee_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct callees of each function."""
    return flowchart.callee_counts(flowchart.callees(_charts(spark)))


@query(f"""WITH {_BLOCKS_SQL}, e AS (
  SELECT fn, CAST(0 AS BIGINT) AS src, fn AS dst FROM b WHERE i = 0
  UNION ALL SELECT fn, fn + 16 * i, fn + 16 * (i + 1) FROM b WHERE i + 1 < n
  UNION ALL SELECT fn, fn + 16 * i, fn + 16 * (i + 2) FROM b WHERE i % 2 = 0 AND i + 2 < n)
SELECT fn AS func_addr, CASE WHEN src = fn THEN fn + 8 ELSE src END AS src, dst FROM e UNION ALL SELECT fn, fn, fn + 8 FROM b WHERE i = 0""")
def chart_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block graphs without trailing empty blocks, first blocks cut in half."""
    charts = flowchart.cleaned_blocks(_charts(spark))
    return flowchart.split_at(charts, charts.select("func_addr", (F.col("func_addr") + 8).alias("at")))


@query(f"WITH {_BLOCKS_SQL} SELECT fn AS func_addr, n + CAST(k % 5 = 0 AS BIGINT) AS n_blocks, n AS n_cleaned FROM b WHERE i = 0")
def chart_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts written as JSON and read again, as they are and cleaned."""
    folder = fresh_folder(spark, "chart-sink")
    flowchart.write_json(_charts(spark).select("func_addr", "callees", "cfg"), folder)
    again = spark.read.schema(model.FLOW_CHART).json(folder)
    cleaned = flowchart.cleaned_blocks(again).select("func_addr", F.size("cfg").cast("bigint").alias("n_cleaned"))
    return again.select("func_addr", F.size("cfg").cast("bigint").alias("n_blocks")).join(cleaned, "func_addr")


_SPANS, _HOPS = [(0, 0, 5), (1, 5, 20), (2, 10, 20), (3, 20, 30)], [(0, 1), (1, 2), (2, 3)]


@query("SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (VALUES (0, 2), (2, 3)) AS t(src, dst)")
def bypassed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block that covers its only successor gives way to it."""
    return blocks.bypassed(spark.createDataFrame(_HOPS, "src bigint, dst bigint"), spark.createDataFrame(_SPANS, "block bigint, lo bigint, hi bigint"))


@query(f"""SELECT k AS src, CASE WHEN k % 4 = 0 AND k % 8 = 0 THEN k + 2 ELSE (k + 1) % 25 END AS dst FROM ({_K}) WHERE k % 7 <> 6""")
def block_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls lead to their return address where it's known, returns end."""
    rows = [(k, [(k + 1) % N], k % 4 == 0, k % 7 == 6, k + 2 if k % 8 == 0 else None) for k in range(N)]
    return blocks.block_graph(spark.createDataFrame(rows, "block bigint, succs array<bigint>, is_call boolean, is_return boolean, return_to bigint"))


@query(f"WITH {ad.EDGES_SQL} SELECT k AS node, k % 3 = 0 AS is_call, k NOT IN (SELECT src FROM edge) AS is_leaf FROM ({_K})")
def end_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes of the trade graph have no way out."""
    nodes = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"), (F.col("n_nationkey") % 3 == 0).alias("is_call"))
    return blocks.end_blocks(nodes, ad.edges(spark, sf_dir))


@query(f"SELECT k * 16 AS addr, 'f' || k AS name FROM ({_K}) WHERE k % 3 = 1")
def functions_with_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that have a chunk."""
    functions = spark.createDataFrame([(16 * k, f"f{k}") for k in range(N)], "addr bigint, name string")
    return flowchart.functions_with_chunks(functions, spark.createDataFrame([(16 * k, k) for k in range(N) for _ in range(2) if k % 3 == 1], "addr bigint, chunk bigint"))


# name maps, references, caches, reports


@query(f"SELECT k AS addr, CASE WHEN k % 6 = 0 THEN 'again ' ELSE '' END || n_name AS name FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation)")
def name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of names in a text file; the last line of an address wins, other lines don't count."""
    known = {r["k"]: r["n_name"] for r in ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name").collect()}  # 25 rows
    lines = [f"{k:#x} : {n}" for k, n in sorted(known.items())] + ["no line of the map", "0xzz : x"] + [f"{k:#x} : again {n} " for k, n in sorted(known.items()) if k % 6 == 0]
    file = f"{fresh_folder(spark, 'names')}/func_map"
    put_text(spark, file, "\n".join(lines) + "\n")
    return flowchart.name_map(flowchart.read_lines(spark, file))


@query("SELECT 'r' || n_regionkey AS name, CAST(max(n_nationkey) AS BIGINT) AS addr FROM nation GROUP BY n_regionkey")
def name_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map the other way; the last line of a name wins."""
    rows = ad.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    file = f"{fresh_folder(spark, 'names')}/name_map"
    put_text(spark, file, "\r\n".join(f"{r[0]:#x} : r{r[1]}" for r in rows))
    return flowchart.address_of_name(flowchart.read_lines(spark, file))


@query(f"SELECT DISTINCT src, k AS dst FROM (SELECT k, unnest([k + 1, k + 2, k + 1]) AS src FROM ({_K})) WHERE src < 25 UNION SELECT 0, 24")
def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers listed in one file for each function, joined with the edges known; only known nodes count."""
    folder = fresh_folder(spark, "references")
    for k in range(N):
        put_text(spark, f"{folder}/{k:#x}.json", json.dumps([k + 1, k + 2, k + 1]))
    edges = spark.createDataFrame([(0, 24)], "src bigint, dst bigint")
    return graph.with_references(edges, flowchart.reference_edges(spark, folder), spark.range(N).withColumnRenamed("id", "node"))


@query(f"SELECT k AS node, 10000 + 5000 * k AS func FROM ({_K}) WHERE k % 2 = 0 OR k % 3 = 0")
def data_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that refer to a target through a chain of data references."""
    inside = lambda k: 10000 + 5000 * k + 4500
    references = [(100 + k, k) for k in range(N)] + [(200 + k, 100 + k) for k in range(N)] + [(inside(k), 200 + k) for k in range(N) if k % 2 == 0] + [(inside(k), 100 + k) for k in range(N) if k % 3 == 0]
    targets = spark.range(N).withColumnRenamed("id", "node")
    functions = spark.createDataFrame([(10000 + 5000 * k, 10000 + 5000 * k, 15000 + 5000 * k) for k in range(N)], "func bigint, lo bigint, hi bigint")
    return graph.callers_by_data(targets, spark.createDataFrame(references, "src bigint, dst bigint"), functions)


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, 'other' AS missing FROM region")
def cached_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made once, loaded after that, and the names that aren't there."""
    cache = TableCache(spark, fresh_folder(spark, "cache"))
    make = lambda: ad.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")
    cache.get("regions", make)
    again = cache.get("regions", lambda: spark.range(0))
    return again.withColumn("missing", F.lit(",".join(cache.missing(["regions", "other"]))))


_RANKING = [(k, f"g{j}", j + 1, 0.5 / (j + 1), 0.25 * j, j < 2) for k in range(4) for j in range(3)]


@query("""SELECT line FROM (SELECT k, CASE WHEN k % 2 = 0 THEN 'Match f' || k || '(0x' || k || ') at 0 ((0.5, 0.0))' ELSE 'f' || k || '(0x' || k || ') finds no counterpart' END AS line FROM (SELECT unnest([0, 1, 2, 3]) AS k)
UNION ALL SELECT k, 'f' || k || ' : [(''g0'', (0.5, 0.0)), (''g1'', (0.25, 0.25)), (''g2'', (0.166667, 100000))]' FROM (SELECT unnest([0, 1, 2, 3]) AS k))""")
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as text, in two steps, and read again."""
    ranking = spark.createDataFrame(_RANKING, "f0 bigint, g string, rank int, score double, diff double, solved boolean")
    index = spark.createDataFrame([(k, 0 if k % 2 == 0 else -1) for k in range(4)], "f0 bigint, match_index bigint")
    lines = report.report_lines(ranking, index, F.concat(F.lit("f"), F.col("f0").cast("string")), F.concat(F.lit("0x"), F.col("f0").cast("string")))
    folder = fresh_folder(spark, "report")
    report.write(lines.where("f0 < 2"), folder)
    report.write(lines.where("f0 >= 2"), folder, append=True)
    return spark.read.text(folder).withColumnRenamed("value", "line")


# sections and addresses; customers' keys are the addresses

_SECTIONS = [
    (0, ".text", 20, 90, 20, True, True, False), (0, ".plt", 90, 100, 90, True, True, False), (0, ".rodata", 100, 130, 100, False, True, False),
    (0, ".data", 130, 150, 130, False, True, True), (0, ".bss", 150, 155, 400, False, True, True), (0, ".note", 155, 160, 155, False, True, False),
]


def _sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SECTIONS, model.SECTION)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("addr")
    return ad.table(spark, sf_dir, "customer").select(F.lit(0).alias("pid"), F.col("c_custkey").cast("bigint").alias("addr")).select("pid", "addr", (k % 7 == 0).alias("is_plt"), (k % 11 == 0).alias("is_simprocedure"), (k % 13 == 0).alias("is_syscall"))


@query("SELECT CAST(c_custkey AS BIGINT) AS addr FROM customer WHERE c_custkey >= 20 AND c_custkey < 90")
def functions_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions inside the text section."""
    return flowchart.in_section(_customers(spark, sf_dir), _sections(spark)).select("addr")


@query("SELECT CAST(c_custkey AS BIGINT) AS addr FROM customer WHERE c_custkey >= 20 AND c_custkey < 90 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0")
def valid_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without stubs, replaced procedures and system calls."""
    return flowchart.valid_functions(_customers(spark, sf_dir), _sections(spark)).select("addr")


@query("SELECT CAST(c_custkey AS BIGINT) AS addr FROM customer WHERE c_custkey < 20 OR c_custkey >= 90")
def outside_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions outside the text section."""
    return flowchart.outside_section(_customers(spark, sf_dir), _sections(spark)).select("addr")


@query("""SELECT kind, name, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM (VALUES ('data', '.rodata', 100, 130), ('data', '.data', 130, 150), ('data', '.bss', 400, 405),
('exec', '.text', 20, 90), ('exec', '.plt', 90, 100), ('object', 'lib1', 500, 600), ('object', 'lib2', 700, 950), ('lookup', '.rodata', 100, 130)) AS t(kind, name, lo, hi)""")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data and executable sections, other loaded objects, and one section by name."""
    objects = spark.createDataFrame([(0, "main", True, 0, 400), (0, "lib1", False, 500, 600), (0, "lib2", False, 700, 950)], "pid int, name string, is_main boolean, lo bigint, hi bigint")
    parts = {"data": flowchart.data_ranges(_sections(spark)), "exec": flowchart.flag_ranges(_sections(spark), "x"), "object": flowchart.object_ranges(objects), "lookup": flowchart.section(_sections(spark), ".rodata")}
    out = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), "name", "lo", "hi")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT CAST(c_custkey AS BIGINT) AS value, CASE WHEN c_custkey % 2 = 1 THEN 'constant' WHEN c_custkey >= 20 AND c_custkey < 100 THEN 'exec' WHEN c_custkey >= 100 AND c_custkey < 150 THEN 'data'
WHEN c_custkey % 3 = 0 THEN 'stack' ELSE 'constant' END AS kind FROM customer""")
def pointer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of pointer width as pointers: code, data, other objects, then the stack; other widths stay constants."""
    k = F.col("c_custkey").cast("bigint")
    rows = ad.table(spark, sf_dir, "customer").select(k.alias("value"), F.when(k % 2 == 1, 32).otherwise(64).alias("width"), F.when(k % 3 == 0, F.array(k)).otherwise(F.array().cast("array<bigint>")).alias("stack"))
    kind = scalars.pointer_kind(F.col("value"), F.col("width"), 64, executable=[(20, 90), (90, 100)], data=[(100, 130), (130, 150)], objects=[(10**9, 10**9 + 1)], recorded=F.col("stack"))
    return rows.select("value", kind.alias("kind"))


@query("SELECT CAST(c_custkey AS BIGINT) AS value, (c_custkey >= 5 AND c_custkey < 8) OR (c_custkey >= 20 AND c_custkey < 21) AS inside FROM customer")
def value_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a value lies in any range of an array."""
    ranges = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ((5, 8), (20, 21))])
    return ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("value"), scalars.in_ranges(F.col("c_custkey"), ranges).alias("inside"))


# instructions, names and numbers

_MNEMONICS = ["call", "CALLQ ", "bl", "blr", "b", "ret", "retq", "jmp", "jne", "je", "b.eq", "cbz", "tbnz", "mov", "br", ""]
_MNEMONIC_SQL = _values([(i, m) for i, m in enumerate(_MNEMONICS)], "no bigint, m string")


def _mnemonics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_MNEMONICS)), "no bigint, m string")


@query(f"""SELECT no, c AS is_call, r AS is_return, j AS is_jump, c OR r AS is_boundary FROM (SELECT no, l LIKE 'call%' OR l IN ('bl', 'blr') AS c, l LIKE 'ret%' AS r,
  (l LIKE 'j%' AND l <> 'jmp') OR l LIKE 'b.%' OR l IN ('cbz', 'cbnz', 'tbz', 'tbnz') AS j FROM (SELECT no, lower(trim(m)) AS l FROM ({_MNEMONIC_SQL})))""")
def instruction_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, returns, conditional jumps and boundaries by mnemonic."""
    m = F.col("m")
    return _mnemonics(spark).select("no", scalars.is_call(m).alias("is_call"), scalars.is_return(m).alias("is_return"), scalars.is_conditional_jump(m).alias("is_jump"), scalars.is_boundary(m).alias("is_boundary"))


@query(f"SELECT no // 4 AS path_no, coalesce(bool_or(lower(trim(m)) LIKE 'call%' OR lower(trim(m)) IN ('bl', 'blr') OR lower(trim(m)) LIKE 'ret%'), FALSE) AS has_boundary FROM ({_MNEMONIC_SQL}) GROUP BY 1")
def path_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path holds a boundary."""
    runs = _mnemonics(spark).groupBy(F.floor(F.col("no") / 4).cast("bigint").alias("path_no")).agg(F.collect_list("m").alias("path"))
    return runs.select("path_no", scalars.contains_boundary(F.col("path")).alias("has_boundary"))


_TRACES = [(0, "a b a b", 2, 2, True), (1, "a b a b", 2, 3, False), (2, "x a a a", 1, 3, True), (3, "a", 1, 2, False), (4, "c a b a b a b", 2, 3, True), (5, "", 1, 2, False)]


@query(_values([(n, r) for n, *_, r in _TRACES], "no bigint, repeats boolean"))
def loop_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a trace ends with the same run so many times."""
    out = None
    for no, text, unit, bound, _ in _TRACES:
        row = spark.createDataFrame([(no, text.split())], "no bigint, trace array<string>").select("no", scalars.repeats_its_tail(F.col("trace"), unit, bound).alias("repeats"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""SELECT k, '0x' || printf('%x', k * 4099) AS hex, k * 4099 AS back, CASE WHEN k % 3 = 0 THEN 'rax' WHEN k % 3 = 1 THEN '7fff' ELSE 'x' || k END AS symbol, (k % 2 = 0) <> (k % 3 = 0) AS either FROM ({_K})""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as hexadecimal and back, base names of symbols, exclusive or."""
    rows = spark.createDataFrame([(k, ("reg_rax_%d_64", "mem_7fff_%d_32", "x%d")[k % 3] % k) for k in range(N)], "k bigint, s string")
    hex_ = scalars.to_hex(F.col("k") * 4099)
    return rows.select("k", hex_.alias("hex"), scalars.from_hex(F.concat(F.lit(" "), F.upper(hex_))).cast("bigint").alias("back"), scalars.symbol_name(F.col("s")).alias("symbol"), scalars.exclusive_or(F.col("k") % 2 == 0, F.col("k") % 3 == 0).alias("either"))


_PLACES = [(".malloc", "x64", "rdi"), (".malloc", "x86", "4"), (".fwrite", "aarch64", "x0,x1,x2,x3"), (".abort", "x64", ""), (".unknown", "x64", "default"), (".__assert_fail", "x86", "4,8")]


@query(_values(_PLACES, "name string, arch string, places string"))
def argument_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where library functions take their arguments."""
    default = F.array(F.lit("default"))
    rows = spark.createDataFrame([p[:2] for p in _PLACES], "name string, arch string")
    place = F.when(F.col("arch") == "x64", names.arguments(F.col("name"), "x64", default)).when(F.col("arch") == "x86", names.arguments(F.col("name"), "x86", default)).otherwise(names.arguments(F.col("name"), "aarch64", default))
    return rows.select("name", "arch", F.array_join(place, ",").alias("places"))


@query("""WITH last AS (SELECT l_returnflag || l_linestatus AS callee, max(l_orderkey) AS call FROM lineitem GROUP BY 1),
s AS (SELECT callee, l_linenumber AS inst, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY callee ORDER BY l_linenumber DESC ROWS UNBOUNDED PRECEDING) AS total FROM lineitem JOIN last ON l_returnflag || l_linestatus = callee AND l_orderkey = call)
SELECT callee, string_agg(CAST(total AS VARCHAR), ',' ORDER BY inst DESC) AS offsets FROM s GROUP BY callee""")
def argument_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of sizes from a call's last instruction to its first; a callee's last call wins."""
    lines = ad.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("callee"), F.col("l_orderkey").cast("bigint").alias("call"), F.col("l_linenumber").cast("bigint").alias("inst"), F.col("l_quantity").cast("bigint").alias("size"))
    return flowchart.argument_offsets(lines).select("callee", F.array_join("offsets", ",").alias("offsets"))


@query(f"WITH RECURSIVE {ad.CLOSURE_SQL} SELECT src AS node, dst AS callee, depth FROM reach WHERE src % 5 = 0")
def callees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some nations reach in the trade graph."""
    nodes = ad.table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return graph.callees_of(graph.closure(ad.edges(spark, sf_dir)), nodes).withColumn("depth", F.col("depth").cast("bigint"))


# expressions


def _nodes(text: str) -> list[tuple]:
    return [(n.op, n.width, list(n.args), n.value, n.name) for n in exprs.parsed(text)]


@query(f"SELECT k, k % 3 + 1 AS n_computing, k % 3 + 1 + k % 2 AS n_not_bare, k % 2 + 1 AS n_constraints FROM ({_K})")
def formula_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas that compute something, formulas that aren't a bare register, and constraints that say something."""
    rows = []
    for k in range(N):
        formulas = [("c", _nodes(f"(add x {i})")) for i in range(k % 3 + 1)] + [("a", _nodes("reg_rax_1_64"))] + [("b", [("BVS", 64, [], None, "x"), ("Extract", 32, [0], None, None)])] * (k % 2)
        constraints = [_nodes("(ult x 5)")] * (k % 2 + 1) + [[("BVV", 0, [], 1, None)]] + [_nodes("(eq rip 7)")] * (k % 4 == 0)
        rows.append((k, [(a, [(*n[:3], None if n[3] is None else exprs.decimal(n[3]), n[4]) for n in b]) for a, b in formulas], [[(*n[:3], None if n[3] is None else exprs.decimal(n[3]), n[4]) for n in c] for c in constraints]))
    df = spark.createDataFrame(rows, f"k bigint, f array<struct<lhs: string, nodes: array<{model.NODE}>>>, c array<array<{model.NODE}>>")
    n = lambda c: F.size(c).cast("bigint")
    return df.select("k", n(blocks.without_assignments(F.col("f"))).alias("n_computing"), n(blocks.without_bare_targets(F.col("f"))).alias("n_not_bare"), n(blocks.valid_constraints(F.col("c"), ["rip"])).alias("n_constraints"))


_CONSTRAINTS = [
    (0, "(eq a:8 1:8)", "(ult b:8 5:8)", "equal", "different"), (1, "(ult b:8 5:8)", "(eq a:8 1:8)", "different", "different"), (2, "(ult a:8 1:8)", "(eq b:8 0:8)", "equal", "equal"),
    (3, "(ne a:8 0:8)", "(not (eq q:8 0:8))", "equal", "equal"), (4, "(land (ult a:8 9:8) (ult 2:8 a:8))", "(ult c:8 9:8)", "equal", "different"),
]


@query(_values([(n, c, e) for n, _, _, c, e in _CONSTRAINTS], "no bigint, contained string, equivalent string"))
def constraint_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether constraints imply each other, and whether they say the same, under a renaming."""
    rows = spark.createDataFrame([r[:3] for r in _CONSTRAINTS], "no bigint, a string, b string")
    return rows.select("no", expr_udfs.formula_contained("a", "b").alias("contained"), expr_udfs.constraint_equivalent("a", "b").alias("equivalent"))


_TREES = [
    (0, "(add x 1)", "(add y 1)", 0.0, True, "x"), (1, "(add x 1)", "(add y 2)", 1.0, False, "x"), (2, "(add x y)", "(add x 1)", None, False, "x,y"), (3, "(concat 0:8 x:8 y:8)", "(concat x:8 y:8)", 0.0, True, "x,y"),
    (4, "(neg (neg x))", "(neg z)", 1.0, False, "x"), (5, "4096", "4100", 0.0, True, ""), (6, "(mul x 4096)", "(mul x 9000)", 1.0, False, "x"),
]


@query(_values([(n, d, e, s) for n, _, _, d, e, s in _TREES], "no bigint, distance double, equal boolean, inputs string"))
def tree_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with code pointers told from constants: distances (none if inputs differ in number), equality, inputs."""
    rows = spark.createDataFrame([r[:3] for r in _TREES], "no bigint, a string, b string")
    d = expr_udfs.tree_distance_of([(4096, 8192)], [])("a", "b")
    return rows.select("no", F.when(d != float("inf"), d).alias("distance"), (d == 0).alias("equal"), F.array_join(expr_udfs.inputs("a"), ",").alias("inputs"))


_REWRITES = [
    (0, "(if (not (eq q 0)) q r)", "q", "q"), (1, "(if (land (not (eq q 0)) (eq r 1)) q r)", "(If (__eq__ r 1) q r)", "(If (And (Not (__eq__ q 0)) (__eq__ r 1)) q r)"),
    (2, "(add q:32 1:32)", "(__add__ q 1)", "(__add__ q 1)"), (3, "(if (eq q 0) q r)", "(If (__eq__ q 0) q r)", "(If (__eq__ q 0) q r)"),
]


@query(_values([(0, "q", 64), (1, "(If (__eq__ r 1) q r)", 64), (2, "(__add__ q 1)", 64), (3, "(If (__eq__ q 0) q r)", 64)], "no bigint, plain string, width bigint"))
def rewritten_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas without null checks, widened to 64 bits."""
    rows = spark.createDataFrame([r[:2] for r in _REWRITES], "no bigint, a string")
    out = expr_udfs.plain("a")
    return rows.select("no", out["text"].alias("plain"), out["width"].alias("width"))


# Left function k has one path of steps 0..k%6, right function 100+m a chain of the steps i with (i+m)%3 <> 0 out of 8.
_STEP_SQL = f"""k AS (SELECT CAST(unnest(range({N})) AS BIGINT) AS k),
step AS (SELECT k, i, i % 3 + 1 AS w, i % 4 <> 3 AND k % 7 <> 6 AND NOT (i = 0 AND k % 2 = 1) AS valid FROM (SELECT k, unnest(range(k % 6 + 1)) AS i FROM k)),
pair AS (SELECT k, m, k % 4 / 100.0::DOUBLE AS gate, (SELECT count(*) FROM range(8) AS r(i) WHERE (r.i + m) % 3 <> 0) AS n1 FROM (SELECT k, unnest([k, (k + 1) % {N}]) AS m FROM k)),
sums AS (SELECT p.k, p.m, any_value(gate) AS gate, any_value(n1) AS n1, count(*) AS n0, count(*) FILTER (valid) AS nv, sum(w) FILTER (valid) AS wv, sum(w) AS wa,
  count(*) FILTER (valid AND (i + m) % 3 <> 0) AS ns, coalesce(sum(w) FILTER (valid AND (i + m) % 3 <> 0), 0) AS ws FROM pair p JOIN step s ON s.k = p.k GROUP BY 1, 2)"""


@query(f"""WITH {_STEP_SQL}, modes AS (
  SELECT 'blocks' AS mode, k, m, CASE WHEN nv > 0 THEN ns / nv::DOUBLE END AS score, CASE WHEN nv > 0 THEN 0 END AS diff, CASE WHEN nv > 0 THEN 'ok' ELSE 'invalid' END AS status FROM sums
  UNION ALL SELECT 'segments', k, m, CASE WHEN nv > 0 THEN ws / wv::DOUBLE END, CASE WHEN nv > 0 THEN abs(n1 - n0) END, CASE WHEN nv > 0 THEN 'ok' ELSE 'invalid' END FROM sums WHERE gate >= 0.01
  UNION ALL SELECT 'prefixes', k, m, CASE WHEN m % 5 = 0 THEN 0 WHEN nv > 0 THEN ws / wa::DOUBLE END, CASE WHEN m % 5 = 0 THEN 100000 WHEN nv > 0 THEN abs(n1 - n0) END, CASE WHEN m % 5 = 0 THEN 'too_hard' WHEN nv > 0 THEN 'ok' ELSE 'invalid' END FROM sums WHERE gate >= 0.01)
SELECT mode, k AS f0, 100 + m AS f1, round(score, 6) AS score, CAST(diff AS DOUBLE) AS diff, status FROM modes""")
def compare_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions compared by paths of blocks, of segments and of prefixes."""
    k = spark.range(N).select(F.col("id").alias("k"))
    pairs = k.select("k", F.explode(F.array("k", (F.col("k") + 1) % N)).alias("m")).select(F.col("k").alias("f0"), (100 + F.col("m")).alias("f1"), (F.col("k") % 4 / 100.0).alias("score"))
    steps = k.select("k", F.explode(F.sequence(F.lit(0), F.col("k") % 6)).alias("i"))
    name = F.concat(F.lit("b"), F.col("i").cast("string"))
    texts = lambda cond, var: F.when(cond, F.array(F.format_string(f"(add {var}:8 %d:8)", F.col("i") + 1))).otherwise(F.array().cast("array<string>"))
    valid = (F.col("i") % 4 != 3) & (F.col("k") % 7 != 6) & ~((F.col("i") == 0) & (F.col("k") % 2 == 1))
    none = F.array().cast("array<string>").alias("constraints")
    blocks0 = steps.select(F.col("k").alias("f0"), name.alias("block"), texts(valid, "x").alias("formulas"), none)
    paths0 = steps.select(F.col("k").alias("f0"), F.lit(0).cast("bigint").alias("path_no"), F.col("i").alias("pos"), name.alias("block"), (F.col("i") % 3 + 1).alias("weight"))
    chain = k.select("k", F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")), lambda i: (i + F.col("k")) % 3 != 0).alias("c")).select((100 + F.col("k")).alias("f1"), F.posexplode("c").alias("at", "i"), "c")
    blocks1 = chain.select("f1", name.alias("block"), texts(F.lit(True), "z").alias("formulas"), none)
    link = lambda before: F.coalesce(F.concat(F.lit("b"), before.cast("string")), F.lit("0")).alias("src")
    graph1 = chain.select("f1", link(F.get("c", F.col("at") - 1)), name.alias("dst"))
    graph0 = steps.select(F.col("k").alias("f0"), link(F.when(F.col("i") > 0, F.col("i") - 1)), name.alias("dst"))
    paths1 = k.select((100 + F.col("k")).alias("f1"), F.explode(F.sequence(F.lit(1), F.when(F.col("k") % 5 == 0, 21).otherwise(1))).alias("path_no"))
    out = None
    for mode in ("blocks", "segments", "prefixes"):
        rows = path_modes.compared_paths(pairs, paths0, paths1, graph0, graph1, blocks0, blocks1, path_modes.PathComparison(mode=mode))
        rows = rows.select(F.lit(mode).alias("mode"), "f0", "f1", F.round("score", 6).alias("score"), "diff", "status")
        out = rows if out is None else out.unionByName(rows)
    return out
