"""Exported flow charts and name maps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch import model
from kinmatch.functions.scalars import in_ranges


def address_of_file(name: Column) -> Column:
    """The address in a file name like 0x401000.json."""
    return F.conv(F.regexp_extract(name, r"0x([0-9a-fA-F]+)(?:\.json)?$", 1), 16, 10).cast("bigint")


def name_map(lines: DataFrame) -> DataFrame:
    """(addr, name) of lines (line_no, value) ``0x… : name``; other lines are left out, the last line of an address wins."""
    parts = lines.select("line_no", F.split("value", " : ", -1).alias("p")).where("size(p) = 2")
    parts = parts.select("line_no", F.conv(F.regexp_extract(F.trim(F.col("p")[0]), r"^0x([0-9a-fA-F]+)$", 1), 16, 10).cast("bigint").alias("addr"), F.trim(F.col("p")[1]).alias("name"))
    return parts.where("addr is not null").groupBy("addr").agg(F.max_by("name", "line_no").alias("name"))


def address_of_name(lines: DataFrame) -> DataFrame:
    """(name, addr), the last line of a name winning."""
    numbered = lines.select("line_no", F.split("value", " : ", -1).alias("p")).where("size(p) = 2")
    pairs = numbered.select("line_no", F.trim(F.col("p")[1]).alias("name"), F.conv(F.regexp_extract(F.trim(F.col("p")[0]), r"^0x([0-9a-fA-F]+)$", 1), 16, 10).cast("bigint").alias("addr"))
    return pairs.where("addr is not null").groupBy("name").agg(F.max_by("addr", "line_no").alias("addr"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, in its order."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    """One row per function: file address, callees and blocks, from a folder of JSON files."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(address_of_file(F.col("_metadata.file_name")).alias("addr"), "value")
    return rows.select("addr", F.from_json("value", model.FLOW_CHART).alias("c")).select("addr", "c.*")


def cleaned_blocks(charts: DataFrame) -> DataFrame:
    """Charts without a trailing empty block and the references to it."""
    last = F.size("cfg") - 1
    empty = (last >= 0) & (F.element_at("cfg", -1)["start"] == F.element_at("cfg", -1)["end"])
    kept = F.transform(F.slice("cfg", 1, F.greatest(last, F.lit(0))), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.filter(b["preds"], lambda p: p != last).alias("preds"), F.filter(b["succs"], lambda p: p != last).alias("succs")))
    return charts.withColumn("cfg", F.when(empty, kept).otherwise(F.col("cfg")))


def callees(charts: DataFrame, offset: int = 0) -> DataFrame:
    """(func_addr, inst, callee, args) of all calls, addresses moved by the load offset."""
    one = charts.select("func_addr", F.explode("callees").alias("inst", "v"))
    parsed = one.select("func_addr", F.col("inst").cast("bigint").alias("inst"), F.parse_json("v").alias("v"))
    out = parsed.select((F.col("func_addr") + offset).alias("func_addr"), (F.col("inst") + offset).alias("inst"), (F.variant_get("v", "$[0]", "bigint") + offset).alias("callee"), F.variant_get("v", "$[1]", "array<bigint>").alias("args"))
    return out.withColumn("args", F.transform("args", lambda a: a + offset))


def callee_counts(calls: DataFrame) -> DataFrame:
    """(func_addr, n): distinct callees."""
    return calls.groupBy("func_addr").agg(F.countDistinct("callee").alias("n"))


def argument_offsets(arguments: DataFrame) -> DataFrame:
    """(callee, offsets) from (callee, call, inst, size): sizes from the last instruction to the first, summed up; the last call of a callee wins."""
    one = arguments.groupBy("callee", "call").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("inst", "size"))), lambda s: s["size"])).alias("sizes"))
    sums = F.aggregate("sizes", F.array().cast("array<bigint>"), lambda acc, s: F.concat(acc, F.array((F.coalesce(F.element_at(F.concat(F.array(F.lit(0).cast("bigint")), acc), -1), F.lit(0)) + s).cast("bigint"))))
    return one.groupBy("callee").agg(F.max_by(sums, "call").alias("offsets"))


def block_edges(charts: DataFrame) -> DataFrame:
    """(func_addr, src, dst): edges of block starts, with the root 0 above each function's first block."""
    blocks = charts.select("func_addr", "cfg", F.posexplode("cfg").alias("i", "b"))
    inner = blocks.select("func_addr", F.col("b.start").alias("src"), F.explode(F.transform("b.succs", lambda s: F.get("cfg", s)["start"])).alias("dst"))
    root = charts.where("size(cfg) > 0").select("func_addr", F.lit(0).cast("bigint").alias("src"), F.col("cfg")[0]["start"].alias("dst"))
    return root.unionByName(inner).where("dst is not null").distinct()


def split_at(charts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(func_addr, src, dst): block edges where blocks are cut at further addresses (func_addr, at): pieces form a chain.

    Edges into a block lead to its first piece, edges out of it leave from its last.
    """
    blocks = charts.select("func_addr", F.explode("cfg").alias("b")).select("func_addr", F.col("b.start").alias("start"), F.col("b.end").alias("end"))
    inside = blocks.join(cuts, "func_addr").where("at > start and at < end").select("func_addr", "start", "at")
    pieces = blocks.select("func_addr", "start", F.col("start").alias("at")).unionByName(inside).distinct()
    w = Window.partitionBy("func_addr", "start").orderBy("at")
    chain = pieces.select("func_addr", F.col("at").alias("src"), F.lead("at").over(w).alias("dst")).where("dst is not null")
    last = pieces.groupBy("func_addr", "start").agg(F.max("at").alias("last"))
    outer = block_edges(charts).join(last.withColumnRenamed("start", "src"), ["func_addr", "src"], "left").select("func_addr", F.coalesce("last", "src").alias("src"), "dst")
    return chain.unionByName(outer).distinct()


def functions_with_chunks(functions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Functions (addr, ...) that have a chunk (addr)."""
    return functions.join(chunks.select("addr"), "addr", "left_semi")


def in_section(functions: DataFrame, sections: DataFrame, name: str = ".text") -> DataFrame:
    """Functions (pid, addr, ...) whose address lies in a section (pid, name, lo, hi)."""
    return functions.join(section(sections, name).select("pid", "lo", "hi"), "pid").where("addr >= lo and addr < hi").drop("lo", "hi")


def outside_section(functions: DataFrame, sections: DataFrame, name: str = ".text") -> DataFrame:
    """Functions (pid, addr, ...) whose address lies in no section of that name."""
    spans = section(sections, name).groupBy("pid").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    return functions.join(spans, "pid", "left").where(F.col("_spans").isNull() | ~in_ranges(F.col("addr"), F.col("_spans"))).drop("_spans")


def valid_functions(functions: DataFrame, sections: DataFrame, name: str = ".text") -> DataFrame:
    """Functions (pid, addr, is_plt, is_simprocedure, is_syscall, ...) of a section that are code of the program's own."""
    return in_section(functions.where("not (is_plt or is_simprocedure or is_syscall)"), sections, name)


def section(sections: DataFrame, name: str) -> DataFrame:
    """The sections of one name; a program without it has no row."""
    return sections.where(F.col("name") == name)


def object_ranges(objects: DataFrame) -> DataFrame:
    """(pid, name, lo, hi) of the loaded objects (pid, name, is_main, lo, hi) besides the program itself."""
    return objects.where("not is_main").select("pid", "name", "lo", "hi")


def data_ranges(sections: DataFrame) -> DataFrame:
    """(pid, lo, hi, name) of data sections, longest first: .bss at its virtual address, names with data, and writable sections without code."""
    bss = F.col("name") == ".bss"
    lo = F.when(bss, F.col("vaddr")).otherwise(F.col("lo"))
    rows = sections.where(bss | F.col("name").contains("data") | (F.col("w") & ~F.col("x")))
    return rows.select("pid", "name", lo.alias("lo"), (lo + F.col("hi") - F.col("lo")).alias("hi")).orderBy((F.col("hi") - F.col("lo")).desc(), "name")


def flag_ranges(sections: DataFrame, flag: str) -> DataFrame:
    """(pid, lo, hi) of sections with a flag (x, r or w), longest first."""
    return sections.where(F.col(flag)).select("pid", "name", "lo", "hi").orderBy((F.col("hi") - F.col("lo")).desc(), "name")


def write_json(charts: DataFrame, path: str) -> None:
    charts.write.mode("overwrite").json(path)


def reference_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from one JSON list of callers for each function."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(address_of_file(F.col("_metadata.file_name")).alias("dst"), F.from_json("value", "array<bigint>").alias("callers"))
    return rows.select(F.explode("callers").alias("src"), "dst").distinct()
