"""Text reports of rankings: writing and parsing.

For every function a report has a head line, ``Match f(0x..) at i (..)`` or
``f(0x..) finds no counterpart``, and a line ``f : [('g', (score, diff)), ...]``.
A comparison that never reached the solver has an integer difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The difference written for a comparison that never reached the solver.
UNSOLVED = "100000"
_ITEM = r"""\(\s*(['"])(.*?)\1\s*,\s*\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)\s*\)"""


def _number(value: Column) -> Column:
    """A float as it is written in a report: always with a point."""
    return F.regexp_replace(F.format_string("%.6f", value), r"(\.\d+?)0+$", "$1")


def report_lines(ranking: DataFrame, indexes: DataFrame, name: Column, address: Column) -> DataFrame:
    """(f0, part, line) of ranking (f0, g, rank, score, diff, solved) and indexes (f0, match_index); part 0 is the head."""
    item = F.concat(F.lit("('"), F.col("g"), F.lit("', ("), _number(F.col("score")), F.lit(", "), F.when(F.col("solved"), _number(F.col("diff"))).otherwise(UNSOLVED), F.lit("))"))
    lists = ranking.groupBy("f0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("i")))), lambda s: s["i"]), ", ").alias("items"), F.array_sort(F.collect_list(F.struct("rank", "score", "diff"))).alias("all"))
    both = lists.join(indexes, "f0").select("f0", "items", "match_index", F.get("all", F.col("match_index").cast("int")).alias("hit"), name.alias("name"), address.alias("address"))
    found = F.concat(F.lit("Match "), "name", F.lit("("), "address", F.lit(") at "), F.col("match_index").cast("string"), F.lit(" (("), _number(F.col("hit.score")), F.lit(", "), _number(F.col("hit.diff")), F.lit("))"))
    head = F.when(F.col("match_index") >= 0, found).otherwise(F.concat("name", F.lit("("), "address", F.lit(") finds no counterpart")))
    body = F.concat("name", F.lit(" : ["), "items", F.lit("]"))
    return both.select("f0", F.posexplode(F.array(head, body)).alias("part", "line"))


def parsed(lines: DataFrame) -> DataFrame:
    """(f, items) of report lines (file, line_no, line): items are the solved results of positive score, in order.

    A list line after ``finds no counterpart`` is skipped. A function without any solved result has no row; one without a
    positive score has an empty list. Names are taken by an anchored pattern, so they may hold colons.
    """
    w = Window.partitionBy("file").orderBy("line_no")
    marked = lines.select("file", "line_no", "line", F.coalesce(F.lag("line").over(w).rlike(r"\) finds no counterpart\s*$"), F.lit(False)).alias("skip"))
    body = marked.where(~F.col("skip") & F.col("line").rlike(r"^.+? : \[.*\]\s*$") & ~F.col("line").rlike(r"\) finds no counterpart\s*$"))
    body = body.select("file", "line_no", F.regexp_extract("line", r"^(.+?) : \[(.*)\]\s*$", 1).alias("f"), F.regexp_extract("line", r"^(.+?) : \[(.*)\]\s*$", 2).alias("list"))
    g, score, diff = (F.regexp_extract_all("list", F.lit(_ITEM), F.lit(k)) for k in (2, 3, 4))
    items = F.transform(F.arrays_zip(g.alias("g"), score.alias("s"), diff.alias("d")), lambda t: F.struct(F.trim(t["g"]).alias("g"), t["s"].cast("double").alias("score"), (~t["d"].rlike(r"^[+-]?\d+$")).alias("solved")))
    solved = body.select("f", "file", "line_no", F.filter(items, lambda t: t["solved"]).alias("items")).where("size(items) > 0")
    last = solved.groupBy("f").agg(F.max_by("items", F.struct("file", "line_no")).alias("items"))
    return last.select("f", F.transform(F.filter("items", lambda t: t["score"] > 0), lambda t: F.struct(t["g"].alias("g"), t["score"].alias("score"))).alias("items"))


def long_rows(results: DataFrame) -> DataFrame:
    """(f, g, score, pos) of parsed results."""
    return results.select("f", F.posexplode("items").alias("pos", "i")).select("f", "i.g", "i.score", F.col("pos").cast("bigint").alias("pos"))


def write(lines: DataFrame, path: str, append: bool = False) -> None:
    """Lines (f0, part, line) as text files, each function's lines together and in order."""
    ordered = lines.repartition("f0").sortWithinPartitions("f0", "part").select("line")
    ordered.write.mode("append" if append else "overwrite").text(path)
