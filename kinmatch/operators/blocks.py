"""Operators over blocks and the formulas and constraints collected from them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.operators.graph import leaves, simple_paths, trimmed
from kinmatch.storage import checkpointed

#: Caps on what one function may hold.
MAX_COLLECTED_PATHS, MAX_COMPARED_PATHS, MAX_NODES, MAX_RECORDS, TRIM_ABOVE = 1000, 100, 1000, 120, 50


def is_assignment(nodes: Column) -> Column:
    """Whether an expression's nodes only name a symbol, whole or cut to size."""
    root = F.element_at(nodes, -1)
    return (F.size(nodes) <= 2) & F.when(F.size(nodes) == 1, root["op"] == "BVS").otherwise((root["op"] == "Extract") & (F.element_at(nodes, 1)["op"] == "BVS"))


def without_assignments(formulas: Column) -> Column:
    """Formulas (array of struct(lhs, nodes)) that compute something."""
    return F.filter(formulas, lambda f: ~is_assignment(f["nodes"]))


def without_bare_targets(formulas: Column) -> Column:
    """Formulas whose right side isn't a bare register or memory symbol."""
    return F.filter(formulas, lambda f: ~(is_assignment(f["nodes"]) & F.element_at(f["nodes"], 1)["name"].rlike("^(reg|mem)")))


def valid_constraints(constraints: Column, skipped: Sequence[str]) -> Column:
    """Constraints (array of node arrays) that aren't literally true and mention no skipped register."""

    def ok(nodes: Column) -> Column:
        true = (F.size(nodes) == 1) & (F.element_at(nodes, 1)["op"] == "BVV") & (F.element_at(nodes, 1)["value"] == 1)
        names = F.transform(F.filter(nodes, lambda n: n["op"] == "BVS"), lambda n: n["name"])
        return ~true & ~F.arrays_overlap(names, F.array(*[F.lit(s) for s in skipped]) if skipped else F.array().cast("array<string>"))

    return F.filter(constraints, ok)


def valid(n_formulas: Column, n_constraints: Column, mode: str = "both") -> Column:
    """Whether a block has something to compare, by mode: formulas, constraints or both (either will do)."""
    return {"formulas": n_formulas > 0, "constraints": n_constraints > 0, "both": (n_formulas > 0) | (n_constraints > 0)}[mode]


def first_valid(flags: Column) -> Column:
    """Place, from 0, of the first true flag; the array's size if there is none."""
    at = F.array_position(flags, True)
    return F.when(at == 0, F.size(flags)).otherwise(at - 1).cast("bigint")


def written_registers(writes: DataFrame, keys: Sequence[str], skipped: Sequence[str]) -> DataFrame:
    """(keys, registers): distinct registers (register) that a block writes, without the skipped ones."""
    return writes.where(~F.col("register").isin(*skipped)).groupBy(*keys).agg(F.array_sort(F.collect_set("register")).alias("registers"))


def distinct_memory_formulas(formulas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One formula (rhs, pos) for each text of the right side; the first by pos."""
    return formulas.groupBy(*keys, "rhs").agg(F.min("pos").alias("pos"))


def relatives(blocks: DataFrame, keys: Sequence[str], info: str) -> DataFrame:
    """(keys, infos, n): the infos of all paths that end at a block, in order."""
    return blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(info)).alias("infos"), F.count("*").alias("n"))


def reliable(blocks: DataFrame, errors: DataFrame, keys: Sequence[str], most: int = 2) -> DataFrame:
    """Blocks whose root block has at most so many errors (keys)."""
    bad = errors.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys)
    return blocks.join(bad, list(keys), "left_anti")


def block_graph(blocks: DataFrame) -> DataFrame:
    """(src, dst) of blocks (block, succs, is_call, is_return, return_to): calls lead to their return address, returns end."""
    target = F.when(F.col("is_return"), F.array().cast("array<bigint>")).when(F.col("is_call") & F.col("return_to").isNotNull(), F.array("return_to")).otherwise(F.col("succs"))
    return blocks.select(F.col("block").alias("src"), F.explode(target).alias("dst")).distinct()


def bypassed(edges: DataFrame, blocks: DataFrame, max_hops: int = 100) -> DataFrame:
    """Edges (src, dst) without blocks (block, lo, hi) that wholly cover their single successor: their predecessors lead past them."""
    for _ in range(max_hops):
        single = edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst")).where("n = 1").select("src", "dst")
        a, b = blocks.select(F.col("block").alias("src"), "lo", "hi"), blocks.select(F.col("block").alias("dst"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
        covers = single.join(a, "src").join(b, "dst").where("src <> dst and lo <= lo1 and hi >= hi1").select(F.col("src").alias("gone"), F.col("dst").alias("to"))
        # one hop at a time: a block whose successor goes too waits
        covers = covers.join(covers.select(F.col("gone").alias("to")), "to", "left_anti")
        if covers.isEmpty():
            return edges
        moved = edges.join(covers, F.col("dst") == F.col("gone"), "left").select("src", F.coalesce("to", "dst").alias("dst"))
        edges = checkpointed(moved.join(covers.select(F.col("gone").alias("src")), "src", "left_anti").where("src <> dst").distinct())
    return edges


def function_paths(nodes: DataFrame, edges: DataFrame, root: int, max_paths: int = MAX_COLLECTED_PATHS) -> tuple[DataFrame | None, str]:
    """(paths, status) of one function's graph: too many nodes are too hard; large graphs with calls are trimmed first."""
    n = nodes.count()
    if n >= MAX_NODES:
        return None, "too_hard"
    if n > TRIM_ABOVE and not nodes.where("is_call").isEmpty():
        left = trimmed(nodes, edges)
        kept = left.select("node")
        edges = edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    start = nodes.where(F.col("node") == root).select("node")
    return simple_paths(edges, start, max_paths=max_paths, keep_loops=True), "ok"


def end_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``is_leaf``."""
    flag = leaves(nodes, edges).select("node", F.lit(True).alias("is_leaf"))
    return nodes.join(flag, "node", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(False)))


@F.pandas_udf(T.StructType([T.StructField("n_steps", T.LongType()), T.StructField("reason", T.StringType())]))
def limited(steps: pd.Series) -> pd.DataFrame:
    """How far a trace runs before a limit stops it: steps are ``call x``, ``ret`` or block names.

    Limits: a function twice on the call stack, a run of blocks three times in a row (a loop run twice), 1000 steps.
    """

    def run(trace) -> tuple[int, str]:
        stack: list[str] = []
        blocks: list[str] = []
        for n, step in enumerate(trace if trace is not None else []):
            if n >= 1000:
                return n, "too_long"
            if step.startswith("call "):
                stack.append(step[5:])
                if stack.count(step[5:]) > 2:
                    return n, "recursion"
            elif step == "ret":
                if stack:
                    stack.pop()
            else:
                blocks.append(step)
                for unit in range(1, len(blocks) // 3 + 1):
                    tail = blocks[-unit:]
                    if blocks[-2 * unit : -unit] == tail and blocks[-3 * unit : -2 * unit] == tail:
                        return n, "loop"
        return len(trace) if trace is not None else 0, "end"

    return pd.DataFrame([run(t) for t in steps], columns=["n_steps", "reason"])
