"""Operators over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.storage import checkpointed


def edge_union(*tables: DataFrame) -> DataFrame:
    """All edges of several tables, each once."""
    out = tables[0].select("src", "dst")
    for t in tables[1:]:
        out = out.unionByName(t.select("src", "dst"))
    return out.distinct()


def with_references(edges: DataFrame, references: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges plus reference edges both of whose ends are known nodes (node)."""
    ok = references.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return edge_union(edges, ok)


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth) of every reachable pair with its least number of steps; a node on a cycle reaches itself.

    Semi-naive: each round joins only the pairs that the round before found, and keeps those not known yet. Rounds end
    when nothing is new; lineage is cut in each.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    known = edges.withColumn("depth", F.lit(1))
    frontier, depth = known, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.select("src", "dst").join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        new = checkpointed(new.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        known, frontier = known.unionByName(new), new
        if depth % 8 == 0:
            known = checkpointed(known)
    return known


def closure_features(reach: DataFrame, features: DataFrame) -> DataFrame:
    """(node, feat): each node's own features (node, feat) and those of all nodes that it reaches."""
    theirs = reach.select("src", F.col("dst").alias("node")).distinct().join(features, "node").select(F.col("src").alias("node"), "feat")
    return features.select("node", "feat").unionByName(theirs).distinct()


def callers_of(reach: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, caller, depth) for everything that reaches a node."""
    out = reach.select(F.col("dst").alias("node"), F.col("src").alias("caller"), "depth")
    return out if nodes is None else out.join(nodes.select("node"), "node", "left_semi")


def callees_of(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, callee, depth) for everything that the nodes reach."""
    return reach.select(F.col("src").alias("node"), F.col("dst").alias("callee"), "depth").join(nodes.select("node"), "node", "left_semi")


def without_features(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """Nodes (node, ...) that have no feature row (node)."""
    return nodes.join(features.select("node"), "node", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def trimmed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node, is_call) that are left after leaves that aren't calls are taken away again and again."""
    left = checkpointed(nodes.select("node", "is_call"))
    live = edges.select("src", "dst").distinct()
    while True:
        gone = left.where("not is_call").join(live.select(F.col("src").alias("node")), "node", "left_anti").select("node")
        gone = checkpointed(gone)
        if gone.isEmpty():
            return left
        left = checkpointed(left.join(gone, "node", "left_anti"))
        live = checkpointed(live.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"))


def simple_paths(edges: DataFrame, roots: DataFrame, max_paths: int | None = None, max_length: int | None = None, keep_loops: bool = False) -> DataFrame:
    """(root, path) of all simple paths from the roots (node) to leaves, level by level.

    With ``max_paths`` a root that would have more, finished and open paths together, is extended from then on along one
    child of each path only, chosen by a hash. ``keep_loops`` also keeps paths that end where every child is on the path already.
    """
    step = edges.select("src", "dst").distinct()
    has_child = step.select(F.col("src").alias("last")).distinct()
    open_ = checkpointed(roots.select(F.col("node").alias("root"), F.array("node").alias("path"), F.col("node").alias("last")))
    done = open_.select("root", "path").limit(0)
    while not open_.isEmpty() and (max_length is None or max_length > 1):
        ended = open_.join(has_child, "last", "left_anti").select("root", "path")
        grown = open_.join(has_child, "last", "left_semi").join(step, F.col("last") == F.col("src"))
        fresh = grown.where(~F.array_contains("path", F.col("dst")))
        if keep_loops:
            stuck = open_.join(has_child, "last", "left_semi").join(fresh.select("root", "path"), ["root", "path"], "left_anti")
            ended = ended.unionByName(stuck.select("root", "path"))
        next_ = fresh.select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
        if max_paths is not None:
            so_far = done.select("root").unionByName(ended.select("root")).unionByName(next_.select("root"))
            many = so_far.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > max_paths).select("root")
            chosen = next_.join(many, "root", "left_semi").groupBy("root", F.slice("path", F.lit(1), F.size("path") - 1).alias("_p")).agg(F.min_by("path", F.xxhash64("path")).alias("path"))
            next_ = next_.join(many, "root", "left_anti").unionByName(chosen.select("root", "path", F.element_at("path", -1).alias("last")))
        done = checkpointed(done.unionByName(ended))
        open_ = checkpointed(next_)
        max_length = None if max_length is None else max_length - 1
    return done


def callers_by_data(targets: DataFrame, references: DataFrame, functions: DataFrame, max_hops: int = 10) -> DataFrame:
    """(node, func): functions that refer to a target (node), through data references (src refers to dst) of at most max_hops.

    functions (func, lo, hi) are half-open ranges. A reference inside a function ends the search there. Addresses meet
    functions by pages of 4096, an equi-join; a function stands once for each page that it touches.
    """
    pages = F.explode(F.sequence(F.floor(F.col("lo") / 4096), F.floor((F.col("hi") - 1) / 4096)))
    functions = functions.where("lo < hi").select("func", "lo", "hi", pages.alias("page"))
    here = targets.select("node", F.col("node").alias("dst"))
    found = None
    seen = here
    for _ in range(max_hops):
        back = checkpointed(here.join(references, "dst").select("node", F.col("src").alias("at")).distinct())
        inside = back.withColumn("page", F.floor(F.col("at") / 4096)).join(functions, "page").where("at >= lo and at < hi").select("node", "at", "func")
        found = inside.select("node", "func") if found is None else found.unionByName(inside.select("node", "func"))
        here = back.join(inside.select("node", "at"), ["node", "at"], "left_anti").select("node", F.col("at").alias("dst"))
        here = checkpointed(here.join(seen, ["node", "dst"], "left_anti"))
        if here.isEmpty():
            break
        seen = seen.unionByName(here)
    return found.distinct()
