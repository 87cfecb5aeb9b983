"""Aligning a path with a graph: the longest common subsequence over the graph's walks from its root."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame

MATCH, NO_MATCH, SKIP = "MATCH", "NO-MATCH", "SKIP"
ROOT = 0


def align(path: Sequence, children: dict, equal: Callable[[object, object], bool], weight: Callable[[object], int] = lambda _: 1, best: bool = False, first: int = 0) -> tuple[int, list[tuple]]:
    """(score, traceback) of a path against a graph below ROOT.

    A row of scores is kept for every node: entry k is for the path's first k blocks. Nodes are visited again as long as
    a row improves. A block equal to the node adds its weight to the parent's row; otherwise the better of skipping the
    node and skipping the block is taken. With ``best`` equal blocks may be skipped, too, which can score higher; without
    it a match replaces that choice. Blocks before ``first`` never match.
    """
    n = len(path)
    rows: dict = {ROOT: [(0, None, None)] * (n + 1)}
    queue = deque([ROOT])
    known: dict = {}

    def same(k: int, node) -> bool:
        if (k, node) not in known:
            known[k, node] = k >= first and equal(path[k], node)
        return known[k, node]

    while queue:
        parent = queue.popleft()
        for node in children.get(parent, ()):
            improved = node not in rows
            row = rows.setdefault(node, [(0, None, None)] * (n + 1))
            above = rows[parent]
            for k in range(n):
                options = []
                if same(k, node):
                    options.append((above[k][0] + weight(path[k]), MATCH, parent))
                if best or not options:
                    options.append((above[k + 1][0], NO_MATCH, parent) if above[k + 1][0] > row[k][0] else (row[k][0], SKIP, None))
                top = max(options, key=lambda o: o[0])
                if top[0] > row[k + 1][0]:
                    row[k + 1] = top
                    improved = True
            if improved:
                queue.append(node)
    score, node = 0, None
    for name, row in rows.items():
        if row[n][0] > score:
            score, node = row[n][0], name
    return score, _traced(rows, path, node) if node is not None else []


def _traced(rows: dict, path: Sequence, node) -> list[tuple]:
    out, k = [], len(path)
    while k > 0:
        _, how, parent = rows[node][k]
        if how == MATCH:
            k -= 1
            out.append((MATCH, node, path[k]))
            node = parent
        elif how == NO_MATCH:
            out.append((NO_MATCH, node, None))
            node = parent
        elif how == SKIP:
            k -= 1
            out.append((SKIP, None, path[k]))
        else:
            break
    return out[::-1]


def aligned_paths(paths: DataFrame, graph: DataFrame, key: str, weighted: bool = False, best: bool = False) -> DataFrame:
    """(key, path_no, score, length) of paths (key, path_no, pos, label, weight) against the graph (key, src, dst) of the same key.

    Blocks are equal to nodes of the same label. One key is one pair of functions, whose caps bound the group.
    """
    schema = f"{key} {paths.schema[key].dataType.simpleString()}, path_no bigint, score bigint, length bigint"

    def run(steps: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        children: dict = {}
        for s, d in zip(edges["src"], edges["dst"], strict=True):
            children.setdefault(ROOT if s == "0" else s, []).append(d)
        for c in children.values():
            c.sort()
        out = []
        if not len(steps):
            return pd.DataFrame(out, columns=[key, "path_no", "score", "length"])
        for number, part in steps.sort_values(["path_no", "pos"]).groupby("path_no"):
            blocks = list(zip(part["label"], part["weight"], strict=True))
            score, _ = align(blocks, children, lambda b, node: b[0] == node, (lambda b: int(b[1])) if weighted else lambda _: 1, best)
            out.append((part[key].iloc[0], number, score, int(part["weight"].sum()) if weighted else len(part)))
        return pd.DataFrame(out, columns=[key, "path_no", "score", "length"])

    edges = graph.select(graph[key].alias("_key"), "src", "dst")  # both sides may come from one table
    return paths.groupBy(key).cogroup(edges.groupBy("_key")).applyInPandas(run, schema)
