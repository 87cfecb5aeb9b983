from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from kinmatch.operators import pair_blocks, similarity
from kinmatch.plans import compare
from tests.conftest import rows

NAMES = (".printf", ".__printf_chk", ".open", ".open64", ".malloc", ".memset", ".free", ".strcmp", "printf")
FORMS = {".__printf_chk": ".printf", "printf": ".printf", ".open64": ".open", ".free": "", ".strcmp": ""}
FORMULAS = ("(add x:8 1:8)", "(add 1:8 q:8)", "(sub z:8 1:8)", "(mul y:8 3:8)", None)
FEATURES, PATHS = "array<string>", "no int, name string, formula string"


def functions(rng, ids):
    """Feature sets, also empty ones and such of stop names only, and paths, also none, with repeated numbers and nulls."""
    feats = [(i, None if k == 5 else rng.sample(NAMES, rng.randint(0, 4)) if k % 4 else rng.sample((".free", ".strcmp"), k % 3)) for k, i in enumerate(ids)]
    return feats, [(i, rng.randint(0, 4), rng.choice((*NAMES, None)), rng.choice(FORMULAS)) for i in ids for _ in range(rng.randint(0, 5))]


def alike(x, y):
    form, memory = lambda n: FORMS.get(n, n), (".malloc", ".memset")
    return x is None or y is None or form(x) == form(y) or (x in memory and y in memory)


def equal(a, b):
    return a is not None and b is not None and (a == b or "add" in a and "add" in b)


def score_of(left, right):
    """The greedy match of two functions' paths (no, name, formula), as its definition reads."""
    if not left or not right:
        return None
    free, n = {j for j, _, _ in right}, 0
    for i in sorted({x[0] for x in left}):
        fits = [j for j, name, b in right if j in free and any(k == i and alike(x, name) and equal(a, b) for k, x, a in left)]
        if fits:
            free.discard(min(fits))
            n += 1
    return n / len(left)


def test_blocks_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pair_blocks, "BLOCK", 9)
    rng = random.Random(7)
    (s0, q0), (s1, q1) = functions(rng, range(30)), functions(rng, [f"g{i}" for i in range(40)])
    f0, f1 = spark.createDataFrame(s0, f"f0 int, feats {FEATURES}"), spark.createDataFrame(s1, f"f1 string, feats {FEATURES}")
    p0, p1 = spark.createDataFrame(q0, f"f0 int, {PATHS}"), spark.createDataFrame(q1, f"f1 string, {PATHS}")
    p = compare.Comparison(gate=0.3)
    of = lambda paths, i: [x[1:] for x in paths if x[0] == i]
    want = {}
    for f, g, gate in similarity.gated_pairs(f0, f1, p.rules, p.gate).select("f0", "f1", "score").collect():
        score = score_of(of(q0, f), of(q1, g))
        want[f, g] = (score, None if score is None else 1 - gate)
    out = compare.compared(f0, f1, p0, p1, p)
    assert {(r["f0"], r["f1"]): (r["score"], r["diff"]) for r in out.collect()} == want
    assert any(s is None for s, _ in want.values()) and any(d == 0 for _, d in want.values())
    best = {f: sorted(((-s, d, g) for (x, g), (s, d) in want.items() if x == f and s is not None))[:3] for f, _ in want}
    got = compare.ranked_comparison(compare.compared(f0, f1, p0, p1, p, top=3), 3)
    assert rows(got.select("f0", "rank", "f1", "score", "diff")) == sorted(((f, k + 1, g, -s, d) for f, b in best.items() for k, (s, d, g) in enumerate(b)), key=str)


def test_candidates_do_not_travel(spark):
    """A feature that all share makes no row per pair: only what passes leaves the tasks."""
    n = 300
    side = lambda f: spark.range(n).repartition(4).select(F.col("id").alias(f), F.array(F.lit("all"), *[F.concat(F.lit(x), F.col("id")) for x in "abc"]).alias("feats"))
    path = lambda f: spark.range(n).repartition(4).select(F.col("id").alias(f), F.lit(0).alias("no"), F.lit(None).cast("string").alias("name"), F.lit("(add x:8 1:8)").alias("formula"))
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    written = lambda: sum(s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(stages()))
    before = written()
    got = compare.compared(side("f0"), side("f1"), path("f0"), path("f1"), compare.Comparison(gate=0.5)).collect()
    assert sorted((r["f0"], r["f1"], r["score"]) for r in got) == [(i, i, 1.0) for i in range(n)]
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert written() - before < 20 * n


@pytest.mark.parametrize("dense, postings", [(0, 1), (10**9, 10**9), (3, 50)])
def test_counts_are_exact(monkeypatch, dense, postings):
    monkeypatch.setattr(pair_blocks, "DENSE", dense)
    monkeypatch.setattr(pair_blocks, "POSTINGS", postings)
    rng = np.random.default_rng(3)
    x, y = (rng.random((n, 40)) < rng.random(40) ** 3 for n in (23, 31))
    coo = lambda m: tuple(a.astype(np.int32) for a in np.nonzero(m))
    (n0, n1), some0, some1 = (x.sum(1), y.sum(1)), np.arange(1, 22), np.arange(0, 31, 2)
    gate = pair_blocks._Gate(coo(x), coo(y), n0, n1, some0, some1, 0.25)
    want = x[some0].astype(int) @ y[some1].T
    assert (gate.counts(2, 15) == want[2:15]).all()
    common = x.astype(int) @ y.T
    got = [t for lo in range(0, 23, 5) for t in zip(*(a.tolist() for a in gate.passing(lo, min(23, lo + 5))), strict=True)]
    assert got == [(i, j, common[i, j] / (n0[i] + n1[j] - common[i, j])) for i in some0 for j in some1 if common[i, j] and common[i, j] / (n0[i] + n1[j] - common[i, j]) >= 0.25]
