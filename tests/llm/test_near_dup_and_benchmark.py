from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from kinmatch.llm import alignment
from kinmatch.llm import decontamination as dc
from kinmatch.llm import textkernel as tk
from kinmatch.llm.components import components
from kinmatch.llm.near_dup import OrderMinHash, near_duplicates, sketches
from kinmatch.llm.shared import new_folder
from tests.llm.helpers import edited, empty_documents, odd_documents, text, twins


def edit_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_alignment_is_exact():
    r = random.Random(1)
    pairs, most, expected = [], [], []
    for _ in range(300):
        v = r.choice([3, 20, 1000])
        a = [r.randrange(1, v + 1) for _ in range(r.choice([0, 1, 3, 10, 60]))]
        b = list(a)
        for _ in range(r.randrange(0, max(2, len(a) // 3))):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = [r.randrange(1, v + 1)] * r.randrange(2)
        m, d = r.randrange(20), edit_distance(a, b)
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        most.append(m)
        expected.append(d if d <= m else -1)
    assert alignment.within(pairs, np.array(most)).tolist() == expected
    assert len(alignment.within([], np.zeros(0, np.int64))) == 0


def classes_by_brute_force(docs: dict[int, str]) -> dict[int, int]:
    words = {d: t.lower().split() for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = max(len(words[a]), len(words[b]))
            if find(a) != find(b) and abs(len(words[a]) - len(words[b])) <= n * 0.2 and edit_distance(words[a], words[b]) <= n * 0.2 + 1e-9:
                root[find(b)] = find(a)
    least: dict[int, int] = {}
    for d in ids:
        least.setdefault(find(d), d)
    return {d: least[find(d)] for d in ids}


@pytest.fixture(scope="module")
def corpus() -> dict[int, str]:
    r = random.Random(9)
    docs: dict[int, str] = {}
    for _ in range(12):
        t = text(r, r.choice([30, 60, 120]))
        n = len(t.split(" "))
        for _ in range(r.randrange(1, 5)):
            docs[len(docs)] = edited(r, t, r.choice([0, 0, 1, max(1, n // 50)]))
    passage = text(r, 40)  # shared by texts that are no copies
    for _ in range(50):
        docs[len(docs)] = text(r, 60) + " " + passage + " " + text(r, 60)
    return docs


@pytest.mark.parametrize("p", [OrderMinHash(), OrderMinHash(crowd=2)])
def test_classes_match_brute_force(spark, corpus, p):
    got = near_duplicates(spark.createDataFrame(list(corpus.items()), "doc_id bigint, text string"), p)
    assert {x["doc_id"]: x["class_id"] for x in got.collect()} == classes_by_brute_force(corpus)


def test_sketches_feel_the_order():
    r = random.Random(2)
    t = text(r, 300)
    w = t.split(" ")
    moved = " ".join(w[150:] + w[:150])
    _, data, offsets = next(tk.chunks(pa.array([t, edited(r, t, 2), moved]), lower=True))
    digest, keys = sketches(tk.split_words(data, offsets, tk.PUNCTUATED), OrderMinHash())
    near, turned = (keys[0] == keys[1]).mean(), (keys[0] == keys[2]).mean()
    assert near > 0.5 and turned < near - 0.2 and len({tuple(d) for d in digest}) == 3


def test_odd_and_no_rows(spark):
    got = sorted(((x["doc_id"], x["class_id"]) for x in near_duplicates(odd_documents(spark)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 2), (None, None), (4, 2), (5, 1), (5, 1), (6, 6), (7, 7)], key=str)
    assert near_duplicates(empty_documents(spark)).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    r = random.Random(3)
    words = [*twins(), *[r.choice("ab") * r.randrange(30) for _ in range(300)], "12345678", "123456789", "", "1234567\0"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    hashes = tk.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words)) and not (tk.span_hashes(data, starts, ends, 1) == hashes)[ends > starts].any()
    for h in (tk.span_hashes, lambda data, starts, ends: np.zeros(len(starts), np.uint64), lambda data, starts, ends: (ends - starts).astype(np.uint64)):
        monkeypatch.setattr(tk, "span_hashes", h)
        where, back = tk.distinct(data, starts, ends)
        assert [words[i] for i in where[back]] == words and len(where) == len(set(words))


def test_texts_of_equal_polynomial_hash_are_no_copies(spark):
    one, two = twins()
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} w x y z"), (4, f"{two} w x y z")], "doc_id bigint, text string")
    got = {x["doc_id"]: (x["class_id"], x["copy_of"]) for x in near_duplicates(docs).collect()}
    assert got[1] != got[2] and {x[1] for x in got.values()} == {1, 2, 3, 4}
    items = spark.createDataFrame([(9, f"{one} one two three four")], "item_id bigint, text string")
    found = dc.contaminated(spark.createDataFrame([(1, f"{one} one two three four"), (2, f"{two} one two three four")], "doc_id bigint, text string"), items).collect()
    assert {(x["doc_id"], x["n_matched"]) for x in found} == {(1, 5), (2, 4)}


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(50)]
    root = {x: x for p in links for x in p}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), new_folder(spark, "t"))
    assert {x["node"]: x["root"] for x in got.collect()} == {x: r_ for x, r_ in root.items() if any(x in p and p[0] != p[1] for p in links)}


def test_seeds_lose_no_window():
    p = dc.Overlap()
    for n in range(p.least, p.window + 1):
        assert dc.misses(dc.seeds_for(n, p), n, n - p.needed(n)) == 0


def found_by_brute_force(docs, items, p=dc.Overlap()):
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            v = (x or "").lower().split()
            if len(v) < p.least:
                continue
            n, best = min(len(v), p.window), 0
            for o in range(-len(v) + 1, len(w)):
                eq = [0 <= o + q < len(w) and w[o + q] == v[q] for q in range(len(v))]
                best = max([best, *(sum(eq[s : s + n]) for s in range(len(v) - n + 1))])
            if best >= p.needed(len(v)):
                out.add((d, i, best, n))
    return out


@pytest.mark.parametrize("bound", [dc.BROADCAST_BYTES, 0])
def test_decontamination_matches_brute_force(spark, bound):
    r = random.Random(6)
    items = [(i, text(r, r.choice([2, 5, 9, 14, 20, 21, 45]))) for i in range(25)]
    docs = []
    for d in range(80):
        t = text(r, r.randrange(0, 60))
        if r.random() < 0.7:
            x = r.choice(items)[1]
            x = edited(r, x, int(len(x.split()) * r.choice([0, 0.1, 0.2, 0.3])))
            t = f"{t} {x.upper()} {text(r, 5)}"
        docs.append((d, t))
    items += [(100, "la " * 30), (101, "la lu " * 14), (102, "la la lu " * 9), (103, "go on now then " * 8)]
    docs += [(100, "la " * 90), (101, "x " + "la lu " * 40), (102, "la la lu " * 20 + "y"), (103, ("go on now then " * 3 + "no ") * 6), (104, "lu la " * 7)]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=bound)
    assert {tuple(x) for x in got.collect()} == found_by_brute_force(docs, items)


def test_repetitive_texts_cost_their_lengths():
    index = dc.ItemIndex([1], ["la " * 400], dc.Overlap())
    words = dc._tokens(pa.array(["la " * 20_000]))[0]
    hits = sum(h.shape[1] for h in index._hits(words, np.array([0, len(words)])))
    assert hits <= 4 * (len(words) + 400)
    assert [x.tolist() for x in index.search(words, np.array([0, len(words)]))] == [[0], [0], [20], [20]]


@pytest.mark.parametrize("bound", [dc.BROADCAST_BYTES, 0])
def test_decontamination_of_odd_and_no_rows(spark, bound):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (None, "one very long line one very"), (4, "")], "item_id bigint, text string")
    got = sorted((tuple(x)[:2] for x in dc.contaminated(odd_documents(spark), items, broadcast_bytes=bound).collect()), key=str)
    assert got == sorted([(1, 1), (5, 1), (5, 1), (6, None)], key=str)
    assert dc.contaminated(empty_documents(spark), items, broadcast_bytes=bound).count() == 0
    assert dc.contaminated(odd_documents(spark), items.limit(0)).count() == 0


def changed(r: random.Random, t: str, n: int) -> str:
    """t with n different words replaced."""
    w = t.split(" ")
    for at in r.sample(range(len(w)), n):
        w[at] = f"new{r.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_scattered_changes_are_linked(spark, share):
    r = random.Random(7)
    docs = {}
    for n in [5, 6, 8, 9, 10, 12, 14, 30, 60, 100, 200] * 4:
        if int(n * share + 1e-9):
            docs[len(docs)] = text(r, n)
            docs[len(docs)] = changed(r, docs[len(docs) - 1], int(n * share + 1e-9))
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    linked = [got[d] == got[d + 1] for d in range(0, len(docs), 2)]
    assert np.mean(linked) >= (0.95 if share == 0.2 else 0.99)


def test_short_texts_lose_no_pair(spark):
    docs = [(1, "one two three four five"), (2, "one two other four five"), (3, "a b c d e f g h i"), (4, "a b c d X f g h i"), (5, "p q r s"), (6, "p q r s t"), (7, "k l m n o u v w x y"), (8, "l m n o u v 1 w x y"), (9, "one two 3 4 five")]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}


def test_pairs_of_crowded_buckets_are_compared(spark):
    r = random.Random(8)
    passage, docs = text(r, 12), {}
    for _ in range(60):  # texts that share a passage; every one has a copy with 15 % of its own words changed
        own = text(r, 40)
        docs[len(docs)] = f"{passage} {own}"
        docs[len(docs)] = f"{passage} {changed(r, own, 6)}"
    got = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), OrderMinHash(crowd=8)).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == classes_by_brute_force(docs)


def test_the_driver_plans_few_queries(spark, corpus):
    def started() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    docs = spark.createDataFrame(list(corpus.items()), "doc_id bigint, text string")
    docs.count()
    before = started()
    assert near_duplicates(docs).count() == len(corpus)
    assert started() - before <= 24  # each one's plans, stages and threads take the driver's memory
