from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from kinmatch.llm import cuckoo
from kinmatch.llm import line_dedup as line_dedup_module
from kinmatch.llm.line_dedup import LineStore, line_dedup
from kinmatch.llm.quality_rules import OP7_SQL, Limits, kept_documents, quality_rules
from kinmatch.llm.shared import new_folder
from tests.llm.helpers import empty_documents, odd_documents, text, twins

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t: str) -> tuple:
    w = WORD.findall(t)
    count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {p for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_base_counts_match_brute_force(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b", " ", "\n", "é", "#", "\x0b", " ", "a b c d e "]) for _ in range(r.randrange(60))) for _ in range(300)]
    texts += [text(r, 80) + "\n" + text(r, 30) for _ in range(20)]
    one, two = twins()
    texts += [f"{one}\n{two}", f"{one}\n{two}\n{one}", " ".join([one, "a b c d", two, "a b c d", one, "a b c d"])]
    got = quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for row in got.collect():
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == base(texts[row["doc_id"]])
        assert not (row["base_failed"] and row["kept"])


def test_verdicts(spark):
    r = random.Random(1)
    good, line = text(r, 200), "the same line of words stands here"
    cases = {1: good, 2: "too short", 3: " ".join([line] * 30), 4: "\n".join([*[line] * 3, text(r, 40)]), 5: "go on " * 30 + text(r, 30)}
    got = {x["doc_id"]: x for x in quality_rules(spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")).collect()}
    assert got[1]["kept"] and not any(got[k]["kept"] for k in (2, 3, 4, 5))
    loose = quality_rules(spark.createDataFrame([(4, cases[4])], "doc_id bigint, text string"), Limits(repeat_percent=100, duplicate_line_chars=1.0, duplicate_lines_and_chars=(1.0, 1.0), duplicate_ngrams=(), top_ngrams=()))
    assert loose.first()["kept"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in cases.items()], "doc_id bigint, text string, text_hash string")
    assert [tuple(x) for x in kept_documents(docs).collect()] == [(1, good, "z")]


def test_quality_of_odd_and_no_rows(spark):
    got = quality_rules(odd_documents(spark)).collect()
    assert len(got) == 9 and all(not x["kept"] for x in got if x["n_words"] == 0)
    assert quality_rules(empty_documents(spark)).count() == 0


def expected_lines(docs: dict[int, str | None]) -> dict[int, tuple[int, int, str]]:
    def key(line: str) -> str:
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))

    holders = collections.defaultdict(set)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != d)]
        out[d] = len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()
    return out


def decided(spark, docs: dict, store: LineStore) -> dict:
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    return {x["doc_id"]: (x["n_lines"], x["n_dropped"], hashlib.sha256(x["kept"].encode()).hexdigest()) for x in line_dedup(df, store).collect()}


def test_line_dedup_is_incremental_and_reversible(spark):
    r = random.Random(5)
    pool = [" " * r.randrange(3) + r.choice(["Shared line number ", "SHARED line number ", "x"]) + str(k // 2) + r.choice(["", "\t"]) for k in range(30)]
    docs = {d: "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for d in range(40)}
    docs[50], docs[51] = None, ""
    frame = lambda ids: spark.createDataFrame([(d, docs[d]) for d in ids], "doc_id bigint, text string")
    ids = sorted(docs)
    store = LineStore(spark, new_folder(spark, "t"), n_shards=3)
    store.insert(frame(ids[:20]))
    assert decided(spark, {d: docs[d] for d in ids[:20]}, store) == expected_lines({d: docs[d] for d in ids[:20]})
    store.insert(frame(ids[20:]))
    assert decided(spark, docs, store) == expected_lines(docs)
    gone = [0, 3, 7, 21, 30]
    store.delete(spark.createDataFrame([(g,) for g in gone], "doc_id bigint"))
    left = {d: t for d, t in docs.items() if d not in gone}
    assert decided(spark, left, store) == expected_lines(left)
    store.insert(frame(gone))
    assert decided(spark, docs, store) == expected_lines(docs)
    exact = store.refs().where("min_doc < max_doc").select("h1", "shard").collect()
    filters = {x["shard"]: cuckoo.CuckooFilter(x["n_buckets"], bytes(x["cells"])) for x in store.filters().collect()}
    assert all(filters[x["shard"]].contains(np.array([x["h1"]]).astype(np.uint64))[0] for x in exact)
    assert sum(map(len, filters.values())) == len(exact)


def test_reopened_and_compacted_store(spark, monkeypatch):
    r = random.Random(6)
    docs = {d: "\n".join(f"Line number {r.randrange(25)}" for _ in range(r.randrange(1, 6))) for d in range(24)}
    frame = lambda ids: spark.createDataFrame([(d, docs[d]) for d in ids], "doc_id bigint, text string")
    folder = new_folder(spark, "t")
    monkeypatch.setattr(line_dedup_module, "BROADCAST_BYTES", 0)  # lines go to the filters
    LineStore(spark, folder, n_shards=3, compact_after=2).insert(frame(range(8)))
    stale = LineStore(spark, folder, n_shards=3, compact_after=2)
    LineStore(spark, folder, n_shards=3, compact_after=2).insert(frame(range(8, 16)))
    with pytest.raises(Exception, match="(?i)exist"):
        stale.insert(frame(range(16, 20)))
    LineStore(spark, folder, n_shards=3, compact_after=2).delete(spark.createDataFrame([(2,), (9,), (77,)], "doc_id bigint"))
    LineStore(spark, folder, n_shards=3, compact_after=2).insert(frame(range(16, 24)))
    store = LineStore(spark, folder, n_shards=3, compact_after=2)
    left = {d: t for d, t in docs.items() if d not in (2, 9)}
    assert store.generation == 4 and len(store.wrote["refs"]) <= 2 and decided(spark, left, store) == expected_lines(left)
    with pytest.raises(ValueError, match="shards"):
        LineStore(spark, folder, n_shards=4)


def test_columns_of_clashing_names(spark):
    names = ["lines", "gone", "text_hash", "row", "pos", "h1", "kept"]
    docs = spark.createDataFrame([(1, "one long shared line", *names), (2, "one long shared line\nand another", *names)], f"doc_id bigint, text string, {', '.join(f'{n} string' for n in names)}")
    store = LineStore(spark, new_folder(spark, "t"), n_shards=2)
    store.insert(docs.select("doc_id", "text"))
    got = sorted(line_dedup(docs, store).collect())
    assert [x["kept"] for x in got] == ["one long shared line", "and another"] and all(x[n] == n for x in got for n in names[:-1])


def test_line_dedup_of_odd_and_no_rows(spark):
    docs = odd_documents(spark)
    store = LineStore(spark, new_folder(spark, "t"), n_shards=2)
    store.insert(docs.select("doc_id", "text"))
    got = sorted(((x["doc_id"], x["n_lines"], x["n_dropped"]) for x in line_dedup(docs, store).collect()), key=str)
    assert got == sorted([(1, 2, 0), (2, 1, 0), (3, 1, 0), (None, 1, 0), (4, 3, 0), (5, 2, 2), (5, 2, 2), (6, 1, 0), (7, 1, 0)], key=str)
    none = LineStore(spark, new_folder(spark, "t"))
    none.insert(empty_documents(spark).select("doc_id", "text"))
    assert line_dedup(empty_documents(spark), none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 2000])
def test_cuckoo_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    f = cuckoo.built(keys)
    assert f.contains(keys).all() and len(f) == n
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.001
    f.delete(keys[: n // 2])
    assert len(f) == n - n // 2 and f.contains(keys[n // 2 :]).all()
    again = cuckoo.CuckooFilter(f.n_buckets, f.to_bytes())
    assert np.array_equal(again.table, f.table)


def test_full_filter_says_so():
    with pytest.raises(cuckoo.FilterFull):
        cuckoo.CuckooFilter(4).insert(np.arange(1, 40, dtype=np.uint64))


def coverage(t: str, limits: Limits) -> tuple[float, float]:
    """Shares of characters inside repeated n-grams (the worst n), and in the most frequent short n-gram (the worst n)."""
    w = WORD.findall(t)
    chars = sum(map(len, w)) or 1
    worst = top = 0.0
    for n, _ in limits.duplicate_ngrams:
        count = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        inside = {p for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
        worst = max(worst, sum(len(w[p]) for p in inside) / chars)
    for n, _ in limits.top_ngrams:
        count = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        best = max(((c, c * sum(map(len, g)) if c >= limits.top_least_times else 0) for g, c in count.items()), default=(0, 0))
        top = max(top, best[1] / chars)
    return worst, top


def test_coverage_matches_brute_force(spark):
    r = random.Random(12)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "dd é", "e\n"]) for _ in range(r.randrange(60))) for _ in range(150)]
    texts += [text(r, 60) + " " + " ".join(["go on now"] * r.randrange(5)) for _ in range(30)]
    for row in quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        worst, top = coverage(texts[row["doc_id"]], Limits())
        assert row["dup_ngram_share"] == pytest.approx(worst) and row["top_ngram_share"] == pytest.approx(top)


def test_sql_of_the_quality_rules_agrees(spark):
    import duckdb

    r = random.Random(5)
    texts = [t for _, t, *_ in odd_documents(spark).collect() if t is None or len(t) < 10_000]
    for _ in range(150):
        lines = [" ".join(r.choice("a bb ccc d# é".split()) for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 12))]
        texts.append("\n".join(r.choice(lines) for _ in range(r.randrange(1, 20))))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = con.execute(OP7_SQL)
    names = [d[0] for d in found.description]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(row) for row in quality_rules(docs).select(*names).collect())
    assert got == sorted(found.fetchall())
    assert {row[names.index("reason")] for row in got} >= {"", "short", "repeated windows"}
