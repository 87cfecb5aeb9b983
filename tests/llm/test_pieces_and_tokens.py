from __future__ import annotations

import collections
import math
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from kinmatch.llm import piece_sampling as ps
from kinmatch.llm import token_counts as tc
from kinmatch.llm.line_dedup import LineStore
from kinmatch.llm.piece_model import LatticeStore, PieceModel
from kinmatch.llm.shared import new_folder, written
from tests.llm.helpers import empty_documents, odd_documents, text, twins

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


def folder_files(folder: str) -> list[Path]:
    return list(Path(folder.removeprefix("file:")).glob("part-*"))


@pytest.fixture(scope="module")
def model() -> PieceModel:
    with open(MODEL, "rb") as f:
        return PieceModel(f.read())


def samples(m: PieceModel, texts: list[str | None], keys: np.ndarray, k: int, seed: int, **store) -> list[tuple]:
    """(row, sample, ids, text as it should decode) of every sample."""
    out = []
    for rows, numbers, found, ids, cut, whole in ps.sampled(LatticeStore(m, **store), pa.array(texts, pa.string()), keys, k, seed):
        assert m.decode_all(ids, cut) == [m.decode(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        assert all(n == sum(rows[: i + 1] == r) for i, (r, n) in enumerate(zip(rows, numbers, strict=True)) if i < 50)
        out += [(r, s, ids[a:b], t) for r, s, a, b, t in zip(rows, found, cut[:-1], cut[1:], whole, strict=True)]
    return out


def all_paths(m: PieceModel, t: str) -> dict[tuple, float]:
    """Every segmentation with its log weight."""
    b = (" " + t).encode() if t else b""
    pieces = {x: i for i, x in enumerate(m.text) if m.weight[i] > -np.inf}
    out: dict[tuple, float] = {}

    def go(i: int, path: list, score: float) -> None:
        if i == len(b):
            out[tuple(path)] = score
            return
        width = 1
        while i + width < len(b) and b[i + width] & 0xC0 == 0x80:
            width += 1
        single = False
        for j in range(i + 1, len(b) + 1):
            if (p := pieces.get(b[i:j])) is not None:
                single |= j == i + width
                go(j, [*path, p], score + m.weight[p])
        if not single:
            go(i + width, path + m.byte_id[list(b[i : i + width])].tolist(), score + m.weight[-width])

    go(0, [], 0.0)
    return out


@pytest.mark.parametrize("t", ["the cat", "ab", "x\ny", "", " 🜁a"])
def test_samples_follow_the_distribution(model, t):
    paths = all_paths(model, t)
    total = np.logaddexp.reduce(list(paths.values()))
    p = {k: math.exp(v - total) for k, v in paths.items()}
    n, k = 3000, 3
    rows = collections.defaultdict(list)
    weights = 0.0
    for row, s, ids, _ in samples(model, [t] * n, np.arange(n), k, 7):
        key = tuple(ids.tolist())
        assert abs(s.log_prob - math.log(p[key])) < 1e-9
        rows[row].append(key)
        weights += math.exp(s.log_prob - s.log_inclusion)
    assert all(len(set(x)) == len(x) == min(k, len(paths)) for x in rows.values())
    assert abs(weights / n - 1) < 0.02  # inclusion scores make the estimate of 1 unbiased
    first = collections.Counter(x[0] for x in rows.values())
    two = collections.Counter(tuple(x[:2]) for x in rows.values())
    best = sorted(p, key=p.get)[-3:]
    for a in best:
        assert abs(first[a] / n - p[a]) < 0.04
        for b in best:
            if a != b:
                assert abs(two[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.04


def test_round_trip_and_independence_of_batches(model):
    r = random.Random(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [text(r, 60), "a  b\n\n\tc  ", "日本語 ñandú €", "\x00\x01", " ", "▁a", None, "word" * 300]
    got = [(row, ids.tolist(), s.log_prob) for row, s, ids, _ in samples(model, texts, np.arange(len(texts)), 2, 3)]
    for row, ids, _ in got:
        want = (texts[row] or "").replace("▁", " ")
        assert model.decode(np.array(ids, dtype=np.int64)) == want
        assert sp.decode(ids) == want or "\x00" in want
    alone = [(i + 2, ids.tolist(), s.log_prob) for i, s, ids, _ in samples(model, texts[2:5], np.arange(2, 5), 2, 3)]
    assert alone == [x for x in got if 2 <= x[0] < 5]
    assert [x[1] for x in got] != [ids.tolist() for _, _, ids, _ in samples(model, texts, np.arange(len(texts)), 2, 4)]


def test_what_a_worker_remembers_changes_nothing(model):
    r = random.Random(4)
    texts = [text(r, 80) for _ in range(30)]
    store = LatticeStore(model, most=500, slice_bytes=100)  # purged for every batch
    for lo in range(0, 30, 5):
        keys = np.arange(lo, lo + 5)
        want = [(i, ids.tolist(), s.perturbed) for i, s, ids, _ in samples(model, texts[lo : lo + 5], keys, 2, 1)]
        got = [(i, ids[a:b].tolist(), s.perturbed) for rows, _, found, ids, cut, _ in ps.sampled(store, pa.array(texts[lo : lo + 5]), keys, 2, 1) for i, s, a, b in zip(rows, found, cut[:-1], cut[1:], strict=True)]
        assert got == want and len(store.data) >= store.nodes


def test_long_words_and_words_of_equal_polynomial_hash(model):
    texts = ["\U0001f701" * 900 + "ab", "\U0001f701" * 3000 + "ab", *twins(), "x" * 50_000]
    got = samples(model, texts, np.arange(5), 3, 0)
    assert all(model.decode(ids) == texts[row] for row, _, ids, _ in got)
    assert len({(row, tuple(ids.tolist())) for row, _, ids, _ in got}) == len(got) and {row for row, *_ in got} == set(range(5))


def test_plain_encoding_is_the_library_s(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = ps.encoded(odd_documents(spark), MODEL).collect()
    want = [sp.encode(x["text"] or "") for x in odd_documents(spark).collect()]
    assert sorted(x["ids"] for x in got) == sorted(want) and ps.encoded(empty_documents(spark), MODEL).count() == 0


def test_sampling_frames(spark):
    out = ps.sample_segmentations(odd_documents(spark), MODEL, k=2).cache()
    got = collections.Counter(x["doc_id"] for x in out.collect())
    assert got[1] == 2 and got[2] == 1 and got[3] == 1 and got[None] == 2 and got[5] == 4 and got[6] == 2
    back = {(x["doc_id"], x["sample"]): x["text"] for x in ps.decoded(out, MODEL).collect()}
    assert back[1, 1] == back[1, 2] and back[1, 1].startswith("alpha beta") and back[2, 1] == ""
    digests = ps.sample_segmentations(odd_documents(spark), MODEL, k=2, digests=True).collect()
    assert all(x["decoded_equal"] for x in digests) and len(digests) == sum(got.values())
    assert ps.sample_segmentations(empty_documents(spark), MODEL).count() == 0


def test_sparing_store_of_lattices_stays_small(model):
    """Two workers with their lattices have to fit beside an executor's heap."""
    r = random.Random(3)
    store, most = LatticeStore(model, ps.SPARING_BYTES), 0
    for _ in range(14):
        strings = list({(" " + "".join(r.choices("etaoinshrdlu", k=8))).encode() for _ in range(20_000)})
        ends = np.cumsum([len(x) for x in strings])
        store.places(b"".join(strings), ends - [len(x) for x in strings], ends)
        at = store.lattice
        most = max(most, sum(x.nbytes for x in (store.data, at.begin, at.stop, at.total, at.to, at.piece, at.share)))
    assert most < 64e6


def test_sparing_workers_give_large_arrays_back_at_once():
    code = """
import re
import numpy as np
from kinmatch.llm.shared import release_early
resident = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
np.ones(1 << 21) + 1
release_early()
before = resident()
pairs = [(np.ones(1 << 18), bytearray(100_000)) for _ in range(60)]
most, kept = resident(), [x for _, x in pairs]
del pairs
print(most - before, resident() - before)
"""
    most, left = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split())
    assert most > 100 and left < 30


def test_sparing_samples_are_the_same(spark):
    plain, sparing = (sorted(map(str, ps.sample_segmentations(odd_documents(spark), MODEL, sparing=x).collect())) for x in (False, True))
    assert plain and plain == sparing


def test_token_counts_match_the_library():
    with open(tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    r = random.Random(2)
    bits = [" ", "  ", "\n", "\t", " ", " ", "é", "ß", "a", "B", "12", ".", "'s", "<|endoftext|>", "<|endof", "😀", "日本", "\x85", "\x00", "́", "\x7f", "_"]
    texts = list(twins(1024, "A", "B")) + ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(3000)] + [text(r, 500)]
    c = tc.Counter(spec)
    assert c.separable and c(pa.array(texts)).tolist() == c.encoded(texts).tolist() == c(pa.array(texts)).tolist()
    forgetful = tc.Counter(spec)
    forgetful.REMEMBERED = 50
    assert [forgetful(pa.array(texts[k : k + 100])).tolist() for k in range(0, 3000, 100)] == [c(pa.array(texts[k : k + 100])).tolist() for k in range(0, 3000, 100)]
    with open(tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        other = tc.Counter(f.read())
    assert not other.separable and other(pa.array(texts[:50])).tolist() == other.encoded(texts[:50]).tolist()


def test_cache_is_used_and_appended_to(spark, monkeypatch):
    file = tokenizers.path("byte_bpe_50k.json")
    cache = new_folder(spark, "cache")
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id bigint, text string")
    first = sorted(tuple(x) for x in tc.token_counts(docs, cache, file, limit=1).collect())
    assert first == [(1, 3, 2, True), (2, 3, 2, True), (3, 1, 1, False)]
    assert spark.read.parquet(cache).count() == 2
    more = docs.unionByName(spark.createDataFrame([(4, "new text here")], "doc_id bigint, text string"))
    monkeypatch.setattr(tc, "BROADCAST_ROWS", 0)  # the way beyond the bound
    assert tc.token_counts(more, cache, file, limit=1).count() == 4 and spark.read.parquet(cache).count() == 3
    # what the cache says is believed, under the same tokenizer version only
    with open(file, encoding="utf-8") as f:
        version = tc.version_of(f.read())
    assert tc.read_cache(spark, cache, version).count() == 3 and tc.read_cache(spark, cache, b"other").count() == 0


def test_counts_of_odd_and_no_rows(spark):
    file = tokenizers.path("byte_bpe_50k.json")
    got = sorted(((x["doc_id"], x["n_bytes"], x["n_tokens"] == 0) for x in tc.token_counts(odd_documents(spark), new_folder(spark, "cache"), file).collect()), key=str)
    assert len(got) == 9 and (2, 0, True) in got and (3, 0, True) in got and (None, 17, False) in got
    assert tc.token_counts(empty_documents(spark), new_folder(spark, "cache"), file).count() == 0


def test_counts_of_few_texts_make_few_files(spark):
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    docs = spark.createDataFrame([(i, f"text {i % 150}") for i in range(300)], "doc_id bigint, text string")
    cache, out = new_folder(spark, "cache"), new_folder(spark, "out")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        tc.token_counts(docs, cache, tokenizers.path("byte_bpe_50k.json"), limit=1).write.parquet(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert spark.read.parquet(cache).count() == 150 and spark.read.parquet(out).selectExpr("count(*)", "count(distinct doc_id)").first() == (300, 300)
    most = 2 * spark.sparkContext.defaultParallelism
    assert len(folder_files(out)) <= most and len(folder_files(cache)) <= most + 2


def test_tables_of_given_rows_start_no_workers_of_their_own(spark):
    store = LineStore(spark, new_folder(spark, "t"), n_shards=3)
    for df in (store._read("deleted", "doc_id bigint"), written(spark, [{"a": 1, "b": None}, {"a": None, "b": "x\"y"}], "a int, b string"), written(spark, [], "a binary, b bigint")):
        assert "Python" not in df._jdf.queryExecution().toRdd().toDebugString()
    assert [tuple(x) for x in written(spark, [{"a": 1, "b": None}, {"a": None, "b": "x\"y"}], "a int, b string").collect()] == [(1, None), (None, "x\"y")]
    assert written(spark, [], "a binary, b bigint").dtypes == [("a", "binary"), ("b", "bigint")] and written(spark, [], "a binary").count() == 0
