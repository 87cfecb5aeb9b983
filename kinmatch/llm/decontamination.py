"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, lower-cased. A spaced seed hashes the
tokens at fixed offsets of a position and ignores those between, so a seed hit
survives substitutions at ignored offsets. The seeds below hit every window of
20 tokens with at most 4 substitutions, so nothing that the verification would
accept can be missed. Every hit fixes an alignment of a test item with a text;
along it equal tokens are counted, and the item counts as found if some window
of ``window`` tokens (the whole item, if it is shorter) has at least ``share``
of its tokens equal.

The seed hashes of documents and items are equi-joined. Up to ``BROADCAST_BYTES`` of
item text the items' table is sent to all tasks, sorted by hash, and documents are
looked up where they lie. Beyond it both sides are tables: a bit filter of the
items' hashes, of bounded size, goes to all tasks and drops nearly all of the
documents' seeds, and the rest is shuffled by hash; either way documents are
scanned once for their seeds, and results are the same. Of a run of hits along one
alignment only the first is kept (the hash before it is joined too and must
differ), so repetitive texts and items cost no more than their lengths together.

Defined results: null and empty texts or items match nothing; items under
``least`` tokens match nothing, as chance can't be told from a copy; repeated
rows give repeated results and null ids stay null; an item found several times
in a text is one row with its best window; very long and repetitive texts are
verified in slices of bounded size; empty tables give an empty result; further
columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import textkernel as tk
from kinmatch.llm.shared import materialise, narrowed, new_folder, tidy

#: Found by search; ``misses`` proves that no window is lost.
SEEDS = ((0, 1, 2, 3, 6, 8), (0, 1, 2, 3, 4, 5), (0, 2, 3, 4, 7, 8), (0, 1, 4, 5, 6, 7))
#: Item text up to this size is sent to all tasks as an index; beyond it both sides are shuffled by hash.
BROADCAST_BYTES = 8 << 20
#: Bits of the filter of item hashes that goes to all tasks then, at most (a power of two).
FILTER_BITS = 1 << 25
#: Tokens that are compared at a time.
_SLICE = 1 << 20
_NONE = np.uint64(0)
SCHEMA = "doc_id bigint, item_id bigint, n_matched bigint, n_window bigint"


@dataclass(frozen=True)
class Overlap:
    window: int = 20
    share: float = 0.8
    least: int = 5

    def needed(self, n: int) -> int:
        return ceil(min(n, self.window) * self.share - 1e-9)


def misses(seeds: tuple[tuple[int, ...], ...], window: int, substitutions: int) -> int:
    """Placements of that many substitutions in a window that no seed survives."""
    placed = [{o + x for x in s} for s in seeds for o in range(window - s[-1])]
    return sum(all(p & set(c) for p in placed) for c in combinations(range(window), substitutions))


def seeds_for(n: int, p: Overlap) -> tuple[tuple[int, ...], ...]:
    """Seeds that lose no window of an item of n tokens."""
    n = min(n, p.window)
    wrong = n - p.needed(n)
    if n == 20 and wrong <= 4 or wrong and n < 20 and not misses(SEEDS, n, wrong):
        return SEEDS
    return (tuple(range(n // (wrong + 1))),)  # one of wrong + 1 blocks has no substitution


def seed_hashes(words: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The seed's hash at every position where it fits."""
    n = len(words) - seed[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, tk.seed_of(len(seed), *seed), dtype=np.uint64)
    for j, x in enumerate(seed):
        out += words[x : x + n] * tk._MULT[j % 64]
    return tk.mix(out)


def _tokens(texts: pa.Array) -> list[np.ndarray]:
    """Each text's token hashes."""
    out: list[np.ndarray] = []
    for _, data, offsets in tk.chunks(texts, lower=True):
        w = tk.split_words(data, offsets, tk.PUNCTUATED)
        out += np.split(w.hashes, w.bounds[1:-1])
    return out


def _with_previous(h: np.ndarray) -> np.ndarray:
    """The hash before each, _NONE before the first."""
    return np.concatenate([[_NONE], h[:-1]]) if len(h) else h


def item_seeds(words: np.ndarray, p: Overlap, known: dict[int, tuple[tuple[int, ...], ...]]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(seed, hashes by place) of an item that is searched for; ``known`` remembers the seeds of each size."""
    if len(words) < p.least:
        return
    size = min(len(words), p.window)
    if size not in known:
        known[size] = seeds_for(size, p)
    for seed in known[size]:
        yield seed, seed_hashes(words, seed)


def text_seeds(words: np.ndarray, bounds: np.ndarray, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A seed's hash at every place of many texts, and the text of each place; -1 where the seed doesn't fit into the text."""
    h = seed_hashes(words, seed)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(h)]
    return h, np.where(np.arange(len(h)) + seed[-1] < bounds[doc + 1], doc, -1)


def best_windows(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, tokens: np.ndarray, start: np.ndarray, stop: np.ndarray, origin: np.ndarray, p: Overlap) -> np.ndarray:
    """Equal tokens of the best window of each alignment: the item tokens[start:stop] laid on words[lo:hi] from origin on."""
    size = stop - start
    out = np.zeros(len(size), dtype=np.int64)
    held = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(held, held[first] + _SLICE, side="right")) - 1)
        at, n = slice(first, last), size[first:last]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        there = np.repeat(origin[at], n) + step
        inside = (there >= np.repeat(lo[at], n)) & (there < np.repeat(hi[at], n))
        equal = inside & (words[np.where(inside, there, 0)] == tokens[np.repeat(start[at], n) + step])
        run = np.concatenate([[0], np.cumsum(equal)])
        window = np.minimum(n, p.window)
        full = step <= np.repeat(n - window, n)  # windows that begin here end inside the item
        here = np.arange(len(step))
        count = np.where(full, run[np.minimum(here + np.repeat(window, n), len(step))] - run[here], 0)
        out[at] = np.maximum.reduceat(count, begin)
        first = last
    return out


class ItemIndex:
    """Hashes of all seeds at all places of the items, sorted for lookup by hash and the hash before."""

    def __init__(self, ids: list[int | None], texts: list[str], p: Overlap) -> None:
        self.p, self.ids = p, pa.array(ids, pa.int64())
        tokens = _tokens(pa.array(texts, pa.string()))
        self.start = np.cumsum([0, *map(len, tokens)])
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        at: dict[tuple[int, ...], list[tuple[np.ndarray, ...]]] = {}
        known: dict[int, tuple[tuple[int, ...], ...]] = {}
        for i, words in enumerate(tokens):
            for seed, h in item_seeds(words, p, known):
                at.setdefault(seed, []).append((h, _with_previous(h), np.full(len(h), i), np.arange(len(h))))
        self.seeds = list(at)
        self.tables = []
        for seed in self.seeds:
            h, previous, item, place = (np.concatenate(x) for x in zip(*at[seed], strict=True))
            order = np.lexsort((previous, h))
            h, previous, item, place = h[order], previous[order], item[order], place[order]
            group = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (previous[1:] != previous[:-1])]))
            n_bits = 1 << max(16, (8 * len(h)).bit_length())
            bits = np.zeros(n_bits, dtype=bool)
            bits[(h & np.uint64(n_bits - 1)).astype(np.int64)] = True
            self.tables.append((h[group], previous[group], np.append(group, len(h)), item, place, bits))

    def _hits(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """(document, item, origin of the item in words) by columns, of the first hit of every run along an alignment."""
        for seed, (hashes, previous, begin, items, places, bits) in zip(self.seeds, self.tables, strict=True):
            h, doc = text_seeds(words, bounds, seed)
            at = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
            at = at[doc[at] >= 0]
            lo, hi = np.searchsorted(hashes, h[at], side="left"), np.searchsorted(hashes, h[at], side="right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            group = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            new = (at == bounds[doc[at]]) | (previous[group] == _NONE) | (previous[group] != h[at - 1])
            at, group = at[new], group[new]
            size = begin[group + 1] - begin[group]
            held = np.concatenate([[0], np.cumsum(size)])
            first = 0
            while first < len(at):
                last = max(first + 1, int(np.searchsorted(held, held[first] + _SLICE, side="right")) - 1)
                n = size[first:last]
                row = np.repeat(begin[group[first:last]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                there = np.repeat(at[first:last], n)
                yield np.stack([doc[there], items[row], there - places[row]])
                first = last

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, equal tokens of the best window, window) of every document and item found."""
        found = list(self._hits(words, bounds))
        none = np.zeros(0, np.int64)
        if not found:
            return none, none, none, none
        doc, item, origin = np.unique(np.concatenate(found, axis=1), axis=1)
        best = best_windows(words, bounds[doc], bounds[doc + 1], self.tokens, self.start[item], self.start[item + 1], origin, self.p)
        window = np.minimum(self.start[item + 1] - self.start[item], self.p.window)
        ok = best >= np.ceil(window * self.p.share - 1e-9).astype(np.int64)
        doc, item, best, window = doc[ok], item[ok], best[ok], window[ok]
        order = np.lexsort((-best, item, doc))
        doc, item, best, window = doc[order], item[order], best[order], window[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[new], item[new], best[new], window[new]


def contaminated(docs: DataFrame, items: DataFrame, p: Overlap = Overlap(), doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_matched, n_window) for every text and test item that overlap as far as asked for."""
    spark = docs.sparkSession
    docs = narrowed(docs, doc_id=doc_col, text=doc_text).selectExpr("cast(doc_id as bigint) doc_id", "text")
    items = narrowed(items, item_id=item_col, text=item_text).selectExpr("cast(item_id as bigint) item_id", "text").where("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes:
        return _joined(docs, items, p)
    rows = items.collect()  # at most broadcast_bytes of text
    sent = spark.sparkContext.broadcast(ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for first, data, offsets in tk.chunks(batch.column(1), lower=True):
                w = tk.split_words(data, offsets, tk.PUNCTUATED)
                doc, item, best, window = index.search(w.hashes, w.bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + first)), index.ids.take(pa.array(item)), pa.array(best.astype(np.int64)), pa.array(window.astype(np.int64))], names=["doc_id", "item_id", "n_matched", "n_window"])

    return docs.mapInArrow(tidy(run), SCHEMA)


def _identified(rows: DataFrame, name: str) -> DataFrame:
    """Rows with two hashes of their text, which stand for it."""
    return rows.select("*", F.xxhash64("text").alias(f"{name}1"), F.xxhash64(F.lit(1), "text").alias(f"{name}2"))


def _joined(docs: DataFrame, items: DataFrame, p: Overlap) -> DataFrame:
    """``contaminated`` by a shuffled join of the seed hashes of distinct texts and items."""
    spark = docs.sparkSession
    folder = new_folder(spark, "decontamination")
    docs, items = _identified(docs.where("text is not null"), "t"), _identified(items, "u")
    seed_schema = "h bigint, previous bigint, place int"

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[tuple[int, ...], ...]] = {}
        for batch in batches:
            for i, words in enumerate(_tokens(batch.column(2))):
                for seed, h in item_seeds(words, p, known):
                    n, row = len(h), batch.slice(i, 1)
                    own = [row.column(c).take(pa.array(np.zeros(n, np.int64))) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(h.view(np.int64)), pa.array(_with_previous(h).view(np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array([",".join(map(str, seed))] * n)], names=["u1", "u2", "h", "previous", "place", "seed"])

    wanted = items.dropDuplicates(["u1", "u2"]).select("u1", "u2", "text")
    seeds = materialise(wanted.mapInArrow(tidy(of_items), f"u1 bigint, u2 bigint, {seed_schema}, seed string"), f"{folder}/items")
    used = [tuple(map(int, r["seed"].split(","))) for r in seeds.select("seed").distinct().collect()]  # at most one for each item size up to the window
    n_bits = min(FILTER_BITS, 1 << max(16, (16 * seeds.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(n_bits - 1))
    bits = seeds.select((at / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(n_bits // 64, dtype=np.int64)
    held[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(held)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(sent.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for first, data, offsets in tk.chunks(batch.column(2), lower=True):
                w = tk.split_words(data, offsets, tk.PUNCTUATED)
                for seed in used:
                    h, doc = text_seeds(w.hashes, w.bounds, seed)
                    here = np.flatnonzero(filled[(h & np.uint64(len(filled) - 1)).astype(np.int64)] & (doc >= 0))
                    previous = np.where(here == w.bounds[doc[here]], _NONE, h[here - 1])
                    own = [batch.column(c).take(pa.array(doc[here] + first)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(h[here].view(np.int64)), pa.array(previous.view(np.int64)), pa.array((here - w.bounds[doc[here]]).astype(np.int32))], names=["t1", "t2", "h", "previous", "place"])

    texts = docs.dropDuplicates(["t1", "t2"]).select("t1", "t2", "text")
    found = docs.select("t1", "t2", "text").mapInArrow(tidy(of_docs), f"t1 bigint, t2 bigint, {seed_schema}")
    other = seeds.select("u1", "u2", "h", F.col("previous").alias("before"), F.col("place").alias("q"))
    hits = found.join(other, "h").where((F.col("previous") == 0) | (F.col("before") == 0) | (F.col("previous") != F.col("before")))
    hits = hits.groupBy("t1", "t2", "u1", "u2").agg(F.collect_set(F.col("place") - F.col("q")).alias("origins"))  # no more than the two lengths together
    hits = materialise(hits, f"{folder}/hits")
    pairs = hits.join(texts, ["t1", "t2"]).join(wanted.withColumnRenamed("text", "item"), ["u1", "u2"]).select("t1", "t2", "u1", "u2", "origins", "text", "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, best, windows = [], [], []
            for i in range(batch.num_rows):
                words, tokens = (_tokens(batch.column(c).slice(i, 1))[0] for c in (5, 6))
                origin = np.asarray(batch.column(4)[i].values, dtype=np.int64)
                zero = np.zeros(len(origin), np.int64)
                most = int(best_windows(words, zero, zero + len(words), tokens, zero, zero + len(tokens), origin, p).max())
                if most >= p.needed(len(tokens)):
                    keep.append(i)
                    best.append(most)
                    windows.append(min(len(tokens), p.window))
            ids = batch.select(["t1", "t2", "u1", "u2"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(best, pa.int64()), pa.array(windows, pa.int64())], names=["t1", "t2", "u1", "u2", "n_matched", "n_window"])

    sure = pairs.mapInArrow(tidy(verify), "t1 bigint, t2 bigint, u1 bigint, u2 bigint, n_matched bigint, n_window bigint")
    return docs.drop("text").join(sure, ["t1", "t2"]).join(items.drop("text"), ["u1", "u2"]).select("doc_id", "item_id", "n_matched", "n_window")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
