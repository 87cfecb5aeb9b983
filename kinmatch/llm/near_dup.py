"""Near duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its three-word shingles (words are runs of letters and
digits, lower-cased), each labelled with its occurrence number, so that they are
distinct. For every sketch the ``ell`` labelled shingles of smallest hash are
taken and put in the order of the text: two texts agree in a sketch only if they
share these shingles in the same order, which makes the sketch sensitive to edit
similarity. Texts of up to ``short`` words, in which a few changes leave hardly a
shingle, also have keys that lose no pair: the longer text is cut into one piece
more than it may have changes, so one piece stands unchanged in the other, at a
place the changes allow. Texts that agree in a key are candidates; a candidate is
a link if ``1 - distance / longer length`` of the word sequences is at least
``similarity``, the distance being exact (banded alignment with a growing band).

Exact copies (equal word sequences) are one node from the start. Inside a bucket
every text is first compared with the smallest id only; after components of
these links are known, texts of buckets that hold several components meet other
centres in ``turns`` turns, and at last the pairs of a bucket that still lie in
different components are compared, so groups of copies never expand into pairs.
No bucket is left out and no pair that agrees in a key is dropped unless its
bags of words prove that it is no link: a text's words fall into ``CELLS``
classes, a bit for each class and count up to ``LEVELS`` tells whether it has so
many words of the class, and every word changed turns over two bits at most,
every word inserted or deleted one. Crowded buckets (texts that share a passage
and little else) are joined in blocks of about ``crowd`` texts, and a pair that
agrees in many sketches is looked at in the first of them only.

Defined results: null and empty texts have the same (empty) word sequence and
are copies of each other; a text under five words is one shingle; a null id gets
a null class and takes part in nothing; rows that repeat an id are one document,
near to others by any of its texts; ties go to the smaller id; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import alignment
from kinmatch.llm import textkernel as tk
from kinmatch.llm.components import stars
from kinmatch.llm.shared import collected, materialise, narrowed, new_folder, observed, tidy


@dataclass(frozen=True)
class OrderMinHash:
    k: int = 3
    n_sketches: int = 48
    ell: int = 2
    similarity: float = 0.8
    short: int = 14
    crowd: int = 1024
    turns: int = 1
    seed: int = 1


#: Classes of words and counts that a text's bits tell apart; FOLDED words of 64 bits are the whole code, xor-ed together.
CELLS, LEVELS, FOLDED = 512, 4, 4
_FOLD = [f"f{i}" for i in range(FOLDED)]


#: Ids of texts to be compared are sent to all tasks up to this many (8 bytes each); beyond it texts are shuffled to them.
BROADCAST_ROWS = 1_000_000


def _smallest(h: np.ndarray, doc: np.ndarray, begin: np.ndarray, count: np.ndarray, ell: int, limit: np.ndarray) -> np.ndarray:
    """Places of the ell smallest hashes of each text (-1 where it has fewer), in order of place."""
    likely = h <= limit
    few = np.flatnonzero(np.add.reduceat(likely, begin, dtype=np.int64) < np.minimum(count, ell))
    if len(few):  # the limit left too few: take these texts whole
        likely |= np.isin(doc, few)
    at = np.flatnonzero(likely)
    order = np.lexsort((h[at], doc[at]))
    at = at[order]
    rank = np.arange(len(at)) - np.searchsorted(doc[at], doc[at])
    at, rank = at[rank < ell], rank[rank < ell]
    out = np.full((len(begin), ell), -1, dtype=np.int64)
    out[doc[at], rank] = at
    out.sort(axis=1)
    return out


def sketches(words: tk.Words, p: OrderMinHash) -> tuple[np.ndarray, np.ndarray]:
    """For each text: a 128-bit digest of its word sequence, and the key of each sketch."""
    docs = words.n_docs
    n_words = np.diff(words.bounds)
    keys = np.zeros((docs, p.n_sketches), dtype=np.uint64)
    digest = np.zeros((docs, 2), dtype=np.uint64)
    place = np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], n_words)
    for j in range(2):
        own = words.hashes if not j else tk.span_hashes(words.data, words.starts, words.ends, 1)  # two independent hashes of each word
        terms = tk.mix(own + tk.seed_of(p.seed, 7, j) + tk.mix(place.astype(np.uint64)))
        run = np.zeros(len(terms) + 1, dtype=np.uint64)
        np.cumsum(terms, out=run[1:])
        digest[:, j] = tk.mix(run[words.bounds[1:]] - run[words.bounds[:-1]] + n_words.astype(np.uint64))
    first, shingle = tk.windows(words.hashes, words.bounds, p.k)
    doc = words.doc_of_word()[first] if len(first) else np.zeros(0, np.int64)
    short = np.flatnonzero(n_words < p.k)
    if len(short):  # one shingle: the whole text
        doc = np.concatenate([doc, short])
        first = np.concatenate([first, words.bounds[short]])
        shingle = np.concatenate([shingle, digest[short, 0]])
        order = np.argsort(doc, kind="stable")
        doc, first, shingle = doc[order], first[order], shingle[order]
    begin = np.searchsorted(doc, np.arange(docs))
    count = np.diff(np.append(begin, len(doc)))
    label = tk.occurrence(doc, shingle)
    labelled = shingle + tk.mix((label + 1).astype(np.uint64)) * (label > 0).astype(np.uint64)
    share = np.minimum(1.0, (2.5 * p.ell + 8) / count)  # so many of a text's hashes hold its ell smallest nearly always
    limit = np.where(share < 1, share * 2.0**63 * 2, 0).astype(np.uint64)
    limit[share >= 1] = np.uint64((1 << 64) - 1)
    limit = limit[doc]
    for s in range(p.n_sketches):
        picks = _smallest(tk.mix(labelled ^ tk.seed_of(p.seed, s)), doc, begin, count, p.ell, limit)
        key = np.full(docs, tk.seed_of(p.seed, s, 99), dtype=np.uint64)
        for e in range(p.ell):
            key = np.where(picks[:, e] >= 0, tk.mix(key * np.uint64(3) + shingle[picks[:, e]]), key)
        keys[:, s] = key
    return digest, keys


def short_keys(words: tk.Words, p: OrderMinHash) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the pieces by which texts of up to p.short words find all others within reach."""
    n_words = np.diff(words.bounds)
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in range(1, p.short + 1):
        docs = np.flatnonzero(n_words == n)
        for longer in range(n, p.short + 1) if len(docs) else ():
            most = int(np.floor(longer * (1 - p.similarity) + 1e-9))
            if not most or longer - n > most:  # equal texts are copies
                continue
            cuts = [i * longer // (most + 1) for i in range(most + 2)]
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for at in range(n - (hi - lo) + 1):
                    if abs(at - lo) + abs(n - longer - (at - lo)) > most:
                        continue
                    key = np.full(len(docs), tk.seed_of(p.seed, longer, i, 77), dtype=np.uint64)
                    for j in range(at, at + hi - lo):
                        key = tk.mix(key * np.uint64(3) + words.hashes[words.bounds[docs] + j])
                    texts.append(docs)
                    keys.append(key)
    return np.concatenate(texts), np.concatenate(keys)


def codes(words: tk.Words) -> np.ndarray:
    """Of each text, one bit for each class of words and each count up to LEVELS: whether it has so many words of the class."""
    cell = words.doc_of_word() * CELLS + (tk.mix(words.hashes) % np.uint64(CELLS)).astype(np.int64)
    count = np.bincount(cell, minlength=words.n_docs * CELLS).reshape(words.n_docs, 1, CELLS)
    has = count >= np.arange(1, LEVELS + 1).reshape(1, LEVELS, 1)
    return np.packbits(has.reshape(words.n_docs, LEVELS * CELLS), axis=1).view(np.int64)


def folded(code: np.ndarray) -> np.ndarray:
    """Codes in FOLDED words: folding can only make two texts more alike."""
    return np.bitwise_xor.reduce(code.reshape(len(code), CELLS * LEVELS // 64 // FOLDED, FOLDED), axis=1)


def _texts(docs: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """The rows of docs with one of the ids (doc_id, distinct)."""
    ids, seen = observed(ids, folder, rows=F.count("*"))
    if seen["rows"] <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi")


def _sketched(docs: DataFrame, p: OrderMinHash) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tk.chunks(batch.column(1), lower=True):
                words = tk.split_words(data, offsets, tk.PUNCTUATED)
                digest, keys = sketches(words, p)
                n = words.n_docs
                doc, key = short_keys(words, p)
                doc = np.concatenate([np.repeat(np.arange(n), p.n_sketches), doc])
                order = np.argsort(doc, kind="stable")
                key = np.concatenate([keys.ravel(), key])[order]
                ends = pa.array(np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64)))
                columns = [batch.column(0).slice(first, n), pa.array(digest[:, 0].copy().view(np.int64)), pa.array(digest[:, 1].copy().view(np.int64)), pa.array(np.diff(words.bounds)), lists]
                code = codes(words)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * code.shape[1]), pa.array(code.ravel())))
                columns += [pa.array(c.copy()) for c in folded(code).T]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "d1", "d2", "n_words", "keys", "code", *_FOLD])

    fold = "".join(f", {f} bigint" for f in _FOLD)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id bigint, d1 bigint, d2 bigint, n_words bigint, keys array<bigint>, code array<bigint>{fold}")


def _verified(pairs: DataFrame, docs: DataFrame, p: OrderMinHash, folder: str) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked for."""
    left, right = (pairs.select(F.col(side).alias("doc_id")).distinct() for side in ("a", "b"))
    texts = _texts(docs, left.unionByName(right).distinct(), f"{folder}/ids")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sides = []
                for name in ("text_a", "text_b"):
                    side: list[np.ndarray] = []
                    for _, data, offsets in tk.chunks(part.column(name), lower=True):
                        w = tk.split_words(data, offsets, tk.PUNCTUATED)
                        side += np.split(w.hashes | np.uint64(1), w.bounds[1:-1])
                    sides.append(side)
                longer = np.array([max(len(x), len(y)) for x, y in zip(*sides, strict=True)], dtype=np.int64)
                most = np.floor(longer * (1 - p.similarity) + 1e-9).astype(np.int64)
                near = alignment.within(list(zip(*sides, strict=True)), most) >= 0
                yield part.filter(pa.array(near)).select(["a", "b"])

    return both.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def _alike(p: OrderMinHash, code: list[str]) -> Column:
    """Whether the bits of two texts (of n words, and of m with x_... bits) leave a link possible: a change turns two over at most, an insertion or deletion one."""
    differing = F.bit_count(F.col(code[0]).bitwiseXOR(F.col(f"x_{code[0]}")))
    for s in code[1:]:
        differing += F.bit_count(F.col(s).bitwiseXOR(F.col(f"x_{s}")))
    most, gap = F.floor(F.greatest("n", "m") * (1 - p.similarity) + 1e-9), F.abs(F.col("n") - F.col("m"))
    return (gap <= most) & (differing <= 2 * most - gap)


def _other(code: list[str]) -> list[Column]:
    return [F.col(s).alias(f"x_{s}") for s in code]


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component; a node without links is its own."""
    return members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Links that stand for the components known so far, and new ones."""
    return links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))


def _star(members: DataFrame, p: OrderMinHash) -> DataFrame:
    """Pairs (a, b) of every bucket's centre with its members of other components."""
    centres = members.where("id = centre").select("key", F.col("n").alias("m"), F.col("root").alias("rx"), *_other(_FOLD)).distinct()
    pairs = members.where("id <> centre").join(centres, "key").where((F.col("root") != F.col("rx")) & _alike(p, _FOLD))
    return pairs.select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()


def _centred(members: DataFrame, turn: int) -> DataFrame:
    """Members with a centre that differs from bucket to bucket and from turn to turn."""
    return members.join(members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id", F.lit(turn)), "id"))["id"].alias("centre")), "key")


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of buckets that hold several components."""
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return placed.join(mixed, "key")


def _sized(placed: DataFrame) -> DataFrame:
    """Members with their bucket's largest component and number of members."""
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.sum("size").alias("members"))
    return placed.join(largest, "key")


@dataclass
class _Rows:
    """Members of buckets, as ``_cross`` compares them."""

    id: np.ndarray
    n: np.ndarray
    root: np.ndarray
    far: np.ndarray  # lies in the bucket's largest component
    keys: np.ndarray
    code: np.ndarray

    def __getitem__(self, at) -> _Rows:
        return _Rows(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


#: Pairs that are tested at a time.
_TESTS = 1 << 16


def _possible(key: int, small: _Rows, others: _Rows, p: OrderMinHash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the pairs that may be links, each unordered pair once: one of a smaller component, and one of another component."""
    step = max(1, _TESTS // max(1, len(others.id)))
    for lo in range(0, len(small.id), step):
        part = small[slice(lo, lo + step)]
        most = np.floor(np.maximum(part.n[:, None], others.n) * (1 - p.similarity) + 1e-9).astype(np.int64)
        gap = np.abs(part.n[:, None] - others.n)
        i, j = np.nonzero((gap <= most) & (part.root[:, None] != others.root) & (others.far | (part.id[:, None] < others.id)))
        differing = np.bitwise_count(part.code[i] ^ others.code[j]).sum(axis=1, dtype=np.int64)
        ok = differing <= 2 * most[i, j] - gap[i, j]
        i, j = i[ok], j[ok]
        same = part.keys[i] == others.keys[j]  # a pair that agrees in several sketches leaves by the first of them only
        ok = (part.keys[i, same.argmax(axis=1)] == key) | ~same.any(axis=1)
        yield part.id[i[ok]], others.id[j[ok]]


def _cross(mixed: DataFrame, nodes: DataFrame, p: OrderMinHash) -> DataFrame:
    """Pairs (a, b) of different components in one bucket, compared by blocks of about p.crowd members."""
    whole = nodes.select("id", F.slice("keys", 1, p.n_sketches).alias("keys"), "code").join(mixed.select("id").distinct(), "id", "left_semi")
    blocks = F.ceil(F.col("members") / p.crowd)
    rows = mixed.select("key", "id", "n", "root", (F.col("root") == F.col("largest")).alias("far"), blocks.alias("blocks"))
    small = rows.where("not far").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("small", F.lit(True))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("small", F.lit(False)).unionByName(small)
    rows = rows.join(whole, "id").select("key", "block", "small", "id", "n", "root", "far", "keys", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Rows] = []  # the members of the block at hand; its smaller components follow them, however many there are
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, small, ids, n, root, far = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            keys, code = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (7, 8))
            all_rows = _Rows(ids, n, root, far, keys, code.view(np.uint64))
            turn = (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (small[1:] != small[:-1])
            cut = np.concatenate([[0], np.flatnonzero(turn) + 1, [len(key)]]).tolist()
            found = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if current != (at := (int(key[lo]), int(block[lo]))):
                    current, held = at, []
                if not small[lo]:
                    held.append(all_rows[slice(lo, hi)])
                elif held:
                    if len(held) > 1:
                        held = [_Rows(*(np.concatenate([getattr(h, f) for h in held]) for f in _Rows.__dataclass_fields__))]
                    found += _possible(current[0], all_rows[slice(lo, hi)], held[0], p)
            if found:
                x, y = (np.concatenate(side) for side in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "small")
    return dealt.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def _buckets(nodes: DataFrame, folder: str) -> DataFrame:
    """(key, id, n, centre, folded code) of the nodes that agree with another in a key; the centre is the smallest id."""
    banded = nodes.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("hi")).where("centre < hi").select("key", "centre")
    # numbers of words and codes join the few rows that share a key, not all of them
    found = materialise(banded.join(shared, "key").select("key", "id", "centre"), f"{folder}-ids")
    return materialise(found.join(nodes.select("id", "n", *_FOLD), "id").select("key", "id", "n", "centre", *_FOLD), folder)


def near_duplicates(docs: DataFrame, p: OrderMinHash = OrderMinHash(), id_col: str = "doc_id", text_col: str = "text", sparing: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class), copy_of (the smallest id of equal words), n_words.

    ``sparing`` collects the executors' heaps before each phase, with the same rows: where other steps run in the same executors.
    """
    spark = docs.sparkSession
    spare = collected if sparing else lambda _: None
    spare(spark)
    folder = new_folder(spark, "near-dup")
    docs = narrowed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = materialise(_sketched(docs, p), f"{folder}/sketches")
    nodes = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_words").alias("n"), *[F.first(c).alias(c) for c in ("keys", "code", *_FOLD)])
    nodes = nodes.where("id is not null")
    members = _buckets(nodes, f"{folder}/buckets")
    seen = materialise(_star(members.withColumn("root", F.col("id")), p), f"{folder}/star")
    links = materialise(_verified(seen, docs, p, f"{folder}/star-texts"), f"{folder}/links")
    roots = stars(links, f"{folder}/first")

    # buckets of several components: other centres first, so that loose groups grow together without their pairs
    for turn in range(p.turns):
        spare(spark)
        mixed = materialise(_mixed(_placed(members.drop("centre"), roots)).drop("root"), f"{folder}/mixed-{turn}")
        star = materialise(_star(_placed(_centred(mixed, turn), roots), p).join(seen, ["a", "b"], "left_anti"), f"{folder}/star-{turn}")
        links = materialise(_verified(star, docs, p, f"{folder}/star-texts-{turn}"), f"{folder}/links-{turn}")
        roots = stars(_grown(roots, links), f"{folder}/turn-{turn}")
        members, seen = mixed, seen.unionByName(star)
    
    # then all pairs of a bucket that are still in different components
    spare(spark)
    mixed = materialise(_mixed(_placed(members.drop("centre"), roots)), f"{folder}/mixed")
    cross = _cross(_sized(mixed), nodes, p).join(seen, ["a", "b"], "left_anti")
    cross = materialise(cross, f"{folder}/cross")
    more = materialise(_verified(cross, docs, p, f"{folder}/cross-texts"), f"{folder}/more")
    roots = stars(_grown(roots, more), f"{folder}/last")

    spare(spark)
    copies = nodes.select("d1", "d2", F.col("id").alias("copy_of")).join(roots.withColumnRenamed("node", "copy_of"), "copy_of", "left").select("d1", "d2", "copy_of", F.coalesce("root", "copy_of").alias("class_id"))
    out = rows.select("doc_id", "d1", "d2", "n_words").join(copies, ["d1", "d2"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("copy_of")).alias("copy_of"), "n_words")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")
