"""Token counts through a digest cache.

The cache is a Parquet table in shared storage: (content digest, tokenizer
version, n_tokens). A version is the digest of the tokenizer's file, its library
and the library's version, so a changed file never meets old counts. Documents
are joined with it by digest; only distinct texts that it lacks are encoded, and
their counts are appended before the final, narrow join. Content is normalised
only so far as can't change a count: a null is the empty text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
and equal texts are encoded once and each get their row; null ids stay null; an
empty table gives an empty result; further columns of the input are ignored.
A failed run appends nothing: Spark commits the append as one job.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import textkernel as tk
from kinmatch.llm.shared import gathered, narrowed, new_folder, tidy, written

_CACHE = "content binary, tokenizer binary, n_tokens bigint"
#: Distinct misses up to this many are sent to all tasks (40 bytes each), so that a warm cache moves no text.
BROADCAST_ROWS = 200_000
#: Bytes of distinct text for one task to encode at least, so that few texts make few files.
TASK_BYTES = 8 << 20


class Counter:
    """Counts as the tokenizers library gives them: no added specials, truncation or padding.

    A byte-level pre-tokenizer never joins what stands before a single space with what follows, if both are no white
    space. Such texts are cut there, and a worker encodes each distinct piece once; a text's count is the sum of its
    pieces'. Other tokenizers get whole texts.
    """

    #: Pieces after which those not met since as many pieces ago are forgotten: a worker holds twice as many (about 150
    #: bytes each) and those of one chunk of text.
    REMEMBERED = 300_000

    def __init__(self, spec: str) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separable = separable(spec)
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def encoded(self, texts: list[str]) -> np.ndarray:
        return np.array([len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], dtype=np.int64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        for first, data, offsets in tk.chunks(texts):
            rows = slice(first, first + len(offsets) - 1)
            if not self.separable:
                raw = data.tobytes()
                out[rows] = self.encoded([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                continue
            starts = np.unique(np.concatenate([offsets[:-1], cuts(data)]))
            starts = starts[starts < len(data)]
            ends = np.append(starts[1:], len(data))
            counts = self._remembered(data, starts, ends)
            out[rows] = tk.sum_by(np.searchsorted(starts, offsets), counts)
        return out

    def _remembered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        where, back = tk.distinct(data, starts, ends)
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        if len(self.young) > self.REMEMBERED:
            self.old, self.young = self.young, {}
        young = self.young
        if new := [x for x in pieces if x not in young]:
            known = {x: n for x, n in zip(new, map(self.old.get, new), strict=True) if n is not None}
            young.update(known)
            new = [x for x in new if x not in known]
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            young.update(zip(part, self.encoded([x.decode() for x in part]).tolist(), strict=True))
        return np.fromiter(map(young.__getitem__, pieces), np.int64, len(pieces))[back]


_COUNTERS: dict[bytes, Counter] = {}


def _counter(spec: str) -> Counter:
    """This worker's tokenizer with the pieces that it remembers, kept from task to task; one at a time."""
    key = version_of(spec)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(spec)
    return _COUNTERS[key]


def separable(spec: str) -> bool:
    """Whether texts may be cut before single spaces: byte-level pre-tokenization with its own pattern and nothing before it."""
    model = json.loads(spec)
    before = model.get("pre_tokenizer") or {}
    specials = [t for t in model.get("added_tokens", []) if any(c.isspace() for c in t["content"]) or t.get("lstrip") or t.get("rstrip")]
    return model.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not specials


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between two characters that are surely no white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 1) & (at < len(data) - 1)]
    last, lead, following = data[at - 1], data[at - 2], data[at + 1]
    # no white space begins with C3..DF; in ASCII all that isn't printable stays uncut
    left = (last > 0x20) & (last < 0x7F) | (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
    right = (following > 0x20) & (following < 0x7F) | (following >= 0xC3) & (following <= 0xDF)
    return at[left & right]


def version_of(spec: str) -> bytes:
    return hashlib.sha256(f"tokenizers {tokenizers.__version__}\n{spec}".encode()).digest()


def read_cache(spark: SparkSession, path: str, version: bytes) -> DataFrame:
    """(content, n_tokens) of one tokenizer version; an absent cache is created empty."""
    written(spark, [], _CACHE).write.mode("append").parquet(path)
    rows = spark.read.schema(_CACHE).parquet(path).where(F.col("tokenizer") == F.lit(bytearray(version)))
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as file:
        spec = file.read()
    version = version_of(spec)
    texts = narrowed(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("content", F.unhex(F.sha2("text", 256)))

    known = read_cache(spark, cache, version)
    folder = new_folder(spark, "token-counts")
    sizes = texts.groupBy("content").agg(F.first(F.octet_length("text").cast("bigint")).alias("n_bytes"))
    gathered(sizes.join(known, "content", "left_anti")).write.parquet(f"{folder}/misses")
    misses = spark.read.schema("content binary, n_bytes bigint").parquet(f"{folder}/misses")
    n_misses, n_bytes = misses.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    misses = misses.select("content")
    if n_misses <= BROADCAST_ROWS:
        todo = texts.join(F.broadcast(misses), "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
    else:  # copies meet before the shuffle, then both sides lie by digest
        todo = texts.groupBy("content").agg(F.first("text").alias("text")).join(misses.hint("merge"), "content", "left_semi")
    sent = spark.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        count = _counter(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1)))], names=["content", "n_tokens"])

    todo = gathered(todo.select("content", "text"), n_bytes // TASK_BYTES + 1)
    counted = todo.mapInArrow(tidy(encode), "content binary, n_tokens bigint")
    counted.select("content", F.lit(bytearray(version)).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = read_cache(spark, cache, version)
    rows = texts.select("doc_id", "content", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return gathered(rows.join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; the cache starts empty, so every distinct text is encoded."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))
