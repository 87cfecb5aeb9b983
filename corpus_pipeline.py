"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but
the last returns the columns of documents. Between stages the rows are written
as Parquet and read again, so a lost executor repeats one stage's tasks at most.

Defined results: null and empty texts fail the quality rules; the other stages
follow their operators' docstrings; a row with a null doc_id is never grouped,
nor dropped by the later stages; rows that repeat a doc_id stay or go together;
documents that line dedup leaves without a word are copies of each other, so the
one of the smallest id goes on, with its empty text; ties go to the smaller id;
very long texts are taken whole; further columns, of any names, are kept as they
are; an empty table gives an empty result.

All stages share the executors, whose heaps would stay as large as any stage made
them: before and within stages heaps are collected, so that Python workers have room.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.decontamination import contaminated
from kinmatch.llm.line_dedup import LineStore, line_dedup
from kinmatch.llm.near_dup import near_duplicates
from kinmatch.llm.piece_sampling import sample_segmentations
from kinmatch.llm.quality_rules import kept_documents
from kinmatch.llm.shared import collected, new_folder, without

#: The last stage can't be expressed in SQL; tests hold all stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds."""
    collected(spark)
    store = LineStore(spark, new_folder(spark, "pipeline-lines"), n_shards=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    store.insert(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    collected(spark)
    # the other columns travel in one of their own, so their names can't clash with the operator's
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup(docs.select("doc_id", "text", *([F.struct(*others).alias("document")] if others else [])), store)
    changed = {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast("bigint").alias("n_chars")}
    return out.select(*[changed[c] if c in changed else F.col(f"document.`{c}`").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id."""
    classes = near_duplicates(docs, sparing=True)
    return without(docs, classes.where("doc_id <> class_id"), new_folder(spark, "pipeline-copies"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    collected(spark)
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found, new_folder(spark, "pipeline-benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    import public_tokenizers

    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2, sparing=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicate documents", near_copies),
    ("benchmark decontamination", benchmark),
    ("piece sampling", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
