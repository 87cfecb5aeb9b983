"""Cutting lineage: checkpoints in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint, readable by all executors and safe if one is lost."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared(spark))
    return df.checkpoint(eager=True)


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master may do without the setting, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="kinmatch-"))
        folder = _OWN[0]
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared storage."""
    return f"{_shared(spark)}/{what}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file into the shared storage."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(text.encode()))
    out.close()


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than needed to know."""
    return df.limit(rows + 1).count() <= rows
