"""Shared storage of a run, and small helpers that every operator uses.

Everything that outlives a task is written below ``spark.checkpoint.dir``,
which driver and executors share. Only if that is unset on a local master (in
tests) a temporary folder of this machine stands in; elsewhere it is an error.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI or path, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="kinmatch-"))
        root = _OWN[0]
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name for one run of an operator; removed when the driver exits."""
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if the session still lives."""
    try:
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables below a folder of the shared storage; none if there is no such folder."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(sc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return [f.getPath().getName() for f in files.listStatus(where) if files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a table to shared storage and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates of its rows taken while they are written, without a query of their own."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), path)
    return out, seen.get


def written(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of given rows, in one partition, made without Python workers.

    ``createDataFrame`` of a list starts workers of a second kind, which stay in memory beside the operators' own.
    """
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def gathered(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """df in that many tasks at most, but two for each core; without a number a sixteenth of the shuffle's partitions, for narrow rows.

    Every file that is written costs more than its rows where they are few: two processes started to set its rights, on file systems that
    need it. Both bounds grow with the corpus or the cluster.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) // 16 if tasks is None else tasks
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, tasks))


def collected(spark: SparkSession) -> None:
    """Let the JVM of every executor collect its garbage, which gives most of the freed heap back to the machine.

    A heap grows up to its limit before it is collected, and stays so large beside the Python workers of later steps. A job with two
    tasks for each core reaches every executor that is idle; an executor that it misses keeps its heap, and nothing else changes.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def release() -> None:
    """Give freed memory of this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def release_early() -> None:
    """Let this process give back arrays of 1 MB and more as soon as they are freed: glibc else keeps ever larger ones, up to 32 MB each."""
    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 23)  # M_TRIM_THRESHOLD


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow in bounded memory.

    It gives its memory back when its task ends, as idle workers of earlier stages stay alive for a while. If the session
    has Spark's own batch size of 10,000 rows, batches become smaller: whole texts are long rows.
    """
    session = SparkSession.getActiveSession()
    if session and session.conf.get(_BATCH_ROWS) == "10000":
        session.conf.set(_BATCH_ROWS, "1000")

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


#: Ids that are taken out are sent to all tasks up to this many (8 bytes each); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """Rows of docs whose doc_id isn't among ids (doc_id); a null id stays."""
    ids = materialise(ids.select("doc_id").where("doc_id is not null").distinct(), folder)
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
