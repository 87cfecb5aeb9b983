"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A store in shared storage holds three tables:

* ``postings``: one row per line occurrence (line key, document, position), in
  one folder per inserted batch. Deleting a document writes its id to ``deleted``.
* ``refs``: exact reference counts. A log of (key, refs, min_doc, max_doc,
  generation); a key's newest row holds. Each insertion or deletion appends the
  rows of the keys that it touches and nothing else.
* ``filters``: for every shard of keys a cuckoo filter of the keys held by two
  documents or more. Keys that become shared are inserted, keys that stop being
  shared are deleted, and a shard is rebuilt from the exact table only when full.

To decide, lines are first tested against the filters, which reject nearly all
unshared lines; the rest is joined with the exact counts, so that false positives
of the filter can't change the result. Filters of up to ``BROADCAST_BYTES`` in all
are sent to all tasks, and lines are tested where they lie; larger ones are dealt
out by shard, each to ``SALTS`` places, and the lines go there, so that neither a
task nor the driver ever holds more than one shard's filter. Choose ``n_shards``
so that a shard's filter (about 2.5 bytes a shared key) fits a task.

``manifest`` names the folders that count, one table for each change, written last:
a store that is opened again goes on where it was, a change that failed leaves
nothing behind that is read, and of two objects that change the same state the
second one fails. Folders are never overwritten. After ``compact_after`` changes
the logs of ``refs``, ``postings`` and ``deleted`` are written anew as one batch.

Defined results: a null or empty text is one empty line and stays; keys under
``least`` code points never count; rows with a null id are no documents: they
count for nothing and keep all their lines; rows that repeat an id are one
document, each row filtered by itself; ties can't arise, as the smallest id
holds the line; an empty table gives an empty result; further columns of the
input may have any names and come back as they are, but for ``n_lines``,
``n_dropped`` and ``kept``, which the result has itself. Very long texts and lines
are whole rows and keys of 128 bits, so only one text at a time is held.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import cuckoo
from kinmatch.llm.shared import folders_in, narrowed, new_folder, tidy, written

LEAST = 10
#: Filters are sent to all tasks up to this size in all; beyond it lines go to the filters.
BROADCAST_BYTES = 48 << 20
#: Places to which a shard's filter is dealt then, so that a line that very many texts hold doesn't meet in one task.
SALTS = 16
_SPACE = " \t\n\x0b\f\r"
_POSTINGS = "h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, pos int"
_REFS = "h1 bigint, h2 bigint, refs bigint, min_doc bigint, max_doc bigint, generation int, shard int"
_MANIFEST = "what string, generation int, folder string"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def postings_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per line occurrence whose key is long enough; 128 bits of hash stand for the key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")


def _shared(refs: DataFrame) -> DataFrame:
    return refs.where("min_doc < max_doc")


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))


class LineStore:
    """The store's state lies in ``path``; an object holds the names of the folders that counted when it last read or wrote."""

    def __init__(self, spark: SparkSession, path: str, n_shards: int = 64, least: int = LEAST, compact_after: int = 8) -> None:
        self.spark, self.path, self.n_shards, self.least, self.compact_after = spark, path.rstrip("/"), n_shards, least, compact_after
        self.generation = 0
        self.wrote: dict[str, list[tuple[int, str]]] = {"postings": [], "deleted": [], "refs": [], "filters": []}
        changes = folders_in(spark, f"{self.path}/manifest")
        if changes:
            self.generation = max(map(int, changes))
            for row in spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{self.generation}").orderBy("generation", "folder").collect():
                if row["what"] == "store":
                    if (row["generation"], row["folder"]) != (n_shards, str(least)):
                        raise ValueError(f"the store has {row['generation']} shards and keys of at least {row['folder']} code points")
                else:
                    self.wrote[row["what"]].append((row["generation"], row["folder"]))

    def _new(self, what: str) -> str:
        return f"{self.path}/{what}/{self.generation}-{uuid.uuid4().hex[:12]}"

    def _write(self, what: str, rows: DataFrame) -> None:
        folder = self._new(what)
        rows.write.parquet(folder)
        self.wrote[what].append((self.generation, folder.rsplit("/", 1)[-1]))

    def _commit(self) -> None:
        """Make the change count; fails if the state has changed in the meantime."""
        rows = [(what, g, f) for what, names in self.wrote.items() for g, f in names] + [("store", self.n_shards, str(self.least))]
        rows = [{"what": what, "generation": g, "folder": f} for what, g, f in rows]
        written(self.spark, rows, _MANIFEST).write.mode("errorifexists").parquet(f"{self.path}/manifest/{self.generation}")

    def _read(self, what: str, schema: str, wrote: list[tuple[int, str]] | None = None) -> DataFrame:
        folders = [f"{self.path}/{what}/{f}" for _, f in (self.wrote[what] if wrote is None else wrote)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else written(self.spark, [], schema)

    def postings(self) -> DataFrame:
        """Postings of the documents that are in the store: a deletion holds for the batches before it."""
        if not self.wrote["deleted"]:
            return self._read("postings", _POSTINGS)
        gone = None
        for entry in self.wrote["deleted"]:
            part = self._read("deleted", "doc_id bigint", [entry]).select("doc_id", F.lit(entry[0]).alias("gone"))
            gone = part if gone is None else gone.unionByName(part)
        gone = gone.groupBy("doc_id").agg(F.max("gone").alias("gone"))
        rows = None
        for entry in self.wrote["postings"]:
            part = self._read("postings", _POSTINGS, [entry]).withColumn("since", F.lit(entry[0]))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self._read("postings", _POSTINGS)
        return rows.join(gone, "doc_id", "left").where("gone is null or gone < since").select("h1", "h2", "doc_id", "text_hash", "pos")

    def refs(self) -> DataFrame:
        """The exact reference counts: every key's newest row."""
        log = self._read("refs", _REFS)
        if len(self.wrote["refs"]) <= 1:
            return log.where("refs > 0").drop("generation")
        newest = log.groupBy("h1", "h2").agg(F.max_by(F.struct("refs", "min_doc", "max_doc", "shard"), "generation").alias("r"))
        return newest.select("h1", "h2", "r.*").where("refs > 0")

    def _compact(self) -> None:
        """Write long logs anew as one batch each."""
        if len(self.wrote["refs"]) > self.compact_after:
            rows, self.wrote["refs"] = self.refs(), []
            self._write("refs", rows.select("h1", "h2", "refs", "min_doc", "max_doc", F.lit(self.generation).alias("generation"), "shard"))
        if len(self.wrote["postings"]) + len(self.wrote["deleted"]) > self.compact_after:
            rows, self.wrote["postings"], self.wrote["deleted"] = self.postings(), [], []
            self._write("postings", rows)

    # changes

    def insert(self, docs: DataFrame) -> None:
        """Add a batch of documents (doc_id, text)."""
        self.generation += 1
        self._write("postings", postings_of(docs, self.least))
        new = _counted(self._read("postings", _POSTINGS, self.wrote["postings"][-1:]))
        if not self.wrote["refs"]:
            self._apply(new.withColumn("was_shared", F.lit(False)))
            self._commit()
            return
        old = self.refs().select("h1", "h2", F.col("refs").alias("r"), F.col("min_doc").alias("a"), F.col("max_doc").alias("b"))
        both = new.join(old, ["h1", "h2"], "left")
        self._apply(both.select("h1", "h2", (F.col("refs") + F.coalesce("r", F.lit(0))).alias("refs"), F.least("min_doc", "a").alias("min_doc"), F.greatest("max_doc", "b").alias("max_doc"), F.coalesce(F.col("a") < F.col("b"), F.lit(False)).alias("was_shared")))
        self._compact()
        self._commit()

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents (doc_id) out again: the store is then as if they had never been inserted."""
        gone = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
        touched = self.postings().join(gone, "doc_id", "left_semi").select("h1", "h2").distinct()
        self.generation += 1
        folder = self._new("touched")
        touched.write.parquet(folder)
        touched = self.spark.read.schema("h1 bigint, h2 bigint").parquet(folder)
        self._write("deleted", gone)
        before = self.refs().join(touched, ["h1", "h2"], "left_semi").select("h1", "h2", (F.col("min_doc") < F.col("max_doc")).alias("was_shared"))
        after = _counted(self.postings().join(touched, ["h1", "h2"], "left_semi"))
        self._apply(before.join(after, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("refs", F.lit(0).cast("bigint")).alias("refs"), "min_doc", "max_doc", "was_shared"))
        self._compact()
        self._commit()

    def _apply(self, changed: DataFrame) -> None:
        """Append the changed keys' counts, and carry keys that became or stopped being shared into the filters."""
        shard = F.pmod(F.xxhash64("h1", "h2"), F.lit(self.n_shards)).cast("int").alias("shard")
        folder = self._new("changed")
        changed.select("h1", "h2", "refs", "min_doc", "max_doc", shard, "was_shared").write.parquet(folder)
        rows = self.spark.read.schema("h1 bigint, h2 bigint, refs bigint, min_doc bigint, max_doc bigint, shard int, was_shared boolean").parquet(folder)
        self._write("refs", rows.select("h1", "h2", "refs", "min_doc", "max_doc", F.lit(self.generation).alias("generation"), "shard"))
        shared = F.coalesce(F.col("min_doc") < F.col("max_doc"), F.lit(False))
        turned = rows.where(shared != F.col("was_shared")).select("shard", "h1", shared.alias("insert"))
        old = self.filters()
        state = "shard int, n_buckets bigint, n_keys bigint, cells binary"

        def turn(key: tuple, have: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            plus = keys.loc[keys["insert"], "h1"].to_numpy().astype(np.uint64)
            minus = keys.loc[~keys["insert"], "h1"].to_numpy().astype(np.uint64)
            if not len(have):
                f, n = cuckoo.built(plus), len(plus)
            else:
                f, n = cuckoo.CuckooFilter(int(have["n_buckets"][0]), have["cells"][0]), int(have["n_keys"][0]) - len(minus) + len(plus)
                f.delete(minus)
                try:
                    if n > f.table.size * 0.9:
                        raise cuckoo.FilterFull
                    f.insert(plus)
                except cuckoo.FilterFull:  # built anew from the exact table below
                    return pd.DataFrame({"shard": [key[0]], "n_buckets": [0], "n_keys": [n], "cells": [b""]})
            return pd.DataFrame({"shard": [key[0]], "n_buckets": [f.n_buckets], "n_keys": [n], "cells": [f.to_bytes()]})

        new = old.groupBy("shard").cogroup(turned.groupBy("shard")).applyInPandas(turn, state)
        folder = self._new("turned")
        new.write.parquet(folder)
        new = self.spark.read.schema(state).parquet(folder)
        full = new.where("n_buckets = 0")
        if len(self.wrote["filters"]) and full.limit(1).count():

            def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
                f = cuckoo.built(keys["h1"].to_numpy().astype(np.uint64))
                return pd.DataFrame({"shard": [key[0]], "n_buckets": [f.n_buckets], "n_keys": [len(keys)], "cells": [f.to_bytes()]})

            again = _shared(self.refs()).join(full.select("shard"), "shard", "left_semi").select("shard", "h1").groupBy("shard").applyInPandas(build, state)
            new = new.where("n_buckets > 0").unionByName(again)
        self._write("filters", new)
        self.wrote["filters"] = self.wrote["filters"][-1:]

    def filters(self) -> DataFrame:
        """The filters of the current generation."""
        return self._read("filters", "shard int, n_buckets bigint, n_keys bigint, cells binary")

    # decisions

    def drops(self) -> DataFrame:
        """(doc_id, text_hash, pos) of every line of the store's documents that another document holds."""
        lines = self.postings()
        filters = self.filters()
        size = filters.agg(F.sum(F.col("n_buckets") * 2 * cuckoo.SLOTS)).first()[0] or 0
        if size <= BROADCAST_BYTES:
            lines = self._tested(lines, {r["shard"]: (r["n_buckets"], bytes(r["cells"])) for r in filters.toLocalIterator()})
        else:
            lines = self._dealt(lines, filters)
        held = _shared(self.refs()).select("h1", "h2", "min_doc")
        return lines.join(held, ["h1", "h2"]).where("doc_id <> min_doc").select("doc_id", "text_hash", "pos")

    def _tested(self, lines: DataFrame, filters: dict[int, tuple[int, bytes]]) -> DataFrame:
        """The lines that the filters don't reject; no shuffle."""
        sent = self.spark.sparkContext.broadcast(filters)
        schema = lines.schema
        lines = lines.withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.lit(self.n_shards)).cast("int"))

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {k: cuckoo.CuckooFilter(n, cells) for k, (n, cells) in sent.value.items()}
            for batch in batches:
                keys = batch.column(0).to_numpy().astype(np.uint64)
                shard = batch.column(batch.num_columns - 1).to_numpy()
                order = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)) if len(order) else []
                keep = np.zeros(len(keys), dtype=bool)
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if (f := own.get(int(shard[order[lo]]))) is not None:
                        keep[order[lo:hi]] = f.contains(keys[order[lo:hi]])
                yield batch.filter(pa.array(keep)).select(batch.schema.names[:-1])

        return lines.mapInArrow(tidy(test), schema)

    def _dealt(self, lines: DataFrame, filters: DataFrame) -> DataFrame:
        """The same with filters too large to be sent to all tasks: a shard's lines come after its filter, in SALTS places."""
        schema = lines.schema
        lines = lines.withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.lit(self.n_shards)).cast("int"))
        lines = lines.select(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).alias("salt"), "shard", F.lit(0).cast("bigint").alias("n_buckets"), F.lit(None).cast("binary").alias("cells"), *schema.names)
        first = filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))).select("salt", "shard", "n_buckets", "cells", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own = None, None
            for batch in batches:
                salt, shard, buckets = (batch.column(i).to_numpy() for i in range(3))
                cut = np.flatnonzero(np.concatenate([[True], (salt[1:] != salt[:-1]) | (shard[1:] != shard[:-1]) | (buckets[1:] != buckets[:-1])])).tolist() if batch.num_rows else []
                for lo, hi in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                    place = (int(salt[lo]), int(shard[lo]))
                    if buckets[lo]:
                        at, own = place, cuckoo.CuckooFilter(int(buckets[lo]), batch.column(3)[lo].as_py())
                    elif at == place and own is not None:
                        part = batch.slice(lo, hi - lo)
                        keep = own.contains(part.column(4).to_numpy().astype(np.uint64))
                        yield part.filter(pa.array(keep)).select(schema.names)

        n = max(self.n_shards, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        both = first.unionByName(lines).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("n_buckets").desc())
        return both.mapInArrow(tidy(test), schema)


def line_dedup(docs: DataFrame, store: LineStore) -> DataFrame:
    """Documents of the store with the lines that stay: doc_id, n_lines, n_dropped, kept (text), and the columns of docs."""
    gone = store.drops().groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    # the columns of docs travel in a struct of their own, so their names can't clash with these
    named = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.struct("*").alias("row"))
    both = named.join(gone, ["doc_id", "text_hash"], "left").withColumn("lines", lines_of(F.col("row.text")))
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(numbers, "gone"), lambda i: F.get("lines", i)))
    done = both.select(
        "row",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_dropped"),
        F.array_join(stay, "\n").alias("kept"),
    )
    own = ("n_lines", "n_dropped", "kept")
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in own], *own)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines after cross-document line dedup of the whole table."""
    docs = narrowed(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    store = LineStore(spark, new_folder(spark, "op6"), n_shards=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    store.insert(docs)
    out = line_dedup(docs, store)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_key FROM (
    SELECT doc_id, pos, line, translate(trim(line, E' 	

'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
  )
), shared AS (
  SELECT lower_key, min(doc_id) AS holder FROM lines WHERE length(lower_key) >= 10
  GROUP BY lower_key HAVING min(doc_id) <> max(doc_id)
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.lower_key IS NOT NULL AND l.doc_id <> s.holder AS gone
  FROM lines l LEFT JOIN shared s ON l.lower_key = s.lower_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
