"""Quality rules by repetition coverage.

Hashes of words are rolled into n-grams of several lengths over each whole text in
numpy; the verdict comes from the share of the text's characters that lie inside
n-grams found more than once, inside the most frequent short n-gram, and inside
repeated lines. Words and lines of equal hash are compared byte by byte, and an
n-gram is rolled from the pair of its (n - 1)-grams, so all counts are exact.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; repeated rows give repeated results; an empty table gives an empty
result; a null id stays null; among equally frequent n-grams the longest counts;
further columns of the input are ignored. A text may be of any length:
working memory grows with the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import textkernel as tk
from kinmatch.llm.shared import narrowed, tidy


@dataclass(frozen=True)
class Limits:
    """Largest shares that a kept text may have."""

    #: share of characters inside n-grams of this many words found more than once
    duplicate_ngrams: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.20), (7, 0.20), (8, 0.20), (9, 0.20), (10, 0.20))
    #: share of characters inside the most frequent n-gram of this many words
    top_ngrams: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    #: an n-gram that occurs less often than this is no "most frequent" one
    top_least_times: int = 3
    #: share of characters in lines equal to an earlier line, alone or together with the share of such lines
    duplicate_line_chars: float = 0.20
    duplicate_lines_and_chars: tuple[float, float] = (0.30, 0.10)
    #: base rule: fewest words, and largest percentage of words in repeated 5-word windows
    least_words: int = 10
    repeat_percent: int = 20


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_line_char_share double, dup_ngram_share double, top_ngram_share double, reason string"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _lines(words: tk.Words, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: lines with a word, those equal to an earlier line, and word characters in the latter."""
    data, off = words.data, words.offsets
    n = len(data)
    docs = words.n_docs
    if not n:
        zero = np.zeros(docs, np.int64)
        return zero, zero, zero
    feed = np.flatnonzero(data == 0x0A)
    first = np.unique(np.concatenate([off[:-1][off[:-1] < n], feed + 1]))
    first = first[first < n]
    last = np.append(first[1:], n)
    doc = np.searchsorted(off, first, side="right") - 1
    end = np.minimum(last, off[doc + 1])
    end = np.where((end > first) & (data[end - 1] == 0x0A), end - 1, end)
    lo, hi = np.searchsorted(words.starts, first), np.searchsorted(words.starts, end)
    keep = hi > lo
    first, end, doc, lo, hi = first[keep], end[keep], doc[keep], lo[keep], hi[keep]
    again = tk.later(doc, tk.distinct(data, first, end)[1])
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(letters, out=chars[1:])
    in_line = chars[end] - chars[first]
    count = np.bincount(doc, minlength=docs)
    return count, np.bincount(doc[again], minlength=docs), np.bincount(doc[again], weights=in_line[again], minlength=docs).astype(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """All measures and verdicts of the documents of one chunk."""
    w = tk.split_words(data, offsets, hashed=False)
    docs = w.n_docs
    n_words = np.diff(w.bounds)
    lead = (data & 0xC0) != 0x80  # one per code point
    letters = lead & ~tk.WHITE[data]
    at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(letters, out=at[1:])
    chars = at[w.ends] - at[w.starts]
    word_chars = tk.sum_by(w.bounds, chars)
    symbols = tk.sum_by(offsets, _SYMBOL[data])
    n_lines, dup_lines, dup_line_chars = _lines(w, letters)
    doc = w.doc_of_word()
    some = np.maximum(word_chars, 1)

    repeat = np.zeros(docs, np.int64)
    worst, top = np.zeros(docs), np.zeros(docs)
    bad, top_bad = np.zeros(docs, dtype=bool), np.zeros(docs, dtype=bool)
    run = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=run[1:])
    duplicate, most_frequent = dict(limits.duplicate_ngrams), dict(limits.top_ngrams)
    ids = tk.distinct(data, w.starts, w.ends)[1]
    for n, first, group, times in tk.repeats(ids, w.bounds, max([5, *duplicate, *most_frequent])):
        if n == 5 or n in duplicate:
            inside = tk.covered(len(chars), first, n)
            if n == 5:
                repeat = tk.sum_by(w.bounds, inside)
            if n in duplicate:
                share = tk.sum_by(w.bounds, np.where(inside, chars, 0)) / some
                worst = np.maximum(worst, share)
                bad |= share > duplicate[n]
        if n in most_frequent and len(times):
            # characters of an n-gram times its occurrences, for the most frequent n-gram of each text, the longest of those
            one = first[np.searchsorted(group, np.arange(len(times)))]
            weight = np.where(times >= limits.top_least_times, times * (run[one + n] - run[one]), 0)
            rank = times * (1 << 32) + np.minimum(weight, (1 << 32) - 1)
            best = np.zeros(docs, np.int64)
            np.maximum.at(best, doc[one], rank)
            share = (best & ((1 << 32) - 1)) / some
            top = np.maximum(top, share)
            top_bad |= share > most_frequent[n]

    base_failed = (n_words < limits.least_words) | (100 * repeat > limits.repeat_percent * n_words)
    line_share = dup_lines / np.maximum(n_lines, 1)
    line_char_share = dup_line_chars / some
    many_lines, their_chars = limits.duplicate_lines_and_chars
    line_bad = (line_char_share > limits.duplicate_line_chars) | (line_share > many_lines) & (line_char_share > their_chars)
    reason = np.select([n_words < limits.least_words, base_failed, line_bad, bad, top_bad], ["short", "repeated windows", "repeated lines", "duplicate n-grams", "top n-gram"], "")
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "base_failed": base_failed, "kept": reason == "", "dup_line_share": line_share, "dup_line_char_share": line_char_share,
        "dup_ngram_share": worst, "top_ngram_share": top, "reason": reason,
    }


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its measures, the base verdict and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in tk.chunks(batch.column(1)):
                out = measure(data, offsets, limits)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(offsets) - 1), *[pa.array(v) if v.dtype.kind != "U" else pa.array(v.tolist(), pa.string()) for v in out.values()]], names=["doc_id", *out])

    return narrowed(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def kept_documents(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tk.chunks(batch.column(at)):
                kept = measure(data, offsets, limits)["kept"]
                yield batch.slice(first, len(kept)).filter(pa.array(kept))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the method's verdict for every whole text of ``documents``."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql(limits: Limits) -> str:
    """The same rows in DuckDB SQL, n-grams as strings of their words."""
    duplicate, most_frequent = dict(limits.duplicate_ngrams), dict(limits.top_ngrams)
    spans = sorted({5, *duplicate})
    longest = max([*spans, *most_frequent])
    leads = ", ".join(f"lead(w, {k}) OVER word AS w{k}" for k in range(1, longest))
    gram = lambda n: "concat_ws(' ', w, " + ", ".join(f"w{k}" for k in range(1, n)) + ")"
    parts = []
    for n in spans:
        parts.append(f"""
at{n} AS (SELECT r, p, w, w{n - 1} IS NOT NULL AND count(*) OVER (PARTITION BY r, w{n - 1} IS NULL, {gram(n)}) > 1 AS again FROM word_at),
in{n} AS (SELECT r, w, max(CAST(again AS INT)) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM at{n}),
d{n} AS (SELECT r, sum(inside) AS words, sum(inside * length(w)) AS chars FROM in{n} GROUP BY r)""")
    for n in most_frequent:
        parts.append(f"""
g{n} AS (SELECT r, count(*) AS times, length(replace(any_value({gram(n)}), ' ', '')) AS chars FROM word_at WHERE w{n - 1} IS NOT NULL GROUP BY r, {gram(n)}),
t{n} AS (SELECT r, max(CAST(times AS HUGEINT) * 4294967296 + CASE WHEN times >= {limits.top_least_times} THEN times * chars ELSE 0 END) % 4294967296 AS chars FROM g{n} GROUP BY r)""")
    share = lambda t: f"coalesce({t}.chars, 0) / CAST(greatest(coalesce(n.chars, 0), 1) AS DOUBLE)"
    over = lambda what: " OR ".join(f"{share(f't{n}' if what is most_frequent else f'd{n}')} > {limit!r}::DOUBLE" for n, limit in what.items())
    many_lines, their_chars = limits.duplicate_lines_and_chars
    joins = " ".join(f"LEFT JOIN {t} ON {t}.r = doc.r" for t in ["l", *[f"d{n}" for n in spans], *[f"t{n}" for n in most_frequent]])
    return f"""WITH doc AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM doc),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM listed),
n AS (SELECT r, count(*) AS words, sum(length(w)) AS chars FROM word GROUP BY r),
word_at AS (SELECT r, p, w, {leads} FROM word WINDOW word AS (PARTITION BY r ORDER BY p)),
line AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM (SELECT r, string_split(text, chr(10)) AS ls FROM doc)),
later AS (SELECT r, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY p) > 1 AS again FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l AS (SELECT r, count(*) AS lines, count(*) FILTER (again) AS again, coalesce(sum(chars) FILTER (again), 0) AS chars FROM later GROUP BY r),{",".join(parts)},
m AS (SELECT doc_id, coalesce(n.words, 0) AS n_words, CAST(coalesce(n.chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.again, 0) AS n_dup_lines, CAST(coalesce(d5.words, 0) AS BIGINT) AS n_repeat_words,
  coalesce(l.again, 0) / CAST(greatest(coalesce(l.lines, 0), 1) AS DOUBLE) AS dup_line_share, {share("l")} AS dup_line_char_share,
  greatest(0.0::DOUBLE, {", ".join(share(f"d{n}") for n in duplicate)}) AS dup_ngram_share, greatest(0.0::DOUBLE, {", ".join(share(f"t{n}") for n in most_frequent)}) AS top_ngram_share,
  {over(duplicate)} AS bad, {over(most_frequent)} AS top_bad
  FROM doc LEFT JOIN n ON n.r = doc.r {joins}),
judged AS (SELECT *, n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed,
  dup_line_char_share > {limits.duplicate_line_chars!r}::DOUBLE OR (dup_line_share > {many_lines!r}::DOUBLE AND dup_line_char_share > {their_chars!r}::DOUBLE) AS line_bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR line_bad OR bad OR top_bad) AS kept,
  dup_line_share, dup_line_char_share, dup_ngram_share, top_ngram_share,
  CASE WHEN n_words < {limits.least_words} THEN 'short' WHEN base_failed THEN 'repeated windows' WHEN line_bad THEN 'repeated lines' WHEN bad THEN 'duplicate n-grams' WHEN top_bad THEN 'top n-gram' ELSE '' END AS reason FROM judged"""


OP7_SQL = _sql(Limits())
