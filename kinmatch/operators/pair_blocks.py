"""All pairs of two collections of functions by blocks: gate, greedy matching of paths and scores.

Nearly all pairs share some frequent feature, so a row per candidate pair grows with the square of the
collections. Here both sides are dealt to blocks, each pair of blocks meets in one task, and what leaves a task
are the pairs that pass the gate, or only those that can be among the first of their f0. Shared features are counted
exactly: frequent ones by a matrix product, the others along their postings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Functions of a side that meet in one task, on average: at most, and at least where there are cores for more tasks.
BLOCK, LEAST_BLOCK = 16_384, 1_024
#: Left functions whose counts are held at once.
ROWS = 256
#: A feature is counted by matrix product if it is shared by more than one in so many pairs of a block.
DENSE, MOST_DENSE = 150, 2_048
#: Postings followed at once, rows of a batch, verdict rows and verdicts that a worker keeps.
POSTINGS, BATCH, VERDICT_ROWS, VERDICTS = 2_000_000, 100_000, 2_000, 1_000_000

FEATURES = ("n_both", "n_raw_only", "lengths", "text")
_KEPT: dict[tuple[str, str, str], bool] = {}


def _groups(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups starts in rising group numbers; the last entry is the end."""
    return np.searchsorted(of, np.arange(n + 1))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers of the values of several string columns by one dictionary; -1 for null."""
    chunks = [c for col in columns for c in col.chunks]
    coded = pa.chunked_array(chunks, pa.string()).dictionary_encode()
    flat = np.concatenate([np.zeros(0, np.int32), *[c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in coded.chunks]])
    return np.split(flat, np.cumsum([len(c) for c in columns])[:-1])


def _rows_and_values(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.ChunkedArray]:
    """The row and the value of each element of a list column."""
    rows, values, at = [np.zeros(0, np.int64)], [], 0
    for c in column.chunks:
        rows.append(pc.list_parent_indices(c).to_numpy(zero_copy_only=False) + at)
        values.append(pc.list_flatten(c))
        at += len(c)
    return np.concatenate(rows), pa.chunked_array(values, column.type.value_type)


class _Gate:
    """Pairs of left functions ``rows`` and right functions ``cols`` whose feature sets have a Jaccard similarity of t or more."""

    def __init__(self, left, right, n0: np.ndarray, n1: np.ndarray, rows: np.ndarray, cols: np.ndarray, t: float):
        self.n0, self.n1, self.rows, self.cols, self.t = n0[rows], n1[cols], rows, cols, t
        (r, a), (c, b) = self._within(left, rows), self._within(right, cols)
        n = 1 + max(a.max(initial=-1), b.max(initial=-1))
        in0, in1 = np.bincount(a, minlength=n), np.bincount(b, minlength=n)
        shared = in0 * in1
        dense = np.flatnonzero(shared * DENSE > len(rows) * len(cols))
        dense = dense[np.argsort(-shared[dense], kind="stable")[:MOST_DENSE]]
        place = np.where(shared > 0, np.int32(-1), np.int32(-2))
        place[dense] = np.arange(len(dense))
        self.right = np.zeros((len(dense), len(cols)), np.float32)
        kind = place[b]
        self.right[kind[kind >= 0], c[kind >= 0]] = 1
        of_left = place[a]
        self.dense_row, self.dense_at = r[of_left >= 0], of_left[of_left >= 0]
        self.row, word = r[of_left == -1], a[of_left == -1]
        c, b = c[kind == -1], b[kind == -1]
        self.postings = c[np.argsort(b, kind="stable")]
        in1 = np.bincount(b, minlength=n)
        self.start, self.length = (np.cumsum(in1) - in1)[word], in1[word]
        # by this bound no pair is lost to rounding; the exact quotient decides
        bound = lambda size: (t / (1 + t) * size * (1 - 1e-5) - 0.01).astype(np.float32)
        self.least0, self.least1 = bound(self.n0), bound(self.n1)

    @staticmethod
    def _within(features: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of, ids = features
        at = np.searchsorted(wanted, of)
        ok = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == of)
        return at[ok].astype(np.int32), ids[ok]

    def counts(self, lo: int, hi: int) -> np.ndarray:
        m = len(self.cols)
        k0, k1 = np.searchsorted(self.dense_row, (lo, hi))
        left = np.zeros((hi - lo, len(self.right)), np.float32)
        left[self.dense_row[k0:k1] - lo, self.dense_at[k0:k1]] = 1
        out = left @ self.right
        k0, k1 = np.searchsorted(self.row, (lo, hi))
        ends = np.cumsum(self.length[k0:k1])
        while k0 < k1:
            n = max(1, int(np.searchsorted(ends, (ends[0] - self.length[k0]) + POSTINGS, "right")))
            part, ends = slice(k0, k0 + n), ends[n:]
            at = np.repeat((self.row[part].astype(np.int64) - lo) * m, self.length[part]) + self.postings[_ranges(self.start[part], self.length[part])]
            first = int(self.row[k0] - lo)
            last = int(self.row[k0 + n - 1] - lo) + 1
            out[first:last] += np.bincount(at - first * m, minlength=(last - first) * m).reshape(last - first, m)
            k0 += n
        return out

    def passing(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, score) for the left functions from lo to hi."""
        k0, k1 = np.searchsorted(self.rows, (lo, hi))
        if k0 == k1 or not len(self.cols):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        c = self.counts(k0, k1)
        at = np.flatnonzero((c > 0) & (c >= self.least0[k0:k1, None] + self.least1))
        r, col, common = at // len(self.cols), at % len(self.cols), c.ravel()[at].astype(np.int64)
        score = common / (self.n0[k0:k1][r] + self.n1[col] - common)
        ok = score >= self.t
        return self.rows[k0:k1][r[ok]], self.cols[col[ok]], score[ok]


class _Paths:
    """The paths of a side's functions, by function and number; those without a formula only count."""

    def __init__(self, table: pa.Table):
        rows, flat = _rows_and_values(table["paths"])
        get = lambda name: pa.chunked_array([c.field(name) for c in flat.chunks], flat.type.field(name).type)
        self.total = np.bincount(rows, minlength=len(table))
        kept = np.flatnonzero(pc.is_valid(get("formula")).to_numpy())
        no = get("no").to_numpy()[kept]
        order = np.lexsort((no, rows[kept]))
        self.order, self.owner, self.no = kept[order], rows[kept][order], no[order]
        self.form, self.formula = get("form").take(self.order), get("formula").take(self.order)
        self.any = pc.is_null(self.form).to_numpy()
        self.memory = get("memory").take(self.order).fill_null(False).to_numpy()
        self.start = _groups(self.owner, len(table))


def _words(side: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray]:
    """The row, the part (0: in both sets, 1: raw only, 2: normalised only) and the text of each feature."""
    rows, parts, texts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int8)], [], 0
    for b in side.to_batches():
        n = pc.list_value_length(b["lengths"]).to_numpy()
        row = np.repeat(np.arange(len(b), dtype=np.int32), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        both, raw = b["n_both"].to_numpy()[row], b["n_raw_only"].to_numpy()[row]
        _, offsets, data = b["text"].buffers()
        first = np.frombuffer(offsets, np.int32)[b["text"].offset] if len(b) else 0
        ends = np.r_[0, np.cumsum(pc.list_flatten(b["lengths"]).to_numpy(), dtype=np.int64)] + first
        texts.append(pa.StringArray.from_buffers(len(row), pa.py_buffer(ends.astype(np.int32)), data or pa.py_buffer(b"")))
        rows.append(row + np.int32(at))
        parts.append((place >= both).astype(np.int8) + (place >= both + raw))
        at += len(b)
    return np.concatenate(rows), np.concatenate(parts), pa.chunked_array(texts, pa.string())


def _features(left: pa.Table, right: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows, parts and numbers of both sides' features, rows rising."""
    sides = [_words(left), _words(right)]
    ids = _codes(*[texts for _, _, texts in sides])
    return [(rows, part, own) for (rows, part, _), own in zip(sides, ids, strict=True)]


def _gates(left: pa.Table, right: pa.Table, sizes: dict, gate: float) -> list[_Gate]:
    """The gates of functions with features in normalised form, and of those with raw ones only against these."""
    features = _features(left, right)

    def between(name: str, without: int, rows: np.ndarray, cols: np.ndarray) -> _Gate:
        chosen = [(of[part != without], ids[part != without]) for of, part, ids in features]
        return _Gate(*chosen, *sizes[name], rows, cols, gate)

    (some0, none0), (some1, none1) = ((np.flatnonzero(x > 0), np.flatnonzero(x == 0)) for x in sizes["form"])
    out = [between("form", 1, some0, some1)] if len(some0) and len(some1) else []
    return out + [between("raw", 2, a, b) for a, b in ((none0, some1), (some0, none1)) if len(a) and len(b)]


def _block_pairs(left: pa.Table, right: pa.Table, gates: list[_Gate], sizes: dict, gate: float, decide: Callable, mode: str, top: int | None) -> Iterator[tuple]:
    """(left rows, right rows, gate scores, matched, valid) of the pairs of two blocks that pass the gate."""
    (none0, none1), (raw0, raw1) = (np.flatnonzero(x == 0) for x in sizes["form"]), sizes["raw"]
    p0, p1 = _Paths(left), _Paths(right)
    forms0, forms1 = _codes(p0.form, p1.form)
    texts0, texts1 = p0.formula.to_pylist(), p1.formula.to_pylist()
    formulas0, formulas1 = _codes(p0.formula, p1.formula)
    known, kinds = np.unique(formulas1, return_inverse=True)
    sample = dict(zip(kinds.tolist(), texts1, strict=True))
    verdicts: dict[int, np.ndarray] = {}

    def decided(k: int, other: np.ndarray) -> np.ndarray:
        """Whether the left path's formula counts as equal to the right formulas of these kinds."""
        if formulas0[k] not in verdicts:
            if len(verdicts) >= VERDICT_ROWS:
                verdicts.clear()
            verdicts[formulas0[k]] = np.full(len(known), -1, np.int8)
        row = verdicts[formulas0[k]]
        if len(open_ := other[row[other] < 0]):
            a = texts0[k]
            for kind in np.unique(open_).tolist():
                key = (mode, a, sample[kind])
                if key not in _KEPT:
                    if len(_KEPT) >= VERDICTS:
                        _KEPT.clear()
                    _KEPT[key] = bool(decide(a, sample[kind]))
                row[kind] = _KEPT[key]
        return row[other] > 0

    def matched(i: int, cols: np.ndarray) -> np.ndarray:
        """How many right paths of each function in cols are matched with paths of i: each left path takes the first free one."""
        out = np.zeros(len(cols), np.int64)
        if p0.start[i] == p0.start[i + 1]:
            return out
        lengths = p1.start[cols + 1] - p1.start[cols]
        at, of = _ranges(p1.start[cols], lengths), np.repeat(np.arange(len(cols)), lengths)
        form, any_, memory, kind, no = forms1[at], p1.any[at], p1.memory[at], kinds[at], p1.no[at]
        slot = np.cumsum(np.r_[False, (of[1:] != of[:-1]) | (no[1:] != no[:-1])]) if len(at) else of
        free = np.ones(len(at), bool)
        last, used = None, None
        for k in range(p0.start[i], p0.start[i + 1]):
            if p0.no[k] != last:  # paths of one number are one element
                last, used, like = p0.no[k], np.zeros(len(at), bool), np.zeros(len(at), bool)
            same = np.ones(len(at), bool) if p0.any[k] else any_ | (form == forms0[k]) | (memory if p0.memory[k] else False)
            near = np.flatnonzero(same)
            like[near[decided(k, kind[near])]] = True
            if k + 1 < p0.start[i + 1] and p0.no[k + 1] == last:
                continue
            near = np.flatnonzero(like)
            near = near[free[slot[near]]]
            first = near[np.r_[True, of[near[1:]] != of[near[:-1]]]] if len(near) else near
            free[slot[first]] = False
            out[of[first]] += 1
        return out

    for lo in range(0, len(left), ROWS):
        hi = min(lo + ROWS, len(left))
        found = [g.passing(lo, hi) for g in gates]
        blank = none0[(none0 >= lo) & (none0 < hi)]
        if len(blank) and len(none1) and gate <= 1:
            r, c = np.repeat(blank, len(none1)), np.tile(none1, len(blank))
            ok = (raw0[r] > 0) | (raw1[c] > 0)
            found.append((r[ok], c[ok], np.ones(int(ok.sum()))))
        if not found:
            continue
        r, c, s = (np.concatenate([x[i] for x in found]) for i in range(3))
        if len(found) > 1:
            order = np.lexsort((c, r))
            r, c, s = r[order], c[order], s[order]
        starts = _groups(r - lo, hi - lo)
        for i in range(lo, hi):
            cols, score = c[starts[i - lo] : starts[i - lo + 1]], s[starts[i - lo] : starts[i - lo + 1]]
            valid = (p1.total[cols] > 0) & (p0.total[i] > 0)
            if top is not None:
                cols, score, valid = cols[valid], score[valid], valid[valid]
            if not len(cols):
                continue
            m = matched(i, cols)
            if top is not None and len(cols) > top:
                # right functions lie by rising f1
                best = np.lexsort((cols, 1 - score, -m))[:top]
                cols, score, valid, m = cols[best], score[best], valid[best], m[best]
            yield np.full(len(cols), i), cols, score, np.where(valid, m / max(1, p0.total[i]), np.nan), valid


def blocks_of(side: DataFrame) -> int:
    """To how many blocks a side is dealt."""
    n, cores = side.count(), side.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // BLOCK), min(-(-n // LEAST_BLOCK), math.isqrt(2 * cores) + 1))


def compared_blocks(left: DataFrame, right: DataFrame, n0: int, n1: int, gate: float, decide: Callable[[str, str], bool], mode: str, top: int | None = None) -> DataFrame:
    """(f0, f1, gate, score) of the pairs that pass the gate; score is null where a function has no paths.

    left is (f0, ``feature_columns``, paths), right the same with f1; paths are (no, form, memory, formula), where form is
    null if the last call is unknown. They are dealt to n0 and n1 blocks. ``decide`` tells whether two formulas
    count as equal; a worker asks it once a pair. With ``top`` only pairs with a score are kept, and of each f0 those
    alone that are among its first in a pair of blocks by falling score, falling gate, rising f1.
    """
    cols = ["n_form", "n_raw", *FEATURES, "paths"]
    deal = lambda side, id_, n: side.withColumn("own", F.pmod(F.xxhash64(id_), F.lit(n)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t0, t1 = left.schema["f0"].dataType, right.schema["f1"].dataType
    a = deal(left, "f0", n0).select("own", "f0", *cols, each(n1).alias("other")).select((F.col("own") * n1 + F.col("other")).alias("cell"), "f0", F.lit(None).cast(t1).alias("f1"), F.lit(True).alias("is_left"), *cols)
    b = deal(right, "f1", n1).select("own", "f1", *cols, each(n0).alias("other")).select((F.col("other") * n1 + F.col("own")).alias("cell"), F.lit(None).cast(t0).alias("f0"), "f1", F.lit(False).alias("is_left"), *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, tuple[list, list]] = {}
        for b in batches:
            for cell in pc.unique(b["cell"]).to_pylist():
                own = b.filter(pc.equal(b["cell"], cell))
                for k, mask in enumerate((own["is_left"], pc.invert(own["is_left"]))):
                    cells.setdefault(cell, ([], []))[k].append(own.filter(mask))
        while cells:
            x, y = map(pa.Table.from_batches, cells.pop(next(iter(cells))))
            if not len(x) or not len(y):
                continue
            y = y.take(pc.sort_indices(y["f1"]))
            sizes = {name: [side[f"n_{name}"].to_numpy().astype(np.int64) for side in (x, y)] for name in ("form", "raw")}
            gates = _gates(x, y, sizes, gate)
            x, y = x.select(["f0", "paths"]), y.select(["f1", "paths"])  # the texts of the features are numbers by now
            held, n = [], 0
            for found in _block_pairs(x, y, gates, sizes, gate, decide, mode, top):
                held.append(found)
                n += len(found[0])
                if n >= BATCH:
                    yield made(x, y, held)
                    held, n = [], 0
            if held:
                yield made(x, y, held)

    def made(x: pa.Table, y: pa.Table, held: list[tuple]) -> pa.RecordBatch:
        i, j, g, s, ok = (np.concatenate([h[k] for h in held]) for k in range(5))
        ids = [x["f0"].take(pa.array(i)).combine_chunks(), y["f1"].take(pa.array(j)).combine_chunks()]
        return pa.RecordBatch.from_arrays([*ids, pa.array(g), pa.array(s, mask=~ok)], names=["f0", "f1", "gate", "score"])

    schema = T.StructType([T.StructField("f0", t0), T.StructField("f1", t1), T.StructField("gate", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return a.unionByName(b).repartitionById(n0 * n1, "cell").mapInArrow(run, schema)


def feature_columns(side: DataFrame, id_: str, feats: str, form: str) -> DataFrame:
    """(id, n_form, n_raw, n_both, n_raw_only, lengths, text): sizes of a raw and a normalised feature set, and their
    features in one text, which travels at half the size of an array: those in both sets, in the raw one, in the other."""
    a, b = F.col(feats), F.col(form)
    part = lambda c: F.array_compact(c)
    out = side.select(id_, F.size(b).alias("n_form"), F.size(a).alias("n_raw"), part(F.array_intersect(b, a)).alias("both"), part(F.array_except(a, b)).alias("raw_only"), part(F.array_except(b, a)).alias("rest"))
    out = out.select(id_, "n_form", "n_raw", F.size("both").alias("n_both"), F.size("raw_only").alias("n_raw_only"), F.concat("both", "raw_only", "rest").alias("all"))
    return out.select(id_, "n_form", "n_raw", "n_both", "n_raw_only", F.transform("all", F.octet_length).alias("lengths"), F.array_join("all", "").alias("text"))
