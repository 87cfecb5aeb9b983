"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

Every path through a text's lattice of pieces is a segmentation; its probability
is its weight over the sum of all paths. Each path's log probability gets an
independent Gumbel perturbation, and the ``k`` paths of largest perturbed value
are emitted: a sample of k distinct segmentations without replacement. They are
found by a best-first (A-star) search: a set of paths is kept as one entry whose
priority is the maximum of its paths' perturbed values, drawn top-down from the
set's total probability. Taking the best entry fixes its maximal path, and splits
the rest of the set by the first string (a word with the space before it) in
which a path differs from it; the maxima of these parts are truncated Gumbels.

The inclusion score of a sampled path is the log of the chance that its
perturbed value passes the threshold, the (k + 1)-th largest value of all.

The noise is a function of the seed, the row's key, the sample and the place in
the text only, so results don't depend on partitions, batches or attempts.

Defined results: null and empty texts have the empty segmentation and nothing
else; a text with fewer than k segmentations gives all of them, with inclusion
score 0 (certain); rows that repeat a key repeat its noise; a null key counts as
0; an empty table gives an empty result; further columns of the input are
ignored. The white space mark itself, in a text, decodes as a space, as in the
library. Words may be of any length: no step recurses, and time grows in
proportion to a word's length. ``encoded`` gives the library's own segmentation.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import textkernel as tk
from kinmatch.llm.piece_model import Lattice, LatticeStore, PieceModel
from kinmatch.llm.shared import collected, narrowed, release, release_early, tidy

#: Strings are told apart, and their lattices built, once for so many bytes of text.
CHUNK_BYTES = 1 << 19
#: Bytes of strings whose lattices a worker keeps, and a sparing one.
STORE_BYTES, SPARING_BYTES = 3 << 19, 3 << 18
SCHEMA = "doc_id bigint, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


@dataclass
class Path:
    """A segmentation: edges of the lattice, where each string's edges begin, and each string's log probability."""

    edges: np.ndarray
    begin: np.ndarray
    log_p: np.ndarray


@dataclass(frozen=True)
class Sample:
    path: Path
    log_prob: float
    perturbed: float
    log_inclusion: float


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Uniform numbers in (0, 1) of integer keys."""
    h = key
    for p in parts:
        h = tk.mix(h + np.asarray(p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


_MASK = (1 << 64) - 1


def _one(key: int, *parts: int) -> float:
    """``_uniform`` of one key, in plain integers."""
    h = key
    for p in parts:
        h = (h + p * 0x9E3779B97F4A7C15 + 1) & _MASK
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & _MASK
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & _MASK
        h ^= h >> 31
    return ((h >> 11) + 0.5) * 2.0**-53


def walk(lattice: Lattice, node: np.ndarray, end: np.ndarray, key: np.ndarray, sample: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths from nodes to their strings' ends, each drawn by its probability: (edges, where each path begins, log probability, whether it's the only path)."""
    n = len(node)
    log_p = -lattice.total[node]
    live, at = np.arange(n), node.copy()
    key = tk.mix(tk.mix(key + sample.astype(np.uint64)) + place.astype(np.uint64))
    steps, owners, step = [], [], 0
    only = np.ones(n, dtype=bool)
    while len(live):
        u = _uniform(key[live], np.uint64(step))
        e = lattice.begin[at[live]]
        only[live] &= lattice.stop[at[live]] == e + 1
        left = np.flatnonzero(u >= lattice.share[e])
        while len(left):  # the last edge's share is 1
            e[left] += 1
            left = left[u[left] >= lattice.share[e[left]]]
        steps.append(e)
        owners.append(live)
        log_p[live] += lattice.score(e)
        at[live] = lattice.to[e]
        live = live[at[live] < end[live]]
        step += 1
    count = np.zeros(n, dtype=np.int64)
    for o in owners:
        count[o] += 1
    begin = np.concatenate([[0], np.cumsum(count)])
    edges = np.zeros(begin[-1], dtype=np.int64)
    for t, (e, o) in enumerate(zip(steps, owners, strict=True)):
        edges[begin[o] + t] = e
    return edges, begin, log_p, only


def truncated(phi: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers of location phi, given that they are less than most; no mass gives -inf."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = phi - np.logaddexp(phi - most, np.log(-np.log(u)))
    return np.where(np.isneginf(phi), -np.inf, out)


def _truncated(phi: float, most: float, u: float) -> float:
    """``truncated`` of one number."""
    if phi == -math.inf:
        return phi
    a, b = phi - most, math.log(-math.log(u))
    return phi - (max(a, b) + math.log1p(math.exp(-abs(a - b))))


def log_rest(log_p: np.ndarray, only: np.ndarray) -> np.ndarray:
    """log(1 - exp(log_p)), at least 1e-300 unless the path is the only one."""
    return np.where(only, -np.inf, np.log(np.maximum(-np.expm1(np.minimum(log_p, 0)), 1e-300)))


def _suffix(lattice: Lattice, path: tuple[int, ...]) -> list[float]:
    """The log weight of a path from each of its edges on."""
    return np.cumsum(lattice.score(list(path))[::-1])[::-1].tolist()


def _n_paths(lattice: Lattice, node: int, end: int, most: int) -> int:
    """How many paths lead from a node to its string's end, counted up to most."""
    begin, stop = lattice.begin[node:end].tolist(), lattice.stop[node:end].tolist()
    count = [0] * (end - node) + [1]
    for i in range(end - node - 1, -1, -1):
        for to in lattice.to[begin[i] : stop[i]].tolist():
            count[i] += count[to - node]
            if count[i] >= most:
                count[i] = most
                break
    return count[0]


def _other_path(lattice: Lattice, node: int, end: int, without: list[tuple[int, ...]], key: int, sample: int, place: int) -> tuple[list[int], float]:
    """A path of one string drawn among those that aren't in without, and its log probability among all paths."""
    edges: list[int] = []
    log_p, at = -float(lattice.total[node]), node
    same = [(x, _suffix(lattice, x)) for x in without]  # those that begin with edges
    while at < end:
        lo, hi, step = int(lattice.begin[at]), int(lattice.stop[at]), len(edges)
        run = lattice.share[lo:hi].tolist()
        mass = [y - x for x, y in zip([0.0, *run[:-1]], run, strict=True)]
        gone = [0] * len(mass)
        for x, weight in same:
            mass[x[step] - lo] -= math.exp(weight[step] - float(lattice.total[at]))
            gone[x[step] - lo] += 1
        for k, n in enumerate(gone):  # an edge all of whose paths are taken has no mass, whatever rounding leaves
            if n and mass[k] < 1e-13 and _n_paths(lattice, int(lattice.to[lo + k]), end, n + 1) == n:
                mass[k] = -1.0
            else:
                mass[k] = max(mass[k], 1e-300)
        free = [k for k in range(hi - lo) if mass[k] > 0]
        left = _one(key, sample, place, 1 << 40, step) * sum(mass[k] for k in free)
        for k in free:
            left -= mass[k]
            if left < 0:
                break
        same = [(x, weight) for x, weight in same if x[step] == lo + k]
        edges.append(lo + k)
        log_p += float(lattice.score(lo + k))
        at = int(lattice.to[lo + k])
    return edges, log_p


def top_k(lattice: Lattice, node: np.ndarray, end: np.ndarray, bounds: np.ndarray, keys: np.ndarray, k: int) -> list[list[Sample]]:
    """For each text d, whose strings are bounds[d]:bounds[d + 1] of node and end, its k best perturbed segmentations."""
    texts = len(bounds) - 1
    size = np.diff(bounds)
    owner = np.repeat(np.arange(texts), size)
    place = np.arange(len(node)) - np.repeat(bounds[:-1], size)
    values = -np.log(-np.log(_uniform(keys, np.uint64(1 << 41))))  # the maximum over all paths of a text
    queue: list[list] = [[] for _ in range(texts)]
    done: list[list[tuple[Path, float, float]]] = [[] for _ in range(texts)]
    # entries to complete: (text, first string that is free, path so far up to it, value)
    prefix: list[tuple[int, int, Path | None, float, list]] = [(d, 0, None, float(values[d]), []) for d in range(texts)]
    for sample in range(1, k + 1):
        todo = []
        for d, free, path, value, taken in prefix:
            if path is None:
                todo.append((d, 0, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0), value))
                continue
            i = int(bounds[d]) + free
            edges, log_p = _other_path(lattice, int(node[i]), int(end[i]), taken, int(keys[d]), sample, free)
            head = path.edges[: path.begin[free]]
            todo.append((d, free + 1, np.concatenate([head, edges]), np.append(path.begin[: free + 1], len(head) + len(edges)), np.append(path.log_p[:free], log_p), value))
            # what is left of the entry: the same string's other paths
            gone = [*taken, tuple(edges)]
            phi = float(path.log_p[:free].sum()) + _left(lattice, int(node[i]), int(end[i]), gone)
            v = _truncated(phi, value, _one(int(keys[d]), sample, free, 1 << 42))
            if v > -np.inf:
                heapq.heappush(queue[d], (-v, sample - 1, free, gone))
        if not todo:
            break
        chosen = np.array([t[0] for t in todo])
        free_at = np.zeros(texts, dtype=np.int64)
        free_at[chosen] = [t[1] for t in todo]
        wanted = np.zeros(texts, dtype=bool)
        wanted[chosen] = True
        tail = np.flatnonzero(wanted[owner] & (place >= free_at[owner]))
        edges, begin, log_p, only = walk(lattice, node[tail], end[tail], keys[owner[tail]], np.full(len(tail), sample), place[tail])
        left = np.searchsorted(tail, bounds[chosen])
        right = np.searchsorted(tail, bounds[chosen + 1])
        noise = _uniform(keys[owner[tail]], np.full(len(tail), sample), place[tail], np.uint64(1 << 43))
        rest = log_rest(log_p, only)
        # the maxima of the parts: one for each free string of each text
        base = np.array([t[4].sum() for t in todo])
        row = np.repeat(np.arange(len(todo)), right - left)
        run = np.cumsum(log_p) - log_p
        before = run - run[np.minimum(left, max(len(run) - 1, 0))][row] + base[row] if len(run) else run
        v = truncated(before + rest, np.array([t[5] for t in todo])[row], noise)
        some = np.flatnonzero(right > left)
        for _ in range(k + 1 - sample if len(some) else 0):  # so many more can be taken from this path, the threshold among them
            most = np.maximum.reduceat(v, left[some])
            at = np.flatnonzero(v == np.repeat(most, (right - left)[some]))
            at = at[np.unique(row[at], return_index=True)[1]]
            for j, value in zip(at.tolist(), v[at].tolist(), strict=True):
                if value > -np.inf:
                    d, free = todo[row[j]][:2]
                    heapq.heappush(queue[d], (-value, sample - 1, free + j - int(left[row[j]]), [tuple(edges[begin[j] : begin[j + 1]].tolist())]))
            v[at] = -np.inf
        prefix = []
        for (d, free, head, head_begin, head_p, value), a, b in zip(todo, left.tolist(), right.tolist(), strict=True):
            path = Path(np.concatenate([head, edges[begin[a] : begin[b]]]), np.concatenate([head_begin[:-1], begin[a : b + 1] - begin[a] + len(head)]), np.concatenate([head_p, log_p[a:b]]))
            done[d].append((path, float(path.log_p.sum()), value))
            if sample < k and queue[d]:
                v, parent, w, taken = heapq.heappop(queue[d])
                prefix.append((d, w, done[d][parent][0], -v, taken))
    out = []
    for d in range(texts):
        threshold = -queue[d][0][0] if queue[d] else -np.inf
        out.append([Sample(p, lp, v, _log_inclusion(lp, threshold)) for p, lp, v in done[d]])
    return out


def _left(lattice: Lattice, node: int, end: int, taken: list[tuple[int, ...]]) -> float:
    """log of the share of a string's paths that aren't taken."""
    share = sum(math.exp(_suffix(lattice, x)[0] - float(lattice.total[node])) for x in taken)
    if share > 1 - 1e-9 and _n_paths(lattice, node, end, len(taken) + 1) == len(taken):
        return -np.inf
    return math.log(max(1 - share, 1e-300))


def _log_inclusion(log_p: float, threshold: float) -> float:
    x = log_p - threshold
    if x > 4:
        return float(np.log1p(-np.exp(-np.exp(min(x, 700)))))
    return float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)


def sampled(store: LatticeStore, texts: pa.Array, keys: np.ndarray, k: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[Sample], np.ndarray, np.ndarray, list[str]]]:
    """(rows, numbers, samples, ids, where each sample's ids begin, texts of the rows as they should decode) of a chunk's samples, in order."""
    model = store.model
    for first, data, offsets in tk.chunks(texts, size=CHUNK_BYTES, change=model.normalised):
        starts = model.strings(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        where, back = tk.distinct(data, starts, ends)
        raw = data.tobytes()
        node = store.places(raw, starts[where], ends[where])[back]
        lattice = store.lattice
        bounds = np.searchsorted(starts, offsets)
        row_keys = tk.mix(keys[first : first + len(offsets) - 1].astype(np.uint64) ^ tk.seed_of(seed, 2))
        results = top_k(lattice, node, node + (ends - starts), bounds, row_keys, k)
        found = [s for samples in results for s in samples]
        size = [len(samples) for samples in results]
        rows = np.repeat(np.arange(len(results)), size)
        ids, begin = model.ids(lattice, store.data, np.concatenate([np.zeros(0, np.int64), *(s.path.edges for s in found)]))
        cut = begin[np.cumsum([0, *(len(s.path.edges) for s in found)])]
        whole = [raw[a:b].decode().removeprefix(" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield rows + first, np.arange(len(rows)) - np.searchsorted(rows, rows) + 1, found, ids, cut, [whole[d] for d in rows]


_STORES: dict[tuple[bytes, float, int], LatticeStore] = {}


def _store(proto: bytes, theta: float, most: int = STORE_BYTES) -> LatticeStore:
    """This worker's model and lattices, kept from task to task; one at a time."""
    key = (hashlib.sha256(proto).digest(), theta, most)
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = LatticeStore(PieceModel(proto, theta), most)
        release()  # building the trie takes more than keeping it
    return _STORES[key]


def sample_segmentations(docs: DataFrame, model_file: str, k: int = 2, theta: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, sparing: bool = False) -> DataFrame:
    """k distinct sampled segmentations of every whole text: ids, log probability, perturbed value and inclusion score.

    With ``digests``, ids are given as their number and SHA-256 (32-bit little-endian), with a round trip through
    ``decode`` in ``decoded_equal``. ``sparing`` takes less memory and more time, with the same rows: for workers beside
    a heap that earlier steps have filled, which is collected first.
    """
    with open(model_file, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    if sparing:
        collected(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sparing:
            release_early()
        store = _store(sent.value, theta, SPARING_BYTES if sparing else STORE_BYTES)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for rows, numbers, samples, ids, cut, whole in sampled(store, batch.column(1), keys, k, seed):
                if digests:
                    wide = memoryview(ids.astype("<i4").tobytes())
                    hashes = [hashlib.sha256(wide[4 * a : 4 * b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    equal = [a == b for a, b in zip(store.model.decode_all(ids, cut), whole, strict=True)]
                    own = [("n_pieces", pa.array(np.diff(cut))), ("ids_sha256", pa.array(hashes, pa.string())), ("decoded_equal", pa.array(equal, pa.bool_()))]
                else:
                    own = [("ids", pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))))]
                floats = [(name, pa.array([getattr(s, name) for s in samples], pa.float64())) for name in ("log_prob", "perturbed", "log_inclusion")]
                columns = [("doc_id", batch.column(0).take(pa.array(rows))), ("sample", pa.array(numbers.astype(np.int32))), *own, *floats]
                yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    schema = SCHEMA if not digests else SCHEMA.replace("ids array<int>", "n_pieces bigint, ids_sha256 string, decoded_equal boolean")
    return narrowed(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tidy(run), schema)


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text as the library segments it, without sampling; a null is the empty text."""
    with open(model_file, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                ids = library.encode(part.column(1).fill_null("").to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return narrowed(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, ids array<int>")


def decoded(samples: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, sample, text) of sampled ids."""
    with open(model_file, "rb") as file:
        sent = samples.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(sent.value)
        for batch in batches:
            lists = batch.column(2).fill_null([])
            texts = model.decode_all(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return samples.select("doc_id", "sample", "ids").mapInArrow(tidy(run), "doc_id bigint, sample int, text string")


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, as digests, with their round trip."""
    import public_tokenizers

    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
