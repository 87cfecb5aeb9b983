"""Vectorised word kernels over Arrow string batches.

All functions work on whole texts as UTF-8 bytes. A batch is cut into chunks of
whole documents of about ``CHUNK_BYTES`` so that the working arrays stay in
cache and memory stays bounded by the chunk (or by one document, if a single
document is larger).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 output function)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def seed_of(*parts: int) -> np.uint64:
    """One 64-bit seed out of small integers."""
    out = np.array([0x243F6A8885A308D3], dtype=_U64)
    for p in parts:
        out = mix(out + _U64(p * _BASE % (1 << 64)))
    return out[0]


def _table(members: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


#: Bytes outside a word where words are what stands between white space.
WHITE = _table(_SPACE)
#: Bytes outside a word where words are runs of ASCII letters, digits and any other script's bytes.
PUNCTUATED = ~_table(tuple(b for b in range(256) if b >= 128 or chr(b).isalnum()))


@dataclass
class Words:
    """Words of a chunk of documents; ``bounds[d]:bounds[d + 1]`` are document d's words."""

    data: np.ndarray  # bytes of the chunk
    offsets: np.ndarray  # document d is data[offsets[d]:offsets[d + 1]]
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    n = len(texts)
    _, off_buf, data_buf = texts.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64, count=n + 1, offset=texts.offset * 8)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf and data_buf.size else np.zeros(0, np.uint8)
    return data, off


def chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK_BYTES, change: Callable[[pa.Array], pa.Array] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole rows, lower-cased or changed otherwise; a null is an empty text."""
    change = pc.utf8_lower if lower else change
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    data, off = _buffers(texts)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, side="right")) - 1)
        if change:
            part, at = _buffers(change(texts.slice(first, last - first)))
            yield first, part[at[0] : at[-1]], at - at[0]
        else:
            yield first, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


#: Keeps the first 0..8 bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=_U64)


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data on (zeros behind its end) as one number."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))


def _unrolled(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of that many bytes as blocks of eight: (span, number of the block in it, bytes that count)."""
    n = (size + 7) >> 3
    span = np.repeat(np.arange(len(size)), n)
    number = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
    return span, number, np.minimum(size[span] - 8 * number, 8)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[starts:ends], by blocks that are mixed with their place before they are summed.

    Different lanes give independent hashes. Equal hashes are no proof of equal spans: ``distinct`` compares the bytes.
    """
    if not len(starts):
        return np.zeros(0, dtype=_U64)
    blocks, size, seed = _blocks(data), ends - starts, np.array([seed_of(lane, 31)])
    out = mix((blocks[starts] & _FIRST[np.minimum(size, 8)]) + mix(seed))
    out[size == 0] = 0
    long = np.flatnonzero(size > 8)
    if len(long):
        span, number, width = _unrolled(size[long] - 8)
        terms = mix((blocks[starts[long][span] + 8 * number + 8] & _FIRST[width]) + mix(seed + number.astype(_U64) + _U64(1)))
        out[long] += np.add.reduceat(terms, np.flatnonzero(number == 0))
    return mix(out + size.astype(_U64) * _U64(_BASE))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact groups of equal spans: (a span of each group, each span's group). Hashes only propose; bytes decide."""
    _, where, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, where[back]
    same = bool((size == size[like]).all())
    if same and len(starts):
        blocks = _blocks(data)
        other = np.flatnonzero(like != np.arange(len(starts)))
        first = _FIRST[np.minimum(size[other], 8)]
        same = bool(((blocks[starts[other]] ^ blocks[starts[like[other]]]) & first == 0).all())
        other = other[size[other] > 8]
        if same and len(other):
            span, number, width = _unrolled(size[other] - 8)
            step = 8 * number + 8
            same = bool(((blocks[starts[other][span] + step] ^ blocks[starts[like[other]][span] + step]) & _FIRST[width] == 0).all())
    if not same:  # two spans share a hash: tell them apart by their bytes
        raw = data.tobytes()
        known: dict[bytes, int] = {}
        back = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
        where = np.unique(back, return_index=True)[1]
    return where, back


def split_words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WHITE, hashed: bool = True) -> Words:
    """Words of each document, with a hash of each if ``hashed``."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, none, none, none.astype(_U64), np.zeros(len(offsets), np.int64))
    inside = ~outside[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, span_hashes(data, starts, ends) if hashed else starts[:0].astype(_U64), np.searchsorted(starts, offsets))


_MULT = mix(np.arange(1, 65, dtype=_U64) * _U64(0xD6E8FEB86659FD93)) | _U64(1)


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of n words that lies inside one document."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    out = hashes[: total - n + 1] * _MULT[0]
    for j in range(1, n):
        out += hashes[j : total - n + 1 + j] * _MULT[j % 64]
    left = np.repeat(bounds[1:], np.diff(bounds))[: total - n + 1] - np.arange(total - n + 1)
    first = np.flatnonzero(left >= n)
    return first, mix(out[first] + _U64(n))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the keys found more than once: (their places, the group of each place, the size of each group)."""
    order = np.argsort(keys, kind="stable")
    run = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(run)))
    many = times > 1
    return order[np.repeat(many, times)], np.repeat(np.arange(many.sum()), times[many]), times[many]


def repeats(ids: np.ndarray, bounds: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1, 2, ..., longest: (n, first words, their groups, sizes of the groups) of all n-grams found twice or more in their text.

    ``ids`` are exact word ids, and an n-gram's group is the pair of the groups of its two (n - 1)-grams, so no hash can mix
    n-grams up. Only n-grams both of whose parts are repeated can be repeated themselves, so the work shrinks with n.
    """
    total = len(ids)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at, group, times = _grouped(doc * (int(ids.max(initial=0)) + 1) + ids)
    for n in range(1, longest + 1):
        yield n, at, group, times
        own = np.full(total + 1, -1, dtype=np.int64)
        own[at] = group
        following = own[at + 1]
        go = (following >= 0) & (doc[at] == doc[np.minimum(at + 1, total - 1)]) if total else np.zeros(0, bool)
        at = at[go]
        found, group, times = _grouped(group[go] * (len(times) + 1) + following[go])
        at = at[found]


def occurrence(groups: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of (group, hash) in order of position, 1 for the second, ..."""
    out = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes) < 2:
        return out
    keys = hashes ^ mix((groups + 1).astype(_U64))
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    at = np.arange(len(keys))
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def later(groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True where (group, id) has occurred before, exactly."""
    out = np.ones(len(ids), dtype=bool)
    if len(ids):
        out[np.unique(groups * (int(ids.max()) + 1) + ids, return_index=True)[1]] = False
    return out


def covered(n: int, first: np.ndarray, width: int) -> np.ndarray:
    """True for the positions of 0..n-1 inside some run [first, first + width)."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def sum_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over each document's run of positions."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
