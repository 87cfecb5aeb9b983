"""Edit distance of word sequences by banded alignment, many pairs at a time.

The band is doubled until it holds the distance or the largest distance asked
for (Ukkonen's scheme), so results are exact; pairs of like band and length
share numpy operations.
"""

from __future__ import annotations

import numpy as np

from kinmatch.llm.textkernel import mix

_CELLS = 1 << 16
_FAR = np.int32(1 << 28)


def _bag_distance(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A lower bound of each pair's edit distance: words that the other side lacks, counted with repeats."""
    if not pairs:
        return np.zeros(0, np.int64)
    n = np.array([len(x) for p in pairs for x in p])
    of = np.repeat(np.repeat(np.arange(len(pairs)), 2), n)
    sign = np.repeat(np.tile([1, -1], len(pairs)), n)
    if not len(of):
        return np.zeros(len(pairs), np.int64)
    keys = np.concatenate([x for p in pairs for x in p]) ^ mix((of + 1).astype(np.uint64))
    order = np.argsort(keys)
    begin = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[0]]))
    more = np.add.reduceat(sign[order], begin)
    owner = of[order[begin]]
    plus = np.bincount(owner, weights=np.maximum(more, 0), minlength=len(pairs))
    minus = np.bincount(owner, weights=np.maximum(-more, 0), minlength=len(pairs))
    return np.maximum(plus, minus).astype(np.int64)


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common beginning and end, which an optimal alignment may match as they are."""
    m = min(len(a), len(b))
    same = a[:m] == b[:m]
    lead = m if same.all() else int(same.argmin())
    a, b = a[lead:], b[lead:]
    m -= lead
    if m:
        same = a[len(a) - m :][::-1] == b[len(b) - m :][::-1]
        tail = m if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    return a, b


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Distances of pairs inside the band of k diagonals on either side; anything above k means: more than k."""
    n, m = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    rows, width = int(n.max()), 2 * k + 1
    left = np.zeros((len(pairs), rows), dtype=np.uint64)
    right = np.zeros((len(pairs), rows + width), dtype=np.uint64)  # b from place k on; 0 is no word's hash here
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        part = b[: rows + width - k]
        right[i, k : k + len(part)] = part
    at = np.arange(width, dtype=np.int32)
    row = np.where(at >= k, at - k, _FAR).astype(np.int32) * np.ones((len(pairs), 1), np.int32)
    out = np.full(len(pairs), _FAR, dtype=np.int64)
    end = m - n + k
    live = np.arange(len(pairs))
    done = live[n[live] == 0]
    out[done] = row[done, end[done]]
    for i in range(1, rows + 1):
        new = row + (right[:, i - 1 : i - 1 + width] != left[:, i - 1 : i])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        new -= at
        np.minimum.accumulate(new, axis=1, out=new)
        new += at
        row = new
        at_end = np.flatnonzero(n[live] == i)
        if len(at_end):
            out[live[at_end]] = row[at_end, end[live[at_end]]]
        if i % 64 == 0:
            keep = (n[live] > i) & (row.min(axis=1) <= k)
            if not keep.all():
                live, row, left, right = live[keep], row[keep], left[keep], right[keep]
                if not len(live):
                    break
    return out


def within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Each pair's edit distance if it is at most ``most``, else -1. Words are non-zero 64-bit hashes."""
    out = np.full(len(pairs), -1, dtype=np.int64)
    gap = np.array([abs(len(a) - len(b)) for a, b in pairs], dtype=np.int64)
    left = [i for i in np.flatnonzero(gap <= most)]
    trimmed = {i: _trim(*pairs[i]) for i in left}
    bound = dict(zip(left, _bag_distance([trimmed[i] for i in left]), strict=True))
    todo: dict[int, list[int]] = {}
    for i in left:
        a, b = trimmed[i]
        if not len(a) or not len(b):
            out[i] = max(len(a), len(b)) if max(len(a), len(b)) <= most[i] else -1
        elif bound[i] <= most[i]:
            k = 1 << int(max(4, bound[i] + 2, gap[i] + 1) - 1).bit_length()
            todo.setdefault(k, []).append(i)
    while todo:
        k = min(todo)
        some = sorted(todo.pop(k), key=lambda i: len(trimmed[i][0]))
        step = max(1, _CELLS // (2 * k + 1))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            for i, d in zip(part, _band([trimmed[i] for i in part], k), strict=True):
                if d <= k:
                    out[i] = d if d <= most[i] else -1
                elif k < most[i]:
                    todo.setdefault(2 * k, []).append(i)
    return out
