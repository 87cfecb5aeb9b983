"""A cuckoo filter over 64-bit keys with batched insertion, lookup and deletion in numpy."""

from __future__ import annotations

import numpy as np

from kinmatch.llm.textkernel import mix

SLOTS = 4
_MAX_ROUNDS = 500
_LOAD = 0.85


class FilterFull(Exception):
    """The filter holds too many keys; build a larger one."""


def buckets_for(n: int) -> int:
    """A power of two of buckets that holds n keys at the planned load."""
    need = max(1, int(np.ceil(n / (_LOAD * SLOTS))))
    return 1 << (need - 1).bit_length()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 marks a free slot. No false negatives."""

    def __init__(self, n_buckets: int, table: bytes | None = None) -> None:
        if n_buckets < 1 or n_buckets & (n_buckets - 1):
            raise ValueError("n_buckets must be a power of two")
        self.mask = np.uint64(n_buckets - 1)
        self.table = np.frombuffer(table, dtype=np.uint16).reshape(n_buckets, SLOTS).copy() if table is not None else np.zeros((n_buckets, SLOTS), dtype=np.uint16)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @property
    def n_buckets(self) -> int:
        return len(self.table)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        fp = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        at = h & self.mask
        return fp, at.astype(np.int64), self._other(at, fp)

    def _other(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return ((at.astype(np.uint64) ^ mix(fp.astype(np.uint64))) & self.mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """False: surely not inserted."""
        fp, one, two = self._places(keys)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)

    def _place(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; True for those placed."""
        done = np.zeros(len(fp), dtype=bool)
        while True:
            left = np.flatnonzero(~done)
            if not len(left):
                return done
            free = self.table[at[left]] == 0
            left, slot = left[free.any(axis=1)], free.argmax(axis=1)[free.any(axis=1)]
            if not len(left):
                return done
            _, once = np.unique(at[left], return_index=True)  # one for each bucket at a time
            left, slot = left[once], slot[once]
            self.table[at[left], slot] = fp[left]
            done[left] = True

    def insert(self, keys: np.ndarray) -> None:
        """Insert each key once. Raises FilterFull if the evictions don't end; the filter is then void."""
        fp, at, two = self._places(keys)
        done = self._place(fp, at)
        done[~done] = self._place(fp[~done], two[~done])
        fp, at = fp[~done], two[~done]
        random = np.random.default_rng(len(keys))
        for _ in range(_MAX_ROUNDS):
            if not len(fp):
                return
            _, once = np.unique(at, return_index=True)
            slot = random.integers(0, SLOTS, len(once))
            out = self.table[at[once], slot].copy()
            self.table[at[once], slot] = fp[once]
            fp[once] = out
            at[once] = self._other(at[once], out)
            done = self._place(fp, at)
            fp, at = fp[~done], at[~done]
        raise FilterFull(f"{len(self)} of {self.table.size} slots are taken")

    def delete(self, keys: np.ndarray) -> None:
        """Delete one copy of each key's fingerprint; keys must have been inserted."""
        fp, one, two = self._places(keys)
        left = np.arange(len(keys))
        for at in (one, two):
            while len(left):
                hit = self.table[at[left]] == fp[left][:, None]
                some = hit.any(axis=1)
                if not some.any():
                    break
                rows, slot = left[some], hit.argmax(axis=1)[some]
                _, once = np.unique(at[rows], return_index=True)
                self.table[at[rows[once]], slot[once]] = 0
                left = np.setdiff1d(left, rows[once])


def built(keys: np.ndarray) -> CuckooFilter:
    """A filter of the given keys, as large as it takes."""
    n = buckets_for(len(keys))
    while True:
        out = CuckooFilter(n)
        try:
            out.insert(keys)
            return out
        except FilterFull:
            n *= 2
