"""A cuckoo filter over 64-bit hashes: membership without false negatives, with deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_KICKS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Buckets of SLOTS 16-bit tags. An entry's two buckets differ by the tag's own hash, so tags can move alone.

    Entries that find no room within the kicks go to a stash, which lookups read too: nothing is ever refused. All
    operations work on whole arrays.
    """

    def __init__(self, capacity: int) -> None:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.85 + 1))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.stash = np.zeros(0, np.int64)

    @property
    def slots(self) -> int:
        return self.table.size

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64) * _MIX
        tags = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return tags, first, self._other(first, tags)

    def _other(self, bucket: np.ndarray, tags: np.ndarray) -> np.ndarray:
        return bucket ^ ((tags.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def _code(self, bucket: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """One number for an entry, whichever of its buckets is given."""
        return (np.minimum(bucket, self._other(bucket, tags)) << 16) | tags.astype(np.int64)

    def _put(self, tags: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Fills free slots, one entry a bucket and pass; the mask of entries that found none."""
        left = np.ones(len(tags), bool)
        while left.any():
            todo = np.flatnonzero(left)
            _, one = np.unique(buckets[todo], return_index=True)
            at = todo[one]
            free = self.table[buckets[at]] == 0
            has = free.any(axis=1)
            if not has.any():
                break
            at, slot = at[has], free[has].argmax(axis=1)
            self.table[buckets[at], slot] = tags[at]
            left[at] = False
            full = (self.table[buckets] != 0).all(axis=1)
            if (full | ~left).all():
                break
        return left

    def insert(self, hashes: np.ndarray) -> None:
        tags, first, second = self._places(hashes)
        left = self._put(tags, first)
        tags, bucket = tags[left], second[left]
        left = self._put(tags, bucket)
        tags, bucket = tags[left], bucket[left]
        rng = np.random.default_rng(len(tags))
        for _ in range(_KICKS):
            if not len(tags):
                return
            _, one = np.unique(bucket, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            out = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = tags[one]
            tags[one] = out
            bucket[one] = self._other(bucket[one], out)
            left = self._put(tags, bucket)
            tags, bucket = tags[left], bucket[left]
        self.stash = np.concatenate([self.stash, self._code(bucket, tags)])

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        tags, first, second = self._places(hashes)
        found = (self.table[first] == tags[:, None]).any(axis=1) | (self.table[second] == tags[:, None]).any(axis=1)
        return found | np.isin(self._code(first, tags), self.stash) if len(self.stash) else found

    def _take(self, tags: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Empties a slot with its tag for each entry; the mask of entries whose bucket had none left."""
        left, todo = np.ones(len(tags), bool), np.arange(len(tags))
        while len(todo):
            _, one = np.unique(buckets[todo], return_index=True)
            at = todo[one]
            hit = self.table[buckets[at]] == tags[at, None]
            got = hit.any(axis=1)
            self.table[buckets[at[got]], hit[got].argmax(axis=1)] = 0
            left[at[got]] = False
            todo = np.delete(todo, one)
        return left

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out one entry for each hash; each must have been inserted."""
        tags, first, second = self._places(hashes)
        left = self._take(tags, first)
        tags, bucket = tags[left], second[left]
        left = self._take(tags, bucket)
        gone, n_gone = np.unique(self._code(bucket[left], tags[left]), return_counts=True)
        held, n_held = np.unique(self.stash, return_counts=True)
        at = np.isin(held, gone)
        n_held[at] -= n_gone[np.isin(gone, held)]
        self.stash = np.repeat(held, np.maximum(n_held, 0))

    def to_bytes(self) -> bytes:
        return np.array([len(self.table), len(self.stash)], np.int64).tobytes() + self.table.tobytes() + self.stash.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, stash = np.frombuffer(data[:16], np.int64)
        out = cls.__new__(cls)
        end = 16 + 2 * SLOTS * int(buckets)
        out.table = np.frombuffer(data[16:end], np.uint16).reshape(int(buckets), SLOTS).copy()
        out.stash = np.frombuffer(data[end : end + 8 * int(stash)], np.int64).copy()
        return out
