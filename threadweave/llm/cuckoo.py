"""A cuckoo filter over many keys at a time: set membership in two bytes a key, with deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4  # of a bucket
LOAD = 0.85  # a table is made so large that no more of its slots are taken
ROUNDS = 500  # of moving fingerprints on before a key goes to the stash
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 is an empty slot. Keys are 64-bit hashes.

    A key's fingerprint lies in one of two buckets, each of which follows from the other and the
    fingerprint. What finds no slot goes to a stash of (bucket, fingerprint), searched as well, so an
    inserted key is always found; another one is found by mistake about once in 8,000. One fingerprint is
    kept per ``insert``, so a key that was inserted once can be deleted once without harm to others.
    """

    def __init__(self, buckets: int):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < n:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        buckets = int(np.frombuffer(raw[:8], "<i8")[0])
        out = cls(buckets)
        split = 8 + buckets * SLOTS * 2
        out.table = np.frombuffer(raw[8:split], "<u2").reshape(buckets, SLOTS).copy()
        out.stash = [(int(b), int(f)) for b, f in np.frombuffer(raw[split:], "<i8").reshape(-1, 2)]
        return out

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, "<i8").reshape(-1, 2)
        return np.int64(len(self.table)).tobytes() + self.table.astype("<u2").tobytes() + stash.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def has_room(self, more: int) -> bool:
        return len(self) + more <= self.table.size * LOAD

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return (keys & np.uint64(len(self.table) - 1)).astype(np.int64), prints

    def _other(self, buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
        moved = (prints.astype(np.uint64) * _MIX) >> np.uint64(32)
        return (buckets.astype(np.uint64) ^ moved & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        bucket, prints = self._places(keys)
        other = self._other(bucket, prints)
        found = (self.table[bucket] == prints[:, None]).any(axis=1) | (self.table[other] == prints[:, None]).any(axis=1)
        for b, f in self.stash:
            found |= (prints == f) & ((bucket == b) | (other == b))
        return found

    def insert(self, keys: np.ndarray) -> None:
        """Keep one fingerprint of every key; all keys of a round move at the same time."""
        bucket, prints = self._places(keys)
        tried = np.zeros(len(keys), bool)  # the first of its two buckets
        turn = np.random.default_rng(len(keys))
        for _ in range(ROUNDS):
            if not len(prints):
                return
            # As many as a bucket has empty slots go in.
            order = np.argsort(bucket, kind="stable")
            bucket, prints, tried = bucket[order], prints[order], tried[order]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            place = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.append(starts, len(bucket))))
            empty = np.argsort(self.table[bucket] != 0, axis=1, kind="stable")  # empty slots first
            fits = place < (self.table[bucket] == 0).sum(axis=1)
            self.table[bucket[fits], empty[fits, place[fits]]] = prints[fits]
            bucket, prints, tried = bucket[~fits], prints[~fits], tried[~fits]
            # Of those that have tried both, one per bucket changes places with a fingerprint there, which moves on.
            _, first = np.unique(np.where(tried, bucket, -1), return_index=True)
            first = first[tried[first]]
            slot = turn.integers(0, SLOTS, len(first))
            prints[first], self.table[bucket[first], slot] = self.table[bucket[first], slot], prints[first]
            moving = ~tried
            moving[first] = True
            bucket[moving] = self._other(bucket[moving], prints[moving])
            tried[:] = True
        self.stash.extend(zip(bucket.tolist(), prints.tolist()))

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint of every key; each must have been inserted."""
        bucket, prints = self._places(keys)
        for b, o, f in zip(bucket.tolist(), self._other(bucket, prints).tolist(), prints.tolist()):
            for place in (b, o):
                slots = np.flatnonzero(self.table[place] == f)
                if len(slots):
                    self.table[place, slots[0]] = 0
                    break
            else:
                self.stash.remove((b, f) if (b, f) in self.stash else (o, f))
