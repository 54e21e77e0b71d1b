"""A map from byte strings to runs of ids that grows, and is asked for many strings at a time.

Strings of up to 15 bytes are two 64-bit numbers (their bytes, zeros and their length), found by open addressing in arrays; longer
ones, which are rare, by a dictionary. An entry takes 60 to 120 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .bytesplit import gather, parts

_SHORT = 15
_MASK = np.frombuffer(b"".join(b"\xff" * n + b"\0" * (16 - n) for n in range(_SHORT + 1)), "<u8").reshape(-1, 2)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _room(a: np.ndarray, n: int, more: int) -> np.ndarray:
    """a, of which n items are in use, or a longer copy with room for more."""
    if n + more <= len(a):
        return a
    out = np.empty((max(2 * len(a), n + more), *a.shape[1:]), a.dtype)
    out[:n] = a[:n]
    return out


class Known:
    """most: entries, and bytes of long strings and ids forty times that, beyond which the map is emptied at the next question."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.n = self.n_ids = self.long_bytes = 0
        self.long: dict[bytes, int] = {}
        self.keys, self.first, self.size, self.ids = np.empty((1 << 12, 2), np.uint64), np.empty(1 << 12, np.int32), np.empty(1 << 12, np.int32), np.empty(1 << 14, np.uint32)
        self.slots = np.full(1 << 13, -1, np.int32)

    def ask(self, items: pa.Array, make) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all items in a row, how many each has). items: distinct strings; make: strings -> the same of those that are new."""
        if self.n > self.most or 4 * self.n_ids + self.long_bytes > 40 * self.most:
            self.clear()
        data, offsets, sizes = parts(items)
        entry = np.full(len(items), -1, np.int64)
        short, long = np.flatnonzero(sizes <= _SHORT), np.flatnonzero(sizes > _SHORT)
        data = np.append(data, np.zeros(16, np.uint8))
        keys = data[offsets[short, None] + np.arange(16)].view("<u8") & _MASK[sizes[short]]
        keys[:, 1] |= sizes[short].astype(np.uint64) << np.uint64(56)
        entry[short] = self._find(keys)
        words = items.take(pa.array(long)).to_pylist()
        entry[long] = [self.long.get(w, -1) for w in words]
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = self._add(*make(items.take(pa.array(new))))
            unseen = entry[short] >= self.n - len(new)
            self._place(keys[unseen], entry[short][unseen])
            for k, w in zip(entry[long].tolist(), words):
                if k >= self.n - len(new):
                    self.long[w] = k
                    self.long_bytes += len(w)
        return gather(self.ids, self.size, entry, self.first)[0], self.size[entry]

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, at = len(sizes), self.n_ids
        self.ids, self.first, self.size, self.keys = _room(self.ids, at, len(ids)), _room(self.first, self.n, n), _room(self.size, self.n, n), _room(self.keys, self.n, n)
        self.ids[at : at + len(ids)] = ids
        self.first[self.n : self.n + n] = at + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + n] = sizes
        self.keys[self.n : self.n + n] = np.iinfo(np.uint64).max  # no short string's, for the entries of long ones
        self.n, self.n_ids = self.n + n, at + len(ids)
        return np.arange(self.n - n, self.n)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] * _ODD[0]) ^ (keys[:, 1] * _ODD[1])
        h = (h ^ (h >> np.uint64(32))) * _ODD[2]
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out, left, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._hash(keys)
        while len(left):
            entry = self.slots[slot]
            there = np.flatnonzero(entry >= 0)
            left, slot, entry = left[there], slot[there], entry[there]
            same = (self.keys[entry] == keys[left]).all(axis=1)
            out[left[same]] = entry[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _place(self, keys: np.ndarray, entry: np.ndarray) -> None:
        """Enter distinct keys that are not there."""
        self.keys[entry] = keys
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n - 1).bit_length(), -1, np.int32)
            entry = np.flatnonzero(self.keys[: self.n, 1] != np.iinfo(np.uint64).max)
            keys = self.keys[entry]
        slot = self._hash(keys)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]  # of several that meet, one stays
            out = self.slots[slot] != entry
            keys, entry, slot = keys[out], entry[out], (slot[out] + 1) & (len(self.slots) - 1)
