"""Words of many texts at a time, by their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words, with A-Z as a-z; all others are spaces. Of words of letters and digits, and of words between white space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def split_words(items, fold: bytes) -> tuple[pa.Array, np.ndarray]:
    """(all words, the number of words of each item). A word is a run of bytes that fold doesn't make a space; null is empty."""
    arr = items.cast(pa.binary()) if isinstance(items, pa.Array) else pa.array(items, pa.binary())
    arr = pc.fill_null(arr, b"")
    if len(arr) == 0:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(fold) if raw else b"", np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    rel = (offsets - offsets[0]).astype(np.int64)
    if len(rel) > 2 and len(edge):  # a word ends where its item ends
        cuts = np.unique(rel[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        glued = cuts[(data[cuts - 1] != 32) & (data[cuts] != 32)]
        edge = np.sort(np.concatenate([edge, glued, glued]))
    starts, ends = edge[0::2], edge[1::2]
    counts = np.searchsorted(starts, rel[1:]) - np.searchsorted(starts, rel[:-1])
    keep = np.zeros(len(data) + 1, bool)
    keep[:-1] = data != 32
    packed = data[data != 32]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]), counts
