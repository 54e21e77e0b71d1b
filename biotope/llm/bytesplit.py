"""Pre-tokens of many texts at a time, by their UTF-8 bytes, for the byte-level vocabulary's pattern.

The pattern cuts a text into contractions, runs of letters, of numbers and of other characters, each with one space before it
if there is one, and white space: of a run of white space, all but its last character are one pre-token; the last goes with what
follows if it is a space and is one by itself if not; at the end of a text the whole run is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

#: Code points below this have bytes below 0xC8 and the same classes in the library and here (all were compared).
LIMIT = 0x200
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.array([_SPACE if regex.match(r"\s", chr(c)) else _LETTER if regex.match(r"\p{L}", chr(c)) else _NUMBER if regex.match(r"\p{N}", chr(c)) else _OTHER for c in range(LIMIT)], np.uint8)
_FIRST = np.zeros(256, np.uint8)
_FIRST[:128] = _CLASS[:128]
_ONE = np.isin(np.arange(256), list(b"stmd"))


def bounds(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens begin. data: bytes of the texts one after another, all below 0xC8; texts: where each non-empty text begins."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _FIRST[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _CLASS[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
    begins = np.zeros(n + 3, bool)
    begins[texts] = True
    start = begins.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start[:n])
    after = run[1:][(kind[run[1:]] != _SPACE) & (kind[run[:-1]] == _SPACE) & ~begins[run[1:]]]  # what follows white space
    last = after - 1 - ((data[after - 1] & 0xC0) == 0x80)
    start[last] = True
    start[after[data[last] == 0x20]] = False
    quote = np.flatnonzero(data == 0x27)
    if len(quote):
        ext = np.append(data, np.zeros(3, np.uint8))
        quote = quote[start[quote] & ~begins[quote + 1]]
        one = _ONE[ext[quote + 1]]
        pair = ext[quote + 1].astype(np.int64) << 8 | ext[quote + 2]
        two = ((pair == 0x7265) | (pair == 0x7665) | (pair == 0x6C6C)) & ~begins[quote + 2]  # re, ve, ll
        for at, k in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            start[at + k] = True
    return np.flatnonzero(start[:n])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(a code for each pre-token, the distinct pre-tokens)."""
    offsets = np.append(at, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def parts(items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each item begins in them, sizes) of a binary array."""
    offsets = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1].astype(np.int64)
    held = items.buffers()[2]
    return np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def spaced_letters(items: pa.Array) -> np.ndarray:
    """Which pre-tokens begin with a space and a letter below LIMIT: those are letters throughout."""
    data, at, sizes = parts(items)
    data = np.append(data, np.zeros(3, np.uint8))
    one, two = data[at + 1], data[at + 2]
    wide = (one >= 0xC2) & (one < 0xC8)
    kind = _CLASS[np.where(wide, (one & 0x1F).astype(np.int64) << 6 | (two & 0x3F), np.where(one < 0x80, one, 0))]
    return (sizes > 1) & (data[at] == 0x20) & (kind == _LETTER)


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the items of every code in a row, where each code's end). flat: the items of code 0, 1, ..., or those of each from first on;
    sizes: how many each has."""
    if first is None:
        first = np.cumsum(sizes) - sizes
    count = sizes[codes]
    end = np.cumsum(count)
    return flat[np.repeat(first[codes] - (end - count), count) + np.arange(end[-1] if len(end) else 0)], end
