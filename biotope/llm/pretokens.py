"""Pre-token splitting for the two byte-level vocabularies, and what the tokenizers library makes of each pre-token.

A text is split by the vocabulary's own pattern and every distinct pre-token is encoded once by the library. The pattern engine
here and the library's follow different Unicode versions, so a text with a character outside SETTLED, or with one of the
vocabulary's special strings, goes to the library whole; results are the library's in either case.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from .bytesplit import gather, parts, spaced_letters

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The vocabularies' patterns.
PATTERNS = {
    "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: Characters whose class, case and composition are the same in the library and here (all were compared).
UNSETTLED = re.compile("[^\x00-΢Τ-ԯ‐-‧€、-ヿ一-龥가-힣！-～]")
#: The same patterns for the standard library's faster engine, and the characters with which they may differ.
LATIN = {
    "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d]+|\d|[^\s\w]+",
}
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\u024f]|[_\x85\xa0²³¹¼½¾]")
#: Plain words that go to the library as one text.
RUN = 512


class Pretokens:
    """split(text) gives pre-tokens, or None for a text that the library must take whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        name = path.rsplit("/", 1)[-1]
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(PATTERNS[name]) if name in PATTERNS else None
        self.latin = re.compile(LATIN[name]) if name in LATIN else None
        self.folds = name == "word_bpe_49k.json"
        ids = range(self.tokenizer.get_vocab_size())
        self.edge = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in ids], bool) if name == "byte_bpe_50k.json" else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def split(self, text: str) -> list[str] | None:
        if self.pattern is None or any(s in text for s in self.special):
            return None
        if not NOT_LATIN.search(text):
            return self.latin.findall(text.lower() if self.folds else text)
        if UNSETTLED.search(text):
            return None
        return self.pattern.findall(unicodedata.normalize("NFC", text).lower() if self.folds else text)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens (binary) in a row, and how many each has.

        Plain words, a space and letters, go to the library many at a time, as one text in which they are its pre-tokens; a mark in
        the vocabulary tells where each begins (the leading space). Others go one by one.
        """
        plain = np.flatnonzero(spaced_letters(words)) if self.edge is not None else np.zeros(0, np.int64)
        data, offsets, sizes = parts(words.take(pa.array(plain)))
        cuts = [*offsets[::RUN].tolist(), int(sizes.sum())]
        order, flat, many = [], [], []
        for k, ids in enumerate(self.encode([data[a:z].tobytes().decode() for a, z in zip(cuts, cuts[1:])])):
            run, ids = plain[RUN * k : RUN * (k + 1)], np.array(ids, np.uint32)
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(run):  # else some word is not one pre-token
                order.append(run)
                flat.append(ids)
                many.append(np.diff(at, append=len(ids)))
        rest = np.ones(len(words), bool)
        for run in order:
            rest[run] = False
        order.append(np.flatnonzero(rest))
        made = self.encode(words.take(pa.array(order[-1])).cast(pa.string()).to_pylist())
        flat.append(np.array([i for ids in made for i in ids], np.uint32))
        many.append(np.array([len(ids) for ids in made], np.int64))
        sizes, back = np.concatenate(many), np.argsort(np.concatenate(order))
        return gather(np.concatenate(flat), sizes, back)[0], sizes[back]

    def encode(self, items: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]


_loaded: dict[str, Pretokens] = {}


def pretokens(path: str) -> Pretokens:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Pretokens(path)
    return _loaded[path]
