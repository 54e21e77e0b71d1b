"""Benchmark decontamination with suffix arrays of the training text.

A shard is a run of whole documents of one task, of at most SHARD_WORDS words (a longer document is a shard by itself). Its words
become 64-bit hashes, 0 for a word that no benchmark text has; a suffix ends at the first 0 or at its document's end, which
loses nothing, as no benchmark text goes on over such a word. The suffix array, in the order of the hashes, is built once a shard (prefix
doubling over the suffixes that can match at all) and binary-searched for every suffix of every benchmark item, all of them at a
time: that gives the longest verbatim match of each and, for each window of WINDOW words, the range of its occurrences. Each
occurrence is then held against its neighbours in the benchmark's own order of suffixes, which gives the document's longest match
there. A document lies within one shard, so its hits are complete there and no text is shuffled.

The benchmark reaches the tasks in blocks of at most BLOCK_ROWS items and BLOCK_BYTES bytes, prepared on the driver, one broadcast each; the
driver and a task hold one at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table, texts, tidy
from .words import ALNUM, split_words

WINDOW = 10
SHARD_WORDS = 1 << 19
#: Bounds of a broadcast block of the benchmark.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 4 << 20


class Block:
    """Items of the benchmark: their words' hashes one after the other, with a 0 after every item."""

    def __init__(self, ids: list[str], items: list[str], window: int):
        words, counts = split_words(items, ALNUM)
        coded = words.dictionary_encode()
        self.vocabulary, self.ids, self.window = coded.dictionary, np.array(ids, object), window
        self.hashes = np.array([xxhash.xxh64_intdigest(w) or 1 for w in coded.dictionary.to_pylist()], np.uint64)
        n = len(words) + len(counts)
        item = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(words)) + item
        self.seq = np.zeros(n + 1, np.uint64)
        self.seq[place] = self.hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else 0
        self.item = np.zeros(n, np.int64)
        self.item[place] = item
        self.begin = np.cumsum(counts + 1) - counts - 1
        dense = dense_of(self.seq[:n])
        self.sa, self.left = suffix_array(dense)  # left: words from here to the item's end
        self.suffixes = np.sort(self.sa)
        wide = np.minimum(self.left, window)
        at = place[(self.left[place] >= window) | (place == self.begin[item])]  # where a window begins
        grid = np.where(np.arange(window) < wide[at][:, None], dense[np.minimum(at[:, None] + np.arange(window), n - 1)], 0) if n else np.zeros((0, window))
        _, one, win = np.unique(grid, axis=0, return_index=True, return_inverse=True) if len(at) else (None, np.zeros(0, int), np.zeros(0, int))
        self.at, self.wide = at[one], wide[at[one]]  # a window that many items share is searched once
        pairs = np.unique(np.stack([win.ravel(), self.item[at]], 1), axis=0) if len(at) else np.zeros((0, 2), int)
        self.win_from = np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
        self.win_items = pairs[:, 1]


def dense_of(hashes: np.ndarray) -> np.ndarray:
    """Small numbers in the order of the hashes; 0 for 0."""
    known = np.unique(hashes[hashes > 0])
    return np.where(hashes > 0, np.searchsorted(known, hashes) + 1, 0).astype(np.int32)


def suffix_array(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers with 0 as the end of every run: the starts of all suffixes in order, and each place's words up to the next 0.

    Prefix doubling: suffixes are sorted by their first words, packed in one integer; then those that still tie are sorted by the
    rank of what follows, over twice the words each time.
    """
    n = len(seq)
    zero = np.flatnonzero(seq == 0)
    nxt = np.append(zero, n)[np.searchsorted(zero, np.arange(n))]
    run = nxt - np.arange(n)
    at = np.flatnonzero(run > 0)
    if not len(at):
        return at, run
    bits = max(1, int(seq.max()).bit_length())
    h = max(1, 63 // bits)
    key = np.zeros(len(at), np.int64)
    for j in range(h):
        key = (key << bits) | np.where(run[at] > j, seq[np.minimum(at + j, n - 1)], 0)
    order = np.argsort(key, kind="stable")
    sa, key = at[order], key[order]
    rank = np.zeros(n + 1, np.int64)
    new = np.append(True, key[1:] != key[:-1])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[sa] = group + 1
    slots = np.arange(len(sa))
    while True:
        size_over_one = np.append(group[1:] == group[:-1], False) | np.append(False, group[1:] == group[:-1])
        go = size_over_one & (run[sa[slots]] >= h)
        slots, group = slots[go], group[go]
        if not len(slots):
            return sa, run
        sub = sa[slots]
        key = (group << 32) | rank[np.minimum(sub + h, n)]
        order = np.argsort(key, kind="stable")
        sub, key = sub[order], key[order]
        sa[slots] = sub
        new = np.append(True, key[1:] != key[:-1])
        group = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[sub] = group + 1
        h *= 2


def search(seq, run, sa, words: np.ndarray, at: np.ndarray, wide: np.ndarray, after: bool) -> np.ndarray:
    """For each suffix of words at at[k], cut to wide[k] words: the first place of sa whose suffix is not below it (after: is above it,
    where one that it is a prefix of counts as equal)."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        t, b, w = sa[mid], at[live], wide[live]
        sign = np.zeros(len(live), np.int8)  # of training suffix against benchmark suffix
        open_, d = np.arange(len(live)), 0
        while len(open_):
            done = d >= w[open_]  # all its words are equal
            open_ = open_[~done]
            x = np.where(d < run[t[open_]], seq[np.minimum(t[open_] + d, len(seq) - 1)], 0)
            y = words[b[open_] + d]
            sign[open_] = (x > y).astype(np.int8) - (x < y)
            open_ = open_[x == y]
            d += 1
        right = sign <= 0 if after else sign < 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
        live = live[lo[live] < hi[live]]
    return lo


def common(seq, run, words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that each suffix of seq at a[k] has in common with the suffix of words at b[k] (0 where either place is negative)."""
    out = np.zeros(len(a), np.int64)
    live, d = np.flatnonzero((a >= 0) & (b >= 0)), 0
    while len(live):
        live = live[(d < left[b[live]]) & (d < run[a[live]])]
        live = live[seq[a[live] + d] == words[b[live] + d]]
        d += 1
        out[live] = d
    return out


def _placed(order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """order[at], and -1 outside it."""
    return np.where((at >= 0) & (at < len(order)), order[np.clip(at, 0, max(0, len(order) - 1))], -1) if len(order) else np.full(len(at), -1)


class Shard:
    """Whole documents; hits and matches of one block after the other. Its suffix array is built once, over the words that any block has."""

    def __init__(self, doc_ids: list, words: pa.Array, counts: np.ndarray):
        self.doc_ids, self.counts = doc_ids, counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.hit = np.zeros(len(self.doc), np.int32)
        self.items: list[set] = [set() for _ in counts]
        self.begin = np.cumsum(counts) - counts
        self.best: list = [(0, 0, None)] * len(counts)  # (words, -position, item) of the longest match
        coded = words.dictionary_encode()
        self.distinct, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.hash = np.zeros(len(self.distinct) + 1, np.uint64)
        self.sa = None

    def know(self, block: Block) -> None:
        """Take the block's words into account; for every block, before the first match()."""
        found = pc.fill_null(pc.index_in(self.distinct, value_set=block.vocabulary), -1).to_numpy(zero_copy_only=False)
        self.hash[:-1] = np.where(found >= 0, block.hashes[found] if len(block.hashes) else 0, self.hash[:-1])

    def _array(self) -> None:
        place = np.arange(len(self.codes)) + self.doc  # a 0 after every document, so that no suffix goes on into the next one
        self.seq = np.zeros(len(self.codes) + len(self.counts), np.uint64)
        self.seq[place] = self.hash[self.codes]
        self.sa, self.run = suffix_array(dense_of(self.seq))
        self.back = np.zeros(len(self.seq), np.int64)
        self.back[place] = np.arange(len(self.codes))
        self.codes = self.distinct = None

    def match(self, block: Block, longest: bool = False) -> list[tuple]:
        """Mark the block's windows in the documents. longest: return (item, offset, length, doc_id, position) of the longest match
        of every benchmark suffix with at least the window's words (ties: smallest doc_id, null last, then position)."""
        if self.sa is None:
            self._array()
        if not len(self.sa) or not len(block.sa):
            return []
        seq, run, sa, back = self.seq, self.run, self.sa, self.back
        every = block.suffixes
        low = search(seq, run, sa, block.seq, every, block.left[every], False)
        length = np.maximum(*(common(seq, run, block.seq, block.left, _placed(sa, low - k), every) for k in (1, 0)))
        of = np.zeros(len(block.seq), np.int64)
        of[every] = length
        found = np.flatnonzero(of[block.at] >= block.wide)
        start, last = (search(seq, run, sa, block.seq, block.at[found], block.wide[found], after) for after in (False, True))
        wide = np.zeros(len(seq), np.int64)
        for k, a, b in zip(found, start, last):
            here = back[sa[a:b]]
            wide[sa[a:b]] = np.maximum(wide[sa[a:b]], block.wide[k])
            self.hit[here] = np.maximum(self.hit[here], block.wide[k])
            names = block.ids[block.win_items[block.win_from[k] : block.win_from[k + 1]]]
            names = names[names != None].tolist()  # noqa: E711
            for d in np.unique(self.doc[here]).tolist():
                self.items[d].update(names)
        if len(found):
            self._longest(block, np.flatnonzero(wide), wide[wide > 0])
        out = []
        if longest:
            far = every[(length >= np.minimum(block.window, block.left[every])) & ((block.left[every] >= block.window) | (every == block.begin[block.item[every]]))]
            start, last = (search(seq, run, sa, block.seq, far, of[far], after) for after in (False, True))
            for k, a, b in zip(far, start, last):
                at = back[sa[a:b]]
                ids = [(self.doc_ids[d] is None, self.doc_ids[d] or 0, p - self.begin[d]) for d, p in zip(self.doc[at].tolist(), at.tolist())]
                null, doc_id, position = min(ids)
                i = block.item[k]
                out.append((block.ids[i], int(k - block.begin[i]), int(of[k]), None if null else doc_id, int(position)))
        return out

    def _longest(self, block: Block, at: np.ndarray, wide: np.ndarray) -> None:
        """Where windows begin (places in seq; the widest window's words): the longest match there with a suffix of the block that such a
        window begins. One of a place's two neighbours in the block's order of suffixes has the longest of all; below the window's
        words it is a whole short item. Of each document the longest is kept (ties: the first place, then the smallest item id)."""
        low = search(block.seq, block.left, block.sa, self.seq, at, self.run[at], False)
        most = np.maximum(*(common(self.seq, self.run, block.seq, block.left, at, _placed(block.sa, low - k)) for k in (1, 0)))
        most = np.where(most >= block.window, most, wide)
        where = self.back[at]
        doc = self.doc[where]
        order = np.lexsort((where, -most, doc))
        first = order[np.append(True, doc[order][1:] != doc[order][:-1])]
        better = [k for k in first.tolist() if (int(most[k]), -int(where[k] - self.begin[doc[k]])) >= self.best[doc[k]][:2]]
        a, b = (search(block.seq, block.left, block.sa, self.seq, at[better], most[better], after) for after in (False, True))
        for k, x, y in zip(better, a, b):
            n, position, some = int(most[k]), -int(where[k] - self.begin[doc[k]]), block.sa[x:y]
            if n < block.window:
                some = some[(block.left[some] == n) & (some == block.begin[block.item[some]])]
            names = [i for i in block.ids[np.unique(block.item[some])].tolist() if i is not None]
            if (n, position) == self.best[doc[k]][:2] and self.best[doc[k]][2] is not None:
                names.append(self.best[doc[k]][2])
            self.best[doc[k]] = (n, position, min(names, default=None))

    def rows(self) -> dict:
        n = len(self.hit)
        covered = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(self.hit)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + self.hit[at], -1)
        inside = np.cumsum(covered[:n]) > 0
        n_hit = np.bincount(self.doc[inside], minlength=len(self.counts))
        items = [sorted(s) for s in self.items]
        return {
            "doc_id": self.doc_ids,
            "n_words": self.counts.astype(np.int64),
            "n_hit": n_hit.astype(np.int64),
            "n_items": [len(i) for i in items],
            "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
            "contaminated": n_hit > 0,
            "longest": [n for n, _, _ in self.best],
            "longest_at": [-p if n else None for n, p, _ in self.best],
            "longest_item": [i for _, _, i in self.best],
            "items": items,
        }


ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()), ("items", pa.list_(pa.string()))]
)
ROWS_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long, longest_item string, items array<string>"
MATCHES = pa.schema([("item_id", pa.string()), ("offset", pa.int64()), ("n_words", pa.int64()), ("doc_id", pa.int64()), ("position", pa.int64())])


def blocks(benchmark: DataFrame, window: int, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES, unnamed: bool = False) -> list:
    """Broadcast blocks, each of a bounded number of items and bytes (or of a single item); unnamed: also items with a null id."""
    sc, out, held, n = benchmark.sparkSession.sparkContext, [], [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null" if unnamed else "item_id is not null and text is not null")

    def send():
        out.append(sc.broadcast(Block(*zip(*held), window)))
        if len(out) > 1:  # the driver keeps its written form only
            for b in out:
                vars(b).pop("_value", None)

    for r in items.toLocalIterator():
        if held and (len(held) == rows or n + len(r[1]) > size):
            send()
            held, n = [], 0
        held.append((r[0], r[1]))
        n += len(r[1])
    if held:
        send()
    return out


def matched(shard: Shard, parts: list, longest: bool = False):
    """The shard against all blocks; of several, a worker lets go of each before it takes the next one."""

    def each():
        for p in parts:
            yield p.value
            if len(parts) > 1 and vars(p).get("_path"):  # it can be read again
                vars(p).pop("_value", None)

    for block in each():
        shard.know(block)
    for block in each():
        yield from shard.match(block, longest)


def shards(batches, doc_id: int, text: int, words: int):
    """(slices of record batches, shard) of whole documents, of about `words` words at most unless one document has more."""
    held, n = [], 0

    def made():
        rows = pa.Table.from_batches(held).combine_chunks()
        one = rows.column(text).combine_chunks()
        return rows, Shard(rows.column(doc_id).to_pylist(), *split_words(one.chunk(0) if isinstance(one, pa.ChunkedArray) else one, ALNUM))

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, size in enumerate(sizes.tolist()):
            if n and n + size > 6 * words:
                if i > start:
                    held.append(b.slice(start, i - start))
                yield made()
                held, n, start = [], 0, i
            n += size + 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield made()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, unnamed: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit (words within a window's occurrence), n_items, items_sha256 (of the item ids as sorted strings, joined by
    commas), contaminated (n_hit > 0), longest, longest_at, longest_item (words, place in the document's words and item of the longest verbatim
    match that holds a window; ties: the first place, then the smallest item; 0 and nulls if there is none), items.

    A window: `window` consecutive words of an item; an item of fewer words is one window, of no words none. docs: doc_id, text. A row
    for every row, equal ones too; null and empty texts have no words; a null doc_id stays null; very long texts are a shard each. benchmark:
    item_id, text; rows with a null are left out, equal ids count once; with unnamed, a text with a null item_id counts in n_hit,
    contaminated and longest, and only its id is missing. Other columns are not read. Empty tables give no rows, or rows without hits.
    """
    ship(docs.sparkSession)
    parts = blocks(benchmark, window, block_rows, unnamed=unnamed)

    def run(batches):
        for _, shard in shards(batches, 0, 1, shard_words):
            for _ in matched(shard, parts):
                pass
            yield table(shard.rows(), ROWS)
        tidy()

    return texts(docs).mapInArrow(run, ROWS_DDL)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """item_id, offset (of the suffix, in words), n_words, doc_id, position: the longest verbatim match of every benchmark suffix that has
    one of at least `window` words (or of the whole of a shorter item), over all shards; ties: smallest doc_id, then position."""
    ship(docs.sparkSession)
    parts = blocks(benchmark, window, block_rows)

    def run(batches):
        for _, shard in shards(batches, 0, 1, shard_words):
            if found := list(matched(shard, parts, longest=True)):
                yield table(dict(zip(MATCHES.names, zip(*found))), MATCHES)
        tidy()

    every = texts(docs).mapInArrow(run, "item_id string, offset long, n_words long, doc_id long, position long")
    best = F.max_by(F.struct("n_words", "doc_id", "position"), F.struct("n_words", F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("position")))
    return every.groupBy("item_id", "offset").agg(best.alias("b")).select("item_id", "offset", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, unnamed: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs without the contaminated rows (unnamed: as in hits); all columns stay, whatever their names, as do null and empty texts and
    equal rows; very long texts are searched whole. An empty benchmark removes nothing."""
    ship(docs.sparkSession)
    parts = blocks(benchmark, window, block_rows, unnamed=unnamed)
    doc_id, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        for rows, shard in shards(batches, doc_id, text, shard_words):
            for _ in matched(shard, parts):
                pass
            yield from rows.filter(pa.array(~np.array(shard.rows()["contaminated"], bool))).to_batches(max_chunksize=256)
        tidy()

    return docs.mapInArrow(run, docs.schema)
