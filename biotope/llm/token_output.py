"""Token-ID output: documents as ids in ascending doc_id order, in files of Simple-8b words.

File layout (all little-endian): magic; then blocks; then the footer; then its length (8 bytes) and the magic again.
A block holds up to BLOCK_IDS ids, regardless of document ends, as packed 64-bit words followed by its escapes (64-bit ids).
A word is a selector in the top 4 bits and a payload of 60 bits: selector s < 14 holds COUNTS[s] ids of 60 // COUNTS[s] bits,
lowest first; selector 14 holds 120 zeros; selector 15 is an escape, whose payload is a place among the block's escapes.
The footer holds the blocks' (offset, words, escapes, ids) and the documents' (doc_id, whether it is null, ids), so that any
block or document can be read by itself and a block is decoded with one vector operation a selector.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesplit
from .common import cut, shared_dir, ship, sliced, table, texts
from .known import Known
from .pretokens import pretokens

MAGIC = b"S8BIDS01"
BLOCK_IDS = 1 << 16
#: Ids in a word, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120, 1], dtype=np.int64)
ZEROS, ESCAPE = 14, 15
_WIDTHS = 60 // COUNTS[:14]
_LOW60 = np.uint64((1 << 60) - 1)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 ids -> (words, escapes). Greedy: each word takes as many ids as fit."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u8")
    width = _bit_length(ids)
    pick = np.full(n, 13, np.uint8)
    pick[width > 60] = ESCAPE
    reach, span = width.copy(), 1  # largest width among ids[i : i + span]
    powers = {1: reach}
    while span * 2 <= 120 and span * 2 <= n:
        nxt = powers[span].copy()
        nxt[: n - span] = np.maximum(nxt[: n - span], powers[span][span:])
        span *= 2
        powers[span] = nxt
    for s in range(12, -1, -1):  # where c ids of a width fit, so do fewer of a larger one: each that fits lowers the selector by one
        c, bits = int(COUNTS[s]), int(_WIDTHS[s])  # plain numbers: the comparisons stay in bytes
        if c > n or np.count_nonzero(width <= bits) < c:
            break  # nor do more ids fit
        p = 1 << (c.bit_length() - 1)
        top = np.maximum(powers[p][: n - c + 1], powers[p][c - p : n - p + 1])
        pick[: n - c + 1] -= (top <= bits).view(np.uint8)
    if n >= 120:
        top = np.maximum(powers[64][: n - 119], powers[64][56 : n - 63])
        pick[: n - 119][top == 0] = ZEROS
    hops = [np.append(np.arange(n) + COUNTS[pick], n)]  # where the next word begins, the next but one, but three, ...; n stays n
    while len(hops) < 5:
        hops.append(hops[-1][hops[-1]])
    far = memoryview(hops[-1])
    at, every = 0, []
    while at < n:
        every.append(at)
        at = far[at]
    start = np.array(every)
    for hop in hops[-2::-1]:
        start = np.stack([start, hop[start]], 1).ravel()
    start = start[start < n]
    sel = pick[start]
    words = sel.astype(np.uint64) << np.uint64(60)
    escapes = ids[start[sel == ESCAPE]]
    words[sel == ESCAPE] |= np.arange(len(escapes), dtype=np.uint64)
    for s in np.unique(sel):
        if s < 14:
            mine, c = np.flatnonzero(sel == s), int(COUNTS[s])
            parts = ids[np.arange(c)[:, None] + start[mine]] << (np.arange(c, dtype=np.uint64) * np.uint64(_WIDTHS[s]))[:, None]
            words[mine] |= np.bitwise_or.reduce(parts, axis=0)
    return words.astype("<u8"), escapes.astype("<u8")


_SHORT = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bit_length(ids: np.ndarray) -> np.ndarray:
    if ids.max() < 1 << 16:
        return _SHORT[ids]
    out, rest = np.zeros(len(ids), np.uint8), ids.copy()
    for shift in (32, 16):
        big = rest >= (np.uint64(1) << np.uint64(shift))
        out[big] += shift
        rest[big] >>= np.uint64(shift)
    return out + _SHORT[rest]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """(words, escapes) -> uint64 ids."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s < 14:
            c, bits = int(COUNTS[s]), int(_WIDTHS[s])
            mask = np.uint64((1 << bits) - 1)
            out[at[mine][:, None] + np.arange(c)] = (words[mine][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(bits))) & mask
        elif s == ESCAPE:
            out[at[mine]] = escapes[(words[mine] & _LOW60).astype(np.int64)]
    return out


class Writer:
    """Writes one file; keeps one block and the footer in memory."""

    def __init__(self, stream):
        self.stream, self.held, self.n_held, self.at = stream, [], 0, len(MAGIC)
        self.blocks, self.docs = [], []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            rest = np.concatenate(self.held)
            full = len(rest) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, full, BLOCK_IDS):
                self._block(rest[k : k + BLOCK_IDS])
            self.held, self.n_held = [rest[full:]], len(rest) - full

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = pack(ids.astype(np.uint64))
        self.blocks.append((self.at, len(words), len(escapes), len(ids)))
        self.stream.write(words.tobytes())
        self.stream.write(escapes.tobytes())
        self.at += 8 * (len(words) + len(escapes))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        foot = np.array([len(self.blocks), len(self.docs)], "<i8").tobytes() + np.array(self.blocks, "<i8").tobytes() + np.array(self.docs, "<i8").tobytes()
        self.stream.write(foot + np.array([len(foot)], "<i8").tobytes() + MAGIC)


class Reader:
    """Reads one file by its footer; holds one block and the ids of one document."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids, or one that is cut short")
        n = int(np.frombuffer(tail[:8], "<i8")[0])
        source.seek(size - 16 - n)
        foot = np.frombuffer(source.read(n), "<i8")
        n_blocks, n_docs = int(foot[0]), int(foot[1])
        self.blocks = foot[2 : 2 + 4 * n_blocks].reshape(-1, 4)
        self.docs = foot[2 + 4 * n_blocks :].reshape(n_docs, 3)

    def block(self, k: int) -> np.ndarray:
        at, n_words, n_escapes, n_ids = (int(x) for x in self.blocks[k])
        self.source.seek(at)
        raw = np.frombuffer(self.source.read(8 * (n_words + n_escapes)), "<u8")
        return unpack(raw[:n_words], raw[n_words:])[:n_ids]

    def documents(self):
        """(doc_id, ids) in file order."""
        k, have = 0, np.zeros(0, np.uint64)
        for doc_id, null, n in self.docs.tolist():
            parts, got = [have], len(have)
            while got < n:
                parts.append(self.block(k))
                got, k = got + len(parts[-1]), k + 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield (None if null else doc_id), have[:n]
            have = have[n:]


#: Pre-tokens kept by a worker (some 60 to 120 bytes each); a full map is emptied, which costs time only.
CACHE = 1_500_000
#: Pre-tokens of texts that are not split by their bytes are looked up when so many are held.
HELD_WORDS = 1 << 16
_known: dict[str, Known] = {}


def encoder(tokenizer: str):
    """An Arrow array of texts -> the ids of each (uint32 arrays).

    Texts of characters below bytesplit.LIMIT without special strings are split together by their bytes, and their distinct pre-tokens
    looked up among those that the library has encoded; others are split one by one, or go to the library whole.
    """
    pre = pretokens(tokenizer)
    fast = tokenizer.rsplit("/", 1)[-1] == "byte_bpe_50k.json"
    known = _known.setdefault(tokenizer, Known(CACHE))
    special = [t.encode() for t in pre.special]

    def look_up(codes: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return bytesplit.gather(*known.ask(distinct, pre.encode_words), codes)

    def by_text(held: list[tuple[int, list[str]]], out: list) -> None:
        coded = pa.array([w for _, words in held for w in words], pa.string()).dictionary_encode()
        ids, end = look_up(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()))
        last = end[np.cumsum([len(words) for _, words in held]) - 1].tolist()
        for (k, _), a, b in zip(held, [0, *last], last):
            out[k] = ids[a:b]

    def encode(items: pa.Array) -> list[np.ndarray]:
        items = items.cast(pa.binary())
        offsets = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1].astype(np.int64)
        data = np.frombuffer(items.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        slow = np.full(len(items), not fast)
        slow[np.searchsorted(offsets, np.flatnonzero(data >= 0xC8), "right") - 1] = True
        raw = data.tobytes()
        if any(s in raw for s in special):
            slow |= [any(s in raw[a:b] for s in special) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        quick = ~slow & (sizes > 0)
        out: list = [np.zeros(0, np.uint32)] * len(items)
        held, n_held = [], 0
        for k in np.flatnonzero(slow & (sizes > 0)).tolist():
            text = raw[offsets[k] : offsets[k + 1]].decode()
            if (split := pre.split(text)) is None:
                out[k] = np.array(pre.encode([text])[0], np.uint32)
            elif split:
                held.append((k, split))
                n_held += len(split)
            if n_held >= HELD_WORDS:
                by_text(held, out)
                held, n_held = [], 0
        if held:
            by_text(held, out)
        if quick.any():
            if slow.any():
                data = data[np.repeat(quick, sizes)]
            own = sizes[quick]
            begin = np.cumsum(own) - own
            at = bytesplit.bounds(data, begin)
            ids, end = look_up(*bytesplit.words(data, at))
            last = end[np.append(np.searchsorted(at, begin[1:]), len(at)) - 1]
            for k, a, b in zip(np.flatnonzero(quick).tolist(), [0, *last[:-1].tolist()], last.tolist()):
                out[k] = ids[a:b]
        return out

    return encode


MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Write the ids of every document, each followed by end_id, to files below folder; return the manifest, one row a file,
    with the number of ids before the file (start).

    docs: doc_id, text. Null and empty texts give the end id alone; a null doc_id comes first; equal doc_ids are ordered by
    text; equal rows are all written. An empty table gives no file and an empty manifest. Other columns are not read.
    Documents are dealt by ranges of doc_id, as text, and encoded where their file is written. A file is written under a
    name of its task attempt and renamed, so a repeated or second attempt leaves the same file.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/ids"
    rows = texts(docs)
    parts = parts or max(1, rows.rdd.getNumPartitions())

    def write(batches):
        from pyarrow import fs

        batches = sliced(batches, 1024)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part = task.partitionId()
        final, temporary = f"part-{part:06d}.s8b", f"{base}/.attempt-{part:06d}-{task.taskAttemptId()}"
        encode, n_docs, n_ids = encoder(tokenizer), 0, 0
        end = np.array([end_id], np.uint32)
        with store.open_output_stream(temporary) as stream:
            out = Writer(stream)
            while first is not None:
                for doc_id, ids in zip(first.column(0).to_pylist(), encode(first.column(1))):
                    ids = np.append(ids, end)
                    out.add(doc_id, ids)
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids)
                first = next(batches, None)
            out.close()
        store.move(temporary, f"{base}/{final}")
        yield table({"part": [part], "path": [f"{folder}/{final}"], "n_docs": [n_docs], "n_ids": [n_ids]}, MANIFEST)

    made = cut(rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_files(manifest: DataFrame, each, ddl: str) -> DataFrame:
    """Apply each(reader, start) -> record batches to every file of a manifest, a file a task."""

    def read(batches):
        from pyarrow import fs

        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    yield from each(Reader(source), start)

    manifest = cut(manifest, "starts")
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, ddl)


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as little-endian uint32)."""

    def digest(reader: Reader, start: int):
        rows = []
        for doc_id, ids in reader.documents():
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            start += len(ids)
            if len(rows) == 4096:
                yield table(dict(zip(READ.names, zip(*rows))), READ)
                rows = []
        if rows:
            yield table(dict(zip(READ.names, zip(*rows))), READ)

    return read_files(manifest, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, ids array<long>."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def whole(reader: Reader, start: int):
        for doc_id, ids in reader.documents():
            yield table({"doc_id": [doc_id], "start": [start], "ids": [ids.astype(np.int64)]}, schema)
            start += len(ids)

    return read_files(manifest, whole, "doc_id long, start long, ids array<long>")
