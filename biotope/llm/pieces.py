"""SentencePiece encoding for merge-type (BPE) vocabularies, and decoding.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score (ties: leftmost) and merges the best pair until none
is in the vocabulary; characters that are no piece become byte pieces. No piece of the vocabulary has the space mark after
another character (checked at loading), so no merge crosses from a word into the next space, and a text can be encoded word by
word. The distinct words of an Arrow batch are encoded side by side, each by its own agenda (a row of a table of symbols), and checked
against the sentencepiece library; the texts' ids are then gathered by word.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import gather
from .common import chunks, ship, table, texts, tidy

MARK = "▁"
#: Words kept by a worker, about, of at most so many bytes (some 200 bytes each in all). When its newer half is full, the older half is
#: forgotten, which costs time only.
CACHE, CACHED_BYTES = 200_000, 64
_NEVER = np.iinfo(np.int32).max
#: Words of more characters have a heap as their agenda; shorter ones are encoded side by side, so many rows at a time.
SHORT, ROWS = 48, 1 << 14
#: Words that the library gets as one text.
CHECKED = 256


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.id = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: lib.get_score(i) for i in plain}
        self.byte = {int(pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece goes on over a space; texts can't be encoded word by word")
        if lib.encode("a  ａ") != lib.encode("a") + self.agenda(f"{MARK}{MARK}ａ"):
            raise ValueError("the model's normaliser changes texts")
        self.decimal = [str(i) for i in range(n)]
        self.known: dict[bytes, bytes] = {}
        self.known_before: dict[bytes, bytes] = {}
        self._tabulate(n)

    def _tabulate(self, n: int) -> None:
        """Symbols as numbers: pieces by id, then ASCII characters and those within pieces that are no piece; n_symbols: any other
        character. For every pair that makes a piece its key and the piece's place in the order of scores; for every symbol the id
        that it is written as (negative where it takes several or is unknown here)."""
        number = dict(self.id)
        for c in sorted(({c for p in self.id for c in p} | set(map(chr, range(128)))) - number.keys()):
            number[c] = n + len(number) - len(self.id)
        self.n_symbols = n + len(number) - len(self.id)
        self.of_char = np.full(0x110000, self.n_symbols, np.int32)
        self.written = np.full(self.n_symbols + 1, -1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
            if i < n or s.isascii():
                self.written[i] = i if i < n else self.byte[ord(s)]
        place = {score: k for k, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = sorted((number[p[:k]] * (self.n_symbols + 1) + number[p[k:]], place[self.score[p]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        bits = max(8, (4 * len(pairs)).bit_length())  # a hash table, open addressing
        self.shift = np.uint64(64 - bits)
        self.pair_key = np.full((1 << bits) + len(pairs) + 1, -1, np.int64)
        self.pair_place, self.pair_made = (np.full(len(self.pair_key), x, np.int32) for x in (_NEVER, 0))
        for at, (key, q, made) in zip(self._slot(np.array([k for k, _, _ in pairs], np.int64)).tolist(), pairs):
            while self.pair_key[at] >= 0:
                at += 1
            self.pair_key[at], self.pair_place[at], self.pair_made[at] = key, q, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the table has these pairs, or an empty place."""
        key = (a.astype(np.int64) * (self.n_symbols + 1) + b).ravel()
        at = self._slot(key)
        there = self.pair_key[at]
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            at[rest] += 1
            there = self.pair_key[at[rest]]
            rest = rest[(there != key[rest]) & (there >= 0)]
        return at.reshape(a.shape)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place in the order of scores of what each two symbols make; _NEVER where they make no piece."""
        return self.pair_place[self._at(a, b)]

    def side_by_side(self, words: list[str]) -> list[bytes | None]:
        """Ids (int32, as bytes) of words of up to SHORT characters; None for those with a character that is written as several
        ids. Each row is a word: in every round its best-scored pair, the leftmost of equals, is merged, and the pairs beside it are
        scored anew."""
        out: list = [None] * len(words)
        if not words:
            return out
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(order), ROWS):
            rows = order[k : k + ROWS]
            n, width = sizes[rows], int(sizes[rows[-1]])
            code = self.of_char[np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le"), np.uint32)]
            inside = np.arange(width + 1) < n[:, None]
            symbol = np.full((len(rows), width + 1), self.n_symbols, np.int32)  # the last one pairs with none
            symbol[inside] = code
            place = np.append(self._pairs(symbol[:, :-1], symbol[:, 1:]), np.full((len(rows), 1), _NEVER, np.int32), 1)
            after, before = (np.tile(x.astype(np.int8), (len(rows), 1)) for x in (np.append(np.arange(width) + 1, width), np.append(width, np.arange(width))))
            each = np.arange(len(rows))
            while len(each):
                best = place[each].argmin(1)
                go = place[each, best] < _NEVER
                each, best = each[go], best[go]
                right = after[each, best]
                made = self.pair_made[self._at(symbol[each, best], symbol[each, right])]
                symbol[each, best], symbol[each, right], place[each, right] = made, -1, _NEVER
                then, left = after[each, right], before[each, best]
                after[each, best], before[each, then] = then, best
                place[each, best] = self._pairs(made, symbol[each, then])
                place[each, left] = self._pairs(symbol[each, left], made)
            self._finish(rows, symbol, inside & (symbol >= 0), out)
        return out

    def _finish(self, rows: np.ndarray, symbol: np.ndarray, stays: np.ndarray, out: list) -> None:
        n = stays.sum(1)
        flat = self.written[symbol[stays]]
        end = np.cumsum(n)
        bad = np.add.reduceat(flat < 0, end - n) > 0
        raw = flat.tobytes()
        for i, a, z, b in zip(rows.tolist(), ((end - n) * 4).tolist(), (end * 4).tolist(), bad.tolist()):
            if not b:
                out[i] = raw[a:z]

    def agenda(self, word: str) -> list[int]:
        """Ids of one word, whatever its length and characters: the agenda is a heap of pairs."""
        out = []
        for s in self._merged(list(word)):
            i = self.id.get(s)
            out.extend([i] if i is not None else [self.byte[x] for x in s.encode()])
        return out

    def _merged(self, symbols: list[str | None]) -> list[str]:
        score = self.score
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None:
                heap.append((-s, i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, a, b, made = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or right[a] != b or symbols[a] + symbols[b] != made:
                continue  # one side has been merged since
            symbols[a], symbols[b] = made, None
            after = right[a] = right[b]
            if after < n:
                left[after] = a
                if (s := score.get(made + symbols[after])) is not None:
                    heapq.heappush(heap, (-s, a, after, made + symbols[after]))
            if (before := left[a]) >= 0 and (s := score.get(symbols[before] + made)) is not None:
                heapq.heappush(heap, (-s, before, a, symbols[before] + made))
        return [s for s in symbols if s is not None]

    def check(self, words: list[str], made: list[bytes]) -> None:
        """Hold the agenda's ids against the library's. It gets words in runs, as texts in which they are the words; words of marks only
        would join the next word, and go alone."""
        runs: list[list[int]] = [[]]
        for k, w in enumerate(words):
            if not w.strip(MARK):
                if w != MARK:  # the library adds the first mark itself
                    runs.append([k])
            else:
                if len(runs[0]) == CHECKED:
                    runs.append(runs[0])
                    runs[0] = []
                runs[0].append(k)
        theirs = self.library.encode(["".join([words[k] for k in run])[1:].replace(MARK, " ") for run in runs], num_threads=1)
        for run, t in zip(runs, theirs):
            if b"".join([made[k] for k in run]) != np.array(t, np.int32).tobytes():
                raise ValueError(f"the agenda and the library differ on a word of {[words[k] for k in run][:8]}")

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of words, by the agenda and checked."""
        made: list = [None] * len(new)
        short = [k for k, w in enumerate(new) if len(w) <= SHORT]
        for k, m in zip(short, self.side_by_side([new[k] for k in short])):
            made[k] = m
        made = [np.array(self.agenda(w), np.int32).tobytes() if m is None else m for w, m in zip(new, made)]
        self.check(new, made)
        return made

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Of distinct words in UTF-8, with spaces as marks."""
        if len(self.known) > CACHE // 2:
            self.known, self.known_before = {}, self.known
        known, before = self.known, self.known_before
        got = [known.get(w) or before.get(w) for w in words]
        new = [k for k, ids in enumerate(got) if ids is None]
        for k, ids in zip(new, self.learn([words[k].decode().replace(" ", MARK) for k in new])):
            got[k] = ids
        known.update((w, ids) for w, ids in zip(words[: CACHE // 2], got) if len(w) <= CACHED_BYTES)
        return got

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts (null: empty): (all ids, one text's after the other's; where each text's begin, and the end)."""
        column = pc.fill_null(column.cast(pa.string()), "")
        column = pc.replace_substring(column, MARK, " ")  # the library takes either for a space
        filled = pc.greater(pc.binary_length(column), 0)
        column = pc.if_else(filled, pc.binary_join_element_wise(" ", column, ""), "")  # the library begins with a mark
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        if offsets[0] == offsets[-1]:
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        raw = column.buffers()[2][int(offsets[0]) : int(offsets[-1])]
        data, rel = np.frombuffer(raw, np.uint8), (offsets - offsets[0]).astype(np.int64)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[rel[:-1][np.diff(rel) > 0]] = True
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), raw]).dictionary_encode()
        made = self.ids_of(coded.dictionary.to_pylist())
        flat, sizes = np.frombuffer(b"".join(made), np.int32), np.array([len(m) >> 2 for m in made], np.int64)
        ids, end = gather(flat, sizes, coded.indices.to_numpy(zero_copy_only=False))
        return ids, np.append(0, end)[np.searchsorted(starts, rel)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids array<int>, decoded string, and the columns named in keep.

    docs: doc_id, text. A row for every row, equal ones too; null and empty texts have no ids and decode to the empty text; a null
    doc_id stays null. Texts of any length are encoded whole. Columns not named are not read, so their names can't clash. A word of which the
    agenda and the library make different ids ends the job: no wrong ids are written.
    """
    ship(docs.sparkSession)
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"kept_{c}") for c in keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fields = row.schema.fields[1:-1]

    def run(batches):
        vocabulary = pieces(model)
        for b in chunks(batches):
            ids, at = vocabulary.encode(b.column("text"))
            each = ids.tolist()
            decoded = [vocabulary.decode(each[a:z]) for a, z in zip(at.tolist(), at[1:].tolist())]
            made = [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *(b.column(f.name) for f in fields)], ["doc_id", "ids", "decoded", *(f.name for f in fields)])
        tidy()

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    return row.mapInArrow(run, f"doc_id long, ids array<int>, decoded string{extra}").withColumnsRenamed({f"kept_{c}": c for c in keep})


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, model: str) -> DataFrame:
    """As encode(), with digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(docs.sparkSession)

    def run(batches):
        vocabulary = pieces(model)
        decimal = vocabulary.decimal
        for b in chunks(batches):
            ids, at = vocabulary.encode(b.column("text"))
            each = ids.tolist()
            lists = [each[a:z] for a, z in zip(at.tolist(), at[1:].tolist())]
            yield table(
                {
                    "doc_id": b.column("doc_id"),
                    "n_tokens": np.diff(at),
                    "ids_sha256": [hashlib.sha256(",".join([decimal[x] for x in i]).encode()).hexdigest() for i in lists],
                    "decoded_sha256": [hashlib.sha256(vocabulary.decode(i).encode()).hexdigest() for i in lists],
                },
                DIGEST,
            )
        tidy()

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
