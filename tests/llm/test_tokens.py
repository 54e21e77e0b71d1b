import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from llm.helpers import ODD, empty, odd

from biotope.llm import bytesplit, known, pieces, pretokens, token_counts, token_output


def texts(n, seed=1):
    r = random.Random(seed)
    al = list("ab1. \n\t'stmdrevl'é²\x85\xa0_-Σ日<|") + ["'s", "'ll", "'re", "  ", "<|endoftext|>", "<|startoftext|>", "\r\n", "½", "İ", "́"]
    return ["".join(r.choice(al if r.random() < 0.3 else al[:22]) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_words_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 119, 120, 121, 300, 5000):
        for hi in (1, 2, 5, 300, 50_000, 2**17, 2**32, 2**59, 2**60, 2**63):
            a = rng.integers(0, hi, n, dtype=np.uint64)
            if n and hi == 2**63:
                a[:: max(1, n // 7)] = 2**64 - 1
            words, escapes = token_output.pack(a)
            assert (token_output.unpack(words, escapes) == a).all()


def test_encoder_is_the_library():
    encode, library = token_output.encoder(P.path("byte_bpe_50k.json")), pretokens.pretokens(P.path("byte_bpe_50k.json")).tokenizer
    every = texts(3000) + ["a" + chr(c) + "b 1" + chr(c) + " ." + chr(c) for c in range(bytesplit.LIMIT + 200)]
    for k in range(0, len(every), 50):
        some = every[k : k + 50]
        assert [x.tolist() for x in encode(pa.array(some))] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_with_little_memory(monkeypatch, name):
    monkeypatch.setattr(token_output, "CACHE", 40)
    monkeypatch.setattr(token_output, "HELD_WORDS", 7)
    monkeypatch.setattr(token_output, "_known", {})
    monkeypatch.setattr(pretokens, "RUN", 3)
    encode, library = token_output.encoder(P.path(name)), pretokens.pretokens(P.path(name)).tokenizer
    every = [*texts(600, 6), "", "日本 \u3000日本語 é", " é", " ", " é È ça aé ½ x½ don't I'LL we'll '", "x" * 5000, "", "日" * 300, "a\x00 a a\x00\x00", " Σίσυφος ΑΣ. — « un » été", "о мире " * 9]
    for k in range(0, len(every), 40):
        some = every[k : k + 40]
        for items in (pa.array(some), pa.array(["é", *some, "b"])[1:-1]):
            assert [x.tolist() for x in encode(items)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_known_is_a_dictionary():
    r, asked, held = random.Random(7), [], known.Known(900)

    def make(new):
        asked.extend(new.to_pylist())
        runs = [run(w) for w in new.to_pylist()]
        return np.array([x for ids in runs for x in ids], np.uint32), np.array([len(ids) for ids in runs], np.int64)

    def run(word):
        return [zlib.crc32(word) + j & 0xFFFFFFFF for j in range(len(word) % 4)]

    pool = sorted({bytes(r.choice(b"\x00\x00ab\xff") for _ in range(r.choice([1, 2, 3, 14, 15, 16, 17, 40]))) for _ in range(6000)})
    seen = set()
    for size in (0, 1, 300, 300, 2000, 400, 400, 400, 400):
        some = r.sample(pool, size)
        if held.n > 900:
            seen = set()
        asked.clear()
        ids, sizes = held.ask(pa.array(some, pa.binary()), make)
        assert ids.tolist() == [x for w in some for x in run(w)] and sizes.tolist() == [len(w) % 4 for w in some]
        assert sorted(asked) == sorted(set(some) - seen)
        seen |= set(some)


def test_known_words_cost_little():
    """Words that are known, encoded and packed, take a small share of the library's own time for the texts."""
    r = random.Random(8)
    some = [" ".join("".join(r.choices("etaoinshrdlu", k=r.randint(4, 11))) for _ in range(500)) for _ in range(300)]
    encode, library = token_output.encoder(P.path("byte_bpe_50k.json")), pretokens.pretokens(P.path("byte_bpe_50k.json")).tokenizer

    def seconds(f):
        took = []
        for _ in range(4):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    def ours():
        ids = np.concatenate(encode(items)).astype(np.uint64)
        for k in range(0, len(ids), token_output.BLOCK_IDS):
            token_output.pack(ids[k : k + token_output.BLOCK_IDS])

    items = pa.array(some)
    encode(items)
    assert seconds(ours) < seconds(lambda: library.encode_batch_fast(some, add_special_tokens=False)) / 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pretokens_are_the_library(name):
    pre = pretokens.pretokens(P.path(name))
    for t in texts(1500, 2):
        if (split := pre.split(t)) is not None:
            assert [i for w in split for i in pre.encode([w])[0]] == pre.encode([t])[0], t


def test_files(spark):
    library = pretokens.pretokens(P.path("byte_bpe_50k.json")).tokenizer
    for parts in (1, 3):
        made = token_output.write_ids(odd(spark), P.path("byte_bpe_50k.json"), parts=parts)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read_digests(made).collect())
        want, at = [], 0
        for doc_id, text, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((at, doc_id, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want
        whole = token_output.read_ids(made).orderBy("start").collect()
        assert [len(r.ids) for r in whole] == [w[2] for w in want]
    assert token_output.read_digests(token_output.write_ids(empty(spark), P.path("byte_bpe_50k.json"))).count() == 0


def test_counts(spark):
    library = pretokens.pretokens(P.path("word_bpe_49k.json")).tokenizer
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts(300, 3))], "doc_id long, text string")
    docs = odd(spark).select("doc_id", "text").union(more)
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in docs.collect()), key=repr)
    for head in (0, 5, 1000):
        got = token_counts.count_tokens(docs, P.path("word_bpe_49k.json"), head=max(1, head)).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.count_tokens(odd(spark), P.path("word_bpe_49k.json")).count() == len(ODD)
    assert token_counts.count_tokens(empty(spark), P.path("word_bpe_49k.json")).count() == 0


def test_pieces(spark):
    v = pieces.pieces(P.path("piece_bpe_32k.model"))
    every = texts(1500, 4) + ["", " ", "  a", "▁▁a ▁", "日本語😀", "x" * 500]
    ids, at = v.encode(pa.array(every))
    for t, a, z in zip(every, at, at[1:]):
        assert ids[a:z].tolist() == v.library.encode(t), t
    words = sorted({"▁" * r.randint(0, 3) + "".join(r.choice("abcdethé日😀\n") for _ in range(r.randint(1, 14))) for r in [random.Random(5)] for _ in range(3000)})
    for w, made in zip(words, v.side_by_side(words)):
        assert made is None and not w.isascii() or np.frombuffer(made, np.int32).tolist() == v.agenda(w), w
    got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in pieces.digests(odd(spark), P.path("piece_bpe_32k.model")).collect()), key=repr)
    want = []
    for d, t, _ in ODD:
        ids = v.library.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(v.library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    kept = pieces.encode(odd(spark), P.path("piece_bpe_32k.model"), keep=("lang", "ids"))
    assert kept.columns == ["doc_id", "ids", "decoded", "lang", "ids"] and kept.count() == len(ODD)
    assert pieces.digests(empty(spark), P.path("piece_bpe_32k.model")).count() == 0
