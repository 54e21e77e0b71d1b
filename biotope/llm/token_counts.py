"""Token counts without ids: pieces are counted once for each distinct pre-token of the corpus, joined to the documents' own
pre-token frequencies and summed.

The most frequent pre-tokens (HEAD of them at most, none longer than HEAD_CHARS: a bounded table) reach the documents by broadcast, where
they are summed at once; only the rest, which has no frequent key by its definition, is dealt out and joined.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, most_frequent, ship, sliced, table, texts
from .pretokens import pretokens

HEAD, HEAD_CHARS = 150_000, 64
#: Distinct pre-tokens that a task holds before it hands on its counts.
HELD = 300_000

FREQ = pa.schema([("pretoken", pa.string()), ("freq", pa.int64())])
PIECES = pa.schema([("pretoken", pa.string()), ("freq", pa.int64()), ("n", pa.int64())])
DOCS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("rest", pa.list_(pa.struct([("pretoken", pa.string()), ("freq", pa.int64())])))])


def vocabulary(docs: DataFrame, tokenizer: str) -> DataFrame:
    """pretoken, freq (in the corpus), n (pieces): a row for each distinct pre-token, written in the shared folder."""
    ship(docs.sparkSession)

    def freqs(batches):
        pre, held = pretokens(tokenizer), Counter()

        def out():
            made = table({"pretoken": list(held), "freq": list(held.values())}, FREQ)
            held.clear()
            return made

        for b in sliced(batches):
            for text in b.column("text").to_pylist():
                held.update(pre.split(text) or ())
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    def count(batches):
        pre = pretokens(tokenizer)
        for b in sliced(batches, 4096):
            n = [len(i) for i in pre.encode(b.column("pretoken").to_pylist())]
            yield table({"pretoken": b.column("pretoken"), "freq": b.column("freq"), "n": n}, PIECES)

    found = texts(docs).select("text").mapInArrow(freqs, "pretoken string, freq long")
    return cut(found.groupBy("pretoken").agg(F.sum("freq").alias("freq")).mapInArrow(count, "pretoken string, freq long, n long"), "vocabulary")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (as the tokenizers library gives them), over_limit (n_tokens > limit).

    docs: doc_id, text. A row for every row, equal ones too; null and empty texts have 0 bytes and 0 tokens; a null doc_id stays
    null. Very long texts are counted whole. Special strings in a text count as the library's default has them, one token each.
    Other columns are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    vocab = vocabulary(docs, tokenizer)
    top = most_frequent(vocab.where(F.length("pretoken") <= HEAD_CHARS), "freq", head).select("pretoken", "n")
    known = spark.sparkContext.broadcast({r[0]: r[1] for r in top.collect()})

    def each(batches):
        pre, most, row = pretokens(tokenizer), known.value, TaskContext.get().partitionId() << 40
        for b in sliced(batches):
            rows, items = [], b.column("text").to_pylist()
            split = [pre.split(t) for t in items]
            whole = iter(pre.encode([t for t, ws in zip(items, split) if ws is None]))
            for doc_id, text, ws in zip(b.column("doc_id").to_pylist(), items, split):
                total, rest = 0, []
                if ws is None:
                    total = len(next(whole))
                else:
                    for w, f in Counter(ws).items():
                        n = most.get(w)
                        if n is None:
                            rest.append({"pretoken": w, "freq": f})
                        else:
                            total += n * f
                rows.append((row, doc_id, len(text.encode()), total, rest))
                row += 1
            yield table(dict(zip(DOCS.names, zip(*rows))), DOCS)

    per = cut(texts(docs).mapInArrow(each, "row long, doc_id long, n_bytes long, known long, rest array<struct<pretoken:string,freq:long>>"), "per_document")
    rest = per.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.pretoken", "r.freq")
    summed = rest.join(vocab.select("pretoken", "n"), "pretoken").groupBy("row").agg(F.sum(F.col("freq") * F.col("n")).alias("more"))
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return per.select("row", "doc_id", "n_bytes", "known").join(summed, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
