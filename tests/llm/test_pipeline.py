"""The registered queries and the pipeline at the smallest size, against brute force over the same tables."""


import hashlib
import struct
import zlib

import public_tokenizers as P
import pytest
from conftest import SF
from llm.helpers import empty, odd
from llm.test_rules import base_counts, brute_pii
from llm.test_similar import brute_components, brute_hits

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from biotope.llm import pii, pieces
from biotope.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(f"select * from ({ORACLES[name]})")
    order = [rel.columns.index(c) for c in sorted(df.columns)]
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_a_document(spark, documents, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and (name.startswith("op5") or sorted(r.doc_id for r in rows) == sorted(d for d, _, _ in documents))


def test_jaccard_and_hits(spark, documents):
    got = QUERIES["op7_jaccard_join"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(d, t) for d, t, _ in documents])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op3_decontamination"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got), key=repr) == sorted(((d, n, h, len(i)) for d, n, h, i in brute_hits([(d, t) for d, t, _ in documents], bench, 10)), key=repr)


def test_pipeline(spark, documents):
    """With few labels no cutoff is certified, so the base rules decide the first stage."""
    rows = [(d, t, lang) for d, t, lang in documents if not ((c := base_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0])]
    comp = {d: k for d, _, k in brute_components([(d, t) for d, t, _ in rows])}
    rows = [r for r in rows if comp[r[0]] == r[0]]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d: h for d, _, h, _ in brute_hits([(d, t) for d, t, _ in rows], bench, 10)}
    rows = [(d, pii.masked(t, pii.spans(t)[1]), lang) for d, t, lang in rows if not hit[d]]
    library = pieces.pieces(P.path("piece_bpe_32k.model")).library
    want = sorted((d, lang, tuple(library.encode(t))) for d, t, lang in rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.lang, tuple(r["ids"])) for r in got) == want and all(r.round_trip and r.n_tokens == len(r["ids"]) for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "personal_data", "encode"]


def test_token_queries_against_the_libraries(spark, documents):
    """The registered queries op2, op6, op8 (base) and op9."""
    texts = {d: t or "" for d, t, _ in documents}
    bytes_, words = (Tokenizer.from_file(P.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start, want = 0, set()
    for d in sorted(texts):
        ids = [*bytes_.encode(texts[d], add_special_tokens=False).ids, 0]
        want.add((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_output"](spark, SF).collect()} == want
    library = pieces.pieces(P.path("piece_bpe_32k.model")).library
    ids = {d: library.encode(t) for d, t in texts.items()}
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op6_pieces"](spark, SF).collect()}
    assert got == {(d, len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for d, i in ids.items()}
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in QUERIES["op8_pii"](spark, SF).collect()}
    base = {d: brute_pii(t) for d, t in texts.items()}
    assert got == {(d, *(sum(s[1] == k for s in found) for k in range(4)), sha(pii.written(found))) for d, found in base.items()}
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    n = {d: len(words.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert got == {(d, len(t.encode()), n[d], n[d] > 2048) for d, t in texts.items()}


@pytest.mark.parametrize("of", [odd, empty])
def test_stages_of_odd_tables(spark, of):
    """Every stage takes odd and empty tables, and all but the last return the columns of its documents."""
    docs = of(spark).withColumn("source", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        assert name == "encode" or not rows or list(rows[0].asDict()) == list(dict.fromkeys(docs.columns))
        assert len(rows) == {"quality": 0, "near_duplicates": 10, "benchmark": 10, "personal_data": 10, "encode": 10}[name] * (of is odd)
