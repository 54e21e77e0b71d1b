"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its written rows are the next one's docs. A stage's own table of texts is deleted
when the next stage begins: its result must have been written by then, as it is in run().
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.llm import decontaminate, jaccard, pieces, pii, quality_rules
from biotope.llm.common import cut, drop


def _left(spark: SparkSession) -> list[DataFrame]:
    """Written tables of texts that the last stage's result reads."""
    return spark.sparkContext.__dict__.setdefault("_corpus_pipeline_left", [])


def _release(spark: SparkSession) -> None:
    left = _left(spark)
    while left:
        drop(left.pop())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), tables=_left(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle sets."""
    _release(spark)
    return jaccard.one_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text."""
    made = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source", "text"))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("encode", encode)]

#: The near-duplicate, personal-data and encoding stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
