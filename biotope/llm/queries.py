"""The queries of this subpackage, with production parameters over whole tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, decontaminate, jaccard, pieces, pii, quality_rules, token_counts, token_output, tool_calls, url_filter


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables hold no lists and no fetch times; both queries below derive them from the rows by rules that SQL can state too.
_NUMBER = "cast(conv(substr(md5({}), 1, 6), 16, 10) as int)"


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, and a fetch time: a day of 2024 and 2025 by page_id."""
    return pages.select("page_id", "url", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id * 7919 % 730 as int))").alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A log of list entries: some of the pages' hosts, and of their first folders, by a hash of the key; half of them are removed after
    some months, and some of these come back."""
    h = url_filter.host(F.col("url"))
    first = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]+)", 1)
    keys = pages.select(h.alias("key"), F.lit("hosts").alias("list")).union(pages.where(first != "").select(F.concat(h, F.lit("/"), first), F.lit("folders"))).where("key is not null").distinct()
    n = keys.withColumn("n", F.expr(_NUMBER.format("key"))).where("n % 3 = 0")
    log = F.array(
        F.struct(F.lit("add").alias("action"), F.expr("n % 500").alias("day")),
        F.struct(F.when(F.expr("n % 2 = 0"), "remove").alias("action"), F.expr("n % 500 + 90").alias("day")),
        F.struct(F.when(F.expr("n % 4 = 0"), "add").alias("action"), F.expr("n % 500 + 150").alias("day")),
    )
    return n.select("list", "key", F.explode(log).alias("e")).where("e.action is not null").select("list", "key", "e.action", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, e.day)").alias("at"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.evaluate(captures(pages), list_entries(pages)).select("page_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), F.array_join("lists", ",").alias("lists"), "rule", "blocked")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 7919 % 730 AS INTEGER)) AS fetched_at,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1) AS first,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), k AS (
  SELECT DISTINCT 'hosts' AS list, host AS key FROM p WHERE host <> ''
  UNION SELECT DISTINCT 'folders', host || '/' || first FROM p WHERE host <> '' AND first <> ''
), n AS (
  SELECT list, key, CAST(('0x' || substr(md5(key), 1, 6)) AS INTEGER) AS n FROM k
), spans AS (
  SELECT list, key, n % 500 AS a, CASE WHEN n % 2 = 0 THEN n % 500 + 90 ELSE 1000000 END AS b FROM n WHERE n % 3 = 0
  UNION ALL SELECT list, key, n % 500 + 150, 1000000 FROM n WHERE n % 3 = 0 AND n % 4 = 0
), own AS (
  SELECT page_id, fetched_at, date_diff('day', TIMESTAMP '2024-01-01', fetched_at) AS d, unnest(list_distinct(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) ||
    list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1),
      lambda i: host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[:i], '/')))) AS key
  FROM p WHERE host <> ''
), hit AS (
  SELECT page_id, fetched_at, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
         arg_min(own.key, (-length(own.key), own.key)) AS rule
  FROM own JOIN spans s ON own.key = s.key AND s.a <= d AND d < s.b GROUP BY ALL
)
SELECT page_id, strftime(p.fetched_at, '%Y-%m-%d') AS fetched_on, coalesce(lists, '') AS lists, rule, rule IS NOT NULL AS blocked FROM p LEFT JOIN hit USING (page_id)
"""


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_output.write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_digests(written)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), unnamed=True).drop("items")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: One stratum and a larger risk, so that few hundred labels certify cutoffs: op4's four strata need 1,151 good documents each.
POOLED_RISK = 0.05


def quality_rules_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of op4 with one stratum for all documents and a risk of POOLED_RISK."""
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), stratum="", risk=POOLED_RISK)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SCHEMAS = {
    "search": {"type": "object", "required": ["n", "query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1, "maximum": 1000}}},
    "translate": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "to": {"type": "string", "enum": ["en", "de"]}, "n": {"type": "integer"}}},
}


def call_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as calls and results: a user's turn calls a tool with what it says, the next turn is the result. In every tenth
    conversation the first call names the third turn's as one before it; in every seventh, n is text."""
    one = conversations.select("conv_id", "turn", "role", "text")
    cid = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"))
    before = F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") == 0), F.array(F.concat(cid, F.lit("2")))).when((F.col("turn") > 0) & ~((F.col("conv_id") % 10 == 0) & (F.col("turn") == 2)), F.array(F.concat(cid, F.col("turn") - 2)))
    n = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit('"'), F.length("text"), F.lit('"'))).otherwise(F.length("text").cast("string"))
    name = F.when(F.col("turn") % 4 == 0, "search").when(F.col("conv_id") % 11 == 0, "unheard").otherwise("translate")
    args = F.concat(F.lit('{"query":'), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1), F.lit(',"n":'), n, F.lit("}"))
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), cid, F.col("turn"), F.lit('","name":"'), name, F.lit('","after":'), F.coalesce(F.to_json(before), F.lit("[]")), F.lit(',"arguments":'), args, F.lit("}]}"))
    result = F.to_json(F.struct(F.concat(cid, F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    return one.withColumn("text", F.when(F.col("role") == "user", call).otherwise(result))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tool_calls.link(call_messages(read(spark, sf_dir, "conversations")), SCHEMAS)
    return linked.select("conv_id", "call_id", "turn", "name", "after_turn", "level", "status", "valid", F.array_join("errors", ";").alias("errors"), F.sha2("record", 256).alias("record_sha256"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = compression.fit(docs, read(spark, sf_dir, "labels"))
    return compression.score(docs, model).select(
        "doc_id", (compression.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_token_output, op3_decontamination, op4_quality_rules, op5_tool_calls, op6_pieces, op7_jaccard_join, op8_pii, op9_token_counts, op10_compression, quality_rules_pooled)}
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op4_quality_rules": quality_rules.sql(), "quality_rules_pooled": quality_rules.sql("''", POOLED_RISK)}
