"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Every rule is a signal that grows with worse text and a fixed sequence of cutoffs, from lenient to strict. On labelled good
documents that pass the base rules, the number x of n that a cutoff rejects in a stratum is tested: P(Bin(n, a) <= x) <= d shows, at
error d, that the rule rejects less than a share a of the stratum's good documents (the exact one-sided Clopper-Pearson bound lies
below a). A rule's cutoffs are tested in order and testing stops at the first that fails, which needs no correction within the
sequence; d is the total error divided by strata and rules (Bonferroni), and a the total risk divided by rules, so with probability
1 - ERROR all rules together reject less than RISK of the good documents of every stratum. A rule without a certified cutoff in
a stratum rejects nothing there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

RISK, ERROR = 0.02, 0.05
#: Cutoffs by rule, lenient to strict; a document is rejected above its stratum's cutoff.
CUTOFFS = {
    "symbols": (0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05),  # n_symbols / word_chars
    "exclaims": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),  # exclamation marks / n_words
    "repeats": (0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10),  # n_repeat_words / n_words
    "dup_lines": (0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20),  # n_dup_lines / lines with a word
}
_WORD = r"[^\x20\x09-\x0D]+"


def repeat_words(words: Column) -> Column:
    """The number of words in 3-word windows that occur twice or more in the list.

    Windows are compared by a 64-bit hash. Sorted with their places, equal ones are neighbours; then each found window adds the
    words since the window found before it, three at most.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    # transform over a list of one binds the sorted list to a name, so that it is made once
    def neighbours(s: Column) -> Column:
        same = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    places = F.get(F.transform(F.array(F.sort_array(windows)), neighbours), F.lit(0))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])
    return F.when(n >= 4, covered).otherwise(F.lit(0))


def signals(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), n_lines, n_exclaims, base_failed.

    A row for every row; null and empty texts have counts of 0 and fail the base rules; a null stratum, or none among the columns, is "".
    """
    return _signals(docs, stratum).drop("row", "number")


def _signals(docs: DataFrame, stratum: str, whole: bool = False) -> DataFrame:
    """signals(), with the whole row in the column row if asked for."""
    lang = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*(docs[c] for c in docs.columns)) if whole else F.lit(0)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("stratum"), text.alias("text"), row.alias("row"))
    split = one.select(
        "row",
        "doc_id",
        "stratum",
        F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)).alias("lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
    )
    counted = split.select(
        "row",
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_exclaims",
        F.monotonically_increasing_id().alias("number"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rule_values() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {"symbols": share("n_symbols", "word_chars"), "exclaims": share("n_exclaims", "n_words"), "repeats": share("n_repeat_words", "n_words"), "dup_lines": share("n_dup_lines", "n_lines")}


def binomial_tail(x: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= x): the term at x by logarithms, and the terms below it by their ratios; 1 where x >= n * a."""
    to = F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<long>"))
    choose = F.aggregate(to, F.lit(0.0), lambda s, j: s + F.log((n - x + j).cast("double") / j))
    top = F.exp(choose + x * F.log(F.lit(a)) + (n - x) * F.log(F.lit(1 - a)))
    # from i to i - 1 the term is multiplied by i (1 - a) / ((n - i + 1) a)
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def down(s: Column, j: Column) -> Column:
        i = x - j + 1
        t = s["t"] * i * (1 - a) / ((n - i + 1) * a)
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    total = top * F.aggregate(to, zero, down, lambda s: s["s"])
    return F.when(x >= n * F.lit(a), F.lit(1.0)).otherwise(total)


def certified(found: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, cutoffs: dict = CUTOFFS) -> DataFrame:
    """stratum, and a cutoff for each rule (null: none is certified). found: signals(). labels: doc_id, quality (1: good); ids that
    are null or repeated count once, other qualities not at all. Strata without a good document aren't in the result."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = found.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    values = rule_values()
    # the place in its rule's sequence at which a document is rejected first; one past the end if nowhere
    def place(value: Column, cs: tuple) -> Column:
        return F.lit(len(cs)) - F.size(F.filter(F.array(*map(F.lit, cs)), lambda c: value > c))

    first = [F.struct(F.lit(rule).alias("rule"), place(values[rule], cs).alias("at")) for rule, cs in cutoffs.items()]
    counts = cut(held.select("stratum", F.explode(F.array(*first)).alias("f")).groupBy("stratum", "f.rule", "f.at").agg(F.count("*").alias("n")), "counts")
    grid = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("at"), F.lit(float(c)).alias("cutoff")) for rule, cs in cutoffs.items() for k, c in enumerate(cs))))
    strata = counts.groupBy("stratum").agg((F.sum("n") / len(cutoffs)).cast("long").alias("total"))
    tests = strata.select("stratum", "total", grid.alias("g")).select("stratum", "total", "g.*").join(counts, ["stratum", "rule", "at"], "left")
    sequence = Window.partitionBy("stratum", "rule").orderBy("at")
    a = risk / len(cutoffs)
    # a stricter cutoff rejects what a more lenient one does: x counts the documents rejected at this place or before it
    tests = tests.withColumn("x", F.sum(F.coalesce("n", F.lit(0))).over(sequence).cast("long"))
    n_strata = max(1, strata.count())
    passed = binomial_tail(F.col("x"), F.col("total"), a) <= F.lit(error / (n_strata * len(cutoffs)))
    tests = tests.withColumn("passed", F.min(passed.cast("int")).over(sequence) == 1)
    return tests.where("passed").groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in cutoffs))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR, cutoffs: dict = CUTOFFS) -> DataFrame:
    """doc_id, stratum, the counts of signals(), the stratum's cutoffs (cut_<rule>, null: none), base_failed, kept.

    kept is false if the base rules fail or a signal is above its stratum's cutoff. docs: doc_id, text and the stratum's column;
    other columns are not read. A row for every row, equal ones too; null and empty texts have counts of 0 and fail the base rules, very long ones
    are counted whole; a null stratum, or none among the columns, is "". Without labels no cutoff is certified and the base rules decide.
    The texts are read once; what follows works on the written counts.
    """
    found = cut(signals(docs, stratum), "signals")
    return _judged(found, certified(found, labels, risk, error, cutoffs), cutoffs)


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR, cutoffs: dict = CUTOFFS, tables: list | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns, whatever their names; equal rows stay or go alike, and null and empty texts go; an
    empty table gives an empty one. Texts are read and counted once: rows that pass the base rules are written with their counts, chosen from by the
    cutoffs, and not shuffled. Columns must be of types that Parquet takes. tables: a list that gets the table of these rows, which the result reads,
    for the caller to drop() when the result is written."""
    # the row's number, which is not deterministic to the optimiser, holds the filter above the counts; below them it would have a
    # copy of their expressions for each use
    passed = cut(_signals(docs, stratum, whole=True).where("not base_failed and number >= 0").drop("number"), "passed")
    if tables is not None:
        tables.append(passed)
    chosen = certified(passed.drop("row"), labels, risk, error, cutoffs)
    return _judged(passed, chosen, cutoffs).where("kept").select("row.*")


def _judged(found: DataFrame, chosen: DataFrame, cutoffs: dict) -> DataFrame:
    chosen = cut(chosen, "cutoffs")
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = found.join(F.broadcast(chosen) if few else chosen, "stratum", "left")
    bad = F.col("base_failed")
    for rule, value in rule_values().items():
        if rule in cutoffs:
            bad = bad | F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False))
    return joined.withColumn("kept", ~bad)


def sql(stratum: str = "coalesce(lang, '')", risk: float = RISK, error: float = ERROR) -> str:
    """The same rows by DuckDB; stratum is an expression of documents."""
    return f"""
WITH base AS (
  SELECT doc_id, {stratum} AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), tri AS (
  SELECT doc_id, i, w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS d
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), counts AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims
  FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), rules(rule, place, cutoff) AS (
  VALUES {", ".join(f"('{r}', {k}, CAST({c} AS DOUBLE))" for r, cs in CUTOFFS.items() for k, c in enumerate(cs))}
), value AS (
  SELECT doc_id, stratum, base_failed, unnest([
    {{'rule': 'symbols', 'v': coalesce(n_symbols / nullif(CAST(word_chars AS DOUBLE), 0), 0)}},
    {{'rule': 'exclaims', 'v': coalesce(n_exclaims / nullif(CAST(n_words AS DOUBLE), 0), 0)}},
    {{'rule': 'repeats', 'v': coalesce(n_repeat_words / nullif(CAST(n_words AS DOUBLE), 0), 0)}},
    {{'rule': 'dup_lines', 'v': coalesce(n_dup_lines / nullif(CAST(n_lines AS DOUBLE), 0), 0)}}]) AS s FROM failed
), held AS (
  SELECT stratum, s.rule AS rule, s.v AS v FROM value
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), tests AS (
  SELECT h.stratum, r.rule, r.place, r.cutoff, count(*) AS n, count(*) FILTER (h.v > r.cutoff) AS x
  FROM held h JOIN rules r USING (rule) GROUP BY ALL
), tails AS (
  SELECT t.*, CASE WHEN x >= n * {risk / len(CUTOFFS)} THEN 1 ELSE
    list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({risk / len(CUTOFFS)}) + (n - k) * ln(1 - {risk / len(CUTOFFS)})))) END AS p
  FROM tests t
), ok AS (
  SELECT *, min(CASE WHEN p <= {error} / ((SELECT count(DISTINCT stratum) FROM held) * {len(CUTOFFS)}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY stratum, rule ORDER BY place) AS passed FROM tails
), chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM ok WHERE passed = 1 GROUP BY ALL
), bad AS (
  SELECT DISTINCT doc_id FROM value v JOIN chosen c ON v.stratum = c.stratum AND v.s.rule = c.rule WHERE v.s.v > c.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM failed
"""
