"""Quality rules as a bitmask ledger, in DataFrame expressions only.

`measure` takes the measurements of every whole text once; `ledger` evaluates every rule on them once and stores one bit a
rule in `failed`; a policy is a named, versioned set of rules (a mask) under which a document is kept if no bit of the mask
is set; `ablation` counts, for every rule of a policy, what it alone removes and what would come back without it, from
the ledger by bitwise aggregation, without touching texts again.

Words are runs of characters other than space and 0x09-0x0D. Repeated words: words in windows of eight words that occur
twice or more in the text, by 64-bit hashes of the windows, compared within a text only.

Edge cases: null and empty texts have no words and all measurements 0 (they fail `few_words`); a text of fewer than eight
words has no window; rows that repeat a doc_id each get a row; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import table

WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: name: (measurements -> failed). A rule's place is its bit; rules are only ever added at the end.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda c: c("n_words") < 20,
    "repeated_windows": lambda c: 100 * c("n_repeat_words") > 30 * c("n_words"),
    "symbols": lambda c: 100 * c("n_symbols") > 10 * c("n_words"),
    "duplicate_lines": lambda c: (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
    "same_word_runs": lambda c: 100 * c("n_same_as_before") > 15 * c("n_words"),
    "shouting": lambda c: 100 * c("n_upper_words") > 30 * c("n_words"),
    "word_length": lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
    "too_long": lambda c: c("n_words") > 1_000_000,
}
#: version: rules that count. Every version holds the base rules.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "same_word_runs", "shouting", "word_length"),
    "v2": tuple(RULES)[:7],
}
CURRENT = "v1"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, though use names it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the array."""
    n = F.size(words)
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def counted(h: Column) -> Column:
        # Starts of repeated windows: equal neighbours after sorting (hash, start).
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(placed, lambda p: _let(F.array_sort(F.transform(F.filter(p, lambda x, k: ((k > 0) & (F.get(p, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])), covered))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(h))).cast("long")


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' columns `keep` with n_words and the measurements, all long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.translate(text, SPACE[1:], " " * (len(SPACE) - 1))
    words = F.array_remove(F.split(spaced, " "), "")
    # A line with a word: something is left of it without white space.
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")

    def of_words(w: Column) -> Column:
        same = F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, F.greatest(i - 1, F.lit(0))) == x)))
        upper = F.size(F.filter(w, lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), same.cast("long").alias("n_same_as_before"), upper.cast("long").alias("n_upper_words"))

    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        *keep,
        _let(words, of_words).alias("_w"),
        of_lines.alias("_l"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(*keep, "_w.*", "_l.*", "word_chars", "n_symbols")


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The measurements with `failed`, the bits of the rules that a document fails."""
    m = measure(docs, keep or ["doc_id"])
    bits = [F.when(rule(F.col), F.lit(bit(name))).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    return m.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with base_failed and kept under a policy."""
    hit = lambda p: F.col("failed").bitwiseAND(F.lit(mask(p)).cast("long")) != 0
    return rows.withColumn("base_failed", hit("base")).withColumn("kept", ~(hit("base") | hit(policy)))


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only (removed by it alone, so back without it), n_any, of a ledger; one pass over the bits."""
    patterns = rows.select(F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("f")).groupBy("f").count()  # at most 2 ** rules
    rules = rows.sparkSession.createDataFrame([(name, bit(name)) for name in POLICIES[policy]], "rule string, b long")
    b = F.col("f").bitwiseAND(F.col("b"))
    return patterns.join(F.broadcast(rules)).groupBy("rule").agg(*[F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias(n) for n, c in (("n_failed", b != 0), ("n_only", F.col("f") == F.col("b")), ("n_any", F.col("f") != 0))])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 1 over the whole of documents."""
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_same_as_before", "n_upper_words", "failed")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS l FROM t),
numbered AS (SELECT row_number() OVER () AS r, * FROM w),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM numbered)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(text)::BIGINT - length(translate(text, '#*$%&|<>', ''))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x))::BIGINT AS n_same_as_before,
  len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x))::BIGINT AS n_upper_words
  FROM numbered LEFT JOIN cov USING (r)),
f AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
  + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (100 * n_same_as_before > 15 * n_words)::INT + 32 * (100 * n_upper_words > 30 * n_words)::INT
  + 64 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 128 * (n_words > 1000000)::INT)::BIGINT AS failed FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed & 119 = 0 AS kept FROM f
"""
