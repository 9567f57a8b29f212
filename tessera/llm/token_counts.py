"""Exact length histogram: documents aggregated by encoded length, and suffix sums over it.

`histogram` encodes every whole text once. `suffix_sums` adds, for each length L that occurs, the documents and tokens
of at least L; from these follow, for a context limit C: documents over C, total tokens, and tokens left when every
text is cut at C (tokens below + C * documents of C and more). Quantiles are read off the same sums.

The sums run over distinct lengths in two levels (within ranges of lengths, then over range totals), so no task holds
all of them. Edge cases: null and empty text have length 0; an empty table gives no rows; rows that repeat count each; extra
columns are ignored, and a kept column named n_tokens gives way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import fields, kept, map_batches, store, table

LIMITS = (128, 256, 512, 1_024, 2_048, 4_096, 8_192, 16_384, 32_768, 65_536, 131_072)
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
RANGE = 1_024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tessera", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """docs' columns `keep` with n_tokens."""
    path = tokenizer or default_tokenizer()
    keep = [] if keep == [] else kept(keep, ("n_tokens",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, fields(docs, keep) + "n_tokens long")


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """n_tokens, n_docs; stored, as the sums read it several times and encoding is by far the dearest step."""
    return store(lengths(docs, [], tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist with docs_ge, tokens_ge, trunc_tokens (total when cut at n_tokens) and quantile (share of documents up to it)."""
    h = hist.withColumn("_r", F.floor(F.col("n_tokens") / RANGE)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    totals = h.groupBy("_r").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_s"))
    totals = totals.select("_r", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_above") for c in ("_d", "_s")])
    whole = h.agg(F.sum("n_docs").alias("_docs"), F.sum("_t").alias("_tokens"))
    down = Window.partitionBy("_r").orderBy(F.desc("n_tokens"))
    out = h.withColumn("_dw", F.sum("n_docs").over(down)).withColumn("_tw", F.sum("_t").over(down)).join(totals, "_r").join(F.broadcast(whole))  # one row
    out = out.withColumn("docs_ge", F.col("_dw") + F.col("_d_above")).withColumn("tokens_ge", F.col("_tw") + F.col("_s_above"))
    return out.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (F.col("_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("trunc_tokens"),
        ((F.col("_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("_docs")).alias("quantile"),
    )


def context_report(sums: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """For each context limit: documents in full, documents cut, total tokens and tokens after cutting."""
    at = sums.sparkSession.createDataFrame([(c,) for c in limits], "limit long")
    per = sums.agg(*[F.struct(F.coalesce(F.sum(F.when(F.col("n_tokens") > c, F.col("n_docs"))), F.lit(0)).alias("cut"), F.sum("n_docs").alias("docs"), F.sum(F.least("n_tokens", F.lit(c)) * F.col("n_docs")).alias("kept"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total")).alias(str(c)) for c in limits])
    rows = per.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c).cast("long") for c in limits]), F.array(*[F.col(f"`{c}`") for c in limits])))).select(F.col("key").alias("limit"), "value.*")
    return at.join(rows, "limit").select("limit", (F.col("docs") - F.col("cut")).alias("docs_whole"), F.col("cut").alias("docs_cut"), F.col("total").alias("total_tokens"), F.col("kept").alias("kept_tokens"))


def quantiles(sums: DataFrame, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Smallest length up to which at least the share of documents reaches."""
    return sums.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"p{q:g}") for q in at])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole histogram of documents with its suffix sums."""
    return suffix_sums(histogram(table(spark, sf_dir, "documents")))
