"""From raw documents to token files: quality classifier, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Null texts go through every stage as empty texts would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, mixing, near_dedup, quality_model, token_output
from tessera.llm.common import renamed, shared_dir, store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject. Null and empty texts are judged by their score
    as others are, rows that repeat are judged alike, extra columns keep their names and values; no documents give none."""
    model = quality_model.fit(quality_model.learnable(docs), table(spark, sf_dir, "labels"))
    safe, back = renamed(docs, "doc_id", "text")
    return quality_model.score(safe, model, safe.columns).filter(F.col("score") >= quality_model.THRESHOLD).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least doc_id; of rows that repeat doc_id and text, one. Null and
    wordless texts stay, each by itself; extra columns keep their names and values; no documents give none."""
    return near_dedup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and wordless texts hold none and stay; rows that repeat are judged
    alike; extra columns keep their names and values; no documents give none, and an empty benchmark removes none."""
    safe, back = renamed(docs, "doc_id", "text")
    return decontaminate.decontaminate(safe, table(spark, sf_dir, "benchmark"), safe.columns).filter("n_hit = 0").select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks for, in a shuffled order. A null source is one of its own, null and empty texts
    get their source's rate, rows that repeat the same count; extra columns keep their names and values; no documents give none."""
    return mixing.mixture(docs)


def place(docs: DataFrame) -> DataFrame:
    """doc_id, text and place, the number of the row in the files it was written to; in order of doc_id if it is not from files."""
    own = [F.col("doc_id"), F.col("text")]
    try:
        return docs.select(*own, (F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long") * (1 << 36) + F.col("_metadata.row_index")).alias("place"))
    except AnalysisException:
        return docs.select(*own, F.col("doc_id").alias("place"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the mixture's order, read back: doc_id, start, n_tokens, ids_crc32 of every copy. Null and empty texts are the
    end id alone; extra columns are ignored; no documents give no rows."""
    path = shared_dir(spark)
    token_output.write(place(docs), path, order="place")
    return token_output.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("tokens", tokens),
]
#: Compression, hashing of shingles and token ids have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
