"""Acquisition without the network: candidate addresses, guards, manifests, caches and sinks as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def candidates(spark: SparkSession, listed: list[str], names: list[str], prefixes: list[str], suffix: str = ".pdf") -> DataFrame:
    """(url, origin): the listed addresses, then every prefix with every name (both short lists of the caller), each once, the
    listed first; names under a guard are left out."""
    fixed = spark.createDataFrame([(u, "listed", i) for i, u in enumerate(listed)], "url string, origin string, place int")
    made = spark.createDataFrame([(n, prefixes) for n in names], "name string, prefixes array<string>").filter(~is_redline(F.col("name")))
    made = made.select(F.explode("prefixes").alias("p"), "name").select(F.concat("p", "name", F.lit(suffix)).alias("url"), F.lit("made").alias("origin"), F.lit(len(listed)).alias("place"))
    return fixed.unionByName(made).groupBy("url").agg(F.min_by("origin", "place").alias("origin"))


def is_redline(name: Column) -> Column:
    """Drafts with marked changes, by name."""
    return F.contains(F.upper(name), F.lit("REDLINE"))


def region(url: Column) -> Column:
    """The two digits of the region in a media address, null if it has none."""
    return F.nullif(F.regexp_extract(url, r"/images/G/(\d{2})/", 1), F.lit(""))


def in_region(url: Column, want: str = "01") -> Column:
    """Whether a media address carries the region wanted."""
    return F.coalesce(region(url) == want, F.lit(False))


def manifest(contents: DataFrame, key: str, content: str, before: DataFrame | None = None) -> DataFrame:
    """Key, sha256, bytes of each content; entries of an earlier manifest stay for keys that are not among them."""
    now = contents.select(key, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))
    return now if before is None else now.unionByName(before.join(now.select(key), key, "left_anti").select(now.columns))


def missing(contents: DataFrame, key: str, before: DataFrame) -> DataFrame:
    """Contents that a manifest does not have yet."""
    return contents.join(before.select(key), key, "left_anti")


def cached(rows: DataFrame, cache: DataFrame, text: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the cached vector of their fingerprint (model and text), and the rows that have none."""
    keyed = rows.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("\x00", F.lit(model), F.coalesce(text, F.lit(""))), 256), 1, 32))
    return keyed.join(cache, "fingerprint"), keyed.join(cache.select("fingerprint"), "fingerprint", "left_anti")


def chunk_lines(chunks: DataFrame, vector: str = "embedding", score: str = "best_similarity") -> DataFrame:
    """One JSON object a chunk, vectors to 6 places and scores to 4; to be written as text."""
    short = chunks.withColumn(vector, F.transform(vector, lambda x: F.round(x.cast("double"), 6))).withColumn(score, F.round(score, 4))
    return short.select(F.to_json(F.struct("*")).alias("value"))


def prepare(chunks: DataFrame, allowed: list[str], lists: list[str], agreement: str, link: str) -> DataFrame:
    """Only the fields an index takes, empty lists null, and the agreement's passages with its link where they have none."""
    out = chunks.select(*[c for c in chunks.columns if c in allowed])
    for c in [x for x in lists if x in out.columns]:
        out = out.withColumn(c, F.when(F.size(c) > 0, F.col(c)))
    empty = F.coalesce(F.col("source_url"), F.lit("")) == ""
    return out.withColumn("source_url", F.when(empty & (F.col("doc_id") == agreement), F.lit(link)).otherwise(F.nullif("source_url", F.lit(""))))


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Old rows, replaced by new ones of the same key; of several new ones of a key the last by seq."""
    last = new.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).filter("nth = 1").drop("nth")
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(old.columns))
