"""Sources and sinks: JSON lines, query lists, header-marked text files, keyed upserts, validation before a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; bad lines give nulls."""
    return spark.read.schema(schema).json(path)


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: (category, text) of tab-separated lines; blank ones and those starting with > are comments."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit(">")))
    parts = F.split("value", "\t", 2)
    return lines.filter(F.size(parts) == 2).select(F.trim(parts[0]).alias("category"), F.trim(parts[1]).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, url, body): SOURCE: and TITLE: of the first four lines, body after the first rule of 60 dashes."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.txt)?$", 1).alias("file"), F.col("value").alias("raw"))
    head = F.concat_ws("\n", F.slice(F.split("raw", "\n"), 1, 4))
    field = lambda n: F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{n}:(.*)$", 1), r"\s+", " "))
    rule = F.lit("-" * 60)
    body = F.when(F.contains("raw", rule), F.substring("raw", F.locate("-" * 60, F.col("raw")) + 60, F.length("raw"))).otherwise(F.col("raw"))
    return raw.select("file", F.coalesce(F.nullif(field("TITLE"), F.lit("")), "file").alias("title"), F.nullif(field("SOURCE"), F.lit("")).alias("url"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those that new replaces; of new rows of one key, any one must do."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def faults(chunks: DataFrame, key: str, dims: int) -> DataFrame:
    """One row: null keys, repeated keys, vectors of another size."""
    return chunks.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != dims).alias("w")).agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"), F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("repeated_keys"), F.coalesce(F.sum("w"), F.lit(0)).alias("wrong_size"))
