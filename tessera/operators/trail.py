"""Trail operators: last write wins, stage latencies, queue statistics, monthly coverage, evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the greatest seq of each key. An aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def latencies(rows: DataFrame, key: str, at: Column, order: list[str]) -> DataFrame:
    """Ms since the step before of the same key, never negative; 0 for the first."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("ms", F.greatest(F.lit(0), at - F.lag(at).over(w)))


def month(ts: Column) -> Column:
    """In UTC, which the session's time zone must be."""
    return F.date_format(ts, "yyyy-MM")


def sort_key(prefix: str, n: Column, width: int) -> Column:
    """Text that sorts as the number."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def coverage(runs: DataFrame, examples: int = 3) -> DataFrame:
    """A10: runs (month, subject, gap, sk) to month, subject, runs, gaps, gap_rate and the first examples of gaps."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("gap") & (F.col("i") <= examples), F.col("sk")))), 1, examples)
    nth = Window.partitionBy("month", "subject", "gap").orderBy("sk")
    return runs.withColumn("i", F.row_number().over(nth)).groupBy("month", "subject").agg(F.count("*").alias("runs"), F.count_if("gap").alias("gaps"), F.round(F.count_if("gap") / F.count("*"), 4).alias("gap_rate"), F.concat_ws(",", first).alias("examples"))


def nearest_pages(runs: DataFrame, title: str, k: int = 5) -> DataFrame:
    """The k titles most often nearest to gaps."""
    return runs.filter("gap").groupBy(title).agg(F.count("*").alias("n")).orderBy(F.desc("n"), title).limit(k)


def evaluation(best: DataFrame, by: list[str], value: str = "cosine", usable: float = 0.70, strong: float = 0.75) -> DataFrame:
    """Number, usable, strong and mean."""
    v = F.col(value)
    return best.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(v >= usable).alias("usable"), F.count_if(v >= strong).alias("strong"), F.round(F.avg(v), 6).alias("mean"))
