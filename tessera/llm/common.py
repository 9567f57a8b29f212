"""Shared helpers of the training-data operators: reading tables, Arrow map stages, durable intermediate tables, names that
cannot clash, and joins that no hot key can stop."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows in an Arrow batch from the JVM. Documents can be a hundred KB each, so the default of 10,000 rows would be too many.
BATCH_ROWS = 512
#: Bytes that the JVM puts into an Arrow batch and that Python functions work on at once: batches that a single row or a join
#: has made larger are cut before they build arrays beside the text.
BATCH_BYTES = 4 << 20
#: Name in sys.modules of what a worker process holds from task to task (the word tables of token_output.encoder).
HELD = "_encoders_of_this_worker"
#: A key is hot if it has more rows than this and than 1 / HOT_SHARE of all; so at most HOT_SHARE keys are hot.
HOT_ROWS, HOT_SHARE = 10_000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share. Where it is unset, as in tests, one under the SQL
    warehouse, in local mode only: a cluster must name its shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/.stages"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to a shared folder and read it again: lineage is cut there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the folders of stored tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_stored", None)
        jvm = getattr(df.sparkSession, "_jvm", None) if path else None
        if jvm is not None:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of finished stages whose plans nothing refers to any more."""
    import gc

    gc.collect()
    if getattr(spark, "_jvm", None) is not None:  # a remote session has none; its server collects by itself
        spark._jvm.System.gc()


def slim(held: str = HELD) -> None:
    """Give back a worker's memory: what it holds for other stages, and what its allocators keep of finished tasks."""
    import ctypes

    sys.modules.pop(held, None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def _bounded(fn: Callable, most: int, holds: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = max(1, -(-b.nbytes // most))
                step = max(1, -(-b.num_rows // parts))
                for i in range(0, b.num_rows, step) or (0,):
                    yield b.slice(i, step)

        if not holds:
            slim()
        yield from fn(cut())
        if not holds:
            slim()

    return run


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, most: int = BATCH_BYTES, holds: bool = False) -> DataFrame:
    """df.mapInArrow with batches of bounded rows and bytes (of one row, if that row alone is larger). Stages share the workers of
    an executor: unless fn `holds` what HELD names, its tasks first give that back, and what they have used themselves."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(_bounded(fn, most, holds), schema)


def with_text(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the columns asked for, text last; extra columns of the input go no further."""
    return docs.select(*[F.col(c) for c in cols], F.col("text"))


def fields(docs: DataFrame, keep: list[str]) -> str:
    """keep's part of a schema string, with a comma after each."""
    return "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)


def kept(keep: list[str] | None, own: tuple[str, ...]) -> list[str]:
    """Columns to carry along: where a name is one of the operator's own results, the result takes its place."""
    return [k for k in (keep or ["doc_id"]) if k not in own]


def renamed(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column but `own` under a name that no operator uses, and the columns that give the old names back."""
    safe = {c: c if c in own else f"column_{i}_of_input" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in safe.items()]), [F.col(n).alias(c) for c, n in safe.items()]


def skew_join(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int, how: str = "inner", rows: int = HOT_ROWS) -> DataFrame:
    """left joined to right, which has one row a key and in `size` the number of left's rows of that key; total: rows of left. Keys
    that are hot, at most HOT_SHARE, are joined by broadcast, so that no task gets all rows of one; the rest as Spark likes. Both
    sides should be stored tables, as they are read twice."""
    bound = max(rows, total // HOT_SHARE)
    plain = right.drop(size)
    if total <= bound or not right.filter(F.col(size) > bound).limit(1).count():
        return left.join(plain, on, how)
    hot = right.filter(F.col(size) > bound).drop(size)
    few = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.filter(F.col(size) <= bound).drop(size), on, how)
    return few.unionByName(rest)
