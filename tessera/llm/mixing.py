"""Mixing sources to target weights by Poisson replication.

Every document gets a count from a Poisson distribution whose mean is its source's target repetition rate, by inverting
the distribution at a uniform number hashed from (seed, doc_id). The document is exploded into that many copies and the
copies are shuffled globally by a hash of (seed, doc_id, copy): a range-partitioned sort, so the order can be made again.

Rate of a source = share of the target * total mass / the source's mass * epochs; mass is characters. Without given weights
the target is proportional to mass ** `power`. Rates above `PIECE` are split into pieces, each with its own hash, as sums
of Poisson counts are Poisson; so exp(-rate) never underflows.

Rates are a table with a row a source. Up to `FEW` they are broadcast. Beyond, those of hot sources still are, so that no task
gets all rows of one, and the others are joined by shuffle.

Edge cases: a null source is a source of its own; null and empty texts have mass 0 but keep their source's rate; a source
without mass gets rate `epochs`; a source without a given weight is left out; a null doc_id is stood in for by a hash of the
text; rows that repeat a doc_id (or a null one and a text) get the same count each; an empty table gives no rows; extra
columns go along, and where one is named rate, copy or mix_key the result takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import renamed, skew_join, store, table

SEED, POWER, EPOCHS, PIECE, STEPS = 17, 0.5, 1.0, 8.0, 64
#: Sources up to which their rates are broadcast.
FEW = 50_000


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, epochs: float = EPOCHS) -> DataFrame:
    """source, n_docs, mass, rate."""
    by = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("mass"))
    if weights is None:
        by = by.withColumn("_w", F.pow(F.col("mass").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_s string, _w double")
        by = by.join(given, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    total = by.agg(F.sum("mass").alias("_m"), F.sum("_w").alias("_ws"))
    rate = F.when((F.col("mass") > 0) & (F.col("_ws") > 0), F.col("_w") / F.col("_ws") * F.col("_m") / F.col("mass") * epochs).otherwise(epochs)
    return by.join(F.broadcast(total)).select("source", "n_docs", "mass", rate.alias("rate"))  # one row


def cdf(mean: Column, steps: int = STEPS) -> Column:
    """P(X <= k) for k = 0 .. steps of a Poisson distribution."""
    first = F.exp(-mean)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(first.alias("p"), F.array(first).alias("all")),
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + acc["p"] * mean / k)).alias("all")),
    )
    return grown["all"]


def _copies(docs: DataFrame, few: int = FEW, seed: int = SEED, **params) -> tuple[DataFrame, list[Column]]:
    """One row a copy with rate, copy, mix_key and doc_key, and the columns that give docs' own back."""
    safe, back = renamed(docs, "doc_id", "text", "source")
    by = rates(safe, **params).select("source", "n_docs", "rate", F.ceil(F.col("rate") / PIECE).cast("int").alias("pieces"))
    by = store(by.withColumn("steps", cdf(F.col("rate") / F.greatest(F.col("pieces"), F.lit(1)))))
    by = by.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("source_key"), "n_docs", "rate", "pieces", "steps")
    safe = safe.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    if by.count() <= few:
        joined = safe.join(F.broadcast(by.drop("n_docs")), "source_key")
    else:
        total = by.agg(F.sum("n_docs")).first()[0]
        joined = skew_join(safe, by, ["source_key"], "n_docs", total)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    numbers = F.when(F.col("pieces") > 0, F.sequence(F.lit(1), F.col("pieces"))).otherwise(F.array().cast("array<int>"))
    reached = lambda u: F.size(F.filter(F.col("steps"), lambda c: c <= u))
    one = lambda j: F.transform(F.array(uniform(F.lit(str(seed)), doc, j.cast("string"))), reached)[0]  # noqa: E731  hashed once a piece
    out = joined.withColumn("n_copies", F.aggregate(numbers, F.lit(0), lambda acc, j: acc + one(j))).filter("n_copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), doc, F.col("copy").cast("string")))), back


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, **params) -> DataFrame:
    """docs with rate, copy (1 ..) and mix_key, one row a copy; not yet in order. Parameters: power, epochs, seed, few."""
    out, back = _copies(docs, weights=weights, **params)
    own = [c for c, name in zip(back, docs.columns, strict=True) if name not in ("rate", "copy", "mix_key")]
    return out.select(*own, "rate", "copy", "mix_key")


def mix(docs: DataFrame, **params) -> DataFrame:
    """replicate(), globally shuffled."""
    return replicate(docs, **params).orderBy("mix_key", "doc_id", "copy")


def mixture(docs: DataFrame, **params) -> DataFrame:
    """The mixture in its order with docs' own columns alone, whatever their names."""
    out, back = _copies(docs, **params)
    return out.orderBy("mix_key", "doc_id", "copy").select(*back)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy in the mixture of documents, in its order."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "mix_key")


OP8_SQL = f"""
WITH RECURSIVE mass AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS m FROM documents GROUP BY source),
tot AS (SELECT sum(m) AS mm, sum(pow(m::DOUBLE, {POWER})) AS ws FROM mass),
rate AS (SELECT source, CASE WHEN m > 0 AND ws > 0 THEN pow(m::DOUBLE, {POWER}) / ws * mm / m * {EPOCHS} ELSE {EPOCHS} END AS r FROM mass, tot),
piece AS (SELECT source, ceil(r / {PIECE})::INT AS n, r / greatest(ceil(r / {PIECE}), 1) AS l FROM rate),
cdf AS (SELECT source, l, 0 AS k, exp(-l) AS p, exp(-l) AS c FROM piece
  UNION ALL SELECT source, l, k + 1, p * l / (k + 1), c + p * l / (k + 1) FROM cdf WHERE k < {STEPS}),
u AS (SELECT d.r, d.doc_id, d.text, d.source, ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) || ':' || j), 1, 13))::BIGINT / {float(1 << 52)} AS u
  FROM (SELECT r, doc_id, text, d.source, unnest(generate_series(1, n)) AS j FROM (SELECT *, row_number() OVER () AS r FROM documents) d JOIN piece ON d.source IS NOT DISTINCT FROM piece.source) d),
n AS (SELECT r, u.doc_id, any_value(text) AS text, u.source, count(*) AS n FROM u JOIN cdf ON cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u GROUP BY r, u.doc_id, u.source)
SELECT doc_id, source, copy, md5('order{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':' || copy) AS mix_key
FROM (SELECT doc_id, text, source, unnest(generate_series(1, n))::INT AS copy FROM n)
"""
