"""Curation: stub and density filters with reject reasons, word windows, marker names, rank-and-cap selection, gap report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import words

MIN_CHARS, DENSITY, SIZE, STEP, LEAST = 1_500, 2.0, 220, 180, 25
CATEGORY_FLOOR, CATEGORY_CAP, CORPUS = 4, 12, 45


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(pattern))


def judge(docs: DataFrame, foreign: str, own: str, min_chars: int = MIN_CHARS, density: float = DENSITY) -> DataFrame:
    """Docs with hits, density (per 1,000 characters) and reason: stub, foreign or null (kept)."""
    chars = F.length(F.coalesce("text", F.lit("")))
    d = docs.withColumn("hits", count(F.col("text"), foreign)).withColumn("_own", count(F.col("text"), own))
    d = d.withColumn("_d", 1000.0 * F.col("hits") / F.greatest(chars, F.lit(1)))
    reason = F.when(chars < min_chars, "stub").when((F.col("_d") >= density) & (F.col("hits") > F.col("_own")), "foreign")
    return d.withColumn("reason", reason).withColumn("density", F.round("_d", 2)).drop("_d", "_own")


def windows(docs: DataFrame, key: str, size: int = SIZE, step: int = STEP, least: int = LEAST) -> DataFrame:
    """Overlapping windows of words, (key, chunk, n_words, text); a window under `least` words falls away unless it is the first."""
    w = docs.select(key, words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / F.lit(step)), F.lit(0)).cast("int")
    cut = w.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).withColumn("part", F.slice("w", F.col("chunk") * step + 1, size))
    return cut.filter((F.size("part") >= least) | (F.col("chunk") == 0)).select(key, "chunk", F.size("part").alias("n_words"), F.concat_ws(" ", "part").alias("text"))


def markers(x: Column, patterns: dict[str, str]) -> Column:
    """names of the patterns that match, in their order."""
    return F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def rank_and_cap(docs: DataFrame, key: str, category: str, score: Column, pinned: Column, floor: int = CATEGORY_FLOOR, cap: int = CATEGORY_CAP, corpus: int = CORPUS) -> DataFrame:
    """Selection by (score desc, chars desc, key): every pinned one, the first `floor` of each category while it has fewer
    than `cap`, then category by category (in order of first appearance by chars) up to `cap` and the corpus limit. Returns the
    selected rows with `why`. Ranks are window functions; the corpus limit needs one running count over the candidates of the third
    step, of which a category gives at most `cap`."""
    rank = Window.partitionBy(category).orderBy(F.desc("_s"), F.desc("n_chars"), key)
    d = docs.withColumn("_s", score).withColumn("_p", pinned).withColumn("_r", F.row_number().over(rank))
    per = Window.partitionBy(category)
    d = d.withColumn("_np", F.count_if("_p").over(per)).withColumn("_first", F.max(F.struct("n_chars", (-F.col(key)).alias("k"))).over(per))
    # Of the first `floor`, those not pinned are taken in order while pinned and taken ones are fewer than the cap.
    free = F.sum(F.when(~F.col("_p") & (F.col("_r") <= floor), 1).otherwise(0)).over(rank)
    d = d.withColumn("_floor", ~F.col("_p") & (F.col("_r") <= floor) & (F.col("_np") + free <= cap))
    d = d.withColumn("_n2", F.count_if(F.col("_p") | F.col("_floor")).over(per))
    more = F.sum(F.when(~F.col("_p") & ~F.col("_floor"), 1).otherwise(0)).over(rank)
    d = d.withColumn("_fill", ~F.col("_p") & ~F.col("_floor") & (F.col("_n2") + more <= cap))
    base = d.agg(F.count_if(F.col("_p") | F.col("_floor")).alias("_base"))
    few = d.filter("_fill").join(F.broadcast(base)).withColumn("_i", F.row_number().over(Window.orderBy(F.desc("_first"), "_r"))).filter(F.col("_base") + F.col("_i") <= corpus)
    taken = few.select(key, F.lit("fill").alias("why")).unionByName(d.filter("_p").select(key, F.lit("pinned").alias("why"))).unionByName(d.filter("_floor").select(key, F.lit("floor").alias("why")))
    return docs.join(taken, key)


def gaps(docs: DataFrame, key: str, dictionary: dict[str, list[str]], least: int = 3, top: int = 4) -> DataFrame:
    """Category, n_docs with at least `least` different terms, and up to `top` keys with most terms; 0 marks a gap."""
    rows = docs.select(key, F.lower("text").alias("t")).select(key, F.explode(F.create_map(*[x for c, terms in sorted(dictionary.items()) for x in (F.lit(c), F.size(F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains("t", w))))])).alias("category", "n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), key)
    good = rows.filter(F.col("n") >= least).withColumn("i", F.row_number().over(w))
    found = good.groupBy("category").agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_list(F.when(F.col("i") <= top, F.struct("i", key)))).alias("k"))
    all_ = docs.sparkSession.createDataFrame([(c,) for c in dictionary], "category string")
    return all_.join(found, "category", "left").select("category", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), F.coalesce(F.concat_ws(",", F.transform("k", lambda x: x[key].cast("string"))), F.lit("")).alias("best"))
