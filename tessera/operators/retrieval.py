"""Retrieval over several fields and vectors: weighted field scores, soft boosts, fusion with exact cosines, conditional re-query,
precedent display and isolation of failing stores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import field_text, squeeze
from tessera.operators.lexical import best_fields, bm25, hybrid, top

#: Weights of the text fields, boosts, and the sizes of result lists.
FIELDS = {"answers_questions": 3.0, "title": 2.0, "heading_path": 1.5, "text": 1.0}
CATEGORY_BOOST, AGREEMENT_BOOST, AGREEMENT_CATEGORIES = 1.4, 1.6, ("payments", "account")
FLOOR, K, CANDIDATES, SHOWN, DEFAULT = 0.72, 5, 20, 5, "account"


def field_scores(chunks: DataFrame, queries: DataFrame, key: str, q: str, fields: dict[str, float] = FIELDS) -> DataFrame:
    """(q, key, score): BM25 of each field by its weight, combined as the best field with a share of the others. A field that
    does not match counts 0; lists are joined to one text."""
    lists = {c for c, kind in chunks.dtypes if kind.startswith("array")}
    each = [bm25(chunks.select(key, field_text(F.col(f), f in lists).alias("text")), queries, key, q).select(q, key, (F.col("score") * w).alias("s"), F.lit(f).alias("field")) for f, w in fields.items()]
    by = reduce(DataFrame.unionByName, each).groupBy(q, key).agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("s"))), F.lit(0.0)).alias(f"score_{i}") for i, f in enumerate(fields)])
    return by.select(q, key, best_fields([F.col(f"score_{i}") for i in range(len(fields))]).alias("score"))


def boosted(scores: DataFrame, chunks: DataFrame, queries: DataFrame, key: str, q: str) -> DataFrame:
    """M7: scores with a constant added for a passage of the query's category, and one for an agreement on the categories that it
    rules. Only passages that match in words have a score, so a boost never brings one in."""
    both = scores.join(chunks.select(key, F.col("category").alias("own"), "doc_type"), key).join(queries.select(q, F.col("category").alias("asked")), q)
    more = F.when(F.col("own") == F.col("asked"), CATEGORY_BOOST).otherwise(0.0) + F.when((F.col("doc_type") == "agreement") & F.col("asked").isin(*AGREEMENT_CATEGORIES), AGREEMENT_BOOST).otherwise(0.0)
    return both.select(q, key, (F.col("score") + F.coalesce(more, F.lit(0.0))).alias("score"))


def candidates(cosines: DataFrame, q: str, key: str, k: int = CANDIDATES) -> DataFrame:
    """The k nearest of each query, exactly."""
    return top(cosines, q, key, k, "cosine").drop("rank")


def fused(lexical: DataFrame, cosines: DataFrame, q: str, key: str, k: int = K, keep: int = 50) -> DataFrame:
    """The k best of each query in the order of the fused scores of lexical hits and vector candidates; each with its exact
    cosine, null if that is not among the query's `keep` best: not measured is not 0."""
    order = top(hybrid(lexical, candidates(cosines, q, key), q, key).drop("cosine"), q, key, k, "fused")
    return order.join(top(cosines, q, key, keep, "cosine").select(q, key, "cosine"), [q, key], "left")


def confidence(cosines: DataFrame, q: str, floor: float = FLOOR) -> DataFrame:
    """Best cosine of each query to 4 places and whether it reaches the floor as it is."""
    return cosines.groupBy(q).agg(F.max("cosine").alias("best")).select(q, F.round("best", 4).alias("best_cosine"), F.lit(floor).alias("min_sim"), (F.col("best") >= floor).alias("confident"))


def requery(first: DataFrame, retry: Callable[[DataFrame], DataFrame], q: str, floor: float = FLOOR) -> DataFrame:
    """Hits (q, ..., cosine), where queries whose best is under the floor are asked again. retry takes these queries' ids and gives
    hits of the same columns; they replace the first ones if their best is strictly better. Adds requeried and kept."""
    best = first.groupBy(q).agg(F.max("cosine").alias("best"))
    weak = best.filter(F.col("best") < floor)
    second = retry(weak.select(q))
    better = second.groupBy(q).agg(F.max("cosine").alias("again")).join(weak, q).filter(F.col("again") > F.col("best")).select(q)
    again = second.join(better, q, "left_semi").withColumns({"requeried": F.lit(True), "kept": F.lit("retry")})
    same = first.join(better, q, "left_anti").join(weak.select(q, F.lit(True).alias("requeried")), q, "left").withColumn("requeried", F.coalesce("requeried", F.lit(False)))
    return same.withColumn("kept", F.lit("original")).unionByName(again)


def summary(hits: DataFrame, q: str, key: str, shown: int = SHOWN) -> DataFrame:
    """Of each query the first hits as structs, without texts and vectors."""
    own = F.struct("rank", key, "cosine", "title", "category", "doc_type")
    return hits.filter(F.col("rank") <= shown).groupBy(q).agg(F.array_sort(F.collect_list(own)).alias("top"))


def voted(queries: DataFrame, votes: DataFrame, q: str, default: str = DEFAULT) -> DataFrame:
    """The label with most votes of each query; the default where it has no hits. votes: (q, label, votes)."""
    best = votes.groupBy(q).agg(F.max_by("label", F.struct(F.round("votes", 6), -F.ascii("label"))).alias("category"))
    return queries.select(q).join(best, q, "left").withColumn("category", F.coalesce("category", F.lit(default)))


def wording(x: Column) -> Column:
    """Texts that differ in case and white space alone are one wording."""
    return F.lower(squeeze(x))


def similar_shown(matches: DataFrame, q: str, similar: float = 0.80, same: float = 0.86, shown: int = SHOWN, fetch: int = 4) -> DataFrame:
    """Of each query's `fetch` * `shown` nearest earlier items the newest of each wording, by similarity; the last one sent
    for the same question is always among them, in front if it was not. Returns (q, place, id, cosine, is_last, same_question).
    matches: (q, id, text, cosine, created, sent). The lists are of bounded length, so each is one row."""
    near = top(matches, q, "id", fetch * shown, "cosine").filter(F.col("cosine") >= similar).withColumn("wording", wording(F.col("text")))
    last = near.filter((F.col("cosine") >= same) & F.col("sent")).groupBy(q).agg(F.max_by(F.struct("id", "wording"), F.struct("created", "id")).alias("last"))
    n_same = near.filter(F.col("cosine") >= same).groupBy(q).agg(F.count_distinct("wording").alias("same_question"))
    newest = near.groupBy(q, "wording").agg(F.max_by(F.struct("id", "cosine", "created"), F.struct("created", "cosine", "id")).alias("n")).select(q, "wording", "n.*")
    by = Window.partitionBy(q).orderBy(F.desc("cosine"), "id")
    listed = newest.join(last, q, "left").withColumn("i", F.row_number().over(by))
    has = F.coalesce(F.max((F.col("id") == F.col("last.id")) & (F.col("i") <= shown)).over(Window.partitionBy(q)), F.lit(False))
    listed = listed.withColumn("has", has).filter(F.col("has") | F.col("last").isNull() | (F.col("wording") != F.col("last.wording")))
    front = listed.filter(~F.col("has") & F.col("last").isNotNull()).select(q, F.col("last.id").alias("id")).distinct()
    alone = last.join(listed.select(q).distinct(), q, "left_anti").select(q, F.col("last.id").alias("id"))
    front = front.unionByName(alone).join(near.select(q, "id", "cosine"), [q, "id"]).withColumn("first", F.lit(0))
    rows = listed.select(q, "id", "cosine", F.lit(1).alias("first")).unionByName(front)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(q).orderBy("first", F.desc("cosine"), "id"))).filter(F.col("place") <= shown)
    return placed.join(last, q, "left").join(n_same, q, "left").select(q, "place", "id", "cosine", F.coalesce(F.col("id") == F.col("last.id"), F.lit(False)).alias("is_last"), F.coalesce("same_question", F.lit(0).cast("long")).alias("same_question"))


def isolated(queries: DataFrame, q: str, stage: Callable[[], DataFrame], empty: dict[str, Column]) -> DataFrame:
    """A stage's rows (one a query) with checked true. If the store behind it fails, every query gets `empty` with checked
    false and the reason: a decision goes on without it. The stage is tried on a row, so a store that cannot be read fails here."""
    try:
        rows = stage()
        rows.limit(1).collect()
    except Exception as e:  # noqa: BLE001  any failure of a store is recorded, none is passed on
        why = f"{type(e).__name__}: {str(e)[:160]}"
        return queries.select(q, F.lit(False).alias("checked"), F.lit(why).alias("reason"), *[c.alias(n) for n, c in empty.items()])
    known = queries.select(q).join(rows.select(q, *empty), q, "left")
    return known.select(q, F.lit(True).alias("checked"), F.lit(None).cast("string").alias("reason"), *[F.coalesce(F.col(n), c).alias(n) for n, c in empty.items()])
