"""Evaluation, drift and consistency reports, gap classification, queue listing, replay and backfill of a trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

USABLE, STRONG, MOVED, RANKS = 0.70, 0.75, 0.15, 200


def baseline(cosines: DataFrame, q: str, key: str, ranks: int = RANKS) -> DataFrame:
    """1-based rank of the `ranks` nearest passages of each query."""
    w = Window.partitionBy(q).orderBy(F.desc(F.round("cosine", 6)), key)
    return cosines.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= ranks)


def compare(base: DataFrame, live: DataFrame, q: str, key: str, usable: float = USABLE, deep: int = 5) -> DataFrame:
    """A row a query: base_best, live_best (first measured cosine of the live list), live_key, its rank in the baseline, error
    (difference of the best cosines), rescued (a usable first hit that the baseline had below `deep`) and regressed (usable before,
    not now). base: (q, key, cosine, rank); live: (q, key, rank, cosine or null)."""
    best = base.groupBy(q).agg(F.max("cosine").alias("base_best"))
    first = live.filter("rank = 1").select(q, F.col(key).alias("live_key"), F.col("cosine").alias("first_cosine"))
    measured = live.filter("cosine is not null").groupBy(q).agg(F.min_by("cosine", "rank").alias("live_best"), F.max("cosine").alias("live_max"))
    rows = best.join(first, q, "left").join(measured, q, "left").join(base.select(q, F.col(key).alias("live_key"), F.col("rank").alias("base_rank")), [q, "live_key"], "left")
    now = F.coalesce("live_best", F.lit(0.0))
    return rows.select(
        q, "base_best", now.alias("live_best"), "live_key", "base_rank", F.abs(F.coalesce("live_max", F.lit(0.0)) - F.col("base_best")).alias("error"),
        F.coalesce((F.col("base_rank") > deep) & (F.coalesce("first_cosine", F.lit(0.0)) >= usable), F.lit(False)).alias("rescued"), (F.col("live_key").isNotNull() & (F.col("base_best") >= usable) & (now < usable)).alias("regressed"),
    )


def report(rows: DataFrame, usable: float = USABLE, strong: float = STRONG, tolerance: float = 0.01) -> DataFrame:
    """One row over compare()'s."""
    live, base = F.col("live_best"), F.col("base_best")
    return rows.agg(F.count("*").alias("n"), F.count_if(base >= usable).alias("base_usable"), F.count_if(live >= usable).alias("live_usable"), F.count_if(live >= strong).alias("live_strong"), F.avg(live).alias("live_mean"), F.count_if("rescued").alias("rescues"), F.count_if("regressed").alias("regressions"), (F.max("error") <= tolerance).alias("faithful"))


def weakest(rows: DataFrame, q: str, score: str, k: int = 8) -> DataFrame:
    """The k queries of least score."""
    return rows.orderBy(score, q).limit(k)


def drift(before: DataFrame, after: DataFrame, key: str, score: str, moved: float = MOVED) -> DataFrame:
    """Mean, median and least of the scores after a change of model, and how many moved by more than `moved`."""
    both = after.select(key, F.col(score).alias("now")).join(before.select(key, F.col(score).alias("was")), key, "left")
    return both.agg(F.avg("now").alias("mean"), F.median("now").alias("median"), F.min("now").alias("least"), F.count_if(F.abs(F.col("now") - F.col("was")) > moved).alias("moved"))


def preflight(chunks: DataFrame, key: str, vector: str, declared: list[str], dim: int, required: dict[str, int]) -> DataFrame:
    """(check, ok, detail), a row a check: fields declared, one dimension and the one that thresholds were set for, ids
    there and unique, vectors of length 1, and coverage: at least so many rows with a value of each column of `required`."""
    undeclared = sorted(set(chunks.columns) - set(declared))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    one = chunks.agg(
        F.count("*").alias("n"), F.count(key).alias("ids"), F.count_distinct(key).alias("different"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"),
        F.count_if(F.abs(length - 1) > 1e-3).alias("off"), *[F.count(c).alias(f"has_{i}") for i, c in enumerate(required)],
    )
    n = F.col
    checks = [
        ("fields_declared", F.lit(not undeclared), F.lit(",".join(undeclared))),
        ("one_dimension", n("low").eqNullSafe(n("high")), F.concat_ws("..", "low", "high")),
        ("calibrated_dimension", F.coalesce((n("low") == dim) & (n("high") == dim), F.lit(False)), F.concat_ws(" for ", n("high"), F.lit(dim))),
        ("ids_present", n("ids") == n("n"), (n("n") - n("ids")).cast("string")),
        ("ids_unique", n("different") == n("ids"), (n("ids") - n("different")).cast("string")),
        ("unit_vectors", n("off") == 0, n("off").cast("string")),
        *[(f"coverage_{c}", n(f"has_{i}") >= least, n(f"has_{i}").cast("string")) for i, (c, least) in enumerate(required.items())],
    ]
    made = F.array(*[F.struct(F.lit(name).alias("check"), ok.alias("ok"), F.coalesce(detail, F.lit("")).alias("detail")) for name, ok, detail in checks])
    return one.select(F.explode(made).alias("c")).select("c.*")


def coverage_row(rows: DataFrame, topics: Column, month: Column) -> DataFrame:
    """Runs with gap, reasons and subject. A run is a gap if knowledge failed it: no page near enough, none with a link, or
    a draft not tied to the passage; an escalation for another reason is none. Subject: the first topic, else the category."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("confident"), "no page matched closely enough"),
        F.when(~F.col("has_citation"), "nothing retrieved carried a source link"),
        F.when(~F.col("quotes_policy"), "the draft could not be tied to the passage"),
    ))
    first = F.try_element_at(F.array_sort(topics), F.lit(1))
    return rows.withColumn("reasons", reasons).withColumn("gap", F.size("reasons") > 0).withColumn("subject", F.coalesce(first, F.col("category"))).withColumn("month", month)


def queue(rows: DataFrame, key: str, created: str, seq: str) -> DataFrame:
    """The last META row of each ticket: of the greatest creation time, of equal ones the later written; newest first."""
    meta = rows.filter("sk = 'META'")
    rest = [c for c in meta.columns if c != key]
    last = meta.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(created, seq)).alias("r")).select(key, "r.*")
    return last.orderBy(F.desc(created), key)


def replay(rows: DataFrame, pk: str, seq: str) -> DataFrame:
    """One ticket's rows in order, the last written of each sort key."""
    own = rows.filter(F.col("pk") == pk)
    rest = [c for c in own.columns if c != "sk"]
    return own.groupBy("sk").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select("sk", "r.*").orderBy("sk")


def backfill(metas: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """Precedents from a trail. metas: key, text, created_ms, category, decision, status; steps: key, step, kept, top_id,
    top_title, citation, draft. Complete and decided tickets only. The passage is the re-query's first if that was kept, else the
    retrieval's; the citation is cut at its last dash into path and link."""
    step = lambda name, c: F.max(F.when(F.col("step") == name, F.col(c)))
    by = steps.groupBy(key).agg(step("requery", "kept").alias("kept"), step("requery", "top_id").alias("id2"), step("requery", "top_title").alias("title2"), step("retrieve", "top_id").alias("id1"), step("retrieve", "top_title").alias("title1"), step("draft", "citation").alias("cite"), step("draft", "draft").alias("draft"))
    done = metas.filter("status = 'complete' and decision is not null").join(by, key, "left")
    again = (F.col("kept") == "retry") & F.col("id2").isNotNull()
    chunk, cite, dash = F.when(again, F.col("id2")).otherwise(F.col("id1")), F.coalesce("cite", F.lit("")), " — "
    linked = F.contains(cite, F.lit(dash))
    link = F.when(linked, F.substring_index(cite, dash, -1)).otherwise("")
    path = F.when(linked, F.regexp_replace(cite, r" — (?!.* — ).*$", "")).when(cite.endswith("[no source URL]"), "").otherwise(cite)
    return done.select(
        key, "text", "created_ms", "category", "decision", (F.col("decision") == "AUTO_SEND").alias("sent"), F.nullif(F.substring_index(chunk, "#", 1), F.lit("")).alias("doc_id"),
        F.coalesce(F.when(again, F.col("title2")).otherwise(F.col("title1")), F.lit("")).alias("policy_title"), F.when(chunk.isNull(), "").otherwise(path).alias("policy_path"),
        F.when(chunk.isNull(), "").otherwise(link).alias("policy_url"), F.coalesce("draft", F.lit("")).alias("draft"),
    )


def audit(limits: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Limits with found: whether the passage named by key holds the quote, white space and case aside; false if it is not there."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    both = limits.join(chunks.select(key, F.col("text").alias("passage")), key, "left")
    return both.withColumn("found", F.coalesce(F.contains(plain("passage"), plain("quote")), F.lit(False))).drop("passage")
