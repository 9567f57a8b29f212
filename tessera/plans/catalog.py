"""Registered queries over the star-schema, event and text tables, each with the SQL that gives the same rows.

Domain dictionaries are parameters of the operators; here they hold words that occur in these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as tx
from tessera.operators import acquisition, chunking, curation, decision, evaluation, facts, lexical, retrieval, selection, trail, vectors
from tessera.sources import html

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _searched(spark, d, k=5):
    e = t(spark, d, "embeddings")
    asked = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q"), "embedding")  # a search's stated queries
    return vectors.similar(e.withColumnRenamed("vec_id", "id"), asked, k), e


UNIT = "unit AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9)) AS v FROM embeddings)"
SEARCH = f"""{UNIT}, sims AS (SELECT a.vec_id AS q, b.vec_id AS id, b.label, list_dot_product(a.v, b.v) AS cosine FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 6) DESC, id) AS rank FROM sims) WHERE rank <= 5)"""


@query(f"WITH {SEARCH} SELECT q, id, rank::INT AS rank, round(cosine, 4) AS cosine FROM hits")
def topk_cosine(spark, d):
    """The five nearest vectors of every twentieth."""
    return _searched(spark, d)[0].select("q", "id", "rank", F.round("cosine", 4).alias("cosine"))


@query(f"""WITH {SEARCH}, v AS (SELECT q, label, sum(cosine) AS votes FROM hits GROUP BY q, label),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(votes, 6) DESC, label) AS i FROM v) WHERE i = 1), c AS (SELECT q, max(cosine) AS best FROM hits GROUP BY q)
SELECT q, label, round(votes, 3) AS votes, round(best, 4) AS best_cosine, best >= 0.35 AS confident FROM w JOIN c USING (q)""")
def vote_classify(spark, d):
    """Label by the summed cosines of the five nearest, and whether the best reaches the floor."""
    hits, e = _searched(spark, d)
    hits = hits.join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    best = hits.groupBy("q").agg(F.max("cosine").alias("best"))
    return vectors.vote(hits).join(best, "q").select("q", "label", F.round("votes", 3).alias("votes"), F.round("best", 4).alias("best_cosine"), (F.col("best") >= 0.35).alias("confident"))


@query(f"""WITH {UNIT}, s AS (SELECT label, i - 1 AS dim, sum(v[i]) AS x FROM unit, generate_series(1, 64) g(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM s GROUP BY label)
SELECT label, dim::INT AS dim, round(x / (n + 1e-9), 5) AS value FROM s JOIN n USING (label)""")
def label_centroids(spark, d):
    """A4: normalised sum of the vectors of each label."""
    return vectors.centroids(t(spark, d, "embeddings"), "label").select("label", "dim", F.round("value", 5).alias("value"))


@query(f"""WITH {UNIT}, b AS (SELECT a.vec_id, max(list_dot_product(a.v, b.v)) AS c FROM unit a JOIN unit b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)
SELECT round(quantile_cont(c, 0.5), 4) AS p50, round(quantile_cont(c, 0.9), 4) AS p90, round(max(c), 4) AS top FROM b""")
def nn_similarity_percentiles(spark, d):
    """Percentiles of the similarity to the nearest neighbour, over all vectors."""
    c = vectors.nearest(t(spark, d, "embeddings").withColumnRenamed("vec_id", "id"))
    return c.agg(F.round(F.percentile("cosine", 0.5), 4).alias("p50"), F.round(F.percentile("cosine", 0.9), 4).alias("p90"), F.round(F.max("cosine"), 4).alias("top"))


@query(f"""WITH {UNIT}, s AS (SELECT c.vec_id AS chunk, q.vec_id AS q, q.label, list_dot_product(c.v, q.v) AS cosine FROM unit c JOIN unit q ON c.vec_id <> q.vec_id AND q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY round(cosine, 6) DESC, q) AS i FROM s WHERE cosine >= 0.2)
SELECT chunk, string_agg(q, ',' ORDER BY i) AS answers, array_to_string(list_sort(list_distinct(list(label))), ',') AS categories, round(max(cosine), 4) AS best FROM r WHERE i <= 6 GROUP BY chunk""")
def top6_answers(spark, d):
    """A2, A3: for each vector the six best queries above the floor and their labels."""
    e = t(spark, d, "embeddings")
    asked = e.filter(F.col("vec_id") % 20 == 0)
    s = vectors.similar(e.withColumnRenamed("vec_id", "id"), asked.select(F.col("vec_id").alias("q"), "embedding"), None, 0.2)
    s = s.select(F.col("id").alias("chunk"), "q", "cosine")
    r = lexical.top(s, "chunk", "q", 6, "cosine").join(asked.select(F.col("vec_id").alias("q"), "label"), "q")
    by = F.array_sort(F.collect_list(F.struct("rank", "q")))
    return r.groupBy("chunk").agg(F.concat_ws(",", F.transform(by, lambda x: x["q"].cast("string"))).alias("answers"), F.concat_ws(",", F.transform(F.array_sort(F.collect_set("label")), lambda x: x.cast("string"))).alias("categories"), F.round(F.max("cosine"), 4).alias("best"))


@query()
def greedy_dedupe(spark, d):
    """Vectors by id, each kept unless near an earlier kept one. SQL needs recursion over all rows; a test has it."""
    e = t(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    pairs = vectors.similar(e, e.select(F.col("id").alias("q"), "embedding"), None, 0.40, later=True)
    return vectors.greedy_keep(e.select("id", F.col("id").alias("rank"), "label"), pairs).select("id", "label")


@query(f"""WITH {UNIT}, s AS (SELECT a.vec_id AS q, b.vec_id AS id, a.label AS q_doc, b.label AS doc, list_dot_product(a.v, b.v) AS c FROM unit a JOIN unit b ON b.vec_id < a.vec_id WHERE a.vec_id % 20 = 0),
g AS (SELECT q, q_doc, count(*) AS n_similar, max(id) FILTER (c >= 0.35 AND id % 3 > 0) AS last_sent FROM s WHERE c >= 0.25 GROUP BY q, q_doc)
SELECT q, n_similar, coalesce(last_sent, -1) AS last_sent, last_sent IS NOT NULL AND l.label <> q_doc AS conflict FROM g LEFT JOIN embeddings l ON l.vec_id = last_sent""")
def precedent_assess(spark, d):
    """Earlier similar vectors, the last one sent of the same question, and whether its document differs."""
    e = t(spark, d, "embeddings")
    asked = e.filter(F.col("vec_id") % 20 == 0)
    hits = vectors.similar(e.withColumnRenamed("vec_id", "id"), asked.select(F.col("vec_id").alias("q"), "embedding"), None, 0.25).filter("id < q")
    hits = hits.join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("doc")), "id").join(asked.select(F.col("vec_id").alias("q"), F.col("label").alias("q_doc")), "q")
    return decision.precedents(hits.withColumn("sent", F.col("id") % 3 > 0).withColumn("created", F.col("id")), 0.25, 0.35).withColumn("last_sent", F.coalesce("last_sent", F.lit(-1).cast("long")))


TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
BM25 = f"""tk AS (SELECT doc_id, {TOK} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM tk),
p AS (SELECT doc_id, len, term, count(*) AS f FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tk) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)"""


@query(f"WITH {BM25} SELECT item_id, doc_id, rank::INT AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) WHERE rank <= 5")
def bm25_topk(spark, d):
    """The five best documents of each benchmark item."""
    s = lexical.bm25(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "item_id")
    return lexical.top(s, "item_id", "doc_id", 5).select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH {BM25}, l AS (SELECT item_id, len({TOK}) AS n FROM benchmark), c AS (SELECT item_id, doc_id, score, CASE WHEN p.len > 0 THEN least(l.n, p.len) / greatest(l.n, p.len)::DOUBLE END AS cosine FROM sc JOIN (SELECT doc_id, len(t) AS len FROM tk) p USING (doc_id) JOIN l USING (item_id)),
m AS (SELECT *, min(score) OVER w AS a, max(score) OVER w AS b, min(cosine) OVER w AS x, max(cosine) OVER w AS y FROM c WINDOW w AS (PARTITION BY item_id)),
f AS (SELECT item_id, doc_id, 0.4 * CASE WHEN b - a < 1e-9 THEN 0 ELSE (score - a) / (b - a) END + 0.6 * CASE WHEN y - x < 1e-9 THEN 0 ELSE (cosine - x) / (y - x) END AS fused FROM m)
SELECT item_id, doc_id, round(fused, 4) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(fused, 6) DESC, doc_id) AS i FROM f) WHERE i <= 3""")
def hybrid_fusion(spark, d):
    """BM25 fused with a second score (here the likeness of lengths, as texts have no vectors)."""
    docs, bench = t(spark, d, "documents"), t(spark, d, "benchmark")
    s = lexical.bm25(docs, bench, "doc_id", "item_id")
    size = lambda df, k, n: df.select(k, F.size(tx.tokens(F.col("text"))).alias(n))
    v = s.join(size(docs, "doc_id", "a"), "doc_id").join(size(bench, "item_id", "b"), "item_id").select("item_id", "doc_id", (F.least("a", "b") / F.greatest("a", "b")).alias("cosine"))
    return lexical.top(lexical.hybrid(s, v, "item_id", "doc_id"), "item_id", "doc_id", 3, "fused").select("item_id", "doc_id", F.round("fused", 4).alias("fused"))


SYNONYMS, STOP = {"the": ["that", "this"], "der": ["die", "das"], "les": ["des"], "erst": ["first"]}, ["the", "and", "of"]


@query(f"WITH w AS (SELECT item_id, {TOK} AS t FROM benchmark), m(k, s, n) AS (VALUES ('der', 'die', 1), ('der', 'das', 2), ('les', 'des', 1), ('erst', 'first', 1)), h AS (SELECT item_id, t, s, min(list_position(t, k) * 10 + n) AS o FROM w JOIN m ON list_contains(t, k) AND NOT list_contains(t, s) GROUP BY ALL) SELECT item_id, coalesce(string_agg(s, ',' ORDER BY o), '') AS added FROM w LEFT JOIN h USING (item_id) GROUP BY item_id")
def synonym_expand(spark, d):
    """Terms that synonyms add to a query."""
    return t(spark, d, "benchmark").select("item_id", F.concat_ws(",", lexical.expand(tx.tokens(F.col("text")), SYNONYMS, STOP)).alias("added"))


FOREIGN, OWN = r"\b(der|die|und|les|des|que)\b", r"\b(the|and|of)\b"


def _count_sql(p):
    return f"len(regexp_extract_all(coalesce(text, ''), '{p}'))"


# Words of these tables' own language end at non-ASCII letters for RE2 but not for Java, so plain spaces mark them here.
SP_FOREIGN, SP_OWN = " (der|die|und|les|des|que) ", " (the|and|of) "
JUDGE = f"""j AS (SELECT *, {_count_sql(SP_FOREIGN)} AS hits, {_count_sql(SP_OWN)} AS own, length(coalesce(text, '')) AS chars FROM documents),
r AS (SELECT *, round(1000.0 * hits / greatest(chars, 1), 2)::DOUBLE AS density, CASE WHEN chars < 1500 THEN 'stub' WHEN 1000.0 * hits / greatest(chars, 1) >= 2.0 AND hits > own THEN 'foreign' END AS reason FROM j)"""


@query(f"WITH {JUDGE} SELECT doc_id, hits::INT AS hits, reason FROM r")
def density_filter(spark, d):
    """Stubs and texts dense in foreign words."""
    return curation.judge(t(spark, d, "documents"), SP_FOREIGN, SP_OWN).select("doc_id", "hits", "reason")


@query(f"WITH {JUDGE} SELECT coalesce(reason, 'kept') AS reason, source, count(*) AS n FROM r GROUP BY ALL")
def reject_reasons(spark, d):
    """Rejects by reason and source."""
    return curation.judge(t(spark, d, "documents"), SP_FOREIGN, SP_OWN).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "source").agg(F.count("*").alias("n"))


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), c AS (SELECT doc_id, unnest(generate_series(0, greatest(ceil((len(w) - 220) / 180.0), 0)::INT)) AS chunk, w FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, chunk, w[chunk * 180 + 1:chunk * 180 + 220] AS p FROM c) SELECT doc_id, chunk::INT AS chunk, len(p)::INT AS n_words, md5(array_to_string(p, ' ')) AS digest FROM p WHERE len(p) >= 25 OR chunk = 0""")
def sliding_word_chunks(spark, d):
    """Windows of 220 words, 180 apart."""
    return curation.windows(t(spark, d, "documents"), "doc_id").select("doc_id", "chunk", "n_words", F.md5("text").alias("digest"))


@query(r"WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents) SELECT doc_id, len(list_filter(s, lambda x: x <> ''))::INT AS n, md5(array_to_string(list_filter(s, lambda x: x <> ''), '|')) AS digest FROM s")
def sentence_split(spark, d):
    """sentences, without rejoining, as these tables have no abbreviations."""
    return t(spark, d, "documents").select("doc_id", tx.sentences(F.coalesce("text", F.lit("")), ()).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.concat_ws("|", "s")).alias("digest"))


@query()
def pack_sentences(spark, d):
    """Passages of sentences with their ids. Folds; a test has the loop."""
    return chunking.numbered_passages(t(spark, d, "documents"), "doc_id").select("doc_id", "chunk", "chunk_id", "n_words", F.md5("text").alias("digest"))


@query("""WITH d AS (SELECT doc_id, source, n_chars, coalesce(quality, 0) AS s, coalesce(toxic, 0) = 1 AND n_chars > 3000 AS p FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, n_chars DESC, doc_id) AS r, count(*) FILTER (p) OVER (PARTITION BY source) AS np, first_value(n_chars) OVER g AS fc, first_value(doc_id) OVER g AS fd FROM d WINDOW g AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)),
f AS (SELECT *, NOT p AND r <= 4 AND np + sum((NOT p AND r <= 4)::INT) OVER (PARTITION BY source ORDER BY r) <= 12 AS fl FROM r),
n AS (SELECT *, count(*) FILTER (p OR fl) OVER (PARTITION BY source) AS n2, sum((NOT p AND NOT fl)::INT) OVER (PARTITION BY source ORDER BY r) AS m FROM f),
fill AS (SELECT *, row_number() OVER (ORDER BY fc DESC, fd, r) AS i FROM n WHERE NOT p AND NOT fl AND n2 + m <= 12), b AS (SELECT count(*) AS b FROM n WHERE p OR fl)
SELECT doc_id, source, CASE WHEN p THEN 'pinned' ELSE 'floor' END AS why FROM n WHERE p OR fl UNION ALL SELECT doc_id, source, 'fill' FROM fill, b WHERE b + i <= 100""")
def rank_and_cap(spark, d):
    """Pinned documents, a floor a source, then filling up to caps."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    pinned = (F.coalesce("toxic", F.lit(0)) == 1) & (F.col("n_chars") > 3000)
    return curation.rank_and_cap(docs.select("doc_id", "source", "n_chars", "quality", "toxic"), "doc_id", "source", F.coalesce("quality", F.lit(0)), pinned, corpus=100).select("doc_id", "source", "why")


TERMS = {"english": ["ther", "ing", "that", "with"], "german": ["der ", "und ", "keit", "sch"], "french": ["eau", "les ", "oi", "que "], "none": ["zzz", "qqq", "xxxx"]}
GAP = " UNION ALL ".join(f"SELECT '{c}' AS category, doc_id, {' + '.join(f'contains(lower(text), {w!r})::INT' for w in ws)} AS n FROM documents" for c, ws in TERMS.items())


@query(f"""WITH n AS ({GAP}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, doc_id) AS i FROM n WHERE n >= 3), c(category) AS (VALUES {", ".join(f"('{c}')" for c in TERMS)})
SELECT category, count(doc_id) AS n_docs, coalesce(string_agg(doc_id, ',' ORDER BY i) FILTER (i <= 4), '') AS best FROM c LEFT JOIN r USING (category) GROUP BY category""")
def gap_report(spark, d):
    """Documents with at least three terms of each category; categories without any are gaps."""
    return curation.gaps(t(spark, d, "documents"), "doc_id", TERMS)


@query()
def html_extract(spark, d):
    """Heading-marked lines of pages. No SQL for parsing; a test has fixtures."""
    x = html.extract(t(spark, d, "pages"), "page_id")
    return x.select("page_id", F.size("lines").alias("n_lines"), F.md5(F.concat_ws("\n", "lines")).alias("digest"))


EDGES = """e AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"WITH {EDGES} SELECT page_id, href FROM e")
def link_edges(spark, d):
    """Links of each page."""
    return html.links(t(spark, d, "pages"), "page_id")


@query(f"""WITH {EDGES}, b AS (SELECT 'p' || page_id AS a, 'h' || href AS b FROM e UNION ALL SELECT 'h' || href, 'p' || page_id FROM e),
h1 AS (SELECT DISTINCT b AS node FROM b WHERE a = 'p0'), h2 AS (SELECT DISTINCT b.b AS node FROM b JOIN h1 ON b.a = h1.node WHERE b.b <> 'p0'), h3 AS (SELECT DISTINCT b.b AS node FROM b JOIN h2 ON b.a = h2.node WHERE b.b NOT IN (SELECT node FROM h1))
SELECT 'p0' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3""")
def link_bfs(spark, d):
    """Pages and links within three hops of page 0 over shared links."""
    e = html.links(t(spark, d, "pages"), "page_id").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("p"), F.concat(F.lit("h"), "href").alias("h"))
    both = e.select(F.col("p").alias("a"), F.col("h").alias("b")).unionByName(e.select(F.col("h").alias("a"), F.col("p").alias("b")))
    return html.reach(both, spark.createDataFrame([("p0",)], "node string"), 3)


TOPICS = {"greeting": ["hello", "the"], "from": ["from", "with"], "rare": ["idiot", "clown", "stupid"], "numbers": [r"\d+"]}


@query(r"""WITH m AS (SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_À-ÿ])(from|with)($|[^a-zA-Z0-9_À-ÿ])') THEN 'from' END,
CASE WHEN regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_À-ÿ])(hello|the)($|[^a-zA-Z0-9_À-ÿ])') THEN 'greeting' END, CASE WHEN regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_À-ÿ])([0-9]+)($|[^a-zA-Z0-9_À-ÿ])') THEN 'numbers' END,
CASE WHEN regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_À-ÿ])(idiot|clown|stupid)($|[^a-zA-Z0-9_À-ÿ])') THEN 'rare' END], lambda x: x IS NOT NULL) AS l FROM conversations)
SELECT conv_id, turn, array_to_string(l, ',') AS topics FROM m""")
def topics_extract(spark, d):
    """topics of each turn."""
    return t(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(",", tx.topics(F.coalesce("text", F.lit("")), TOPICS)).alias("topics"))


ASKING, REPORTING = ["und", "the", "que"], ["ist", "is", "est"]
EDGE = "[^a-zA-Z0-9_À-ÿß]"


def _any(words: list[str]) -> str:
    return f"regexp_matches(text, '(?i)(^|{EDGE})({'|'.join(words)})($|{EDGE})')"


@query(f"SELECT conv_id, turn, CASE WHEN {_any(ASKING)} AND NOT {_any(REPORTING)} THEN 'question' ELSE 'problem' END AS intent FROM conversations")
def intent_classify(spark, d):
    """question or problem, of every turn, by words that occur in them; a test has sentences."""
    return t(spark, d, "conversations").select("conv_id", "turn", tx.intent(F.coalesce("text", F.lit("")), ASKING, REPORTING).alias("intent"))


@query("SELECT doc_id, len(v)::INT AS n, round(coalesce(list_sum(list_transform(v, lambda x: x::DOUBLE)), 0), 6) AS total FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:%|percent)', 1) AS v FROM documents)")
def percent_readings(spark, d):
    """The number and the sum of the percentages of every document. F10, which gives each its metric, is metric_mentions."""
    v = t(spark, d, "documents").select("doc_id", tx.percents(F.coalesce("text", F.lit(""))).alias("v"))
    return v.select("doc_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query()
def metric_mentions(spark, d):
    """metric readings of every turn. No turn of these tables has a percentage, so they give no row; a test has sentences."""
    return facts.readings(t(spark, d, "conversations"), ["conv_id", "turn"], "text")


SCORE_LIMITS = (("return_rate", "selling", "max", 34.0), ("return_rate", "prime", "max", 30.0), ("early_rate", "selling", "min", 45.0), ("early_rate", "prime", "min", 55.0))
SCORES = """s AS (SELECT l_suppkey, 100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) AS return_rate, 100.0 * count(*) FILTER (l_shipdate < o_orderdate) / count(*) AS early_rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey),
r AS (SELECT l_suppkey, 'return_rate' AS metric, return_rate AS value FROM s UNION ALL SELECT l_suppkey, 'early_rate', early_rate FROM s), lim(metric, tier, kind, lim) AS (VALUES ('return_rate', 'selling', 'max', 34.0), ('return_rate', 'prime', 'max', 30.0), ('early_rate', 'selling', 'min', 45.0), ('early_rate', 'prime', 'min', 55.0)),
f AS (SELECT l_suppkey, r.metric, tier, round(value, 3) AS value, CASE WHEN kind = 'max' THEN CASE WHEN value >= lim THEN 'breach' WHEN value >= lim - 1 THEN 'close' ELSE 'meets' END ELSE CASE WHEN value < lim THEN 'breach' WHEN value < lim + 1 THEN 'close' ELSE 'meets' END END AS status FROM r JOIN lim USING (metric))"""


def _findings(spark, d):
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    s = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("l_suppkey").agg((100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("return_rate"), (100.0 * F.count_if(F.col("l_shipdate") < F.col("o_orderdate")) / F.count("*")).alias("early_rate"))
    readings = s.unpivot("l_suppkey", ["return_rate", "early_rate"], "metric", "value")
    return decision.assess(readings, spark.createDataFrame(list(SCORE_LIMITS), "metric string, tier string, kind string, limit double"))


@query(f"WITH {SCORES} SELECT l_suppkey, metric, tier, value, status FROM f")
def standing_findings(spark, d):
    """Supplier metrics against their limits."""
    return _findings(spark, d).select("l_suppkey", "metric", "tier", F.round("value", 3).alias("value"), "status")


@query(f"WITH {SCORES} SELECT l_suppkey, bool_or(status = 'breach' AND tier = 'selling') AS breach_selling, bool_or(status = 'breach' AND tier = 'prime') AS breach_prime, count(*) FILTER (status = 'close') AS n_close FROM f GROUP BY l_suppkey")
def standing_flags(spark, d):
    """Breach flags of each supplier. R8, from text, is facts.readings before the same steps; a test has it."""
    return decision.standing(_findings(spark, d), "l_suppkey")


@query("SELECT doc_id, item_id, true AS ok FROM documents d JOIN benchmark b ON length(b.text) >= 12 AND contains(d.text, b.text)")
def grounding_check(spark, d):
    """benchmark items that a document holds word for word, by one automaton of the items."""
    b = t(spark, d, "benchmark").filter(F.length("text") >= 12).select("item_id", F.col("text").alias("quote"))
    return decision.holding(t(spark, d, "documents"), b, "doc_id", "item_id").select("doc_id", "item_id", F.lit(True).alias("ok"))


def gate_states(spark: SparkSession) -> DataFrame:
    """20 topics (none and 19) x 3 confidences x 16 flags: a fixed space of 960 states."""
    topics = ["", *(x for ts in decision.GUARDED.values() for x in ts)]
    out = spark.createDataFrame([(x,) for x in topics], "topic string").withColumn("c", F.explode(F.array(*map(F.lit, ("0.7199", "0.7200", "0.9500")))))
    for name in ("has_citation", "quotes_policy", "conflict", "breach"):
        out = out.withColumn(name, F.explode(F.array(F.lit(True), F.lit(False))))
    return out.withColumn("confidence", F.col("c").cast("decimal(5,4)")).withColumn("topics", F.when(F.col("topic") == "", F.array().cast("array<string>")).otherwise(F.array("topic"))).drop("c")


_TOPIC_RULES = ", ".join(f"('{x}', '{r}')" for r, ts in decision.GUARDED.items() for x in ts)


@query(f"""WITH k(topic, rule) AS (VALUES ('', NULL), {_TOPIC_RULES}), c(confidence) AS (VALUES (0.7199::DECIMAL(5,4)), (0.72), (0.95)), b(x) AS (VALUES (true), (false)),
s AS (SELECT topic, rule, confidence, b1.x AS cit, b2.x AS quo, b3.x AS con, b4.x AS bre FROM k, c, b b1, b b2, b b3, b b4),
f AS (SELECT *, list_filter([rule, CASE WHEN confidence < 0.72 OR NOT cit OR NOT quo THEN 'F6' END, CASE WHEN con THEN 'F7' END, CASE WHEN bre THEN 'F8' END], lambda x: x IS NOT NULL) AS l FROM s)
SELECT topic, confidence::DOUBLE AS confidence, cit AS has_citation, quo AS quotes_policy, con AS conflict, bre AS breach, array_to_string(l, ',') AS blocked_by, CASE WHEN len(l) = 0 THEN 'AUTO_SEND' ELSE 'ESCALATE' END AS decision FROM f""")
def gate_exhaustive(spark, d):
    """The decision of every state."""
    return decision.decide(gate_states(spark)).select("topic", F.col("confidence").cast("double").alias("confidence"), "has_citation", "quotes_policy", "conflict", "breach", F.concat_ws(",", "blocked_by").alias("blocked_by"), "decision")


@query("SELECT conv_id, role, max(turn) AS turn, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id, role")
def trail_latest(spark, d):
    """The last turn of each role in a conversation."""
    return trail.latest(t(spark, d, "conversations").withColumn("seq", F.col("turn")), ["conv_id", "role"], "seq").select("conv_id", "role", "turn", F.md5("text").alias("digest"))


@query("SELECT event_id, user_id, coalesce(greatest(0, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0)::BIGINT AS ms FROM events")
def stage_latency(spark, d):
    """Ms between events of a user, 0 for the first."""
    x = trail.latencies(t(spark, d, "events"), "user_id", F.unix_millis(F.col("ts").cast("timestamp")), ["ts", "event_id"])
    return x.select("event_id", "user_id", "ms")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) AS held, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def queue_stats(spark, d):
    """Counts, share held and elapsed statistics."""
    v = F.col("value")
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v > 10).alias("held"), F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"))


def _runs(spark, d):
    e = t(spark, d, "events")
    return e.select(trail.month(F.col("ts")).alias("month"), F.col("event_type").alias("subject"), (F.get_json_object("props", "$.k").cast("int") % 4 == 0).alias("gap"), trail.sort_key("RUN#", F.col("event_id"), 13).alias("sk"), F.concat(F.lit("page "), (F.col("user_id") % 17).cast("string")).alias("title"))


RUNS = "r AS (SELECT strftime(ts, '%Y-%m') AS month, event_type AS subject, (props->>'$.k')::INT % 4 = 0 AS gap, 'RUN#' || lpad(event_id::VARCHAR, 13, '0') AS sk, 'page ' || (user_id % 17) AS title FROM events)"


@query(f"""WITH {RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY month, subject, gap ORDER BY sk) AS i FROM r)
SELECT month, subject, count(*) AS runs, count(*) FILTER (gap) AS gaps, round(count(*) FILTER (gap) / count(*)::DOUBLE, 4) AS gap_rate, coalesce(string_agg(sk, ',' ORDER BY sk) FILTER (gap AND i <= 3), '') AS examples FROM n GROUP BY month, subject""")
def coverage_month(spark, d):
    """Monthly coverage by subject."""
    return trail.coverage(_runs(spark, d))


@query(f"WITH {RUNS} SELECT title, count(*) AS n FROM r WHERE gap GROUP BY title ORDER BY n DESC, title LIMIT 5")
def nearest_pages(spark, d):
    """The five pages most often nearest to gaps."""
    return trail.nearest_pages(_runs(spark, d), "title")


@query(f"WITH {SEARCH}, b AS (SELECT q, max(cosine) AS cosine FROM hits GROUP BY q) SELECT label, count(*) AS n, count(*) FILTER (cosine >= 0.35) AS usable, count(*) FILTER (cosine >= 0.4) AS strong, round(avg(cosine), 6) AS mean FROM b JOIN embeddings ON vec_id = q GROUP BY label")
def eval_summary(spark, d):
    """Best similarity of the queries by label."""
    hits, e = _searched(spark, d, 1)
    return trail.evaluation(hits.join(e.select(F.col("vec_id").alias("q"), "label"), "q"), ["label"], "cosine", 0.35, 0.4)


@query("SELECT sha256(text)[:32] AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_fingerprint_dupes(spark, d):
    """Fingerprints that several documents share."""
    return t(spark, d, "documents").filter("text is not null").groupBy(F.substring(F.sha2("text", 256), 1, 32).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents")
def content_manifest(spark, d):
    """Fingerprint and size of every content."""
    return acquisition.manifest(t(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), c AS (SELECT doc_id, unnest(generate_series(0, greatest(ceil((len(w) - 220) / 180.0), 0)::INT)) AS chunk, w FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, chunk, len(w[chunk * 180 + 1:chunk * 180 + 220]) AS n FROM c) SELECT doc_id, chunk::INT AS chunk, row_number() OVER (ORDER BY doc_id, chunk) - 1 AS number FROM p WHERE n >= 25""")
def chunk_numbers(spark, d):
    """Chunks numbered on over all documents."""
    return chunking.number_all(curation.windows(t(spark, d, "documents"), "doc_id"), "doc_id", 25).select("doc_id", "chunk", F.col("number").cast("long").alias("number"))


@query(f"""WITH {UNIT}, s AS (SELECT c.label AS doc, c.vec_id AS chunk, q.vec_id AS q, list_dot_product(c.v, q.v) AS cosine FROM unit c JOIN unit q ON c.vec_id <> q.vec_id AND q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY cosine DESC, chunk, q) AS i FROM s) SELECT doc, chunk, q, round(cosine, 4) AS cosine, CASE WHEN cosine < 0.45 THEN 'not_relevant' END AS reason FROM r WHERE i = 1""")
def relevance_floor(spark, d):
    """A1, P5: the best passage and query of each document (here a label's vectors), and whether it reaches the floor."""
    e = t(spark, d, "embeddings")
    s = vectors.similar(e.withColumnRenamed("vec_id", "id"), e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q"), "embedding"), None)
    s = s.join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("doc")), "id").select("doc", F.col("id").alias("chunk"), "q", "cosine")
    return selection.relevant(selection.best_chunk(s, "doc", "chunk", "q"), 0.45).select("doc", "chunk", "q", F.round("cosine", 4).alias("cosine"), "reason")


@query(f"""WITH {SEARCH} SELECT q, id, rank::INT AS rank, round(cosine, 4) AS cosine FROM hits WHERE rank <= 3""")
def query_coverage(spark, d):
    """The three best passages of each query."""
    return selection.covering(_searched(spark, d)[0].drop("rank"), "q", "id").select("q", "id", "rank", F.round("cosine", 4).alias("cosine"))


@query(f"WITH {SEARCH} SELECT q, round(max(cosine), 4) AS best FROM hits GROUP BY q ORDER BY max(cosine), q LIMIT 8")
def weakest_queries(spark, d):
    """The eight queries of least best similarity."""
    best = _searched(spark, d, 1)[0].groupBy("q").agg(F.max("cosine").alias("best"))
    return evaluation.weakest(best, "q", "best").select("q", F.round("best", 4).alias("best"))


RETRY = """again AS (SELECT a.vec_id AS q, list_transform(list_zip(a.v, b.v), lambda x: x[1] + x[2]) AS w FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0),
normed AS (SELECT q, list_transform(w, lambda x: x / (sqrt(list_dot_product(w, w)) + 1e-9)) AS w FROM again),
second AS (SELECT * FROM (SELECT q, b.vec_id AS id, list_dot_product(w, b.v) AS cosine, row_number() OVER (PARTITION BY q ORDER BY round(list_dot_product(w, b.v), 6) DESC, b.vec_id) AS i FROM normed JOIN unit b ON b.vec_id <> q AND b.vec_id <> q + 1) WHERE i <= 5)"""


@query(f"""WITH {SEARCH}, {RETRY}, f AS (SELECT q, max(cosine) AS best FROM hits GROUP BY q), s AS (SELECT q, max(cosine) AS best FROM second GROUP BY q),
k AS (SELECT f.q, f.best < 0.45 AS requeried, f.best < 0.45 AND coalesce(s.best > f.best, false) AS kept FROM f LEFT JOIN s USING (q))
SELECT q, id, round(cosine, 4) AS cosine, requeried, 'original' AS kept FROM hits JOIN k USING (q) WHERE NOT k.kept UNION ALL SELECT q, id, round(cosine, 4), requeried, 'retry' FROM second JOIN k USING (q) WHERE k.kept""")
def requery_kept(spark, d):
    """Queries under the floor asked again, here with the sum of their vector and the next, and kept if that is better."""
    hits, e = _searched(spark, d)

    def retry(weak: DataFrame) -> DataFrame:
        own = e.join(weak, F.col("vec_id") == F.col("q"), "left_semi").select(F.col("vec_id").alias("q"), "embedding")
        two = own.join(e.select((F.col("vec_id") - 1).alias("q"), F.col("embedding").alias("next")), "q")
        asked = two.select("q", F.zip_with(vectors.normalised(F.col("embedding")), vectors.normalised(F.col("next")), lambda x, y: x + y).alias("embedding"))
        found = vectors.similar(e.withColumnRenamed("vec_id", "id"), asked, 6)
        return lexical.top(found.drop("rank").filter("id != q + 1"), "q", "id", 5, "cosine").select("q", "id", "cosine")

    return retrieval.requery(hits.select("q", "id", "cosine"), retry, "q", 0.45).select("q", "id", F.round("cosine", 4).alias("cosine"), "requeried", "kept")


@query("""WITH r AS (SELECT event_id, strftime(ts, '%Y-%m') AS month, event_type, list_filter([CASE WHEN value <= 3 THEN 'no page matched closely enough' END, CASE WHEN user_id % 5 = 0 THEN 'nothing retrieved carried a source link' END,
CASE WHEN event_id % 7 = 0 THEN 'the draft could not be tied to the passage' END], lambda x: x IS NOT NULL) AS l FROM events) SELECT event_id, month, event_type AS subject, len(l) > 0 AS gap, array_to_string(l, ';') AS reasons FROM r""")
def gap_classify(spark, d):
    """Which runs are gaps of knowledge, and why. Events stand for runs."""
    e = t(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("category"), (F.col("value") > 3).alias("confident"), (F.col("user_id") % 5 != 0).alias("has_citation"), (F.col("event_id") % 7 != 0).alias("quotes_policy"))
    return evaluation.coverage_row(e, F.array().cast("array<string>"), trail.month(F.col("ts"))).select("event_id", "month", "subject", "gap", F.concat_ws(";", "reasons").alias("reasons"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def queue_listing(spark, d):
    """The last state of each ticket, newest first. Events of a user stand for a ticket's rows."""
    e = t(spark, d, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("status"), F.lit("META").alias("sk"))
    return evaluation.queue(e, "user_id", "ts", "event_id").select("user_id", "event_id", "status")


@query(f"""WITH k(topic, rule) AS (VALUES ('', NULL), {_TOPIC_RULES}), c(confidence) AS (VALUES (0.7199::DECIMAL(5,4)), (0.72), (0.95)), b(x) AS (VALUES (true), (false)),
s AS (SELECT rule, confidence, b1.x AS cit, b2.x AS quo, b3.x AS con, b4.x AS bre FROM k, c, b b1, b b2, b b3, b b4),
f AS (SELECT unnest(list_filter([rule, CASE WHEN confidence < 0.72 OR NOT cit OR NOT quo THEN 'F6' END, CASE WHEN con THEN 'F7' END, CASE WHEN bre THEN 'F8' END], lambda x: x IS NOT NULL)) AS rule FROM s)
SELECT rule, count(*) AS n, CASE WHEN rule IN ('F6', 'F7') THEN 'why ' || rule ELSE '' END AS reason FROM f GROUP BY rule""")
def gate_provenance(spark, d):
    """How often each rule blocks over all states, with why it exists."""
    from tessera.operators import policies

    known = spark.createDataFrame([("F6", "forbid", "why F6", "", "", "", "", ""), ("F7", "forbid", "why F7", "", "", "", "", ""), ("P1", "permit", "x", "", "", "", "", "")], ", ".join(f"{c} string" for c in ("rule", "effect", *policies.NOTES)))
    states = decision.decide(gate_states(spark)).withColumn("id", F.monotonically_increasing_id())
    return policies.provenance(states, "id", known).groupBy("rule", "reason").agg(F.count("*").alias("n")).select("rule", "n", "reason")
