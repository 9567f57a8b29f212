"""URL filters by a temporal list join, in DataFrame expressions only.

A list's dated events (list, kind, key, action, at) become validity intervals: an entry added at one time is active until
the next event of the same list and key says otherwise. Each capture is judged at its fetch time: its keys (host and
parent domains; host with each leading path) are joined to the entries, and the as-of condition picks those active then.

Kinds: `domain` keys match the host and its subdomains, `path` keys a host with a leading path of whole segments; an entry
matches by its own kind only. Hosts are folded to lower case on both sides, paths are compared as written, repeated and closing
slashes aside. An entry of an `allow` list lifts blocks by keys that are not longer. The intervals of a key are gathered in one
row, so the join is an equi-join on kind and key; up to `FEW` keys are broadcast, above that both sides are salted.

Edge cases: null or hostless URLs and null fetch times match nothing; events without a list, kind, key or time do nothing;
events at the same time are applied add first; a remove without an add does nothing; an empty list blocks nothing; repeated
events and captures are harmless (a row for each capture); extra columns are dropped unless kept, and a kept column named
blocked, lists or n_entries gives way to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import kept, table

FEW, SALTS = 100_000, 16
#: Start of the registered query's times, 2024-01-01 UTC.
START, DAY = 1_704_067_200, 86_400


def host(url: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(".")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def entry_key(kind: Column, key: Column) -> Column:
    """A list entry's key as `keys` writes it."""
    domain = F.rtrim(F.lower(F.trim(key)), F.lit("."))
    at = F.regexp_replace(F.trim(key), "/+", "/")
    at = F.regexp_replace(at, "/$", "")
    return F.when(kind == "domain", domain).otherwise(F.concat(F.rtrim(F.lower(F.substring_index(at, "/", 1)), F.lit(".")), F.regexp_replace(at, "^[^/]*", "")))


def keys(url: Column) -> Column:
    """(kind, key) of a URL, without repeats."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.concat_ws(".", F.slice(labels, i, F.size(labels))).alias("key")))
    steps = F.filter(F.split(path(url), "/"), lambda x: x != "")
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("path").alias("kind"), F.concat_ws("/", host(url), F.concat_ws("/", F.slice(steps, F.lit(1), i))).alias("key"))))
    return F.when(host(url) != "", F.array_distinct(F.concat(domains, F.coalesce(paths, F.array().cast("array<struct<kind:string,key:string>>")))))


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, key, active_from, active_to (null: still active) from events."""
    events = events.select("list", "kind", entry_key(F.col("kind"), F.col("key")).alias("key"), "action", "at").dropna().distinct()
    order = Window.partitionBy("list", "kind", "key").orderBy("at", F.col("action"))
    return events.withColumn("active_to", F.lead("at").over(order)).filter(F.col("action") == "add").select("list", "kind", "key", F.col("at").alias("active_from"), "active_to").filter(F.col("active_to").isNull() | (F.col("active_to") > F.col("active_from")))


def judge(captures: DataFrame, events: DataFrame, keep: list[str], url: str = "url", at: str = "fetched_at", allow: str = "allow", few: int = FEW) -> DataFrame:
    """captures' columns `keep` with blocked, lists (active blocking lists, sorted) and n_entries (active entries)."""
    keep = kept(keep, ("blocked", "lists", "n_entries"))
    by_key = intervals(events).groupBy("kind", "key").agg(F.collect_set(F.struct("list", F.col("active_from").alias("a"), F.col("active_to").alias("b"))).alias("entries"))
    # A verdict depends on URL and time alone, so repeated captures are judged once.
    asked = captures.select(F.col(f"`{url}`").alias("j_url"), F.col(f"`{at}`").alias("j_at")).dropna().distinct()
    asked = asked.select("j_url", "j_at", F.explode(keys(F.col("j_url"))).alias("k")).select("j_url", "j_at", "k.*")
    if by_key.count() <= few:
        joined = asked.join(F.broadcast(by_key), ["kind", "key"])
    else:
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("j_url", "j_at"), F.lit(SALTS)).cast("int"))
        joined = salted.join(by_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["kind", "key", "salt"])
    active = F.filter("entries", lambda e: (e["a"] <= F.col("j_at")) & (e["b"].isNull() | (F.col("j_at") < e["b"])))
    hits = joined.select("j_url", "j_at", F.length("key").alias("n"), F.explode(active).alias("e"))
    allowed = F.col("e.list") == allow
    verdicts = hits.groupBy("j_url", "j_at").agg(
        F.array_sort(F.collect_set(F.when(~allowed, F.col("e.list")))).alias("j_lists"),
        F.count("*").alias("j_n"),
        F.coalesce(F.max(F.when(~allowed, F.col("n"))) > F.coalesce(F.max(F.when(allowed, F.col("n"))), F.lit(-1)), F.lit(False)).alias("j_blocked"),
    )
    rows = captures.select(*[F.col(f"`{c}`").alias(f"column_{i}") for i, c in enumerate(keep)], F.col(f"`{url}`").alias("c_url"), F.col(f"`{at}`").alias("c_at"))
    out = rows.join(verdicts, (F.col("c_url") == F.col("j_url")) & (F.col("c_at") == F.col("j_at")), "left")
    own = [F.col(f"column_{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*own, F.coalesce("j_blocked", F.lit(False)).alias("blocked"), F.coalesce("j_lists", F.array().cast("array<string>")).alias("lists"), F.coalesce("j_n", F.lit(0).cast("long")).alias("n_entries"))


def pages_as_captures(pages: DataFrame) -> DataFrame:
    """`pages` has no fetch time: it is taken from page_id, some minute of 2024."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525_600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(START) + minute * 60).alias("fetched_at"))


#: The registered query's events, made from the pages themselves by a hash of each host or leading path: (what, share of hashes,
#: remainder, list, kind, [(action, days after the entry's first day)]).
SCRIPT = (
    ("host", 12, 0, "spam", "domain", (("add", 0), ("remove", 60), ("add", 120))),
    ("host", 12, 1, "malware", "domain", (("add", 0),)),
    ("host", 12, 2, "allow", "domain", (("add", 0), ("remove", 150))),
    ("host", 12, 3, "adult", "domain", (("remove", 0), ("add", 30), ("add", 60), ("remove", 90))),
    ("parent", 2, 0, "adult", "domain", (("add", 100), ("remove", 110))),
    ("parent", 2, 1, "malware", "domain", (("add", 150), ("remove", 155))),
    ("step", 8, 0, "adult", "path", (("add", 0), ("remove", 100))),
    ("step", 8, 1, "allow", "path", (("add", 50),)),
    ("step", 8, 2, "spam", "path", (("add", 20), ("remove", 40), ("add", 200))),
    ("step", 8, 3, "malware", "domain", (("add", 0),)),  # a path under the wrong kind matches nothing
)


def page_events(pages: DataFrame) -> DataFrame:
    """Dated list entries about hosts, parent domains and leading paths that occur in pages."""
    url = F.col("url")
    at = pages.filter(host(url) != "").select(host(url).alias("host"), F.regexp_extract(path(url), "^/+([^/]+)", 1).alias("first"))
    names = at.select(F.explode(F.array(
        F.struct(F.lit("host").alias("what"), F.col("host").alias("key")),
        F.struct(F.lit("parent").alias("what"), F.substring_index("host", ".", -2).alias("key")),
        F.struct(F.lit("step").alias("what"), F.when(F.col("first") != "", F.concat_ws("/", "host", "first")).alias("key")),
    )).alias("x")).select("x.*").dropna().distinct().withColumn("n", F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("long"))
    first = F.pmod(F.floor(F.col("n") / 100), F.lit(150))
    rows = [F.when((F.col("what") == what) & (F.col("n") % share == rest), F.array(*[F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.when(F.lit(kind == "domain"), F.upper("key")).otherwise(F.col("key")).alias("key"), F.lit(action).alias("action"), F.timestamp_seconds(F.lit(START) + DAY * (first + day)).alias("at")) for action, day in steps])) for what, share, rest, name, kind, steps in SCRIPT]
    return names.select(F.explode(F.coalesce(*rows)).alias("e")).select("e.*")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, with the verdict of the lists at its fetch time."""
    pages = table(spark, sf_dir, "pages")
    out = judge(pages_as_captures(pages), page_events(pages), ["page_id", "url"])
    return out.select("page_id", "url", "blocked", F.array_join("lists", ",").alias("lists"), "n_entries")


_RULES = ", ".join(f"('{what}', {share}, {rest}, '{name}', '{kind}', '{action}', {day})" for what, share, rest, name, kind, steps in SCRIPT for action, day in steps)
OP4_SQL = rf"""
WITH cap AS (SELECT page_id, url, {START} + (page_id * 7919) % 525600 * 60 AS t, lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.')) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
names AS (SELECT DISTINCT what, key FROM (SELECT 'host' AS what, host AS key FROM cap WHERE host <> '' UNION ALL SELECT 'parent', array_to_string(string_split(host, '.')[-2:], '.') FROM cap WHERE host <> ''
  UNION ALL SELECT 'step', host || '/' || regexp_extract(path, '^/+([^/]+)', 1) FROM cap WHERE host <> '' AND regexp_extract(path, '^/+([^/]+)', 1) <> '')),
hashed AS (SELECT *, ('0x' || substr(md5(key), 1, 7))::BIGINT AS n FROM names), rules(what, share, rest, list, kind, action, d) AS (VALUES {_RULES}),
events AS (SELECT list, kind, key, action, {START} + {DAY} * ((n // 100) % 150 + d) AS ts FROM hashed JOIN rules ON rules.what = hashed.what AND n % share = rest),
iv AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY list, kind, key ORDER BY ts, action) AS until FROM (SELECT DISTINCT * FROM events)) WHERE action = 'add' AND (until IS NULL OR until > ts)),
hit AS (SELECT page_id, list, length(key) AS n FROM cap JOIN iv ON ts <= t AND (until IS NULL OR t < until) AND host <> ''
  AND CASE kind WHEN 'domain' THEN host = key OR ends_with(host, '.' || key) ELSE starts_with(host || regexp_replace(path || '/', '/+', '/', 'g'), key || '/') END),
v AS (SELECT page_id, array_to_string(list_sort(list_distinct(list(list) FILTER (list <> 'allow'))), ',') AS lists, count(*) AS n_entries,
  coalesce(max(n) FILTER (list <> 'allow') > coalesce(max(n) FILTER (list = 'allow'), -1), false) AS blocked FROM hit GROUP BY page_id)
SELECT page_id, url, coalesce(blocked, false) AS blocked, coalesce(lists, '') AS lists, coalesce(n_entries, 0)::BIGINT AS n_entries FROM cap LEFT JOIN v USING (page_id)
"""
