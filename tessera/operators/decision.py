"""Decision operators: metric limits, standing, forbid-overrides-permit rules as data, grounding, precedents."""

from __future__ import annotations

from dataclasses import dataclass, replace
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import folded, percent_text, quotes, urls

FLOOR, SIMILAR, SAME, MARGIN = Decimal("0.72"), 0.80, 0.86, 1.0
#: Metric, tier, kind, value of the published limits.
LIMITS = (
    ("order_defect_rate", "selling", "max", 1.0),
    ("late_shipment_rate", "selling", "max", 4.0),
    ("cancellation_rate", "selling", "max", 2.5),
    ("valid_tracking_rate", "selling", "min", 95.0),
    ("on_time_delivery", "selling", "min", 90.0),
    ("on_time_delivery", "prime", "min", 93.5),
    ("valid_tracking_rate", "prime", "min", 99.0),
    ("cancellation_rate", "prime", "max", 0.5),
)
#: Rules by id and the topics that each forbids.
GUARDED = {
    "F1": ("account_deactivation", "account_suspension", "enforcement_action", "account_review"),
    "F2": ("payment_hold", "disbursement_failure", "account_reserve", "funds_withheld"),
    "F3": ("appeal", "reinstatement", "plan_of_action"),
    "F4": ("listing_suppressed", "listing_removed", "category_gated"),
    "F5": ("ip_infringement", "counterfeit_claim", "legal_threat", "law_enforcement", "regulatory"),
}


@dataclass(frozen=True)
class Policies:
    """An immutable rule set; changes give another one, so a session never touches the original."""

    floor: Decimal = FLOOR
    topics: tuple[tuple[str, tuple[str, ...]], ...] = tuple(GUARDED.items())
    disabled: frozenset[str] = frozenset()

    def disable(self, rule: str) -> Policies:
        return replace(self, disabled=self.disabled | {rule})

    def forbid(self, rule: str, *topics: str) -> Policies:
        return replace(self, topics=(*self.topics, (rule, topics)))

    def with_floor(self, floor: str) -> Policies:
        return replace(self, floor=Decimal(floor))

    def rules(self) -> dict[str, Column]:
        """Conditions over topics, confidence, has_citation, quotes_policy, conflict, breach."""
        own = {r: F.arrays_overlap("topics", F.array(*map(F.lit, t))) for r, t in self.topics}
        own["F6"] = (F.col("confidence") < F.lit(self.floor).cast("decimal(5,4)")) | ~F.col("has_citation") | ~F.col("quotes_policy")
        own |= {"F7": F.col("conflict"), "F8": F.col("breach")}
        return {r: c for r, c in own.items() if r not in self.disabled}


def decide(tickets: DataFrame, policies: Policies = Policies()) -> DataFrame:
    """Tickets with blocked_by (sorted rule ids) and decision. One permit; any forbid wins; an unknown input forbids."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in sorted(policies.rules().items())]))
    return tickets.withColumn("blocked_by", fired).withColumn("decision", F.when(F.size(fired) == 0, "AUTO_SEND").otherwise("ESCALATE"))


def status(value: Column, kind: Column, limit: Column, margin: float = MARGIN) -> Column:
    """M8: breach at or above a maximum or below a minimum; close within the margin; else meets."""
    top = F.when(value >= limit, "breach").when(value >= limit - margin, "close").otherwise("meets")
    low = F.when(value < limit, "breach").when(value < limit + margin, "close").otherwise("meets")
    return F.when(kind == "max", top).otherwise(low)


def assess(readings: DataFrame, limits: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Readings (key columns, metric, value) joined to limits (metric, tier, kind, limit), with status and sentence. The
    limits are a table of a few rows a metric; Spark picks the join."""
    out = readings.join(limits, "metric").withColumn("status", status(F.col("value"), F.col("kind"), F.col("limit"), margin))
    bound = F.when(F.col("kind") == "max", "ceiling").otherwise("floor")
    return out.withColumn("sentence", F.concat(F.col("metric"), F.lit(" "), percent_text(F.col("value")), F.lit(" against the "), F.col("tier"), F.lit(" "), bound, F.lit(" of "), percent_text(F.col("limit")), F.lit(": "), F.col("status")))


def standing(findings: DataFrame, key: str) -> DataFrame:
    """Breach flags by key and tier."""
    bad = F.col("status") == "breach"
    return findings.groupBy(key).agg(F.bool_or(bad & (F.col("tier") == "selling")).alias("breach_selling"), F.bool_or(bad & (F.col("tier") == "prime")).alias("breach_prime"), F.count_if(F.col("status") == "close").alias("n_close"))


def ground(draft: Column, passage: Column, allowed: Column) -> Column:
    """Struct of ok, n_quotes, unverified, bad_urls. Grounded if some quote stands in the passage, none is missing and
    every link is allowed or stands in the passage."""
    q = F.transform(quotes(draft), folded)
    missing = F.filter(q, lambda x: ~F.contains(folded(passage), x))
    clean = F.transform(allowed, lambda u: F.lower(F.regexp_replace(F.regexp_replace(u, r"[#?].*$", ""), r"[.,;:!?/]+$", "")))
    bad = F.array_except(urls(draft), F.array_union(clean, urls(passage)))
    ok = (F.size(q) > 0) & (F.size(missing) == 0) & (F.size(bad) == 0)
    return F.struct(ok.alias("ok"), F.size(q).alias("n_quotes"), F.size(missing).alias("unverified"), bad.alias("bad_urls"))


def precedents(hits: DataFrame, similar: float = SIMILAR, same: float = SAME) -> DataFrame:
    """Hits (q, id, cosine, q_doc, doc, sent, created) of earlier items: number of similar ones, last sent one of the same
    question, and whether its document differs (a null document conflicts)."""
    last = F.max_by(F.struct("id", "doc"), F.when((F.col("cosine") >= same) & F.col("sent"), F.struct("created", "id")))
    out = hits.filter(F.col("cosine") >= similar).groupBy("q", "q_doc").agg(F.count("*").alias("n_similar"), last.alias("_l"), F.count_if((F.col("cosine") >= same) & F.col("sent")).alias("_n"))
    found = F.col("_n") > 0
    return out.select("q", "n_similar", F.when(found, F.col("_l.id")).alias("last_sent"), (found & ~F.coalesce(F.col("_l.doc") == F.col("q_doc"), F.lit(False))).alias("conflict"))


def distinct_wordings(rows: DataFrame, by: str, text: str, newest: str) -> DataFrame:
    """T4: the newest row of each wording, white space and case aside."""
    w = Window.partitionBy(by, F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))).orderBy(F.desc(newest))
    return rows.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def holding(docs: DataFrame, quotes: DataFrame, key: str, item: str, text: str = "text", block: int = 32 << 20) -> DataFrame:
    """F12 over tables: (key, item) where a document holds a quote (item, quote) letter for letter. One automaton of all quotes reads
    each document once; quotes beyond `block` bytes go into further automata, each with a pass of its own."""
    import ahocorasick

    spark, kind = docs.sparkSession, quotes.schema[item].dataType.simpleString()

    def scan(owners: dict[str, list]) -> DataFrame:
        tree = ahocorasick.Automaton()
        for q, ids in owners.items():
            tree.add_word(q, tuple(ids))
        tree.make_automaton()
        shared = spark.sparkContext.broadcast(tree)  # bounded by block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(text).to_pylist()):
                    hits = {x for _, ids in shared.value.iter(t or "") for x in ids}
                    at += [i] * len(hits)
                    found += sorted(hits)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(found, quoted)], names=[key, item])

        return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {kind}")

    quoted = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out, owners, size = None, {}, 0
    for q, x in quotes.select("quote", item).filter("quote != ''").toLocalIterator():
        if size > block:
            out = scan(owners) if out is None else out.unionByName(scan(owners))
            owners, size = {}, 0
        owners.setdefault(q, []).append(x)
        size += len(q)
    if owners:
        out = scan(owners) if out is None else out.unionByName(scan(owners))
    return out if out is not None else docs.join(quotes, F.lit(False)).select(key, item)
