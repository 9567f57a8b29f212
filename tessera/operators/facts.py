"""Facts from text and what is said of them: metric readings, findings in words, summaries, replies from a template."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import percent_text, pick_quote, restate

#: How each metric is written, as patterns matched as whole words.
ALIASES = {
    "order_defect_rate": ("odr", "order defect rate"),
    "late_shipment_rate": ("lsr", "late shipment rate", "late dispatch rate"),
    "cancellation_rate": ("cr", "cancell?ation rate", "pre-?fulfill?ment cancell?ation rate"),
    "valid_tracking_rate": ("vtr", "valid tracking rate", "tracking rate"),
    "on_time_delivery": ("otd", "on[- ]time delivery(?: rate)?"),
}
AHEAD, BEHIND = 60, 20
_NUMBER = re.compile(r"(\d{1,3}(?:\.\d{1,2})?)\s*(?:%|percent\b|per cent\b)", re.IGNORECASE)


def _read(text: str, names: list[tuple[str, re.Pattern]], ahead: int, behind: int) -> list[tuple[str, float, str]]:
    spans = sorted(((m.start(), m.end(), metric) for metric, p in names for m in p.finditer(text)), key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in spans:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    out, taken, i = [], set(), 0
    for n in _NUMBER.finditer(text):
        while i < len(kept) and kept[i][1] <= n.start():
            i += 1
        j = next((k for k in range(i, len(kept)) if kept[k][0] >= n.end()), None)
        if i and n.start() - kept[i - 1][1] <= ahead:
            owner = i - 1
        elif j is not None and kept[j][0] - n.end() <= behind:
            owner = j
        else:
            continue
        if owner not in taken:
            taken.add(owner)
            out.append((kept[owner][2], float(n[1]), text[kept[owner][0] : n.end()].strip()))
    return out


def readings(rows: DataFrame, keys: list[str], text: str, aliases: dict[str, tuple[str, ...]] = ALIASES, ahead: int = AHEAD, behind: int = BEHIND) -> DataFrame:
    """(keys, metric, value, matched). Of alias spans that overlap the first, and of those the longest, counts. A percentage
    belongs to the last mention that ends at most `ahead` characters before it, else to the first that starts at most `behind` after;
    a mention gives one reading, and a percentage whose mention is taken gives none."""
    names = [(metric, re.compile(rf"\b{p}\b", re.IGNORECASE)) for metric, patterns in aliases.items() for p in patterns]
    some = rows.select(*keys, F.col(text).alias("_text")).filter("_text is not null")
    schema = ", ".join([*(f"`{k}` {some.schema[k].dataType.simpleString()}" for k in keys), "metric string, value double, matched string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *r) for i, x in enumerate(b.column("_text").to_pylist()) for r in _read(x, names, ahead, behind)]
            at, metric, value, matched = zip(*found) if found else ((), (), (), ())
            own = [b.column(k).take(pa.array(at, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, pa.array(metric, pa.string()), pa.array(value, pa.float64()), pa.array(matched, pa.string())], names=[*keys, "metric", "value", "matched"])

    return some.mapInArrow(run, schema)


def finding(label: Column, value: Column, kind: Column, limit: Column, stake: Column, status: Column) -> Column:
    """a finding in words. A ceiling and a floor read in opposite directions."""
    top = kind == "max"
    bar = F.concat(percent_text(limit), F.when(top, " limit").otherwise(" needed"), F.lit(" for "), stake)
    how = F.when(status == "breach", F.when(top, "is above the ").otherwise("is below the ")).when(status == "close", F.when(top, "stays under the ").otherwise("stays above the ")).otherwise(F.when(top, "is within the ").otherwise("is comfortably above the "))
    return F.concat(label, F.lit(" of "), percent_text(value), F.lit(" "), how, bar, F.when(status == "close", ", but only just.").otherwise("."))


def severity(status: Column) -> Column:
    return F.when(status == "breach", 0).when(status == "close", 1).otherwise(2)


def summaries(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, n_readings, findings in order (breach, close, meets; the selling tier first; label) and a summary sentence.
    findings: keys, label, tier, status, sentence, stake. A ticket's readings are few: one a metric mentioned."""
    item = F.struct(severity(F.col("status")).alias("at"), (F.col("tier") != "selling").alias("tier"), "label", "sentence", "stake", "status")
    by = findings.groupBy(*keys).agg(F.count_distinct("label").alias("n_readings"), F.array_sort(F.collect_list(item)).alias("f"))
    first, n = F.col("f")[0], F.col("n_readings")
    counted = F.concat(n.cast("string"), F.when(n == 1, " number checked. ").otherwise(" numbers checked. "))
    said = F.when(first["status"] == "breach", F.concat(first["label"], F.lit(" is under the line for "), first["stake"], F.lit("."))).when(first["status"] == "close", F.concat(F.lit("Everything clears, but "), first["label"], F.lit(" is close to the line."))).otherwise("Every one clears its published limit.")
    return by.select(*keys, "n_readings", F.col("f.sentence").alias("findings"), F.concat(counted, said).alias("summary"))


REFUSAL = "I cannot answer this from the published pages, so a colleague will take it from here."


def template_reply(ask: Column, passage: Column, where: Column, url: Column, findings: Column, rules: Column) -> Column:
    """A reply around a word-for-word quote, or the refusal where the passage gives none. findings: array of sentences or
    null; rules: array of (metric, operator, value, unit) or null."""
    quote, none = pick_quote(passage), F.array().cast("array<string>")
    said = F.when(F.size(findings) > 0, F.concat(F.array(F.lit(""), F.lit("Your numbers against the published limits:")), F.transform(findings, lambda x: F.concat(F.lit("  - "), x)))).otherwise(none)
    asked = F.when(F.size(rules) > 0, F.concat(F.array(F.lit(""), F.lit("The specific requirement that applies:")), F.transform(rules, lambda r: F.concat(F.lit("  - "), F.concat_ws(" ", r["metric"], r["operator"], F.concat(r["value"].cast("string"), r["unit"])))))).otherwise(none)
    source = F.concat(F.lit("Source: "), F.concat_ws(" — ", F.coalesce(where, F.lit("")), F.nullif(url, F.lit(""))))
    head = F.array(F.concat(F.lit("Thank you for writing about "), restate(ask), F.lit(".")), F.lit(""), F.concat(F.lit('The applicable policy states: "'), quote, F.lit('"')))
    tail = F.array(F.lit(""), F.lit("Please read the policy in full at the link below."), F.lit(""), source)
    return F.when(quote.isNull(), REFUSAL).otherwise(F.concat_ws("\n", head, F.coalesce(said, none), F.coalesce(asked, none), tail))
