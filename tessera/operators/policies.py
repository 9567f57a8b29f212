"""Policy texts as rule tables: parsing, introspection, sessions, provenance of decisions, checks of inputs."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tessera.operators.decision import FLOOR, Policies

NOTE, HEAD = re.compile(r'@(\w+)\("([^"]*)"\)\s*'), re.compile(r"(permit|forbid)\s*\(")
NOTES = ("reason", "grounding", "source_type", "source", "policy_ref", "policy_url")
#: What the gate takes: name and Spark type.
INPUTS = {"category": "string", "topics": "array<string>", "confidence": "decimal(5,4)", "has_citation": "boolean", "quotes_policy": "boolean", "conflict": "boolean", "breach": "boolean"}


@dataclass(frozen=True)
class Rule:
    """An annotated statement: its number among these in the text, annotations, effect, and the body up to its end."""

    number: int
    notes: tuple[tuple[str, str], ...]
    effect: str
    body: str

    @property
    def id(self) -> str:
        return dict(self.notes).get("id", f"policy{self.number}")

    @property
    def topics(self) -> tuple[str, ...]:
        return tuple(re.findall(r'"([a-z_]+)"', self.body)) if self.effect == "forbid" else ()


def parse(text: str) -> list[Rule]:
    """G1: the annotated statements of a policy text, line by line; a statement without annotations is no rule. No rule is an error."""
    rules, notes, body = [], [], None
    for line in text.splitlines():
        if body is not None:
            body.append(line)
        elif m := NOTE.fullmatch(line):
            notes.append((m[1], m[2]))
            continue
        elif notes and (m := HEAD.match(line)):
            effect, body = m[1], [line]
        else:
            notes = []
            continue
        if "};" in line or line.rstrip().endswith(");"):
            rules.append(Rule(len(rules), tuple(notes), effect, "\n".join(body)))
            notes, body = [], None
    if not rules:
        raise ValueError("no annotated rules in the policy text")
    return rules


def floor(text: str, default: Decimal = FLOOR) -> Decimal:
    """The confidence floor that a policy text enforces."""
    m = re.search(r'decimal\("([0-9.]+)"\)', text)
    return Decimal(m[1]) if m else default


def topics(text: str) -> dict[str, tuple[str, ...]]:
    """The topics that each rule forbids."""
    return {r.id: r.topics for r in parse(text) if r.topics}


def policies(text: str) -> Policies:
    """G1: a policy text as the rule set that decide() applies."""
    return Policies(floor=floor(text), topics=tuple(topics(text).items()))


@dataclass(frozen=True)
class Session:
    """Changes to a rule set in memory. The text that it began with never changes, and reset gives it back."""

    original: Policies
    now: Policies

    @staticmethod
    def of(text: str) -> Session:
        made = policies(text)
        return Session(made, made)

    def change(self, **values) -> Session:
        return replace(self, now=replace(self.now, **values))

    def set_floor(self, value: str) -> Session:
        return replace(self, now=self.now.with_floor(value))

    def disable(self, rule: str) -> Session:
        known = {r for r, _ in self.now.topics} | {"F6", "F7", "F8"}
        if rule not in known:
            raise KeyError(f"no rule {rule}")
        return replace(self, now=self.now.disable(rule))

    def add_forbid(self, rule: str, *topics: str) -> Session:
        return replace(self, now=self.now.forbid(rule, *topics))

    def reset(self) -> Session:
        return replace(self, now=self.original)


def rule_table(spark: SparkSession, text: str) -> DataFrame:
    """Rule, effect and annotations, a row each."""
    rows = [(r.id, r.effect, *(dict(r.notes).get(n, "") for n in NOTES)) for r in parse(text)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("rule", "effect", *NOTES)))


def provenance(decisions: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """A row for each rule that blocked a decision, with why it exists; a rule without annotations has empty ones. The rules are a
    table of a few rows."""
    blocked = decisions.select(key, F.explode("blocked_by").alias("rule"))
    known = blocked.join(rules.filter("effect = 'forbid'").drop("effect"), "rule", "left")
    return known.select(key, "rule", *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in NOTES])


def drift(extracted: list[str], text: str) -> dict[str, list[str]]:
    """Topics that rules name and no extractor finds, and topics found that no rule names: either is a guard that cannot work."""
    guarded = {t for ts in topics(text).values() for t in ts}
    return {"not_extracted": sorted(guarded - set(extracted)), "not_guarded": sorted(set(extracted) - guarded)}


def invalid(schema: StructType, inputs: dict[str, str] = INPUTS) -> list[str]:
    """What is wrong with a table of gate inputs: columns that are missing or of another type."""
    have = {f.name: f.dataType.simpleString() for f in schema.fields}
    return [f"{c}: {have.get(c, 'missing')}, not {kind}" for c, kind in inputs.items() if have.get(c) != kind]


def build_ticket(rows: DataFrame, topics: Column, confidence: Column, conflict: Column | None = None, breach: Column | None = None) -> DataFrame:
    """Rows with the gate's inputs: topics in order and once each, the confidence to four places, unknown flags false."""
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    named = {"topics": F.array_sort(F.array_distinct(topics)), "confidence": F.round(confidence.cast("decimal(12,8)"), 4).cast("decimal(5,4)"), "conflict": flag(conflict), "breach": flag(breach)}
    return rows.withColumns(named)
