"""Sentence packing into passages, and carrying headings forward."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import ABBREVIATIONS, sentences, squeeze, words

TARGET, LEAST, MERGE, FEWEST = 150, 60, 240, 20


def _fold(units: Column, target: int) -> Column:
    """Units, structs (s, n) of text and its words, put in order into lists up to `target` words, each but the first opened by the
    last unit of the one before."""
    unit = "array<struct<s:string,n:int>>"
    start = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.array().cast(unit).alias("buf"), F.lit(0).alias("n"))

    def step(acc: Column, u: Column) -> Column:
        full = (F.size(acc["buf"]) > 0) & (acc["n"] + u["n"] > target)
        last = F.element_at(acc["buf"], -1)
        return F.when(full, F.struct(F.concat(acc["done"], F.array(acc["buf"])).alias("done"), F.array(last, u).alias("buf"), (last["n"] + u["n"]).alias("n"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["buf"], F.array(u)).alias("buf"), (acc["n"] + u["n"]).alias("n")))

    return F.aggregate(units, start, step, lambda acc: F.when(F.size(acc["buf"]) > 0, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]))


def _total(units: Column) -> Column:
    return F.aggregate(units, F.lit(0), lambda a, u: a + u["n"])


def _rows(docs: DataFrame, key: str, lists: Column) -> DataFrame:
    packed = docs.select(key, lists.alias("c")).select(key, F.posexplode("c").alias("chunk", "u"))
    return packed.select(key, "chunk", _total(F.col("u")).alias("n_words"), F.concat_ws(" ", "u.s").alias("text"))


def pack(docs: DataFrame, key: str, target: int = TARGET, least: int = LEAST, ceiling: int = MERGE) -> DataFrame:
    """(key, chunk, n_words, text): W8's fold without its hard split, for texts whose sentences are short. A longer sentence stays
    whole, and only a last passage under `least` words joins the one before, if both have at most `ceiling`. See passages()."""
    units = F.transform(sentences(F.coalesce("text", F.lit(""))), lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n")))

    def merged(c: Column) -> Column:
        last, before = F.try_element_at(c, F.lit(-1)), F.try_element_at(c, F.lit(-2))
        joins = (F.size(c) > 1) & (_total(last) < least) & (_total(before) + _total(last) <= ceiling)
        return F.when(joins, F.concat(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), F.array(F.concat(before, last)))).otherwise(c)

    return _rows(docs.select(key, _fold(units, target).alias("c")), key, merged(F.col("c")))


_WHITE = re.compile(r"[^\S\x1c-\x1f]+")
_ENDS = re.compile(r"(?<=[.!?]) ")
_SHORT = re.compile(r"\b(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")\.$", re.IGNORECASE)


def _sentences(text: str, promo: re.Pattern | None) -> list[str]:
    """functions.text.sentences() for a text in Python."""
    out: list[str] = []
    for s in _ENDS.split(_WHITE.sub(" ", text).strip(" ")):
        if not s or promo and promo.search(s):
            continue
        if out and _SHORT.search(out[-1]):
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def _pack(units: list[tuple[tuple, list[str]]], target: int, least: int, ceiling: int) -> list[tuple[tuple, list[str]]]:
    """(heading, words) of each passage, of units (heading, words)."""
    done: list[tuple[tuple, list[str]]] = []
    own, held, last = (), [], []
    for head, w in units:
        if held and (len(held) + len(w) > target or head != own and len(held) >= least):
            done.append((own, held))
            held = list(last) if head == own else []
        if not held:
            own = head
        held = held + w
        last = w
    if held:
        done.append((own, held))
    out: list[tuple[tuple, list[str]]] = []
    for head, w in done:
        if out and len(w) < least and len(out[-1][1]) + len(w) <= ceiling:
            out[-1] = (out[-1][0], out[-1][1] + w)
        else:
            out.append((head, w))
    return out


def _passages(docs: DataFrame, key: str, target: int, least: int, ceiling: int, sections: str | None, promo: tuple[str, ...], fewest: int) -> DataFrame:
    """passages() of at least `fewest` words, with number, their place among these."""
    drop = re.compile("|".join(promo), re.IGNORECASE) if promo else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, parts in enumerate(b.column("parts").to_pylist()):
                units = [((x["heading_path"], x["section_id"]), w[j : j + target]) for x in parts or () for s in _sentences(x["text"] or "", drop) for w in [s.split(" ")] for j in range(0, len(w), target)]
                made = [(c, h, w) for c, (h, w) in enumerate(_pack(units, target, least, ceiling)) if len(w) >= fewest]
                if made:
                    cols = [pa.array([c for c, _, _ in made], pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array([len(w) for _, _, w in made], pa.int32()), pa.array([h[0] for _, h, _ in made], pa.string()), pa.array([h[1] for _, h, _ in made], pa.string()), pa.array([" ".join(w) for _, _, w in made], pa.string())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(made), pa.int64())), *cols], names=[key, "chunk", "number", "n_words", "heading_path", "section_id", "text"])

    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading_path"), F.lit(None).cast("string").alias("section_id"), F.col("text").alias("text")))
    rows = docs.select(key, (F.col(sections) if sections else whole).alias("parts"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk int, number int, n_words int, heading_path string, section_id string, text string")


def passages(docs: DataFrame, key: str, target: int = TARGET, least: int = LEAST, ceiling: int = MERGE, sections: str | None = None, promo: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk, n_words, heading_path, section_id, text). Sentences of more than `target` words are cut into pieces of `target`;
    sentences and pieces fill passages up to `target` words, with the last of one repeated in the next under the same heading; another
    heading begins a passage once the one before has `least` words; a passage keeps its first sentence's heading. Then every passage
    under `least` words joins the one before if both have at most `ceiling`. `sections` names a column of structs (heading_path,
    section_id, text); without it the column text is one section. One pass over each document's words, in Arrow batches: documents never
    leave their row, and the work grows with their length."""
    return _passages(docs, key, target, least, ceiling, sections, promo, 0).drop("number")


def _chunk_id(key: str, n: Column) -> Column:
    """key#n, n in four digits or as many as it has."""
    digits = n.cast("string")
    return F.concat(F.col(key).cast("string"), F.lit("#"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def numbered_passages(docs: DataFrame, key: str, fewest: int = FEWEST, target: int = TARGET, least: int = LEAST, ceiling: int = MERGE, sections: str | None = None, promo: tuple[str, ...] = ()) -> DataFrame:
    """number() of passages(), numbered as they are packed: nothing is shuffled. Rows that repeat a key are numbered each by
    itself, so their ids repeat."""
    return _passages(docs, key, target, least, ceiling, sections, promo, fewest).withColumn("chunk_id", _chunk_id(key, F.col("number"))).drop("number")


def number(chunks: DataFrame, key: str, fewest: int = FEWEST) -> DataFrame:
    """Chunks of at least `fewest` words with chunk_id, doc#number within the document."""
    w = Window.partitionBy(key).orderBy("chunk")
    return chunks.filter(F.col("n_words") >= fewest).withColumn("chunk_id", _chunk_id(key, F.row_number().over(w) - 1))


def headings(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Lines with heading_path: the last heading of each depth, unless a shallower one came after it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.length(F.regexp_extract(text, r"^(#{1,4}) ", 1))
    title = F.regexp_replace(text, r"^#{1,4} ", "")
    out, levels = lines.withColumn("_d", depth), []
    for d in range(1, 5):
        out = out.withColumn(f"_h{d}", F.last(F.when(F.col("_d") == d, F.struct(F.col(order).alias("o"), title.alias("t"))), ignorenulls=True).over(w))
        out = out.withColumn(f"_c{d}", F.max(F.when(F.col("_d").between(1, d - 1), F.col(order))).over(w))
        levels.append(F.when(F.col(f"_c{d}").isNull() | (F.col(f"_h{d}.o") > F.col(f"_c{d}")), F.col(f"_h{d}.t")))
    return out.withColumn("heading_path", F.concat_ws(" > ", *levels)).select(*lines.columns, "heading_path")


#: Numbered clauses of an agreement and the part that each prefix stands for.
PARTS = {"S": "Selling Service Terms", "F": "Fulfillment Service Terms", "API": "API Terms"}


def sections(lines: DataFrame, key: str, order: str, text: str, title: str, parts: dict[str, str] = PARTS) -> DataFrame:
    """(key, section, section_id, heading_path, text) of an agreement's lines. A line `S-1.2 Title ...` opens a section of its
    part and belongs to it; a line under 90 characters like `3. Title` opens one of the general terms and does not; what stands
    before the first section falls away."""
    clause, general = r"^\s*((?:" + "|".join(parts) + r")-\d+(?:\.\d+)?)\s+(.*)$", r"^\s*(\d{1,2})\.\s+([A-Z].*)$"
    t = F.rtrim(F.col(text))
    is_clause = t.rlike(clause)
    is_general = ~is_clause & t.rlike(general) & (F.length(t) < 90)
    rest = squeeze(F.regexp_extract(t, clause, 2))
    name = F.when(is_clause, F.substring(F.substring_index(rest, ".", 1), 1, 70)).otherwise(F.substring(F.regexp_replace(squeeze(F.regexp_extract(t, general, 2)), r"\.+$", ""), 1, 70))
    number = F.when(is_clause, F.regexp_extract(t, clause, 1)).otherwise(F.concat(F.lit("§"), F.regexp_extract(t, general, 1)))
    named = F.create_map(*[F.lit(x) for p in parts.items() for x in p])
    part = F.when(is_clause, named[F.regexp_extract(t, clause + "|$", 1).substr(F.lit(1), F.instr(F.regexp_extract(t, clause, 1), "-") - 1)]).otherwise("General Terms")
    opened = F.when(is_clause | is_general, F.struct(F.col(order).alias("o"), number.alias("id"), F.concat_ws(" > ", F.lit(title), part, F.concat_ws(" ", number, name)).alias("head")))
    w = Window.partitionBy(key).orderBy(order)
    rows = lines.filter(F.trim(text) != "").select(key, F.col(order).alias("line"), F.last(opened, ignorenulls=True).over(w).alias("s"), F.when(is_clause, rest).when(~is_general, F.trim(t)).alias("x")).filter("s is not null and x is not null")
    out = rows.groupBy(key, F.col("s.o").alias("at"), F.col("s.id").alias("section_id"), F.col("s.head").alias("head")).agg(F.array_sort(F.collect_list(F.struct("line", "x"))).alias("l"))
    out = out.select(key, "at", "section_id", squeeze(F.col("head")).alias("heading_path"), squeeze(F.concat_ws(" ", "l.x")).alias("text")).filter("text != ''")
    return out.withColumn("section", F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).drop("at")


def locate(chunks: DataFrame, docs: DataFrame, key: str, probe: int = 60) -> DataFrame:
    """Chunks (key, chunk, text) with char_start and char_end in the document's collapsed text, null where absent. Each is sought
    by its first `probe` characters from one past the start of the chunk found before, or else from the beginning."""
    ordered = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", F.substring("text", 1, probe).alias("p")))).alias("c"))
    body = docs.select(key, squeeze(F.coalesce("text", F.lit(""))).alias("body")).join(ordered, key)

    def step(acc: Column, c: Column) -> Column:
        ahead = F.call_function("locate", c["p"], F.col("body"), acc["cursor"] + 1)
        at = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", c["p"], F.col("body"))) - 1
        return F.struct(F.concat(acc["out"], F.array(F.struct(c["chunk"].alias("chunk"), at.alias("at")))).alias("out"), F.when(at >= 0, at + 1).otherwise(acc["cursor"]).alias("cursor"))

    start = F.struct(F.array().cast("array<struct<chunk:int,at:int>>").alias("out"), F.lit(0).alias("cursor"))
    found = body.select(key, F.explode(F.aggregate("c", start, step, lambda acc: acc["out"])).alias("f")).select(key, "f.*")
    start_at = F.when(F.col("at") >= 0, F.col("at"))
    return chunks.join(found, [key, "chunk"]).withColumn("char_start", start_at).withColumn("char_end", start_at + F.length("text")).drop("at")


def number_all(chunks: DataFrame, key: str, fewest: int = FEWEST) -> DataFrame:
    """Chunks of at least `fewest` words with chunk_id, key#number counted on over all documents in order of key. Documents' counts
    are summed up first, so no window holds chunks of several documents."""
    some = chunks.filter(F.col("n_words") >= fewest).withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("chunk")) - 1)
    counts = some.groupBy(key).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.repartitionByRange(F.col(key)).withColumn("block", F.spark_partition_id())
    blocks = placed.groupBy("block").agg(F.sum("n").alias("n"), F.min(key).alias("first"))
    blocks = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each partition
    base = placed.withColumn("within", before).join(F.broadcast(blocks), F.col("block") == F.col("b")).select(key, (F.col("base") + F.col("within")).alias("start"))
    return some.join(base, key).withColumn("number", F.col("start") + F.col("number")).withColumn("chunk_id", _chunk_id(key, F.col("number"))).drop("start")


def word_stats(chunks: DataFrame) -> DataFrame:
    """Least, median and most words of a chunk."""
    return chunks.agg(F.min("n_words").alias("least"), F.median("n_words").alias("median"), F.max("n_words").alias("most"))
