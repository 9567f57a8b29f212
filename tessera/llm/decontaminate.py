"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Text is normalised byte-wise: A-Z to a-z, words are runs of [0-9a-z] and non-ASCII bytes, joined by single spaces.
The automaton holds every window of `window` consecutive item words (an item of fewer words is one window), padded with
spaces so that only whole words match. A document is scanned once in C; match ends are mapped to word numbers, and only
for documents with a match to offsets in the original text.

Size: the automaton is broadcast, so a block holds at most `max_words` item words. A larger benchmark is cut into
several blocks, each scanned in a pass of its own that hands its word runs to the next.

Edge cases: null or wordless text has no words and no hits; null or wordless items are ignored; an item without an id hits words
as any other, but has no id to be listed or counted; repeated items and equal windows of several items all count; repeated
document rows each give a row; an empty benchmark gives no hits; a kept column named like a result gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import fields, kept, map_batches, store, table

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Lower-cases A-Z and turns every byte that is no word byte into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not WORD.match(bytes([b])) else b for b in range(256))
WINDOW, MAX_WORDS = 10, 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def build(items: list[tuple[str | None, list[bytes]]], window: int):
    """Automaton over the windows of (item id, words). A window's value: (its number of words, its item ids)."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, words in items:
        for w in windows(words, window):
            owners.setdefault(w, set()).update(() if item is None else (item,))
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
    if owners:
        automaton.make_automaton()
    return automaton


def _read_blocks(benchmark: DataFrame, window: int, max_words: int) -> Iterator:
    """Automata over blocks of items, streamed to the driver in item order."""
    items, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of(row[1])
        if items and n + len(words) > max_words:
            yield build(items, window)
            items, n = [], 0
        if words:
            items.append((row[0], words))
            n += len(words)
    yield build(items, window)


def scan(text: str | None, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word runs [from, to), item ids."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    padded = b" " + b" ".join(words) + b" "
    found, items = [], set()
    for end, (n, ids) in automaton.iter(padded.decode("latin-1")):
        found.append((end, n))
        items.update(ids)
    if not found:
        return len(words), [], items
    ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word stands
    runs: list[tuple[int, int]] = []
    for last, n in sorted((int(np.searchsorted(ends, e)) + 1, n) for e, n in found):
        first = last - n
        while runs and runs[-1][1] >= first:  # windows overlap or touch
            first = min(first, runs.pop()[0])
        runs.append((first, last))
    return len(words), runs, items


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans in the original text of runs of words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    chars = np.cumsum([0] + [(b & 0xC0) != 0x80 for b in raw])
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in runs]


RESULT = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def _pass(docs: DataFrame, automaton, keep: list[str], first: bool, last: bool) -> DataFrame:
    """One scan. Between passes the hit word runs and the text go along; the last one turns runs into offsets."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            had = [([], [])] * len(texts) if first else list(zip(b.column("_runs").to_pylist(), b.column("items").to_pylist(), strict=True))
            n_words, all_runs, all_items = [], [], []
            for text, (flat, before) in zip(texts, had, strict=True):
                n, runs, items = scan(text, tree)
                n_words.append(n)
                all_runs.append(_union(runs + list(zip(flat[::2], flat[1::2], strict=True))))
                all_items.append(sorted(items.union(before)))
            cols = [b.column(k) for k in keep] + [pa.array(n_words, pa.int64())]
            if last:
                cols += [pa.array([sum(y - x for x, y in r) for r in all_runs], pa.int64()), pa.array([len(x) for x in all_items], pa.int64()), pa.array(all_items, strings)]
                cols.append(pa.array([[{"start": x, "end": y} for x, y in offsets(t, r)] if r else [] for t, r in zip(texts, all_runs, strict=True)], spans))
            else:
                cols += [pa.array(all_items, strings), pa.array([[x for r in runs for x in r] for runs in all_runs], ints), b.column("text")]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [*keep, "n_words", *(("n_hit", "n_items", "items", "spans") if last else ("items", "_runs", "text"))]
    return map_batches(docs, run, fields(docs, keep) + (RESULT if last else "n_words long, items array<string>, _runs array<int>, text string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs' columns `keep` with n_words, n_hit, n_items, items (sorted ids) and spans (hit characters of the text)."""
    keep = kept(keep, ("n_words", "n_hit", "n_items", "items", "spans", "_runs"))
    at = docs.select(*dict.fromkeys([*keep, "text"]))
    blocks = _read_blocks(benchmark, window, max_words)
    block, first = next(blocks), True
    for following in blocks:  # rarely: written in between, so that no worker holds two automata
        at, first, block = store(_pass(at, block, [k for k in keep if k != "text"], first, False)), False, following
    return _pass(at, block, keep, first, True)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 3 over the whole of documents."""
    hits = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
