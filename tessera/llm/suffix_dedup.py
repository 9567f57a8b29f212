"""Suffix-array deduplication: removes every byte covered by a string of `span` bytes that also starts anywhere else.

A distributed merge sort of suffixes that knows common prefixes, kept small by two ideas from communication-efficient
string sorting: only suffixes that can matter are exchanged, and they travel front-coded in sorted runs.

1. Anchors. With S = span // 2, a position is an anchor if its 8-byte hash is the least in some string of S bytes that holds it
   (all positions of equal least hash count, so the choice depends on content alone). Every window of `span` bytes holds
   an anchor in its first S bytes, at the same offset o <= S - 8 in every equal window. So windows are equal exactly if,
   at some anchors, the o bytes before and the span - o bytes after are equal, and the latter share span - S + 8 bytes.
2. Duplicate detection. Each anchor gives a hash of those shared bytes (`mid`) and one of all its context (`whole`).
   A mid that occurs once has no duplicate. Where all wholes of a mid are equal, every window of those anchors has one.
   Only one representative of each whole, of mids with several wholes, goes on to be sorted.
3. Sort. Each task sorts its suffixes and writes a front-coded run for each part (mids are dealt to parts by hash, as no
   order across mids is needed). A part's runs are merged by a loser tree that carries the common prefix with the last
   winner, so known prefixes are never compared again. Common prefixes of neighbours then give, for each suffix, the least
   and the greatest o whose window occurs elsewhere; all windows of an anchor hold it, so what lies between is covered.
   A mid with more than `HOT` wholes is not merged in one task: its windows' 128-bit digests are counted instead.
4. Covered runs are gathered per text and cut out.

Spans depend on the text alone, so rows are keyed by doc_id, an integer, with a hash of the text. Matches never cross documents.
A mid, or a context, that holds a great part of all anchors is joined by broadcast of its one row, so no task gets all of them.
Edge cases: null is empty; texts under `span` bytes keep all; repeated rows and rows sharing a doc_id are copies like any
others; long runs of one byte match themselves at an offset, so all of such a run goes if it has over `span` bytes; an empty
table gives no rows; extra columns go no further.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import HOT_ROWS, discard, map_batches, release, skew_join, store, table

SPAN, GRAM, HOT, PART = 400, 8, 50_000, 20_000
PAIRS = 24
META = "<HHHHBqqi"  # common prefix, rest, common suffix before, rest, flags, doc_id, text hash, position


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours, in log w passes."""
    size = 1
    while size * 2 <= w:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: bytes, s: int) -> np.ndarray:
    """Positions of anchors: every string of s bytes holds one with its GRAM bytes."""
    n, w = len(data) - GRAM + 1, s - GRAM + 1
    if n < w:
        return np.zeros(0, np.int64)
    x = np.ndarray((n,), "<u8", data, 0, (1,)).astype(np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    h = (x >> np.uint64(32)).astype(np.uint32)
    least = np.zeros(n + w - 1, np.uint32)
    least[w - 1 : n] = _slide(h, w, np.minimum)
    return np.flatnonzero(_slide(least, w, np.maximum) == h)


def _anchor_rows(span: int):
    from xxhash import xxh3_64_intdigest as digest

    s = span // 2
    most, mid = s - GRAM, span - s + GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            starts = np.cumsum([0] + [len(t) for t in texts])
            data = b"".join(texts)
            at = anchors(data, s)
            row = np.searchsorted(starts, at, "right") - 1
            p, n = at - starts[row], starts[row + 1] - starts[row]
            left, right = np.minimum(p, most), np.minimum(n - p, span)
            ok = np.flatnonzero(left + right >= span)
            at, row, p, left, right = (v[ok] for v in (at, row, p, left, right))
            view = memoryview(data)
            mids = np.array([digest(view[a : a + mid]) for a in at.tolist()], np.uint64).view(np.int64)
            wholes = np.array([digest(view[a - x : a + y], x * 65536 + y) for a, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)], np.uint64).view(np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), pa.array(p.astype(np.int32)), pa.array(right.astype(np.int16)), pa.array(mids), pa.array(wholes)], names=["doc_id", "th", "p", "r", "mid", "whole"])

    return run


def shared(x: bytes, y: bytes, h: int = 0) -> int:
    """Length of the common prefix, known to be h at least."""
    n = min(len(x), len(y))
    if x[h:n] == y[h:n]:
        return n
    return h + ((n - h) * 8 - (int.from_bytes(x[h:n], "big") ^ int.from_bytes(y[h:n], "big")).bit_length()) // 8


def encode_run(records: list[tuple]) -> bytes:
    """Sorted (after, before reversed, flags, doc_id, th, p), each front-coded against the one before."""
    out, a0, b0 = [], b"", b""
    for a, b, flags, doc, th, p in records:
        x, y = shared(a0, a), shared(b0, b)
        out += (struct.pack(META, x, len(a) - x, y, len(b) - y, flags, doc, th, p), a[x:], b[y:])
        a0, b0 = a, b
    return b"".join(out)


def decode_run(raw: bytes) -> Iterator[tuple[int, tuple]]:
    """(common prefix with the one before, record)."""
    i, a, b = 0, b"", b""
    while i < len(raw):
        x, n, y, m, flags, doc, th, p = struct.unpack_from(META, raw, i)
        i += struct.calcsize(META)
        a, b = a[:x] + raw[i : i + n], b[:y] + raw[i + n : i + n + m]
        i += n + m
        yield x, (a, b, flags, doc, th, p)


def merge(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """Loser tree over sorted runs: (common prefix with the last winner, record). A contender's common prefix with the last
    winner is known; the longer one is the smaller string, and bytes are compared from there on only if both are equal."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    head: list[tuple | None] = [None] * k
    lcp = [0] * k
    losers = [0] * k

    def advance(i: int) -> None:
        lcp[i], head[i] = next(runs[i], (0, None)) if i < len(runs) else (0, None)

    def play(i: int, j: int) -> tuple[int, int]:
        x, y = head[i], head[j]
        if x is None or y is None:
            return (j, i) if x is None else (i, j)
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        a, b = x[0], y[0]
        h = shared(a, b, lcp[i])
        i, j = (i, j) if a[h : h + 1] <= b[h : h + 1] else (j, i)
        lcp[j] = h
        return i, j

    for i in range(k):
        advance(i)
        lcp[i] = 0
    winners = list(range(k))
    level = k
    while len(winners) > 1:
        level //= 2
        pairs = [play(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        for i, (_, loser) in enumerate(pairs):
            losers[level + i] = loser
        winners = [w for w, _ in pairs]
    best = winners[0]
    while head[best] is not None:
        yield lcp[best], head[best]
        i = best
        advance(i)
        node = (i + k) // 2
        while node:
            i, losers[node] = play(i, losers[node])
            node //= 2
        best = i


def verdicts(group: list[tuple[int, tuple]], span: int) -> Iterator[tuple[int, int, int]]:
    """(record number, least o, greatest o) of records that have a window which another record has too. group: sorted, with
    common prefixes; o bytes stand before the anchor."""
    least, most = [span] * len(group), [-1] * len(group)
    if len(group) <= PAIRS:
        for i, (_, x) in enumerate(group):
            r = span
            for j in range(i + 1, len(group)):
                r = min(r, group[j][0])
                y = group[j][1]
                o = shared(x[1], y[1])
                if o >= span - r:
                    for k in (i, j):
                        least[k], most[k] = min(least[k], span - r), max(most[k], o)
    else:
        for o in range(max(len(x[1]) for _, x in group) + 1):
            seen: dict = {}
            block = 0
            for i, (h, x) in enumerate(group):
                block += h < span - o
                if len(x[1]) >= o and len(x[0]) >= span - o:
                    key = (block, x[1][:o])
                    first = seen.setdefault(key, i)
                    if first != i:
                        for k in (first, i):
                            least[k], most[k] = min(least[k], o), max(most[k], o)
    for i, o in enumerate(most):
        if o >= 0:
            yield i, least[i], o


def _records(texts: list[bytes], wanted: list[list[dict]], docs: list, hashes: list[int], most: int) -> Iterator[tuple[int, int, tuple]]:
    for text, own, doc, th in zip(texts, wanted, docs, hashes, strict=True):
        for w in own:
            p = w["p"]
            flags = (w["m"] > 1) + 2 * (doc is None)
            yield w["part"], w["hot"], (text[p : p + w["r"]], text[max(0, p - most) : p][::-1], flags, doc or 0, th, p)


def _runs(span: int, run_bytes: int = 24 << 20):
    most = span // 2 - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, tuple]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0], x[1][0]))
            parts: dict[int, list] = {}
            for part, rec in held:
                parts.setdefault(part, []).append(rec)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([encode_run(r) for r in parts.values()], pa.binary())], names=["part", "run"])

        for b in batches:
            for part, _, rec in _records(b.column("text").cast(pa.binary()).to_pylist(), b.column("own").to_pylist(), b.column("doc_id").to_pylist(), b.column("th").to_pylist(), most):
                held.append((part, rec))
                size += len(rec[0]) + len(rec[1]) + 200
            if size > run_bytes:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _merged(span: int):
    share = span - span // 2 + GRAM

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, group = [], []

        def close() -> None:
            for i, low, high in verdicts(group, span) if len(group) > 1 else ():
                _, _, flags, doc, th, p = group[i][1]
                if not flags & 1:  # representatives of several anchors are covered anyway
                    out.append((None if flags & 2 else doc, th, p - high, p - low + span))
            group.clear()

        for h, rec in merge([decode_run(r) for r in pdf["run"]]):
            if h < share:
                close()
            group.append((h, rec))
        close()
        return pd.DataFrame({"doc_id": pd.array([x[0] for x in out], "Int64"), "th": pd.array([x[1] for x in out], "int64"), "s": pd.array([x[2] for x in out], "int32"), "e": pd.array([x[3] for x in out], "int32")})

    return run


def _window_digests(span: int):
    """For mids with too many wholes: the digest of every window with the offset of its anchor, so that a window which
    two anchors hold is not its own copy."""
    from xxhash import xxh3_128_digest as digest

    most = span // 2 - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, (a, before, flags, doc, th, p) in _records(b.column("text").cast(pa.binary()).to_pylist(), b.column("own").to_pylist(), b.column("doc_id").to_pylist(), b.column("th").to_pylist(), most):
                whole = before[::-1] + a
                for o in range(max(0, span - len(a)), len(before) + 1):
                    w = whole[len(before) - o : len(before) - o + span]
                    out.append((digest(w, o), None if flags & 2 else doc, th, p - o, flags & 1))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["w", "doc_id", "th", "s", "many"])

    return run


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def covered(docs: DataFrame, span: int = SPAN, hot: int = HOT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, th (hash of the text), runs: covered byte runs [s, e) of each text that has some, not yet merged; stored."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").filter(F.octet_length("text") >= span)
    found = store(map_batches(texts, _anchor_rows(span), "doc_id long, th long, p int, r short, mid long, whole long"))
    groups = found.groupBy("mid").agg(F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("n > 1")
    groups = store(groups.select("mid", "n", (F.col("lo") != F.col("hi")).alias("mixed")))
    total = found.count()
    known = store(skew_join(found, groups, ["mid"], "n", total, rows=hot_rows))
    release(spark)
    discard(found, groups)
    left = F.least(F.col("p"), F.lit(span // 2 - GRAM))
    all_of = [F.col("doc_id"), F.col("th"), (F.col("p") - left).alias("s"), (F.col("p") + F.col("r")).cast("int").alias("e")]
    classes = known.filter("mixed").groupBy("mid", "whole").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "th", "p", "r")).alias("rep"))
    classes = store(classes)
    several = classes.filter("m > 1").select("mid", "whole", "m")
    spans = known.filter(~F.col("mixed")).select(*all_of)
    spans = spans.unionByName(skew_join(known.filter("mixed"), several, ["mid", "whole"], "m", total, rows=hot_rows).select(*all_of))
    n = classes.count()
    done: list[DataFrame] = [known, classes]
    if n:
        parts = max(1, n // PART)
        many = classes.groupBy("mid").agg(F.count("*").alias("c")).filter(F.col("c") > hot)
        flagged = classes.join(many.select("mid", F.lit(1).alias("hot")), "mid", "left") if many.limit(1).count() else classes.withColumn("hot", F.lit(None).cast("int"))
        item = F.struct(F.col("rep.p").alias("p"), F.col("rep.r").cast("int").alias("r"), "m", F.pmod(F.xxhash64("mid"), F.lit(parts)).cast("int").alias("part"), F.coalesce("hot", F.lit(0)).alias("hot"))
        own = flagged.groupBy(F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")).agg(F.collect_list(item).alias("own"))  # a representative is one row, so within one text

        def with_text(which: int) -> DataFrame:
            some = own.withColumn("own", F.filter("own", lambda x: x["hot"] == which)).filter(F.size("own") > 0)
            return texts.join(some, _same(texts, some)).select(texts["doc_id"], texts["th"], "own", "text")

        runs = map_batches(with_text(0), _runs(span), "part int, run binary")
        merged = store(runs.repartition(parts, "part").groupBy("part").applyInPandas(_merged(span), "doc_id long, th long, s int, e int"))
        spans = spans.unionByName(merged)
        done.append(merged)
        release(spark)
        if flagged.filter("hot = 1").limit(1).count():
            rows = store(map_batches(with_text(1), _window_digests(span), "w binary, doc_id long, th long, s int, many int"))
            twice = rows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
            spans = spans.unionByName(rows.filter("many = 0").join(twice, "w").select("doc_id", "th", "s", (F.col("s") + span).alias("e")))
            done.append(rows)
    # A set: rows that repeat doc_id and text have the same runs, which count once.
    out = store(spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("runs")))
    discard(*done)
    return out


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def deduplicate(docs: DataFrame, span: int = SPAN, hot: int = HOT, with_kept: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, removed (the maximal runs) and kept (bytes left)."""
    runs = covered(docs, span, hot, hot_rows)
    release(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    joined = rows.join(runs, _same(rows, runs), "left").select(rows["doc_id"], "runs", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                text = text or b""
                cut = union([(r["s"], r["e"]) for r in own or ()])
                ends = [0, *(x for c in cut for x in c), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)) if cut else text
                out.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"s": x, "e": y} for x, y in cut], kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.binary()][: 6 if with_kept else 4]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: len(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([o[i] for o in out], t) for i, t in enumerate(types)]], names=["doc_id", *names])

    more = ", removed array<struct<s:int,e:int>>, kept binary" if with_kept else ""
    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 5 over the whole of documents."""
    return deduplicate(table(spark, sf_dir, "documents"), with_kept=False)
