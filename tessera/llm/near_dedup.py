"""MinHash near-duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded and verified.

1. Shingles are five consecutive words (runs of letters, digits and non-ASCII bytes, A-Z folded; a text of one to four words
   is one shingle), hashed to 64 bits with numpy over a whole batch; repeats count as weight.
2. Signature. The weight axis is cut at 1, 2, 4, 8, ...; each (shingle, interval) has its own Poisson process, seeded by the
   two, whose points carry a register and a weight level. A point counts if its level is below the shingle's weight, so
   equal weight shares get equal points; a register keeps its earliest point. Points come in order of time and stop once
   they are later than all registers of the text. The chance that a register is equal is the weighted Jaccard similarity.
3. Texts of equal multisets are one node (by a 128-bit digest), so exact copies are never compared.
4. Bands of `ROWS` registers give buckets. A bucket's nodes are compared with a few of it, first by their signatures (one byte a
   register), and pairs that agree in `ESTIMATE` of the registers are verified by the exact overlap of their multisets. Linked
   nodes form components. A bucket with at most R nodes outside its largest component has these compared with all its
   nodes, and is done; otherwise the nodes outside are compared with R of the largest component, and R grows 64-fold for the
   next round. The R are those of the largest buckets in sum: the text that many copies come from is met first. So every
   pair of a bucket that is not yet known to be in one component is compared, while a group of thousands of like texts
   costs comparisons in proportion. The few come before the rest in a sorted partition, `BLOCK` at a time; nothing joins
   nodes to pairs.
   From the second round on nodes also carry the `SKETCH` least hashes of their multisets, which for a text with no more
   shingles are the whole multiset: its similarities are known at once. Of several sure partners in one component the best
   is enough. Of longer texts, pairs are sure from an estimated similarity of `DOUBT` above the threshold, and are verified
   from as much below.
5. Components are found by alternating large-star and small-star steps on edge tables, a shuffle each, until all are stars.

With 24 bands of 5, a pair at the threshold of 0.8 shares a bucket with probability 0.9999; it agrees in fewer than 0.65 of
120 registers with probability 0.00005, and a sketch's estimate is off by `DOUBT` with probability 0.000002.

Rows are keyed by doc_id, an integer, with a hash of the text. Equal texts, or a class, with a great part of all rows are joined by
broadcast of their one row, so no task gets all of them. Edge cases: null and wordless texts are linked to nothing and form a
class each (rows that repeat such a doc_id and text share it); repeated rows are in one class; an empty table gives no rows;
extra columns go no further, but for keep_first, which gives all back whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import HOT_ROWS, HOT_SHARE, discard, map_batches, release, renamed, skew_join, store, table
from tessera.llm.decontaminate import FOLD

WORDS, THRESHOLD, BANDS, ROWS, ESTIMATE = 5, 0.8, 24, 5, 0.65
SKETCH, DOUBT, BLOCK = 1024, 0.06, 512
#: Edges and places in buckets are some 50 bytes each: a key of them is hot from so many times HOT_ROWS.
NARROW = 20
#: Text bytes that are signed at once; the arrays of points take some 40 times as much.
SIGN_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
U = np.uint64
END = U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), sorted, with repeats."""
    data = b" ".join((t or b"").translate(FOLD) for t in texts) + b" "
    a = np.frombuffer(data, np.uint8)
    ends_of_texts = np.cumsum([len(t or b"") + 1 for t in texts])
    inside = a != 32
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U)
    # Polynomial hash of every word from prefix sums, modulo 2 ** 64.
    power = np.cumprod(np.full(len(a), BASE, U))
    back = np.cumprod(np.full(len(a), pow(BASE, -1, 1 << 64), U))
    sums = np.cumsum((a.astype(U) + U(1)) * power)
    word = mix((sums[end - 1] - np.where(start > 0, sums[start - 1], U(0))) * back[start] + (end - start).astype(U))
    text = np.searchsorted(ends_of_texts, start, "right")
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count
    n = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), n)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(doc), U)
    for k in range(words):
        there = k < count[doc]
        h += np.where(there, word[np.minimum(at + k, len(word) - 1)] * U((2 * k + 3) * BASE & (1 << 64) - 1), U(0))
    h = mix(h)
    order = np.lexsort((h, doc))
    return doc[order], h[order]


def weights(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, hash) and their counts."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return doc[first], h[first], np.diff(np.r_[first, len(h)])


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Earliest points by text and register; infinite for texts without shingles."""
    out = np.full((n_docs, registers), np.inf)
    if not len(h):
        return out
    sizes = np.bincount(doc, minlength=n_docs)
    # The processes of each shingle: intervals [0, 1), [1, 2), [2, 4), ... up to its weight.
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    row = np.repeat(np.arange(len(h)), levels)
    k = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    width = np.maximum(low, 1)
    seed = mix(h[row] + k.astype(U) * U(0xD1342543DE82EF95))
    flat = out.reshape(-1)
    for few in (True, False):  # texts of few shingles need many points from each: 32 at a time
        own = np.flatnonzero((sizes[doc[row]] < 128) == few)
        step = 32 if few else 1
        d, s, lo, wd, w = doc[row][own], seed[own], low[own], width[own], count[row][own]
        t, j = np.zeros(len(own)), 0
        while len(d):
            n = np.arange(1, step + 1, dtype=U) + U(j)
            a = mix(s[:, None] + n * U(2 * BASE + 1 & (1 << 64) - 1))
            b = mix(s[:, None] ^ n * U(0xA0761D6478BD642F))
            gap = -np.log(((a >> U(11)).astype(float) + 0.5) * 2.0**-53) / (registers * wd[:, None])
            at = t[:, None] + np.cumsum(gap, axis=1)
            register = ((b >> U(32)) * U(registers) >> U(32)).astype(np.int64)
            level = lo[:, None] + (b & (wd[:, None] - 1).astype(U)).astype(np.int64)
            ok = level < w[:, None]
            np.minimum.at(flat, (d[:, None] * registers + register)[ok], at[ok])
            t, j = at[:, -1], j + step
            go = t < out.max(axis=1)[d]
            d, s, lo, wd, w, t = (x[go] for x in (d, s, lo, wd, w, t))
    return out


def _signed(texts: list[bytes | None]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Node digest (None without shingles), band hashes and register bytes of every text."""
    from xxhash import xxh3_128_digest

    doc, h = shingles(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    nodes = [xxh3_128_digest(h[x:y].tobytes()) if y > x else None for x, y in zip(cut, cut[1:], strict=False)]
    sig = signatures(*weights(doc, h), len(texts), BANDS * ROWS).view(U).reshape(len(texts), BANDS, ROWS)
    band = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), (len(texts), BANDS)).copy()
    for k in range(ROWS):
        band = mix(band * U(BASE) + sig[:, :, k])
    return nodes, band.view(np.int64), mix(sig).astype(np.uint8).reshape(len(texts), -1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, band, sig = _signed(b.column("text").cast(pa.binary()).to_pylist())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS), pa.int32()), pa.array(band.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(nodes, pa.binary()), bands, pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "th", "node", "bands", "sig"])


def multiset(text: bytes | None) -> np.ndarray:
    """The shingles of a text with repeats numbered, as one set of hashes."""
    _, h = shingles([text])
    if not len(h):
        return h
    first = np.r_[True, h[1:] != h[:-1]]
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return np.where(nth > 0, mix(h + nth.astype(U) * U(0xD1342543DE82EF95)), h)


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Six bytes a shingle, in order: enough to tell the shingles of two texts apart."""
    for b in batches:
        sets = [np.sort(multiset(t)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("sig"), pa.array(sets, pa.binary())], names=["node", "sig", "set"])


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def similarity(x: bytes, y: bytes) -> float:
    a, b = len(x) // 6, len(y) // 6
    if not a or not b:
        return 0.0
    both = np.sort(unpacked(x + y))
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (a + b - same)


class Few:
    """The nodes of a block, to be compared with one node after the other."""

    def __init__(self, own: list[dict]):
        self.names, self.comps = [x["node"] for x in own], np.array([x["comp"] for x in own], object)
        self.sigs = np.frombuffer(b"".join(x["sig"] for x in own), np.uint8).reshape(len(own), -1)
        if own[0]["sketch"] is None:
            return
        self.sketches = [unpacked(x["sketch"]) for x in own]
        self.sizes, self.whole = np.array([len(x) for x in self.sketches]), np.array([x["n"] <= SKETCH for x in own])
        self.last = np.array([END if w else x[-1] for x, w in zip(self.sketches, self.whole, strict=True)], U)
        hashes, owner = np.concatenate(self.sketches), np.repeat(np.arange(len(own)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def agreeing(self, node: dict) -> np.ndarray:
        """Those of other components whose signatures agree enough."""
        return np.flatnonzero(((self.sigs == np.frombuffer(node["sig"], np.uint8)).mean(axis=1) >= ESTIMATE) & (self.comps != node["comp"]))

    def similarities(self, sketch: np.ndarray, whole: bool, at: np.ndarray) -> np.ndarray:
        """To those at `at`, by the hashes up to the last that both sketches reach, all of them if both are whole."""
        low, high = np.searchsorted(self.hashes, sketch, "left"), np.searchsorted(self.hashes, sketch, "right")
        n = high - low
        hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = np.bincount(self.owner[hit], minlength=len(self.names))[at]
        end = np.minimum(self.last[at], END if whole else sketch[-1])
        x, y = np.searchsorted(sketch, end, "right"), self.sizes[at]
        for k in np.flatnonzero(end < END):
            y[k] = np.searchsorted(self.sketches[at[k]], end[k], "right")
        return same / np.maximum(x + y - same, 1)

    def partners(self, node: dict, threshold: float) -> list[bytes]:
        """Those that node is to be verified with: of sure ones the best of each component, and all in doubt."""
        at = self.agreeing(node)
        if node["sketch"] is None or not len(at):
            return [self.names[i] for i in at]
        whole = node["n"] <= SKETCH
        best: dict[bytes, tuple[float, bytes]] = {}
        doubt = []
        for i, s in zip(at, self.similarities(unpacked(node["sketch"]), whole, at), strict=True):
            margin = 0.0 if whole and self.whole[i] else DOUBT
            if s >= threshold + margin:
                best[self.comps[i]] = max(best.get(self.comps[i], (0.0, b"")), (s, self.names[i]))
            elif s >= threshold - margin and margin:
                doubt.append(self.names[i])
        return doubt + [x for _, x in best.values()]


def _compare(threshold: float):
    """Pairs to verify of rows in order of (key, part, salt), a block's few before the nodes that are compared with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, few = None, [], None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["key"], r["part"], r["salt"]) != at:
                    at, own, few = (r["key"], r["part"], r["salt"]), [], None
                if not r["asked"]:
                    own.append(r)
                elif own:
                    few = few or Few(own)
                    out += [(min(r["node"], x), max(r["node"], x)) for x in few.partners(r, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = [similarity(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            good = pa.array(np.flatnonzero(np.array(sims) >= threshold))
            yield pa.RecordBatch.from_arrays([b.column(k).take(good) for k in ("a", "b")], names=["a", "b"])

    return run


def _least(rows: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """Distinct rows (u, v) with m, the least v of their u. One shuffle; the rows of hot u, if there are any, are not moved to one task."""
    by_u = Window.partitionBy("u").orderBy("v")
    windowed = lambda x: x.withColumns({"m": F.first("v").over(by_u), "before": F.lag("v").over(by_u)}).filter("before is null or before != v").select("u", "v", "m")
    bound = max(NARROW * hot_rows, total // HOT_SHARE)
    if total <= bound:
        return windowed(rows)
    hot = store(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).filter(F.col("n") > bound).select("u", "m"))
    if not hot.limit(1).count():
        return windowed(rows)
    return rows.distinct().join(F.broadcast(hot), "u").select("u", "v", "m").unionByName(windowed(rows.join(F.broadcast(hot.select("u")), "u", "left_anti")))


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """node, comp (the least node of the component) of all nodes that edges (a, b) touch."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    total, small = edges.count(), None
    while True:
        # Large star: greater neighbours move to the least of all. Of a node with several lesser ones a row without v tells.
        both = _least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * total, hot_rows).filter("v > u or v > m")
        moved, root = F.col("m") < F.col("u"), (F.col("v") == F.col("m")) & (F.col("m") > F.col("u"))
        large = store(both.select(F.greatest("u", "v").alias("u"), F.when(F.col("v") > F.col("u"), F.least("u", "m")).alias("v"), moved.alias("moved"), root.alias("root")))
        discard(small)
        total, changed = large.agg(F.count("v"), F.max("moved")).first()
        if not changed:  # all components are stars, and these are their edges, once each
            return large.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(large.filter("root").select(F.col("v").alias("node"), F.col("v").alias("comp")))
        # Small star: lesser neighbours and the node itself move to the least of them.
        least = _least(large.filter("v is not null").select("u", "v"), total, hot_rows)
        edges = small = store(least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
        discard(large)
        total = edges.count()


def _opened(placed: DataFrame, hot: bool) -> DataFrame:
    """Rows of the buckets with nodes of several components: whether a row is inside the largest component, how many are not
    (odd), and how many there are (all). One shuffle by bucket, which gives places (i) too, among a bucket's rows inside and among the
    others; with hot buckets, aggregates and a join that Spark can split, without i."""
    if hot:
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max("score").alias("score"))
        main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "score", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).filter("all > most")
        rows = placed.join(main, "key")
    else:
        bucket, part = Window.partitionBy("key"), Window.partitionBy("key", "comp")
        rows = placed.withColumn("all", F.count("*").over(bucket)).withColumns({"n": F.count("*").over(part), "best": F.max("score").over(part)})
        rows = rows.withColumns({"main": F.max_by("comp", F.struct("n", "best", "comp")).over(bucket), "most": F.max("n").over(bucket)}).filter("all > most")
    rows = rows.select("key", "node", "score", "comp", (F.col("comp") == F.col("main")).alias("inside"), (F.col("all") - F.col("most")).alias("odd"), "all")
    return rows if hot else rows.withColumn("i", F.row_number().over(Window.partitionBy("key", "inside").orderBy(F.desc("score"), "node")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, th (hash of the text), node and comp of every row; comp is null where a text has no shingles."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    signed = store(map_batches(texts, _sign, "doc_id long, th long, node binary, bands array<long>, sig binary", SIGN_BYTES))
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("bands").alias("bands"), F.min("sig").alias("sig"), F.count("*").alias("copies"))
    nodes = store(nodes)
    rows = nodes.select("node", F.explode("bands").alias("key"))
    several = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    member = store(rows.join(several, "key"))
    n_member, largest = member.agg(F.count("*"), F.max("n")).first()
    hot = (largest or 0) > max(NARROW * hot_rows, n_member // HOT_SHARE)
    used = store(member.groupBy("node").agg(F.sum("n").alias("score")))
    member = member.select("key", "node").join(used, "node")
    used = used.join(nodes.select("node", "rep", "sig"), "node").select(F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("h"), "node", "sig")
    with_text = texts.join(used, texts["doc_id"].eqNullSafe(used["d"]) & (texts["th"] == used["h"])).select("node", "sig", "text")
    sets = store(map_batches(with_text, _multisets, "node binary, sig binary, set binary"))
    if _repeats(signed):
        sets = store(sets.dropDuplicates(["node"]))
    release(spark)

    def linked(pairs: DataFrame) -> DataFrame:
        with_x = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        with_y = with_x.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        ratio = F.octet_length("x") / F.octet_length("y")  # sizes alone bound the similarity
        return map_batches(with_y.filter((ratio >= threshold) & (ratio <= 1 / threshold)).select("a", "b", "x", "y"), _verify(threshold), "a binary, b binary")

    comp = None
    few = 1
    while True:
        placed = member if comp is None else member.join(comp, "node", "left")
        placed = placed.withColumn("comp", F.col("node") if comp is None else F.coalesce("comp", "node"))
        open_ = store(_opened(placed, hot))
        # Blocks: the few in parts of BLOCK, each beside every salt of the nodes that are compared with them.
        salts, parts = F.floor(F.col("all") / (8 * BLOCK)), F.floor((F.least("all", F.lit(few)) - 1) / BLOCK)
        chosen = open_.filter((F.col("odd") <= few) != F.col("inside"))
        chosen = (chosen.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "node"))) if hot else chosen).filter(F.col("i") <= few)
        chosen = chosen.select("key", F.floor((F.col("i") - 1) / BLOCK).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt"), F.lit(False).alias("asked"), "node", "comp")
        asked = open_.filter((F.col("odd") <= few) | ~F.col("inside")).withColumn("salt", F.pmod(F.xxhash64("node"), salts + 1))
        asked = asked.select("key", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"), "salt", F.lit(True).alias("asked"), "node", "comp")
        # Signatures do for the comparison with one node of each bucket; later rounds have fewer buckets.
        sketch, n = (F.lit(None).cast("binary"), F.lit(None).cast("long")) if comp is None else (F.substring("set", 1, 6 * SKETCH), F.floor(F.octet_length("set") / 6))
        block = chosen.unionByName(asked).join(sets.select("node", "sig", sketch.alias("sketch"), n.alias("n")), "node")
        block = block.repartition("key", "part", "salt").sortWithinPartitions("key", "part", "salt", "asked")
        found = store(linked(map_batches(block, _compare(threshold), "a binary, b binary").distinct()))
        if comp is None or found.limit(1).count():
            stars = found if comp is None else found.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))
            comp = components(stars, hot_rows)
        member = open_.filter(F.col("odd") > few).select("key", "node", "score")
        release(spark)
        if member.limit(1).count() == 0:
            break
        few *= 64
    placed = store(comp.join(nodes.select("node", "copies"), "node"))
    rows = skew_join(signed.select("doc_id", "th", "node"), placed, ["node"], "copies", signed.count(), "left", hot_rows)
    return rows.select("doc_id", "th", "node", F.coalesce("comp", "node").alias("comp"))


def _repeats(signed: DataFrame) -> bool:
    """Whether some row repeats both doc_id and text."""
    return signed.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count() > 0


def assign(docs: DataFrame, threshold: float = THRESHOLD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, th, class_id (least doc_id of the class) and first (whether the row is the class's least doc_id and text)."""
    key = F.coalesce(F.hex("comp"), F.concat_ws(":", F.lit("alone"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("th").cast("string")))
    keyed = store(classes(docs, threshold, hot_rows).select("doc_id", "th", key.alias("key")))
    least = keyed.groupBy("key").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("a"), F.min(F.struct("doc_id", "th")).alias("b"), F.count("*").alias("n"))
    least = store(least.select("key", F.coalesce("a", "b").alias("least"), "n"))
    rows = skew_join(keyed, least, ["key"], "n", keyed.count(), rows=hot_rows)
    return rows.select("doc_id", "th", F.col("least.doc_id").alias("class_id"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))).alias("first"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs of each class, all columns; of rows that repeat doc_id and text, one stays."""
    rows = store(assign(docs, threshold).filter("first").select("doc_id", "th"))
    twice = rows.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count() > 0
    chosen = rows.distinct().select(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th"))
    safe, back = renamed(docs, "doc_id", "text")
    kept = safe.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_th")))
    return (kept.dropDuplicates(["kept_id", "kept_th"]) if twice else kept).select(*back)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its class of near-duplicates, named by the least doc_id."""
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
