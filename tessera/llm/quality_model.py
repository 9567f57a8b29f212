"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text, and a calibrated score.

Two views of a text are compressed in blocks with either class's raw-content dictionary: the text itself, and its
shape, where every word becomes a letter for its form (plain, capitalised, upper case, digits, symbols, attached
symbols), in another row if the word equals the one before or the three words ending there have occurred before. The
normalised size difference (bad - good) / (bad + good) of each view goes into a logistic regression fitted on labelled
rows that the dictionaries have not seen, which gives a probability of label 1.

Fitting takes a bounded sample of labelled rows: `DICT_ROWS` + `CALIBRATE_ROWS` a label, chosen by a hash of doc_id. Rows
of at most `ROW_BYTES` bytes among the first `DICT_ROWS` fill the dictionaries of `DICT_BYTES` (if there is none, the first
`ROW_BYTES` characters of longer ones); the rows after these calibrate, with their whole texts, which executors score. Only ids and labels are joined and counted; texts are fetched for the sample alone. Label
counts reweight the sample back to the prior.

Edge cases: null or empty text has both differences 0 and gets the score that gives; with labels of one class only, or
none, the score is the prior (0.5 without rows); a document with several labels is learned from once for each; rows that
repeat a doc_id are all learned from, up to the sample's bound; a kept column named like a result gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import discard, fields, kept, map_batches, store, table
from tessera.llm.langid import blocks, compressor, cost, fill, held_out, uniform

DICT_ROWS, CALIBRATE_ROWS, ROW_BYTES, DICT_BYTES = 500, 1_000, 4_000, 120_000
#: (bytes of a block, zstandard level) for the text and for its shape. A shape's blocks are so small that nearly all of the
#: work is left to the dictionary: in longer ones repeated text compresses by itself, as well with either dictionary.
RAW, SHAPE = (1_024, 3), (12, 12)
THRESHOLD = 0.7
RESULT = ("score", "raw_diff", "shape_diff")


def word_shape(w: str) -> int:
    if w.isalpha():
        return 0 if w.islower() else 1 if w.istitle() or len(w) == 1 else 2 if w.isupper() else 3
    core = w.rstrip(".,;:")
    if core.isalpha():
        return 4 if core.islower() else 5 if core.istitle() or len(core) == 1 else 6
    if not any(c.isalnum() for c in w):
        return 7
    core = w.rstrip("!?#*$%&|<>")
    if core != w:
        return 8 if core.upper() == core else 9
    return 10 if any(c.isdigit() for c in w) else 11


def shape(text: str) -> bytes:
    """A byte a word; a newline for each line end. Rows of 12 letters: new, seen as part of three words, repeated."""
    out, seen, cache = bytearray(), set(), {}
    a = b = ""
    for line in text.split("\n"):
        for w in line.split():
            if (s := cache.get(w)) is None:
                s = cache[w] = word_shape(w)
            three = (a, b, w)
            out.append(33 + s + (24 if w == b else 12 if three in seen else 0))
            seen.add(three)
            a, b = b, w
        out.append(10)
    return bytes(out[:-1])


class Model(NamedTuple):
    raw: tuple[bytes, bytes] | None  # contents of the bad and the good dictionary
    form: tuple[bytes, bytes] | None
    weights: tuple[float, ...]  # bias, raw, form


def pairs(raw: tuple[bytes, bytes], form: tuple[bytes, bytes]) -> list[tuple]:
    """Compressors (bad, good) of either view."""
    return [tuple(compressor(v, level) for v in contents) for contents, (_, level) in ((raw, RAW), (form, SHAPE))]


def differences(text: str | None, raw, form) -> tuple[float, float]:
    """Normalised differences of the views; compressors are pairs (bad, good)."""
    out = []
    for data, (size, _), (bad, good) in (((text or "").encode("utf-8", "ignore"), RAW, raw), (shape(text or ""), SHAPE, form)):
        if not data:
            out.append(0.0)
            continue
        parts = blocks(data, size)
        x, y = cost(bad, parts), cost(good, parts)
        out.append((x - y) / (x + y))
    return out[0], out[1]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for weighted logistic regression; x has the bias column."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return beta


def sampled(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame | None, dict[int, int]]:
    """A stored table (quality, u, text) of at most 1.3 * per_label labelled rows a label, lowest hash first, and the labels'
    counts. docs: doc_id, text; labels: doc_id, quality."""
    quality = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    ids = docs.select("doc_id").join(quality, "doc_id")
    ids = store(ids.withColumn("u", uniform("doc_id")))
    counts = {r[0]: r[1] for r in ids.groupBy("quality").count().collect()}
    if len(counts) < 2:
        discard(ids)
        return None, counts
    most = int(1.3 * per_label)
    wanted = None
    for q, n in sorted(counts.items()):  # the least `most` hashes of a label, of those under a threshold that its count gives
        some = ids.filter((F.col("quality") == q) & (F.col("u") < min(1.0, 1.6 * per_label / n))).orderBy("u", "doc_id").limit(most)
        wanted = some if wanted is None else wanted.unionByName(some)
    wanted = store(wanted.distinct())  # at most 2 * most rows
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts = [rows.filter(F.col("quality") == q).orderBy("u", "doc_id", "h").limit(most) for q in counts] if docs_repeat(ids, wanted) else [rows]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = store(out.select("quality", "u", "doc_id", "h", "text"))
    discard(ids, wanted)
    return out, counts


def docs_repeat(ids: DataFrame, wanted: DataFrame) -> bool:
    """Whether a sampled id stands in several rows: then their number needs its own bound."""
    return ids.join(F.broadcast(wanted.select("doc_id", "quality")), ["doc_id", "quality"]).count() > wanted.count()


def fit(docs: DataFrame, labels: DataFrame, per_label: int = DICT_ROWS, calibrate: int = CALIBRATE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1; other rows count for nothing)."""
    rows, counts = sampled(docs, labels, per_label + calibrate)
    n = sum(counts.values())
    if rows is None:
        p = min(max(counts.get(1, 0) / n if n else 0.5, 0.01), 0.99)
        return Model(None, None, (math.log(p / (1 - p)), 0.0, 0.0))
    order = sorted((r[0], r[1], str(r[2]), r[3], r[4] or 0) for r in rows.select("quality", "u", "doc_id", "h", F.octet_length("text")).collect())
    roles = []
    for q in (0, 1):
        own = [x for x in order if x[0] == q]
        first = own[: min(per_label, max(1, len(own) // 2))]
        some_short = any(x[4] <= ROW_BYTES for x in first)
        roles += [(x[0], x[2], x[3], x[1], x[4] <= ROW_BYTES or not some_short) for x in first]
    asked = docs.sparkSession.createDataFrame(roles, "quality int, d string, h long, at double, in_dict boolean")  # at most 2 * per_label
    marked = rows.withColumn("d", F.col("doc_id").cast("string")).join(F.broadcast(asked), ["quality", "d", "h"], "left")
    texts = sorted((r[0], r[1], r[2], r[3] or "") for r in marked.filter("in_dict").select("quality", "at", "h", F.substring("text", 1, ROW_BYTES)).collect())
    own = [[t for c, _, _, t in texts if c == q] for q in (0, 1)]
    raw = tuple(fill([t.encode("utf-8", "ignore") for t in v], DICT_BYTES, b"\n")[0].ljust(8) for v in own)
    form = tuple(fill([shape(t) for t in v], DICT_BYTES, b"\n")[0].ljust(8) for v in own)
    left = marked.filter("in_dict is null").select("quality", "text")
    if left.select("quality").distinct().count() < 2:  # too few rows to spare some
        left = rows.select("quality", "text")
    got = score(left, Model(raw, form, (0.0, 0.0, 0.0)), ["quality"]).select("quality", "raw_diff", "shape_diff").collect()
    got = sorted(tuple(r) for r in got)  # whatever the order of tasks, the same sums
    discard(rows)
    of = {q: sum(r[0] == q for r in got) for q in (0, 1)}
    x = np.array([(1.0, a, b) for _, a, b in got])
    w = np.array([counts[q] / n / of[q] * len(got) for q, _, _ in got])
    return Model(raw, form, tuple(float(b) for b in _logistic(x, np.array([float(q) for q, _, _ in got]), w)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` with score, the probability of label 1, and the two differences."""
    keep = kept(keep, RESULT)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # at most 4 * DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, form, weights = shared.value
        tools = pairs(raw, form) if raw else None
        for b in batches:
            x = np.array([differences(t, *tools) if tools else (0.0, 0.0) for t in b.column("text").to_pylist()]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ np.array(weights[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(p), pa.array(x[:, 0]), pa.array(x[:, 1])], names=[*keep, *RESULT])

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, fields(docs, keep) + "score double, raw_diff double, shape_diff double")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows whose labels may be learned from."""
    return docs.select("doc_id", "text").filter(~held_out(4, 2))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 10 over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs), table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
