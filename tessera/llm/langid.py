"""Language identification by compression against one zstandard raw-content dictionary per language.

A text is lower-cased and reduced to words of letters (with their combining marks) and single spaces, cut into blocks of `BLOCK`
bytes, and every block is compressed with each language's dictionary; the language with the smallest total wins. The score is
a logistic of the bits saved a byte against the runner-up; `accepted` is false under `reject`, where the margin is narrow.

Training: every language is learned, from a bounded sample of its rows: about `DICT_ROWS`, chosen by hash, fill a dictionary of
`DICT_BYTES`. These are rows of at most `ROW_BYTES` bytes, so that a dictionary holds many texts; a language with fewer gives
about `LONG_ROWS` longer ones too, of each at most its first `LONG_BYTES` characters. Prediction reads whole texts. Up to `BLOCK_LANGS` languages are compared in one pass;
more are compared in several, each handing its best two to the next.

Edge cases: null text, or text without a letter, gives `und` and score 0; without training rows all is `und`; one language
alone gets score 0.5; ties between languages go to the first name; null languages are not learned from; a kept column named
like a result gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import fields, kept, map_batches, store, table

DICT_ROWS, ROW_BYTES, DICT_BYTES, BLOCK_LANGS, BLOCK, LEVEL = 120, 4_000, 120_000, 200, 1_024, 9
LONG_ROWS, LONG_BYTES = 20, 12_000
REJECT = 0.05
RESULT = ("lang_pred", "score", "accepted")


def letters(text: str | None) -> bytes:
    """Words of letters; a word that repeats the one before is left out, as it says nothing more."""
    import regex

    words = regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()) if text else []
    return " ".join([w for w, before in zip(words, ["", *words]) if w != before]).encode("utf-8", "ignore")


def blocks(data: bytes, size: int = BLOCK) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def compressor(content: bytes, level: int = LEVEL):
    import zstandard as z

    made = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return z.ZstdCompressor(level=level, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)


def cost(c, parts: list[bytes]) -> int:
    return sum(len(c.compress(p)) for p in parts)


def uniform(*cols):
    """In [0, 1), from a hash of the columns."""
    text = F.concat_ws(":", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def fill(contents: list[bytes], most: int, between: bytes = b" ") -> tuple[bytes, int]:
    """(dictionary, number of contents in it): contents in order while there is room; the last one is cut to the room left."""
    out, n = [], 0
    for c in contents:
        if most <= 0:
            break
        out.append(c[:most])
        most -= len(c) + len(between)
        n += 1
    return between.join(reversed(out)), n


def sample(rows: DataFrame, label: str, per_label: int, row_bytes: int) -> dict:
    """About per_label texts of each label: rows of at most row_bytes first, by a hash below a threshold from their number. Labels
    with fewer of these get up to about LONG_ROWS longer ones too, of which a dictionary has room for LONG_BYTES each."""
    rows = rows.filter(F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col(label).alias("label"), (F.octet_length("text") <= row_bytes).alias("short"), uniform("doc_id", F.xxhash64("text")).alias("u"), "text")
    counts = rows.groupBy("label").agg(F.count_if("short").alias("n"), F.count_if(~F.col("short")).alias("n_long")).collect()  # a row for each dictionary to come
    if not counts:
        return {}
    shares = [(r[0], 1.5 * per_label / max(r[1], 1), 1.5 * LONG_ROWS / max(r[2], 1) if r[1] < per_label else 0.0) for r in counts]
    of = rows.sparkSession.createDataFrame(shares, "label string, short_share double, long_share double")
    chosen = rows.join(F.broadcast(of), "label").filter(F.col("u") < F.when(F.col("short"), F.col("short_share")).otherwise(F.col("long_share")))
    texts = chosen.select("label", "short", "u", F.substring("text", 1, LONG_BYTES).alias("text")).dropDuplicates(["label", "u", "text"])
    got: dict = {}
    for lab, short, u, text in texts.collect():
        got.setdefault(lab, []).append((not short, u, text))
    return {k: [t for *_, t in sorted(v)][: per_label] for k, v in sorted(got.items())}


def fit(rows: DataFrame, per_lang: int = DICT_ROWS) -> dict[str, bytes]:
    """rows: doc_id, text, lang. A dictionary for each language."""
    made = {lang: fill([letters(t) for t in texts], DICT_BYTES)[0] for lang, texts in sample(rows, "lang", per_lang, ROW_BYTES).items()}
    return {lang: content for lang, content in made.items() if len(content) >= 8}


def best_two(parts: list[bytes], models: list[tuple[str, object]], before: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(bytes, language) of the best two of these languages and of those before."""
    return sorted([*before, *((cost(c, parts), lang) for lang, c in models)])[:2]


def verdict(data: bytes, best: list[tuple[int, str]]) -> tuple[str, float]:
    if not data or not best:
        return "und", 0.0
    if len(best) == 1:
        return best[0][1], 0.5
    gain = (best[1][0] - best[0][0]) / (len(data) + 16)  # 16 bytes: short texts are less sure
    return best[0][1], max(0.0, min(1.0, 2 / (1 + math.exp(-30 * gain)) - 1))


def identify(docs: DataFrame, model: dict[str, bytes], keep: list[str] | None = None, reject: float = REJECT, block_langs: int = BLOCK_LANGS) -> DataFrame:
    """docs' columns `keep` with lang_pred, score and accepted."""
    keep = kept(keep, RESULT)
    names = sorted(model)
    passes = [names[i : i + block_langs] for i in range(0, len(names), block_langs)] or [[]]
    types = fields(docs, keep)
    pair = pa.struct([("n", pa.int64()), ("lang", pa.string())])

    def one(rows: DataFrame, langs: list[str], first: bool, last: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in langs})  # at most block_langs * DICT_BYTES = 24 MB

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = [(k, compressor(v)) for k, v in sorted(shared.value.items())]
            for b in batches:
                own = [b.column(i) for i in range(len(keep))]
                data = [letters(t) for t in b.column("text_to_judge").to_pylist()]
                had = [[]] * len(data) if first else [[(x["n"], x["lang"]) for x in v] for v in b.column("best_two").to_pylist()]
                best = [best_two(blocks(x), models, v) if x else [] for x, v in zip(data, had, strict=True)]
                if last:
                    got = [verdict(x, v) for x, v in zip(data, best, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([k for k, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), pa.array([s >= reject for _, s in got], pa.bool_())], names=[*keep, *RESULT])
                else:
                    yield pa.RecordBatch.from_arrays([*own, b.column("text_to_judge"), pa.array([[{"n": n, "lang": k} for n, k in v] for v in best], pa.list_(pair))], names=[*keep, "text_to_judge", "best_two"])

        return map_batches(rows, run, types + ("lang_pred string, score double, accepted boolean" if last else "text_to_judge string, best_two array<struct<n:long,lang:string>>"))

    rows = docs.select(*keep, F.col("text").alias("text_to_judge"))
    for i, langs in enumerate(passes):
        rows = one(rows, langs, i == 0, i == len(passes) - 1)
        if i < len(passes) - 1:
            rows = store(rows)
    return rows


def held_out(modulus: int, rest: int):
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 7 over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(5, 0)).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "accepted")
