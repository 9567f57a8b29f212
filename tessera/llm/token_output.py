"""Token ids in binary: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Format (a folder; Parquet carries the rows, so that any store Spark reaches will do):
  ranks/   id, n, rank    - every id that occurs, by falling count, ties by id; rank 0 is the most frequent
  blocks/  part, block, doc_ids, lengths, n_ids, control, data - documents in ascending order by (part, block); block is
           the place of its first row in the part's run
  index/   part, block, start - ids in all blocks before
A block codes the ranks of its ids: two control bits an id give 1 to 4 data bytes, four ids a control byte, low bits first,
data little-endian. Decoding looks the four lengths of a control byte up in a table and gathers the data bytes with numpy.

Encoding keeps the ids of each word between white space of lower-cased text, if the tokenizer file says that its steps
allow that: white space is dropped and never joined across, and case is folded. So a text's ids are its words' ids in a row, and
a batch looks up every different word once, without the punctuation at its end, which is a word of its own. Arrow splits texts,
numbers words and looks them up; Python sees only words that are not in the worker's table. That holds about 40 bytes a word, WORDS
words and those of one batch at most; beyond that those met in the fewest batches lately go, and are encoded anew if they come again.
Texts that hold a special token's string, and all texts of a file with other steps, are encoded in one piece.

Parts are ranges of doc_id from quantiles; ids of each are sorted within the part. Nulls of doc_id come first. Rows of
equal doc_id stand in the order of their ids. Edge cases: null and empty text give the end id alone; an empty table
gives an empty folder of blocks and no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import string
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import HELD, discard, map_batches, release, shared_dir, store, table

END_ID = 1
#: Words that a worker's table holds, words that stay when it is full, bytes of a word that is kept.
WORDS, STAY, WORD_BYTES = 200_000, 130_000, 64
#: Words whose ids are gathered at once.
GATHERED = 65_536
#: Ids after which a block ends; a longer document is a block by itself. A reader has hundreds of blocks in memory.
BLOCK_IDS = 32_768
#: Lengths of the four values of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: The steps that let a text be encoded word by word: white space of any kind is one space, case is folded, and pre-tokens are
#: runs of letters, digits or marks, or a clitic; what is no pre-token, white space, is removed.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
#: Byte-level models name the bytes that are no visible Latin-1 character by those from U+0100 on, in order. The line break stays,
#: as it parts the words here.
BYTE_NAMES = np.arange(256, dtype="<u2")
BYTE_NAMES[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(0x100, 0x144)
BYTE_NAMES[10] = 10
LETTERS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
BEYOND = re.compile("[^\0-\u017f]").search


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_words(path: str) -> bool:
    """Whether the file's normaliser and pre-tokeniser are the steps named above."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split, *rest = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    by_bytes = len(rest) == 1 and BYTES.items() <= rest[0].items()
    return by_bytes and (made.get("normalizer") or {}).get("normalizers") == NORMALISER and split.get("pattern") == {"Regex": PRE_TOKENS} and (split.get("behavior"), split.get("invert")) == ("Removed", True)


def lower(text: str) -> str:
    """The lower case that the normaliser makes; letters whose lower case depends on their place are left to the library."""
    return text if "Σ" in text or "İ" in text else text.lower()


def encoder(path: str) -> Encoder:
    """One a worker process, so that its words last from task to task."""
    made = sys.modules.setdefault(HELD, types.ModuleType(HELD)).__dict__
    return made.get(path) or made.setdefault(path, Encoder(path))


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = "<u2" if max(self.tokenizer.get_vocab().values()) < 65536 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        # The table: words, how many ids each has, the ids of all in a row, and the batches a word was in, lately.
        self.words, self.size, self.known, self.hits = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, self.width), np.zeros(0, np.int32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def made(self, words: list[str]) -> list[bytes]:
        """Ids of words that the table lacks. Lower-case letters up to U+017F are a pre-token as they are: the library's model takes
        them, by the names of their bytes, without the steps before it."""
        out, latin, rest = {}, [], []
        tokenize, packed = self.tokenizer.model.tokenize, self.packed
        for w in words:
            if not (w.isalpha() and w.islower()):
                rest.append(w)
            elif w.isascii():
                out[w] = packed([t.id for t in tokenize(w)])
            else:
                (rest if BEYOND(w) else latin).append(w)
        if latin:
            named = BYTE_NAMES[np.frombuffer("\n".join(latin).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n")
            for w, name in zip(latin, named, strict=True):
                out[w] = packed([t.id for t in tokenize(name)])
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[w] = packed(e.ids)
        return [out[w] for w in words]

    def look_up(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, all in a row, and how many each has; the table learns words that it lacks."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        lacks = at < 0
        self.hits[at[~lacks]] += 1
        if lacks.any():
            new = words.filter(pa.array(lacks))
            raw = self.made(new.to_numpy(zero_copy_only=False).tolist())
            at[lacks] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.size = np.concatenate([self.size, np.fromiter(map(len, raw), np.int32, len(raw)) // int(self.width[-1])])
            self.known = np.concatenate([self.known, np.frombuffer(b"".join(raw), self.width)])
            self.hits = np.concatenate([self.hits, np.ones(len(raw), np.int32)])
        out, size = gather(self.known, self.size, at), self.size[at]
        stay = pc.binary_length(self.words).to_numpy() <= WORD_BYTES
        if stay.sum() > WORDS:
            order = np.flatnonzero(stay)
            stay[order[np.argsort(self.hits[order], kind="stable")[:-STAY]]] = False
            self.hits //= 2
        if not stay.all():
            kept = np.flatnonzero(stay)
            self.known, self.words = gather(self.known, self.size, kept), self.words.take(pa.array(kept))
            self.size, self.hits = self.size[kept], self.hits[kept]
        return out, size

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, in `width`."""
        if not self.by_words:
            return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        low = [lower(t) if t else "" for t in texts]
        whole = {i for i, (t, x) in enumerate(zip(texts, low, strict=True)) if x and any(s in t or s in x for s in self.special)}
        split = pc.ascii_split_whitespace(pa.array(["" if i in whole else x for i, x in enumerate(low)], pa.string()))
        place = split.values.dictionary_encode()
        pieces = halves(place.dictionary).dictionary_encode()
        ids, size = self.look_up(pieces.dictionary)
        ids = gather(ids, size, pieces.indices.to_numpy())
        size = size[pieces.indices.to_numpy()].reshape(-1, 2).sum(1, dtype=np.int32)
        at = place.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[at], dtype=np.int64)])[split.offsets.to_numpy()].tolist()
        ids = gather(ids, size, at)
        return [self.packed(self.whole(t)) if i in whole else ids[x:y].tobytes() for i, (t, x, y) in enumerate(zip(texts, ends, ends[1:], strict=False))]


def gather(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the words `at` in a row, of words whose ids stand in a row, `size` each."""
    start = np.cumsum(size, dtype=np.int64) - size
    out, done = np.empty(size[at].sum(), ids.dtype), 0
    for i in range(0, len(at), GATHERED):
        some = at[i : i + GATHERED]
        ends = np.cumsum(n := size[some], dtype=np.int64)
        out[done : done + ends[-1]] = ids[np.repeat(start[some] - ends + n, n) + np.arange(ends[-1])]
        done += ends[-1]
    return out


def halves(words: pa.StringArray) -> pa.StringArray:
    """Of each word, what stands before the ASCII punctuation at its end, and that. Pre-tokens end between a letter or digit and
    punctuation; where another character stands before, the word is its first half."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    cut = ends[:-1] + pc.binary_length(pc.ascii_rtrim(words, characters=string.punctuation)).to_numpy()
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last, before = (raw[np.maximum(cut - k, 0)] if len(raw) else np.zeros(len(cut), np.uint8) for k in (1, 2))
    # Latin-1's lower-case letters are C3 and a byte from 9F on, but for B7, the sign of division.
    letter = LETTERS[last] | (before == 0xC3) & (last >= 0x9F) & (last <= 0xBF) & (last != 0xB7)
    cut = np.where((cut == ends[:-1]) | ~letter, ends[1:], cut)
    offsets = np.empty(2 * len(cut) + 1, np.int32)
    offsets[:-1:2], offsets[1::2], offsets[-1] = ends[:-1], cut, ends[-1]
    return pa.StringArray.from_buffers(2 * len(cut), pa.py_buffer(offsets), words.buffers()[2])


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros((len(v) + 3) // 4 * 4, np.uint8)
    four[: len(v)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, order: str, bounds: list[float]) -> DataFrame:
    """order_by, doc_id, part (the range of the order among bounds), n_tokens and ids: 16 bits each if the whole vocabulary fits,
    else 32, after a byte that gives their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        ends = np.array(bounds)
        for b in batches:
            size = int(enc.width[-1])
            first, end = bytes([size]), np.array([end_id], enc.width).tobytes()
            raw = [first + x + end for x in enc.encode(b.column("text").to_pylist())]
            place = b.column("order_by")
            part = np.searchsorted(ends, place.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(float), "right")
            yield pa.RecordBatch.from_arrays([place, b.column("doc_id"), pa.array(part.astype(np.int32)), pa.array([len(x) // size for x in raw], pa.int64()), pa.array(raw, pa.binary())], names=["order_by", "doc_id", "part", "n_tokens", "ids"])

    rows = docs.select(F.col(order).cast("long").alias("order_by"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return map_batches(rows, run, "order_by long, doc_id long, part int, n_tokens long, ids binary", holds=True)


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(0, np.int64)
    for b in batches:
        rows = [ids_of(raw) for raw in b.column("ids").to_pylist()]
        if rows:
            got = np.bincount(np.concatenate(rows), minlength=len(n))
            got[: len(n)] += n
            n = got
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["id", "n"])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, order: str = "doc_id") -> None:
    """Encode docs and write the format at path, documents in ascending `order` (a long column)."""
    spark = docs.sparkSession
    parts = max(1, docs.select("text").rdd.getNumPartitions())
    bounds = sorted(set(docs.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    tokens = tokenise(docs, tokenizer or default_tokenizer(), end_id, order, bounds)
    rows = store(tokens.repartition(parts, "part").sortWithinPartitions(F.col("part"), F.col("order_by").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "ids"))
    release(spark)
    ranks = map_batches(rows.select("ids"), _counts, "id long, n long", holds=True).groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()  # at most the vocabulary
    spark.createDataFrame([(int(r.id), int(r.n), i) for i, r in enumerate(ranks)], "id long, n long, rank long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    rank = np.zeros(max((r.id for r in ranks), default=0) + 1, np.uint32)
    rank[[r.id for r in ranks]] = np.arange(len(ranks))
    shared = spark.sparkContext.broadcast(rank)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for b in batches:
            at, place = (b.column(k).to_numpy(zero_copy_only=False) for k in ("part", "place"))
            before = np.cumsum(b.column("n_tokens").to_numpy()) // BLOCK_IDS
            # A block also ends where the part does, and where the rows of this batch do not follow each other.
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(place) != 1) | (np.diff(before) != 0)) + 1).tolist(), len(at)]
            out = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                ids = [ids_of(v) for v in b.column("ids").slice(x, y - x).to_pylist()]
                ranked = rank[np.concatenate(ids)]
                out.append((int(at[x]), int(place[x]), b.column("doc_id").slice(x, y - x).to_pylist(), [len(v) for v in ids], len(ranked), *pack(ranked)))
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            names = ["part", "block", "doc_ids", "lengths", "n_ids", "control", "data"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    # A part is one sorted run of rows of one task. A row's number in what the task wrote is its place, so blocks keep their order
    # however the files are split for reading.
    place = F.regexp_extract("_metadata.file_name", r"-c(\d+)", 1).cast("long") * (1 << 40) + F.col("_metadata.row_index")
    files = map_batches(rows.select("part", "doc_id", "n_tokens", "ids", place.alias("place")), encode, "part int, block long, doc_ids array<long>, lengths array<int>, n_ids long, control binary, data binary", holds=True)
    files.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    discard(rows)
    sizes = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("within", within).join(totals, "part").select("part", "block", (F.col("before") + F.col("within")).alias("start")).write.mode("overwrite").parquet(f"{path}/index")


def decoded(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of blocks; order: the ids by rank."""
    for b in batches:
        lists = {k: b.column(k) for k in ("doc_ids", "lengths")}
        for i in range(b.num_rows):
            start, n, control, data = (b.column(k)[i].as_py() for k in ("start", "n_ids", "control", "data"))
            ids = order[unpack(control, data, n)].astype("<u4")
            size = lists["lengths"][i].values.to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            # Arrow's converter never lets go of a memoryview that it is given, nor of what stands behind it; so the column is made of its buffers.
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([lists["doc_ids"][i].values, pa.array(ends[:-1] + start), pa.array(size), pa.array(crc, pa.int64()), raw], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit)."""
    order = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()]
    shared = spark.sparkContext.broadcast(np.array(order, np.uint32))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(batches, shared.value)

    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/index"), ["part", "block"])
    return map_batches(blocks.select("start", "doc_ids", "lengths", "n_ids", "control", "data"), decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary", holds=True)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 6: write documents in the format, read the files back."""
    path = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
