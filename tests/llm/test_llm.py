"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import sys
import tracemalloc
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, langid, mixing, near_dedup, quality_model, quality_rules, suffix_dedup, token_counts, token_output, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, th string, n_words string"


def frame(spark, texts):
    """Odd ids: a null, repeated rows; extra columns whose names clash with inner ones."""
    rows = [(None if i == 3 else i, t, "en", "s", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA).repartition(3)


RND = random.Random(4)
VOCAB = ["".join(RND.choice("abcdeé") for _ in range(RND.randint(1, 6))) for _ in range(60)]
LONG = " ".join(RND.choice(VOCAB) for _ in range(6000))
TEXTS = [None, "", "  \n ", "One", "a b " * 40, LONG, "x" * 900, "### $$$ !!", LONG[:700], LONG[100:1500], "same\nsame\n\nsame", "word " * 7 + "end"] + [" ".join(RND.choices(VOCAB, k=RND.randint(1, 60))) for _ in range(12)]


def test_quality_rules(spark):
    got = Counter(tuple(r) for r in quality_rules.apply_policy(quality_rules.ledger(frame(spark, TEXTS))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for r in frame(spark, TEXTS).collect():
        t = r.text or ""
        for c in "\t\n\x0b\x0c\r":
            s = t.replace(c, " ")
        w = t.replace("\n", " ").split(" ")
        w = [x for x in w if x]
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.strip(" ")]
        want[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))] += 1
    assert got == want
    for r in quality_rules.apply_policy(quality_rules.ledger(frame(spark, TEXTS))).collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        bad = 100 * r.n_symbols > 10 * r.n_words or 100 * r.n_same_as_before > 15 * r.n_words or 100 * r.n_upper_words > 30 * r.n_words or not 2 * r.n_words <= r.word_chars <= 15 * r.n_words
        assert r.kept == (not r.base_failed and not bad)
    assert quality_rules.ledger(frame(spark, TEXTS).limit(0)).count() == 0


def test_ablation(spark):
    rows = spark.createDataFrame([(1,), (3,), (4,), (0,)], "failed long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_any) for r in quality_rules.ablation(rows).collect()}
    assert got["few_words"] == (2, 1, 3) and got["repeated_windows"] == (1, 0, 3) and got["symbols"] == (1, 1, 3)


def test_token_counts(spark):
    enc = token_counts.encoding(token_counts.default_tokenizer())
    n = [len(enc.encode_ordinary(r.text or "")) for r in frame(spark, TEXTS).collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(frame(spark, TEXTS)))
    for r in sums.collect():
        ge = [x for x in n if x >= r.n_tokens]
        assert (r.n_docs, r.docs_ge, r.tokens_ge, r.trunc_tokens) == (n.count(r.n_tokens), len(ge), sum(ge), sum(min(x, r.n_tokens) for x in n))
    for r in token_counts.context_report(sums, (1, 16, 10_000)).collect():
        assert (r.docs_cut, r.kept_tokens, r.total_tokens) == (sum(x > r.limit for x in n), sum(min(x, r.limit) for x in n), sum(n))
    assert token_counts.suffix_sums(token_counts.histogram(frame(spark, TEXTS).limit(0))).count() == 0


@pytest.mark.parametrize("max_words", [10**6, 30])
def test_decontaminate(spark, max_words):
    words = LONG.split()
    items = [(1, " ".join(words[50:75])), (2, "one"), (3, None), (4, " ... "), (5, " ".join(words[60:80]).upper()), (10, " ".join(words[90:99])), (1, "zz yy"), (None, " ".join(words[200:230]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(frame(spark, TEXTS), bench, max_words=max_words).collect())
    own = {}
    for i, t in items:
        w = decontaminate.words_of(t)
        for j in range(max(1, len(w) - 9)) if w else ():
            own.setdefault(tuple(w[j : j + 10]), set()).update(() if i is None else (str(i),))
    want = Counter()
    for r in frame(spark, TEXTS).collect():
        w, hit, ids = decontaminate.words_of(r.text), set(), set()
        for k in {len(x) for x in own}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in own:
                    hit |= set(range(j, j + k))
                    ids |= own[tuple(w[j : j + k])]
        want[(r.doc_id, len(w), len(hit), tuple(sorted(ids)))] += 1
    assert got == want
    assert decontaminate.decontaminate(frame(spark, TEXTS), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_offsets():
    text = "Äpfel, zwei—DREI vier!"
    words = decontaminate.words_of(text)
    (a, b), = decontaminate.offsets(text, [(0, len(words))])
    assert text[a:b] == "Äpfel, zwei—DREI vier"


def test_url_filters(spark):
    ev = spark.createDataFrame([("spam", "domain", "b.org", "add", 10), ("spam", "domain", "b.org", "remove", 20), ("allow", "path", "x.b.org/ok", "add", 0), ("bad", "domain", "c.org", "remove", 1)], "list string, kind string, key string, action string, at long")
    caps = [(1, "http://a.b.org/p", 15), (2, "http://b.org", 20), (3, "http://notb.org/", 15), (4, "https://u@X.b.org:80/ok/1?q", 15), (5, None, 15), (6, "http://b.org", None), (7, "mailto:b.org", 15), (1, "http://a.b.org/p", 15)]
    got = url_filters.judge(spark.createDataFrame(caps, "page_id int, url string, fetched_at long"), ev, ["page_id"]).collect()
    assert sorted((r.page_id, r.blocked, r.n_entries) for r in got) == [(1, True, 1), (1, True, 1), (2, False, 0), (3, False, 0), (4, False, 2), (5, False, 0), (6, False, 0), (7, False, 0)]


def brute_spans(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen, out = Counter(t[i : i + span] for t in raw for i in range(len(t) - span + 1)), []
    for t in raw:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                hit[i : i + span] = True
        kept = bytes(b for b, h in zip(t, hit, strict=True) if not h)
        out.append((len(t), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("few", [url_filters.FEW, 0])
def test_url_kinds(spark, few):
    """Entries match by their own kind; hosts are folded; every capture gets a row, kept columns keep their values."""
    ev = [("spam", "domain", "B.org.", "add", 0), ("spam", "path", "b.org", "add", 0), ("bad", "domain", "c.org/ok", "add", 0), ("bad", "path", "C.org/ok//", "add", 5), ("bad", "path", "c.org/ok", "remove", 9), ("bad", "path", None, "add", 0), ("allow", "path", "b.org/fine", "add", 0)]
    events = spark.createDataFrame(ev, "list string, kind string, key string, action string, at long")
    caps = [(1, "http://b.org/p", 1, "v"), (2, "http://c.org/ok/x", 6, "v"), (3, "http://c.org/okay", 6, "v"), (4, "http://c.org/ok", 9, "v"), (5, "http://b.org/fine/1", 1, "v"), (6, "http://c.org/OK", 6, "v")]
    pages = spark.createDataFrame(caps, "page_id int, url string, fetched_at long, e string")
    got = {r.page_id: (r.blocked, r.lists, r.n_entries, r.e) for r in url_filters.judge(pages, events, ["page_id", "e"], few=few).collect()}
    assert got == {1: (True, ["spam"], 1, "v"), 2: (True, ["bad"], 1, "v"), 3: (False, [], 0, "v"), 4: (False, [], 0, "v"), 5: (False, ["spam"], 2, "v"), 6: (False, [], 0, "v")}
    named = pages.withColumnsRenamed({"e": "blocked"}).withColumn("lists", F.lit(1)).withColumn("key", F.lit(1))
    assert [r.blocked for r in url_filters.judge(named, events, ["page_id", "blocked", "key"], few=few).orderBy("page_id").collect()] == [True, True, False, False, False, False]
    assert url_filters.judge(pages.limit(0), events, ["page_id"], few=few).count() == 0
    assert url_filters.judge(pages, events.limit(0), ["page_id"], few=few).filter("blocked").count() == 0


def test_skew_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 1), (None, 7)], "k int, v int")
    right = spark.createDataFrame([(1, 50, "a"), (2, 1, "b")], "k int, n int, x string")
    for how in ("inner", "left"):
        want = left.join(right.drop("n"), "k", how).collect()
        assert sorted(map(str, common.skew_join(left, right, ["k"], "n", 53, how, rows=2).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("hot,hot_rows", [(suffix_dedup.HOT, common.HOT_ROWS), (2, 3)])
def test_suffix_dedup(spark, hot, hot_rows):
    base = ["".join(RND.choice("ab") for _ in range(300)) for _ in range(3)]
    texts = [None, "", "a" * 130, "ab" * 50, "z" * 39, "z" * 41] + ["".join(x[(k := RND.randrange(200)) : k + RND.randrange(30, 120)] for x in RND.choices(base, k=3)) for _ in range(40)]
    df = frame(spark, texts)
    rows = df.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_spans([r.text for r in rows], 40), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df, 40, hot, hot_rows=hot_rows).collect())
    assert got == want
    assert suffix_dedup.deduplicate(df.limit(0), 40).count() == 0


def test_token_output(spark, tmp_path):
    texts = [*TEXTS, "a <|endoftext|> b", "tab\tand space  it's\x1fx"]
    path = str(tmp_path / "tokens")
    df = frame(spark, texts)
    token_output.write(df, path)
    tok = token_output.Encoder(token_output.default_tokenizer())
    want, at = [], 0
    for r in sorted(df.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id):
        ids = [*(tok.whole(r.text) if r.text else []), 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read(spark, path).collect()) == [(b, a, c, d) for a, b, c, d in want]


def test_token_output_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write(frame(spark, TEXTS).limit(0), path)
    assert token_output.read(spark, path).count() == 0


def test_encoder():
    enc = token_output.Encoder(token_output.default_tokenizer())
    texts = ["Σ HELLO World. ΣΑΣ", "İstanbul Ángel don't Áb", "x<|ENDOFTEXT|>y <|endoftext|>", "Kelvin \u212a \u212b \u2126 ǅ ﬁ", "it's word?! a\u00a0b 漢字&&& e\u0301. &and 12a.", "", None]
    assert [np.frombuffer(x, enc.width).tolist() for x in enc.encode(texts)] == [enc.whole(t or "") for t in texts]


def test_encoder_with_a_full_table(monkeypatch):
    monkeypatch.setattr(token_output, "WORDS", 40)
    monkeypatch.setattr(token_output, "STAY", 20)
    enc = token_output.Encoder(token_output.default_tokenizer())
    letters = [f"x{chr(c)}y{chr(c)}. {chr(c)}" for c in range(0xA1, 0x250)]
    odd = ["foo…. …!! a÷. b\x1c. c×! 1. x's. 'll ''. d'. . é? é\u0301! ﬁ. \u3000w.\u00a0v, ª. ſ; ", "Σ A. B", "q" * 200 + ". end", " lead  and trail. "]
    for i in range(0, len(letters), 50):
        texts = [*letters[i : i + 50], *odd, LONG, None, ""]
        assert [np.frombuffer(x, enc.width).tolist() for x in enc.encode(texts)] == [enc.whole(t or "") for t in texts]
        assert len(enc.words) == len(enc.size) == len(enc.hits) <= 40 and enc.size.sum() == len(enc.known)
        assert max(len(w.encode()) for w in enc.words.to_pylist()) <= token_output.WORD_BYTES


def test_decoding_keeps_nothing():
    ids = np.arange(250_000, dtype=np.uint32) % 1000
    control, data = token_output.pack(ids)
    row = {"start": 5, "doc_ids": [1, 2, 3], "lengths": [0, 50_000, 200_000], "n_ids": len(ids), "control": control, "data": data}
    batch = pa.RecordBatch.from_pylist([row] * 3)
    tracemalloc.start()
    try:
        for _ in range(4):
            for b in token_output.decoded(iter([batch]), np.arange(1000, dtype=np.uint32)):
                assert b.column("start").to_pylist() == [5, 5, 50_005]
                assert b.column("ids").to_pylist() == [b"", ids[:50_000].tobytes(), ids[50_000:].tobytes()]
        b = None
        assert tracemalloc.get_traced_memory()[0] < 1_000_000
    finally:
        tracemalloc.stop()


def test_variable_length_code():
    v = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        assert (token_output.unpack(*token_output.pack(v[:n]), n) == v[:n]).all()


def test_langid(spark):
    rows = [(i, " ".join(RND.choices([["der", "die", "keit", "ung"], ["the", "ing", "of", "that"]][i % 2], k=30)), ["de", "en"][i % 2]) for i in range(80)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "der ung keit die der ung die keit"), (2, "that of the ing the of that"), (3, None), (4, "12 !?"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["de", "en", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in langid.identify(asked, langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))).collect()} == {"und"}


def test_langid_in_passes(spark):
    """Many languages in several passes give what one pass does; marks are part of words, numerals are no letters."""
    rows = [(i, " ".join(RND.choices([f"{k}{x}" for x in ("an", "er", "is", "o")], k=30)), k) for i, k in enumerate("abcdefg" * 12)]
    rows += [(None, "x" * 9_000, "long"), (7, None, "a"), (7, rows[7][1], None)] + [rows[0]] * 3
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model) == [*"abcdefg", "long"]
    asked = frame(spark, [rows[14][1], rows[6][1].upper(), None, "½ ① Ⅷ 12", "", (rows[1][1] + " ") * 900, "cis"]).withColumn("score", F.lit("kept"))
    one, some = (sorted(map(str, langid.identify(asked, model, ["doc_id", "n_words", "score"], block_langs=k).collect())) for k in (200, 3))
    assert one == some and "lang_pred='und'" in one[0] + one[1] + one[2]
    by = {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()}
    assert (by[0], by[1], by[2], by[4], by[5]) == ("a", "g", "und", "und", "b")
    assert by[None] == "und" and langid.identify(asked.limit(0), model).count() == 0
    assert langid.letters("नमस्ते دُنیا é") == "नमस्ते دُنیا é".encode()


CLASHES = ["score", "raw_diff", "rate", "_n", "_c", "copy", "mix_key", "pieces", "steps", "_d", "_h", "kept_id", "node", "comp", "n_hit", "n_words", "items", "spans", "_place", "place", "part", "start", "lang_pred", "source_key"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Nulls, empty, long and repeated texts, ties and columns named like inner ones, through every stage; then no rows at all."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(2).collect()]
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 1500").limit(12).collect()]
    docs = frame(spark, [*TEXTS[:6], *good, good[0], items[0], "y " + items[1]]).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    first = docs.collect()
    judged = {}
    for name, stage in p.STAGES[:-1]:
        out = p.store(stage(spark, docs, sf))
        assert out.columns == docs.columns
        rows = {str(r) for r in first}
        judged[name] = out.collect()
        assert all(str(r) in rows for r in judged[name])
        assert stage(spark, docs.limit(0), sf).count() == 0
    ids = Counter(r.doc_id for r in judged["decontaminated"])
    assert ids[len(TEXTS[:6]) + len(good) + 1] == 0 and ids[0] == ids[1] == 1 and ids[6] == 1
    once = Counter(r.doc_id for r in judged["near_duplicates"])
    assert max(once.values()) == 1 and once[6] == 1 and once[6 + len(good)] == 0 and once[0] == once[1] == 1
    assert sum(1 for _ in judged["mixed"]) > 0
    out = p.tokens(spark, p.store(docs), sf).collect()
    assert len(out) == len(first) and sorted(r.start for r in out)[0] == 0
    assert p.tokens(spark, p.store(docs.limit(0)), sf).count() == 0


def test_mixing_by_shuffle_and_null_ids(spark):
    rows = [(i, "t" * (i % 7), f"s{i % 5}", 1) for i in range(400)] + [(None, f"text {i}", "s1", 1) for i in range(200)] + [(None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    a, b = (sorted(map(str, mixing.mix(df, few=k).select("doc_id", "text", "source", "copy", "mix_key").collect())) for k in (mixing.FEW, 0))
    assert a == b and len({r.text for r in mixing.mix(df, epochs=0.5).filter("doc_id is null").collect()}) not in (0, 200)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixture(df).columns == df.columns


def test_mixing(spark):
    rows = [(i, "t" * 10, "big" if i < 3000 else "small" if i < 3300 else None) for i in range(3400)] + [(None, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(r.source for r in mixing.replicate(df, {"big": 1.0, "small": 1.0, None: 1.0}).collect())
    third = 34_000 / 3 / 10
    assert all(abs(n[s] - third) < 5 * third**0.5 for s in ("big", "small", None))
    assert [r.mix_key for r in mixing.mix(df).collect()] == sorted(r.mix_key for r in mixing.mix(df).collect())


def test_near_dedup(spark):
    w = [f"w{i}" for i in range(400)]
    near = [*w[:200], "new", *w[201:400]]
    texts = [None, "", "!!", "x", " ".join(w), " ".join(near), " ".join(w[::-1]), "one two three", "ONE two, three", " ".join(w)]
    got = near_dedup.assign(frame(spark, texts)).collect()
    by = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(texts) + 1 and by[4] == by[5] == by[9] == 4 and by[7] == by[8] == 7 and by[6] == 6 and by[0] == 0 and by[1] == 1 and by[2] == 2
    assert sorted(str(r.doc_id) for r in near_dedup.keep_first(frame(spark, texts)).collect()) == sorted(map(str, [0, 1, 2, None, 4, 6, 7]))
    assert sorted((str(r.doc_id), r.class_id) for r in near_dedup.assign(frame(spark, texts), hot_rows=1).collect()) == sorted((str(r.doc_id), r.class_id) for r in got)
    assert near_dedup.assign(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("size", [150, 700])
def test_near_dedup_of_a_hot_group(spark, size):
    """Hundreds of copies of one text with few to many words replaced: classes as from all pairs."""
    rng = random.Random(size)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    texts = []
    for _ in range(250):
        own = list(base)
        for i in rng.sample(range(size), rng.randrange(size // 25)):
            own[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [set(near_dedup.multiset(t.encode()).tolist()) for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] != least[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    assert 1 < len(set(least)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(near_dedup.assign(docs).select("doc_id", "class_id").collect()) == dict(enumerate(least))


@pytest.mark.parametrize("hot_rows", [10_000, 1])
def test_near_dedup_components(spark, hot_rows):
    """Stars, a chain, a node with many lesser neighbours, loops, repeats and random edges: components as from union-find. A table
    that holds a star already takes one shuffle: few tasks at four partitions."""
    rng = random.Random(hot_rows)
    own = rng.sample(range(200, 500), 300)
    edges = [(0, i) for i in range(1, 60)] * 2 + [(i, i + 1) for i in range(60, 90)] + [(199, i) for i in range(100, 150)] + [(95, 95)] + [(rng.choice(own), rng.choice(own)) for _ in range(160)]

    def find(pairs, up):
        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            if a != b:
                low, high = sorted((top(a), top(b)))
                up[high] = low
        return {x: top(x) for x in up}

    def run(pairs):
        df = common.store(spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in pairs], "a binary, b binary").coalesce(1))
        group = f"components {hot_rows} {len(pairs)}"
        spark.sparkContext.setJobGroup(group, group)
        rows = near_dedup.components(df, hot_rows).collect()
        spark.sparkContext.setJobGroup("rest", "rest")
        track = spark.sparkContext.statusTracker()
        tasks = sum(x.numCompletedTasks for j in track.getJobIdsForGroup(group) for k in track.getJobInfo(j).stageIds if (x := track.getStageInfo(k)))
        assert sorted((int(r.node), int(r.comp)) for r in rows) == sorted(find(pairs, {}).items())
        return tasks

    run(edges)
    run([])
    assert run(edges[:59]) <= 20 or hot_rows == 1


def test_near_dedup_by_joins_of_hot_buckets(spark):
    """Near copies in buckets over the bound are counted by aggregates and a join: the same classes."""
    w = [f"v{i}" for i in range(300)]
    texts = [" ".join([*w[: i * 7], f"n{i}", *w[i * 7 + 1 :]]) for i in range(40)]
    docs = frame(spark, texts)
    assert {r.class_id for r in near_dedup.assign(docs, hot_rows=1).collect()} == {r.class_id for r in near_dedup.assign(docs).collect()} == {0}


def test_signature_is_unbiased():
    z = []
    for n in (12, 80, 900):
        for _ in range(8):
            a = RND.choices(VOCAB * 9, k=n) + ["r", "s"] * RND.randint(1, 15)
            b = [x if RND.random() > 0.03 else "q%d" % i for i, x in enumerate(a)]
            doc, h = near_dedup.shingles([" ".join(x).encode() for x in (a, b)])
            s = near_dedup.signatures(*near_dedup.weights(doc, h), 2, 800)
            x, y = (Counter(h[doc == i].tolist()) for i in (0, 1))
            j = sum((x & y).values()) / sum((x | y).values())
            z.append(((s[0] == s[1]).mean() - j) / np.sqrt(j * (1 - j) / 800 + 1e-6))
    assert abs(np.mean(z)) < 1 and np.std(z) < 2


def test_quality_model(spark):
    good = lambda: " ".join(RND.choices(VOCAB, k=60)).capitalize() + "."
    rows = [(i, good() if i % 3 else " ".join(w + "###" for w in RND.choices(VOCAB, k=60)), int(i % 3 > 0)) for i in range(240)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_model.fit(labelled, labelled)
    asked = frame(spark, [None, "", good(), good(), " ".join(w + "###" for w in VOCAB)])
    got = {r.doc_id: r.score for r in quality_model.score(asked, model).collect()}
    assert got[2] > 0.7 > got[4] and all(0 <= s <= 1 for s in got.values())
    assert [r.score for r in quality_model.score(asked.withColumn("score", F.lit("x")), model, ["doc_id", "score", "th"]).orderBy("doc_id").collect()] == [r.score for r in quality_model.score(asked, model).orderBy("doc_id").collect()]
    again = labelled.unionByName(labelled.filter("doc_id < 5")).unionByName(spark.createDataFrame([(None, "x", 1), (900, None, 0), (901, "word " * 30_000, 1)], labelled.schema))
    odd = quality_model.fit(again, again, 20, 30)
    assert all(0 <= r.score <= 1 for r in quality_model.score(again, odd).collect()) and odd == quality_model.fit(again.repartition(5), again, 20, 30)
    none = labelled.limit(0)
    assert quality_model.score(asked, quality_model.fit(none, none)).first().score == 0.5


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = [docs.count()]
    for _, stage in p.STAGES:
        before, docs = docs, p.store(stage(spark, docs, sf))
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] and n[4] == n[5] > 0
    rows = sorted(docs.collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    order = [r.doc_id for r in p.place(before).orderBy("place").collect()]
    assert [r.doc_id for r in rows] == order


def test_batches_from_the_jvm_are_bounded(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.get_total_buffer_size()])], names=["size"])

    df = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    got = [r["size"] for r in common.map_batches(df, size, "size long").collect()]
    assert sum(got) > 20_000_000 and max(got) < 1.5 * common.BATCH_BYTES


@pytest.mark.parametrize("holds", [False, True])
def test_stages_give_back_what_a_worker_holds(monkeypatch, holds):
    monkeypatch.setitem(sys.modules, common.HELD, types.ModuleType(common.HELD))
    batch = pa.RecordBatch.from_pydict({"x": list(range(5))})
    seen = [(b.num_rows, common.HELD in sys.modules) for b in common._bounded(lambda bs: bs, 1 << 20, holds)(iter([batch]))]
    assert seen == [(5, holds)] and (common.HELD in sys.modules) == holds
