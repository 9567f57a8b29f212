"""Selection, retrieval, policies, evaluation, acquisition and text facts on small fixtures."""

from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import acquisition, chunking, decision, evaluation, facts, policies, retrieval, selection


def one(spark, *cols, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(*cols).first()


def test_rules(spark):
    t = "We require a LSR less than 4%. Your ODR must be below 1% and VTR above 95%. The cancellation rate for thirty days should stay under 2.5%. Keep it at least 5%. We require a LSR less than 4%. A CR, for sellers of any size, " + "x" * 81 + " under 3%."
    got = one(spark, tx.rules(F.col("t")).alias("r"), t=t).r
    assert [(r.metric, r.operator, r.value, r.unit) for r in got] == [("LSR", "less than", 4.0, "%"), ("cancellation rate", "under", 2.5, "%")]
    assert got[0].evidence == "We require a LSR less than 4%." and one(spark, tx.rules(F.col("t")).alias("r"), t="").r == []


def test_sentences(spark):
    said = one(spark, tx.sentences(F.col("t"), promo=tx.PROMO).alias("s"), t="See No. 5 of Acme Inc. today. Listen to this now. Go on.  Volcano. End").s
    assert said == ["See No. 5 of Acme Inc. today.", "Go on.", "Volcano.", "End"]


def test_quotes_and_citations(spark):
    q = lambda t, n=40: one(spark, tx.pick_quote(F.col("t"), n).alias("q"), t=t).q
    assert q('He said "one". Then two more. And a third one here.') == "He said one. Then two more."
    assert q("word " * 20) == ("word " * 8).strip() and q("short") is None and q("") is None
    c = lambda *v: one(spark, tx.citation(*[F.col(x) for x in "abcde"]).alias("c"), **dict(zip("abcde", v))).c
    assert c("H", "T", "k#1", "S-5", "u") == "H, S-5 — u" and c("", "T", "k#1", None, "") == "T [no source URL]" and c(None, "", "k#1", "", None) == "k#1 [no source URL]"
    d = lambda *v: one(spark, tx.doc_identity(*[F.col(x) for x in "abcd"]).alias("c"), **dict(zip("abcd", v))).c
    assert d("x", "k#1", "u", "t") == "x" and d("", "k#1", "u", "t") == "k" and d(None, "k", "u", "t") == "u" and d(None, None, "", "t") == "t"
    assert one(spark, tx.category_of(F.col("t"), ("returns", "payments"), "account").alias("c"), t="It is Payments.").c == "payments"
    assert one(spark, tx.analysed(F.col("t"), ("the",)).alias("c"), t="The Café straße").c == ["cafe", "strasse"]
    assert one(spark, tx.body_fields(F.col("t"), "text string").alias("c"), t="no json").c.text is None and len(one(spark, tx.excerpt(F.col("t")).alias("c"), t="a  b " * 90).c) == 160


def test_sections(spark):
    lines = ["before", "S-1.2 Payment terms. We pay.", "more  text", "3. Definitions.", "means this", "API-2 Use of it", "7. " + "Long clause " * 9]
    got = chunking.sections(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, o int, t string"), "k", "o", "t", "Agreement").orderBy("section").collect()
    assert [(r.section_id, r.text) for r in got] == [("S-1.2", "Payment terms. We pay. more text"), ("§3", "means this"), ("API-2", "Use of it " + ("7. " + "Long clause " * 9).strip())]
    assert got[0].heading_path == "Agreement > Selling Service Terms > S-1.2 Payment terms" and got[1].heading_path == "Agreement > General Terms > §3 Definitions"


def test_locate_and_numbers(spark):
    docs = spark.createDataFrame([(1, "aa bb  aa bb cc"), (2, "x")], "k int, text string")
    chunks = spark.createDataFrame([(1, 0, "aa bb", 30), (1, 1, "aa bb cc", 30), (1, 2, "zz", 5), (2, 0, "x", 40)], "k int, chunk int, text string, n_words int")
    got = {(r.k, r.chunk): (r.char_start, r.char_end) for r in chunking.locate(chunks, docs, "k", 5).collect()}
    assert got == {(1, 0): (0, 5), (1, 1): (6, 14), (1, 2): (None, None), (2, 0): (0, 1)}
    many = spark.createDataFrame([(d, c, "t", 20 + c) for d in range(40) for c in range(d % 4)], "k int, chunk int, text string, n_words int").repartition(5)
    ids = [r.chunk_id for r in chunking.number_all(many, "k", 21).orderBy("k", "chunk").collect()]
    assert [int(x.split("#")[1]) for x in ids] == list(range(len(ids))) and len(ids) == 30
    assert tuple(chunking.word_stats(chunks).first()) == (5, 30.0, 40)


def test_selection(spark):
    scores = spark.createDataFrame([(1, 2, 7, 0.8), (1, 1, 9, 0.8), (1, 1, 8, 0.8), (2, 0, 1, 0.5)], "doc int, chunk int, q int, cosine double")
    best = {r.doc: (r.chunk, r.q) for r in selection.best_chunk(scores, "doc", "chunk", "q").collect()}
    assert best == {1: (1, 8), 2: (0, 1)} and {r.doc: r.reason for r in selection.relevant(selection.best_chunk(scores, "doc", "chunk", "q")).collect()} == {1: None, 2: "not_relevant"}
    docs = spark.createDataFrame([(1, "You must reply. Hello"), (2, "Nothing here"), (3, "Nothing here"), (4, "You must"), (5, "You must click")], "d int, text string")
    chunks = spark.createDataFrame([(1, 0, "Hello", 0.9), (1, 1, "You must reply", 0.75), (2, 0, "Nothing", 0.9), (3, 0, "Nothing", 0.9), (4, 0, "You must", 0.7), (5, 0, "You must click " + "click " * 4, 0.9)], "d int, chunk int, text string, similarity double")
    got = {r.d: (r.chunk, r.reason) for r in selection.quotable(docs, chunks, "d", F.col("d") == 3, selection.markers()).collect()}
    assert got == {1: (1, None), 2: (0, "not_quotable"), 3: (0, None), 4: (None, "not_quotable"), 5: (0, "not_quotable")}
    kept, rest = selection.split(docs, docs.filter("d < 3"), "d", "over_cap")
    assert kept.count() == 2 and {r.reason for r in rest.collect()} == {"over_cap"}
    assert [r.chunk for r in selection.covering(scores, "q", "chunk", 1).orderBy("q").collect()] == [0, 2, 1, 1]


def test_retrieval(spark):
    chunks = spark.createDataFrame([("a", "late fee", ["how late"], "", "fee for late orders", "payments", "agreement"), ("b", "fee", None, "", "other words late", "returns", "page"), ("c", "", [], "", "none", "payments", "agreement")], "id string, title string, answers_questions array<string>, heading_path string, text string, category string, doc_type string")
    asked = spark.createDataFrame([(1, "late late fee", "payments"), (2, "absent", "payments")], "q int, text string, category string")
    s = {(r.q, r.id): r.score for r in retrieval.field_scores(chunks, asked, "id", "q").collect()}
    assert set(s) == {(1, "a"), (1, "b")} and s[1, "a"] > s[1, "b"] > 0
    b = {(r.q, r.id): r.score for r in retrieval.boosted(retrieval.field_scores(chunks, asked, "id", "q"), chunks, asked, "id", "q").collect()}
    assert abs(b[1, "a"] - s[1, "a"] - 3.0) < 1e-9 and b[1, "b"] == s[1, "b"]
    cos = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.1)], "q int, id string, cosine double")
    got = retrieval.fused(spark.createDataFrame([(1, "a", 2.0), (1, "z", 1.0)], "q int, id string, score double"), cos, "q", "id").orderBy("rank").collect()
    assert [r.id for r in got][:2] == ["a", "b"] and {r.id: r.cosine for r in got}["z"] is None
    c = retrieval.confidence(spark.createDataFrame([(1, 0.719996), (2, 0.72)], "q int, cosine double"), "q").orderBy("q").collect()
    assert [(r.best_cosine, r.confident) for r in c] == [(0.72, False), (0.72, True)]


def test_requery(spark):
    first = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.6), (3, "a", 0.6), (4, "a", 0.5)], "q int, id string, cosine double")
    second = spark.createDataFrame([(1, "b", 0.99), (2, "b", 0.7), (3, "b", 0.6)], "q int, id string, cosine double")
    got = sorted(tuple(r) for r in retrieval.requery(first, lambda weak: second.join(weak, "q", "left_semi"), "q").collect())
    assert got == [(1, "a", 0.9, False, "original"), (2, "b", 0.7, True, "retry"), (3, "a", 0.6, True, "original"), (4, "a", 0.5, True, "original")]


def test_isolated_store(spark):
    asked = spark.createDataFrame([(1,), (2,)], "q int")
    ok = retrieval.isolated(asked, "q", lambda: spark.createDataFrame([(1, True)], "q int, conflict boolean"), {"conflict": F.lit(False)}).orderBy("q").collect()
    bad = retrieval.isolated(asked, "q", lambda: spark.read.parquet("/nowhere"), {"conflict": F.lit(False)}).collect()
    assert [tuple(r) for r in ok] == [(1, True, None, True), (2, True, None, False)]
    assert all(not r.checked and not r.conflict and r.reason for r in bad) and len(bad) == 2


def test_similar_shown(spark):
    rows = [(1, 10, "Same Text", 0.95, 5, True), (1, 11, "same  text", 0.95, 9, False), (1, 12, "other", 0.85, 3, True), (1, 13, "far", 0.5, 99, True), (2, 20, "only", 0.9, 1, True), (3, 30, "x", 0.81, 1, True)]
    m = spark.createDataFrame(rows, "q int, id int, text string, cosine double, created int, sent boolean")
    got = {}
    for r in retrieval.similar_shown(m, "q").orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.id, r.is_last, r.same_question))
    assert got == {1: [(10, True, 1), (12, False, 1)], 2: [(20, True, 1)], 3: [(30, False, 0)]}


POLICY = """// intro
permit (principal, action, resource);

@id("F1")
@reason("Enforcement goes to a person.")
@source_type("page")
forbid (principal, action, resource)
when {
  resource.topics.containsAny(["appeal", "account_review"])
};

@id("F6")
@reason("Not grounded.")
forbid (principal, action, resource)
when {
  resource.retrieval_confidence.lessThan(decimal("0.7500"))
};

@id("P1")
permit (principal, action, resource);
"""


def test_policies(spark):
    rules = policies.parse(POLICY)
    assert [(r.id, r.effect, r.number) for r in rules] == [("F1", "forbid", 0), ("F6", "forbid", 1), ("P1", "permit", 2)]
    assert policies.topics(POLICY) == {"F1": ("appeal", "account_review")} and policies.floor(POLICY) == Decimal("0.7500") and policies.floor("") == Decimal("0.72")
    assert policies.drift(["appeal", "refund"], POLICY) == {"not_extracted": ["account_review"], "not_guarded": ["refund"]}
    with pytest.raises(ValueError):
        policies.parse("permit (principal);")
    base = policies.build_ticket(spark.createDataFrame([(1, ["appeal", "appeal"], 0.74999, True, True), (2, [], 0.75, True, True)], "id int, t array<string>, score double, has_citation boolean, quotes_policy boolean"), F.col("t"), F.col("score"))
    assert [r.topics for r in base.orderBy("id").collect()] == [["appeal"], []]
    s = policies.Session.of(POLICY)
    decided = lambda x: {r.id: (r.decision, r.blocked_by) for r in decision.decide(base, x.now).collect()}
    assert decided(s) == {1: ("ESCALATE", ["F1"]), 2: ("AUTO_SEND", [])}
    changed = s.disable("F1").set_floor("0.95").add_forbid("F9", "refund")
    assert decided(changed) == {1: ("ESCALATE", ["F6"]), 2: ("ESCALATE", ["F6"])} and decided(changed.reset()) == decided(s)
    why = policies.provenance(decision.decide(base, s.now), "id", policies.rule_table(spark, POLICY)).collect()
    assert [(r.id, r.rule, r.reason, r.source_type, r.source) for r in why] == [(1, "F1", "Enforcement goes to a person.", "page", "")]
    assert policies.invalid(base.schema) == ["category: missing, not string"]


def test_gate_over_all_states(spark):
    """960 states: none and 19 topics, three confidences, four flags. Only a state without any ground to hold it is sent."""
    from tessera.plans.catalog import gate_states

    states = gate_states(spark)
    got = decision.decide(states).collect()
    assert len(got) == 960
    for r in got:
        assert (r.decision == "AUTO_SEND") == (not r.topics and r.confidence >= Decimal("0.72") and r.has_citation and r.quotes_policy and not r.conflict and not r.breach)


def test_evaluation(spark):
    cos = spark.createDataFrame([(q, i, 0.9 - 0.01 * i - 0.2 * (q == 2)) for q in (1, 2) for i in range(9)], "q int, id int, cosine double")
    base = evaluation.baseline(cos, "q", "id")
    live = spark.createDataFrame([(1, 7, 1, 0.83), (1, 0, 2, 0.9), (2, 5, 1, None), (2, 0, 2, 0.69)], "q int, id int, rank int, cosine double")
    rows = {r.q: r for r in evaluation.compare(base, live, "q", "id").collect()}
    assert rows[1].rescued and rows[1].base_rank == 8 and not rows[1].regressed and rows[1].error < 1e-9
    assert not rows[2].rescued and rows[2].regressed == (rows[2].base_best >= 0.7) and abs(rows[2].live_best - 0.69) < 1e-9
    r = evaluation.report(evaluation.compare(base, live, "q", "id")).first()
    assert (r.n, r.rescues, r.live_usable) == (2, 1, 1) and [x.q for x in evaluation.weakest(evaluation.compare(base, live, "q", "id"), "q", "live_best", 1).collect()] == [2]
    d = evaluation.drift(spark.createDataFrame([(1, 0.9), (2, 0.5)], "id int, s double"), spark.createDataFrame([(1, 0.7), (2, 0.6), (3, 0.1)], "id int, s double"), "id", "s").first()
    assert (d.moved, d.median, d.least) == (1, 0.6, 0.1)


def test_preflight(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("a", [0.6, 0.8], None), (None, [0.0, 2.0], None)], "id string, v array<double>, url string")
    got = {r.check: r.ok for r in evaluation.preflight(rows, "id", "v", ["id", "v"], 2, {"url": 1}).collect()}
    assert got == {"fields_declared": False, "one_dimension": True, "calibrated_dimension": True, "ids_present": False, "ids_unique": False, "unit_vectors": False, "coverage_url": True}
    assert not {r.check: r.ok for r in evaluation.preflight(rows, "id", "v", ["id", "v", "url"], 3, {"url": 2}).collect()}["calibrated_dimension"]


def test_trail_reports(spark):
    run = spark.createDataFrame([(1, "account", True, True, True), (2, "returns", False, True, False)], "id int, category string, confident boolean, has_citation boolean, quotes_policy boolean")
    got = {r.id: (r.gap, len(r.reasons), r.subject) for r in evaluation.coverage_row(run, F.when(F.col("id") == 2, F.array(F.lit("z"), F.lit("b"))).otherwise(F.array().cast("array<string>")), F.lit("2024-01")).collect()}
    assert got == {1: (False, 0, "account"), 2: (True, 2, "b")}
    meta = spark.createDataFrame([("t1", "META", 5, 1, "old"), ("t1", "META", 5, 2, "new"), ("t2", "META", 9, 3, "x"), ("t1", "STEP#001", 7, 4, "s")], "pk string, sk string, created long, seq int, status string")
    assert [(r.pk, r.status) for r in evaluation.queue(meta, "pk", "created", "seq").collect()] == [("t2", "x"), ("t1", "new")]
    assert [(r.sk, r.status) for r in evaluation.replay(meta, "t1", "seq").collect()] == [("META", "new"), ("STEP#001", "s")]


def test_backfill(spark):
    metas = spark.createDataFrame([("1", "a", 1, "c", "AUTO_SEND", "complete"), ("2", "b", 2, "c", "ESCALATE", "complete"), ("3", "c", 3, "c", None, "complete"), ("4", "d", 4, "c", "AUTO_SEND", "open")], "id string, text string, created_ms long, category string, decision string, status string")
    steps = spark.createDataFrame([("1", "retrieve", None, "k#1", "T1", None, None), ("1", "requery", "retry", "m#2", "T2", None, None), ("1", "draft", None, None, None, "A — B — http://u", "Dear"), ("2", "retrieve", None, "k#1", "T1", None, None), ("2", "requery", "original", "m#2", "T2", None, None), ("2", "draft", None, None, None, "Path [no source URL]", None)], "id string, step string, kept string, top_id string, top_title string, citation string, draft string")
    got = {r.id: (r.sent, r.doc_id, r.policy_title, r.policy_path, r.policy_url, r.draft) for r in evaluation.backfill(metas, steps, "id").collect()}
    assert got == {"1": (True, "m", "T2", "A — B", "http://u", "Dear"), "2": (False, "k", "T1", "", "", "")}


def test_audit(spark):
    limits = spark.createDataFrame([("a", "Under  4%"), ("b", "x"), ("z", "x")], "id string, quote string")
    chunks = spark.createDataFrame([("a", "stay under 4% please"), ("b", "y")], "id string, text string")
    assert {r.id: r.found for r in evaluation.audit(limits, chunks, "id").collect()} == {"a": True, "b": False, "z": False}


def test_acquisition(spark):
    got = {r.url: r.origin for r in acquisition.candidates(spark, ["h/a.pdf", "h/p_x.pdf"], ["x", "y_redline"], ["h/p_", "h/q_"]).collect()}
    assert got == {"h/a.pdf": "listed", "h/p_x.pdf": "listed", "h/q_x.pdf": "made"}
    assert [one(spark, acquisition.in_region(F.col("u")).alias("x"), u=u).x for u in ("https://m/images/G/01/a.pdf", "https://m/images/G/02/a.pdf", "https://m/a")] == [True, False, False]
    files = spark.createDataFrame([("a", b"one"), ("b", b"two")], "f string, c binary")
    old = spark.createDataFrame([("a", "old", 9), ("z", "kept", 1)], "f string, sha256 string, bytes long")
    m = {r.f: (r.sha256[:6], r.bytes) for r in acquisition.manifest(files, "f", "c", old).collect()}
    assert m["z"] == ("kept", 1) and m["a"] == ("7692c3", 3) and [r.f for r in acquisition.missing(files, "f", old).collect()] == ["b"]
    rows, cache = spark.createDataFrame([("t",), ("u",)], "t string"), spark.createDataFrame([("-", [1.0])], "fingerprint string, embedding array<double>")
    hit, miss = acquisition.cached(rows, cache, "t", "m")
    assert hit.count() == 0 and miss.count() == 2
    hit, miss = acquisition.cached(rows, miss.select("fingerprint", F.array(F.lit(1.0)).alias("embedding")).limit(1), "t", "m")
    assert hit.count() == 1 and miss.count() == 1
    chunks = spark.createDataFrame([("agr", None, [], [0.12345678], 0.98765, 1), ("page", "u", ["q"], [1.0], 0.5, 2), ("page", "", ["q"], [1.0], 0.5, 2)], "doc_id string, source_url string, rules array<string>, embedding array<double>, best_similarity double, extra int")
    p = acquisition.prepare(chunks, ["doc_id", "source_url", "rules"], ["rules", "absent"], "agr", "link").collect()
    assert [(r.source_url, r.rules) for r in p] == [("link", None), ("u", ["q"]), (None, ["q"])]
    assert '"embedding":[0.123457],"best_similarity":0.9877' in acquisition.chunk_lines(chunks).first().value
    new = spark.createDataFrame([(1, "n1", 1), (1, "n2", 2), (3, "n3", 1)], "k int, v string, s int")
    assert sorted(tuple(r) for r in acquisition.upsert(spark.createDataFrame([(1, "o", 0), (2, "o", 0)], "k int, v string, s int"), new, "k", "s").collect()) == [(1, "n2", 2), (2, "o", 0), (3, "n3", 1)]


def test_findings_in_words(spark):
    rows = [(1, "Late rate", "selling", 4.0, "max", 4.0, "selling", "breach"), (1, "Tracking rate", "prime", 99.4, "min", 99.0, "the badge", "close"), (2, "Tracking rate", "selling", 99.0, "min", 95.0, "selling", "meets")]
    f = spark.createDataFrame(rows, "id int, label string, tier string, value double, kind string, limit double, stake string, status string")
    f = f.withColumn("sentence", facts.finding(*[F.col(c) for c in ("label", "value", "kind", "limit", "stake", "status")]))
    got = {r.id: (r.findings, r.summary) for r in facts.summaries(f, ["id"]).collect()}
    assert got[1] == (["Late rate of 4% is above the 4% limit for selling.", "Tracking rate of 99.4% stays above the 99% needed for the badge, but only just."], "2 numbers checked. Late rate is under the line for selling.")
    assert got[2] == (["Tracking rate of 99% is comfortably above the 95% needed for selling."], "1 number checked. Every one clears its published limit.")
    reply = lambda p: spark.createDataFrame([("Hi, my fee", p)], "a string, p string").select(facts.template_reply(F.col("a"), F.col("p"), F.lit("H"), F.lit("u"), F.array(F.lit("s1")), F.lit(None).cast("array<struct<metric:string,operator:string,value:double,unit:string>>")).alias("r")).first().r
    assert '"Fees are due monthly."' in reply("Fees are due monthly.") and reply("Fees are due monthly.").endswith("Source: H — u") and reply("no") == facts.REFUSAL


def test_packing_by_headings(spark):
    """Another heading begins a passage once the one before has enough words; a sentence is repeated under the same heading only."""
    w = lambda c, n: " ".join([c] * (n - 1) + [c + "."])
    parts = [("A", "1", f"{w('a', 50)} {w('b', 9)}"), ("B", None, w("c", 70)), ("C", None, f"{w('d', 100)} {w('e', 70)} Watch this video now.")]
    doc = spark.createDataFrame([(1, parts), (2, None), (3, [("A", "1", w("a", 60)), ("B", "2", w("b", 61))])], "k int, s array<struct<heading_path:string,section_id:string,text:string>>")
    got = [(r.k, r.chunk, r.heading_path, r.section_id, r.n_words) for r in chunking.passages(doc, "k", sections="s", promo=tx.PROMO).orderBy("k", "chunk").collect()]
    assert got == [(1, 0, "A", "1", 129), (1, 1, "C", None, 100), (1, 2, "C", None, 170), (3, 0, "A", "1", 60), (3, 1, "B", "2", 61)]


def test_holding(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None), (4, "")], "d int, text string")
    quotes = spark.createDataFrame([(7, "two"), (8, "one two"), (9, "two"), (5, "x"), (6, "")], "i int, quote string")
    for block in (32 << 20, 0):
        assert sorted(tuple(r) for r in decision.holding(docs, quotes, "d", "i", block=block).collect()) == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 9)]
    assert decision.holding(docs, quotes.limit(0), "d", "i").count() == 0


def test_streams(spark, tmp_path):
    """Windowed coverage and keyed upserts over micro-batches give what the batch forms do."""
    from tessera.streaming import coverage

    rows = [(datetime(2024, 1, 1 + i // 4, i, tzinfo=timezone.utc), "ab"[i % 2], i % 3 == 0, i) for i in range(8)]
    src = spark.createDataFrame(rows, "ts timestamp, event_type string, gap boolean, seq int")
    for part in range(2):
        src.filter(F.col("seq") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = coverage.coverage(stream).writeStream.format("memory").queryName("runs").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "a")).start()
    assert q.awaitTermination(90)
    want = src.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("runs"), F.count_if("gap").alias("gaps"))
    assert sorted(map(str, spark.table("runs").collect())) == sorted(map(str, want.collect()))
    q = stream.writeStream.foreachBatch(coverage.upserting(str(tmp_path / "out"), ["event_type"], "seq")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "b")).start()
    assert q.awaitTermination(90)
    assert sorted((r.event_type, r.seq) for r in spark.read.parquet(str(tmp_path / "out" / "1")).collect()) == [("a", 6), ("b", 7)]
