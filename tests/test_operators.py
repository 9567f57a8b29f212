import random

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, decision, facts, trail, vectors
from tessera.plans import catalog
from tessera.sources import files, html


def test_greedy_keeps_what_a_loop_keeps(spark):
    rnd = random.Random(5)
    for n in (1, 12, 40):
        pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.12}
        kept = []
        for i in range(n):
            if not any((k, i) in pairs for k in kept):
                kept.append(i)
        nodes = spark.createDataFrame([(i, i) for i in range(n)], "id long, rank long")
        edges = spark.createDataFrame(sorted(pairs), "q long, id long") if pairs else spark.createDataFrame([], "q long, id long")
        assert sorted(r.id for r in vectors.greedy_keep(nodes, edges).collect()) == kept


def test_nearest_takes_every_vector(spark, monkeypatch):
    """Only vectors 1 and 3, which a sample of every twentieth leaves out, are near; blocks of 8 make several scans."""
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rnd = random.Random(9)
    v = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(43)]
    v[3] = v[1]
    unit = [[x / sum(y * y for y in a) ** 0.5 for x in a] for a in v]
    want = {i: max(sum(x * y for x, y in zip(a, b)) for j, b in enumerate(unit) if j != i) for i, a in enumerate(unit)}
    got = {r.q: r.cosine for r in vectors.nearest(spark.createDataFrame(list(enumerate(v)), "id long, embedding array<float>")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    assert max(got.values()) > 0.999 > max(got[i] for i in got if i % 20 == 0)


def test_packing_equals_loop(spark):
    rnd = random.Random(2)
    texts = [" ".join(" ".join("w" * rnd.randint(1, 5) for _ in range(rnd.choice((3, 20, 70, 160)))) + "." for _ in range(rnd.randint(0, 12))) for _ in range(25)]
    want = []
    for key, t in enumerate(texts):
        done, buf = [], []
        size = lambda ss: sum(len(s.split()) for s in ss)
        for s in [x + "." for x in t.split(". ") if x] if t else []:
            s = s.replace("..", ".")
            if buf and size(buf) + len(s.split()) > 150:
                done.append(buf)
                buf = [buf[-1], s]
            else:
                buf = [*buf, s]
        if buf and done and size(buf) < 60 and size(done[-1]) + size(buf) <= 240:
            done[-1] = done[-1] + buf
        elif buf:
            done.append(buf)
        want += [(key, i, size(b)) for i, b in enumerate(done)]
    got = chunking.pack(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k").collect()
    assert sorted((r.k, r.chunk, r.n_words) for r in got) == want


def test_numbers_need_no_window_and_grow(spark):
    """Numbered as packed or by a window: the same ids; a document of over 10,000 passages has as many ids."""
    rnd = random.Random(4)
    texts = [" ".join(" ".join("w" * rnd.randint(1, 5) for _ in range(rnd.choice((3, 12, 60, 149, 151)))) + "." for _ in range(rnd.randint(0, 9))) for _ in range(30)]
    docs = spark.createDataFrame([*enumerate([*texts, "", None]), (None, "one two.")], "k int, text string")
    for fewest in (0, 20, 130):
        packed, windowed = chunking.numbered_passages(docs, "k", fewest), chunking.number(chunking.passages(docs, "k"), "k", fewest)
        assert sorted(map(str, packed.collect())) == sorted(map(str, windowed.select(packed.columns).collect()))
    many = spark.range(10_002).select(F.lit(1).alias("k"), F.col("id").alias("chunk"), F.lit(30).alias("n_words"))
    ids = {r.chunk_id for r in chunking.number(many, "k").collect()}
    assert len(ids) == 10_002 and {"1#0007", "1#10001"} <= ids


def test_passages_equal_reference_rules(spark):
    """A loop of the rules of W8: hard split, fold with one sentence repeated, every short passage merged backwards."""
    rnd = random.Random(3)
    texts = [" ".join(" ".join("w" * rnd.randint(1, 5) for _ in range(rnd.choice((3, 20, 45, 70, 148, 150, 151, 160, 300, 470)))) + "." for _ in range(rnd.randint(0, 14))) for _ in range(40)]
    sized = lambda *ns: " ".join(" ".join("v" * (1 + i % 7) for i in range(n)) + "." for n in ns)
    texts += ["", "word " * 3805, sized(151), sized(70, 70, 3, 20, 148, 40), sized(3, 160, 2)]
    want, inner = [], 0
    for key, t in enumerate(texts):
        units = []
        for s in [x.rstrip(".") + "." for x in t.split(". ") if x] if "." in t else [t] if t else []:
            w = s.split()
            units += [w[i : i + 150] for i in range(0, len(w), 150)]
        chunks, buf = [], []
        for u in units:
            if buf and sum(map(len, buf)) + len(u) > 150:
                chunks.append(sum(buf, []))
                buf = buf[-1:]
            buf.append(u)
        if buf:
            chunks.append(sum(buf, []))
        merged = []
        for i, c in enumerate(chunks):
            if merged and len(c) < 60 and len(merged[-1]) + len(c) <= 240:
                merged[-1] = merged[-1] + c
                inner += i + 1 < len(chunks)
            else:
                merged.append(c)
        want += [(key, i, len(c), " ".join(c)) for i, c in enumerate(merged)]
    assert inner  # a merge before the last passage is among the cases
    got = chunking.passages(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k").collect()
    assert sorted((r.k, r.chunk, r.n_words, r.text) for r in got) == want
    assert max(r.n_words for r in got) <= 300


def test_readings_name_their_metric(spark):
    """F10 by its rules, and R8 from text: readings, limits, statuses, flags."""
    gap = lambda n: "ODR" + "x".center(n) + "1.5%"
    cases = [
        ("my ODR is 1.2% and my VTR is 91 per cent", [("order_defect_rate", 1.2, "ODR is 1.2%"), ("valid_tracking_rate", 91.0, "VTR is 91 per cent")]),
        ("Pre-fulfilment cancellation rate: 3 percent", [("cancellation_rate", 3.0, "Pre-fulfilment cancellation rate: 3 percent")]),
        ("valid tracking rate 98.5%", [("valid_tracking_rate", 98.5, "valid tracking rate 98.5%")]),
        ("1.4% ODR", [("order_defect_rate", 1.4, "")]),
        ("2% and then some more words ODR", []),
        (gap(60), [("order_defect_rate", 1.5, gap(60))]),
        (gap(61), []),
        ("ODR 1% then 2%, LSR", [("order_defect_rate", 1.0, "ODR 1%")]),
        ("I refunded 3% of orders", []),
        ("OTD 95.0% OTD 88%", [("on_time_delivery", 95.0, "OTD 95.0%"), ("on_time_delivery", 88.0, "OTD 88%")]),
        ("", []),
        (None, []),
    ]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "id int, text string")
    got = facts.readings(rows, ["id"], "text")
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, *r) for i, (_, rs) in enumerate(cases) for r in rs)
    limits = spark.createDataFrame(list(decision.LIMITS), "metric string, tier string, kind string, limit double")
    flags = {r.id: (r.breach_selling, r.breach_prime, r.n_close) for r in decision.standing(decision.assess(got, limits), "id").collect()}
    assert flags[0] == (True, True, 0) and flags[2] == (False, True, 0) and flags[9] == (True, True, 0) and 8 not in flags


def test_gate_properties(spark):
    states = decision.decide(catalog.gate_states(spark)).collect()
    assert len(states) == 20 * 3 * 16
    for r in states:
        free = r.topic == "" and r.confidence >= decision.FLOOR and r.has_citation and r.quotes_policy and not r.conflict and not r.breach
        assert (r.decision == "AUTO_SEND") == free
    base = decision.Policies()
    changed = base.disable("F2").with_floor("0.96")
    assert "F2" not in changed.rules() and "F2" in base.rules() and base.floor == decision.FLOOR


def test_grounding(spark):
    rows = [
        ('It says "late orders are refunded in full". See https://a.example/x?y=1', "Late orders are refunded in full, always.", ["https://a.example/x"], True),
        ('It says "late orders are never refunded".', "Late orders are refunded in full.", [], False),
        ("No quote at all.", "Late orders.", [], False),
        ('“late orders are refunded” and "wholly made up words"', "late orders are refunded", [], False),
        ('"late orders are refunded" https://b.example', "late orders are refunded", ["https://a.example"], False),
    ]
    df = spark.createDataFrame(rows, "draft string, passage string, allowed array<string>, want boolean")
    assert all(r.want == r.g.ok for r in df.withColumn("g", decision.ground(F.col("draft"), F.col("passage"), F.col("allowed"))).collect())


def test_html_lines():
    page = "<nav><p>menu</p></nav><h1>Top</h1><p>One <b>two</b><p>One two</p><li><a href='/x'>only a link</a></li><p>ab</p><script>p</script>"
    assert html.lines_of(page) == ["# Top", "One two"]
    assert html.lines_of(None) == []


def test_headings_and_trail(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# A", "x", "## B", "y", "# C", "z"])], "k int, i int, t string")
    assert [r.heading_path for r in chunking.headings(lines, "k", "i", "t").orderBy("i").collect()] == ["A", "A", "A > B", "A > B", "C", "C"]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, seq int, v string")
    assert {(r.k, r.v) for r in trail.latest(rows, ["k"], "seq").collect()} == {("a", "z"), ("b", None)}


def test_sentences_and_restate(spark):
    df = spark.createDataFrame([("Use tools, e.g. saws. Then stop! Why? ",), ("",)], "t string")
    assert [r[0] for r in df.select(tx.sentences(F.col("t"))).collect()] == [["Use tools, e.g. saws.", "Then stop!", "Why?"], []]


def test_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("> note\n\naccount\tHow?\nbad line\n")
    assert [tuple(r) for r in files.query_list(spark, str(tmp_path / "q.tsv")).collect()] == [("account", "How?")]
    (tmp_path / "doc.txt").write_text("SOURCE: http://a\nTITLE:  A  b\n" + "-" * 60 + "\nBody here\n")
    assert [tuple(r) for r in files.text_files(spark, str(tmp_path / "doc.txt")).collect()] == [("doc", "A b", "http://a", "Body here")]
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert {tuple(r) for r in files.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}
