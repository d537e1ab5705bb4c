import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tandem.operators import align, classify, judge, layout, report
from tandem.sources import runs as src
from tandem.streaming import review

SIDE = "struct<page:int,text:string,span:array<int>>"
FINDINGS = f"run_id string, input_ord int, type string, source string, pair_id string, sentence_id string, section string, en {SIDE}, zh {SIDE}, explanation string, confidence double"
ALL = ("The buyer may pay HK$5.", [0, 9])


def finding(n, kind, source="llm", pair=None, sid=None, section="Terms", en=(1, *ALL), zh=(1, "買方", [0, 2]), expl="Differs.", conf=0.834):
    return ("r", n, kind, source, pair, sid, section, en, zh, expl, conf)


def classified(spark, rows, sections=(), glossary=(), authoritative="EN"):
    made = classify.classify(
        spark.createDataFrame(rows, FINDINGS), spark.createDataFrame(list(sections), "run_id string, sec_n int, en_heading string, zh_heading string"),
        spark.createDataFrame(list(glossary), "run_id string, en string, zh string"), spark.createDataFrame([("r", authoritative, "English", "Chinese")], "run_id string, authoritative string, name_a string, name_b string"),
    )
    return sorted(made.collect(), key=lambda r: r.id)


def test_dedupe_rank_and_ids(spark):
    rows = [
        finding(1, "NUMBER_MISMATCH", "deterministic", "p_002"), finding(2, "NUMBER_MISMATCH", "deterministic", "p_002"), finding(3, "MEANING_SHIFT", pair="p_002"), finding(4, "WORDING", pair="p_003"),
        finding(5, "WORDING", pair="p_003"), finding(6, "MEANING_SHIFT", pair="p_001", en=(None, "x", None), zh=(7, "y", None)), finding(7, "MEANING_SHIFT", pair="p_009", en=(2, "x", None)), finding(8, "ODD", sid="en_s4"),
    ]
    got = [(r.id, r.type, r.severity, r.pair_id) for r in classified(spark, rows)]
    assert got == [("f_001", "NUMBER_MISMATCH", "Critical", "p_002"), ("f_002", "MEANING_SHIFT", "Material", "p_009"), ("f_003", "MEANING_SHIFT", "Material", "p_001"), ("f_004", "ODD", "Cosmetic", None), ("f_005", "WORDING", "Cosmetic", "p_003")]


def test_escalation_and_wording(spark):
    null = (1, "", None)
    rows = [
        finding(1, "OMISSION_MINOR", sid="en_s1", en=(1, "The buyer shall pay.", [0, 20]), zh=null, expl="It is missing from the Chinese version."),
        finding(2, "OMISSION_MINOR", sid="en_s2", en=(1, "Just some words here.", [0, 21]), zh=null, expl=""),
        finding(3, "OMISSION_MINOR", sid="en_s3", en=(1, "The Escrow Agent of old.", [0, 24]), zh=null, expl="Gone"),
        finding(4, "HEDGE_CHANGE", pair="p_001", section="Terms"),
        finding(5, "HEDGE_CHANGE", pair="p_002", section="Prices"),
    ]
    got = {r.sentence_id or r.pair_id: r for r in classified(spark, rows, sections=[("r", 1, "Terms", "風險因素"), ("r", 2, "Prices", "價格")], glossary=[("r", "Escrow Agent", "託管代理")])}
    assert got["en_s1"].type == "OMISSION_MATERIAL" and got["en_s1"].explanation == "It is omitted from Chinese."
    assert got["en_s2"].type == "OMISSION_MINOR" and got["en_s2"].explanation == "Omitted from Chinese."
    assert got["en_s3"].type == "OMISSION_MATERIAL" and got["en_s3"].explanation == "Gone — omitted from Chinese."
    assert (got["p_001"].severity, got["p_002"].severity) == ("Critical", "Material")
    assert got["p_001"].confidence == 0.83 and got["p_001"].status == "unreviewed"


def test_fallback(spark):
    rows = [finding(1, "WORDING", pair="p_001"), finding(2, "WORDING", pair="p_001"), finding(3, "NUMBER_MISMATCH", pair="p_002"), finding(4, "ODD", pair="p_001")]
    made = classify.fallback_classify(spark.createDataFrame(rows, FINDINGS).withColumn("sentence_id", F.lit(None).cast("string"))).orderBy("id").collect()
    assert [(r.id, r.type, r.severity) for r in made] == [("f_001", "NUMBER_MISMATCH", "Critical"), ("f_002", "ODD", "Cosmetic"), ("f_003", "WORDING", "Cosmetic")]


def test_full_text(spark):
    rows = [("r", "en", n, f"Sentence {n}.") for n in (2, 1, 3)]
    made = judge.full_text(spark.createDataFrame(rows, "run_id string, slot string, s_n int, text string"), chars=20)
    assert made.first().text == "Sentence 1.\nSentence"


def test_order_of_input_rows_does_not_matter(spark):
    rows = [finding(n, k, pair=f"p_{n % 4:03d}") for n, k in enumerate(["WORDING", "MEANING_SHIFT", "HEDGE_CHANGE"] * 5)]
    assert classified(spark, rows) == classified(spark, rows[::-1])


def line(page, block, no, text, size=10.0, bold=False, y=100.0, slot="en"):
    return ("r", slot, page, block, no, text, size, bold, 50.0, y, 300.0, y + size)


def test_layout(spark):
    rows = []
    for page in (1, 2, 3):
        rows += [line(page, 0, 0, "Example Holdings Limited", y=20.0), line(page, 9, 0, f"Page {page} of 3", y=800.0)]
    rows += [
        line(1, 1, 0, "1. Terms", bold=True, y=50.0), line(1, 1, 1, "The buyer shall pay the price in full when due.", y=72.0), line(1, 1, 2, "It was signed by Mr. Lee. All agree.", y=84.0),
        line(1, 2, 0, "This line continues the paragraph before it.", y=97.0), line(1, 3, 0, "BIG TITLE", size=18.0, y=200.0), line(2, 1, 0, "A second page with some more text for the body.", y=60.0),
        line(1, 1, 0, "一、條款", y=60.0, slot="zh"), line(1, 2, 0, "買方須支付", y=150.0, slot="zh"), line(1, 2, 1, "全部價款。賣方須交付股份。好。", y=162.0, slot="zh"),
    ]
    scripts = spark.createDataFrame([("r", "en", "Latn"), ("r", "zh", "Hant")], "run_id string, slot string, script string")
    blocks, sentences = layout.layout(spark.createDataFrame(rows, src.LINES), scripts)
    got = [(b.block_id, b.text, b.is_heading) for b in sorted(blocks.collect(), key=lambda b: (b.slot, b.block_n))]
    assert got == [
        ("en_b1", "1. Terms", True), ("en_b2", "The buyer shall pay the price in full when due. It was signed by Mr. Lee. All agree. This line continues the paragraph before it.", False),
        ("en_b3", "BIG TITLE", True), ("en_b4", "A second page with some more text for the body.", False), ("zh_b1", "一、條款", True), ("zh_b2", "買方須支付全部價款。賣方須交付股份。好。", False),
    ]
    texts = [(s.sid, s.text) for s in sorted(sentences.collect(), key=lambda s: (s.slot, s.s_n))]
    assert texts == [
        ("en_s1", "The buyer shall pay the price in full when due."), ("en_s2", "It was signed by Mr. Lee."), ("en_s3", "All agree."), ("en_s4", "This line continues the paragraph before it."), ("en_s5", "A second page with some more text for the body."),
        ("zh_s1", "買方須支付全部價款。"), ("zh_s2", "賣方須交付股份。好。"),
    ]
    pages = spark.createDataFrame([("r", "en", p) for p in (1, 2, 4)], "run_id string, slot string, page int")
    assert [p.page for p in layout.unreadable_pages(pages, spark.createDataFrame(rows, src.LINES)).collect()] == [4]
    heads = {h.slot: h.head for h in layout.first_pages_text(blocks, chars=10).collect()}
    assert heads["en"].startswith("# 1. Terms\nThe buyer") and "BIG" not in heads["en"]


def test_lines_from_spans(spark):
    spans = spark.createDataFrame([("r", "en", 1, 0, 0, 0, "Total  ", 12.04, True, 1.0, 2.0, 3.0, 4.0), ("r", "en", 1, 0, 0, 1, "of the price", 10.0, False, 3.0, 1.0, 9.0, 4.0)], "run_id string, slot string, page int, block_no int, line_no int, span_no int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")
    got = layout.project_lines(spans).first()
    assert (got.text, got.size, got.bold, got.x1, got.y0) == ("Total of the price", 10.0, False, 9.0, 1.0)


def test_alignment(spark):
    texts = {"en": ["Price is 5 dollars and no more.", "Closing is on day 12 of June.", "An extra remark that stands alone in this version and nowhere else."], "zh": ["價格為5元正。", "於六月12日完成。"]}
    rows = [("r", "sec_1", s, f"{s}_s{i}", i, t) for s, ts in texts.items() for i, t in enumerate(ts, 1)]
    sentences = spark.createDataFrame(rows, "run_id string, sec_id string, slot string, sid string, s_n int, text string")
    made = align.align_by_length(sentences, ratio=3.0)
    assert [(r.en_ids, r.zh_ids) for r in made.orderBy("ord").collect()] == [(["en_s1"], ["zh_s1"]), (["en_s2"], ["zh_s2"])]
    numbered = align.number_pairs(made.withColumn("sec_n", F.lit(1)))
    assert [r.pair_id for r in numbered.orderBy("pair_n").collect()] == ["p_001", "p_002"]
    assert [r.sid for r in align.unpaired(sentences, made).collect()] == ["en_s3"]


def test_matches_are_accepted_in_order(spark):
    rows = [("r", 0, 0, 0, 0.9), ("r", 1, 0, 1, 0.9), ("r", 2, 1, 1, 0.8), ("r", 3, 5, 2, 0.8), ("r", 4, 2, 1, 0.8)]
    got = align.accept_matches(spark.createDataFrame(rows, "run_id string, ord int, i int, j int, score double"), spark.createDataFrame([("r", 3, 3)], "run_id string, n_en int, n_zh int"))
    assert sorted((r.i, r.j) for r in got.collect()) == [(0, 0), (1, 1)]
    pairs = [("r", "s", 0, ["a", "b"], ["x"], 0.9), ("r", "s", 1, ["b", "c"], ["y"], 0.9), ("r", "s", 2, ["a"], ["z"], 0.9)]
    kept = align.accept_pairs(spark.createDataFrame(pairs, "run_id string, sec_id string, ord int, en_ids array<string>, zh_ids array<string>, score double")).orderBy("ord").collect()
    assert [(r.en_ids, r.zh_ids) for r in kept] == [(["a", "b"], ["x"]), (["c"], ["y"])]


def test_terms_glossary_and_prevailing(spark):
    text = '"Buyer" means X. “Seller” shall mean Y. „Preis“ bedeutet Z. «Prix» désigne P. 「買方」指甲。"Buyer" means again'
    assert spark.range(1).select(align.terms(F.lit(text)).alias("t")).first().t == ["Buyer", "Seller", "Prix", "Preis", "買方"]
    blocks = spark.createDataFrame([("r", "zh", 1, "以英文版本為準", False), ("r", "en", 3, "The Chinese text shall prevail.", False), ("q", "en", 1, "The German version shall be binding", False), ("s", "en", 1, "nothing", False)], "run_id string, slot string, block_n int, text string, is_heading boolean")
    assert {r.run_id: r.code for r in align.prevailing(blocks).collect()} == {"r": "zh", "q": "de"}
    defs = spark.createDataFrame([("r", "en", 1, "Terms", True), ("r", "en", 2, "a", False), ("r", "en", 3, "Definitions", True), ("r", "en", 4, "b", False), ("r", "en", 5, "c", False), ("q", "en", 1, "z", False)], "run_id string, slot string, block_n int, text string, is_heading boolean")
    assert {r.run_id: r.text for r in align.definitions_text(defs).collect()} == {"r": "b\nc", "q": "z"}
    listed = spark.createDataFrame([("r", ["a", "b"], ["x", "y"]), ("q", ["a"], ["x", "y"])], "run_id string, en_terms array<string>, zh_terms array<string>")
    assert [(g.run_id, g.en, g.zh) for g in align.glossary(listed).orderBy("ord").collect()] == [("r", "a", "x"), ("r", "b", "y")]


PAIRS = "run_id string, sec_id string, section string, pair_id string, pair_n int, en_ids array<string>, zh_ids array<string>, en_text string, zh_text string, en_page int, zh_page int"
JUDGED = "run_id string, tier string, pair_id string, verdict string, en_span string, zh_span string, explanation string, confidence double"


def pairs(spark):
    return spark.createDataFrame([("r", "s", "Terms", f"p_{n:03d}", n, [f"en_s{n}"], [f"zh_s{n}"], f"The  buyer may pay {n}.", f"買方可支付{n}", 1, 2) for n in range(1, 6)], PAIRS)


def test_cascade(spark):
    rows = [
        ("r", "triage", "p_001", "EQUIVALENT", None, None, None, 0.9), ("r", "triage", "p_002", "HEDGE_CHANGE", "may", None, " ", None), ("r", "strong", "p_002", "MEANING_SHIFT", "the BUYER may", None, "", 1.7),
        ("r", "triage", "p_003", "WORDING", "absent", None, "x", 0.5), ("r", "triage", "p_004", "PARTIAL_OMISSION", "absent", None, "x", 0.5), ("r", "triage", "p_005", "SCOPE_CHANGE", None, None, "x", 0.5), ("r", "strong", "p_005", "EQUIVALENT", None, None, "x", 0.5),
    ]
    judged = judge.cascade(pairs(spark), judge.recorded_provider(spark.createDataFrame(rows, JUDGED)))
    found = {f.pair_id: f for f in judge.pair_findings(judged, pairs(spark)).collect()}
    assert set(found) == {"p_002", "p_004"}
    assert found["p_002"].type == "MEANING_SHIFT" and found["p_002"].en.span == [0, 14] and found["p_002"].confidence == 1.0
    assert found["p_002"].explanation == "Meaning Shift between the two versions."
    assert found["p_004"].type == "OMISSION_MINOR" and found["p_004"].en.span is None
    assert judge.cascade(pairs(spark), judge.rule_provider()).where("verdict = 'HEDGE_CHANGE'").count() == 5


def test_batch_sizes(spark):
    rows = [("r", "a", n) for n in range(23)] + [("r", "b", n) for n in range(7)]
    made = judge.batches(spark.createDataFrame(rows, "run_id string, sec_id string, pair_n int"))
    sizes = made.groupBy("sec_id", "batch_no").count().orderBy("sec_id", "batch_no").collect()
    assert [s["count"] for s in sizes] == [10, 10, 3, 7]


def test_omissions(spark):
    omitted = spark.createDataFrame([("r", "s", "en", "en_s9", 9, 3, "Left out here.", "Terms"), ("r", "s", "en", "en_s8", 8, 3, "Elsewhere.", "Terms"), ("r", "s", "zh", "zh_s7", 7, 4, "遺漏", "Terms")], "run_id string, sec_id string, slot string, sid string, s_n int, page int, text string, section string")
    sentences = spark.createDataFrame([("r", s, f"{s}_s{n}", n) for s in ("en", "zh") for n in range(1, 10)], "run_id string, slot string, sid string, s_n int")
    near = judge.neighbours(omitted, sentences, pairs(spark))
    judged = spark.createDataFrame([("r", "en_s9", False, True, " Why ", None), ("r", "en_s8", True, True, "x", 0.5), ("r", "zh_s7", False, False, None, 0.4)], "run_id string, sentence_id string, present_elsewhere boolean, material boolean, reason string, confidence double")
    found = {f.sentence_id: f for f in judge.omission_findings(judged, omitted, near).collect()}
    assert set(found) == {"en_s9", "zh_s7"}
    assert found["en_s9"].type == "OMISSION_MATERIAL" and found["en_s9"].en.span == [0, 14] and found["en_s9"].zh.text == "買方可支付5" and found["en_s9"].confidence == 0.9
    assert found["zh_s7"].type == "OMISSION_MINOR" and found["zh_s7"].zh.span == [0, 2] and found["zh_s7"].en.span is None and found["zh_s7"].confidence == 0.4
    united = judge.union_findings(judge.omission_findings(judged, omitted, near))
    assert sorted(r.input_ord for r in united.collect()) == [1, 2]


def run_json():
    side = lambda text, span: {"page": 1, "text": text, "span": span}
    f = lambda i, sev, status: {"id": f"f_{i:03d}", "type": "NUMBER_MISMATCH", "severity": sev, "source": "deterministic", "section": "S", "pair_id": "p_001", "sentence_id": None, "en": side("a <b> HK$5", [6, 10]), "zh": side("五元", None), "explanation": "x & y", "confidence": 1.0, "status": status, "dismiss_reason": None, "note": "n'"}
    return {"run_id": "r", "status": "done", "created_at": "2026-01-02T03:04:05Z", "meta": {"company": "A & B", "en_title": "T"}, "counts": {"critical": 1, "total": 2}, "findings": [f(2, "Cosmetic", "confirmed"), f(1, "Critical", "unreviewed")], "unaligned_sections": [], "glossary": []}


def test_report_and_run_objects(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps(run_json()))
    (tmp_path / "broken.json").write_text("{nope")
    loaded = src.read_json(spark, str(tmp_path / "run.json"), src.RUN)
    html = report.render(loaded).first().html
    assert "a &lt;b&gt; <mark>HK$5</mark>" in html and html.index("f_001") < html.index("f_002") and "A &amp; B" in html and "<td>Critical: 1</td>" in html and "2 January 2026" in html and "n&#x27;" in html
    assert report.render(loaded.withColumn("findings", F.array().cast(src.FINDINGS))).first().html.endswith("<p>No findings.</p>")
    assert src.read_json(spark, str(tmp_path / "none.json"), src.RUN).count() == 0
    assert src.read_json(spark, str(tmp_path / "broken.json"), src.RUN).first().run_id is None
    both = {r.run_id: r for r in src.load_runs(spark.createDataFrame([("r",), ("q",)], "run_id string"), loaded).collect()}
    assert both["q"].status == "running" and both["q"].counts.total == 0 and both["q"].findings == [] and both["r"].counts.critical == 1
    exported = json.loads(src.export_json(loaded).first().json)
    assert exported["findings"][1]["en"]["span"] == [6, 10]
    src.write_json(loaded, str(tmp_path / "out"))
    assert src.read_json(spark, str(tmp_path / "out"), src.RUN).first().meta.company == "A & B"
    plain = report.render_plain(loaded.select("run_id", F.explode("findings").alias("f")).select("run_id", "f.*")).first().html
    assert plain.startswith("<table><tr><td>f_001</td><td>Critical")


def test_uploads_cache_and_checks(spark):
    files = spark.createDataFrame([("a.pdf", b"%PDF-1.7"), ("b.pdf", b""), ("c.pdf", b"hello")], "path string, content binary")
    assert {r.path: r.error for r in src.check_uploads(files).collect()} == {"a.pdf": None, "b.pdf": "the file is empty", "c.pdf": "the file is not a PDF"}
    choice = lambda v: spark.range(1).select(src.normalise_authoritative(F.lit(v)).alias("x")).first().x
    assert (choice("en"), choice(" none "), choice("")) == ("EN", "none", None)
    with pytest.raises(Exception, match="must be EN, ZH or none"):
        choice("fr")
    requests = spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    cache = spark.createDataFrame([(__import__("hashlib").sha256(b"m\x1fp1").hexdigest(), "{}")], "key string, response string")
    hit, miss = src.cached(requests, cache, "m")
    assert [r.prompt for r in hit.collect()] == ["p1"] and [r.prompt for r in miss.collect()] == ["p2"]
    shapes = spark.createDataFrame([('{"a": [1], "b": "x"}',), ('{"a": 1, "b": "x"}',), ("[]",), ('{"a": []}',)], "t string")
    assert [r.v for r in shapes.select(src.valid_response(F.col("t"), {"a": "array", "b": "string"}).alias("v")).collect()] == [True, False, False, False]
    names = spark.createDataFrame([("announcement_en.pdf",), ("公告.pdf",), ("x_FR.pdf",), ("plain.pdf",)], "n string")
    assert [r.x for r in names.select(src.guess_language(F.col("n")).alias("x")).collect()] == ["en", "zh", "fr", None]


T0 = dt.datetime(2026, 1, 1)


def decisions(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    return spark.createDataFrame(
        [
            ("r", "f_001", at(1), "dismissed", "false_positive", " ok ", True, True), ("r", "f_001", at(2), "confirmed", "false_positive", "", True, True), ("r", "f_002", at(1), "dismissed", None, None, False, False),
            ("r", "f_002", at(0), "unresolved", None, None, False, False), ("r", "f_003", at(1), "bogus", None, None, False, False), ("r", "f_003", at(3), "dismissed", "acceptable_variation", "n", True, True),
        ],
        review.DECISIONS,
    )


def findings(spark):
    return spark.createDataFrame([("r", f"f_{n:03d}", "Critical" if n < 3 else "Cosmetic", "unreviewed", None, None) for n in range(1, 5)], "run_id string, id string, severity string, status string, dismiss_reason string, note string")


def test_decisions(spark):
    now = {r.id: r for r in review.applied(findings(spark), decisions(spark)).collect()}
    assert [(now[i].status, now[i].dismiss_reason, now[i].note) for i in sorted(now)] == [("confirmed", None, None), ("unresolved", None, None), ("dismissed", "acceptable_variation", "n"), ("unreviewed", None, None)]
    counts = classify.recount(review.applied(findings(spark), decisions(spark))).first()
    assert (counts.critical, counts.cosmetic, counts.reviewed, counts.total) == (2, 2, 3, 4)
    assert classify.export_gate(review.applied(findings(spark), decisions(spark))).first().ready
    assert review.next_unreviewed(findings(spark), 4).first().id == "f_001" and review.next_unreviewed(findings(spark), 1).first().id == "f_002"
    assert review.validated(decisions(spark)).where("error is not null").count() == 2


def test_decision_stream(spark, tmp_path):
    """Two batches: the second keeps the first one's decisions, and an older decision in it does not win."""
    folder, out = str(tmp_path / "in"), []

    def run():
        stream = spark.readStream.schema(review.DECISIONS).parquet(folder)
        review.review_stream(stream, findings(spark), lambda now, counts: out.append(({r.id: r.status for r in now.collect()}, counts.first().reviewed)), str(tmp_path / "check"), str(tmp_path / "log"), availableNow=True).awaitTermination(120)

    decisions(spark).coalesce(1).write.parquet(folder)
    run()
    late = [("r", "f_001", T0, "unresolved", None, None, False, False), ("r", "f_004", T0, "confirmed", None, None, False, False)]
    spark.createDataFrame(late, review.DECISIONS).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert [reviewed for _, reviewed in out] == [3, 4]
    assert out[1][0] == {"f_001": "confirmed", "f_002": "unresolved", "f_003": "dismissed", "f_004": "confirmed"}


def test_follow_until_the_end(spark, tmp_path):
    path, seen = str(tmp_path / "events"), []
    event = lambda n, stage, done: spark.createDataFrame([("r", n, T0, stage, "", done)], review.PROGRESS)
    review.append_progress(event(1, "extract", True), path)
    query, ended = review.follow(spark, path, lambda b: seen.extend(r.stage for r in b.collect()), str(tmp_path / "check"), {"r"}, seconds=0.2)
    review.append_progress(event(2, "done", True), path)
    assert review.until_ended(query, ended, 120) and seen == ["extract", "done"] and not query.isActive


def test_answers_are_recorded_and_asked_again(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def call(requests):
        asked.append(sorted(r.prompt for r in requests.collect()))
        good = F.col("prompt").isin("p1") | (F.lit(len(asked) > 1) & (F.col("prompt") == "p2"))
        return requests.select("key", F.when(good, '{"a": []}').otherwise("nonsense").alias("response"))

    requests = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "prompt string")
    found, failed = src.answered(requests, path, call, "m", {"a": "array"})
    assert sorted(r.prompt for r in found.collect()) == ["p1", "p2"] and [r.prompt for r in failed.collect()] == ["p3"]
    assert asked == [["p1", "p2", "p3"], ["p2", "p3"]]
    again, _ = src.answered(requests.where("prompt <> 'p3'"), path, call, "m", {"a": "array"})
    assert again.count() == 2 and len(asked) == 2


def test_files_become_lines(spark, tmp_path):
    from tandem.sources import documents

    for slot, content in (("en", b"%PDF one\ntwo"), ("zh", b"%PDF three"), ("xx", b"no"), ("yy", b"")):
        (tmp_path / "run7").mkdir(exist_ok=True)
        (tmp_path / "run7" / f"{slot}.pdf").write_bytes(content)
    parse = lambda content: [(1, n, 0, t.decode(), 10.0, False, 0.0, 0.0, 1.0, 1.0) for n, t in enumerate(content[5:].split(b"\n"))]
    made = documents.lines_of(documents.read_files(spark, str(tmp_path)), parse)
    assert sorted((r.run_id, r.slot, r.text) for r in made.collect()) == [("run7", "en", "one"), ("run7", "en", "two"), ("run7", "zh", "three")]


def test_progress(spark, tmp_path):
    rows = [("r", n, T0, s, "", d) for n, (s, d) in enumerate([("extract", True), ("align", False), ("align", True), ("done", True), ("late", False)])] + [("q", 1, T0, "detect", "", True)]
    events = spark.createDataFrame(rows, review.PROGRESS)
    assert {r.run_id: (r.reached, r.finished) for r in review.stage_state(events).collect()} == {"r": (8, 1), "q": (2, 0)}
    assert review.until_terminal(events).where("run_id = 'r'").count() == 4
    ended = review.with_terminal(events, spark.createDataFrame([("r", "done"), ("q", "error")], "run_id string, status string"))
    assert ended.where("stage = 'done'").groupBy("run_id").count().count() == 2
    assert [r.finished_of for r in review.running_counts(events).where("stage = 'align'").orderBy("seq").collect()] == [1, 2]
    events.write.parquet(str(tmp_path / "in"))
    stream = review.stage_state(spark.readStream.schema(review.PROGRESS).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("stages").where("finished = 1").first().run_id == "r"
