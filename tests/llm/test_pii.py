import random
import re

from tandem.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d) if d else 0, "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end(), m[0]) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if good(k, m[0])]


FIXED = [
    None, "", "mail a.b@c.de, x@y@z.com_d@e.f and a@b c@d.e-f..g", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4853345444325509",
    "+1 (462) 555-7216 é +4930 1234567. +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "\U0001f600 a@b.c 漢 1.1.1.1", "1" * 60_000 + " " + "a" * 60_000 + "@", "1 " * 30_000, "+" + "1(" * 30_000 + "2", "a@b." + "c." * 20_000 + "d", "x.1.2.3.4@a.b 4111111111111111.1.1.1",
]


def test_patterns_against_plain_ones(spark):
    rng = random.Random(5)
    texts = FIXED + ["".join(rng.choices(["1", "23", "4111111111111111", ".", "-", " ", "+", "(", "@", "a", "B", "_", "é", "\U0001f600"], k=rng.randrange(60))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find_spans(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r.base] == brute(texts[r.doc_id]), texts[r.doc_id]


def revealing():
    """A name stands by one phone number in many texts, other words by all numbers."""
    rng = random.Random(1)
    w = lambda: f"w{rng.randrange(12)}"
    texts = [f"{w()} {w()} call Zanthor at +44 20 7946 1111 {w()} {w()}" if i % 2 else f"{w()} call us at +44 20 7946 {2000 + i} {w()} {w()}" for i in range(24)]
    texts += [" ".join(w() for _ in range(12)) for _ in range(60)]
    texts += ["no name, only +44 20 7946 1111 " + "and much text " * 40 + "until ZANTHOR comes", "Zanthor without a number"]
    copies = ["the unique Quorvex wrote from q@r.st here"] * 9
    return texts + copies


def told(text):
    return re.findall("zanthor", text.lower()) if "1111" in (text or "") else []


def test_terms_that_reveal(spark):
    texts = revealing()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, start int")
    for r in pii.find_spans(docs).collect():
        assert [s.value for s in r.spans if s.kind == "term"] == told(texts[r.doc_id]), texts[r.doc_id]
        assert [s for s in r.spans if s.kind != "term"] == r.base
        assert all(texts[r.doc_id][s.start : s.end].lower() == s.value.lower() for s in r.spans)
    made = pii.sanitise(docs)
    assert made.columns == ["doc_id", "start", "text", "spans"]
    out = {r.doc_id: r.text for r in made.collect()}
    assert "call <term> at <phone> " in out[1] and "<email>" in out[len(texts) - 1] and "Quorvex" in out[len(texts) - 1]
    assert "until <term> comes" in out[84] and out[85] == texts[85]
    assert all(out[i] == t for i, t in enumerate(texts) if not brute(t))


def test_odd_rows(spark):
    rows = [(None, "a@b.c d"), (None, None), (1, "a@b.c"), (1, "a@b.c"), (1, "other +1 234 567 89"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r.doc_id, [s.value for s in r.spans], r.text)) for r in pii.sanitise(docs).collect())
    want = [(None, ["a@b.c"], "<email> d"), (None, [], ""), (1, ["a@b.c"], "<email>"), (1, ["a@b.c"], "<email>"), (1, ["+1 234 567 89"], "other <phone>"), (2, [], "")]
    assert got == sorted(map(str, want))
    assert pii.sanitise(docs.limit(0)).count() == 0 and pii.find_spans(docs.limit(0)).count() == 0
    assert "Python" not in pii.find_spans(docs)._jdf.queryExecution().executedPlan().toString()


def test_sql_has_the_same_terms(spark):
    import duckdb
    import pandas as pd
    from pyspark.sql import functions as F

    texts = [t for t in revealing() + FIXED if t is None or len(t) < 5000]
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(pii.PII_SQL).df().sort_values("doc_id")
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = found.select("doc_id", pii.span_text(F.col("spans")).alias("spans")).orderBy("doc_id").collect()
    assert [r.spans for r in got] == want["spans"].tolist()
    assert sum("term" in r.spans for r in got) >= 13
