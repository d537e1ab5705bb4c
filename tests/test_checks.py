import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.functions import tokens as tk
from tandem.operators import checks

NUMBER, DATE, CURRENCY = "NUMBER_MISMATCH", "DATE_MISMATCH", "CURRENCY_MISMATCH"
U202F, NBSP = " ", " "

#: (codes, text a, text b, expected (type, span a, span b))
PAIRS = [
    ("en-zh", "The consideration is HK$12.4 million.", "代價為港幣1,210萬元。", [(NUMBER, [21, 36], [3, 12])]),
    ("en-zh", "The consideration is HK$12,100,000.", "代價為港幣1,210萬元。", []),
    ("en-zh", "Completion by 24 September 2026 and 60% of all", "二零二六年九月二十四日完成，佔百分之六十", []),
    ("en-zh", "The long stop date is 30 September 2026.", "最後截止日期為2026年9月24日。", [(DATE, [22, 39], [7, 17])]),
    ("en-zh", "under Rule 14.07(1), Chapter 14A and paragraph 2 (1) first", "根據第14.07(1)條、第14A章", []),
    ("en-zh", "revenue of HK$1.2 billion", "收入為港幣12億元", []),
    ("en-zh", "July 5, 2026", "2026年7月5日", []),
    ("en-zh", "on 5/7/2026", "於2026年5月7日", [(DATE, [3, 11], [1, 10])]),
    ("en-zh", "US$5 million", "港幣500萬元", [(CURRENCY, [0, 3], [0, 2])]),
    ("en-zh", "Revenue was 3,456 units.", "收入增加。", [(NUMBER, [12, 17], None)]),
    ("en-zh", "It is fully consistent.", "一般而言十分一致。", []),
    ("en-zh", "RMB9,300,000", "人民幣930萬元", []),
    ("en-zh", "Q3 results rose by 5%", "Q3業績上升5%", []),
    ("en-zh", "\U0001f600 It costs 12 units", "成本為15個", [(NUMBER, [11, 13], [3, 5])]),
    ("en-zh", "on 31 February 2026", "2026年2月31日", []),
    ("en-zh", "the first time in 2025", "首次", []),
    ("en-fr", "a price of 1,234,567.89 euros", f"un prix de 1{U202F}234{NBSP}567,89 euros", []),
    ("en-fr", "EUR 12.4 million", "12,1 millions d'euros", [(NUMBER, [0, 16], [0, 13])]),
    ("en-fr", "on 24 September 2026", "le 24 septembre 2026, article 12, le 1er rang", []),
    ("en-de", "HK$2,500 and 60 per cent", "HKD 2.500 und 60 Prozent", []),
    ("en-de", "on 24 September 2026", "am 25.09.2026", [(DATE, [3, 20], [3, 13])]),
    ("en-de", "CHF 1,234,567.89", "CHF 1'234'567.89", []),
    ("en-it", "2 billion", "2 miliardi", []),
    ("en-es", "12.4 million", "12,4 millones", []),
]


@pytest.mark.parametrize("codes", sorted({p[0] for p in PAIRS}))
def test_pairs(spark, codes):
    cases = [p for p in PAIRS if p[0] == codes]
    a, b = codes.split("-")
    frame = spark.createDataFrame([(i, p[1], p[2]) for i, p in enumerate(cases)], "i int, a string, b string")
    rows = frame.select("i", checks.check_pair(F.col("a"), F.col("b"), a, b).alias("f")).collect()
    for r in rows:
        assert [(f.type, f.en_span, f.zh_span) for f in r.f] == cases[r.i][3], cases[r.i]


def test_explanations(spark):
    frame = spark.createDataFrame([("The consideration is HK$12.4 million.", "代價為港幣1,210萬元。")], "a string, b string")
    found = frame.select(checks.check_pair(F.col("a"), F.col("b")).alias("f")).first().f
    assert found[0].explanation == "English states HK$12.4 million; Chinese states HK$12.1 million."


def test_columns_dispatch_like_literals(spark):
    cases = [p for p in PAIRS if p[0] in ("en-fr", "en-de")]
    frame = spark.createDataFrame([(i, p[1], p[2], p[0][:2], p[0][3:]) for i, p in enumerate(cases)], "i int, a string, b string, ca string, cb string")
    for r in frame.select("i", checks.check_pair(F.col("a"), F.col("b"), F.col("ca"), F.col("cb")).alias("f")).collect():
        assert [(f.type, f.en_span, f.zh_span) for f in r.f] == cases[r.i][3]


def test_chinese_numerals(spark):
    cases = {"六十": 60, "一千二百萬": 12_000_000, "十二": 12, "三億五千萬": 350_000_000, "二零二六": 2026, "一萬億": 1e12, "三點五": 3.5, "兩百零五": 205}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in frame.select("t", tk.cjk_number(F.col("t")).alias("v")).collect()} == pytest.approx(cases)


def loop_match(a, b):
    same = lambda x, y: abs(x - y) <= max(1e-6 * max(abs(x), abs(y)), 1e-9)
    rest, left = list(b), []
    for x in a:
        at = next((i for i, y in enumerate(rest) if same(x, y)), None)
        left.append(x) if at is None else rest.pop(at)
    return left, rest


def loop_nearest(a, b):
    rest, out = list(b), []
    for x in a:
        out.append((x, rest.pop(min(range(len(rest)), key=lambda i: (abs(x - rest[i]), i)))) if rest else (x, None))
    return out + [(None, y) for y in rest]


def test_folds_against_loops(spark):
    rng = random.Random(3)
    bag = lambda: [rng.choice([1.0, 2.0, 2.0000001, 5.0, 7.5, 100.0, 100.00001]) for _ in range(rng.randrange(7))]
    cases = [(i, bag(), bag()) for i in range(300)]
    frame = spark.createDataFrame(cases, "i int, a array<double>, b array<double>")
    matched = checks.bag_match(F.col("a"), F.col("b"), checks.same, "array<double>")
    near = checks.nearest_pairs(F.col("a"), F.col("b"), lambda x, y: F.abs(x - y), "array<double>")
    for r in frame.select("i", matched.alias("m"), near.alias("n")).collect():
        _, a, b = cases[r.i]
        assert (r.m.a, r.m.b) == loop_match(a, b)
        assert [(p.a, p.b) for p in r.n] == loop_nearest(a, b)


def test_equal_texts_have_no_findings(spark):
    texts = [p[1] for p in PAIRS] + ["", "no figures"]
    frame = spark.createDataFrame([(t,) for t in texts], "a string")
    assert frame.select(F.sum(F.size(checks.check_pair(F.col("a"), F.col("a"), "en", "en")))).first()[0] == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="12,. ()%HK$aé年月\U0001f600", max_size=30), min_size=20, max_size=20))
def test_spans_stand_for_their_text(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for code in ("en", "fr", "zh"):
        for r in frame.select("t", tk.numbers(F.col("t"), code, tk.none_of(tk.DATE)).alias("n")).collect():
            assert all(r.t[n.s : n.e] == n.raw for n in r.n)


def test_run_checks_joins_sentences(spark):
    pairs = spark.createDataFrame([("r", "p_001", "Price", ["en_s1", "en_s2", "gone"], ["zh_s1"]), ("r", "p_002", "Empty", ["en_s3"], [])], "run_id string, pair_id string, section string, en_ids array<string>, zh_ids array<string>")
    sentences = spark.createDataFrame(
        [("r", "en", "en_s1", 2, " It costs ", "Latn"), ("r", "en", "en_s2", 3, "HK$12.4 million.", "Latn"), ("r", "en", "en_s3", 1, "Alone 5.", "Latn"), ("r", "zh", "zh_s1", 2, "代價為港幣1,210萬元。", "Hant")],
        "run_id string, slot string, sid string, page int, text string, script string",
    )
    found = checks.run_checks(checks.pair_texts(pairs, sentences)).collect()
    assert len(found) == 1 and found[0].pair_id == "p_001" and found[0].en.text == "It costs HK$12.4 million." and found[0].en.page == 2 and found[0].en.span == [9, 24]
