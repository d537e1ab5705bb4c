from pyspark.sql import functions as F

from tandem.operators import judge
from tandem.plans.audit import audit
from tandem.sources import runs as src

EN = [
    ("# 1. Terms", None), ("The consideration is HK$12.4 million and it is payable by the buyer.", None), ("The long stop date is 30 September 2026 for all of the conditions.", None), ("The buyer may extend the date of the closing with the consent of the seller.", None),
    ("# 2. General", None), ("The Chinese version of this announcement shall prevail.", None), ("The board is of the view that the terms are fair and it will publish them.", None),
]
ZH = [
    ("# 一、條款", None), ("代價為港幣1,210萬元，由買方支付並於完成時以現金全數付清。", None), ("所有條件的最後截止日期為2026年9月24日，除非各方另行協定。", None), ("買方經賣方同意後延長完成日期，並須以書面通知各方當事人。", None),
    ("# 二、一般事項", None), ("本公告以中文版本為準。", None), ("董事會認為條款公平，並將於稍後公佈。", None), ("# 三、附錄", None), ("附錄內容載於此處供股東參考。", None),
]


def lines(run, slot, rows):
    for n, (text, _) in enumerate(rows):
        head = text.startswith("# ")
        yield run, slot, 1 + n // 5, n, 0, text.removeprefix("# "), 10.0, head, 50.0, 60.0 + 30 * (n % 5), 300.0, 70.0 + 30 * (n % 5)


def test_planted_pair(spark):
    rows = [r for run in ("r_1", "r_2") for s, t in (("en", EN), ("zh", ZH)) for r in lines(run, s, t)] + [r for s in ("en", "zh") for r in lines("r_same", s, EN)]
    made = audit(spark.createDataFrame(rows, src.LINES), provider=judge.rule_provider())
    findings = made.findings.orderBy("run_id", "id").collect()
    own = [(f.type, f.severity, f.explanation) for f in findings if f.run_id == "r_1"]
    assert ("NUMBER_MISMATCH", "Critical", "English states HK$12.4 million; Chinese states HK$12.1 million.") in own
    assert ("DATE_MISMATCH", "Critical", "English long stop date is 30 September 2026; Chinese is 24 September 2026.") in own
    assert own == [(f.type, f.severity, f.explanation) for f in findings if f.run_id == "r_2"]
    meta = {m.run_id: m for m in made.meta.collect()}
    assert (meta["r_1"].en_code, meta["r_1"].zh_script, meta["r_1"].authoritative, meta["r_1"].en_title) == ("en", "Hant", "ZH", "1. Terms")
    assert [(u.slot, u.heading) for u in made.unaligned_sections.where("run_id = 'r_1'").collect()] == [("zh", "三、附錄")]
    assert not [f for f in findings if f.run_id == "r_same" and f.source == "deterministic"]
    runs = {r.run_id: r for r in made.runs().collect()}
    assert runs["r_1"].counts.critical >= 2 and runs["r_1"].counts.unaligned_sections == 1 and runs["r_1"].findings[0].id == "f_001"
    assert made.pairs.where("run_id = 'r_1'").agg(F.min("pair_id"), F.count(F.lit(1))).first()[:] == ("p_001", 5)
