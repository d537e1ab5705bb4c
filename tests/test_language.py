import pytest
from pyspark.sql import functions as F

from tandem.functions import language

SAMPLES = [
    ("The company shall pay the amount in full, and that is all of it.", "en", "Latn"),
    ("La société a été informée que le prix est dans les comptes de la banque.", "fr", "Latn"),
    ("Die Gesellschaft hat den Vertrag mit der Bank nicht unterzeichnet und wird es nicht tun.", "de", "Latn"),
    ("Il contratto è stato firmato con la società e non è più in vigore.", "it", "Latn"),
    ("El contrato se firmó con la sociedad y no es válido para los socios.", "es", "Latn"),
    ("O contrato não foi assinado com a sociedade e não é mais válido para os sócios.", "pt", "Latn"),
    ("De overeenkomst is niet ondertekend en het bedrag wordt door de bank betaald.", "nl", "Latn"),
    ("本公司於二零二六年公佈業績，這個董事會認為條款公平合理。", "zh", "Hant"),
    ("这个公司于二零二六年发布业绩，董事会认为条款公平合理。", "zh", "Hans"),
    ("これは日本語の文章です。会社は発表しました。", "ja", "Jpan"),
    ("이 회사는 오늘 발표했습니다 그리고 계속합니다", "ko", "Hang"),
    ("xyzzy qwerty", "und", "Zyyy"),
    ("", "und", "Zyyy"),
    (None, "und", "Zyyy"),
    ("12345 !!", "und", "Zyyy"),
]


def test_detect(spark):
    frame = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SAMPLES)], "i int, t string")
    for r in frame.select("i", language.detect_language(F.col("t")).alias("x")).collect():
        assert (r.x.code, r.x.script) == SAMPLES[r.i][1:], SAMPLES[r.i]


@pytest.mark.parametrize(
    ("text", "cjk", "want"),
    [
        ("Mr. Smith of No. 5 came. He left! \"Why?\" It is approx. This.", False, ["Mr. Smith of No. 5 came.", "He left!", "\"Why?\" It is approx. This."]),
        ("Un prix. Évident. « Oui. » Non", False, ["Un prix.", "Évident.", "« Oui. » Non"]),
        ("no capital. here", False, ["no capital. here"]),
        ("甲公司宣佈收購。是。乙公司同意所有條款；好！完成日期待定", True, ["甲公司宣佈收購。是。", "乙公司同意所有條款；好！", "完成日期待定"]),
        ("是。甲公司宣佈收購。", True, ["是。", "甲公司宣佈收購。"]),
        ("  ", False, []),
    ],
)
def test_sentences(spark, text, cjk, want):
    assert spark.range(1).select(language.sentences(F.lit(text), cjk).alias("s")).first().s == want


def test_helpers(spark):
    row = spark.range(1).select(language.short_name(F.lit("Chinese (Traditional)")).alias("n"), language.joiner(F.lit("Hant")).alias("j"), language.joiner(F.lit("Hang")).alias("k"), language.modals(F.lit("zh"), F.lit("Hans")).alias("m"), language.modals(F.lit("xx"), F.lit("Latn")).alias("e")).first()
    assert (row.n, row.j, row.k, row.m[1], row.e) == ("Chinese", "", " ", "将", ["may", "will", "shall", "must"])
