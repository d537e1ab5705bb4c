import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tandem.llm import bpe, classifier
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_rules_lines import brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A third of the smallest documents with their benchmark and labels, and odd rows."""
    folder = tmp_path_factory.mktemp("pipeline")
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id < 70")
    item = spark.read.parquet(f"{source}/benchmark.parquet").first().text
    line = "a line that is long enough to be deduplicated, more than forty"
    odd = [(900, None), (901, ""), (902, f"Some words before. {item} And some after that."), (903, docs.first().text + " x"), (None, docs.first().text)]
    odd += [(910 + i, f"{line}\nBody number {i} of an ordinary text with {i * 7} words, and it goes on.") for i in range(6)]
    extra = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_stages_against_loops(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    model = classifier.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    slots = classifier.Indicators()
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score(slots(r.text or "")) >= 0.3]
    rows = [(d, t) for d, t, _, _ in brute_lines(rows)]
    groups = [eval(x) for x in brute_groups(rows, 5, 80)]
    stays = {d for d, n, c in groups if d is not None and (d == c or n == 0)}
    rows = [(d, t) for d, t in rows if d is None or d in stays]
    bad = {d for d, *_ in brute_leaks([(d, t) for d, t in rows if d is not None], items)}
    assert 902 in bad
    rows = [(d, t) for d, t in rows if d not in bad]
    enc = bpe.encoder(public_tokenizers.path(pipeline.BPE_RANKS), public_tokenizers.PATTERN)
    want = sorted(str((d, enc.encode_ordinary(t or ""))) for d, t in rows)
    got = pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    found = got.collect()
    assert sorted(str((r.doc_id, r.ids)) for r in found) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


def test_stages_return_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clashing = ("quality_score", "score", "n_lines", "n_dropped", "leaks", "row", "t", "kept", "others", "x")
    wide = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in clashing})
    for _, stage in pipeline.STAGES[:-1]:
        made = stage(spark, wide, tables)
        assert made.columns == COLUMNS + list(clashing) and made.schema == wide.schema
        assert made.where(F.col("doc_id").isNotNull()).where(" or ".join(f"{c} <> concat('{c}', doc_id)" for c in clashing)).count() == 0


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, tables).select(F.count(F.lit(1))).first()[0] == 0
