import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tandem.llm import lines, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A = "this line is long enough to count as a key, forty and more"
B = "THIS line is LONG enough to count as a key, forty and more  "
ODD = [None, "", " \t\n\x0b ", "a", "x " * 30, "a b c d e f g h " * 3 + "tail", "é漢 \U0001f600 #*$%&|<> A\n\nb\nb\n b", f"{A}\nshort\n{B}\n{A}", "w" * 50_000, "- one\n* two\n  • three\n", "so...\nand so…\nend. \n\u2028x", "1 2 3 4 5 " * 9, " ".join(f"w{i % 9}" for i in range(4000)), " ".join(f"v{i}" for i in range(25))]


def brute_repeat(words, w=8):
    spots = defaultdict(list)
    for i in range(len(words) - w + 1):
        spots[tuple(words[i : i + w])].append(i)
    return len({i + j for at in spots.values() if len(at) > 1 for i in at for j in range(w)})


def test_measures_against_loops(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in quality_rules.quality_rules(docs, columns=tuple(quality_rules.COSTS)).collect():
        t = r.text or ""
        w = WORD.findall(t)
        full = [x for x in t.split("\n") if WORD.search(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(full) - len(set(full))
        assert r.n_repeat_words == brute_repeat(w), t[:40]
        assert r.n_alpha_words == sum(any(c.isalpha() for c in x) for x in w) and r.n_text_lines == len(full)
        assert r.n_bullets == sum(x.strip()[0] in "-*•–·●" for x in full) and r.n_ellipses == sum(x.rstrip().endswith(("...", "…")) for x in full)


def test_cascade_and_columns_agree(spark):
    docs = spark.createDataFrame([(i % 5, t, "x", True) for i, t in enumerate(ODD)], "doc_id long, text string, failed_rule string, kept boolean")
    lazy = quality_rules.quality_rules(docs)
    assert lazy.columns == ["doc_id", "text", "failed_rule", "kept"]
    eager = quality_rules.quality_rules(docs, columns=tuple(quality_rules.COSTS))
    pairs = lambda d: sorted(map(str, d.select("doc_id", "text", "kept").collect()))
    assert pairs(lazy) == pairs(eager) and len(pairs(lazy)) == len(ODD)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_order_is_by_rejections_per_cost():
    made = [quality_rules.Estimate(r, c, n) for r, c, n in zip(quality_rules.RULES, (100.0, 10.0, 200.0, 10.0), (10, 10, 10, 10))]
    assert [r.name for r in quality_rules.ordered(made)] == ["repetition", "shouting", "too_short", "symbols"]


def test_estimates_are_repeatable_and_weigh_copies(spark):
    texts = ["x " * 30] * 90 + [f"ordinary words of text number {i} " * 5 for i in range(30)] + ["short"] * 20 + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {e.rule.name: e for e in quality_rules.estimate(docs)}
    assert found["too_short"].rejected == 22 and found["repetition"].rejected == 120
    assert found["repetition"].cost > found["too_short"].cost
    assert quality_rules.estimate(docs, paid=("n_words",))[0].cost == 0
    part = quality_rules.sample(docs, sample_rows=20).collect()
    assert part == quality_rules.sample(docs.repartition(7), sample_rows=20).collect() or sorted(part) == sorted(quality_rules.sample(docs.repartition(7), sample_rows=20).collect())
    names = lambda d: sorted((r.doc_id, r.failed_rule or "") for r in quality_rules.quality_rules(d, sample_rows=20).collect())
    assert names(docs) == names(docs.repartition(5))


def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(d)
    last = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= min_docs}
    for d, t in docs:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if key(x) not in last or last[key(x)] == d]
        yield d, "\n".join(stay), len(all_), len(all_) - len(stay)


def test_lines_against_loops(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20 + i, f"{A}\nn{i}\n{B}" if i % 2 else B) for i in range(6)] + [(3, A), (3, A), (None, A), (None, None), (40, "\n".join([A] * 500))]
    docs = spark.createDataFrame([(d, t, 7, None) for d, t in rows], "doc_id long, text string, n_lines int, drop string")
    got = lines.line_dedup(docs)
    assert got.columns == ["doc_id", "drop", "text", "n_lines", "n_dropped"]
    found = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()]
    assert Counter(found) == Counter(brute_lines(rows))
    assert lines.line_dedup(docs.limit(0)).count() == 0


def test_lines_are_native(spark):
    docs = spark.createDataFrame([(1, A)], "doc_id long, text string")
    for made in (lines.line_dedup(docs), quality_rules.quality_rules(docs)):
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.select(F.count(F.lit(1))).first()[0] == 1
