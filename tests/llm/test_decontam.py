import random
from collections import Counter
from math import log

import numpy as np
from pyspark.sql import functions as F

from tandem.llm import decontam


def brute(docs, items, threshold=0.8):
    """Best window of every document and item by exact similarity of every window."""
    split = {i: decontam.words(t or "") for i, t in items if i is not None}
    split = {i: w for i, w in split.items() if w}
    grams = lambda w, k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    size = {i: min(decontam.SHINGLE, len(w)) for i, w in split.items()}
    held = Counter(g for i, w in split.items() for g in set(grams(w, size[i])))
    for d, t in docs:
        ws = decontam.words(t or "")
        for i, w in split.items():
            b, best = Counter(grams(w, size[i])), (0, 0)
            weight = lambda g: log(1 + len(split) / (held[g] if g in b else 1))  # noqa: B023, E731
            for p in range(len(ws) - len(w) + 1):
                a = Counter(grams(ws[p : p + len(w)], size[i]))
                s = sum(weight(g) * min(a[g], b[g]) for g in a) / sum(weight(g) * max(a[g], b[g]) for g in a | b)
                if s > best[0] + 1e-12:
                    best = (s, p)
            if best[0] >= threshold:
                yield d, i, round(best[0], 9), best[1], best[1] + len(w)


def fixture():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 30, 31, 45])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "...!"), (23, "Same same same same same same same"), (24, items[2][1] + " tail")]
    docs = []
    for d in range(40):
        body = rng.choices([*vocabulary, "x1", "x2", "x3"], k=rng.randrange(0, 120))
        if d % 2:
            copy = decontam.words(items[d % 12][1])
            if d % 3 == 0:
                copy[rng.randrange(len(copy))] = "edited"
            if d % 5 == 0:
                copy.insert(len(copy) // 2, "more")
            body[10:10] = copy
        docs.append((d, ", ".join(body).upper() if d % 7 == 0 else " ".join(body)))
    return docs + [(50, None), (51, ""), (52, "same, " * 40), (53, items[4][1]), (53, items[4][1])], items


def test_against_all_windows(spark):
    docs, items = fixture()
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.end_word) for r in got)
    want = sorted(brute(docs, items))
    assert found == want and len(want) > 12


def test_blocks_give_the_same_rows(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (4,):
        got = decontam.find_leaks(d, b, block_items=size).collect()
        assert sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.end_word) for r in got) == sorted(brute(docs, items))


def test_document_shorter_than_the_item_is_one_window(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(item[:-1])), (2, " ".join(item[1:])), (3, " ".join(item[:20])), (4, "w0 w1 w2")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.find_leaks(frame, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 6), r.first_word, r.end_word) for r in got) == [(1, 7, round(35 / 36, 6), 0, 39), (2, 7, round(35 / 36, 6), 0, 39)]


def test_decontaminate_keeps_clean_rows_whole(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(d, t, "l", [1]) for d, t in docs], "doc_id long, text string, leaks string, similarity array<int>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, *_ in brute(docs, items)}
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)
    assert decontam.decontaminate(frame.limit(0), bench).count() == 0
    assert decontam.decontaminate(frame, bench.limit(0)).count() == len(docs)


def shared_items(n=60):
    """Items that share a passage, and one-word edits of them."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(25)]
    items = [(i, " ".join([f"a{i}x{j}" for j in range(rng.randrange(40, 70))] + passage)) for i in range(n)]
    docs = []
    for i, t in items:
        ws = t.split()
        ws[rng.randrange(len(ws))] = "edited"
        docs.append((i, "before it " + " ".join(ws) + " and after"))
    return docs, items


def test_weights_do_not_depend_on_blocks(spark):
    docs, items = shared_items()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda size: sorted((r.doc_id, r.item_id, round(r.similarity, 12), r.first_word) for r in decontam.find_leaks(d, b, block_items=size).collect())
    whole = rows(1000)
    assert whole == rows(20) and len(whole) > 45
    assert [(x, y, round(z, 9), p) for x, y, z, p in whole] == sorted(w[:4] for w in brute(docs, items))
    kept = lambda size: sorted(r.doc_id for r in decontam.decontaminate(d, b, block_items=size).collect())
    assert kept(1000) == kept(20) == sorted(set(range(60)) - {x for x, *_ in whole})


def test_other_kinds_of_ids(spark):
    docs, items = shared_items(4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for kind in ("decimal(5,1)", "date", "short", "string"):
        b = spark.createDataFrame(items, "item_id int, text string").withColumn("item_id", F.expr("date'2020-01-01' + item_id") if kind == "date" else F.col("item_id").cast(kind))
        made = decontam.find_leaks(d, b)
        assert made.schema["item_id"].dataType == b.schema["item_id"].dataType and made.count() >= 3


def made_items(n, rng):
    return decontam.Items([(i, " ".join(f"a{rng.randrange(4000)}" for _ in range(40)), []) for i in range(n)], n)


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(1)
    items = made_items(50, rng)
    bits = np.unpackbits(items.prints.view(np.uint8), axis=1).astype(bool)
    for n in range(50):
        for flips in (0, 1, 20, decontam.RADIUS):
            q = bits[n].copy()
            q[rng.sample(range(decontam.BITS), flips)] ^= True
            assert n in items.near(q[None], 40)[1]


def test_multi_index_filters():
    """Of unrelated items the index returns less than a fifth."""
    rng = random.Random(2)
    items = made_items(300, rng)
    windows = np.array([[rng.random() < 0.5 for _ in range(decontam.BITS)] for _ in range(200)])
    assert len(items.looked_up(windows, 40)[0]) < 0.2 * 300 * 200


def test_very_long_text(spark):
    docs, items = shared_items(2)
    long = "w0 w1 w2 " * 60_000 + docs[0][1] + " w3" * 60_000
    d = spark.createDataFrame([(1, long)], "doc_id long, text string")
    got = decontam.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.item_id, r.first_word) for r in got] == [(0, 180_002)]
