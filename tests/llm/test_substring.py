import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=20):
    seen, out = {}, {}
    order = sorted({(d is not None, d or 0, d, t) for d, t in docs}, key=lambda x: x[:2])
    for _, _, d, t in order:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if seen.setdefault(x, (d, i)) != (d, i):
                gone.update(range(i, i + window))
        out[d, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24))
def test_any_two_positions_meet_on_the_cover(period):
    cover = set(substring.difference_cover(period))
    assert all(any((i + o) % period in cover and (j + o) % period in cover for o in range(period)) for i in range(period) for j in range(period))


def test_plan():
    assert substring.plan_anchors(20) == (13, (0, 1, 3, 9), 8)
    for window in (2, 9, 10, 50):
        period, _, size = substring.plan_anchors(window)
        assert size >= 1 and period - 1 + size == window


@pytest.mark.parametrize(("window", "odd"), [(20, True), (20, False), (9, True)])
def test_against_loops(spark, window, odd):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(window + 7)]
    docs = []
    for d in range(60):
        body = [f"v{rng.randrange(4 if d % 9 == 0 else 4000)}" for _ in range(rng.randrange(0, 90))]
        if d % 3 == 0:
            at, cut = rng.randrange(len(body) + 1), rng.randrange(9)
            body[at:at] = passage[cut:]
        if d % 4 == 0:
            body += ["\n"] + passage[: rng.randrange(len(passage))] + ["é漢\U0001f600"]
        docs.append((d, " ".join(body)))
    docs += [(100, docs[7][1]), (101, docs[7][1]), (101, docs[7][1]), (102, None), (103, ""), (104, "  \n"), (105, "same " * 3000)]
    if odd:  # ids that are null or stand for several texts
        docs += [(None, docs[9][1] + " " + docs[12][1])]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_words int, places string")
    made = substring.remove_repeats(frame, window=window)
    assert made.columns == ["doc_id", "places", "text", "n_words", "n_removed"]
    want = brute(docs, window)
    got = made.collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.text)) for r in got) == sorted(str((d, *want[d, t])) for d, t in docs)
    assert sum(r.n_removed for r in got) > 500
    assert substring.remove_repeats(frame.limit(0), window=window).count() == 0
