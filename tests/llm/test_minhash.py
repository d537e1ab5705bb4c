import random
import re

import numpy as np
import pytest

from tandem.llm import graph, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, size):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, size, percent):
    sets = [grams(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and docs[i][0] is not None and docs[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(str((d, len(sets[i]), least.get(root(i)) if d is not None else None)) for i, (d, _) in enumerate(docs))


def corpus(seed, n=160, words=90):
    rng = random.Random(seed)
    docs = []
    shared = [f"s{i}" for i in range(40)]
    for d in range(n):
        if docs and rng.random() < 0.6:
            body = (rng.choice(docs)[1] or "").split(" ")
            for _ in range(rng.randrange(0, 5)):
                body[rng.randrange(len(body))] = f"e{rng.randrange(10**6)}"
        else:
            body = [f"v{rng.randrange(10**5)}" for _ in range(rng.randrange(1, words))]
            if rng.random() < 0.5:
                body += shared
        docs.append((d, " ".join(body)))
    rng.shuffle(docs)
    return docs


ODD = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "one  two"), (1007, "One Two three"), (None, "one two"), (1008, "z" * 70_000), (1009, "Z" * 70_000), (1010, "é É"), (1010, "é É"), (1011, "a b c " * 400), (1012, "a b c " * 300)]


@pytest.mark.parametrize(("size", "percent", "large", "block"), [(3, 85, 20_000, (256, 2048)), (5, 80, 20_000, (3, 4)), (3, 85, 8, (2, 2))])
def test_against_all_pairs(spark, monkeypatch, size, percent, large, block):
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = corpus(size * percent) + ODD
    frame = spark.createDataFrame([(d, t, 1, True, "n") for d, t in docs], "doc_id long, text string, node int, kept boolean, n string")
    got = minhash.near_duplicates(frame, shingle_words=size, percent=percent).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs, size, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_split_buckets_lose_nothing(spark, monkeypatch):
    """One bucket for all, members of several components: found by splitting."""
    monkeypatch.setattr(minhash, "LARGE", 12)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(300)]
    docs = []
    for family in range(6):
        own = base[:240] + [f"f{family}x{i}" for i in range(90)]
        for member in range(6):
            body = list(own)
            for _ in range(4):
                body[rng.randrange(len(body))] = f"m{family}.{member}.{rng.randrange(999)}"
            docs.append((member * 6 + family, " ".join(body)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = minhash.near_duplicates(frame, shingle_words=3, percent=85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs, 3, 85)


def one_bucket(monkeypatch, docs, size):
    """All documents in a single bucket: one band, of a register that they share."""
    registers = np.array([minhash.registers(minhash.shingle_set(t, size)) for _, t in docs])
    shared = np.flatnonzero((registers == registers[0]).all(0))
    assert shared[0] == 0
    monkeypatch.setattr(minhash, "band_shape", lambda percent: (1, 1))


def test_large_bucket_keeps_the_links_of_an_outsider(spark, monkeypatch):
    """A group far above LARGE, and a document that reaches the threshold only with one that is not the group's smallest."""
    monkeypatch.setattr(minhash, "LARGE", 3)
    base = [f"b6.{i}" for i in range(93)]
    docs = [(i, " ".join([*base, *(f"g{i}.{j}" for j in range(5))])) for i in range(30)]
    docs += [(30 + n, " ".join([*base, *(f"u{j}" for j in range(own))])) for n, own in enumerate((8, 14))]
    one_bucket(monkeypatch, docs, 1)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=1, percent=85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs, 1, 85)
    assert {r.component_id for r in got} == {0}


def test_members_that_collide_do_not_crowd_out_a_link(spark, monkeypatch):
    """Three members of a component have the highest bounds by equal prints; the true link is a fourth one."""
    p, q = "p60", "p205"
    assert minhash.prints(minhash.shingle_set(p, 1)) == minhash.prints(minhash.shingle_set(q, 1))
    base = [f"a{i}" for i in range(11)]
    own = [["a", "b", q], [q, "a"], [q, "b"], [q], [p, "a", "b"], [p]]
    docs = [(i, " ".join([*base, *x])) for i, x in enumerate(own)]
    one_bucket(monkeypatch, docs, 1)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=1, percent=85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs, 1, 85)
    assert {r.component_id for r in got} == {0}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for n, t in ((60, 0.9), (1000, 0.85), (20_000, 0.5), (5000, 0.0)):
        union = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        cut = int(n * (1 - t) / 2)
        a, b = np.unique(union[: n - cut]), np.unique(union[cut:])
        if t == 0:
            a, b = np.unique(union[: n // 2]), np.unique(union[n // 2 :])
        regs = [minhash.registers(x)[None] for x in (a, b)]
        got = minhash.estimated_jaccard(*regs, np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - t) < 0.17
        assert minhash.plausible(np.array([got]), np.array([len(a)]), np.array([len(b)]), 85)[0] or t < 0.85


def test_registers_hold_zeros_and_mantissa():
    h = np.array([1 << 40], np.uint64)
    value = int(minhash.mix(h + np.uint64(0x632BE59BD9B4E019))[0])
    zeros = 64 - value.bit_length()
    mantissa = int(format(value, "064b")[zeros + 1 :][:10].ljust(10, "0"), 2)
    assert set(minhash.registers(h).tolist()) == {zeros << 10 | mantissa}


def test_bounds_are_never_below_the_similarity():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 9000, dtype=np.uint64) << np.uint64(1)
    one = np.unique(rng.choice(pool, 4000))
    others = [np.unique(rng.choice(pool, n)) for n in (6, 500, 4000, 9000)] + [one]
    fine = [minhash.prints(x) for x in others]
    sizes = np.array([len(x) for x in fine])
    got = minhash.similarity_bounds(minhash.prints(one), np.concatenate(fine), np.cumsum(sizes) - sizes, sizes)
    for x, bound in zip(others, got, strict=True):
        true = len(np.intersect1d(one, x)) / len(np.union1d(one, x))
        assert true - 1e-12 <= bound <= true + 0.1
    assert got[-1] == 1


def test_chosen_pairs():
    bound, label = np.array([0.99, 0.86, 0.95, 0.9, 0.93, 0.85]), np.array([1, 1, 1, 1, 1, 2])
    assert sorted(minhash.chosen(bound, label, 100, 85).tolist()) == [0, 2, 4, 5]
    assert sorted(minhash.chosen(bound, label, 10_000, 85).tolist()) == [0, 1, 2, 3, 4, 5]


def test_band_shape_keeps_its_promise():
    for percent in (50, 80, 85, 95):
        bands, rows = minhash.band_shape(percent)
        assert bands * rows <= minhash.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= 1e-6


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(2)
    ids = list(range(120))
    rng.shuffle(ids)
    edges = {"path": list(zip(ids[:60], ids[1:61])), "star": [(ids[0], x) for x in ids[1:50]], "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(70)]}[kind]
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    assert {r.node: r.label for r in got} == parent
