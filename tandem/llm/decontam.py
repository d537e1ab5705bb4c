"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

A document leaks an item if some run of as many words as the item has is at
least ``threshold`` similar to it: weighted Jaccard similarity of the two bags
of ``SHINGLE``-word shingles.  A document of fewer words than the item is one
window as a whole.  Words are the runs of letters and digits of the
lower-cased text.  A shingle of the item weighs log(1 + items / items that hold
it), one that the item does not hold weighs most, log(1 + items).

Every window that shares a shingle with an item is judged (the others have
similarity 0, so nothing is lost by leaving them out).  Its fingerprint is the
``BITS``-bit SimHash of its weighted shingles, from running sums over the
document.  The items' fingerprints stand in a multi-index: cut into ``BLOCKS``
blocks of 13 or 14 bits, two fingerprints that differ in at most ``RADIUS`` bits
agree in one block up to ``SLACK`` bits.  The index holds every item under all
such neighbours of its blocks, so one look-up for each block of a window finds
every item within the radius; of unrelated items of the same length it returns
about one in seven.  Those within the radius are compared exactly.

The radius is the one approximate step.  At similarity 0.8 fingerprints differ
in about 39 of 256 bits (deviation 6); a radius of 56 misses 1 in 1000 windows
that are just at the threshold, and in practice none that is above it.

The benchmark is a query set against all documents.  How many items hold each
shingle is counted over all of them by Spark.  The items go to the executors in
blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_SHINGLES`` shingles with their
own weights, one block in memory and one pass over the documents at a time;
similarities do not depend on the blocks.  Documents are judged where they are
read, whole, without a shuffle.

Defined results: null and empty texts and items leak nothing and match nothing,
nor do empty tables; an item of fewer than ``SHINGLE`` words is one shingle, so
only the same words match it; repeated documents or items each give their own
rows; an item with a null id is left out; ties for the best window go to the
first.  A very long document is judged in parts of bounded memory.  Item ids are
of any type that Arrow knows.  Extra columns pass through ``decontaminate``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tandem.llm.common import hash128, materialize, text_of

SHINGLE = 5
THRESHOLD = 0.8

#: Bits of a fingerprint, blocks of the index, and bits in which a block may differ.
BITS = 256
BLOCKS = 19
SLACK = 2
RADIUS = BLOCKS * (SLACK + 1) - 1

#: Items and shingles that are in memory at once.
BLOCK_ITEMS = 2000
BLOCK_SHINGLES = 1_000_000

#: Windows whose fingerprints are made at once.
WINDOWS = 4096

_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EDGES = np.linspace(0, BITS, BLOCKS + 1).astype(int)
_LANE = 32  # bits whose votes are summed at once


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) | 1  # 0 stands for a word that no item holds


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of ``size`` words, or of those that start at the places given."""
    if at is None:
        at = np.arange(max(0, len(hashes) - size + 1))
    h = np.full(len(at), np.uint64(size))
    for i in range(size):
        h = _mix(h * _ODD + hashes[at + i])
    return h


def item_shingles(ws: list[str]) -> np.ndarray:
    return shingles(np.fromiter(map(word_hash, ws), np.uint64, len(ws)), min(SHINGLE, len(ws)))


def _votes(hashes: np.ndarray, weights: np.ndarray, lane: int) -> np.ndarray:
    """One row of signed weights for each shingle, a column for each bit of a lane."""
    own = _mix(hashes + np.array([lane + 1], np.uint64) * _ODD)
    bits = (own[:, None] >> np.arange(_LANE, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
    return (2 * bits - 1) * weights[:, None]


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """SimHash bits, one row for each window of ``span`` shingles."""
    bits = np.empty((len(starts), BITS), bool)
    for lane in range(BITS // _LANE):
        sums = np.concatenate([np.zeros((1, _LANE)), np.cumsum(_votes(hashes, weights, lane), 0)])
        bits[:, lane * _LANE : (lane + 1) * _LANE] = sums[starts + span] - sums[starts] > 1e-6  # ties are 0, whatever the rounding
    return bits


def block_keys(bits: np.ndarray) -> np.ndarray:
    """The blocks of each fingerprint as numbers."""
    return np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(_EDGES, _EDGES[1:], strict=False)], 1)


@lru_cache(maxsize=4)
def neighbours(width: int) -> np.ndarray:
    """Numbers of ``width`` bits of which at most ``SLACK`` are set."""
    return np.array([sum(1 << b for b in bs) for n in range(SLACK + 1) for bs in combinations(range(width), n)], np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


class Items:
    """One block of the query set, ready to judge documents.

    ``items`` are (id, text, [(shingle, items that hold it)]) with all shingles
    that more than one of the ``total`` items holds.
    """

    def __init__(self, items: list[tuple[object, str, list[tuple[int, int]]]], total: int, threshold: float = THRESHOLD) -> None:
        self.threshold, self.top = threshold, log(1 + total)
        split = [(i, ws, dict(held or ())) for i, t, held in items if (ws := words(t or ""))]
        self.ids = [i for i, _, _ in split]
        self.vocabulary = {w: word_hash(w) for _, ws, _ in split for w in ws}
        self.lengths = np.array([len(ws) for _, ws, _ in split], np.int64)
        hashed = [item_shingles(ws) for _, ws, _ in split]
        self.bags = [Counter(s.tolist()) for s in hashed]
        weight = lambda h, held: log(1 + total / held.get(h - (1 << 64) if h >> 63 else h, 1))
        self.weights = [{h: weight(h, held) for h in bag} for bag, (_, _, held) in zip(self.bags, split, strict=True)]
        known = {h: w for own in self.weights for h, w in own.items()}
        self.known = np.array(sorted(known), np.uint64)
        self.known_weight = np.array([known[h] for h in self.known.tolist()])
        self.of_shingle: dict[int, list[int]] = defaultdict(list)
        for n, bag in enumerate(self.bags):
            for h in bag:
                self.of_shingle[h].append(n)
        bits = [fingerprints(s, self.weight(s), np.zeros(1, int), len(s)) for s in hashed]
        self.index(np.concatenate([np.zeros((0, BITS), bool), *bits]))

    def index(self, bits: np.ndarray) -> None:
        """All neighbours of the blocks of each item, by length, block and number."""
        self.prints = _packed(bits)
        self.slot = {length: n for n, length in enumerate(np.unique(self.lengths).tolist())}
        slots = np.array([self.slot[length] for length in self.lengths.tolist()], np.int64)
        own, keys, items = block_keys(bits), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for b in range(BLOCKS):
            near = own[:, b, None] ^ neighbours(int(_EDGES[b + 1] - _EDGES[b]))[None]
            keys.append(self.place(slots, b)[:, None].repeat(near.shape[1], 1).ravel() | near.ravel())
            items.append(np.arange(len(own), dtype=np.int32).repeat(near.shape[1]))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        self.keys, self.items = every[order], np.concatenate(items)[order]

    @staticmethod
    def place(slot, block):
        return (slot * BLOCKS + block) << 14

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), self.top)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.known_weight[at], self.top)

    def similarity(self, window: Counter, item: int) -> float:
        bag, weights = self.bags[item], self.weights[item]
        both = least = 0.0
        for h, n in bag.items():
            m = window.get(h, 0)
            least += weights[h] * min(n, m)
            both += weights[h] * max(n, m)
        foreign = sum(m for h, m in window.items() if h not in bag)
        return least / (both + self.top * foreign)

    def near(self, bits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the items of a length that lie within the radius of a window's fingerprint."""
        windows, items = self.looked_up(bits, length)
        apart = np.bitwise_count(_packed(bits)[windows] ^ self.prints[items]).sum(1)
        return windows[apart <= RADIUS], items[apart <= RADIUS]

    def looked_up(self, bits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) that agree in a block up to the slack, by window."""
        keys = self.place(self.slot[length], np.arange(BLOCKS))[None] | block_keys(bits)
        low, high = np.searchsorted(self.keys, keys, "left").ravel(), np.searchsorted(self.keys, keys, "right").ravel()
        counts = high - low
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        items = self.items[np.repeat(low, counts) + offset].astype(np.int64)
        pairs = np.unique(np.repeat(np.repeat(np.arange(len(bits)), BLOCKS), counts) * len(self.ids) + items)
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def leaks(self, text: str) -> list[tuple[object, float, int, int]]:
        """(item id, similarity, first word, word after the last) of the best window for each item found."""
        ws = words(text)
        own = np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.uint64, len(ws))
        missing = np.concatenate([[0], np.cumsum(own == 0)])
        found = []
        full = None
        for size in range(1, SHINGLE + 1):
            if not (np.minimum(self.lengths, SHINGLE) == size).any() or len(ws) < size:
                continue
            at = np.flatnonzero(missing[size:] == missing[:-size])
            hashes = shingles(own, size, at)
            place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[place] == hashes
            places = defaultdict(list)
            for p, h in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
                for length in {int(self.lengths[n]) for n in self.of_shingle[h]}:
                    if min(SHINGLE, length) == size:
                        places[length].append(p)
            if places and full is None:
                full = np.array([h or word_hash(w) for h, w in zip(own.tolist(), ws, strict=True)], np.uint64)
            if places:
                hashes = shingles(full, size)
            for length, near in places.items():
                found += self.windows(hashes, length, size, np.array(near))
        return found

    def windows(self, hashes: np.ndarray, length: int, size: int, near: np.ndarray) -> list[tuple[object, float, int, int]]:
        """Judge every window of ``length`` words, or all of a shorter document, that holds one of the shingles at ``near``."""
        span = min(length - size + 1, len(hashes))
        last = len(hashes) - span
        inside = np.zeros(last + 2, np.int64)
        np.add.at(inside, np.clip(near - span + 1, 0, last + 1), 1)
        np.add.at(inside, np.clip(near + 1, 0, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(inside)[: last + 1] > 0)
        best: dict[int, tuple[float, int]] = {}
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for at in range(0, len(part), WINDOWS):
                self.judge(hashes, part[at : at + WINDOWS], span, length, best)
        return [(self.ids[n], s, p, p + span + size - 1) for n, (s, p) in sorted(best.items())]

    def judge(self, hashes: np.ndarray, starts: np.ndarray, span: int, length: int, best: dict[int, tuple[float, int]]) -> None:
        if not len(starts):
            return
        low = int(starts[0])
        own = hashes[low : int(starts[-1]) + span]
        bits = fingerprints(own, self.weight(own), starts - low, span)
        bag, of = Counter(), -1
        for w, n in zip(*(x.tolist() for x in self.near(bits, length)), strict=True):
            if w != of:
                at = int(starts[w])
                bag, of = Counter(hashes[at : at + span].tolist()), w
            s = self.similarity(bag, n)
            if s >= self.threshold and (n not in best or s > best[n][0] + 1e-12):
                best[n] = (s, int(starts[w]))


#: The block that this worker judges by.
_READY: dict[str, Items] = {}


def _leaks_column(text: Column, payload: Broadcast, token: str, item_type, threshold: float) -> Column:
    kind = ArrayType(StructType([StructField("item", item_type), StructField("similarity", DoubleType()), StructField("first_word", LongType()), StructField("end_word", LongType())]))
    out = to_arrow_type(kind)

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if token not in _READY:
            _READY.clear()
            _READY[token] = Items(*payload.value, threshold)
        items = _READY[token]
        for batch in texts:
            rows = ([{"item": i, "similarity": s, "first_word": a, "end_word": b} for i, s, a, b in items.leaks(t.as_py() or "")] for t in batch)
            yield pa.array(rows, out, size=len(batch))

    return F.arrow_udf(judge, kind)(text)


def prepared(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(r, i, t, n, held): items with the number of their shingles, and those of them that several items hold with how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [item_shingles(words(t.as_py())).view(np.int64) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("i"), b.column("t"), pa.array(hashes, pa.list_(pa.int64()))], names=["r", "i", "t", "s"])

    known = benchmark.select(F.monotonically_increasing_id().alias("r"), F.col(item).alias("i"), F.col(text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    kind = StructType([*known.schema.fields, StructField("s", ArrayType(LongType()))])
    items = materialize(known.mapInArrow(run, kind).where(F.size("s") > 0))
    each = items.select("r", F.explode(F.array_distinct("s")).alias("h"))
    several = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = each.join(several, "h").groupBy("r").agg(F.collect_list(F.struct("h", "n")).alias("held"))
    return materialize(items.select("r", "i", "t", F.size("s").alias("n")).join(held, "r", "left"))


def _passes(benchmark: DataFrame, item: str, text: str, threshold: float, block_items: int):
    """One function from a text column to its leaks for each block; a block is in memory while it is used."""
    spark, items = benchmark.sparkSession, prepared(benchmark, item, text)
    total, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(-(-total // block_items), -(-size // BLOCK_SHINGLES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("r"), F.lit(blocks)) == b).orderBy("i", "t", "r").collect()
        own = [(r.i, r.t, [(x.h, x.n) for x in r.held or ()]) for r in rows]
        payload = spark.sparkContext.broadcast((own, total))
        yield blocks, lambda column, p=payload: _leaks_column(column, p, uuid.uuid4().hex, benchmark.schema[item].dataType, threshold)
        if blocks > 1:
            payload.unpersist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(key, item_id, similarity, first_word, end_word): the best window of each document and item that leaks."""
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("t"))
    named = lambda d: d.select(key, F.explode("x").alias("x")).select(key, F.col("x.item").alias("item_id"), "x.similarity", "x.first_word", "x.end_word")
    made = None
    for blocks, leaks in _passes(benchmark, item, item_text, threshold, block_items):
        found = named(rows.select(key, leaks(F.col("t")).alias("x")))
        found = materialize(found) if blocks > 1 else found
        made = found if made is None else made.union(found)
    if made is None:
        empty = F.array().cast(ArrayType(StructType([StructField("item", benchmark.schema[item].dataType), StructField("similarity", DoubleType()), StructField("first_word", LongType()), StructField("end_word", LongType())])))
        return named(rows.select(key, empty.alias("x")))
    return made


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows that leak no item, with their columns as they are.

    With one block rows are judged and passed on where they are read; with
    several each pass writes the hashes of the texts that leak.
    """
    rows = docs.select(F.struct("*").alias("row"), text_of(text).alias("t"))
    bad = None
    for blocks, leaks in _passes(benchmark, item, item_text, threshold, block_items):
        if blocks == 1:
            return rows.withColumn("x", leaks(F.col("t"))).where(F.size("x") == 0).select("row.*")
        h0, h1 = hash128(F.col("t"))
        found = materialize(rows.select("t", leaks(F.col("t")).alias("x")).where(F.size("x") > 0).select(h0.alias("h0"), h1.alias("h1")).distinct())
        bad = found if bad is None else bad.union(found)
    if bad is None:
        return docs
    h0, h1 = hash128(F.col("t"))
    return rows.withColumns({"h0": h0, "h1": h1}).join(bad, ["h0", "h1"], "left_anti").select("row.*")
