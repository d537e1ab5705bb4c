"""Near-duplicate documents: HyperMinHash registers, banding, exact verification.

1. Signatures, in one pass over the texts.  A document's distinct shingles are
   hashed to 64 bits.  Each falls into one of ``REGISTERS`` buckets; a bucket
   keeps the smallest hash as its count of leading zeros (6 bits) and the
   ``MANTISSA`` bits after the leading one: 16 bits.  Empty buckets borrow from
   others along a fixed sequence, so that short texts agree on as large a share
   of registers as on shingles.
2. Equal shingle sets become one node, with the smallest id.
3. Banding: the registers are cut into bands, whose bits are the bucket keys.
   Rows per band are as many as still lose less than one pair in a million at
   the threshold.
4. In each bucket all members are paired with its smallest id only.  A pair's
   Jaccard similarity is estimated from the share of equal registers, corrected
   for the registers that unrelated sets of these sizes share by chance; a pair
   six deviations below the threshold goes.  The others are verified on the
   full shingle sets.
5. Verified links make components.  A bucket whose members are all in one
   component is done.  In the others links between members can be missing: the
   members outside the bucket's largest component are compared with all others,
   in blocks of bounded bytes, by an upper bound of their similarity from 16 bits
   of each shingle.  Pairs whose bound reaches the threshold are verified; of a
   document and a component that it is all but sure to be linked with, the three
   most similar members first, and all others if these leave them apart.
   Buckets beyond ``LARGE`` members are compared in the same way after all
   others, whose links leave fewer members outside.

No bucket is capped and no pair is skipped that could be a link.  Hot buckets
cost one pair for each member; every count and minimum is combined before it is
shuffled; full sets are built only for documents in a surviving pair.

Defined results: null and empty texts, and those of white space, have no
shingles and link with nothing; with fewer words than a shingle has, the whole
sequence is one; very long texts are hashed whole; an empty table stays empty.  Rows with a null id keep their size and get no component.
Repeated rows have the same component; rows that repeat an id with another text
are judged each by their own text.  Extra columns pass through
(``near_duplicates`` returns the result columns alone).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tandem.llm.common import materialize, text_of, wanted
from tandem.llm.graph import components
from tandem.llm.hashing import mix, run_hashes, word_hashes

REGISTERS = 200
MANTISSA = 10

#: Pairs at the threshold that banding may lose.
LOSS = 1e-6

#: Buckets of more members are compared after the others.
LARGE = 20_000

#: A similarity bound this far above the threshold is a link but for freak collisions ...
MARGIN = 0.03

#: ... in sets of up to so many shingles; larger ones have all their pairs verified.
SURE = 2048

#: Texts whose sets are in memory at once, and bytes of sets that are passed on together.
ROWS = 512
SET_BYTES = 16 << 20

#: Pairs in memory before they are passed on.
PAIRS = 100_000

#: What one comparison takes, in units of ``UNIT`` shingles: members outside the main component, and members.
BLOCK = (256, 2048)
UNIT = 1024

def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(size, len(words))))


@lru_cache(maxsize=4)
def _probes(k: int) -> np.ndarray:
    return np.random.default_rng(k).integers(0, k, (64 * k, k)).astype(np.int16 if k < 1 << 15 else np.int64)


def registers(shingles: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """Compressed registers of a set that is not empty."""
    least = np.full(k, np.iinfo(np.uint64).max)
    np.minimum.at(least, ((shingles >> np.uint64(32)) % np.uint64(k)).astype(np.int64), mix(shingles + np.uint64(0x632BE59BD9B4E019)))
    full = np.zeros(k, bool)
    full[np.unique((shingles >> np.uint64(32)) % np.uint64(k)).astype(np.int64)] = True
    filled, empty = least.copy(), np.flatnonzero(~full)
    for probe in _probes(k):
        if not len(empty):
            break
        donor = probe[empty]
        has = full[donor]
        filled[empty[has]] = least[donor[has]]
        empty = empty[~has]
    filled[empty] = least[full][0]
    filled = np.maximum(filled, np.uint64(1))
    zeros = 63 - np.floor(np.log2(filled.astype(np.float64))).astype(np.int64)
    zeros = np.clip(np.where(filled >> np.minimum(63 - zeros, 63).astype(np.uint64) == 0, zeros + 1, zeros), 0, 63)
    after = filled << (zeros.astype(np.uint64)) << np.uint64(1)
    return ((zeros.astype(np.uint16) << MANTISSA) | (after >> np.uint64(64 - MANTISSA)).astype(np.uint16)).astype("<u2")


def prints(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each shingle, sorted as the set is."""
    return (shingles >> np.uint64(48)).astype("<u2")


def similarity_bounds(one: np.ndarray, many: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the Jaccard similarity of one set and many, from their prints.

    Shared shingles have equal prints, so the number of prints of the other set
    that the first one holds is never below the number of shared shingles.
    """
    table = np.zeros(1 << 16, np.int32)
    table[one] = 1
    both = np.add.reduceat(table[many], starts)
    return both / (len(one) + sizes - np.minimum(both, len(one)))


@lru_cache(maxsize=10_000)
def _chance(n4: int, m4: int, k: int) -> float:
    """Share of registers that unrelated sets of 2^(n4/4) and 2^(m4/4) shingles have in common."""
    scale = 2.0 ** -(np.arange(64)[:, None] + 1)
    low = scale * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + scale / (1 << MANTISSA)
    cell = lambda q: np.exp(-max(1.0, 2 ** (q / 4) / k) * low) - np.exp(-max(1.0, 2 ** (q / 4) / k) * high)
    return float((cell(n4) * cell(m4)).sum())


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates for the rows of two register matrices."""
    k = a.shape[1]
    by_chance = np.array([_chance(round(4 * log2(x)), round(4 * log2(y)), k) for x, y in zip(np.maximum(n, 1), np.maximum(m, 1), strict=True)])
    return ((a == b).mean(1) - by_chance) / (1 - by_chance)


def plausible(estimate: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int, k: int = REGISTERS) -> np.ndarray:
    """Pairs that may reach the threshold: sizes allow it, and the estimate is not six deviations below."""
    t, small, large = percent / 100, np.minimum(n, m), np.maximum(n, m)
    deviation = np.sqrt(t * (1 - t) / (np.minimum(small, k) / 2.5))
    return (100 * small >= percent * large) & (estimate >= t - 6 * deviation)


def chosen(bound: np.ndarray, label: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which of the near members to verify first: the three best of a component that is sure, all others."""
    order = np.argsort(-bound, kind="stable")
    sure = np.unique(label[bound >= percent / 100 + MARGIN]) if size <= SURE else label[:0]
    rest = order[np.isin(label[order], sure)]
    take = [order[~np.isin(label[order], sure)]]
    for _ in range(3):
        first = np.unique(label[rest], return_index=True)[1]
        take.append(rest[first])
        rest = np.delete(rest, first)
    return np.concatenate(take)


def band_shape(percent: int, k: int = REGISTERS) -> tuple[int, int]:
    """(bands, rows): the most rows that lose at most ``LOSS`` of the pairs at the threshold."""
    t = percent / 100
    rows = max((r for r in range(1, k + 1) if (1 - t**r) ** (k // r) <= LOSS), default=1)
    return k // rows, rows


def _matrix(column: pa.Array, k: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, k)


def _sets(nodes: Iterable[pa.Scalar], texts: Iterable[pa.Scalar], size: int) -> Iterator[tuple[list, list[bytes]]]:
    """Nodes and their shingle sets, about ``SET_BYTES`` at a time."""
    own, made, held = [], [], 0
    for node, text in zip(nodes, texts, strict=True):
        own.append(node.as_py())
        made.append(shingle_set(text.as_py(), size).tobytes())
        held += len(made[-1])
        if held >= SET_BYTES or len(own) == ROWS:
            yield own, made
            own, made, held = [], [], 0
    if own:
        yield own, made


def signatures(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(k, n, set_key, regs, prints) of every row; no registers and prints where only an equal set can be a link."""
    kind = docs.schema[key].dataType.simpleString()
    least = ceil(percent / (100 - percent)) if percent < 100 else np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sets = [shingle_set(t.as_py(), size) for t in batch.column("t")]
                kept = lambda f: pa.array([f(s).tobytes() if len(s) >= least else None for s in sets], pa.binary())
                keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([len(s) for s in sets], pa.int64()), keys, kept(registers), kept(prints)], names=["k", "n", "set_key", "regs", "prints"])

    return docs.select(F.col(key).alias("k"), text_of(text).alias("t")).mapInArrow(run, f"k {kind}, n bigint, set_key binary, regs binary, prints binary")


class _Links:
    """What one run knows: nodes, tested pairs, links, components."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, fine: DataFrame, key: str, text: str, size: int, percent: int) -> None:
        self.docs, self.nodes, self.fine, self.key, self.text, self.size, self.percent = docs, nodes, fine, key, text, size, percent
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def stars(self, members: DataFrame) -> DataFrame:
        """(a, b): each member of a bucket and the smallest one."""
        leaders = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("b")).where("c > 1").drop("c"))
        return members.join(leaders, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct()

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose estimate leaves them a chance."""
        kind = self.nodes.schema["node"].dataType.simpleString()
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if x.num_rows:
                    n, m = x.column("n").to_numpy(), x.column("m").to_numpy()
                    near = plausible(estimated_jaccard(_matrix(x.column("r")), _matrix(x.column("q")), n, m), n, m, percent)
                    yield x.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

        of_a = self.nodes.select(F.col("node").alias("a"), "n", F.col("regs").alias("r"))
        of_b = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("regs").alias("q"))
        sized = pairs.join(of_a, "a").join(of_b, "b").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * self.percent)
        return sized.select("a", "b", "n", "m", "r", "q").mapInArrow(run, f"a {kind}, b {kind}")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold on their full shingle sets."""
        kind = self.nodes.schema["node"].dataType.simpleString()
        size, percent = self.size, self.percent
        node_type = to_arrow_type(self.nodes.schema["node"].dataType)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, made in _sets(batch.column("node"), batch.column("t"), size):
                    yield pa.RecordBatch.from_arrays([pa.array(own, node_type), pa.array(made, pa.binary())], names=["node", "s"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                found = []
                for s, q in zip(x.column("s"), x.column("q"), strict=True):
                    one, two = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    found.append(100 * both >= percent * (len(one) + len(two) - both))
                yield x.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

        asked = wanted(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
        texts = self.docs.select(F.col(self.key).alias("node"), text_of(self.text).alias("t")).join(asked, "node", "left_semi")
        sets = materialize(texts.mapInArrow(build, f"node {kind}, s binary"))
        joined = pairs.join(sets.withColumnRenamed("node", "a"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("q")), "b")
        return joined.select("a", "b", "s", "q").mapInArrow(compare, f"a {kind}, b {kind}").distinct()

    def test(self, pairs: DataFrame, estimate: bool = True) -> None:
        """Verify new pairs, by their estimate first, and bring the components up to date."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        likely = materialize(self.likely(pairs)) if estimate else pairs
        if likely.isEmpty():
            new = likely
        else:
            new = materialize(self.verified(likely))
        self.links = new if self.links is None else self.links.union(new)
        if self.labels is None or not new.isEmpty():
            self.labels = components(self.links)

    def labelled(self, members: DataFrame) -> DataFrame:
        return members.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def mixed(self, members: DataFrame) -> DataFrame:
        """(bucket, c, main, cu, ru): buckets of c members, three or more, with cu units, ru of them outside the largest component.

        In a bucket of two the only pair has been tested.
        """
        seen = self.labelled(members).groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"))
        largest = F.max(F.struct("n", "label", "u")).alias("top")
        summed = seen.groupBy("bucket").agg(F.sum("n").alias("c"), F.sum("u").alias("cu"), largest).where("c > 2 and top.n < c")
        return materialize(summed.select("bucket", "c", F.col("top.label").alias("main"), "cu", (F.col("cu") - F.col("top.u")).alias("ru")))

    def outside(self, members: DataFrame, buckets: DataFrame) -> DataFrame:
        """(bucket, node, cu, ru, label, outer): members of mixed buckets; those outside the main component are outer."""
        return self.labelled(members).join(buckets, "bucket").withColumn("outer", F.col("label") != F.col("main")).drop("main")

    def left_apart(self, members: DataFrame, pairs: DataFrame) -> DataFrame:
        """The same of the buckets with a document that is still apart from a component of which only the best members were verified."""
        of_a, of_b = (self.labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in ("a", "b"))
        named = pairs.where(F.col("more").isNotNull()).join(of_a, "a", "left").join(of_b, "b", "left")
        apart = named.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(F.col("more").alias("node"), F.lit(True).alias("outer")).distinct()
        apart = materialize(apart)
        buckets = materialize(members.join(apart, "node").groupBy("bucket").agg(F.sum("u").alias("ru")))
        sized = materialize(members.join(buckets, "bucket").groupBy("bucket", "ru").agg(F.count(F.lit(1)).alias("c"), F.sum("u").alias("cu")).where("c > 2"))
        return self.labelled(members).join(sized, "bucket").join(apart, "node", "left").withColumn("outer", F.coalesce("outer", F.lit(False)))

    def across(self, mine: DataFrame, best: bool) -> DataFrame:
        """(a, b, more) across components within buckets: pairs that have a chance.

        Blocks of outer members meet blocks of all members.  With ``best``, of the
        members of a component that is all but sure only three are taken; ``more``
        is the outer one where that left some out.
        """
        kind = self.nodes.schema["node"].dataType.simpleString()
        types = [to_arrow_type(self.nodes.schema["node"].dataType)] * 3
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups = batch.column(0)
                rows, ends = groups.flatten(), np.asarray(groups.offsets) - groups.offsets[0].as_py()
                node, label, outer = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "outer"))
                own_prints = [np.frombuffer(x, "<u2") for x in rows.field("prints").to_pylist()]
                found = []
                for low, high in zip(ends[:-1], ends[1:], strict=True):
                    own = np.arange(low, high)
                    inner = own[~outer[own]]
                    if not len(inner):
                        continue
                    sizes = np.array([len(own_prints[i]) for i in inner])
                    many, starts = np.concatenate([own_prints[i] for i in inner]), np.cumsum(sizes) - sizes
                    for u in own[outer[own]]:
                        bound = similarity_bounds(own_prints[u], many, starts, sizes)
                        bound[(label[inner] == label[u])] = 0
                        near = np.flatnonzero(100 * bound >= percent - 1e-9)
                        if len(near):
                            of = label[inner[near]]
                            take = chosen(bound[near], of, len(own_prints[u]), percent) if best else np.arange(len(near))
                            short = set(np.delete(of, take).tolist())
                            found += [(max(node[u], m), min(node[u], m), node[u] if x in short else None) for m, x in zip(node[inner[near[take]]], of[take].tolist(), strict=True)]
                    if len(found) > PAIRS:
                        yield pairs_batch(found)
                        found = []
                if found:
                    yield pairs_batch(found)

        def pairs_batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), types, strict=True)], names=["a", "b", "more"])

        block = lambda column, count, size: F.pmod(F.xxhash64(column, F.lit(size)), F.ceil(count / size)).cast("int")
        every = lambda count, size: F.explode(F.sequence(F.lit(0), (F.ceil(count / size) - 1).cast("int")))
        mine = materialize(mine)
        fine = materialize(self.fine.join(wanted(mine, "node"), "node", "left_semi"))
        rows = mine.join(fine, "node").where(F.col("prints").isNotNull())
        row = F.struct("node", "label", "prints", "outer")
        outer = rows.where("outer").select("bucket", block("node", F.col("ru"), BLOCK[0]).alias("i"), every(F.col("cu"), BLOCK[1]).alias("j"), "node", "label", "prints", F.lit(True).alias("outer"))
        inner = rows.select("bucket", every(F.col("ru"), BLOCK[0]).alias("i"), block("node", F.col("cu"), BLOCK[1]).alias("j"), "node", "label", "prints", F.lit(False).alias("outer"))
        groups = outer.union(inner).groupBy("bucket", "i", "j").agg(F.collect_list(row).alias("group")).select("group")
        return groups.mapInArrow(run, f"a {kind}, b {kind}, more {kind}").distinct()

    def settle(self, members: DataFrame, mixed: DataFrame) -> None:
        """Find the links across components within the mixed buckets."""
        if mixed.isEmpty():
            return
        pairs = materialize(self.across(self.outside(members, mixed), best=True))
        self.test(pairs.select("a", "b").distinct(), estimate=False)
        if not pairs.where(F.col("more").isNotNull()).isEmpty():
            rest = self.across(self.left_apart(members, pairs), best=False)
            self.test(rest.select("a", "b").distinct(), estimate=False)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; links have at least ``percent`` % of their union in common."""
    signed = materialize(signatures(docs, key, text, shingle_words, percent))
    known = signed.where(F.col("k").isNotNull() & (F.col("n") > 0))
    sets = materialize(known.groupBy("set_key").agg(F.min("k").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    nodes = sets.where(F.col("regs").isNotNull()).select("node", "n", "regs")

    bands, rows = band_shape(percent)
    step = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * step + 1, F.lit(step))))
    units = F.ceil(F.col("n") / UNIT).cast("int").alias("u")
    banded = nodes.select("node", units, F.posexplode(keys).alias("band", "bucket"))

    links = _Links(docs, nodes, signed.select(F.col("k").alias("node"), "prints"), key, text, shingle_words, percent)
    links.test(links.stars(banded))
    mixed = links.mixed(banded)
    links.settle(banded, mixed.where(F.col("c") <= LARGE))
    large = mixed.where(F.col("c") > LARGE).select("bucket")
    if not large.isEmpty():
        hot = materialize(banded.join(large, "bucket"))
        links.settle(hot, links.mixed(hot))

    component = sets.select("set_key", "node").join(links.labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("c"))
    component = materialize(component)
    found = signed.select("k", "n", "set_key").join(component, "set_key", "left")
    mine = F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("k"))
    return found.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("k").isNotNull(), mine).alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


#: DuckDB: the contract's links and components, by brute force.
NEAR_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), placed AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM placed
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.doc_id
), component AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN component USING (doc_id)
"""
