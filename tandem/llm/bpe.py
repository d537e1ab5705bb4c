"""Byte-level BPE encoding and decoding with a local rank file.

Each text is encoded by the tiktoken library, whole, in one pass over the
input: no shuffle, and a megabyte of text in memory as ids at a time.  Long texts are cut
first, but only where the pre-tokenizer's pattern would cut anyway:

* between a non-space character and white space.  No alternative of the
  pattern matches a non-space character followed by white space, and none looks
  back, so both halves tokenise as they do in the whole;
* around the body of a white-space run of ``LONG_RUN`` characters or more.  All
  of it but its last character (all of it at the end of the text) is one
  pre-token, which goes to the merge loop directly, because the regex engine
  overflows its stack on such runs.

Defined results: a null or empty text has no tokens and decodes to no bytes;
repeated rows each get their own result; extra columns do not matter, since
only the key and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece that is handed to the library at once, at least.
PIECE_CHARS = 65_536
LONG_RUN = 8_192

#: Texts, and their bytes, that are encoded before the result is handed on.
ROWS = 512
PART_CHARS = 1 << 20

#: The white space of the library's regex engine (Unicode White_Space).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")

_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(rank_path: str, pattern: str):
    """The library's encoding for a rank file, once per worker process."""
    import tiktoken

    key = (rank_path, pattern)
    if key not in _ENCODERS:
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def safe_pieces(text: str) -> Iterator[tuple[bool, str]]:
    """Cut a text at safe boundaries into (is one pre-token, piece)."""
    at = 0
    for run in _LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((False, x) for x in _short(text, at, run.start()))
        yield True, text[run.start() : stop]
        at = stop
    yield from ((False, x) for x in _short(text, at, len(text)))


def _short(text: str, at: int, end: int) -> Iterator[str]:
    while end - at > PIECE_CHARS:
        cut = _SAFE.search(text, at + PIECE_CHARS, end)
        if not cut or cut.start() >= end:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < end:
        yield text[at:end]


def encode(enc, text: str) -> list[int]:
    if len(text) <= LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for one, piece in safe_pieces(text):
        ids += enc._core_bpe.encode_single_piece(piece.encode("utf-8")) if one else enc.encode_ordinary(piece)
    return ids


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids, decoded, round_trip) for every row.

    ``ids`` are the token ids, ``decoded`` the bytes they stand for, and
    ``round_trip`` tells whether those are the text's UTF-8 bytes.  Without
    ``with_ids`` the digests ``ids_sha256`` and ``decoded_sha256`` replace the
    two, so that ids never leave the worker.
    """
    kind = docs.schema[key].dataType
    out = "ids array<int>, decoded binary" if with_ids else "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_path, pattern)
        names: dict[int, str] = {}
        for batch in batches:
            for part in _parts(batch):
                texts = part.column("t").to_pylist()
                ids = [encode(enc, t) for t in texts]
                decoded = [enc.decode_bytes(i) for i in ids]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                same = [d == t.encode("utf-8") for d, t in zip(decoded, texts, strict=True)]
                if with_ids:
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)), pa.array(decoded, pa.binary())
                else:
                    for i in set(chain.from_iterable(ids)).difference(names):
                        names[i] = str(i)
                    joined = [",".join(map(names.__getitem__, i)) for i in ids]
                    made = pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(sizes), pa.array(same), *made], names=["k", "n_tokens", "round_trip", "a", "b"])

    a, b = (x.split() for x in out.split(", "))
    made = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"k {kind.simpleString()}, n_tokens bigint, round_trip boolean, a {a[1]}, b {b[1]}")
    return made.select(F.col("k").alias(key), "n_tokens", F.col("a").alias(a[0]), F.col("b").alias(b[0]), "round_trip")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``ROWS`` texts and about ``PART_CHARS`` bytes: what is in memory as ids at once."""
    sizes = pc.binary_length(batch.column("t")).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and (i - at >= ROWS or held + size > PART_CHARS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if len(sizes) > at:
        yield batch.slice(at)
