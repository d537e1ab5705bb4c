"""Token counts of whole texts for a sentencepiece BPE model with byte fallback.

The text's tokens are never materialised.  A text is cut into pre-tokens where
no vocabulary piece can cross: before a run of spaces, and before a line feed.
(``check_model`` proves it for the vocabulary at hand: no piece has a space mark
after another character, and none holds a line feed.)  Merges on both sides of
such a cut never touch each other, so the count of a text is the sum of its
pre-tokens' counts.

Within each Arrow batch the pre-tokens of all documents are reduced to the
distinct ones, each distinct one is counted once, and the counts are joined to
the per-document frequencies by code and summed.  The join is local to the
task: a global one would move a row for every (document, pre-token), several
times the size of the input, to save a few microseconds each.  Counts of pieces
seen before are remembered per worker, up to ``MEMO`` entries.

Defined results: null and empty texts have 0 bytes and 0 tokens; very long texts
are counted whole; each repeated row has its own result; an empty table stays
empty; only the key and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's memory of counts; it is emptied when full.
MEMO = 400_000
MARK = "▁"
_PRE = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")

_MODELS: dict[str, object] = {}
_SEEN: dict[str, dict[str, int]] = {}


def model(path: str):
    import sentencepiece

    if path not in _MODELS:
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(processor)
        _MODELS[path] = processor
    return _MODELS[path]


def check_model(processor) -> None:
    """Raise unless the cuts of ``pre_tokens`` are safe for this model."""
    pieces = [processor.id_to_piece(i) for i in range(processor.vocab_size())]
    if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a vocabulary piece crosses a pre-token boundary")
    if len(processor.encode("a")) != 1 or len(processor.encode("  a")) < 2 or len(processor.encode("\n")) != 2:
        raise ValueError("the model must add a leading space, keep spaces and fall back to bytes")


def pre_tokens(text: str) -> list[str]:
    """Pieces that tokenise independently; the model's leading space is included."""
    return _PRE.findall(MARK + text.replace(" ", MARK)) if text else []


def count_piece(processor, piece: str) -> int:
    if piece == MARK:
        return 1
    if piece[0] == "\n":
        return len(processor.encode(piece)) - 1  # without the leading space that the model adds
    return len(processor.encode(piece[1:]))


def count_batch(processor, seen: dict[str, int], texts: list[str]) -> np.ndarray:
    """Tokens of each text: distinct pre-tokens, their counts, sums by document."""
    split = [pre_tokens(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    index: dict[str, int] = {}
    codes = np.fromiter((index.setdefault(p, len(index)) for pieces in split for p in pieces), np.int64, int(sizes.sum()))
    counts = np.empty(len(index), np.int64)
    for piece, i in index.items():
        n = seen.get(piece)
        if n is None:
            n = count_piece(processor, piece)
            if len(piece) <= 64:
                if len(seen) >= MEMO:
                    seen.clear()
                seen[piece] = n
        counts[i] = n
    # frequencies of (document, pre-token), joined to the counts by code and summed by document
    own = np.sort(np.repeat(np.arange(len(split)), sizes) * max(1, len(index)) + codes)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    times = np.diff(first, append=len(own))
    document, code = np.divmod(own[first], max(1, len(index)))
    return np.bincount(document, counts[code] * times, len(split)).astype(np.int64)


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", rows: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens) for every row; ``rows`` texts share one local join."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        processor, seen = model(model_path), _SEEN.setdefault(model_path, {})
        for batch in batches:
            texts = batch.pop("t").tolist()
            batch["n_tokens"] = np.concatenate([np.zeros(0, np.int64), *(count_batch(processor, seen, texts[i : i + rows]) for i in range(0, len(texts), rows))])
            yield batch

    source = docs.select(F.col(key).alias("k"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    made = source.mapInPandas(run, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return made.select(F.col("k").alias(key), "n_bytes", "n_tokens")
