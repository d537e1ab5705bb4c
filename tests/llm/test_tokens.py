import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

ODD = ["", " ", "\n", "  a  b\n c", "a▁b ▁ ▁▁c", "x" * 9000, "été 漢字 \U0001f600!! \x00 \r\n\t q", "<s>a</s><unk><|endoftext|>", "tail   ", "\n\n  \n x"]


def encoder():
    return bpe.encoder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1\n\t'.s 　é漢", max_size=200))
def test_cut_texts_encode_alike(text):
    enc = encoder()
    long = (text + " word") * (bpe.PIECE_CHARS // (len(text) + 5) + 2)
    assert bpe.encode(enc, long) == enc.encode_ordinary(long)
    assert "".join(p for _, p in bpe.safe_pieces(long)) == long


def test_long_white_space_runs():
    enc = encoder()
    for tail in ("", "x", " \n\n", "\n1"):
        text = "a" + " \n" * bpe.LONG_RUN + tail + " b" * 10
        assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    huge = "a" + " " * 2_000_000 + "b"
    assert enc.decode_bytes(bpe.encode(enc, huge)) == huge.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c\n\t▁'.é漢\r\x00", max_size=120))
def test_counts_equal_the_library(text):
    sp = token_counts.model(MODEL)
    assert token_counts.count_batch(sp, {}, [text]).tolist() == [len(sp.encode(text))]


def test_operators_on_odd_rows(spark):
    rows = [(i, t, "k") for i, t in enumerate(ODD)] + [(None, None, None), (1, " ", "k"), (1, " ", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    enc, sp = encoder(), token_counts.model(MODEL)
    got = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ODD[r.doc_id] if r.doc_id is not None else ""
        assert r.ids == enc.encode_ordinary(want) and bytes(r.decoded) == want.encode() and r.round_trip and r.n_tokens == len(r.ids)
    digests = {r.doc_id: r for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=False).collect()}
    for i, t in enumerate(ODD):
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    counted = token_counts.token_counts(docs, MODEL).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in counted), key=str) == sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _ in rows), key=str)
    for made in (bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN), token_counts.token_counts(docs.limit(0), MODEL)):
        assert made.count() == 0


def test_unsafe_model_is_refused():
    class Crossing:
        vocab_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")

    with pytest.raises(ValueError):
        token_counts.check_model(Crossing())
