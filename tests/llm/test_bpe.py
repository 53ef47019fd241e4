"""Byte-level BPE against the tiktoken library; exact round trips."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SF, docs_of, frame, prose, rows_of
from tillroll.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


EDGE = ["", "a", "  \n\n  x  ", "<|endoftext|> is text", "naïve Ünïcödé ñandú 東京 \U0001f600", "don't we'll I'm", "1234567 3.14",
        "a\u00a0b\u2003c", "\x00\x01", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 4, " " * 200, "x" * 700 + "=" * 900, "\t\t\tif x:\r\n", "ſß"]


def check(codec, library, texts):
    for text, (ids, back) in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or ""), text
        assert back == (text or "").encode()


def test_edges_equal_the_library(codec, library):
    check(codec, library, [None, *EDGE])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4))
def test_any_text(codec, library, texts):
    check(codec, library, texts)


def test_very_long_pieces(codec, library):
    check(codec, library, ["ab" * 1500, "the" * 900 + "!" * 2500])


def test_bounded_cache(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    check(codec, library, [prose(1, 60), prose(2, 60)])


def test_documents(spark, library):
    texts = {r.doc_id: r.text for r in docs_of(spark).collect()}
    for doc_id, row in rows_of(bpe.op3_byte_bpe(spark, SF)).items():
        ids = np.array(library.encode_ordinary(texts[doc_id]), "<u4")
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[doc_id].encode()).hexdigest()


def test_frames(spark):
    assert bpe.bpe_digest(frame(spark, [])).count() == 0
    got = rows_of(bpe.bpe_round_trip(frame(spark, ["same text", None, "same text"], ids="mine", source="s")))
    assert got[0].ids == got[2].ids and got[1].n_tokens == 0 and bytes(got[0].decoded) == b"same text"
    out = rows_of(bpe.stage(spark, frame(spark, ["same text", None], source="s"), SF))
    assert out[0].round_trip and out[1].round_trip and out[1].ids == []
