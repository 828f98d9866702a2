"""Encoding against the library's own pattern on whole texts; decoding as an exact round trip."""

import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trawlnet.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    return tiktoken.Encoding("w", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_encoding(RANKS)._mergeable_ranks, special_tokens={})


def same(whole, text):
    got = bpe.ids_of(bpe.encode_bytes(bpe.encoding_for(RANKS), text))
    assert got == whole.encode_ordinary(text)
    assert whole.decode_bytes(got) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1Zé .,'s!\n\t\r\x0b\x1c\x1f\x85\xa0 　_٣中<|>"), max_size=60))
def test_cuts_change_no_ids(text):
    w = tiktoken.Encoding("w2", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoding_for(RANKS)._mergeable_ranks, special_tokens={})
    same(w, text)


@pytest.mark.parametrize("text", ["", " ", "   ", "\n\n", "a  b", " a", "a ", "don't 'll", "<|endoftext|>", "x\n\n\n y"])
def test_edges(whole, text):
    same(whole, text)


def test_long_text_is_cut_at_safe_boundaries(whole):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["word", " ", "é1", ",", "\n", "  ", "don't"]) for _ in range(120_000))
    assert len(bpe.safe_parts(text)) > 4 and "".join(bpe.safe_parts(text)) == text
    same(whole, text)


def test_rows(spark):
    rows = [(1, "hello  world", "x"), (1, "hello  world", "x"), (2, None, "y"), (3, "", None), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.bpe_round_trip(df, RANKS).collect()
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in out] == [(a, b or "") for a, b, _ in rows]
    assert bpe.bpe_digest(df.limit(0), RANKS).count() == 0
    again = bpe.bpe_decode(bpe.bpe_encode(df, RANKS), RANKS).collect()
    assert [bytes(r.decoded) for r in again] == [bytes(r.decoded) for r in out]
