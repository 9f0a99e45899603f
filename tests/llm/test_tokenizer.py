import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import tokenizer as K

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def enc():
    return K.encoder(K.vocabulary_path(), K.split_pattern())


@pytest.fixture(scope="module")
def other():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equal_to_the_public_encoder(enc, other, text):
    text = text.encode("utf-8", "replace").decode()
    ids = enc.encode(text)
    assert list(ids) == other.encode_ordinary(text)
    assert enc.decode_bytes(ids).decode() == text
    assert enc.count(text) == len(ids) and int(enc.token_lengths(ids).sum()) == len(text.encode())


def test_long_and_odd_pieces(enc, other):
    rng = random.Random(1)
    for text in ("a" * 3000, "ab" * 2000, "é" * 900, "x" * 50 + " " * 400, "<|endoftext|>", "\x00\x01", "".join(rng.choice("abc the-THE 0123é中\n\t") for _ in range(5000))):
        assert list(enc.encode(text)) == other.encode_ordinary(text)


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "hello  world", 0), (4, "hello  world", 0)], "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in K.encode(df).collect()]
    assert got[0] == (1, []) and got[1] == (2, []) and len(got[2][1]) > 0 and got[3] == got[4]
    assert [r.n_tokens for r in K.encode(df, ids=False).collect()] == [len(i) for _, i in got]
    assert [r.text for r in K.decode(K.encode(df)).collect()] == ["", "", " \n", "hello  world", "hello  world"]
    assert K.encode(df.where("false")).count() == 0
