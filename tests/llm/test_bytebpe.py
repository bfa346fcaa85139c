import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from decant.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.codec(PATH, public_tokenizers.PATTERN)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t's1.aé日\x1c\x85　")), max_size=60))
def test_same_ids_as_the_library(plain, own, text):
    assert ids(own, text) == plain.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_every_token_and_long_parts(plain, own):
    assert own.tokens == [plain.decode_single_token_bytes(i) for i in range(plain.n_vocab)]
    for text in ("ab" * 5000, " " * 3000 + "x", "\n" * 999, "日本語" * 700, "<|endoftext|> it's", "a" * 4097):
        assert ids(own, text) == plain.encode_ordinary(text)


def test_every_character(plain, own):
    for at in range(0, 0x110000, 64):
        text = " ".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert ids(own, text) == plain.encode_ordinary(text), hex(at)


def test_other_vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    text = "Größe, façade, señor, 日本語, привет 123 it's\n\n  x"
    assert ids(bytebpe.codec(path, public_tokenizers.PATTERN), text) == other.encode_ordinary(text)


def test_a_vocabulary_with_gaps_is_refused():
    with pytest.raises(ValueError):
        bytebpe.model_bytes({b"a": 0, b"b": 2})


def test_documents(make, prose, plain):
    rows = [(i, prose(i, 1 + i * 37 % 400)) for i in range(40)] + [(100, None), (101, ""), (102, prose(9, 9000)), (5, prose(5, 186)), (None, "a b"), (None, None), (103, "naïve 日本 \U0001f600 ͸")]
    docs = make(rows)
    expected = []
    for key, text in rows:
        own = plain.encode_ordinary(text or "")
        raw = np.array(own, dtype="<u4").tobytes()
        expected.append((key, len(own), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    def order(r):
        return str(r)

    assert sorted(map(tuple, bytebpe.digest(docs).collect()), key=order) == sorted(expected, key=order)
    encoded = bytebpe.encode(docs)
    back = bytebpe.decode(encoded).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(k), (t or "").encode()) for k, t in rows)
    assert bytebpe.digest(make([])).collect() == []


def test_bytes_that_are_no_text(spark):
    d = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text")
    assert bytebpe.decode(bytebpe.encode(d)).collect()[0].decoded == "a�b".encode()
