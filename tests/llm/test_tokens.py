import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chainlake.llm import bpe_codec, token_count
from chainlake.llm.bpe import vocabulary

from .util import LONG, ODD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)


def real(text):
    return REAL.encode(text or "", add_special_tokens=False).ids


def test_counts(spark):
    got = {r["doc_id"]: r for r in token_count.token_counts(documents(spark, ODD), PATH, limit=10).collect()}
    for i, t in enumerate(ODD):
        want = len(real(t))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((t or "").encode()), want > 10)


def test_codec_digests(spark):
    got = {r["doc_id"]: r for r in bpe_codec.codec_digests(documents(spark, ODD), PATH).collect()}
    for i, t in enumerate(ODD):
        ids = real(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(REAL.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(spark):
    texts = [t or "" for t in ODD]
    coded = bpe_codec.encode_documents(documents(spark, ODD), PATH)
    assert {r["doc_id"]: list(r["ids"]) for r in coded.collect()} == {i: real(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in bpe_codec.decode_documents(coded, PATH).collect()} == dict(enumerate(texts))


def test_nulls_repeats_and_empty_tables(spark):
    df = documents(spark, ["a b", "a b", None], [1, 1, None])
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in token_count.token_counts(df, PATH).collect()) == [(False, 2), (False, 2), (True, 0)]
    assert token_count.token_counts(df.where("false"), PATH).count() == 0
    assert bpe_codec.codec_digests(df.where("false"), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_any_text(text):
    v = vocabulary(PATH)
    want = real(text)
    assert token_count.TokenCounter(v).of(text) == len(want)
    assert list(bpe_codec.encode_texts([text], bpe_codec.PieceIds(v))) == [want]
    assert bpe_codec.decode(want, v) == text


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr("chainlake.llm.bpe.REMEMBERED", 50)
    known = bpe_codec.PieceIds(vocabulary(PATH))
    for k in range(5):
        part = LONG[k * 5000 : k * 5000 + 5000]
        assert list(bpe_codec.encode_texts([part], known)) == [real(part)]
        assert len(known) + len(known.old) <= 101


@pytest.mark.parametrize("piece", ["aaaa" * 50, "ababab", "thethethe"])
def test_overlapping_pairs(piece):
    v = vocabulary(PATH)
    got = bpe_codec.PieceIds(v)[piece]
    assert list(got) == real(piece)
