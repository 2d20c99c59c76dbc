"""The registered queries over a whole small table, each against plain Python."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chainlake.llm import queries

from .test_packing import verify
from .test_secrets import brute as brute_base
from .test_simhash import brute_fp, brute_groups
from .util import quality_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op1_tiff_media")}
    features = collections.defaultdict(set)
    assert set(got) == set(texts)
    for k, t in texts.items():
        raw = t.encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert len(r["media_sha256"]) == 64 and r["media_bytes"] > 0 and r["feature"]
        features[t].add((r["media_sha256"], r["feature"]))
    assert all(len(f) == 1 for f in features.values())


def test_op2_and_op3(spark, texts):
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    real.no_truncation()
    real.no_padding()
    counts = {r["doc_id"]: r for r in rows_of(spark, "op2_token_counts")}
    coded = {r["doc_id"]: r for r in rows_of(spark, "op3_bpe_codec")}
    for k, t in texts.items():
        ids = real.encode(t, add_special_tokens=False).ids
        assert (counts[k]["n_bytes"], counts[k]["n_tokens"], counts[k]["over_limit"]) == (len(t.encode()), len(ids), len(ids) > 512)
        back = real.decode(ids, skip_special_tokens=False)
        assert coded[k]["n_tokens"] == len(ids) and coded[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert coded[k]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_op6(spark, texts):
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {k: np.array([*real.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    rows = rows_of(spark, "op6_packing")
    verify(rows, docs, 2048, len({r["sequence_id"] >> 24 for r in rows}))


def test_op7(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op7_simhash")}
    ids = sorted(texts)
    fps = [brute_fp(texts[k]) for k in ids]
    assert [int(got[k]["fingerprint"], 16) for k in ids] == fps
    assert [got[k]["component_id"] for k in ids] == [ids[j] for j in brute_groups(fps, 2)]


def test_op8(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op8_secret_scan")}
    for k, t in texts.items():
        spans = brute_base(t)
        joined = ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[k][f"n_{kind}"] for kind in ("assign", "access", "hex")] == [sum(s[0] == kind for s in spans) for kind in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(got[k]["spans"].split(","))


def test_op9(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op9_quality")}
    for k, t in texts.items():
        r, (words, chars, symbols, lines, repeated) = got[k], quality_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, lines, repeated)
        assert r["base_failed"] == (words < 50 or 100 * repeated > 50 * words) and not (r["kept"] and r["base_failed"])
    assert 0 < sum(r["kept"] for r in got.values()) < len(got)
