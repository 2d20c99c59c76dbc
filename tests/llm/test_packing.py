import collections
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chainlake.llm import packing

from .util import ODD, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*REAL.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def verify(rows, docs, window, shards=1):
    """Every id of every document once, gapless sequences, little padding."""
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
        x = docs[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
    assert set(by) == set(docs)
    for k, ps in by.items():
        assert sorted((p["start"], p["length"]) for p in ps)[0][0] == 0
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(docs[k])
    short = 0
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        short += at < window
    assert short <= shards


def test_odd_texts(spark):
    rows = packing.pack(documents(spark, ODD), PATH).collect()
    verify(rows, {i: ids_of(t) for i, t in enumerate(ODD)}, 2048)


def test_shards_split_what_is_frequent(spark):
    texts = [f"zebra zebra zebra number {i}" for i in range(300)] + [f"apple {i} pie" for i in range(50)]
    rows = packing.pack(documents(spark, texts), PATH, window=32, shard=400).collect()
    docs = {i: ids_of(t) for i, t in enumerate(texts)}
    shards = {r["sequence_id"] >> 24 for r in rows}
    assert len(shards) > 4
    verify(rows, docs, 32, len(shards))
    assert packing.pack(documents(spark, texts).where("false"), PATH).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = packing.pack(documents(spark, ["same text"] * 3 + ["none"], [1, 1, 1, None]), PATH).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 3 * len(ids_of("same text"))
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == len(ids_of("none"))
    assert packing.pack(documents(spark, ["same text"] * 3), PATH).select("sequence_id").distinct().count() == 1


def test_neighbours_are_bm25s_best():
    docs = [np.array(x) for x in ([5, 6, 7, 1], [5, 6, 7, 8, 1], [9, 10, 1], [7, 11, 1], [5, 6, 1])]
    idf = np.ones(20)
    index = packing.Shard(docs, idf, 4.0)  # all of a seed's ids are looked up
    used = np.zeros(5, bool)
    used[0] = True

    def score(i):
        out = 0.0
        for t in set(docs[0]):
            tf = (docs[i] == t).sum()
            out += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[i]) / 4.0)) if tf else 0
        return out

    want = sorted((i for i in range(1, 5) if score(i)), key=lambda i: (-score(i), i))
    assert list(index.neighbours(0, used)) == want
    pieces = list(packing.fill(index, 9))
    assert [p[0] for p in pieces][:2] == [0, want[0]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=5))
def test_any_text_is_encoded_as_the_library_does(texts):
    memo = packing.PieceIds(PATH)
    for t in texts:
        got = np.frombuffer(b"".join(memo[p] for p in packing.pieces(t)), "<u2")
        assert got.tolist() == ids_of(t)[:-1].tolist()
    together = [np.frombuffer(x, "<u2").tolist() for x in packing.encoder(PATH).texts(texts)]
    assert together == [ids_of(t)[:-1].tolist() for t in texts]


CONTRACTIONS = st.text(st.sampled_from("'streavlmdD12 \n\xa0\x85\x1cé.!ßÉ<|"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(CONTRACTIONS, min_size=1, max_size=6))
def test_pieces_are_cut_as_the_library_does(texts):
    assert [np.frombuffer(x, "<u2").tolist() for x in packing.encoder(PATH).texts(texts)] == [ids_of(t)[:-1].tolist() for t in texts]


def test_the_encoders_table_starts_anew(monkeypatch):
    e = packing.Encoder(PATH)
    monkeypatch.setattr(e, "AT_ONCE", 400)
    monkeypatch.setattr(e, "MOST", 300)
    texts = [f"word{k % 7} {'x' * (k % 60)} more{k}" for k in range(200)] + ["y" * 1000]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.texts(texts)] == [ids_of(t)[:-1].tolist() for t in texts]


def test_copies_are_spread_over_shards(spark):
    """Repeated rows without an id: equal in everything, and still no shard takes more than its share."""
    rows = packing.pack(documents(spark, ["the same text again"] * 400, [None] * 400), PATH, window=64, shard=200).collect()
    n = len(ids_of("the same text again"))
    held = collections.Counter()
    for r in rows:
        held[r["sequence_id"] >> 24] += r["length"]
    assert sum(held.values()) == 400 * n and max(held.values()) < 200 + n and sum(r["start"] == 0 for r in rows) == 400


def test_neighbours_by_brute_force_over_a_table(spark):
    """In one shard every window's documents are the seed's best unused ones, by a plain BM25 over all pairs."""
    import math

    docs = {r["doc_id"]: ids_of(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(table, PATH, window=2048, shard=1 << 40).collect()
    verify(rows, docs, 2048)
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    tf = {k: collections.Counter(x.tolist()) for k, x in docs.items()}
    seen = collections.Counter(t for c in tf.values() for t in c)
    idf = {t: math.log1p((n - m + 0.5) / (m + 0.5)) for t, m in seen.items()}
    weight = {k: {t: idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[k]) / mean)) for t, f in c.items()} for k, c in tf.items()}
    pieces = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    used, seed, last = set(), None, None
    for r in pieces:
        if r["offset"] == 0:
            seed = r["doc_id"]
        if r["start"] == 0 and r["doc_id"] not in used:
            if r["offset"] and last == (r["sequence_id"], True):
                score = lambda k: sum(w for t, w in weight[k].items() if t in tf[seed])  # noqa: B023, E731
                best = max(score(k) for k in docs if k not in used)
                assert score(r["doc_id"]) >= best - 1e-6
            used.add(r["doc_id"])
        done = r["start"] + r["length"] == r["doc_tokens"]
        last = (r["sequence_id"], done)
