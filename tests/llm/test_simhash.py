import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlake.llm import simhash

from .util import ODD, WORD, documents, lower


def brute_fp(text, words=3):
    w = WORD.findall(lower(text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, radius):
    """By position the smallest position reachable."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_groups_of_odd_texts(spark):
    texts = [*ODD, *(f"one two three four five six seven eight nine ten {k}" for k in "abc")]
    got = {r["doc_id"]: r for r in simhash.groups(documents(spark, texts)).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [int.from_bytes(got[i]["fp"], "big") for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_groups(fps, 2)


def pairs_of(fps, sizes, radius):
    a, b = simhash.near(fps, sizes, radius)
    return set(zip(a.tolist(), b.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 3), st.integers(0, 2**32), st.sampled_from([0, 1, 2, 7, 40, 63]))
def test_bit_sliced_distances(n_words, n_buckets, seed, radius):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(1, 150, n_buckets + 1)]
    base = rng.integers(0, 2**63, (1, n_words), np.uint64)
    flips = np.zeros((sum(sizes), n_words), np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, flips.shape).astype(np.uint64)
    fps = base ^ flips
    want, at = set(), 0
    for n in sizes:
        for i in range(at, at + n):
            d = np.bitwise_count(fps[at : at + n] ^ fps[i]).sum(axis=1)
            want |= {(i, at + int(j)) for j in np.flatnonzero(d <= radius)}
        at += n
    assert pairs_of(fps, sizes, radius) == want


def near_fingerprints(spark, n, seed, spread):
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2**63))
    values = sorted({base ^ sum(1 << int(b) for b in set(rng.integers(0, spread, rng.integers(0, 4)))) for _ in range(n)} | {int(x) for x in rng.integers(0, 2**63, n)})
    df = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    return values, simhash.materialise(df, "test")


@pytest.mark.parametrize("radius,cap", [(1, 1024), (2, 1024), (2, 16), (3, 64)])
def test_links_lose_nothing(spark, monkeypatch, radius, cap):
    """Also where buckets are too large and are dealt again, several times over."""
    monkeypatch.setattr(simhash, "BUCKET", cap)
    values, df = near_fingerprints(spark, 150, radius * 10 + cap, 40)
    roots = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in simhash.components(simhash.links(df, 64, radius)).collect()}
    want = brute_groups(values, radius)
    assert [roots.get(v, v) for v in values] == [values[k] for k in want]


def test_long_chains_become_one_component(spark):
    edges = spark.range(1, 200).selectExpr("cast(lpad(cast(id as string), 4, '0') as binary) as a", "cast(lpad(cast(id - 1 as string), 4, '0') as binary) as b")
    got = simhash.components(edges).collect()
    assert len(got) == 199 and {bytes(r["root"]) for r in got} == {b"0000"}


def test_nulls_ties_and_empty(spark):
    df = documents(spark, ["a b c"] * 4 + [None, None], [7, 7, 3, None, None, None])
    got = simhash.groups(df).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got if r["component_id"]) == [(False, 3)] * 3 + [(True, 3)]
    assert sum(r["component_id"] is None for r in got) == 2
    assert simhash.groups(df.where("false")).count() == 0


def test_one_of_each(spark):
    base = [f"w{k % 89}x{k * 7 % 61} " for k in range(400)]
    changed = base[:]
    changed[200] = "changed "
    texts = ["".join(base), "".join(changed), "".join(base).upper(), "something else altogether " * 3, " ".join(f"v{k}" for k in range(300))]
    df = documents(spark, [*texts, texts[4], None, None], [5, 2, 9, 4, 6, 6, None, None])
    assert sorted((r["doc_id"] for r in simhash.one_of_each(df).collect()), key=str) == [2, 4, 6, None]
    assert simhash.one_of_each(df).columns == df.columns
    assert simhash.one_of_each(df.where("false")).count() == 0


def family(n, shared, own, seed=0):
    """n texts that share a passage and have words of their own."""
    passage = " ".join(f"s{k}" for k in range(shared))
    return [f"{passage} " + " ".join(f"d{seed}x{i}y{k}" for k in range(own)) for i in range(n)]


def test_only_pairs_at_the_similarity_are_near_duplicates(spark):
    """Documents that share a long passage (0.70) all stay; near copies at 0.8 and more go, however the corpus is cut."""
    texts = family(60, 200, 42) + [" ".join(f"c{k}" if k != 5 * i % 390 else f"e{i}" for k in range(400)) for i in range(40)]
    got = sorted(r["doc_id"] for r in simhash.one_of_each(documents(spark, texts)).collect())
    assert got == list(range(61))


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLED_BUCKET", 8)
    texts = [" ".join(f"c{k}" if k != 5 * i % 390 else f"e{i}" for k in range(400)) for i in range(40)]
    assert [r["doc_id"] for r in simhash.one_of_each(documents(spark, texts)).collect()] == [0]


def test_every_two_labels_of_a_key_meet_once(spark, monkeypatch):
    """Also where a key is cut into parts, by rows or by bytes; and a pair that shares several masks is looked at in one."""
    monkeypatch.setattr(simhash, "SAMPLED_BUCKET", 8)
    masks = simhash.Masks(256, 40, 50)
    label = lambda k: k % 3 if k > 20 else 9
    want = {(a, b) for a in range(50) for b in range(a + 1, 50) if label(a) != label(b)}
    for size in (0, 9 << 20):
        rows = spark.createDataFrame([(bytearray([k] * 40), label(k), size) for k in range(50)], "fp binary, label long, size long")
        sets = simhash.blocks(simhash.keyed(rows, masks, masks.first(), simhash.NODE)).collect()
        on = np.array([masks.mask(p) for p in masks.first()])
        met = []
        for r in sets:
            fps = pa.array(r["fps"], pa.binary())
            w = simhash.words_of(fps, 256)
            n = len(fps)
            pairs = simhash.apart(w, np.array(r["labels"]), np.array(r["parts"]), np.full(n, r["same"]), np.full(n, int(r["path"])), on, simhash.near_steps(w, [n], 256))
            met += [tuple(sorted((bytes(r["fps"][x])[0], bytes(r["fps"][y])[0]))) for i, j in pairs for x, y in zip(i, j)]
        assert len(met) == len(set(met)) and set(met) == {(a, b) for a, b in want if any((differ(a, b) & m == 0).all() for m in on)}


def differ(a, b):
    return np.frombuffer(bytes([a ^ b]) * 32, ">u8").astype(np.uint64)


def test_jaccard_of_many_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30000, n).astype(np.uint64)) for n in (0, 0, 1, 5, 50, 20000, 20000, 25000)] + [np.arange(100, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64)]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(len(sets)) for b in range(len(sets))]))
    got = simhash.jaccard_pairs(sets, i, j)
    for a, b, v in zip(i, j, got):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if a == b:
            continue  # values that one set alone has are left out
        assert v == (len(x & y) / len(x | y) if x | y else 1.0)
    assert len(simhash.jaccard_pairs(sets, i[:0], j[:0])) == 0


def test_large_buckets_of_sampled_masks_lose_no_link(spark, monkeypatch):
    """All 40 rows agree on all sampled masks' buckets; each links to its neighbour only, at the radius itself."""
    monkeypatch.setattr(simhash, "SAMPLED_BUCKET", 8)
    monkeypatch.setattr(simhash.Masks, "mask", lambda self, path: np.zeros(self.bits // 64, np.uint64))
    values = [((1 << 6 * k) - 1) for k in range(40)]
    df = simhash.materialise(spark.createDataFrame([(bytearray(v.to_bytes(32, "big")),) for v in values], "fp binary"), "test")
    root = {v: v for v in values}
    for r in simhash.links(df, 256, 6).collect():
        a, b = (int.from_bytes(r[c], "big") for c in "ab")
        root = {v: root[a] if x == root[b] else x for v, x in root.items()}
    assert len(set(root.values())) == 1


def test_one_row_of_each_document_whatever_its_id(spark):
    """Rows that share an id but not their text are documents of their own; ties go by text and by the whole row."""
    a, b = "alpha beta gamma delta epsilon zeta", "quite another text about something else"
    df = spark.createDataFrame([(6, a, "x"), (6, b, "x"), (2, a, "x"), (2, a, "w"), (2, a, "w"), (None, b, "x"), (None, "alone without an id at all", "x"), (None, "alone without an id at all", "x"), (9, None, "x"), (8, " \n", "x")], "DOC_ID bigint, Text string, own string")
    got = sorted(((r[0], r[1]) for r in simhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(2, a), (6, b), (8, " \n"), (None, "alone without an id at all")], key=str)
    assert {r["own"] for r in simhash.one_of_each(df).where("DOC_ID = 2").collect()} == {r["own"] for r in simhash.one_of_each(df.orderBy("own")).where("DOC_ID = 2").collect()}


def test_extra_columns_of_any_name_and_kind(spark):
    df = spark.createDataFrame([(1, "a b c d e f", {"k": 1}, "x", "y"), (2, "a b c d e f", {"k": 2}, "x", "y")], "doc_id bigint, text string, Rep map<string,int>, `odd.name` string, TEXT string")
    (r,) = simhash.one_of_each(df).collect()
    assert simhash.one_of_each(df).columns == df.columns and tuple(r) == (1, "a b c d e f", {"k": 1}, "x", "y")
    assert {r["component_id"] for r in simhash.groups(df).collect()} == {1}
    with pytest.raises(ValueError, match="no column"):
        simhash.groups(df.drop("text", "TEXT"))


def similar_sets(rng, similarity, n=300):
    """Hashes of two sets of shingles of this Jaccard similarity."""
    own = round(n * (1 - similarity) / (1 + similarity))
    x = rng.integers(0, 2**63, n + own, np.uint64)
    return x[:n], x[own:]


@pytest.mark.parametrize("corpus", [200_000, 10_000_000, 10**9])
def test_recall_of_the_pipelines_search(corpus):
    """Of pairs at a similarity from 0.8 up, by band, how many lie within the radius and share a mask's bits."""
    rng = np.random.default_rng(corpus)
    masks = simhash.Masks(256, 53, corpus, simhash.distance_at(0.8, 256, 1))
    on = np.array([masks.mask(p) for p in masks.first()])
    for similarity, least in ((0.8, 0.93), (0.85, 0.98), (0.9, 0.99), (0.95, 0.99)):
        found = 0
        for _ in range(200):
            x, y = (np.frombuffer(simhash.majority(s, 256), ">u8").astype(np.uint64) for s in similar_sets(rng, similarity))
            differ = x ^ y
            found += np.bitwise_count(differ).sum() <= 53 and ((differ & on) == 0).all(axis=1).any()
        assert found >= 200 * least, (similarity, found)
