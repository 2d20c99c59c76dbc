import collections
import hashlib
import math

import regex

from chainlake.llm import line_dedup, quality

from .util import ODD, documents, lower, quality_base

REPEATS = ["a b c a b c d", "a a a a", "x y z x y z " * 30, "one\nONE\none\n\n\none ", "#*$ %&|<>", "p q r s p q r t q r s"]
GOOD = [f"the {a} {b} of the house was {c} and the garden too. " * 12 for a, b, c in (("old", "door", "red"), ("new", "roof", "blue"), ("big", "wall", "green"))]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_base_counts(spark):
    texts = [*REPEATS, *ODD]
    got = {r["doc_id"]: r for r in quality.judge_documents(documents(spark, texts), labels(spark, [])).collect()}
    for i, t in enumerate(texts):
        r, (words, chars, symbols, lines, repeated) = got[i], quality_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, lines, repeated), t
        assert r["base_failed"] == (words < 50 or 100 * repeated > 50 * words)
        assert r["kept"] == (not r["base_failed"]) and r["llr"] == 0.0


def distinct_text(k, mark=""):
    return " ".join(f"w{(k * 31 + i * i) % 40}{mark} the" for i in range(80))


def test_junk_is_told_from_text(spark):
    texts = [distinct_text(k) for k in range(30)] + [distinct_text(k, "$$$ %%%") for k in range(30, 36)]
    rows = quality.judge_documents(documents(spark, texts), labels(spark, [(i, 1, 0) for i in range(15)] + [(31, 0, 0), (None, 1, 0), (15, None, 0)])).collect()
    llr = {r["doc_id"]: r["llr"] for r in rows}
    assert min(llr[i] for i in range(30)) > max(llr[i] for i in range(30, 36))
    assert {r["doc_id"] for r in rows if r["llr"] >= quality.THRESHOLD} == set(range(30))


def test_nulls_repeats_and_empty(spark):
    df = documents(spark, [GOOD[0], GOOD[0], None], [None, 1, 1])
    got = quality.judge_documents(df, labels(spark, [(1, 1, 0), (1, 1, 1)])).collect()
    assert len(got) == 3 and len({r["llr"] for r in got if r["text"]}) == 1
    assert quality.judge_documents(df.where("false"), labels(spark, [(1, 1, 0)])).count() == 0


def brute_lines(texts, threshold):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    count = {}
    for lines in split:
        for k in {key(x) for x in lines}:
            count[k] = count.get(k, 0) + 1
    out = []
    for lines in split:
        kept = [x for x in lines if not (key(x) and count[key(x)] >= threshold)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    texts = [f" Common LINE\r\nown {i}\n\n\tcommon line \nrare" for i in range(3)] + ["common line", "common line\n", "RARE x\n" * 500 + "rare", *ODD, "É", "é", "É", "é"]
    for threshold in (2, 4, 5):
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, texts), threshold).collect()}
        for i, want in enumerate(brute_lines(texts, threshold)):
            assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == want, (threshold, texts[i])
            assert got[i]["lang"] is None and got[i]["gone"] == "x"


def test_lines_of_repeated_rows(spark):
    df = documents(spark, ["a\nb", "a\nb", "a\nc", "a", None], [1, 1, None, None, None])
    got = sorted((r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(df, 3).collect())
    assert got == [(1, 0, ""), (1, 1, ""), (2, 1, "b"), (2, 1, "b"), (2, 1, "c")]
    same = documents(spark, ["a\nb"] * 12 + ["b\nc"] * 2, [7] * 12 + [8, 9])
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(same, 10).collect()} == {0}
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(same, 3).distinct().collect()) == [(7, "a"), (8, "c"), (9, "c")]
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_long_texts_of_dropped_lines(spark):
    text = "\n".join(["drop", "keep"] * 20000)
    (r,) = line_dedup.dedup_lines(documents(spark, [text] + ["drop"] * 3), 4).where("doc_id = 0").collect()
    assert r["n_dropped"] == 20000 and hashlib.sha256(r["text"].encode()).digest() == hashlib.sha256("\n".join(["keep"] * 20000).encode()).digest()


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(k, "drop\nkeep", "x", "y", "z") for k in range(3)], "Doc_Id bigint, Text string, N_Lines string, Kept string, `a.b` string")
    (r,) = line_dedup.dedup_lines(df, 3).distinct().where("Doc_Id = 0").collect()
    assert r.asDict() == {"Doc_Id": 0, "Text": "", "Kept": "y", "a.b": "z", "n_lines": 2, "n_dropped": 2}
    out = quality.judge_documents(df, labels(spark, []).withColumnRenamed("quality", "Quality"))
    assert out.columns[:4] == ["Doc_Id", "Text", "N_Lines", "a.b"] and {r["kept"] for r in out.collect()} == {False}
    both = spark.createDataFrame([(1, "one", "two")], "doc_id bigint, TEXT string, text string")
    (r,) = line_dedup.dedup_lines(both, 1).collect()
    assert tuple(r) == (1, "one", "", 1, 1)


def brute_llr(texts, trusted, buckets):
    """The mean log ratio of each text, with buckets given by what the operator hashes to."""
    raw, good = collections.Counter(), collections.Counter()
    for i, b in enumerate(buckets):
        raw.update(b)
        if i in trusted:
            good.update(b)
    n_raw, n_good = sum(raw.values()), sum(good.values())
    extra = quality.SMOOTHING * n_good + 1.0
    share = lambda n, total: (n + extra / quality.BUCKETS) / (total + extra)
    weight = {b: round((math.log(share(good[b], n_good)) - math.log(share(raw[b], n_raw))) * 1e6) for b in raw}
    return [sum(weight[b] for b in own) / len(own) / 1e6 if own else 0.0 for own in buckets]


def test_scores_and_verdicts_by_brute_force(spark):
    """Tokens by a regex of Python's, n-grams one by one, and the logarithms of all counts."""
    texts = [*GOOD, *(distinct_text(k) for k in range(5)), distinct_text(6, "$$$ %%%"), *ODD]
    token = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+")
    grams = []
    for t in texts:
        w = token.findall((t or "").lower())
        grams.append([(x,) for x in w] + list(zip(w, w[1:])))
    known = {g for own in grams for g in own}
    one, two = ([g for g in known if len(g) == n] for n in (1, 2))
    bucket = lambda rows, cols: {tuple(r[:-1]): r[-1] for r in spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).selectExpr("*", f"cast(pmod(xxhash64({', '.join(cols)}), {quality.BUCKETS}) as int)").collect()}
    place = bucket(one, "a") | bucket(two, "ab")
    trusted = {0, 1, 3, 4}
    want = brute_llr(texts, trusted, [[place[g] for g in own] for own in grams])
    rows = quality.judge_documents(documents(spark, texts), labels(spark, [(i, 1, 0) for i in trusted] + [(5, 0, 0), (6, 1, 0), (6, 0, 0)])).collect()
    for r in rows:
        i = r["doc_id"]
        assert abs(r["llr"] - want[i]) < 2e-6, texts[i][:50]
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)
    once = quality.verdicts(documents(spark, texts), labels(spark, [(i, 1, 0) for i in trusted]))
    assert once.columns == [c for c in quality.judge_documents(documents(spark, texts), labels(spark, [])).columns if c != "text"]
    assert sorted((r["doc_id"], r["llr"], r["kept"], r["n_words"]) for r in once.collect()) == sorted((r["doc_id"], r["llr"], r["kept"], r["n_words"]) for r in rows)
    assert quality.verdicts(documents(spark, texts).where("false"), labels(spark, [])).count() == 0
