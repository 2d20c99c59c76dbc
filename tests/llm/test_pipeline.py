import corpus_pipeline
from chainlake.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        if k == 4:
            assert "sequence_id" in out.columns and out.select("doc_id").distinct().count() == kept
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.where("n_chars <> char_length(text)").count() == 0
        n = out.count()
        assert 0 < n <= kept and (n == kept or name in ("quality_rules", "simhash_near_dedup"))
        docs, kept = out, n


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert found["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert set(queries.QUERIES) <= set(found) and sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


PLAIN = " ".join(f"word{k * 7 % 113} of the {k}" for k in range(60))


def test_every_stage_bears_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ids twice and null ids, columns of clashing names."""
    texts = [None, "", PLAIN, PLAIN, PLAIN, PLAIN + " end", "\n".join(["line"] * 50), PLAIN.upper() + " 4111 1111 1111 1111", " ".join(f"w{k % 9973}" for k in range(60000))]
    rows = [(i, t, None, None, None, "x", "y", "z") for i, t in zip((1, None, 3, 3, None, 4, 4, 5, 6), texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, TEXT string, lang string, source string, n_chars bigint, Kept string, salt string, `shingles.x` string")
    got = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    assert {r["doc_id"] for r in got["quality_rules"]} <= {3, None, 4, 5, 6} and len(got["line_dedup"]) == len(got["pseudonyms"]) == 9
    assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in got["simhash_near_dedup"]) == sorted([("1", 0), ("3", len(PLAIN)), ("4", 249), ("6", len(texts[8]))])
    assert "4111 1111" not in "".join(r["text"] or "" for r in got["pseudonyms"])
    pieces = [r for r in got["packing"]]
    assert sum(r["start"] == 0 for r in pieces) == 9 and max(r["offset"] + r["length"] for r in pieces) <= 2048
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_near_dup_stage_by_brute_force(spark):
    """The stage's survivors on a whole small table: components of pairs of 5-word shingle sets at 0.8, and what stays."""
    import itertools

    from .util import WORD, lower

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = WORD.findall(lower(r["text"] or ""))
        sets[r["doc_id"]] = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] == sets[b] or (both := len(sets[a] & sets[b])) and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == {i for i in root if root[i] == i}


def test_a_run_leaves_little_behind(spark):
    import pathlib

    from chainlake.llm import common

    common.discard(spark)
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "chainlake"
    before = set(folder.glob("*"))
    corpus_pipeline.run(spark, SF).collect()
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert left == {"pipeline-pseudonyms", "packing-ids"}, left
    common.discard(spark)
    assert set(folder.glob("*")) == before
