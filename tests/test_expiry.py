"""The rules of time to live and staleness, case by case, and the two ways of finding removals against each other."""

import pytest
from pyspark.sql import functions as F

from chainlake.operators import expiry
from chainlake.plans import fixture as fx
from chainlake.schema import ID, MAX_LONG

TTL = [
    ("off", 5000, 7000, 0, None), ("off", 0, 7000, 3000, None), ("per_entry", 5000, 7000, 0, 5000), ("per_entry", 0, 7000, 0, None),
    ("per_entry", 5000, 7000, 3000, 3000), ("all", 5000, 7000, 0, 5000), ("all", 0, 7000, 0, 7000), ("all", 0, 7000, 3000, 3000), ("all", 2000, 7000, 3000, 2000),
]


def test_ttl_matrix(spark):
    df = spark.createDataFrame([t[:4] for t in TTL], "e string, t bigint, d bigint, m bigint")
    got = df.select("*", expiry.effective_ttl(F.col("t"), F.col("e"), F.col("d"), F.col("m")).alias("x")).collect()
    assert {tuple(r) for r in got} == set(TTL)


def test_expiry_saturates(spark):
    df = spark.createDataFrame([(5, 7), (MAX_LONG - 1, 7), (5, None)], "a bigint, b bigint")
    assert [r[0] for r in df.select(expiry.expires_at(F.col("a"), F.col("b"))).collect()] == [12, MAX_LONG, None]


# removed, expires_at, action, marked, now, grace -> state
STATES = [
    (False, None, "delete", False, 100, 0, "live"), (False, 100, "delete", False, 99, 0, "live"), (False, 100, "delete", False, 100, 0, "expired"),
    (False, 100, "mark_stale", False, 100, 0, "stale"), (False, 100, "delete", True, 100, 0, "stale"), (False, None, "mark_stale", True, 0, 0, "stale"),
    (True, 100, "delete", True, 200, 0, "removed"), (False, 100, "delete", False, 109, 10, "live"), (False, 100, "delete", False, 110, 10, "expired"), (False, 0, "delete", False, 5, 10, "expired"),
]


def test_states_and_visibility(spark):
    df = spark.createDataFrame([s[:6] for s in STATES], "r boolean, e bigint, a string, m boolean, n bigint, g bigint")
    state = expiry.state(F.col("r"), F.col("e"), F.col("a"), F.col("m"), F.col("n"), F.col("g"))
    rows = df.select("*", state.alias("s")).withColumn("v", expiry.visible(F.col("s"))).withColumn("w", expiry.visible(F.col("s"), True, True)).collect()
    assert {tuple(r)[:7] for r in rows} == set(STATES)
    assert all(r["v"] == (r["s"] == "live") and r["w"] == (r["s"] != "removed") for r in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lookups_give_what_the_join_gives(spark, sf):
    stamped, info, gone = fx.facts(spark, f"/root/testdata/{sf}")
    want = expiry.removals_by_join(info, stamped.where("kind = 'checkpoint'"))
    assert sorted(map(tuple, gone.collect())) == sorted(map(tuple, want.collect()))


def test_removal_set_of_one_checkpoint(spark):
    # seq, expires, action, marked at, removed; by cleanup the sequence numbers that go
    rows = [(1, 50, "delete", None, False), (2, 150, "delete", None, False), (3, 50, "mark_stale", None, False), (4, None, "mark_stale", 5, False), (6, 50, "delete", None, True), (7, None, "delete", 9, False), (12, 50, "delete", None, False)]
    df = spark.createDataFrame([("j", 1, s, 1, s, e, a, 1 if m else None, m, m is not None, r) for s, e, a, m, r in rows], "journal string, author bigint, author_seq bigint, epoch bigint, seq bigint, expires_at_ms bigint, ttl_action string, stale_epoch bigint, stale_seq bigint, stale_marked boolean, removed boolean")
    go = lambda cleanup: sorted(r["seq"] for r in expiry.removal_set(df, (1, 8), 100, cleanup).collect())
    assert go("keep") == [1] and go("delete") == [1, 3, 4]


def test_a_mark_needs_staleness_its_author_and_an_earlier_target(spark):
    rows = [("j", 1, 1, "data", 7, 1, None, None, "author"), ("j", 1, 2, "stale", 7, 2, 7, 1, "off"), ("j", 1, 3, "stale", 8, 1, 7, 1, "author"), ("j", 1, 4, "stale", 7, 3, 7, 1, "author"), ("j", 1, 5, "stale", 7, 4, 7, 1, "author"), ("j", 1, 6, "stale", 7, 5, 7, 9, "author"), ("j", 1, 7, "data", 7, 9, None, None, "author")]
    df = spark.createDataFrame(rows, "journal string, epoch bigint, seq bigint, kind string, author bigint, author_seq bigint, target_author bigint, target_seq bigint, stale_enforce string")
    assert [tuple(r) for r in expiry.stale_marks(df).select(*ID, "stale_seq").collect()] == [("j", 7, 1, 4)]


def test_a_removed_entry_stays_removed_when_it_is_slotted_again(spark):
    """Data at 1:1, a checkpoint at 1:2 that removes it, the same id again at 1:3; and one whose second stamp is later."""
    rows = [("j", 7, 1, 1, 1, 10, "data", 50), ("j", 7, 2, 1, 2, 11, "data", 50), ("j", 7, 2, 1, 3, 12, "data", 900), ("j", 7, 1, 1, 5, 101, "data", 200)]
    info = spark.createDataFrame([(*r[:6], r[6], "h", 1, 40, r[7], "delete") for r in rows], "journal string, author bigint, author_seq bigint, epoch bigint, seq bigint, slot_ts_ms bigint, kind string, entry_hash string, payload_len bigint, effective_ttl_ms bigint, expires_at_ms bigint, ttl_action string")
    marks = spark.createDataFrame([], "journal string, author bigint, author_seq bigint, stale_epoch bigint, stale_seq bigint")
    checkpoints = spark.createDataFrame([("j", 1, 4, 100, "keep"), ("j", 1, 6, 102, "keep")], "journal string, epoch bigint, seq bigint, slot_ts_ms bigint, stale_cleanup string")
    for find in (expiry.removals, expiry.removals_by_join):
        assert [tuple(r) for r in find(expiry.occurrences(info, marks), checkpoints).collect()] == [("j", 7, 1, 1, 4)]


def test_again_and_checkpoints_that_reach_less_far(spark, monkeypatch):
    """The lookups against the definition, with entries slotted again, and with rows of a journal spread over tasks."""
    from chainlake.plans import queries

    monkeypatch.setattr(expiry, "LOOKUP", 40)
    _, occurrences, checkpoints = queries._again(spark, "/root/testdata/sf0.001")
    served = checkpoints.where("verdict = 'apply'")
    got, want = expiry.removals(occurrences, served), expiry.removals_by_join(occurrences, served)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    assert {r["verdict"] for r in checkpoints.select("verdict").distinct().collect()} == {"apply", "no_op", "bad_checkpoint", "merge_settling"}
