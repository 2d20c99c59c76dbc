"""Elections over every subset of live members, chains under shuffling, ingestion, paging."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chainlake.operators import chain, control, election, expiry, prefix, storage, writing
from chainlake.plans import fixture as fx
from chainlake.schema import ID
from chainlake.streaming import live

SF = "/root/testdata/sf0.001"
MEMBERS = [(1, "host-1", (1, 5), (2, 1)), (2, "host-2", (1, 2), (2, 9)), (3, "host-3", (2, 1), (2, 9)), (4, "host-4", (1, 9), (1, 1))]
AUTHORITIES = ["host-3", f"{1:032x}", "host-9"]


def expected(up, mode, tiebreak, fallback, n):
    """The rules, written out over a list."""
    live_ones = [m for m in MEMBERS if m[0] in up]
    place = {m[0]: next((i for i, a in enumerate(AUTHORITIES) if a in (m[1], f"{m[0]:032x}")), None) for m in MEMBERS}
    senior = min(live_ones, key=lambda m: m[2])[0] if live_ones else None
    if mode == "seniority" or (n == 1 and live_ones):
        return senior
    listed = [m for m in live_ones if place[m[0]] is not None]
    if not listed:
        return senior if fallback == "seniority" else None
    if mode == "configured":
        return min(listed, key=lambda m: (place[m[0]], m[2]))[0]
    fresh = tiebreak == "freshest"
    return min(listed, key=lambda m: ((-m[3][0], -m[3][1]) if fresh else (), m[2]))[0]


@pytest.mark.parametrize("mode,tiebreak,fallback", [("seniority", "seniority", "stall"), ("configured", "seniority", "stall"), ("configured", "seniority", "seniority"), ("combined", "seniority", "stall"), ("combined", "freshest", "seniority")])
def test_every_subset_of_live_members(spark, mode, tiebreak, fallback):
    subsets = [set(c) for r in range(5) for c in itertools.combinations(range(1, 5), r)]
    rows = [(k, i, f"{i:032x}", a, *s, "member" if i in up else "lost", *ack) for k, up in enumerate(subsets) for i, a, s, ack in MEMBERS]
    views = spark.createDataFrame(rows, "cluster bigint, member bigint, hex_id string, address string, joined_epoch bigint, joined_seq bigint, state string, ack_epoch bigint, ack_seq bigint")
    auth = spark.createDataFrame([(k, p, a) for k in range(len(subsets)) for p, a in enumerate(AUTHORITIES)], "cluster bigint, place bigint, authority string")
    got = {r["cluster"]: r["leader"] for r in election.elect(election.with_authority(views, auth), mode, tiebreak, fallback).collect()}
    assert got == {k: expected(up, mode, tiebreak, fallback, 4) for k, up in enumerate(subsets)}


def test_one_member_leads_itself(spark):
    views = spark.createDataFrame([(1, 7, "07", "h", 1, 1, "member", 1, 1), (2, 8, "08", "h", 1, 1, "lost", 1, 1)], "cluster bigint, member bigint, hex_id string, address string, joined_epoch bigint, joined_seq bigint, state string, ack_epoch bigint, ack_seq bigint")
    for mode in ("seniority", "configured", "combined"):
        assert {r["cluster"]: r["leader"] for r in election.elect(views, mode).collect()} == {1: 7, 2: None}


def test_the_same_log_in_any_order_gives_the_same_summary(spark):
    s = fx.slots(spark, SF).select("journal", "epoch", "seq", "kind", "author", "payload_len", "entry_hash", "prev_slot_hash")
    rows = s.collect()
    want = sorted(map(tuple, chain.fold_summary(s).collect()))
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        again = spark.createDataFrame(rows, s.schema).repartition(seed + 3)
        assert sorted(map(tuple, chain.fold_summary(again).collect())) == want


def test_pages_are_greedy(spark):
    sizes = [10, 90, 1, 200, 50, 50, 1]
    df = spark.createDataFrame([("j", 1, i + 1, n) for i, n in enumerate(sizes)], "journal string, epoch bigint, seq bigint, record_bytes bigint")
    assert [r["page"] for r in sorted(storage.pages(df, 100).collect(), key=lambda r: r["seq"])] == [0, 0, 1, 2, 3, 3, 4]


def test_ingest_twice_adds_nothing(spark, tmp_path):
    """Entries that come again in a batch, in a later batch, or in another run; the refused ones stand apart."""
    s = fx.slots(spark, SF).where("journal = 'j1'").select("journal", "author", "author_seq", F.col("event_id").alias("arrival"), "payload_len")
    known = spark.createDataFrame([("j1", "true", 8)], "journal string, allow_append string, max_entry_bytes bigint")
    none = spark.createDataFrame([], "journal string, epoch bigint, seq bigint, slot_ts_ms bigint")

    def slot(batch, heads):
        return writing.append(batch, known, none if heads is None else heads, 5, 2)

    s.union(s.limit(5)).write.parquet(f"{tmp_path}/in")
    for k in range(3):
        stream = live.slots_stream(spark, f"{tmp_path}/in", s.schema)
        live.ingest(stream, f"{tmp_path}/table", f"{tmp_path}/cursor", slot).awaitTermination()
        if k == 1:
            s.union(s.withColumn("author_seq", F.col("author_seq") + 1000)).write.mode("append").parquet(f"{tmp_path}/in")
    got = spark.read.parquet(f"{tmp_path}/table")
    small = s.where("payload_len <= 8").count()
    assert 0 < small < s.count()
    assert got.count() == 2 * small and spark.read.parquet(f"{tmp_path}/table-refused").where("refusal = 'too_large'").count() >= s.count() - small
    assert sorted(r["seq"] for r in got.collect()) == list(range(1, 2 * small + 1))


def test_delivery_resumes_at_its_cursor(spark, tmp_path):
    s = fx.slots(spark, SF).where("journal = 'j1'").select("journal", "epoch", "seq", "kind")
    seen = []
    for part in ("epoch = 1", "epoch = 2"):
        s.where(part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.follow(live.slots_stream(spark, f"{tmp_path}/in", s.schema), "j1", (1, 5))
        live.deliver(stream, lambda b, n: seen.extend(map(tuple, b.collect())), f"{tmp_path}/cursor").awaitTermination()
    assert len(seen) == len(set(seen)) == s.where("epoch in (1, 2) and (epoch > 1 or seq >= 5)").count()


def test_expiries_follow_the_last_slot_with_a_timer_a_part(spark, tmp_path):
    """Three runs against the rules over a dict: entries slotted again with an earlier, later or no instant, or delivered
    again out of order; slots without an entry; ids beyond a double's digits; instants that equal the last stamp."""
    r, ids = random.Random(3), [(f"j{k % 3}", 2**60 + k % 7, k) for k in range(4000)]
    schema = "journal string, author bigint, author_seq bigint, epoch bigint, seq bigint, slot_ts_ms bigint, expires_at_ms bigint, ttl_action string, grace_ms bigint"
    known, want, timers, seq = {}, [], [], 0
    for run in range(3):
        rows, last = [], {}
        for entry in ids if run == 0 else r.sample(ids, 1500):
            for _ in range(r.choice([1, 1, 1, 2])):
                seq, ts = seq + 1, 100 * run + r.randrange(1, 100)
                ttl = r.choice([None, 0, r.randrange(1, 50), r.randrange(50, 400)])
                at = r.choice([seq, seq, seq, seq - 3000]) if run else seq
                rows.append((*entry, 1, at, ts, None if ttl is None else ts + ttl, r.choice(["delete", "mark_stale"]), r.choice([0, 7])))
        rows += [(f"j{k}", None, None, 1, seq + k, 100 * run + 100, None, "mark_stale", 0) for k in range(1, 4)]
        for x in rows:
            if x[1] is not None and (x[:3] not in last or last[x[:3]][4] < x[4]):
                last[x[:3]] = x
        for entry, x in last.items():
            if entry not in known or known[entry][4] <= x[4]:
                known[entry] = x
                if x[6] is None:
                    del known[entry]
        now = 100 * run + 100
        done = {entry: x for entry, x in known.items() if x[6] + x[8] <= now}
        want += [(*entry, "expired" if x[7] == "delete" else "stale", x[6] + x[8]) for entry, x in done.items()]
        known = {entry: x for entry, x in known.items() if entry not in done}
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = live.expiries(live.slots_stream(spark, f"{tmp_path}/in", schema))
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start()
        q.awaitTermination()
        timers += [o["customMetrics"].get("numRegisteredTimers", 0) for p in q.recentProgress for o in p["stateOperators"]]
        assert run or len(known) > live.PARTS
    assert 0 < max(timers) <= live.PARTS and {100, 200, 300} <= {x[4] for x in want}
    assert out.dtypes == [("journal", "string"), ("author", "bigint"), ("author_seq", "bigint"), ("becomes", "string"), ("at_ms", "bigint")]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(want)


def test_settings_are_applied_as_a_whole_or_not_at_all(spark):
    from chainlake.operators import settings

    rows = [
        ("c", 1, 1, True, 1, [], [("leadership.mode", "configured"), ("leadership.authorities", "")]),
        ("c", 1, 2, False, 3, ["h:1"], [("ttl.enforce", "all")]),
        ("c", 1, 3, False, 3, ["h:1"], [("leadership.authorities", "h:1"), ("ttl.enforce", "all"), ("ttl.default_ms", "5")]),
        ("c", 1, 4, False, 3, ["h:1"], [("leadership.authorities", "h:9")]),
        ("c", 1, 5, False, 3, ["h:1"], [("leadership.reconfigurable", "false")]),
        ("c", 1, 6, False, 3, ["h:1"], [("leadership.mode", "seniority")]),
        ("c", 1, 7, False, 3, ["h:1"], [("nope", "1")]),
        ("c", 1, 8, False, 3, ["h:1"], [("ttl.max_ms", "7")]),
        ("c", 2, 1, False, 3, ["h:1"], [("journal.max_entry_bytes", str(17 << 20))]),
    ]
    df = spark.createDataFrame(rows, "journal string, epoch bigint, seq bigint, is_genesis boolean, n_members int, names array<string>, changes array<struct<key: string, value: string>>")
    got = sorted(settings.replay(df).collect(), key=lambda r: (r["epoch"], r["seq"]))
    assert [r["refusal"] for r in got] == [None, "invalid_settings", None, "invalid_settings", None, "not_live_changeable", "unknown_setting", None, "invalid_settings"]
    assert len({r["hash"] for r in got}) == 4


def brute_refusals(rows):
    """Duplicates by folding one journal's rows (seq, author, author_seq, hash, refused by another rule) in order."""
    last, first, out = {}, {}, []
    for _, author, number, content, other in rows:
        if other == "before":
            out.append("unknown_author")
        elif number <= last.get(author, -1) and first.get((author, number)) != content:
            out.append("duplicate_conflict")
        elif other == "after":
            out.append("too_large")
        else:
            first.setdefault((author, number), content)
            last[author] = max(last.get(author, -1), number)
            out.append(None)
    return out


def test_conflicts_as_a_fold_finds_them(spark):
    rng = random.Random(5)
    rows = [("j1", *r) for r in [(1, "a", 5, "A", None), (2, "a", 5, "B", None), (3, "a", 5, "B", None), (4, "a", 5, "A", None), (5, "a", 4, "C", None), (6, "a", 4, "C", None)]]
    for j in range(2, 40):
        rows += [(f"j{j}", k + 1, rng.choice("ab"), rng.randrange(1, 6), rng.choice("AB"), rng.choice([None] * 4 + ["before", "after"])) for k in range(30)]
    df = spark.createDataFrame(rows, "journal string, seq bigint, by string, author_seq bigint, entry_hash string, other string")
    s = df.selectExpr("*", "cast(1 as bigint) as epoch", "cast(seq as bigint) as slot_ts_ms", "if(other = 'before', 'nobody', by) as author", "'l' as leader", "'data' as kind", "cast(if(other = 'after', 100, 1) as bigint) as payload_len", "'true' as allow_append", "'author' as stale_enforce", "cast(null as string) as target_author", "cast(null as boolean) as signature_ok", "cast(null as boolean) as payload_ok", "concat(journal, seq) as slot_hash", f"if(seq = 1, repeat('0', 64), concat(journal, seq - 1)) as prev_slot_hash")
    members = spark.createDataFrame([("a",), ("b",), ("l",)], "member string")
    got = {(r["journal"], r["seq"]): r["refusal"] for r in chain.first_refusal(s, members, max_entry_bytes=10).collect()}
    for j in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == j]
        assert [got[j, r[0]] for r in own] == brute_refusals([(r[0], "nobody" if r[4] == "before" else r[1], *r[2:]) for r in own]), own


def test_creations_under_a_cap(spark):
    make = lambda ids, names: spark.createDataFrame([(i, n, 1, k) for k, (i, n) in enumerate(zip(ids, names))], "id bigint, name string, epoch bigint, seq bigint")
    old = spark.createDataFrame([(0,)], "id bigint")
    go = lambda df, most: [r["refusal"] for r in sorted(chain.create_journal_refusal(df, old, most).collect(), key=lambda r: r["seq"])]
    assert go(make([1, 2, 3, 4, 5], "abcde"), 3) == [None, None, "too_many_journals", "too_many_journals", "too_many_journals"]
    assert go(make([7, 7, 7, 0], ["", "x", "y", "z"]), 9) == ["bad_journal_name", None, "journal_exists", "journal_exists"]
    assert go(make([1, 2, 2, 1], ["a", "b", "", ""]), 2) == [None, "too_many_journals", "bad_journal_name", "journal_exists"]


def test_one_journal_in_many_buckets(spark, monkeypatch):
    """Settings, neighbours and numbers are the same whether a chain is cut into many buckets or none."""
    from chainlake.operators import merge, settings

    s = fx.slots(spark, SF).where("journal in ('j1', 'j2')").select("journal", "epoch", "seq", "slot_ts_ms", "slot_hash", "prev_slot_hash", "kind", "k", *ID[1:], "ttl_ms", "payload_len", "entry_hash", "event_id")
    s = s.withColumn("prev_slot_hash", F.expr("if(event_id % 7 = 0, 'x', prev_slot_hash)"))

    def results():
        known = settings.in_force(s, fx.changes(s), fx.KEYS).select("journal", "epoch", "seq", *map(settings.column_of, fx.KEYS))
        broken = chain.continuity(s).select("journal", "epoch", "seq", "refusal")
        moved = merge.reslot(s.where("epoch = 1"), s.where("epoch > 1"), 3, 1706700000000).select(*ID, "epoch", "seq")
        return [sorted(map(tuple, df.collect()), key=repr) for df in (known, broken, moved)], known

    want, _ = results()
    monkeypatch.setattr(prefix, "BUCKET", 5)
    got, plan = results()
    assert got == want
    text = plan._jdf.queryExecution().executedPlan().toString()
    import re

    windows = re.findall(r"Window \[[^\n]*?\], \[(.*?)\], \[", text)
    assert windows and sum("_b" in w for w in windows) >= 1


def test_predicates_reach_the_scan(spark):
    from chainlake.operators import reads

    s = fx.slots(spark, SF)
    for df in (reads.read(s, "j1", first=(1, 20), last=(2, 60)), reads.read(s, author=7), reads.read(s, since_ms=1704500000000), reads.point(s, "j1", (2, 3)), reads.page_after(s, "j1", (1, 10), 25)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull" in plan or "PushedFilters: [Or" in plan, plan
    assert "PartitionFilters: [isnotnull(journal" in reads.scan(s, "j1")._jdf.queryExecution().executedPlan().toString()


# --- the control chain --------------------------------------------------------------------------------------------


def control_rows(*steps):
    """Records of a control chain from (kind, author, payload, more); members are numbers, their ids follow from keys."""
    import hashlib

    from chainlake.functions import codec

    rows, numbers, epoch, seq = [], {}, 1, 0
    for k, (kind, author, payload, *more) in enumerate(steps):
        extra = more[0] if more else {}
        seq += 1
        if kind == "epoch" and "epoch" not in extra:
            epoch, seq = epoch + 1, 1
        numbers[author] = numbers.get(author, 0) + 1
        raw = payload if isinstance(payload, bytes) else codec.encode_payload(kind, **payload)
        r = {"cluster": "c", "epoch": epoch, "seq": seq, "slot_ts_ms": 1000 * k, "kind": kind, "author": member(author), "author_seq": numbers[author], "entry_hash": hashlib.sha256(raw + bytes([k])).digest(), "entry_journal": b"C" * 16, "slot_leader": member(1), "payload": raw, "signature_ok": None, "slot_signature_ok": None, "payload_ok": None, "refusal": None}
        rows.append(r | {k: v for k, v in extra.items() if k != "epoch"})
    return rows


def key(n):
    return bytes([n]) * 32


def member(n):
    import hashlib

    return hashlib.sha256(key(n)).digest()[:16]


def join(n, address="h"):
    return {"member": member(n), "public_key": key(n), "address": f"{address}{n}"}


def outcomes(spark, *steps):
    schema = "cluster string, epoch bigint, seq bigint, slot_ts_ms bigint, kind string, author binary, author_seq bigint, entry_hash binary, entry_journal binary, slot_leader binary, payload binary, signature_ok boolean, slot_signature_ok boolean, payload_ok boolean, refusal string"
    rows = control_rows(*steps)
    df = spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r.values()) for r in rows], schema)
    folded = control.fold(df)
    return folded, [r["outcome"] for r in sorted(folded.collect(), key=lambda r: r["slot_ts_ms"])]


GENESIS = ("genesis", 1, {"founder_key": key(1), "changes": []})
CLUSTER = {"scope": "cluster", "journal": bytes(16)}


def test_the_control_chain(spark):
    folded, got = outcomes(
        spark,
        GENESIS,
        GENESIS,
        ("join", 1, join(2)),
        ("join", 1, join(2)),
        ("join", 1, {"member": member(3), "public_key": key(4), "address": "x"}),
        ("join", 1, b"junk"),
        ("join", 1, join(3), {"signature_ok": False}),
        ("join", 1, join(3), {"payload_ok": False}),
        ("join", 1, join(3), {"slot_leader": member(2)}),
        ("join", 1, join(3)),
        ("leave", 2, {"member": member(3)}),  # neither itself nor the leader: slotted again by a merge, and refused
        ("leave", 1, {"member": member(9)}),
        ("create_journal", 1, {"journal": b"j" * 16, "name": "one", "changes": []}),
        ("create_journal", 1, {"journal": b"j" * 16, "name": "two", "changes": []}),
        ("create_journal", 1, {"journal": b"k" * 16, "name": "", "changes": []}),
        ("create_journal", 1, {"journal": b"k" * 16, "name": "k", "changes": [("ttl.enforce", "all")]}),
        ("settings", 1, CLUSTER | {"changes": [("cluster.max_journals", "1")]}),
        ("create_journal", 1, {"journal": b"k" * 16, "name": "k", "changes": []}),
        ("settings", 1, {"scope": "journal", "journal": b"j" * 16, "changes": [("ttl.enforce", "off")]}),
        ("settings", 2, CLUSTER | {"changes": [("cluster.max_journals", "9")]}),  # not the leader's: nothing
        ("data", 1, b"x"),
        ("merge", 1, {"epoch": 0, "seq": 4}),
        ("merge", 1, {"epoch": 1, "seq": 4}),
        ("epoch", 1, {"number": 2, "leader": member(9), "reason": "manual"}),
        ("epoch", 2, {"number": 3, "leader": member(2), "reason": "leader_lost"}, {"slot_leader": member(2)}),
    )
    assert got == [
        "apply", "bad_genesis", "apply", "already_member", "bad_join", "bad_control_payload", "bad_signature", "bad_payload_hash", "not_leader", "apply",
        "bad_leave", "bad_leave", "apply", "journal_exists", "bad_journal_name", "invalid_settings", "apply", "too_many_journals", "scope_mismatch", "no_op", "wrong_journal_type", "bad_merge", "apply", "bad_epoch", "bad_epoch",
    ]
    assert {bytes(r["member"]): r["address"] for r in control.members(folded).collect()} == {member(1): "", member(2): "h2", member(3): "h3"}
    assert [(r["name"], r["created_seq"]) for r in control.journals(folded).collect()] == [("one", 13)]
    assert [r["merge_ts_ms"] for r in control.last_merges(folded).collect()] == [22000]
    assert {bytes(r["member"]) for r in control.members_as_of(folded, (1, 3)).collect()} == {member(1), member(2)}


def test_nothing_counts_before_the_genesis(spark):
    assert outcomes(spark, ("join", 1, join(2)), ("join", 1, join(2)))[1] == ["wrong_journal", "wrong_journal"]


def test_terms_and_what_a_merge_slots_again(spark):
    folded, got = outcomes(
        spark,
        GENESIS,
        ("join", 1, join(2)),
        ("epoch", 1, {"number": 2, "leader": member(2), "reason": "manual"}),
        ("epoch", 1, {"number": 2, "leader": member(1), "reason": "manual"}, {"epoch": 2, "slot_leader": member(2)}),  # of the same term: again
        ("join", 1, join(2), {"slot_leader": member(2)}),  # by a former leader, of a member
        ("join", 1, join(3), {"slot_leader": member(2)}),
        ("leave", 3, {"member": member(3)}, {"slot_leader": member(2)}),
        ("leave", 1, {"member": member(3)}, {"slot_leader": member(2)}),
        ("settings", 1, CLUSTER | {"changes": [("cluster.max_members", "3")]}, {"slot_leader": member(2)}),
        ("settings", 2, CLUSTER | {"changes": [("leadership.reconfigurable", "false")]}, {"slot_leader": member(2)}),
        ("settings", 2, CLUSTER | {"changes": [("leadership.mode", "configured")]}, {"slot_leader": member(2)}),
        ("epoch", 1, {"number": 3, "leader": member(1), "reason": "leader_lost"}),
    )
    assert got == ["apply", "apply", "apply", "no_op", "no_op", "apply", "apply", "no_op", "no_op", "apply", "not_live_changeable", "apply"]
    t = control.terms(folded)
    assert sorted((r["epoch"], bytes(r["leader"]), r["reason"]) for r in t.collect()) == [(1, member(1), "genesis"), (2, member(2), "manual"), (3, member(1), "leader_lost")]
    assert [(r["epoch"], bytes(r["leader"])) for r in control.current_leaders(t).collect()] == [(3, member(1))]
    slots = spark.createDataFrame([("c", 2, 1), ("c", 9, 1)], "cluster string, epoch bigint, seq bigint")
    assert sorted((r["epoch"], r["term_leader"] and bytes(r["term_leader"])) for r in control.with_term_leader(slots, t).collect()) == [(2, member(2)), (9, None)]


def test_whole_state_rules_on_joining_and_leaving(spark):
    listed = [("leadership.mode", "configured"), ("leadership.authorities", ["h2"])]
    _, got = outcomes(
        spark,
        ("genesis", 1, {"founder_key": key(1), "changes": listed}),
        ("join", 1, join(3)),  # two members, and none of the authorities among them
        ("join", 1, join(2)),
        ("join", 1, join(3)),
        ("leave", 1, {"member": member(2)}),
        ("leave", 1, {"member": member(3)}),
    )
    assert got == ["apply", "invalid_settings", "apply", "apply", "invalid_settings", "apply"]


def test_payloads_as_columns(spark):
    import hashlib

    rows = control_rows(GENESIS, ("join", 1, join(2, "hö")), ("epoch", 1, {"number": 2, "leader": member(2), "reason": "merge"}), ("leave", 1, {"member": member(2)}), ("merge", 1, {"epoch": 7, "seq": 8}), ("stale", 1, {"author": member(1), "author_seq": 9}), ("checkpoint", 1, {"epoch": 3, "seq": 4}), ("create_journal", 1, {"journal": b"j" * 16, "name": "näme", "changes": []}), ("join", 1, b"short"))
    df = spark.createDataFrame([(r["kind"], bytearray(r["payload"])) for r in rows], "kind string, payload binary")
    got = control.with_payloads(df).collect()
    assert bytes(got[0]["public_key"]) == key(1) and (bytes(got[1]["joining"]), bytes(got[1]["public_key"]), got[1]["address"]) == (member(2), key(2), "hö2")
    assert (got[2]["term_number"], got[2]["term_reason"], bytes(got[2]["term_leader"])) == (2, "merge", member(2)) and bytes(got[3]["leaving"]) == member(2)
    assert (got[4]["branch_epoch"], got[4]["branch_seq"], got[5]["target_seq"], got[6]["through_epoch"], got[6]["through_seq"]) == (7, 8, 9, 3, 4)
    assert (bytes(got[7]["created"]), got[7]["created_name"], got[8]["joining"]) == (b"j" * 16, "näme", None)
    ok = spark.createDataFrame([(bytearray(b"x"), bytearray(hashlib.sha256(b"x").digest()), False), (bytearray(b"y"), bytearray(hashlib.sha256(b"x").digest()), False), (None, bytearray(hashlib.sha256(b"x").digest()), True), (None, bytearray(hashlib.sha256(b"").digest()), False)], "p binary, h binary, o boolean")
    assert [r[0] for r in ok.select(control.payload_verdict(F.col("p"), F.col("h"), F.col("o"))).collect()] == [True, False, True, True]
