"""Segment files, payload codecs, signatures, configuration."""

import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlake import cli
from chainlake.functions import codec, ed25519, scalar
from chainlake.plans import queries
from chainlake.sources import config, segment

JOURNAL = bytes(range(16))


def record(seq, **more):
    payload = more.pop("payload", b"hello")
    r = {"journal": JOURNAL, "epoch": 1, "seq": seq, "slot_ts_ms": 1700000000000, "kind": "data", "author": b"a" * 16, "author_seq": seq, "author_ts_ms": 5, "ttl_ms": 0, "payload": payload, "payload_len": len(payload), "payload_hash": hashlib.sha256(payload).digest(), "payload_omitted": False, "entry_hash": b"\xab" * 32, "prev_slot_hash": bytes(32) if seq == 1 else b"p" * 32, "leader": b"l" * 16, "entry_sig": bytes(64), "slot_sig": bytes(64)}
    return r | more


def slot_only(seq):
    return record(seq) | dict.fromkeys(("kind", "author", "author_seq", "author_ts_ms", "ttl_ms", "payload", "payload_len", "payload_hash", "payload_omitted", "entry_sig"))


def file_of(*records, sealed=False):
    return segment.encode_segment(JOURNAL, bytes(32), b"".join(map(segment.encode_record, records)), sealed)


def test_three_shapes_and_their_sizes():
    rows = [record(1), record(2) | {"payload": None, "payload_omitted": True}, slot_only(3), record(4, payload=b"")]
    assert [len(segment.encode_record(r)) for r in rows] == [345, 340, 176, 340]
    assert list(segment.iter_records(file_of(*rows))) == rows


@pytest.mark.parametrize("sealed", [False, True])
def test_every_cut_leaves_whole_records(sealed):
    raw = file_of(record(1), record(2))
    for n in range(segment.HEADER_SIZE, len(raw) + 1):
        assert len(list(segment.iter_records(raw[:n]))) == (n >= 54 + 345) + (n >= 54 + 690)
    whole = file_of(record(1), record(2), sealed=sealed)
    assert len(list(segment.iter_records(whole))) == 2


def test_damage_in_the_middle_is_refused():
    raw = bytearray(file_of(record(1), record(2), record(3)))
    raw[54 + 345 + 100] ^= 1
    with pytest.raises(segment.SegmentError, match="corrupt"):
        list(segment.iter_records(bytes(raw)))
    assert len(list(segment.iter_records(bytes(raw), permissive=True))) == 1
    seal = bytearray(file_of(record(1), sealed=True))
    seal[-1] ^= 1
    with pytest.raises(segment.SegmentError, match="corrupt_seal"):
        list(segment.iter_records(bytes(seal)))
    with pytest.raises(segment.SegmentError, match="bad_magic"):
        list(segment.iter_records(b"XXXX" + bytes(raw[4:])))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes_are_refused_or_read(raw):
    for f in (lambda: list(segment.iter_records(raw)), lambda: segment.decode_entry(raw), lambda: segment.decode_queue(raw)):
        try:
            f()
        except segment.SegmentError:
            pass
    for kind in ("stale", "checkpoint", "merge", "epoch", "leave", "join", "settings", "genesis", "create_journal"):
        try:
            codec.decode_payload(kind, raw)
        except (codec.CodecError, UnicodeDecodeError):
            pass


def test_generations():
    good = lambda k: True
    assert segment.generation([0], 3, good) == (0, 3)
    assert segment.generation([0, 2], 4, good) == (2, 4)
    assert segment.generation([0, 2], 3, good) == (0, 2)
    assert segment.generation([0, 2], 4, lambda k: k != 3) == (0, 2)
    assert segment.generation([0, 2, 4], 5, good) == (2, 4)


def test_queue_files():
    raw = segment.encode_queue([record(1), record(2)])
    assert [e["author_seq"] for e in segment.decode_queue(raw)] == [1, 2]
    assert [e["author_seq"] for e in segment.decode_queue(raw[:-3])] == [1]
    damaged = bytearray(raw)
    damaged[30] ^= 1
    with pytest.raises(segment.SegmentError, match="corrupt"):
        segment.decode_queue(bytes(damaged))


def test_data_source(spark, tmp_path):
    slots = queries.binary_slots(spark, "/root/testdata/sf0.001")
    segment.write_segments(slots, str(tmp_path), roll_bytes=20000)
    back = segment.read_segments(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, slots.collect()), key=repr)
    assert max(len(os.listdir(tmp_path / d)) for d in os.listdir(tmp_path)) > 1
    journal = bytes(back.first()["journal"])
    assert cli.run(spark, ["read", "--data", str(tmp_path), "--journal", journal.hex(), "--from", "1:2", "--to", "1:4"]).count() == 3
    assert cli.run(spark, ["head", "--data", str(tmp_path)]).count() == 8
    assert cli.run(spark, ["status", "--data", str(tmp_path)]).count() == 8
    assert cli.run(spark, ["doctor", "--data", str(tmp_path)]).count() == 11
    assert {(r["refusal"], r["n"] > 0) for r in cli.run(spark, ["verify", "--data", str(tmp_path)]).collect()} == {(None, True)}
    assert cli.run(spark, ["settings-schema"]).count() == 25
    # the header in SQL is the header of the files
    r = back.first().asDict()
    h = spark.createDataFrame([back.first()], back.schema).select(scalar.entry_header(*[F.col(c) for c in ("kind", "journal", "author", "author_seq", "author_ts_ms", "ttl_ms", "payload_len", "payload_hash", "entry_sig")])).first()[0]
    assert bytes(h) == segment.entry_header(r)


CHANGES = [("leadership.authorities", ["a", "", "é"]), ("cluster.max_members", "7"), ("ttl.enforce", "all"), ("journal.allow_append", "false"), ("ttl.max_ms", "123"), ("cluster.max_journals", "9")]
PAYLOADS = [
    ("stale", {"author": b"a" * 16, "author_seq": 7}), ("checkpoint", {"epoch": 1, "seq": 2}), ("merge", {"epoch": 3, "seq": 4}), ("epoch", {"number": 5, "leader": b"l" * 16, "reason": "manual"}),
    ("leave", {"member": b"m" * 16}), ("join", {"member": b"m" * 16, "public_key": b"k" * 32, "address": "host:1"}), ("settings", {"scope": "cluster", "journal": bytes(16), "changes": CHANGES[:2]}), ("settings", {"scope": "journal", "journal": b"j" * 16, "changes": CHANGES[2:5]}),
    ("genesis", {"founder_key": b"f" * 32, "changes": CHANGES[:2]}), ("create_journal", {"journal": b"j" * 16, "name": "näme", "changes": CHANGES[2:5]}),
]


@pytest.mark.parametrize("kind,value", PAYLOADS)
def test_payloads(kind, value):
    raw = codec.encode_payload(kind, **value)
    assert codec.decode_payload(kind, raw) == value
    for bad in (raw[:-1], raw + b"x"):
        with pytest.raises(codec.CodecError):
            codec.decode_payload(kind, bad)


def test_changes_as_a_table_function(spark):
    spark.udtf.register("settings_changes", codec.SettingsChanges)
    from chainlake.shipping import ship

    ship(spark)
    df = spark.createDataFrame([(1, bytearray(codec.encode_payload("settings", scope="journal", journal=b"j" * 16, changes=CHANGES[2:5]))), (2, bytearray(b"\1"))], "id int, payload binary")
    df.createOrReplaceTempView("payloads")
    rows = spark.sql("select id, c.* from payloads, lateral settings_changes(payload) c").collect()
    assert [(r["key"], r["value"]) for r in rows if r["id"] == 1] == [("ttl.enforce", "all"), ("journal.allow_append", "false"), ("ttl.max_ms", "123")]
    assert [r["error"] is not None for r in rows if r["id"] == 2] == [True]


def test_published_signatures():
    # the first three test vectors of RFC 8032
    for secret, key, message, sig in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
        ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ):
        s, k, m, g = map(bytes.fromhex, (secret, key, message, sig))
        assert ed25519.public_key(s) == k and ed25519.sign(s, m) == g and ed25519.verify(k, m, g)
        assert not ed25519.verify(k, m + b"x", g) and not ed25519.verify(k, m, g[:-1] + b"\xff")


def test_configuration():
    c = config.parse('data_dir = "/var/x#y" # comment\nstorage.fsync = "never"\nsync.unslotted_max_bytes = 1_000\n[genesis]\nleadership.authorities = ["a", "b.c"]\ncluster.max_members = 5\n[[peers]]\naddress = "h:1"\npublic_key = "' + "ab" * 32 + '"\n')
    assert c["data_dir"] == "/var/x#y" and c["sync.unslotted_max_bytes"] == 1000 and c["genesis"] == {"leadership.authorities": ["a", "b.c"], "cluster.max_members": "5"} and c["peers"][0]["address"] == "h:1"
    for text, name in (("x = 1", "unknown_key"), ("ttl.enforce = \"all\"", "journal_key"), ("data_dir = 5", "invalid_type"), ("data_dir", "syntax"), ('data_dir = "a', "syntax"), ('listen = "a"\nlisten = "b"', "duplicate"), ('storage.fsync = "x"', "invalid_value"), ("[other]", "unknown_key"), ('[[peers]]\npublic_key = "ab"', "invalid_value"), ("[genesis]\nttl.enforce = \"all\"", "journal_key"), ("[genesis]\nnope = 1", "unknown_key")):
        with pytest.raises(config.ConfigError, match=name):
            config.parse(text)


def some_slots(spark, first, n, journal=JOURNAL):
    rows = [record(k, journal=journal) for k in range(first, first + n)]
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r.values()) for r in rows], ", ".join(f"{c} {t}" for c, t in zip(rows[0], KINDS_OF))).select(*segment.ROW_NAMES)


KINDS_OF = ["binary", "bigint", "bigint", "bigint", "string", "binary", "bigint", "bigint", "bigint", "binary", "bigint", "binary", "boolean", "binary", "binary", "binary", "binary", "binary"]


def test_appending_and_overwriting(spark, tmp_path):
    path, read = str(tmp_path), lambda: sorted(r["seq"] for r in segment.read_segments(spark, str(tmp_path)).collect())
    segment.write_segments(some_slots(spark, 1, 3), path, roll_bytes=700)
    segment.write_segments(some_slots(spark, 4, 2), path)
    assert read() == [1, 2, 3, 4, 5]
    names = sorted(os.listdir(tmp_path / JOURNAL.hex()))
    assert names == [f"seg-{k:08d}" for k in range(len(names))] and len(names) >= 3
    heads = segment.segment_headers(spark, path).collect()
    assert {bytes(r["journal"]) for r in heads} == {JOURNAL} and all(r["sealed"] and bytes(r["group"]) == bytes(32) for r in heads) and len(heads) == len(names)
    other = b"o" * 16
    segment.write_segments(some_slots(spark, 1, 2, other), path)
    assert segment.read_segments(spark, path, journal=other).count() == 2 and segment.read_segments(spark, path, journal=JOURNAL).count() == 5
    segment.write_segments(some_slots(spark, 1, 2), path, overwrite=True)
    assert read() == [1, 2] and sorted(p for p in os.listdir(tmp_path)) == [JOURNAL.hex()]


def test_what_a_crash_leaves_is_not_read(spark, tmp_path):
    segment.write_segments(some_slots(spark, 1, 3), str(tmp_path))
    writer = segment.SegmentWriter(str(tmp_path), 1 << 20, False)
    done = writer.write(iter(some_slots(spark, 4, 2).toArrow().cast(segment.ROW_SCHEMA).to_batches()))
    assert segment.read_segments(spark, str(tmp_path)).count() == 3
    writer.commit([done])
    assert segment.read_segments(spark, str(tmp_path)).count() == 5
    again = segment.SegmentWriter(str(tmp_path), 1 << 20, True)
    again.abort([again.write(iter(some_slots(spark, 9, 1).toArrow().cast(segment.ROW_SCHEMA).to_batches()))])
    assert segment.read_segments(spark, str(tmp_path)).count() == 5 and os.listdir(tmp_path) == [JOURNAL.hex()]


def test_planning_reads_a_few_bytes_of_each_file(spark, tmp_path, monkeypatch):
    """The driver's reads follow the number of files, not their size; a file in another journal's folder is refused."""
    folder = tmp_path / JOURNAL.hex()
    folder.mkdir()
    big = record(2, payload=b"x" * 300_000)
    for k in range(6):
        (folder / f"seg-{k:08d}").write_bytes(file_of(record(1) if k == 0 else record(1) | {"prev_slot_hash": b"p" * 32}, *[big] * 3, sealed=True))
    seen = []
    real = segment.store_of

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def get_file_info(self, x):
            return self.inner.get_file_info(x)

        def open_input_file(self, path):
            raw = self.inner.open_input_file(path)
            outer = self

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    raw.close()

                def read(self, n=None):
                    got = raw.read(n)
                    seen.append(len(got))
                    return got

            return File()

    monkeypatch.setattr(segment, "store_of", lambda p: (Counting(real(p)[0]), real(p)[1]))
    assert len(segment.SegmentReader(str(tmp_path), False).partitions()) == 6
    assert sum(seen) == 6 * segment.FIRST_BYTES
    (folder / "seg-00000006").write_bytes(segment.encode_segment(b"z" * 16, bytes(32), segment.encode_record(record(1)), True))
    with pytest.raises(segment.SegmentError, match="wrong_journal"):
        segment.SegmentReader(str(tmp_path), False).partitions()


def test_queue_files_as_a_table(spark, tmp_path):
    (tmp_path / "queue-1").write_bytes(segment.encode_queue([record(1), record(2)]))
    (tmp_path / "queue-2").write_bytes(segment.encode_queue([record(3)])[:-3])
    rows = segment.read_queue(spark, str(tmp_path)).collect()
    assert sorted((r["author_seq"], r["arrival"], bytes(r["payload"])) for r in rows) == [(1, 0, b"hello"), (2, 1, b"hello")]


def test_the_control_chain_of_a_folder(spark, tmp_path):
    """Written as segments, read back, folded: members, journals and what the doctor sees."""
    from tests.test_rules import GENESIS, control_rows, join, member

    steps = [GENESIS, ("join", 1, join(2)), ("join", 1, join(3)), ("join", 1, join(3)), ("create_journal", 1, {"journal": b"j" * 16, "name": "one", "changes": []}), ("leave", 1, {"member": member(2)})]
    rows, prev = [], bytes(32)
    for r in control_rows(*steps):
        out = dict(zip(segment.ROW_NAMES, [r["entry_journal"], r["epoch"], r["seq"], r["slot_ts_ms"], r["kind"], r["author"], r["author_seq"], 0, 0, r["payload"], len(r["payload"]), hashlib.sha256(r["payload"]).digest(), False, b"", prev, r["slot_leader"], bytes(64), bytes(64)]))
        out["entry_hash"] = hashlib.sha256(segment.entry_header(out)).digest()
        prev = hashlib.sha256(segment.slot_bytes(out)).digest()
        rows.append(tuple(bytearray(v) if isinstance(v, bytes) else v for v in out.values()))
    from chainlake.schema import SLOT_ROW

    segment.write_segments(spark.createDataFrame(rows, SLOT_ROW), str(tmp_path))
    listed = cli.run(spark, ["members", "--data", str(tmp_path)]).collect()
    assert {(r["member"], r["address"], r["seniority"], r["is_leader"]) for r in listed} == {(member(1).hex(), "", 1, True), (member(3).hex(), "h3", 2, False)}
    assert [(r["name"], r["journal"]) for r in cli.run(spark, ["journals", "--data", str(tmp_path)]).collect()] == [("one", (b"j" * 16).hex())]
    doctor = {r["item"]: r["value"] for r in cli.run(spark, ["doctor", "--data", str(tmp_path)]).collect()}
    assert doctor["members"] == "2" and doctor["epoch"] == "1"
