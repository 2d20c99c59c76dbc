"""The registered queries of the engine, each with its SQL for the oracle where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ed25519, scalar
from ..operators import chain, control, election, expiry, membership, merge, reads, settings, storage, writing
from ..schema import FRAMES, ID, PAGE_BYTES, SLOT_ROW
from ..shipping import ship
from ..sources import segment
from ..streaming import live
from . import fixture as fx
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


PICK = ["journal", "epoch", "seq", "slot_ts_ms", "kind", "author", "author_seq"]
PICKED = ", ".join(PICK)


# --- reads --------------------------------------------------------------------------------------------------------


@query(o.query(o.SLOTS, select=f"SELECT {PICKED}, payload FROM slots WHERE epoch * 1000000 + seq BETWEEN 1000020 AND 2000060"))
def read_range(spark, sf_dir):
    return reads.read(fx.slots(spark, sf_dir), first=(1, 20), last=(2, 60)).select(*PICK, "payload")


@query(o.query(o.SLOTS, select=f"SELECT {PICKED} FROM slots WHERE author = 7"))
def read_by_author(spark, sf_dir):
    return reads.read(fx.slots(spark, sf_dir), author=7).select(*PICK)


@query(o.query(o.SLOTS, select=f"SELECT {PICKED} FROM slots WHERE kind = 'stale' AND journal = 'j3'"))
def read_by_kind(spark, sf_dir):
    return reads.read(fx.slots(spark, sf_dir), journal="j3", kind="stale").select(*PICK)


@query(o.query(o.SLOTS, select=f"SELECT {PICKED} FROM slots WHERE author_seq = 3 AND author % 2 = 0"))
def read_by_id(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    return reads.read_by_ids(s, s.where("author_seq = 3 and author % 2 = 0").select(*ID)).select(*PICK)


@query(o.query(o.SLOTS, select=f"SELECT {PICKED} FROM slots WHERE slot_ts_ms BETWEEN 1704500000000 AND {fx.MID}"))
def read_by_time(spark, sf_dir):
    return reads.read(fx.slots(spark, sf_dir), since_ms=1704500000000, until_ms=fx.MID).select(*PICK)


@query(o.query(o.SLOTS, select="SELECT journal, epoch, seq, slot_hash FROM slots QUALIFY row_number() OVER (PARTITION BY journal ORDER BY epoch DESC, seq DESC) = 1"))
def head(spark, sf_dir):
    return reads.heads(fx.slots(spark, sf_dir), "slot_hash")


@query(o.query(o.SLOTS, select=f"SELECT {PICKED} FROM slots WHERE journal = 'j1' AND epoch * 1000000 + seq > 1000010 ORDER BY epoch, seq LIMIT 25"))
def keyset_page(spark, sf_dir):
    return reads.page_after(fx.slots(spark, sf_dir).select(*PICK), "j1", (1, 10), 25)


@query(o.query(o.SLOTS, select="SELECT journal, min_by(kind, epoch * 1000000000 + seq) AS kind FROM slots GROUP BY journal"))
def first_record_kind(spark, sf_dir):
    return reads.first_kinds(fx.slots(spark, sf_dir))


@query(o.query(o.SLOTS, select="SELECT journal, count(*) AS n_slots, count(kind) AS n_entries FROM slots GROUP BY journal"))
def journals(spark, sf_dir):
    return reads.journals(fx.slots(spark, sf_dir))


def _names(spark, sf_dir):
    n = fx.load(spark, sf_dir, "customer")
    return n.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), (1 + F.col("c_nationkey") % 3).cast("bigint").alias("created_epoch"), F.col("c_custkey").alias("created_seq"), (F.col("c_custkey") == 1).alias("is_control"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey <> 1 AND c_mktsegment = 'BUILDING' ORDER BY 1 + c_nationkey % 3, c_custkey LIMIT 1")
def journal_by_name(spark, sf_dir):
    return reads.journal_by_name(_names(spark, sf_dir), "BUILDING")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey = 1")
def control_journal_by_name(spark, sf_dir):
    """The control journal has a name of its own."""
    return reads.journal_by_name(_names(spark, sf_dir), "__cluster__")


@query(o.query(o.SLOTS, select="SELECT journal, epoch || ':' || seq AS pos, author || ':' || author_seq AS id, kind, payload FROM slots WHERE journal = 'j1'"))
def cli_projection(spark, sf_dir):
    return reads.projection(reads.scan(fx.slots(spark, sf_dir), "j1"))


# --- settings -----------------------------------------------------------------------------------------------------


_JOURNAL_KEYS = ", ".join(f"('{s[0]}', '{s[3]}')" for s in settings.SETTINGS if s[1] == "journal")
_CHANGES = """
ch AS (SELECT journal, epoch, seq, unnest([{'key': 'ttl.enforce', 'value': c_enforce}, {'key': 'ttl.default_ms', 'value': CAST(c_default AS VARCHAR)}, {'key': 'ttl.max_ms', 'value': CAST(c_max AS VARCHAR)},
  {'key': 'ttl.action', 'value': c_action}, {'key': 'ttl.grace_ms', 'value': CAST(c_grace AS VARCHAR)}, {'key': 'stale.enforce', 'value': c_stale}, {'key': 'stale.cleanup', 'value': c_cleanup}]) AS c FROM wide WHERE s),
changes AS (SELECT journal, epoch, seq, c.key AS key, c.value AS value FROM ch WHERE c.value IS NOT NULL)"""


@query(o.query(o.SLOTS, o.WIDE, _CHANGES, f"keys(key, dflt) AS (VALUES {_JOURNAL_KEYS})", "last AS (SELECT journal, key, max_by(value, epoch * 1000000000 + seq) AS v FROM changes GROUP BY ALL)", select="SELECT j.journal, k.key, coalesce(v, dflt) AS value FROM (SELECT DISTINCT journal FROM slots) j CROSS JOIN keys k LEFT JOIN last l ON l.journal = j.journal AND l.key = k.key"))
def settings_current(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    return settings.current(fx.changes(s), s.select("journal").distinct())


@query(o.query(o.SLOTS, o.WIDE, select=f"SELECT journal, epoch, seq, ttl_enforce, CAST(ttl_default_ms AS BIGINT) AS ttl_default_ms, CAST(ttl_max_ms AS BIGINT) AS ttl_max_ms, ttl_action, stale_enforce, stale_cleanup FROM {o.CURRENT}"))
def settings_as_of(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    at = settings.at_positions(s, fx.changes(s), fx.KEYS)
    return at.select("journal", "epoch", "seq", "ttl_enforce", F.col("ttl_default_ms").cast("bigint"), F.col("ttl_max_ms").cast("bigint"), "ttl_action", "stale_enforce", "stale_cleanup")


_SCHEMA_ROWS = ", ".join(f"({i}, '{k}', '{scope}', '{kind}', '{default}', '{','.join(allowed)}', '{rule}')" for i, (k, scope, kind, default, allowed, rule) in enumerate(settings.SETTINGS))


@query(f"SELECT CAST(key_index AS BIGINT) AS key_index, key, scope, value_type, \"default\", allowed, live_rule FROM (VALUES {_SCHEMA_ROWS}) t(key_index, key, scope, value_type, \"default\", allowed, live_rule)")
def settings_schema(spark, sf_dir):
    return settings.schema_table(spark)


@query(f"SELECT CAST(key_index AS BIGINT) AS key_index, '| ' || concat_ws(' | ', key, scope, value_type, CASE WHEN allowed = '' THEN '-' ELSE allowed END, CASE WHEN dflt = '' THEN '(empty)' ELSE dflt END, live_rule) || ' |' AS line FROM (VALUES {_SCHEMA_ROWS}) t(key_index, key, scope, value_type, dflt, allowed, live_rule)")
def settings_markdown(spark, sf_dir):
    return settings.schema_markdown(spark)


@query(o.query(o.SLOTS, o.WIDE, _CHANGES, select="SELECT c.journal, c.epoch, c.seq, bool_or(key LIKE 'leadership.%') OR any_value(author % 3 = 0) AS touches FROM changes c JOIN slots s ON s.journal = c.journal AND s.epoch = c.epoch AND s.seq = c.seq GROUP BY ALL"))
def settings_touch_leadership(spark, sf_dir):
    """Every third author's records change the tiebreak too."""
    s = fx.slots(spark, sf_dir)
    more = s.where("kind = 'settings' and author % 3 = 0").select("journal", "epoch", "seq", F.lit("leadership.tiebreak").alias("key"), F.lit("freshest").alias("value"))
    return settings.touches_leadership(fx.changes(s).union(more))


@query(o.query(o.SLOTS, o.WIDE, _CHANGES, select="SELECT journal, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM (SELECT journal, key || '=' || max_by(value, epoch * 1000000000 + seq) AS line FROM changes GROUP BY journal, key) GROUP BY journal"))
def settings_hash(spark, sf_dir):
    last = fx.changes(fx.slots(spark, sf_dir)).groupBy("journal", "key").agg(F.max_by("value", scalar.position()).alias("value"))
    return settings.state_hash(last, ["journal"])


@query(o.query(o.SLOTS, o.WIDE, _CHANGES, "l AS (SELECT journal, key, max_by(value, epoch * 1000000000 + seq) AS value FROM changes GROUP BY ALL)", "a AS (SELECT key, value FROM l WHERE journal = 'j1')", "b AS (SELECT key, value FROM l WHERE journal = 'j2')", select="SELECT key, a.value AS local, b.value AS folded FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value"))
def settings_drift(spark, sf_dir):
    last = fx.changes(fx.slots(spark, sf_dir)).groupBy("journal", "key").agg(F.max_by("value", scalar.position()).alias("value"))
    return settings.drift(last.where("journal = 'j1'"), last.where("journal = 'j2'"))


@query(o.query("c AS (SELECT c_custkey AS id, c_custkey % 3 AS m, c_custkey % 2 AS f, c_nationkey % 4 AS na, c_custkey % 5 AS n, c_custkey % 7 AS d, c_custkey % 11 AS x FROM customer)", select="""
SELECT id, CASE WHEN n = 1 AND d = 0 THEN 'ttl_enforce_all_needs_default'
  WHEN na = 0 AND NOT (m = 0 OR f = 0 OR n <= 1) THEN 'empty_authorities_needs_fallback'
  WHEN na = 2 AND x = 1 THEN 'empty_authority_entry'
  WHEN na = 2 AND x = 2 THEN 'authority_entry_too_long'
  WHEN na > 0 AND x <> 3 AND NOT (m = 0 OR f = 0 OR n <= 1) THEN 'authorities_match_no_member'
  WHEN x = 4 THEN 'max_entry_bytes_exceeds_frame_cap' END AS error FROM c"""))
def settings_validate(spark, sf_dir):
    key = F.col("c_custkey")
    c = fx.load(spark, sf_dir, "customer").withColumn("na", F.col("c_nationkey") % 4).withColumn("n", key % 5).withColumn("x", key % 11)
    second = F.when(F.col("x") == 1, F.lit("")).when(F.col("x") == 2, F.repeat(F.lit("a"), 257)).otherwise("host-2:7000")
    names = F.when(F.col("na") == 0, F.array().cast("array<string>")).when(F.col("na") == 2, F.array(F.lit("host-1:7000"), second)).otherwise(F.array(F.lit("host-1:7000")))
    error = settings.state_error(
        F.when(F.col("n") == 1, "all").otherwise("off"), key % 7, F.when(key % 3 == 0, "seniority").otherwise("configured"), F.when(key % 2 == 0, "seniority").otherwise("stall"),
        names, F.col("n"), F.col("x") == 3, F.when(F.col("x") == 4, 17 * 1024 * 1024).otherwise(1000),
    )
    return c.select(key.alias("id"), error.alias("error"))


@query(o.query("c AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS reconf, CASE c_custkey % 3 WHEN 0 THEN 'leadership.mode' WHEN 1 THEN 'leadership.reconfigurable' ELSE 'ttl.enforce' END AS key FROM customer)", select="SELECT id, key, CASE WHEN key LIKE 'leadership.%' THEN reconf ELSE true END AS allowed FROM c"))
def settings_live_gate(spark, sf_dir):
    key = F.col("c_custkey")
    c = fx.load(spark, sf_dir, "customer").select(key.alias("id"), (key % 2 == 0).alias("reconf"), F.when(key % 3 == 0, "leadership.mode").when(key % 3 == 1, "leadership.reconfigurable").otherwise("ttl.enforce").alias("key"))
    return c.select("id", "key", settings.live_changeable(F.col("key"), F.lit(""), F.col("reconf")).alias("allowed"))


_OWN = {"ttl.enforce": ("c_enforce", "'off'"), "ttl.default_ms": ("CASE WHEN author % 2 = 0 THEN 0 ELSE c_default END", "0"), "ttl.max_ms": ("c_max", "0"), "ttl.action": ("c_action", "'mark_stale'"), "ttl.grace_ms": ("c_grace", "0"), "stale.enforce": ("c_stale", "'off'"), "stale.cleanup": ("c_cleanup", "'keep'")}
_STATE = " || chr(10) || ".join(f"'{k}=' || " + (f"CAST(coalesce(last_value(CASE WHEN NOT bad THEN {_OWN[k][0]} END IGNORE NULLS) OVER w, {_OWN[k][1]}) AS VARCHAR)" if k in _OWN else f"'{v}'") for k, v in sorted(settings.DEFAULTS.items()))


@query(o.query(o.SLOTS, o.WIDE, "rec AS (SELECT *, c_enforce = 'all' AND author % 2 = 0 AS bad FROM wide WHERE s)", select=f"SELECT journal, epoch, seq, CASE WHEN bad THEN 'invalid_settings' END AS refusal, sha256({_STATE}) AS hash FROM rec WINDOW w AS (PARTITION BY journal ORDER BY epoch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def settings_replay(spark, sf_dir):
    """Every settings record applied or refused in sequence; records that ask for all without a default are refused."""
    s = fx.slots(spark, sf_dir)
    own = fx.changes(s).join(s.select("journal", "epoch", "seq", "author"), ["journal", "epoch", "seq"])
    own = own.withColumn("value", F.when((F.col("key") == "ttl.default_ms") & (F.col("author") % 2 == 0), "0").otherwise(F.col("value")))
    grouped = own.groupBy("journal", "epoch", "seq").agg(F.collect_list(F.struct("key", "value")).alias("changes"))
    return settings.replay(grouped.select("*", F.lit(False).alias("is_genesis"), F.lit(3).alias("n_members"), F.array(F.lit("host-1")).alias("names"), F.lit("journal").alias("scope")))


# --- expiry -------------------------------------------------------------------------------------------------------


@query(o.query(o.SLOTS, o.WIDE, o.FORCE, o.STAMPED, select="SELECT journal, epoch, seq, effective_ttl_ms, expires_at_ms, ttl_action FROM st"))
def effective_ttl(spark, sf_dir):
    return expiry.stamped(fx.in_force(spark, sf_dir)).select("journal", "epoch", "seq", "effective_ttl_ms", "expires_at_ms", "ttl_action")


@query(o.query(o.SLOTS, o.WIDE, o.FORCE, o.STAMPED, o.MARKS, select="SELECT journal, author, author_seq, mark // 1000000000 AS stale_epoch, mark % 1000000000 AS stale_seq FROM marks"))
def stale_marks(spark, sf_dir):
    return expiry.stale_marks(fx.in_force(spark, sf_dir))


@query(o.query(*o.ALL_FACTS[:6], select="SELECT journal, author, author_seq, epoch, seq, expires_at_ms, ttl_action, stale_marked, stale_epoch, stale_seq FROM info"))
def entry_info(spark, sf_dir):
    _, info, _ = fx.facts(spark, sf_dir)
    return info.select(*ID, "epoch", "seq", "expires_at_ms", "ttl_action", "stale_marked", "stale_epoch", "stale_seq")


@query(o.query(*o.ALL_FACTS, select="SELECT journal, author, author_seq, by_mark // 1000000000 AS removed_epoch, by_mark % 1000000000 AS removed_seq FROM removed"))
def removal_set(spark, sf_dir):
    return fx.facts(spark, sf_dir)[2]


def _states(spark, sf_dir, now):
    """The stamped slots, and the state of every entry at a time."""
    stamped, info, gone = fx.facts(spark, sf_dir)
    s = settings.current(fx.changes(stamped), stamped.select("journal").distinct()).where("key = 'ttl.grace_ms'").select("journal", F.col("value").cast("bigint").alias("grace"))
    rows = info.join(gone, ID, "left").join(s, "journal").withColumn("removed", F.col("removed_epoch").isNotNull())
    state = expiry.state(F.col("removed"), F.col("expires_at_ms"), F.col("ttl_action"), F.col("stale_marked"), F.lit(now), F.col("grace"))
    return stamped, rows.withColumn("state", state)


@query(o.query(*o.ALL_FACTS, o.with_state(fx.MID), select="SELECT journal, author, author_seq, kind, state FROM state"))
def entry_state(spark, sf_dir):
    return _states(spark, sf_dir, fx.MID)[1].select(*ID, "kind", "state")


@query(o.query(*o.ALL_FACTS, o.with_state(fx.MID), select="SELECT s.journal, s.epoch, s.seq, s.kind, s.author, s.author_seq, s.payload, state FROM slots s JOIN state USING (journal, author, author_seq) WHERE state IN ('live', 'stale') AND s.epoch * 1000000 + s.seq BETWEEN 1000005 AND 3000030"))
def visible_read(spark, sf_dir):
    """A range read with stale entries, without expired and removed ones."""
    stamped, states = _states(spark, sf_dir, fx.MID)
    rows = reads.read(stamped, first=(1, 5), last=(3, 30)).select("journal", "epoch", "seq", "kind", "author", "author_seq", "payload")
    return rows.join(states.where(expiry.visible(F.col("state"), include_stale=True)).select(*ID, "state"), ID)


@query(o.query(*o.ALL_FACTS, o.with_state(fx.END), select="SELECT journal, state, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS bytes FROM state GROUP BY ALL"))
def state_counts(spark, sf_dir):
    return _states(spark, sf_dir, fx.END)[1].groupBy("journal", "state").agg(F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


@query(o.query(*o.ALL_FACTS, select=f"SELECT journal, CAST(sum(payload_len) AS BIGINT) AS pending_bytes, count(*) AS n FROM info LEFT JOIN removed USING (journal, author, author_seq) WHERE by_mark IS NULL AND ((ttl_action = 'delete' AND expires_at_ms <= {fx.END}) OR stale_marked OR (ttl_action = 'mark_stale' AND expires_at_ms <= {fx.END})) GROUP BY journal"))
def pending_bytes(spark, sf_dir):
    _, info, gone = fx.facts(spark, sf_dir)
    rows = info.join(gone, ID, "left").withColumn("removed", F.col("removed_epoch").isNotNull())
    return expiry.pending_bytes(expiry.removal_set(rows, (1000, 0), fx.END, "delete"))


@query(o.query(*o.ALL_FACTS[:6], select="SELECT journal, bool_or(expires_at_ms IS NOT NULL AND ttl_action = 'delete') AS may_expire_delete, bool_or((expires_at_ms IS NOT NULL AND ttl_action = 'mark_stale') OR stale_marked) AS may_remove_stale FROM info GROUP BY journal"))
def may_remove(spark, sf_dir):
    return expiry.may_remove(fx.facts(spark, sf_dir)[1])


_PENDING = f"pend AS (SELECT journal, CAST(sum(payload_len) AS BIGINT) AS pending FROM info LEFT JOIN removed USING (journal, author, author_seq) WHERE by_mark IS NULL AND ((ttl_action = 'delete' AND expires_at_ms <= {fx.END}) OR stale_marked OR (ttl_action = 'mark_stale' AND expires_at_ms <= {fx.END})) GROUP BY journal)"


@query(o.query(*o.ALL_FACTS, _PENDING, select="SELECT journal, max(slot_ts_ms) AS last_ms, coalesce(max(pending), 0) AS pending, (1706600000000 - max(slot_ts_ms) >= 86400000) OR coalesce(max(pending), 0) >= 700 AS due FROM st LEFT JOIN pend USING (journal) WHERE kind = 'checkpoint' GROUP BY journal"))
def checkpoint_cadence(spark, sf_dir):
    """Whether each journal's next checkpoint is due: a day after the last, or when 700 bytes could be removed."""
    stamped, info, gone = fx.facts(spark, sf_dir)
    c = stamped.where("kind = 'checkpoint'").groupBy("journal").agg(F.max("slot_ts_ms").alias("last_ms"))
    rows = info.join(gone, ID, "left").withColumn("removed", F.col("removed_epoch").isNotNull())
    waiting = expiry.pending_bytes(expiry.removal_set(rows, (1000, 0), fx.END, "delete"))
    c = c.join(waiting, "journal", "left").withColumn("pending", F.coalesce("pending_bytes", F.lit(0)))
    return c.select("journal", "last_ms", "pending", expiry.checkpoint_due(F.lit(1706600000000), F.col("last_ms"), F.lit(86400000), F.col("pending"), F.lit(700)).alias("due"))


_CHK = """
chk0 AS (SELECT journal, epoch, seq, slot_ts_ms, stale_cleanup, author % 3 AS a, greatest(seq - author_seq % 50, 0) + CASE WHEN author_seq % 11 = 5 THEN seq + 1 ELSE 0 END AS through_seq FROM occ0 WHERE kind = 'checkpoint'),
chk1 AS (SELECT *, epoch * 1000000000 + through_seq AS through, CASE WHEN a <> epoch % 3 AND epoch < 5 THEN 'no_op' WHEN through_seq > seq THEN 'bad_checkpoint' WHEN slot_ts_ms < 1705500000000 THEN 'no_op' WHEN slot_ts_ms < 1705500000000 + 120000000 THEN 'merge_settling' ELSE 'apply' END AS verdict FROM chk0),
chk AS (SELECT * FROM chk1 WHERE verdict = 'apply')"""


def _again(spark, sf_dir):
    """Slots of which some come again, their occurrences, and the checkpoints with their verdicts."""
    s = fx.slotted_again(spark, sf_dir)
    through = F.greatest(F.col("seq") - F.col("author_seq") % 50, F.lit(0)) + F.when(F.col("author_seq") % 11 == 5, F.col("seq") + 1).otherwise(0)
    led = F.when(F.col("epoch") == 5, 0).otherwise(F.col("author") % 3)
    c = s.where("kind = 'checkpoint'").select("journal", "epoch", "seq", "slot_ts_ms", "stale_cleanup", led.alias("author"), F.col("epoch").alias("through_epoch"), through.alias("through_seq"))
    terms = s.select("epoch").distinct().withColumn("leader", F.when(F.col("epoch") == 5, 0).otherwise(F.col("epoch") % 3))
    merges = spark.range(1).select(F.lit(1705500000000).alias("merge_ts_ms"))
    return s, expiry.occurrences(s, expiry.stale_marks(s)), expiry.checkpoint_verdicts(c, terms, merges, 120000000)


@query(o.query(*o.AGAIN_FACTS, _CHK, select="SELECT journal, epoch, seq, verdict FROM chk1"))
def checkpoint_verdicts(spark, sf_dir):
    """Which checkpoints apply: by their author's term, how far they reach, and the last merge."""
    return _again(spark, sf_dir)[2].select("journal", "epoch", "seq", "verdict")


@query(o.query(*o.AGAIN_FACTS, _CHK, o.AGAIN_REMOVED, select="SELECT journal, author, author_seq, by_mark // 1000000000 AS removed_epoch, by_mark % 1000000000 AS removed_seq FROM gone"))
def redelivered_removals(spark, sf_dir):
    """What checkpoints that count remove, where entries are slotted again with a new stamp."""
    _, occurrences, checkpoints = _again(spark, sf_dir)
    return expiry.removals(occurrences, checkpoints.where("verdict = 'apply'"))


@query(o.query(*o.AGAIN_FACTS, _CHK, o.AGAIN_REMOVED, select=f"SELECT journal, author, author_seq, epoch, seq, CASE WHEN by_mark IS NOT NULL THEN 'removed' WHEN marked_at IS NOT NULL OR (ttl_action = 'mark_stale' AND coalesce(expires_at_ms <= {fx.END + 30 * fx.HOUR}, false)) THEN 'stale' WHEN ttl_action = 'delete' AND coalesce(expires_at_ms <= {fx.END + 30 * fx.HOUR}, false) THEN 'expired' ELSE 'live' END AS state FROM occ LEFT JOIN gone USING (journal, author, author_seq) WHERE until IS NULL"))
def redelivered_states(spark, sf_dir):
    """The state of every entry by its last slot; what was removed stays removed."""
    s, occurrences, checkpoints = _again(spark, sf_dir)
    gone = expiry.removals(occurrences, checkpoints.where("verdict = 'apply'"))
    rows = expiry.entry_info(s, expiry.stale_marks(s)).join(gone, ID, "left")
    state = expiry.state(F.col("removed_epoch").isNotNull(), F.col("expires_at_ms"), F.col("ttl_action"), F.col("stale_marked"), F.lit(fx.END + 30 * fx.HOUR), F.lit(0))
    return rows.select(*ID, "epoch", "seq", state.alias("state"))


@query(o.query(*o.ALL_FACTS, o.with_state(fx.MID), select="SELECT s.journal, s.epoch, s.seq, s.kind, s.author, s.author_seq FROM slots s JOIN state USING (journal, author, author_seq) WHERE s.author_seq % 5 = 1 AND state IN ('live', 'expired')"))
def visible_by_id(spark, sf_dir):
    """Entries by id as a reader is given them: none that is removed or stale, but what has only expired."""
    stamped, states = _states(spark, sf_dir, fx.MID)
    asked = stamped.where("author_seq % 5 = 1").select(*ID)
    rows = stamped.select("journal", "epoch", "seq", "kind", "author", "author_seq")
    return reads.read_by_ids(rows, asked, states.where(expiry.visible(F.col("state"), include_expired=True)))


@query(o.query(o.SLOTS, select=f"SELECT {PICKED} FROM slots WHERE journal = 'j2' AND epoch = 2 AND seq = 7"))
def read_point(spark, sf_dir):
    return reads.point(fx.slots(spark, sf_dir), "j2", (2, 7)).select(*PICK)


@query(o.query(o.SLOTS, select="SELECT journal, author, author_seq, event_id AS arrival FROM slots q WHERE event_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM slots s WHERE s.event_id % 8 = 0 AND s.journal = q.journal AND s.author = q.author AND s.author_seq = q.author_seq)"))
def queue_removal(spark, sf_dir):
    """The queue without what has been slotted."""
    s = fx.slots(spark, sf_dir)
    queue = s.where("event_id % 4 = 0").select(*ID, F.col("event_id").alias("arrival"))
    return storage.remove_queued(queue, s.where("event_id % 8 = 0"))


# --- storage ------------------------------------------------------------------------------------------------------


@query(o.query(*o.ALL_FACTS, select="SELECT journal, epoch, seq, kind, author, author_seq, CASE WHEN by_mark IS NULL THEN payload END AS payload, payload_len, by_mark IS NOT NULL AS payload_omitted, CASE WHEN by_mark IS NULL THEN 340 + payload_len ELSE 340 END AS record_bytes FROM slots LEFT JOIN removed USING (journal, author, author_seq)"))
def compact_header(spark, sf_dir):
    stamped, _, gone = fx.facts(spark, sf_dir)
    s = stamped.select("journal", "epoch", "seq", "kind", "author", "author_seq", "payload", "payload_len")
    return storage.compact(s, gone, "header")


@query(o.query(*o.ALL_FACTS, select="SELECT journal, epoch, seq, CASE WHEN by_mark IS NULL THEN kind END AS kind, CASE WHEN by_mark IS NULL THEN author END AS author, CASE WHEN by_mark IS NULL THEN author_seq END AS author_seq, CASE WHEN by_mark IS NULL THEN payload END AS payload, CASE WHEN by_mark IS NULL THEN payload_len END AS payload_len, entry_hash, CASE WHEN by_mark IS NULL THEN 340 + payload_len ELSE 176 END AS record_bytes FROM slots LEFT JOIN removed USING (journal, author, author_seq)"))
def compact_none(spark, sf_dir):
    stamped, _, gone = fx.facts(spark, sf_dir)
    s = stamped.select("journal", "epoch", "seq", "kind", "author", "author_seq", "payload", "payload_len", "entry_hash")
    return storage.compact(s, gone, "none").drop("payload_omitted")


@query(o.query(*o.ALL_FACTS, select="SELECT journal, epoch, seq, CASE WHEN by_mark IS NULL OR journal < 'j4' THEN author_seq END AS author_seq, CASE WHEN by_mark IS NULL THEN payload END AS payload, by_mark IS NOT NULL AND journal < 'j4' AS payload_omitted, CASE WHEN by_mark IS NULL THEN 340 + payload_len WHEN journal < 'j4' THEN 340 ELSE 176 END AS record_bytes FROM slots LEFT JOIN removed USING (journal, author, author_seq)"))
def compact_retained(spark, sf_dir):
    """Each journal compacted as its settings say: the upper four keep nothing of an entry."""
    stamped, _, gone = fx.facts(spark, sf_dir)
    changed = fx.changes(stamped).union(stamped.where("seq = 1 and epoch = 1 and journal >= 'j4'").select("journal", "epoch", "seq", F.lit("ttl.retain").alias("key"), F.lit("none").alias("value")))
    current = settings.current(changed, stamped.select("journal").distinct())
    s = stamped.select("journal", "epoch", "seq", "author", "author_seq", "payload", "payload_len")
    return storage.compact_in_force(s, gone, current).select("journal", "epoch", "seq", "author_seq", "payload", "payload_omitted", "record_bytes")


@query(o.query(o.SLOTS, select=f"SELECT {PICKED} FROM slots WHERE journal <> 'j2' OR (epoch, seq) <= (2, 15)"))
def truncate_prefix(spark, sf_dir):
    return storage.truncate(fx.slots(spark, sf_dir), "j2", (2, 15)).select(*PICK)


@query(
    o.query(
        o.SLOTS,
        "q AS (SELECT journal, event_id AS arrival, payload_len + 172 AS size, row_number() OVER (PARTITION BY journal ORDER BY event_id) AS n FROM slots WHERE epoch = 3)",
        "g AS (SELECT journal, arrival, n, CASE WHEN size <= 5000 THEN size ELSE 0 END AS used, size <= 5000 AS accepted FROM q WHERE n = 1 UNION ALL SELECT q.journal, q.arrival, q.n, CASE WHEN g.used + q.size <= 5000 THEN g.used + q.size ELSE g.used END, g.used + q.size <= 5000 FROM g JOIN q ON q.journal = g.journal AND q.n = g.n + 1)",
        select="SELECT journal, arrival, accepted, used AS queued_bytes FROM g",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def queue_gate(spark, sf_dir):
    q = fx.slots(spark, sf_dir).where("epoch = 3").select("journal", F.col("event_id").alias("arrival"), "payload_len")
    return storage.queue_gate(q, 5000)


@query(o.query(o.SLOTS, select="SELECT journal, author, author_seq, event_id AS arrival FROM slots q WHERE event_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM slots s WHERE s.epoch <= 2 AND s.journal = q.journal AND s.author = q.author AND s.author_seq = q.author_seq)"))
def queue_replay(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    return storage.unslotted(s.where("event_id % 4 = 0").select(*ID, F.col("event_id").alias("arrival")), s.where("epoch <= 2").select(*ID, "kind"))


@query(
    o.query(
        o.SLOTS,
        "g AS (SELECT journal, epoch, seq, payload_len + 340 AS used, CAST(0 AS BIGINT) AS page FROM slots WHERE seq = 1 UNION ALL SELECT s.journal, s.epoch, s.seq, CASE WHEN g.used + s.payload_len + 340 <= 4096 THEN g.used + s.payload_len + 340 ELSE s.payload_len + 340 END, CASE WHEN g.used + s.payload_len + 340 <= 4096 THEN g.page ELSE g.page + 1 END FROM g JOIN slots s ON s.journal = g.journal AND s.epoch = g.epoch AND s.seq = g.seq + 1)",
        select="SELECT journal, epoch, seq, page FROM g",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def page_bytes(spark, sf_dir):
    """Pages of at most 4 KiB: a greedy cut."""
    s = fx.slots(spark, sf_dir).withColumn("record_bytes", F.col("payload_len") + 340)
    return storage.pages(s, 4096)


@query(
    o.query(
        o.SLOTS,
        "b AS (SELECT * FROM slots WHERE (epoch, seq) > (2, 10))",
        "g AS (SELECT journal, epoch, seq, payload_len + 340 AS used, CAST(0 AS BIGINT) AS page FROM b WHERE seq = CASE WHEN epoch = 2 THEN 11 ELSE 1 END UNION ALL SELECT s.journal, s.epoch, s.seq, CASE WHEN g.used + s.payload_len + 340 <= 65536 THEN g.used + s.payload_len + 340 ELSE s.payload_len + 340 END, CASE WHEN g.used + s.payload_len + 340 <= 65536 THEN g.page ELSE g.page + 1 END FROM g JOIN b s ON s.journal = g.journal AND s.epoch = g.epoch AND s.seq = g.seq + 1)",
        select="SELECT journal, epoch, page, count(*) AS n, min(seq) AS first_seq FROM g GROUP BY ALL",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def backfill_pages(spark, sf_dir):
    """What a member that has all up to 2:10 is sent, in pages of 64 KiB."""
    behind = reads.scan(fx.slots(spark, sf_dir), first=(2, 11)).withColumn("record_bytes", F.col("payload_len") + 340)
    return storage.pages(behind, PAGE_BYTES).groupBy("journal", "epoch", "page").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


# --- chain --------------------------------------------------------------------------------------------------------


_BROKEN = """
bad AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 5 THEN repeat('f', 64) ELSE prev_slot_hash END AS prev_slot_hash, CASE WHEN event_id % 89 = 7 THEN slot_ts_ms - 40000000 ELSE slot_ts_ms END AS slot_ts_ms) FROM slots WHERE event_id % 83 <> 11),
cont AS (SELECT *, lag(slot_hash) OVER w AS p_hash, lag(slot_ts_ms) OVER w AS p_ts, lag(epoch) OVER w AS p_epoch, lag(seq) OVER w AS p_seq FROM bad WINDOW w AS (PARTITION BY journal ORDER BY epoch, seq)),
chk AS (SELECT *, CASE WHEN prev_slot_hash <> coalesce(p_hash, repeat('0', 64)) THEN 'bad_prev_hash' WHEN slot_ts_ms < coalesce(p_ts, 0) THEN 'bad_timestamp'
  WHEN NOT (CASE WHEN p_seq IS NULL THEN seq = 1 WHEN epoch = p_epoch THEN seq = p_seq + 1 ELSE epoch > p_epoch AND seq = 1 END) THEN 'bad_position' END AS refusal FROM cont)"""


def _broken(spark, sf_dir):
    s = fx.slots(spark, sf_dir).where("event_id % 83 <> 11")
    return s.withColumn("prev_slot_hash", F.expr("if(event_id % 97 = 5, repeat('f', 64), prev_slot_hash)")).withColumn("slot_ts_ms", F.expr("if(event_id % 89 = 7, slot_ts_ms - 40000000, slot_ts_ms)"))


@query(o.query(o.SLOTS, _BROKEN, select="SELECT journal, epoch, seq, refusal FROM chk WHERE refusal IS NOT NULL"))
def chain_verify(spark, sf_dir):
    return chain.continuity(_broken(spark, sf_dir)).where("refusal is not null").select("journal", "epoch", "seq", "refusal")


_JUDGED = """
v AS (SELECT *, CASE WHEN author % 5 = 2 THEN author_seq - author_seq % 3 ELSE author_seq END AS aseq, CASE WHEN author % 5 = 2 THEN 'h' || CAST(k % 2 AS VARCHAR) ELSE entry_hash END AS eh,
  CASE WHEN event_id % 59 = 0 THEN 'join' ELSE kind END AS knd FROM chk),
r AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN refusal WHEN leader % 13 = 0 THEN 'not_leader' WHEN event_id % 67 = 0 THEN 'bad_signature' WHEN event_id % 61 = 0 THEN 'wrong_journal' WHEN author % 13 = 0 THEN 'unknown_author'
  WHEN event_id % 71 = 0 THEN 'bad_signature' WHEN event_id % 73 = 0 THEN 'bad_payload_hash' END AS b,
  CASE WHEN payload_len > 8 AND k > 95 THEN 'too_large' WHEN knd = 'data' AND k = 50 THEN 'journal_frozen' WHEN knd = 'stale' AND k < 10 THEN 'staleness_disabled' WHEN knd = 'stale' AND event_id % 4 = 0 THEN 'not_author' WHEN knd = 'join' THEN 'wrong_journal_type' END AS a FROM v),
w AS (SELECT *, coalesce(aseq > max(CASE WHEN b IS NULL AND a IS NULL THEN aseq END) OVER (PARTITION BY journal, author ORDER BY epoch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS above FROM r),
x AS (SELECT *, first_value(CASE WHEN b IS NULL AND a IS NULL THEN {'h': eh, 'above': above} END IGNORE NULLS) OVER (PARTITION BY journal, author, aseq ORDER BY epoch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS acc FROM w)"""


@query(o.query(o.SLOTS, _BROKEN, select="SELECT journal, p_epoch AS after_epoch, p_seq AS after_seq, epoch, seq FROM cont WHERE CASE WHEN epoch = p_epoch THEN seq > p_seq + 1 ELSE seq > 1 END"))
def missing_slots(spark, sf_dir):
    return chain.gaps(_broken(spark, sf_dir))


@query(o.query(o.SLOTS, _BROKEN, _JUDGED, select="SELECT journal, epoch, seq, knd AS kind, CASE WHEN b IS NOT NULL THEN b WHEN NOT above AND NOT coalesce(acc.above AND acc.h = eh, false) THEN 'duplicate_conflict' ELSE a END AS refusal FROM x"))
def data_validation(spark, sf_dir):
    """Every rule for a data journal's records; one author in five uses each number for three entries of two contents."""
    s = _broken(spark, sf_dir)
    members = s.select(F.col("author").alias("member")).union(s.select("leader")).where("member % 13 <> 0")
    of = lambda n: F.col("event_id") % n != 0
    twice = F.col("author") % 5 == 2
    s = s.withColumn("entry_hash", F.when(twice, F.concat(F.lit("h"), (F.col("k") % 2).cast("string"))).otherwise(F.col("entry_hash")))
    s = s.withColumn("author_seq", F.when(twice, F.col("author_seq") - F.col("author_seq") % 3).otherwise(F.col("author_seq")))
    s = s.withColumn("allow_append", F.when(F.col("k") == 50, "false").otherwise("true")).withColumn("stale_enforce", F.when(F.col("k") < 10, "off").otherwise("author"))
    s = s.withColumn("target_author", F.when(of(4), F.col("author")).otherwise(F.col("author") + 1)).withColumn("kind", F.when(of(59), F.col("kind")).otherwise("join"))
    s = s.withColumns({"signature_ok": of(71), "payload_ok": of(73), "slot_signature_ok": of(67), "entry_journal": F.when(of(61), F.col("journal")).otherwise("other")})
    most = F.when(F.col("k") > 95, F.lit(8)).otherwise(16777216)
    return chain.first_refusal(s, members, max_entry_bytes=most).select("journal", "epoch", "seq", "kind", "refusal")


@query(o.query(o.SLOTS, select="SELECT journal, author, max(author_seq) AS last_seq, max(author_seq) + 1 AS next_seq FROM slots GROUP BY ALL"))
def author_last_seq(spark, sf_dir):
    return chain.last_seqs(fx.slots(spark, sf_dir))


_TWICE = "twice AS (SELECT journal, author, author_seq, entry_hash FROM slots UNION ALL SELECT journal, author, author_seq, CASE WHEN event_id % 3 = 0 THEN slot_hash ELSE entry_hash END FROM slots WHERE event_id % 10 = 0)"


@query(o.query(o.SLOTS, _TWICE, select="SELECT journal, author, author_seq, count(*) AS n, CASE WHEN min(entry_hash) = max(entry_hash) THEN 'redelivered' ELSE 'duplicate_conflict' END AS verdict FROM twice GROUP BY ALL HAVING count(*) > 1"))
def dedup_conflicts(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    again = s.where("event_id % 10 = 0").withColumn("entry_hash", F.expr("if(event_id % 3 = 0, slot_hash, entry_hash)"))
    return chain.duplicates(s.unionByName(again))


@query("""
WITH j AS (SELECT c_custkey % 60 AS id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS name, c_custkey AS seq FROM customer), old AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey <= 5),
g AS (SELECT id, min(seq) AS first_seq FROM j WHERE length(name) BETWEEN 1 AND 256 AND id NOT IN (SELECT id FROM old) GROUP BY id),
p AS (SELECT *, row_number() OVER (ORDER BY first_seq) + (SELECT count(*) FROM old) <= 20 AS fits FROM g)
SELECT j.seq, j.id, CASE WHEN j.id IN (SELECT id FROM old) OR (fits AND j.seq > first_seq) THEN 'journal_exists' WHEN length(name) NOT BETWEEN 1 AND 256 THEN 'bad_journal_name' WHEN NOT coalesce(fits, false) THEN 'too_many_journals' END AS refusal FROM j LEFT JOIN p USING (id)""")
def create_journal_rules(spark, sf_dir):
    """Creations under a cap of 20 journals, five of which there are."""
    key = F.col("c_custkey")
    rows = fx.load(spark, sf_dir, "customer").select((key % 60).alias("id"), F.when(key % 9 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit(1).alias("epoch"), key.alias("seq"))
    return chain.create_journal_refusal(rows, fx.load(spark, sf_dir, "supplier").where("s_suppkey <= 5").select(F.col("s_suppkey").alias("id")), 20).select("seq", "id", "refusal")


@query(o.query(o.SLOTS, "h AS (SELECT journal, max(slot_ts_ms) AS t, max(seq) FILTER (WHERE epoch = 3) AS s FROM slots GROUP BY journal)", select="SELECT q.journal, q.event_id AS arrival, 3 AS epoch, coalesce(h.s, 0) + row_number() OVER (PARTITION BY q.journal ORDER BY q.event_id) AS seq, greatest(1706000000000, h.t) AS slot_ts_ms FROM slots q JOIN h USING (journal) WHERE q.event_id % 4 = 0"))
def assign_slots(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    queue = s.where("event_id % 4 = 0").select("journal", F.col("event_id").alias("arrival"))
    out = chain.assign(queue, reads.heads(s, "slot_ts_ms"), 1706000000000, 3)
    return out.select("journal", "arrival", F.col("epoch").cast("int").alias("epoch"), F.col("seq").cast("bigint").alias("seq"), "slot_ts_ms")


_PART = "CAST(sum(CAST('0x' || substr(h, {0}, 8) AS BIGINT)) AS BIGINT)"


@query(o.query(o.SLOTS, "x AS (SELECT *, sha256(concat_ws('|', journal, epoch, seq, entry_hash, prev_slot_hash)) AS h FROM slots)", select=f"""
SELECT journal, max(epoch) AS head_epoch, max_by(seq, epoch * 1000000000 + seq) AS head_seq, count(*) AS n_slots, count(*) FILTER (WHERE kind = 'data') AS n_data, count(*) FILTER (WHERE kind <> 'data') AS n_control,
  count(DISTINCT author) AS n_authors, CAST(sum(payload_len) AS BIGINT) AS payload_bytes, concat_ws('-', {', '.join(_PART.format(8 * k + 1) for k in range(3))}) AS digest FROM x GROUP BY journal"""))
def fold_summary(spark, sf_dir):
    return chain.fold_summary(fx.slots(spark, sf_dir))


_LAST_KEYS = "last AS (SELECT journal, key, max_by(value, epoch * 1000000000 + seq) AS v FROM changes GROUP BY ALL)"


@query(o.query(
    o.SLOTS, o.WIDE, _CHANGES, f"keys(key, dflt) AS (VALUES {_JOURNAL_KEYS})", _LAST_KEYS,
    "cur AS (SELECT j.journal, k.key || '=' || coalesce(v, dflt) AS line FROM (SELECT DISTINCT journal FROM slots) j CROSS JOIN keys k LEFT JOIN last l ON l.journal = j.journal AND l.key = k.key)",
    "sh AS (SELECT journal, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM cur GROUP BY journal)",
    "mh AS (SELECT journal, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM (SELECT journal, lpad(CAST(min(epoch) AS VARCHAR), 20, '0') || ':' || lpad(CAST(min(seq) AS VARCHAR), 20, '0') || ':' || author AS line FROM slots WHERE epoch = 1 GROUP BY journal, author) GROUP BY journal)",
    "x AS (SELECT *, sha256(concat_ws('|', journal, epoch, seq, entry_hash, prev_slot_hash)) AS h FROM slots)",
    f"fs AS (SELECT journal, max(epoch) AS he, max_by(seq, epoch * 1000000000 + seq) AS hs, concat_ws('-', {', '.join(_PART.format(8 * k + 1) for k in range(3))}) AS d FROM x GROUP BY journal)",
    select="SELECT fs.journal, sha256(concat_ws('|', he, hs, d, coalesce(sh.h, '-'), coalesce(mh.h, '-'))) AS digest FROM fs LEFT JOIN sh USING (journal) LEFT JOIN mh USING (journal)",
))
def state_digest(spark, sf_dir):
    """Slots, settings and members in one digest; a journal's members are those who wrote in its first term."""
    s = fx.slots(spark, sf_dir)
    current = settings.current(fx.changes(s), s.select("journal").distinct())
    members = s.where("epoch = 1").groupBy("journal", F.col("author").alias("member")).agg(F.min("epoch").alias("joined_epoch"), F.min("seq").alias("joined_seq"))
    return chain.state_digest(chain.fold_summary(s), settings.state_hash(current, ["journal"]), members)


@query(o.query(o.SLOTS, o.EVENTS, select="SELECT 'epoch' AS item, CAST(max(epoch) AS VARCHAR) AS value FROM slots UNION ALL SELECT 'members', CAST(count(*) AS VARCHAR) FROM mem UNION ALL SELECT 'journals', CAST(count(DISTINCT journal) AS VARCHAR) FROM slots UNION ALL SELECT 'head ' || journal, max(epoch) || ':' || max_by(seq, epoch * 1000000000 + seq) FROM slots GROUP BY journal"))
def doctor(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    return chain.doctor(s, membership.members(fx.member_events(spark, sf_dir)), s.select("epoch").distinct())


_LE = "lower(" + " || ".join(f"substr(x, {k}, 2)" for k in range(15, 0, -2)) + ")"


@query(o.query(o.SLOTS, select=f"SELECT journal, epoch, seq, {_LE} AS le, slot_ts_ms AS back, epoch AS pos_epoch, seq AS pos_seq, kind FROM (SELECT *, lpad(to_hex(slot_ts_ms), 16, '0') AS x FROM slots)"))
def scalar_bytes(spark, sf_dir):
    """Little-endian bytes and back, positions as text and back, kinds as codes and back."""
    s = fx.slots(spark, sf_dir)
    le = scalar.le_bytes(F.col("slot_ts_ms"), 8)
    pos = scalar.parse_position(scalar.position_text(F.col("epoch"), F.col("seq")))
    return s.select("journal", "epoch", "seq", scalar.hex_id(le).alias("le"), scalar.from_le_bytes(le).alias("back"), pos["epoch"].alias("pos_epoch"), pos["seq"].alias("pos_seq"), scalar.kind_name(scalar.kind_code(F.col("kind"))).alias("kind"))


# --- membership and election --------------------------------------------------------------------------------------


@query(o.query(o.SLOTS, o.EVENTS, select="SELECT cluster, member, address, epoch AS joined_epoch, seq AS joined_seq FROM mem"))
def members_current(spark, sf_dir):
    return membership.members(fx.member_events(spark, sf_dir))


@query(o.query(o.SLOTS, o.EVENTS, select="SELECT cluster, epoch, seq, member, CASE WHEN what = before THEN CASE what WHEN 'join' THEN 'already_member' ELSE 'bad_leave' END END AS refusal FROM vd"))
def member_verdicts(spark, sf_dir):
    return membership.verdicts(fx.member_events(spark, sf_dir)).select("cluster", "epoch", "seq", "member", "refusal")


@query(o.query(o.SLOTS, o.EVENTS, select="SELECT cluster, member, address, epoch AS joined_epoch, seq AS joined_seq, row_number() OVER (PARTITION BY cluster ORDER BY epoch, seq, member) AS seniority, member = min(member) OVER (PARTITION BY cluster) AS is_leader FROM mem"))
def members_listing(spark, sf_dir):
    m = membership.members(fx.member_events(spark, sf_dir))
    return membership.listing(m, m.groupBy("cluster").agg(F.min("member").alias("leader")))


def _admission_sql(others: str) -> str:
    return f"""
WITH h AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'bad address' ELSE 'host' || c_custkey END AS address, c_custkey % 7 AS s, c_custkey % 17 AS g, c_custkey % 5 AS m, c_mktsegment AS seg FROM customer)
SELECT id, CASE WHEN s = 0 THEN 'not_allowlisted' WHEN id % 11 = 0 THEN 'not_allowlisted' WHEN id = 1 THEN 'none' WHEN g = 3 THEN 'wrong_genesis' WHEN m = 0 THEN 'none' ELSE {others} END AS answer FROM h"""


def _admission(mode: str, most: int):
    def run(spark, sf_dir):
        key = F.col("c_custkey")
        public = lambda k: F.unhex(F.sha2(k.cast("string"), 256))
        c = fx.load(spark, sf_dir, "customer").withColumn("public_key", public(key))
        own = F.substring(F.unhex(F.sha2("public_key", 256)), 1, 16)
        genesis = F.when(key % 17 == 3, F.lit(b"other")).when(key % 2 == 0, F.lit(b"mine"))
        hellos = c.select(key.alias("id"), F.when(key % 7 == 0, F.lit(b"somebody")).otherwise(own).alias("member"), "public_key", F.when(key % 11 == 0, "bad address").otherwise(F.concat(F.lit("host"), key.cast("string"))).alias("address"), genesis.alias("genesis"))
        members = c.where(key % 5 == 0).select(own.alias("member"), "public_key")
        me = bytes.fromhex("6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b")  # SHA-256 of "1"
        return membership.admission(hellos, members, c.where("c_mktsegment = 'BUILDING'").select("public_key"), mode, most, me, b"mine").select("id", "answer")

    return run


for _name, _mode, _most, _sql in (
    ("admission", "allowlist", 1000000, "CASE WHEN seg = 'BUILDING' THEN 'none' ELSE 'not_allowlisted' END"),
    ("admission_open", "open", 1000000, "'none'"),
    ("admission_prompt", "prompt", 1000000, "'prompt_pending'"),
    ("admission_full", "open", 1, "'max_members'"),
):
    QUERIES[_name] = _admission(_mode, _most)
    ORACLE_SQL[_name] = _admission_sql(_sql)


def _elect(mode, tiebreak="seniority", fallback="stall"):
    def run(spark, sf_dir):
        v = election.with_authority(fx.views(spark, sf_dir), fx.authorities(spark, sf_dir))
        return election.elect(v, mode, tiebreak, fallback)

    return run


def _elect_sql(order: str, eligible: str, fallback: bool) -> str:
    pick = f"SELECT cluster, arg_min(member, ROW({order})) FILTER (WHERE state = 'member' AND {eligible}) AS best, arg_min(member, ROW(joined_epoch, joined_seq)) FILTER (WHERE state = 'member') AS senior, count(*) AS n FROM ranked GROUP BY cluster"
    return o.query(o.VIEWS, f"p AS ({pick})", select=f"SELECT cluster, CASE WHEN n = 1 THEN senior ELSE {'coalesce(best, senior)' if fallback else 'best'} END AS leader FROM p")


for _name, _args, _sql in (
    ("elect_seniority", ("seniority",), ("joined_epoch, joined_seq", "true", False)),
    ("elect_configured", ("configured",), ("idx, joined_epoch, joined_seq", "idx IS NOT NULL", False)),
    ("elect_combined", ("combined", "freshest", "seniority"), ("-ack_epoch, -ack_seq, joined_epoch, joined_seq", "idx IS NOT NULL", True)),
):
    QUERIES[_name] = _elect(*_args)
    ORACLE_SQL[_name] = _elect_sql(*_sql)


@query(o.query(o.VIEWS, "b AS (SELECT cluster, min(member) AS leader_a, max(member) AS leader_b FROM views GROUP BY cluster)", "r AS (SELECT cluster, member, coalesce(idx, 2147483647) * 1000000000 + joined_epoch * 10000000 + joined_seq AS r FROM ranked)", select="SELECT b.*, CASE WHEN x.r <= y.r THEN 'a' ELSE 'b' END AS winner FROM b JOIN r x ON x.cluster = b.cluster AND x.member = leader_a JOIN r y ON y.cluster = b.cluster AND y.member = leader_b"))
def survivor(spark, sf_dir):
    v = election.with_authority(fx.views(spark, sf_dir), fx.authorities(spark, sf_dir))
    pairs = v.groupBy("cluster").agg(F.min("member").alias("leader_a"), F.max("member").alias("leader_b"))
    return election.survivors(pairs, v, "configured")


@query(o.query(o.VIEWS, "f AS (SELECT cluster, arg_min(member, ROW(joined_epoch, joined_seq)) FILTER (WHERE state = 'member') AS from_leader FROM views GROUP BY cluster)", "t AS (SELECT cluster, arg_min(member, ROW(idx, joined_epoch, joined_seq)) FILTER (WHERE state = 'member' AND idx IS NOT NULL) AS best, count(*) AS n FROM ranked GROUP BY cluster)", select="SELECT cluster, from_leader, CASE WHEN n = 1 THEN from_leader ELSE best END AS to_leader FROM f JOIN t USING (cluster) WHERE (CASE WHEN n = 1 THEN from_leader ELSE best END) IS NOT NULL AND from_leader IS DISTINCT FROM (CASE WHEN n = 1 THEN from_leader ELSE best END)"))
def handover(spark, sf_dir):
    v = election.with_authority(fx.views(spark, sf_dir), fx.authorities(spark, sf_dir))
    return election.handovers(election.elect(v, "seniority"), election.elect(v, "configured"))


@query(o.query(o.VIEWS, select="SELECT cluster, bool_or(EXISTS (SELECT 1 FROM views v WHERE v.cluster = a.cluster AND v.member % 2 = 0 AND (v.address = a.authority OR v.hex_id = a.authority))) AS resolves FROM auth a GROUP BY cluster"))
def authorities_resolve(spark, sf_dir):
    return settings.resolving(fx.authorities(spark, sf_dir), fx.views(spark, sf_dir).where("member % 2 = 0"))


_TERMS = """
t AS (SELECT journal, epoch, seq, CASE WHEN hash_bad THEN epoch + 1 ELSE epoch END AS number, author, CASE WHEN author % 2 = 0 THEN author ELSE leader END AS slot_leader, CASE WHEN author % 3 = 0 THEN leader ELSE author END AS led FROM (SELECT *, event_id % 5 = 0 AS hash_bad FROM slots WHERE seq = 1)),
tl AS (SELECT *, lag(led) OVER w AS p, lag(number) OVER w AS pn FROM t WINDOW w AS (PARTITION BY journal ORDER BY epoch, seq))"""


@query(o.query(o.SLOTS, _TERMS, select="SELECT journal, epoch, number, led AS leader, CASE WHEN NOT (number = epoch AND (pn IS NULL OR (number = pn + 1 AND CASE WHEN author = p THEN slot_leader = p ELSE author = led AND slot_leader = led END))) THEN 'bad_epoch' END AS refusal FROM tl"))
def terms(spark, sf_dir):
    s = fx.slots(spark, sf_dir).where("seq = 1")
    t = s.select("journal", "epoch", "seq", F.expr("if(event_id % 5 = 0, epoch + 1, epoch)").alias("number"), "author", F.expr("if(author % 2 = 0, author, leader)").alias("slot_leader"), F.expr("if(author % 3 = 0, leader, author)").alias("led"))
    return election.terms(t.withColumnRenamed("led", "leader")).select("journal", "epoch", "number", "leader", "refusal")


@query(o.query(o.SLOTS, "l AS (SELECT journal AS cluster, author AS member, max(slot_ts_ms) AS heard_ms, max_by(epoch, slot_ts_ms * 1000000 + author_seq) AS head_epoch, max_by(author_seq, slot_ts_ms * 1000000 + author_seq) AS head_seq FROM slots GROUP BY ALL)", "m AS (SELECT cluster, max(head_epoch * 1000000000 + head_seq) AS top FROM l GROUP BY cluster)", select=f"SELECT l.cluster, member, heard_ms, head_epoch, head_seq, CASE WHEN {fx.END} - heard_ms >= 86400000 THEN 'lost' WHEN head_epoch * 1000000000 + head_seq < top THEN 'syncing' ELSE 'member' END AS state, {fx.END} - heard_ms >= 604800000 AS evict FROM l JOIN m USING (cluster)"))
def failure_detector(spark, sf_dir):
    return membership.detect(fx.heartbeats(spark, sf_dir), fx.END, 86400000, 604800000)


_FRAMES = ", ".join(f"('{k}', '{v}')" for k, v in FRAMES.items())


@query(f"WITH f(kind, rule) AS (VALUES {_FRAMES}), r(role) AS (VALUES ('operator'), ('member'), ('none')), b(outbound) AS (VALUES (true), (false)) SELECT role, outbound, kind, rule = 'any' OR (rule = 'outbound' AND outbound) OR rule = role AS allowed FROM f, r, b")
def frame_permissions(spark, sf_dir):
    rows = [(r, b, k) for r in ("operator", "member", "none") for b in (True, False) for k in FRAMES]
    return membership.allowed_frames(spark.createDataFrame(rows, "role string, outbound boolean, kind string"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'bad_genesis' WHEN c_custkey % 7 = 0 THEN 'bad_signature' WHEN c_custkey % 11 = 0 THEN 'bad_payload_hash' END AS refusal FROM customer")
def genesis_rules(spark, sf_dir):
    key = F.col("c_custkey")
    founder = F.unhex(F.sha2(key.cast("string"), 256))
    own = F.substring(F.unhex(F.sha2(founder, 256)), 1, 16)
    g = fx.load(spark, sf_dir, "customer").select(
        key.alias("id"), F.lit(1).alias("epoch"), (1 + key % 2).alias("seq"), (key % 3 != 0).alias("is_first"), F.when(key % 5 == 0, F.lit(b"x")).otherwise(own).alias("author"), own.alias("leader"),
        founder.alias("founder_key"), (key % 7 != 0).alias("signature_ok"), (key % 11 != 0).alias("payload_ok"),
    )
    return chain.genesis_refusal(g).select("id", "refusal")


# --- writing ------------------------------------------------------------------------------------------------------


@query(o.query(
    o.SLOTS,
    "q AS (SELECT journal, event_id AS arrival, CASE WHEN journal = 'j7' THEN 'unknown_journal' WHEN journal = 'j3' THEN 'journal_frozen' WHEN payload_len > CASE WHEN journal = 'j5' THEN 8 ELSE 16777216 END THEN 'too_large' END AS refusal FROM slots WHERE event_id % 4 = 0)",
    "h AS (SELECT journal, max(slot_ts_ms) AS t, coalesce(max(seq) FILTER (WHERE epoch = 3), 0) AS s FROM slots GROUP BY journal)",
    select="SELECT journal, arrival, refusal, CASE WHEN refusal IS NULL THEN CAST(3 AS BIGINT) END AS epoch, CASE WHEN refusal IS NULL THEN s + row_number() OVER (PARTITION BY journal, refusal IS NULL ORDER BY arrival) END AS seq, CASE WHEN refusal IS NULL THEN greatest(1706000000000, t) END AS slot_ts_ms FROM q JOIN h USING (journal)",
))
def append_gate(spark, sf_dir):
    """Queued entries with their slots, or why they are refused: an unknown journal, a frozen one, one with a small limit."""
    s = fx.slots(spark, sf_dir)
    queue = s.where("event_id % 4 = 0").select("journal", F.col("event_id").alias("arrival"), "payload_len")
    known = s.where("journal <> 'j7'").select("journal").distinct()
    known = known.select("journal", F.when(F.col("journal") == "j3", "false").otherwise("true").alias("allow_append"), F.when(F.col("journal") == "j5", 8).otherwise(16777216).alias("max_entry_bytes"))
    return writing.append(queue, known, reads.heads(s, "slot_ts_ms"), 1706000000000, 3).select("journal", "arrival", "refusal", "epoch", "seq", "slot_ts_ms")


def _le_hex(value: str) -> str:
    x = f"lpad(to_hex({value}), 16, '0')"
    return "lower(" + " || ".join(f"substr({x}, {k}, 2)" for k in range(15, 0, -2)) + ")"


_LAST = "l AS (SELECT journal, author, max(author_seq) AS last_seq FROM slots GROUP BY ALL)"


@query(o.query(o.SLOTS, _LAST, select=f"SELECT journal, author, last_seq + row_number() OVER (PARTITION BY journal, author ORDER BY author_seq) AS author_seq, 'stale' AS kind, lpad(lower(to_hex(author)), 32, '0') || {_le_hex('author_seq')} AS payload, CAST(24 AS BIGINT) AS payload_len FROM slots JOIN l USING (journal, author) WHERE kind = 'data' AND event_id % 25 = 0"))
def stale_records(spark, sf_dir):
    """The entries by which authors mark every 25th data entry of theirs."""
    s = fx.slots(spark, sf_dir)
    author = F.unhex(F.lpad(F.hex("author"), 32, "0"))
    marks = writing.stale_records(s.where("kind = 'data' and event_id % 25 = 0"), chain.last_seqs(s), author)
    return marks.select("journal", "author", "author_seq", "kind", scalar.hex_id(F.col("payload")).alias("payload"), "payload_len")


@query(o.query(*o.ALL_FACTS, _PENDING, _LAST, "h AS (SELECT journal, max(epoch) AS e, max_by(seq, epoch * 1000000000 + seq) AS s FROM slots GROUP BY journal)", select=f"SELECT journal, 7 AS author, coalesce(last_seq, 0) + 1 AS author_seq, 'checkpoint' AS kind, {_le_hex('e')} || {_le_hex('s')} AS payload, CAST(16 AS BIGINT) AS payload_len FROM pend JOIN h USING (journal) LEFT JOIN l ON l.journal = pend.journal AND l.author = 7 WHERE pending >= 100").replace("SELECT journal, 7", "SELECT pend.journal AS journal, 7"))
def checkpoint_records(spark, sf_dir):
    """The checkpoint of every journal in which at least 100 bytes could be removed."""
    stamped, info, gone = fx.facts(spark, sf_dir)
    known = stamped.select("journal").distinct().select("journal", F.lit("delete").alias("stale_cleanup"), F.lit(0).alias("every_ms"), F.lit(100).alias("threshold"), F.lit(None).cast("bigint").alias("last_ms"))
    rows = info.join(gone, ID, "left").withColumn("removed", F.col("removed_epoch").isNotNull())
    out = writing.checkpoint_records(rows, reads.heads(stamped), known, F.lit(7), chain.last_seqs(stamped), fx.END)
    return out.select("journal", "author", "author_seq", "kind", scalar.hex_id(F.col("payload")).alias("payload"), "payload_len")


@query(o.query(o.SLOTS, _LAST, select="SELECT j.journal, 3 AS author, coalesce(last_seq, 0) + 1 AS author_seq, '01' || lower(substr(sha256(j.journal), 1, 32)) || '0200' || '0c00' || '0100' || '00' || '0f00' || '0800' || lpad(to_hex(CAST(substr(j.journal, 2) AS INTEGER)), 2, '0') || '00000000000000' AS payload FROM (SELECT DISTINCT journal FROM slots) j LEFT JOIN l ON l.journal = j.journal AND l.author = 3"))
def settings_records(spark, sf_dir):
    """The entry that freezes each journal and sets its default time to live."""
    s = fx.slots(spark, sf_dir)
    names = s.select("journal").distinct()
    changes = names.select("journal", F.lit("journal.allow_append").alias("key"), F.lit("false").alias("value")).union(names.select("journal", F.lit("ttl.default_ms"), F.substring("journal", 2, 1)))
    own_id = F.substring(F.unhex(F.sha2(F.col("journal").cast("binary"), 256)), 1, 16)
    rows = writing.settings_records(changes, F.lit(3), chain.last_seqs(s), own_id)
    return rows.select("journal", "author", "author_seq", scalar.hex_id(F.col("payload")).alias("payload"))


@query("SELECT 'c' AS journal, 1 AS author, row_number() OVER (ORDER BY sha256(n_name)) AS author_seq, substr(sha256(n_name), 1, 32) || lpad(lower(to_hex(length(n_name))), 2, '0') || '00' || lower(hex(n_name)) || '0000' AS payload FROM nation")
def create_journal_records(spark, sf_dir):
    """The entries that create a journal for each nation."""
    names = fx.load(spark, sf_dir, "nation").select(F.lit("c").alias("journal"), F.substring(F.unhex(F.sha2(F.col("n_name").cast("binary"), 256)), 1, 16).alias("id"), F.col("n_name").alias("name"))
    none = spark.createDataFrame([], "journal string, author int, last_seq bigint")
    rows = writing.create_journal_records(names, F.lit(1), none)
    return rows.select("journal", "author", "author_seq", scalar.hex_id(F.col("payload")).alias("payload"))


@query("SELECT r_name AS journal, substr(sha256(unhex(sha256(r_name))), 1, 32) AS author, CAST(1 AS BIGINT) AS author_seq, 'genesis' AS kind, sha256(r_name) || '0000' AS payload FROM region")
def genesis_records(spark, sf_dir):
    """The first entry of a cluster for each region."""
    founders = fx.load(spark, sf_dir, "region").select(F.col("r_name").alias("journal"), F.unhex(F.sha2(F.col("r_name").cast("binary"), 256)).alias("founder_key"))
    rows = writing.genesis_records(founders)
    return rows.select("journal", scalar.hex_id(F.col("author")).alias("author"), "author_seq", "kind", scalar.hex_id(F.col("payload")).alias("payload"))


@query(o.query(o.SLOTS, _LAST, "h AS (SELECT journal, max(epoch) AS e, max_by(seq, epoch * 1000000000 + seq) AS s FROM slots WHERE epoch >= 2 AND event_id % 2 = 1 GROUP BY journal)", select=f"SELECT h.journal AS journal, coalesce(last_seq, 0) + 1 AS author_seq, 'merge' AS kind, {_le_hex('e')} || {_le_hex('s')} AS payload FROM h LEFT JOIN l ON l.journal = h.journal AND l.author = 9"))
def merge_markers(spark, sf_dir):
    """The record that opens the merge of each journal's losing branch."""
    s = fx.slots(spark, sf_dir)
    rows = writing.merge_markers(reads.heads(fx.branch(s)), F.lit(9).cast("bigint"), chain.last_seqs(s))
    return rows.select("journal", "author_seq", "kind", scalar.hex_id(F.col("payload")).alias("payload"))


@query(o.query(o.SLOTS, "n AS (SELECT *, row_number() OVER (ORDER BY epoch, seq) AS place FROM slots WHERE journal = 'j1' AND epoch >= 2 AND event_id % 2 = 1)", select="SELECT journal, epoch, seq, author, author_seq, kind FROM slots WHERE journal <> 'j1' OR (epoch, seq) <= (1, 30) UNION ALL SELECT journal, 4, place, author, author_seq, kind FROM n"))
def truncate_and_refold(spark, sf_dir):
    """A journal cut at the common prefix and continued with what was slotted again, in a new term."""
    s = fx.slots(spark, sf_dir)
    again = merge.reslot(s.where("journal = 'j1' and (epoch = 1 and seq <= 30)"), fx.branch(s).where("journal = 'j1'"), 4, 1706700000000)
    columns = ["journal", "epoch", "seq", "author", "author_seq", "kind"]
    return writing.refold(s.select(*columns), "j1", (1, 30), again.select(*columns))


# --- the control chain --------------------------------------------------------------------------------------------


_CONTROL = """
cf AS (SELECT journal, event_type, k, author % 12 AS m, 1 + row_number() OVER (PARTITION BY journal ORDER BY event_id) AS seq FROM slots WHERE event_type IN ('signup', 'error') OR (event_type = 'purchase' AND k < 10)),
mv AS (SELECT *, lag(event_type) OVER (PARTITION BY journal, m ORDER BY seq) AS p FROM cf WHERE event_type = 'error' OR (event_type = 'signup' AND k % 10 <> 9)),
oc AS (SELECT journal, seq, m, k, 'join' AS kind, CASE WHEN p = 'signup' THEN 'already_member' ELSE 'apply' END AS outcome FROM mv WHERE event_type = 'signup'
  UNION ALL SELECT journal, seq, m, k, 'join', 'bad_join' FROM cf WHERE event_type = 'signup' AND k % 10 = 9
  UNION ALL SELECT journal, seq, m, k, 'leave', CASE WHEN coalesce(p, 'error') = 'error' THEN 'bad_leave' ELSE 'apply' END FROM mv WHERE event_type = 'error'
  UNION ALL SELECT journal, seq, m, k, 'create_journal', CASE WHEN row_number() OVER (PARTITION BY journal, k ORDER BY seq) > 1 THEN 'journal_exists' ELSE 'apply' END FROM cf WHERE event_type = 'purchase'
  UNION ALL SELECT DISTINCT journal, 1, -1, 0, 'genesis', 'apply' FROM slots)"""


@query(o.query(o.SLOTS, _CONTROL, select="SELECT journal, seq, kind, outcome, CAST(sum(CASE WHEN outcome <> 'apply' THEN 0 WHEN kind IN ('genesis', 'join') THEN 1 WHEN kind = 'leave' THEN -1 ELSE 0 END) OVER w AS BIGINT) AS n_members, CAST(sum(CASE WHEN outcome = 'apply' AND kind = 'create_journal' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_journals FROM oc WINDOW w AS (PARTITION BY journal ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def control_fold(spark, sf_dir):
    """What every record of eight control chains does, from its stored bytes."""
    return control.fold(fx.control_records(spark, sf_dir)).select(F.col("cluster").alias("journal"), "seq", "kind", "outcome", "n_members", "n_journals")


def _member_sql(m: str) -> str:
    return f"substr(sha256(unhex(sha256(CAST({m} AS VARCHAR)))), 1, 32)"


@query(o.query(o.SLOTS, _CONTROL, "lm AS (SELECT *, row_number() OVER (PARTITION BY journal, m ORDER BY seq DESC) AS r FROM oc WHERE outcome = 'apply' AND kind IN ('genesis', 'join', 'leave'))", select=f"SELECT journal, {_member_sql('m')} AS member, CASE WHEN kind = 'genesis' THEN '' ELSE 'host-' || m END AS address, seq AS joined_seq FROM lm WHERE r = 1 AND kind <> 'leave'"))
def control_members(spark, sf_dir):
    m = control.members(control.fold(fx.control_records(spark, sf_dir)))
    return m.select(F.col("cluster").alias("journal"), scalar.hex_id(F.col("member")).alias("member"), "address", "joined_seq")


@query(o.query(o.SLOTS, _CONTROL, select="SELECT journal, 'name-' || k AS name, seq AS created_seq FROM oc WHERE kind = 'create_journal' AND outcome = 'apply'"))
def control_journals(spark, sf_dir):
    return control.journals(control.fold(fx.control_records(spark, sf_dir))).select(F.col("cluster").alias("journal"), "name", "created_seq")


@query(o.query(o.SLOTS, _CONTROL, "em AS (SELECT *, row_number() OVER (PARTITION BY journal, m ORDER BY seq DESC) AS r FROM oc WHERE outcome = 'apply' AND kind IN ('genesis', 'join', 'leave') AND seq <= 20)", select=f"SELECT journal, {_member_sql('m')} AS member FROM em WHERE r = 1 AND kind <> 'leave'"))
def members_as_of(spark, sf_dir):
    """Who was a member at the twentieth record."""
    m = control.members_as_of(control.fold(fx.control_records(spark, sf_dir)), (1, 20))
    return m.select(F.col("cluster").alias("journal"), scalar.hex_id(F.col("member")).alias("member"))


@query(o.query(o.SLOTS, _TERMS, "okt AS (SELECT journal, epoch, led AS leader FROM tl WHERE number = epoch AND (pn IS NULL OR (number = pn + 1 AND CASE WHEN author = p THEN slot_leader = p ELSE author = led AND slot_leader = led END)))", "top AS (SELECT journal, max(epoch) AS e FROM okt GROUP BY journal)", select="SELECT s.journal, s.epoch, s.seq, okt.leader AS term_leader, s.author = okt.leader AS by_leader, c.leader AS current_leader FROM slots s LEFT JOIN okt ON okt.journal = s.journal AND okt.epoch = s.epoch LEFT JOIN top ON top.journal = s.journal LEFT JOIN okt c ON c.journal = s.journal AND c.epoch = top.e"))
def slot_terms(spark, sf_dir):
    """Every slot with who led its term, whether that is its author, and who leads now."""
    accepted = terms(spark, sf_dir).where("refusal is null").select("journal", "epoch", "leader")
    s = control.with_term_leader(fx.slots(spark, sf_dir).select("journal", "epoch", "seq", "author"), accepted, "journal")
    now = control.current_leaders(accepted, "journal").select("journal", F.col("leader").alias("current_leader"))
    return s.join(now, "journal", "left").select("journal", "epoch", "seq", "term_leader", (F.col("author") == F.col("term_leader")).alias("by_leader"), "current_leader")


@query(o.query(o.SLOTS, o.EVENTS, select="SELECT cluster, epoch, seq, member, what FROM ok"))
def member_reslots(spark, sf_dir):
    """Joins and leaves of a losing branch that change something."""
    return membership.reslotted(fx.member_events(spark, sf_dir)).select("cluster", "epoch", "seq", "member", "what")


@query(o.query(o.SLOTS, o.EVENTS, "p AS (SELECT author AS member, min(k) AS k FROM slots GROUP BY author)", select="SELECT p.member, p.k FROM p WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.member = p.member) AND p.k % 2 = 0"))
def pending_admissions(spark, sf_dir):
    """Who has asked and waits for an operator's word, without those whom it has admitted."""
    s = fx.slots(spark, sf_dir)
    asked = s.groupBy(F.col("author").alias("member")).agg(F.min("k").alias("k"))
    answered = asked.select("member", F.col("k").alias("public_key"), F.lit("h").alias("address"), F.when(F.col("k") % 2 == 0, "prompt_pending").otherwise("none").alias("answer"))
    waiting = membership.pending(answered, membership.members(fx.member_events(spark, sf_dir)))
    return waiting.select("member", F.col("public_key").alias("k"))


# --- merge --------------------------------------------------------------------------------------------------------


_BRANCH = "br AS (SELECT * REPLACE (sha256(slot_hash || 'b') AS slot_hash) FROM slots WHERE epoch >= 2 AND event_id % 2 = 1), sv AS (SELECT * FROM slots WHERE epoch < 2 OR event_id % 2 = 0 OR event_id % 3 = 0)"


@query(o.query(o.SLOTS, _BRANCH, "nw AS (SELECT * FROM br WHERE NOT EXISTS (SELECT 1 FROM sv WHERE sv.journal = br.journal AND sv.author = br.author AND sv.author_seq = br.author_seq))", "hd AS (SELECT journal, max(slot_ts_ms) AS t, max(seq) FILTER (WHERE epoch = 3) AS s FROM sv GROUP BY journal)", select="SELECT nw.journal, author, author_seq, nw.epoch AS branch_epoch, nw.seq AS branch_seq, 3 AS epoch, coalesce(hd.s, 0) + row_number() OVER (PARTITION BY nw.journal ORDER BY nw.epoch, nw.seq) AS seq, greatest(1706700000000, hd.t) AS slot_ts_ms FROM nw JOIN hd USING (journal)"))
def merge_reslot(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    out = merge.reslot(fx.survivor(s), fx.branch(s), 3, 1706700000000)
    return out.select(*ID, "branch_epoch", "branch_seq", F.col("epoch").cast("int").alias("epoch"), "seq", "slot_ts_ms")


@query(o.query(o.SLOTS, _BRANCH, "nw AS (SELECT * FROM br WHERE NOT EXISTS (SELECT 1 FROM sv WHERE sv.journal = br.journal AND sv.author = br.author AND sv.author_seq = br.author_seq))", select="SELECT journal, author, author_seq, CASE WHEN event_type = 'error' THEN 'leave' ELSE kind END AS kind, row_number() OVER (PARTITION BY journal ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, epoch, seq) AS seq FROM nw"))
def merge_reslot_leaves(spark, sf_dir):
    """A branch with leaves among its records: they come last, in a term of their own."""
    s = fx.slots(spark, sf_dir)
    branch = fx.branch(s).withColumn("kind", F.when(F.col("event_type") == "error", "leave").otherwise(F.col("kind")))
    return merge.reslot(fx.survivor(s), branch, 4, 1706700000000).select(*ID, "kind", "seq")


@query(o.query(o.SLOTS, "b AS (SELECT *, CASE WHEN epoch >= 2 AND seq > 10 THEN '' ELSE slot_hash END AS h FROM slots)", "d AS (SELECT journal, min(epoch * 1000000000 + seq) AS cut FROM b WHERE h <> slot_hash GROUP BY journal)", select="SELECT s.journal, count(*) FILTER (WHERE cut IS NULL OR epoch * 1000000000 + seq < cut) AS n_common FROM slots s LEFT JOIN d USING (journal) GROUP BY s.journal"))
def common_prefix(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    return merge.common_prefix(s, s.withColumn("slot_hash", F.expr("if(epoch >= 2 and seq > 10, '', slot_hash)")))


@query(o.query(o.SLOTS, select="SELECT journal, max(seq) AS seq FROM slots WHERE epoch = 2 GROUP BY journal"))
def last_epoch_position(spark, sf_dir):
    return merge.last_in_epoch(fx.slots(spark, sf_dir), 2)


@query(o.query(o.SLOTS, "mg AS (SELECT journal, max(slot_ts_ms) AS m FROM slots WHERE kind = 'settings' AND epoch = 2 GROUP BY journal)", select="SELECT s.journal, epoch, seq, CASE WHEN m IS NULL THEN 'apply' WHEN slot_ts_ms < m THEN 'no_op' WHEN slot_ts_ms < m + 86400000 THEN 'merge_settling' ELSE 'apply' END AS verdict FROM slots s LEFT JOIN mg USING (journal) WHERE kind = 'checkpoint'"))
def merge_settle(spark, sf_dir):
    s = fx.slots(spark, sf_dir)
    m = merge.last_merges(s.where("kind = 'settings' and epoch = 2").withColumn("kind", F.lit("merge")))
    c = s.where("kind = 'checkpoint'").join(m, "journal", "left")
    return c.select("journal", "epoch", "seq", merge.settle_verdict(F.col("slot_ts_ms"), F.col("merge_ts_ms"), F.lit(86400000)).alias("verdict"))


@query(o.query(o.SLOTS, select="SELECT journal, epoch, seq, author <> leader AS no_op FROM slots WHERE kind IN ('settings', 'checkpoint')"))
def reslot_no_ops(spark, sf_dir):
    s = fx.slots(spark, sf_dir).where("kind in ('settings', 'checkpoint')")
    return s.select("journal", "epoch", "seq", merge.is_reslot(F.col("author"), F.col("leader")).alias("no_op"))


# --- streams and files: rows only ---------------------------------------------------------------------------------


def _streamed(spark: SparkSession, rows: DataFrame, name: str, run: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Writes rows, streams them through run() until nothing is left, and returns what came out."""
    folder = fx.work_folder(spark, name)
    rows.write.parquet(f"{folder}/in")
    out = run(live.slots_stream(spark, f"{folder}/in", rows.schema))
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start()
    else:
        q = out.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out/*" if mode != "append" else f"{folder}/out")


@query(o.query(o.SLOTS, select=f"SELECT {PICKED} FROM slots WHERE journal = 'j1' AND (epoch > 1 OR seq >= 10)"))
def follow_stream(spark, sf_dir):
    rows = fx.slots(spark, sf_dir).select(*PICK)
    return _streamed(spark, rows, "follow", lambda s: live.follow(s, "j1", (1, 10)))


@query(o.query(o.SLOTS, select="SELECT journal, author, author_seq, entry_hash FROM slots"))
def dedup_stream(spark, sf_dir):
    s = fx.slots(spark, sf_dir).select(*ID, "entry_hash", "slot_ts_ms")
    return _streamed(spark, s.union(s.where("author_seq % 3 = 0")), "dedup", live.deduplicated).select(*ID, "entry_hash")


@query(o.query(o.SLOTS, o.WIDE, o.FORCE, o.STAMPED, select="SELECT journal, author, author_seq, CASE WHEN ttl_action = 'delete' THEN 'expired' ELSE 'stale' END AS becomes, expires_at_ms + ttl_grace_ms AS at_ms FROM st WHERE expires_at_ms + ttl_grace_ms <= (SELECT max(slot_ts_ms) FROM st)"))
def ttl_timer_stream(spark, sf_dir):
    """What becomes stale or expired, with the grace of its slot, before the last stamp of all."""
    s = expiry.stamped(fx.in_force(spark, sf_dir)).select(*ID, "epoch", "seq", "slot_ts_ms", "expires_at_ms", "ttl_action", F.col("ttl_grace_ms").cast("bigint").alias("grace_ms"))
    return _streamed(spark, s, "ttl", live.expiries)


@query(o.query(o.SLOTS, "h AS (SELECT DISTINCT journal AS cluster, author AS member, slot_ts_ms AS t FROM slots)", "g AS (SELECT *, lag(t) OVER (PARTITION BY cluster, member ORDER BY t) AS p, max(t) OVER (PARTITION BY cluster, member) AS last FROM h)", select="SELECT cluster, member, 'member' AS state, t AS at_ms FROM g WHERE p IS NULL OR t - p >= 86400000 UNION ALL SELECT cluster, member, 'lost', p + 86400000 FROM g WHERE t - p >= 86400000 UNION ALL SELECT cluster, member, 'lost', t + 86400000 FROM g WHERE t = last AND t + 86400000 <= (SELECT max(t) FROM h)"))
def silence_stream(spark, sf_dir):
    """Members as they fall silent for a day and are heard again, and those still silent at the end."""
    h = fx.heartbeats(spark, sf_dir).select("cluster", "member", "heard_ms")
    return _streamed(spark, h, "silence", lambda s: live.silence(s, 86400000), "update")


def binary_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived journals in the binary form, with a real chain of hashes and zero signatures.

    A chain of hashes is produced in sequence: one task a journal, which is given nothing but hashes.
    """
    ship(spark)
    s = fx.slots(spark, sf_dir)
    pad = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 32, "0"))
    payload = F.col("payload").cast("binary")
    rows = s.select(
        F.unhex(F.substring(F.sha2(F.col("journal").cast("binary"), 256), 1, 32)).alias("journal"), "epoch", "seq", "slot_ts_ms", "kind", pad(F.col("author")).alias("author"), "author_seq",
        F.col("slot_ts_ms").alias("author_ts_ms"), "ttl_ms", payload.alias("payload"), "payload_len", scalar.sha256(payload).alias("payload_hash"), F.lit(False).alias("payload_omitted"), pad(F.col("leader")).alias("leader"), F.lit(bytes(64)).alias("entry_sig"), F.lit(bytes(64)).alias("slot_sig"),
    )
    header = scalar.entry_header(*[F.col(c) for c in ("kind", "journal", "author", "author_seq", "author_ts_ms", "ttl_ms", "payload_len", "payload_hash", "entry_sig")])
    rows = rows.withColumn("entry_hash", scalar.sha256(header))

    linked = ["journal", "epoch", "seq", "slot_ts_ms", "entry_hash", "leader", "slot_sig"]

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by([("epoch", "ascending"), ("seq", "ascending")])
        prev, out = bytes(32), []
        for r in group.to_pylist():
            out.append(prev)
            prev = hashlib.sha256(segment.slot_bytes(r | {"prev_slot_hash": prev})).digest()
        return group.select(["journal", "epoch", "seq"]).append_column("prev_slot_hash", pa.array(out, pa.binary()))

    links = rows.select(*linked).groupBy("journal").applyInArrow(link, "journal binary, epoch bigint, seq bigint, prev_slot_hash binary")
    return rows.join(links, ["journal", "epoch", "seq"]).select(*[F.col(c).cast(t) for c, t in (f.split() for f in SLOT_ROW.split(", "))])


@query(o.query(o.SLOTS, select="SELECT lower(substr(sha256(journal), 1, 32)) AS journal, epoch, seq, slot_ts_ms, kind, author_seq, ttl_ms, payload, payload_len FROM slots"))
def segment_roundtrip(spark, sf_dir):
    """Written as segment files and read back."""
    folder = fx.work_folder(spark, "segments")
    segment.write_segments(binary_slots(spark, sf_dir), folder, 1 << 20)
    back = segment.read_segments(spark, folder)
    return back.select(scalar.hex_id(F.col("journal")).alias("journal"), "epoch", "seq", "slot_ts_ms", "kind", "author_seq", "ttl_ms", F.col("payload").cast("string").alias("payload"), "payload_len")


@query(o.query(o.SLOTS, select="SELECT lower(substr(sha256(journal), 1, 32)) AS journal, CAST(NULL AS VARCHAR) AS refusal, count(*) AS n FROM slots GROUP BY 1"))
def binary_chain_verify(spark, sf_dir):
    """The binary chain verified from the stored predecessors' hashes; no row is refused."""
    b = binary_slots(spark, sf_dir)
    h = scalar.sha256(scalar.slot_bytes(*[F.col(c) for c in ("epoch", "seq", "slot_ts_ms", "entry_hash", "prev_slot_hash", "leader", "slot_sig")]))
    named = b.select(scalar.hex_id(F.col("journal")).alias("journal"), "epoch", "seq", "slot_ts_ms", scalar.hex_id(h).alias("slot_hash"), scalar.hex_id(F.col("prev_slot_hash")).alias("prev_slot_hash"))
    return chain.continuity(named).groupBy("journal", "refusal").agg(F.count("*").alias("n"))


@query(o.query(o.SLOTS, select="SELECT lower(substr(sha256(journal), 1, 32)) AS journal, epoch, seq, author_seq % 3 <> 0 OR author_seq % 2 = 0 AS payload_ok FROM slots"))
def payload_check(spark, sf_dir):
    """Payloads against the hashes that are signed: every third is forged, of which every second is dropped by compaction."""
    b = binary_slots(spark, sf_dir)
    forged, gone = F.col("author_seq") % 3 == 0, F.col("author_seq") % 6 == 0
    payload = F.when(gone, F.lit(None)).when(forged, F.lit(b"forged")).otherwise(F.col("payload"))
    return b.select(scalar.hex_id(F.col("journal")).alias("journal"), "epoch", "seq", control.payload_verdict(payload, F.col("payload_hash"), gone).alias("payload_ok"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 3 <> 0 AS signature_ok FROM nation")
def signature_verify(spark, sf_dir):
    """Signatures of a statement by each nation's key, each checked; every third is forged."""
    ship(spark)
    names = fx.load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").cast("binary").alias("message"))

    def sign(batches):
        for batch in batches:
            keys = [hashlib.sha256(str(i).encode()).digest() for i in batch.column("id").to_pylist()]
            signed = [ed25519.sign(k, m) if i % 3 else bytes(64) for k, i, m in zip(keys, batch.column("id").to_pylist(), batch.column("message").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(ed25519.public_key, keys), pa.binary()), pa.array(signed, pa.binary())], ["id", "message", "public_key", "signature"])

    signed = names.mapInArrow(sign, "id bigint, message binary, public_key binary, signature binary")
    return ed25519.with_verdict(signed, "public_key", "message", "signature").select("id", "signature_ok")
