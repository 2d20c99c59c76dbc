"""The same queries for DuckDB, from parts that follow plans.fixture."""

from __future__ import annotations

SLOTS = """
e AS (SELECT event_id, event_type, 'j' || CAST(user_id % 8 AS VARCHAR) AS journal, epoch_us(ts) // 1000 AS slot_ts_ms, user_id AS author,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props AS payload FROM events),
e1 AS (SELECT *, 1 + (slot_ts_ms - 1704067200000) // 864000000 AS epoch FROM e),
e2 AS (SELECT *, row_number() OVER (PARTITION BY journal, epoch ORDER BY slot_ts_ms, event_id) AS seq,
       row_number() OVER (PARTITION BY journal, author ORDER BY slot_ts_ms, event_id) AS author_seq FROM e1),
e3 AS (SELECT *, CASE WHEN seq % 40 = 0 THEN 'checkpoint' WHEN event_type = 'error' THEN 'stale' WHEN event_type = 'signup' AND k < 5 THEN 'settings' ELSE 'data' END AS kind FROM e2),
e4 AS (SELECT *, CASE WHEN kind = 'data' THEN k * 3600000 ELSE 0 END AS ttl_ms, CAST(strlen(payload) AS BIGINT) AS payload_len,
       CASE WHEN kind = 'stale' THEN last_value(CASE WHEN kind = 'data' THEN author_seq END IGNORE NULLS) OVER (PARTITION BY journal, author ORDER BY author_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target_seq,
       CASE WHEN kind = 'stale' THEN author END AS target_author FROM e3),
e5 AS (SELECT *, sha256(concat_ws('|', journal, author, author_seq, kind, ttl_ms, payload)) AS entry_hash FROM e4),
e6 AS (SELECT *, sha256(concat_ws('|', journal, epoch, seq, slot_ts_ms, entry_hash)) AS slot_hash FROM e5),
slots AS (SELECT *, coalesce(lag(slot_hash) OVER (PARTITION BY journal ORDER BY epoch, seq), repeat('0', 64)) AS prev_slot_hash, (epoch * 3 + author % 8) % 15 AS leader FROM e6)"""

WIDE = """
wide AS (SELECT *, kind = 'settings' AS s,
  CASE WHEN kind = 'settings' THEN CASE k % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'per_entry' ELSE 'all' END END AS c_enforce,
  CASE WHEN kind = 'settings' THEN (k + 1) * 3600000 END AS c_default,
  CASE WHEN kind = 'settings' AND k >= 3 THEN 172800000 END AS c_max,
  CASE WHEN kind = 'settings' THEN CASE WHEN k IN (1, 4) THEN 'delete' WHEN k = 2 THEN 'mark_stale' END END AS c_action,
  CASE WHEN kind = 'settings' AND k = 3 THEN 3600000 END AS c_grace,
  CASE WHEN kind = 'settings' THEN CASE WHEN k = 0 THEN 'off' ELSE 'author' END END AS c_stale,
  CASE WHEN kind = 'settings' THEN CASE WHEN k % 2 = 0 THEN 'delete' ELSE 'keep' END END AS c_cleanup
  FROM slots)"""


def _last(column: str, default: str, end: str) -> str:
    return f"coalesce(last_value({column} IGNORE NULLS) OVER (PARTITION BY journal ORDER BY epoch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND {end}), {default})"


def _in_force(end: str) -> str:
    cols = {"ttl_enforce": ("c_enforce", "'off'"), "ttl_default_ms": ("c_default", "0"), "ttl_max_ms": ("c_max", "0"), "ttl_action": ("c_action", "'mark_stale'"), "ttl_grace_ms": ("c_grace", "0"), "stale_enforce": ("c_stale", "'off'"), "stale_cleanup": ("c_cleanup", "'keep'")}
    return "SELECT *, " + ", ".join(f"{_last(c, d, end)} AS {n}" for n, (c, d) in cols.items()) + " FROM wide"


FORCE = f"force AS ({_in_force('1 PRECEDING')})"
STAMPED = """
st0 AS (SELECT *, CASE WHEN kind <> 'data' OR ttl_enforce = 'off' THEN NULL WHEN ttl_ms > 0 THEN ttl_ms WHEN ttl_enforce = 'all' THEN ttl_default_ms END AS asked FROM force),
st AS (SELECT * EXCLUDE (ttl_action, asked), CASE WHEN asked IS NULL THEN NULL WHEN ttl_max_ms = 0 THEN asked ELSE least(asked, ttl_max_ms) END AS effective_ttl_ms,
       slot_ts_ms + CASE WHEN asked IS NULL THEN NULL WHEN ttl_max_ms = 0 THEN asked ELSE least(asked, ttl_max_ms) END AS expires_at_ms,
       CASE WHEN kind = 'data' THEN ttl_action ELSE 'mark_stale' END AS ttl_action FROM st0)"""
MARKS = """
marks AS (SELECT m.journal, m.target_author AS author, m.target_seq AS author_seq, min(m.epoch * 1000000000 + m.seq) AS mark
  FROM st m JOIN st t ON t.journal = m.journal AND t.author = m.target_author AND t.author_seq = m.target_seq AND (t.epoch, t.seq) < (m.epoch, m.seq)
  WHERE m.kind = 'stale' AND m.stale_enforce = 'author' AND m.target_author = m.author GROUP BY ALL)"""
INFO = """
info AS (SELECT st.journal, st.author, st.author_seq, epoch, seq, slot_ts_ms, kind, payload_len, effective_ttl_ms, expires_at_ms, ttl_action, mark // 1000000000 AS stale_epoch, mark % 1000000000 AS stale_seq, mark IS NOT NULL AS stale_marked
  FROM st LEFT JOIN marks USING (journal, author, author_seq))"""
REMOVED = """
removed AS (SELECT i.journal, i.author, i.author_seq, min(c.epoch * 1000000000 + c.seq) AS by_mark FROM info i JOIN st c ON c.journal = i.journal AND c.kind = 'checkpoint' AND (i.epoch, i.seq) < (c.epoch, c.seq)
  WHERE (i.ttl_action = 'delete' AND i.expires_at_ms <= c.slot_ts_ms) OR (c.stale_cleanup = 'delete' AND ((i.stale_marked AND (i.stale_epoch, i.stale_seq) < (c.epoch, c.seq)) OR (i.ttl_action = 'mark_stale' AND i.expires_at_ms <= c.slot_ts_ms))) GROUP BY ALL)"""
VIEWS = """
views AS (SELECT CAST(s_nationkey % 5 AS BIGINT) AS cluster, s_suppkey AS member, lpad(lower(to_hex(s_suppkey)), 32, '0') AS hex_id, 'host-' || s_suppkey || ':7000' AS address, 1 + s_suppkey % 3 AS joined_epoch, s_suppkey AS joined_seq,
  CASE WHEN s_acctbal > 0 THEN 'member' ELSE 'lost' END AS state, CAST(1 + s_nationkey % 3 AS BIGINT) AS ack_epoch, s_suppkey * 7 % 50 AS ack_seq FROM supplier),
auth AS (SELECT cluster, member % 11 AS place, address AS authority FROM views WHERE member % 3 = 0 UNION ALL SELECT cluster, member % 7, hex_id FROM views WHERE member % 4 = 0),
ranked AS (SELECT *, (SELECT min(place) FROM auth a WHERE a.cluster = v.cluster AND (a.authority = v.address OR a.authority = v.hex_id)) AS idx FROM views v)"""
EVENTS = """
ev AS (SELECT author % 5 AS cluster, epoch, event_id AS seq, author AS member, CASE WHEN event_type = 'signup' THEN 'join' ELSE 'leave' END AS what, 'host-' || k AS address FROM slots WHERE event_type IN ('signup', 'error')),
vd AS (SELECT *, coalesce(lag(what) OVER (PARTITION BY cluster, member ORDER BY epoch, seq), 'leave') AS before FROM ev),
ok AS (SELECT * FROM vd WHERE what <> before),
mem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, member ORDER BY epoch DESC, seq DESC) AS r FROM ok) WHERE r = 1 AND what = 'join')"""


def query(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select


def with_state(now: int) -> str:
    """Entries with their state at a time; grace is the journal's at its head."""
    return f"""
head AS (SELECT journal, max_by(g, epoch * 1000000000 + seq) AS grace FROM (SELECT journal, epoch, seq, {_last('c_grace', '0', 'CURRENT ROW')} AS g FROM wide) GROUP BY journal),
state AS (SELECT i.*, by_mark, CASE WHEN by_mark IS NOT NULL THEN 'removed'
  WHEN stale_marked OR (ttl_action = 'mark_stale' AND coalesce(expires_at_ms <= greatest({now} - grace, 0), false)) THEN 'stale'
  WHEN ttl_action = 'delete' AND coalesce(expires_at_ms <= greatest({now} - grace, 0), false) THEN 'expired' ELSE 'live' END AS state
  FROM info i LEFT JOIN removed r USING (journal, author, author_seq) JOIN head USING (journal))"""


CURRENT = f"({_in_force('CURRENT ROW')})"
ALL_FACTS = (SLOTS, WIDE, FORCE, STAMPED, MARKS, INFO, REMOVED)

# --- a term in which entries are slotted again --------------------------------------------------------------------

AGAIN = f"""
late0 AS (SELECT * REPLACE (CASE WHEN event_id % 40 = 1 THEN 'checkpoint' ELSE kind END AS kind, CASE WHEN event_id % 40 = 1 THEN author_seq + 1000000 ELSE author_seq END AS author_seq,
  5 AS epoch, row_number() OVER (PARTITION BY journal ORDER BY event_id) AS seq) FROM wide WHERE (event_id % 20 = 3 AND kind = 'data') OR event_id % 40 = 1),
now AS (SELECT journal, {', '.join(f"max_by({n}, epoch * 1000000000 + seq) AS {n}" for n in ('ttl_enforce', 'ttl_default_ms', 'ttl_max_ms', 'ttl_action', 'stale_cleanup', 'stale_enforce', 'ttl_grace_ms'))} FROM ({_in_force('CURRENT ROW')}) GROUP BY journal),
late AS (SELECT l.* REPLACE (1706659200000 + seq * 3600000 AS slot_ts_ms), now.* EXCLUDE (journal) FROM late0 l JOIN now USING (journal)),
late1 AS (SELECT *, CASE WHEN kind <> 'data' OR ttl_enforce = 'off' THEN NULL WHEN ttl_ms > 0 THEN ttl_ms WHEN ttl_enforce = 'all' THEN ttl_default_ms END AS asked FROM late),
occ0 AS (SELECT journal, author, author_seq, epoch, seq, slot_ts_ms, kind, expires_at_ms, ttl_action, stale_cleanup, payload_len FROM st UNION ALL
  SELECT journal, author, author_seq, epoch, seq, slot_ts_ms, kind, slot_ts_ms + CASE WHEN asked IS NULL THEN NULL WHEN ttl_max_ms = 0 THEN asked ELSE least(asked, ttl_max_ms) END, CASE WHEN kind = 'data' THEN ttl_action ELSE 'mark_stale' END, stale_cleanup, payload_len FROM late1),
occ AS MATERIALIZED (SELECT occ0.*, mark AS marked_at, lead(epoch * 1000000000 + seq) OVER (PARTITION BY journal, author, author_seq ORDER BY epoch, seq) AS until FROM occ0 LEFT JOIN marks USING (journal, author, author_seq))"""
AGAIN_REMOVED = """
gone AS (SELECT o.journal, o.author, o.author_seq, min(c.epoch * 1000000000 + c.seq) AS by_mark FROM occ o JOIN chk c ON c.journal = o.journal
    AND o.epoch * 1000000000 + o.seq < c.epoch * 1000000000 + c.seq AND o.epoch * 1000000000 + o.seq <= c.through AND (until IS NULL OR c.epoch * 1000000000 + c.seq < until)
  WHERE (o.ttl_action = 'delete' AND o.expires_at_ms <= c.slot_ts_ms) OR (c.stale_cleanup = 'delete' AND ((marked_at < c.epoch * 1000000000 + c.seq AND marked_at <= c.through) OR (o.ttl_action = 'mark_stale' AND o.expires_at_ms <= c.slot_ts_ms))) GROUP BY ALL)"""
AGAIN_FACTS = (SLOTS, WIDE, FORCE, STAMPED, MARKS, AGAIN)
