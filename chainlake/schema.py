"""What the journal format fixes: kinds, settings, refusals, and the columns of the tables."""

from __future__ import annotations

#: Entry kinds in wire order.
KINDS = ["data", "genesis", "create_journal", "join", "leave", "epoch", "merge", "settings", "stale", "checkpoint"]

#: Setting keys in wire order: (key, scope, type, default, allowed values, rule for live changes).
SETTINGS = [
    ("leadership.mode", "cluster", "enum", "seniority", ["seniority", "configured", "combined"], "requires_reconfigurable"),
    ("leadership.authorities", "cluster", "string_list", "", [], "requires_reconfigurable"),
    ("leadership.tiebreak", "cluster", "enum", "seniority", ["seniority", "freshest"], "requires_reconfigurable"),
    ("leadership.fallback", "cluster", "enum", "stall", ["stall", "seniority"], "requires_reconfigurable"),
    ("leadership.reconfigurable", "cluster", "boolean", "true", [], "reconfigurable_turnoff_only"),
    ("cluster.admission", "cluster", "enum", "allowlist", ["allowlist", "prompt", "open"], "always"),
    ("cluster.max_members", "cluster", "u16", "32", [], "always"),
    ("cluster.max_journals", "cluster", "u32", "1024", [], "always"),
    ("cluster.heartbeat_ms", "cluster", "u64", "1000", [], "always"),
    ("cluster.suspect_after_ms", "cluster", "u64", "5000", [], "always"),
    ("membership.evict_after_ms", "cluster", "u64", "0", [], "always"),
    ("merge.settle_ms", "cluster", "u64", "30000", [], "always"),
    ("journal.allow_append", "journal", "boolean", "true", [], "always"),
    ("journal.max_entry_bytes", "journal", "u64", "16777216", [], "always"),
    ("ttl.enforce", "journal", "enum", "off", ["off", "per_entry", "all"], "always"),
    ("ttl.default_ms", "journal", "u64", "0", [], "always"),
    ("ttl.max_ms", "journal", "u64", "0", [], "always"),
    ("ttl.action", "journal", "enum", "mark_stale", ["mark_stale", "delete"], "always"),
    ("ttl.retain", "journal", "enum", "header", ["header", "none"], "always"),
    ("ttl.grace_ms", "journal", "u64", "0", [], "always"),
    ("stale.enforce", "journal", "enum", "off", ["off", "author"], "always"),
    ("stale.who", "journal", "enum", "author", ["author"], "always"),
    ("stale.cleanup", "journal", "enum", "keep", ["delete", "keep"], "always"),
    ("checkpoint.every_ms", "journal", "u64", "60000", [], "always"),
    ("checkpoint.pending_bytes", "journal", "u64", "67108864", [], "always"),
]
DEFAULTS = {s[0]: s[3] for s in SETTINGS}
KEY_INDEX = {s[0]: i for i, s in enumerate(SETTINGS)}

#: The names under which a record is refused.
REFUSALS = [
    "bad_signature", "bad_payload_hash", "not_leader", "bad_prev_hash", "bad_position", "bad_timestamp", "duplicate_conflict",
    "unknown_author", "wrong_journal", "unknown_target", "not_author", "staleness_disabled", "invalid_settings", "unknown_setting",
    "not_live_changeable", "scope_mismatch", "too_large", "journal_frozen", "already_member", "bad_join", "bad_leave", "bad_epoch",
    "bad_merge", "merge_settling", "wrong_journal_type", "journal_exists", "bad_journal_name", "too_many_journals", "bad_genesis",
    "bad_checkpoint", "bad_control_payload", "no_epoch",
]

#: Frame kinds in wire order, and who may send them: anyone, a dialled peer, an operator or a member.
FRAMES = {
    "hello": "any", "hello_ack": "outbound", "append": "operator", "ack": "any", "forward": "member", "slot": "member", "sync_req": "member", "sync_page": "member",
    "heartbeat": "member", "read_req": "operator", "read_page": "any", "settings": "operator", "merge_offer": "member", "merge_ack": "member", "members_req": "operator", "members_page": "any",
}

#: Sizes in bytes.
SLOT_BYTES, ENTRY_HEADER_BYTES, RECORD_PREFIX_BYTES = 168, 164, 8
FRAME_CAP_BYTES = 17 * 1024 * 1024
PAGE_BYTES = 64 * 1024
SEGMENT_ROLL_BYTES = 64 * 1024 * 1024
QUEUE_BYTES = 64 * 1024 * 1024
MOST_NAME, LONGEST_AUTHORITY = 256, 256
GENESIS_PREV = "0" * 64
MAX_LONG = 9223372036854775807

#: An entry's identity, and a slot's place; ids are unique inside one journal only.
ID = ["journal", "author", "author_seq"]
POSITION = ["epoch", "seq"]

#: Rows as a segment holds them; null entry columns mean that only the slot is kept.
SLOT_ROW = (
    "journal binary, epoch bigint, seq bigint, slot_ts_ms bigint, kind string, author binary, author_seq bigint, author_ts_ms bigint, "
    "ttl_ms bigint, payload binary, payload_len bigint, payload_hash binary, payload_omitted boolean, entry_hash binary, "
    "prev_slot_hash binary, leader binary, entry_sig binary, slot_sig binary"
)
