"""Settings: the changes a journal carries, and what was in force where.

``changes`` has journal, epoch, seq, key, value (string). A settings record applies to later slots only.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_hex_id, position
from ..schema import DEFAULTS, FRAME_CAP_BYTES, KEY_INDEX, LONGEST_AUTHORITY, SETTINGS
from ..shipping import ship
from .prefix import last_known


def column_of(key: str) -> str:
    return key.replace(".", "_")


def schema_table(spark: SparkSession) -> DataFrame:
    """The settings' schema as a table."""
    rows = [(i, k, scope, kind, default, ",".join(allowed), rule) for i, (k, scope, kind, default, allowed, rule) in enumerate(SETTINGS)]
    return spark.createDataFrame(rows, "key_index bigint, key string, scope string, value_type string, default string, allowed string, live_rule string")


def schema_markdown(spark: SparkSession) -> DataFrame:
    """One line of a Markdown table per setting."""
    cells = ["key", "scope", "value_type", F.when(F.col("allowed") == "", "-").otherwise(F.col("allowed")), F.when(F.col("default") == "", "(empty)").otherwise(F.col("default")), "live_rule"]
    return schema_table(spark).select("key_index", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def pivoted(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per settings record, with a nullable column for each key."""
    cols = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(column_of(k)) for k in keys]
    return changes.groupBy("journal", "epoch", "seq").agg(*cols)


def current(changes: DataFrame, journals: DataFrame) -> DataFrame:
    """journal, key, value in force at the head: the last change, else the default.

    The defaults are literals exploded for each journal; changes are reduced before they are joined.
    """
    last = changes.groupBy("journal", "key").agg(F.max_by("value", position()).alias("changed"))
    each = journals.select("journal", F.explode(F.array(*[F.struct(F.lit(s[0]).alias("key"), F.lit(s[3]).alias("default")) for s in SETTINGS if s[1] == "journal"])).alias("s"))
    return each.select("journal", "s.*").join(last, ["journal", "key"], "left").select("journal", "key", F.coalesce("changed", "default").alias("value"))


def in_force(slots: DataFrame, changes: DataFrame, keys: list[str], inclusive: bool = False) -> DataFrame:
    """slots with a column per key (dots become underscores): the setting in force at each slot.

    A slot is stamped with what stood before it; ``inclusive`` also counts its own change, as a query at a position
    does. The last value that isn't null over the records so far, sorted bucket by bucket, not journal by journal.
    """
    columns = [column_of(k) for k in keys]
    known = last_known(slots, pivoted(changes, keys), columns, inclusive)
    return known.select(*[F.col(f"`{c}`") for c in slots.columns], *[F.coalesce(column_of(k), F.lit(DEFAULTS[k])).alias(column_of(k)) for k in keys])


def at_positions(positions: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Settings at given positions (journal, epoch, seq), own change included; before any change the defaults.

    Positions need not be slots. The changes come in as positions of their own and are dropped afterwards.
    """
    asked = positions.select("journal", "epoch", "seq").distinct()
    places = asked.withColumn("_ask", F.lit(1)).union(changes.select("journal", "epoch", "seq").distinct().withColumn("_ask", F.lit(0)))
    each = places.groupBy("journal", "epoch", "seq").agg(F.max("_ask").alias("_ask"))
    return in_force(each, changes, keys, True).where("_ask = 1").drop("_ask")


def live_changeable(key: Column, value: Column, reconfigurable: Column) -> Column:
    """Whether a key may be changed now: leadership.* only while reconfigurable, which so can only be turned off for good.

    Setting it to what it is changes nothing and is allowed while it is on, whatever the value.
    """
    return F.when(key.startswith("leadership."), reconfigurable).otherwise(F.lit(True))


def state_error(enforce: Column, default_ms: Column, mode: Column, fallback: Column, authorities: Column, n_members: Column, resolves: Column, max_entry_bytes: Column) -> Column:
    """The first rule that a whole state of settings breaks, null if none."""
    empty_ok = (mode == "seniority") | (fallback == "seniority") | (n_members <= 1)
    size = F.size(authorities)
    first_bad = F.filter(authorities, lambda a: (F.length(a) == 0) | (F.length(a) > LONGEST_AUTHORITY))
    return (
        F.when((enforce == "all") & (default_ms == 0), "ttl_enforce_all_needs_default")
        .when((size == 0) & ~empty_ok, "empty_authorities_needs_fallback")
        .when(F.size(first_bad) > 0, F.when(F.length(F.get(first_bad, F.lit(0))) == 0, "empty_authority_entry").otherwise("authority_entry_too_long"))
        .when(~empty_ok & (size > 0) & ~resolves, "authorities_match_no_member")
        .when(max_entry_bytes > FRAME_CAP_BYTES - 4096, "max_entry_bytes_exceeds_frame_cap")
    )


def resolving(authorities: DataFrame, members: DataFrame) -> DataFrame:
    """cluster and whether any of its authorities (cluster, authority) names a member: an address as it stands, or an id
    in hex. Two equi joins instead of one with OR, so neither is a nested loop."""
    by_address = authorities.where(~is_hex_id(F.col("authority"))).join(members.select("cluster", F.col("address").alias("authority")), ["cluster", "authority"], "left_semi")
    by_id = authorities.where(is_hex_id(F.col("authority"))).withColumn("hex", F.lower("authority")).join(members.select("cluster", F.col("hex_id").alias("hex")), ["cluster", "hex"], "left_semi").drop("hex")
    named = by_address.union(by_id).select("cluster").distinct().withColumn("yes", F.lit(True))
    return authorities.select("cluster").distinct().join(named, "cluster", "left").select("cluster", F.coalesce("yes", F.lit(False)).alias("resolves"))


def state_hash(df: DataFrame, by: list[str]) -> DataFrame:
    """A digest of each state (key, value), whatever the order of its rows."""
    lines = F.array_sort(F.collect_list(F.concat_ws("=", "key", "value")))
    return df.groupBy(*by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


def drift(local: DataFrame, folded: DataFrame) -> DataFrame:
    """Keys whose local value isn't the folded one; a side without the key has null."""
    a = local.select("key", F.col("value").alias("local"))
    b = folded.select("key", F.col("value").alias("folded"))
    return a.join(b, "key", "full").where(~F.col("local").eqNullSafe(F.col("folded")))


def touches_leadership(changes: DataFrame) -> DataFrame:
    """By settings record, whether it changes who may lead."""
    return changes.groupBy("journal", "epoch", "seq").agg(F.bool_or(F.col("key").startswith("leadership.")).alias("touches"))


def broken_rule(state: dict, n_members: int, names: set[str]) -> str | None:
    """The rule that a state of settings (values as text, authorities as a list) breaks; the Python twin of state_error()."""
    listed = state["leadership.authorities"]
    exempt = "seniority" in (state["leadership.mode"], state["leadership.fallback"]) or n_members <= 1
    if state["ttl.enforce"] == "all" and int(state["ttl.default_ms"]) == 0:
        return "ttl_enforce_all_needs_default"
    if not listed and not exempt:
        return "empty_authorities_needs_fallback"
    for a in listed:
        if not 0 < len(a) <= LONGEST_AUTHORITY:
            return "authority_entry_too_long" if a else "empty_authority_entry"
    if listed and not exempt and not names & {a.lower() if len(a) == 32 else a for a in listed}:
        return "authorities_match_no_member"
    return "max_entry_bytes_exceeds_frame_cap" if int(state["journal.max_entry_bytes"]) > FRAME_CAP_BYTES - 4096 else None


def as_value(key: str, text: str) -> str | list[str]:
    """A setting as broken_rule() takes it, from text; lists are joined by commas."""
    if key != "leadership.authorities":
        return text
    return text.split(",") if text else []


def replay(records: DataFrame) -> DataFrame:
    """journal, epoch, seq, refusal, and hash of the state after each settings record of a chain.

    ``records``: journal, epoch, seq, is_genesis, n_members, names (addresses and hex ids of the members), changes (array
    of key, value; lists joined by commas), and, if the scope is to be tested, scope: keys of another are a mismatch. A record counts as a whole or not at all: first the live rules, against the
    state before it, then the rules of the whole state. That is a fold in sequence, over the few settings records of each
    chain; chains are folded in parallel.
    """
    ship(records.sparkSession)

    def fold(group: pa.Table) -> pa.Table:
        state, out = {k: as_value(k, v) for k, v in DEFAULTS.items()}, []
        for r in sorted(group.to_pylist(), key=lambda r: (r["epoch"], r["seq"])):
            changes = [(c["key"], c["value"]) for c in r["changes"] or ()]
            refusal = None
            if any(k not in DEFAULTS for k, _ in changes):
                refusal = "unknown_setting"
            elif r.get("scope") and any(SETTINGS[KEY_INDEX[k]][1] != r["scope"] for k, _ in changes):
                refusal = "scope_mismatch"
            elif not r["is_genesis"] and state["leadership.reconfigurable"] != "true" and any(k.startswith("leadership.") for k, _ in changes):
                refusal = "not_live_changeable"
            else:
                new = state | {k: as_value(k, v) for k, v in changes}
                if broken_rule(new, 1 if r["is_genesis"] else r["n_members"], set(r["names"] or ())):
                    refusal = "invalid_settings"
                else:
                    state = new
            text = "\n".join(f"{k}={v if isinstance(v, str) else ','.join(v)}" for k, v in sorted(state.items()))
            out.append((r["journal"], r["epoch"], r["seq"], refusal, hashlib.sha256(text.encode()).hexdigest()))
        kinds = (group.schema.field("journal").type, pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["journal", "epoch", "seq", "refusal", "hash"])

    kind = records.schema["journal"].dataType.simpleString()
    return records.groupBy("journal").applyInArrow(fold, f"journal {kind}, epoch bigint, seq bigint, refusal string, hash string")
