"""Who is a member: a fold of join and leave events, the admission rules, and the failure detector.

``events``: cluster, epoch, seq, member, what (join, leave), address. Clusters are independent and fold in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import address_safe, position, sat_sub
from ..schema import FRAMES


def verdicts(events: DataFrame) -> DataFrame:
    """events with ``refusal``: a join of a member is refused, and a leave of someone who isn't one.

    Whatever happens to an event, after a join its member is in and after a leave out. So an event is refused exactly
    if it says what the member's previous event said; nothing is folded in sequence. Who may write an event, keys and the
    rules of the whole state are control.fold()'s to judge; this takes what it has let pass, or events without those.
    """
    w = Window.partitionBy("cluster", "member").orderBy("epoch", "seq")
    before = F.coalesce(F.lag("what").over(w), F.lit("leave"))
    return events.withColumn("refusal", F.when((F.col("what") == "join") & (before == "join"), "already_member").when((F.col("what") == "leave") & (before == "leave"), "bad_leave"))


def reslotted(events: DataFrame) -> DataFrame:
    """Events of a merged branch: what would be refused is a no-op and is left out."""
    return verdicts(events).where("refusal is null").drop("refusal")


def members(events: DataFrame) -> DataFrame:
    """cluster, member, address, joined_epoch, joined_seq of those who are in: their last accepted join."""
    last = verdicts(events).where("refusal is null").groupBy("cluster", "member").agg(F.max_by(F.struct("what", "address", "epoch", "seq"), position()).alias("e"))
    return last.where("e.what = 'join'").select("cluster", "member", F.col("e.address").alias("address"), F.col("e.epoch").alias("joined_epoch"), F.col("e.seq").alias("joined_seq"))


def listing(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Members with their rank by seniority and whether they lead."""
    w = Window.partitionBy("cluster").orderBy("joined_epoch", "joined_seq", "member")
    ranked = members.withColumn("seniority", F.row_number().over(w).cast("bigint"))
    return ranked.join(leaders.select("cluster", F.col("leader").alias("_l")), "cluster", "left").withColumn("is_leader", F.coalesce(F.col("member") == F.col("_l"), F.lit(False))).drop("_l")


def admission(hellos: DataFrame, members: DataFrame, allowlist: DataFrame, mode: str, max_members: int, own_key: bytes | None, genesis: bytes | None) -> DataFrame:
    """hellos with the answer: none (admitted), not_allowlisted, wrong_genesis, max_members or prompt_pending.

    ``hellos``: member (claimed id), public_key, address, genesis (null: none yet). ``members``: member, public_key.
    ``allowlist``: public_key. The rules are tried in order. Members and allowlist are joined by key.
    """
    derived = F.substring(F.unhex(F.sha2("public_key", 256)), 1, 16)
    known = hellos.join(members.select("member", F.col("public_key").alias("_member_key")), "member", "left")
    listed = known.join(allowlist.select("public_key").distinct().withColumn("_listed", F.lit(True)), "public_key", "left")
    n = members.agg(F.count("*").alias("_n_members"))
    own = F.lit(False) if own_key is None else F.col("public_key") == F.lit(own_key)
    wrong = F.lit(False) if genesis is None else F.col("genesis").isNotNull() & (F.col("genesis") != F.lit(genesis))
    by_mode = {"open": F.lit("none"), "prompt": F.lit("prompt_pending")}.get(mode, F.when(F.col("_listed"), "none").otherwise("not_allowlisted"))
    answer: Column = (
        F.when(F.col("member") != derived, "not_allowlisted")
        .when(~address_safe(F.col("address")), "not_allowlisted")
        .when(own, "none")
        .when(wrong, "wrong_genesis")
        .when(F.col("_member_key").isNotNull(), F.when(F.col("_member_key") == F.col("public_key"), "none").otherwise("not_allowlisted"))
        .when(F.col("_n_members") >= max_members, "max_members")
        .otherwise(by_mode)
    )
    return listed.join(F.broadcast(n)).select(*hellos.columns, answer.alias("answer"))  # n is one row


def allowed_frames(frames: DataFrame) -> DataFrame:
    """frames (role, outbound, kind) with ``allowed``: the rule of each kind is a map literal."""
    rule = F.try_element_at(F.create_map(*[F.lit(x) for pair in FRAMES.items() for x in pair]), F.col("kind"))
    ok = (rule == "any") | ((rule == "outbound") & F.col("outbound")) | (rule == F.col("role"))
    return frames.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def pending(answered: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Who waits for an operator's word; those who are members by now, admitted by one, no longer do."""
    waiting = answered.where("answer = 'prompt_pending'").select("member", "public_key", "address").distinct()
    return waiting if members is None else waiting.join(members.select("member").distinct(), "member", "left_anti")


def admitted(waiting: DataFrame, keys: DataFrame) -> DataFrame:
    """Of those who wait the ones whose key an operator has admitted; their join records are what is written next."""
    return waiting.join(keys.select("public_key").distinct(), "public_key", "left_semi")


def detect(heartbeats: DataFrame, now_ms: int, suspect_after_ms: int, evict_after_ms: int) -> DataFrame:
    """cluster, member, last heard, state (member, syncing, lost) and whether the leader evicts it.

    ``heartbeats``: cluster, member, heard_ms (null: never), head_epoch, head_seq. A member is syncing while its head is
    behind the most advanced head of its cluster. Of equal stamps the one of the later head counts.
    """
    last = heartbeats.groupBy("cluster", "member").agg(F.max("heard_ms").alias("heard_ms"), F.max_by(position("head_epoch", "head_seq"), F.struct("heard_ms", position("head_epoch", "head_seq"))).alias("head"))
    top = last.groupBy("cluster").agg(F.max("head").alias("_top"))
    silent = sat_sub(F.lit(now_ms), F.col("heard_ms"))
    lost = F.col("heard_ms").isNotNull() & (silent >= suspect_after_ms)
    state = F.when(lost, "lost").when(F.col("head") < F.col("_top"), "syncing").otherwise("member")
    evict = lost & (silent >= evict_after_ms) & F.lit(evict_after_ms > 0)
    return last.join(top, "cluster").select("cluster", "member", "heard_ms", F.col("head.epoch").alias("head_epoch"), F.col("head.seq").alias("head_seq"), state.alias("state"), evict.alias("evict"))
