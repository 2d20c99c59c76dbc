"""Leader election and the ranking behind it, per cluster.

``views``: cluster, member, hex_id, address, joined_epoch, joined_seq, state, ack_epoch, ack_seq.
``authorities``: cluster, place (from 0), authority (an address, or an id in hex).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_hex_id, position

NOT_LISTED = 2147483647


def with_authority(views: DataFrame, authorities: DataFrame, id_bytes: int = 16) -> DataFrame:
    """views with auth_index: the first place of an authority that names the member, null if none does.

    What looks like an id names ids only, anything else addresses only: two equi joins.
    """
    hexed = is_hex_id(F.col("authority"), id_bytes)
    ids = authorities.where(hexed).groupBy("cluster", F.lower("authority").alias("hex_id")).agg(F.min("place").alias("_by_id"))
    addresses = authorities.where(~hexed).groupBy("cluster", F.col("authority").alias("address")).agg(F.min("place").alias("_by_address"))
    out = views.join(ids, ["cluster", "hex_id"], "left").join(addresses, ["cluster", "address"], "left")
    return out.withColumn("auth_index", F.least("_by_id", "_by_address")).drop("_by_id", "_by_address")


def rank(mode: str, tiebreak: str = "seniority") -> Column:
    """A struct that orders members as the election does; the least one leads."""
    seniority = position("joined_epoch", "joined_seq")
    listed = F.col("auth_index").isNotNull()
    zero = F.lit(0).cast("bigint")
    if mode == "seniority":
        first, fresh = zero, (zero, zero)
    elif mode == "configured":
        first, fresh = F.coalesce(F.col("auth_index"), F.lit(NOT_LISTED)).cast("bigint"), (zero, zero)
    else:
        first = F.when(listed, 0).otherwise(1).cast("bigint")
        ack = tiebreak == "freshest"
        fresh = tuple(F.when(listed & F.lit(ack), -F.col(c).cast("bigint")).otherwise(zero) for c in ("ack_epoch", "ack_seq"))
    return F.struct(first.alias("first"), fresh[0].alias("fresh_epoch"), fresh[1].alias("fresh_seq"), seniority.alias("seniority"))


def elect(views: DataFrame, mode: str, tiebreak: str = "seniority", fallback: str = "stall") -> DataFrame:
    """cluster, leader (null: none): one grouped minimum. views come from with_authority() unless by seniority.

    A cluster of one member that is up leads itself under every mode.
    """
    if "auth_index" not in views.columns:
        views = views.withColumn("auth_index", F.lit(None).cast("bigint"))
    up = F.col("state") == "member"
    best = lambda ok, order: F.min(F.when(ok, F.struct(order.alias("r"), F.col("member").alias("member"))))
    eligible = up if mode == "seniority" else up & F.col("auth_index").isNotNull()
    found = views.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(up).alias("n_up"), best(eligible, rank(mode, tiebreak)).alias("best"), best(up, rank("seniority")).alias("senior"))
    spare = F.col("senior.member") if fallback == "seniority" else F.lit(None)
    leader = F.when((F.col("n") == 1) & (F.col("n_up") == 1), F.col("senior.member")).otherwise(F.coalesce("best.member", spare))
    return found.select("cluster", leader.alias("leader"))


def survivors(branches: DataFrame, views: DataFrame, mode: str, tiebreak: str = "seniority") -> DataFrame:
    """cluster and the branch (a, b) that survives a split: the one whose leader ranks higher; a on equality.

    ``branches``: cluster, leader_a, leader_b."""
    r = views.select("cluster", F.col("member").alias("_m"), rank(mode, tiebreak).alias("_r"))
    a = branches.join(r.withColumnRenamed("_r", "_ra"), (branches["cluster"] == r["cluster"]) & (branches["leader_a"] == r["_m"])).select(branches["cluster"], "leader_a", "leader_b", "_ra")
    b = a.join(r, (a["cluster"] == r["cluster"]) & (a["leader_b"] == r["_m"])).select(a["cluster"], "leader_a", "leader_b", "_ra", "_r")
    return b.select("cluster", "leader_a", "leader_b", F.when(F.col("_ra") <= F.col("_r"), "a").otherwise("b").alias("winner"))


def terms(epochs: DataFrame) -> DataFrame:
    """epoch records (journal, epoch, seq, number, author, slot_leader, leader, reason) with ``refusal``.

    A record's number is its slot's epoch and one more than the previous term's; it is written by the leader that hands
    over or by the one that takes over, and its slot is led by its author.
    """
    w = Window.partitionBy("journal").orderBy("epoch", "seq")
    previous, number = F.lag("leader").over(w), F.lag("number").over(w)
    by = F.when(F.col("author") == previous, F.col("slot_leader") == previous).otherwise((F.col("author") == F.col("leader")) & (F.col("slot_leader") == F.col("leader")))
    ok = (F.col("number") == F.col("epoch")) & (number.isNull() | ((F.col("number") == number + 1) & by))
    return epochs.withColumn("refusal", F.when(~ok, "bad_epoch"))


def handovers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clusters whose leader changes with new settings: cluster, from_leader, to_leader."""
    a = before.select("cluster", F.col("leader").alias("from_leader"))
    b = after.select("cluster", F.col("leader").alias("to_leader"))
    return a.join(b, "cluster").where("to_leader is not null and not (from_leader <=> to_leader)")
