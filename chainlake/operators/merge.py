"""Healing a split: the common prefix, and the losing branch slotted again after the survivor's head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import position, sat_add
from ..schema import ID
from .prefix import numbered
from .reads import Position, at_or_before


def common_prefix(a: DataFrame, b: DataFrame) -> DataFrame:
    """By journal the number of leading slots that both branches share, by comparing hashes place by place."""
    x = a.select("journal", "epoch", "seq", F.col("slot_hash").alias("_a"))
    y = b.select("journal", "epoch", "seq", F.col("slot_hash").alias("_b"))
    both = x.join(y, ["journal", "epoch", "seq"], "full").withColumn("same", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
    split = both.groupBy("journal").agg(F.min(F.when(~F.col("same"), position())).alias("_split"))
    shared = both.join(split, "journal").where(F.col("same") & (F.col("_split").isNull() | (position() < F.col("_split"))))
    return split.select("journal").join(shared.groupBy("journal").agg(F.count("*").alias("n")), "journal", "left").select("journal", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_common"))


def prefix_length(slots: DataFrame, split: Position) -> DataFrame:
    """The same where the place of the split is known."""
    return slots.where(at_or_before(split)).groupBy("journal").agg(F.count("*").alias("n_common"))


def last_in_epoch(slots: DataFrame, epoch: int) -> DataFrame:
    return slots.where(F.col("epoch") == epoch).groupBy("journal").agg(F.max("seq").alias("seq"))


def reslot(survivor: DataFrame, branch: DataFrame, epoch: int, now_ms: int) -> DataFrame:
    """The losing branch's entries with new slots, in branch order, leaves at the very end.

    Entries that the survivor knows, by id, are left out: slotting them again would change nothing. Numbers go on from
    the survivor's head in the given epoch; the stamp is the clock's, but never before the head's.
    """
    new = branch.where(F.col("kind").isNotNull()).join(survivor.where(F.col("kind").isNotNull()).select(*ID).distinct(), ID, "left_anti")
    head = survivor.groupBy("journal").agg(F.max("slot_ts_ms").alias("_t"), F.max(F.when(F.col("epoch") == epoch, F.col("seq"))).alias("_s"))
    out = numbered(new, "_n", F.when(F.col("kind") == "leave", 1).otherwise(0)).join(head, "journal", "left")
    return out.select(
        *ID, "kind", "ttl_ms", "payload_len", "entry_hash",
        F.col("epoch").alias("branch_epoch"), F.col("seq").alias("branch_seq"),
        F.lit(epoch).cast("bigint").alias("epoch"), (F.coalesce("_s", F.lit(0)) + F.col("_n")).cast("bigint").alias("seq"),
        F.greatest(F.lit(now_ms).cast("bigint"), F.coalesce("_t", F.lit(0))).alias("slot_ts_ms"),
    )


def is_reslot(author: Column, term_leader: Column) -> Column:
    """A settings or checkpoint record counts only if its author led its slot's term; else it was slotted again."""
    return ~F.coalesce(author == term_leader, F.lit(False))


def last_merges(slots: DataFrame) -> DataFrame:
    """By journal the position and stamp of the last merge marker."""
    m = slots.where("kind = 'merge'").groupBy("journal").agg(F.max(F.struct("epoch", "seq", "slot_ts_ms")).alias("m"))
    return m.select("journal", F.col("m.epoch").alias("merge_epoch"), F.col("m.seq").alias("merge_seq"), F.col("m.slot_ts_ms").alias("merge_ts_ms"))


def settle_verdict(checkpoint_ts: Column, merge_ts: Column, settle_ms: Column) -> Column:
    """What a checkpoint does after a merge: no_op before it, merge_settling soon after it, else apply."""
    return F.when(merge_ts.isNull(), "apply").when(checkpoint_ts < merge_ts, "no_op").when(checkpoint_ts < sat_add(merge_ts, settle_ms), "merge_settling").otherwise("apply")
