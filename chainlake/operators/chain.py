"""The chain itself: continuity, validation in order, duplicates, sequence assignment, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import position
from ..schema import GENESIS_PREV, ID
from .prefix import lagged


def continuity(slots: DataFrame) -> DataFrame:
    """slots with ``refusal``: bad_prev_hash, bad_timestamp or bad_position, the first that holds; else null.

    Every slot stores its predecessor's hash, so a chain is verified by comparing neighbours, bucket by bucket. A missing
    prev_slot_hash is a bad one. Slots without an entry count as any other.
    """
    before = lagged(slots, {"_hash": F.col("slot_hash"), "_ts": F.col("slot_ts_ms"), "_epoch": F.col("epoch"), "_seq": F.col("seq")})
    dense = F.when(F.col("_seq").isNull(), F.col("seq") == 1).when(F.col("epoch") == F.col("_epoch"), F.col("seq") == F.col("_seq") + 1).otherwise((F.col("epoch") > F.col("_epoch")) & (F.col("seq") == 1))
    refusal = (
        F.when(~F.col("prev_slot_hash").eqNullSafe(F.coalesce("_hash", F.lit(GENESIS_PREV))), "bad_prev_hash")
        .when(F.col("slot_ts_ms") < F.coalesce("_ts", F.lit(0)), "bad_timestamp")
        .when(~dense, "bad_position")
    )
    return before.withColumn("refusal", refusal).drop("_hash", "_ts", "_epoch", "_seq")


def gaps(slots: DataFrame) -> DataFrame:
    """journal, after_epoch, after_seq, epoch, seq: between which slots that were received others are missing.

    What lies between two terms can't be told, but a term starts at 1; a journal's first slot has no slot before it.
    """
    before = lagged(slots, {"after_epoch": F.col("epoch"), "after_seq": F.col("seq")})
    same = F.col("epoch") == F.col("after_epoch")
    missing = F.when(same, F.col("seq") > F.col("after_seq") + 1).otherwise(F.col("seq") > 1)
    return before.where(missing).select("journal", "after_epoch", "after_seq", "epoch", "seq")


def last_seqs(slots: DataFrame) -> DataFrame:
    """By journal and author the highest sequence number, and the next one to use. Redelivery doesn't lower it."""
    best = slots.where(F.col("kind").isNotNull()).groupBy("journal", "author").agg(F.max("author_seq").alias("last_seq"))
    return best.withColumn("next_seq", F.col("last_seq") + 1)


def duplicates(slots: DataFrame) -> DataFrame:
    """Ids that occur more than once: redelivered (one hash) or in conflict (several)."""
    g = slots.where(F.col("kind").isNotNull()).groupBy(*ID).agg(F.count("*").alias("n"), F.min("entry_hash").alias("low"), F.max("entry_hash").alias("high"))
    return g.where("n > 1").select(*ID, "n", F.when(F.col("low") == F.col("high"), "redelivered").otherwise("duplicate_conflict").alias("verdict"))


def first_refusal(slots: DataFrame, members: DataFrame, terms: DataFrame | None = None, max_entry_bytes: Column | int = 16777216, reslotted: bool = False) -> DataFrame:
    """slots with ``refusal``: the first rule that a data journal's record breaks, in the order in which they are tested.

    ``slots`` have allow_append and stale_enforce in force, target_author and target_seq on stale records, and
    signature_ok and payload_ok (null: not tested); they may have slot_signature_ok, and entry_journal, the journal that
    the entry itself names. ``members``: member. Membership is as it is at the end of the control chain. With ``terms``
    (epoch, leader) a first record of a later term than the last is refused too. ``reslotted``: the rules for what a
    merge slots again, where control records do nothing.

    A number at or below the author's last one is a conflict unless the entry is, byte for byte, the one that was
    accepted under this id. Only accepted records count for both: a conflict is never above the last number, so the
    highest number of the records that no other rule refuses is the last one; and what was accepted under an id is the
    first of its records that no other rule refuses, if that was above the last number at its place, else nothing.
    """
    known = members.select(F.col("member").alias("_m")).distinct().withColumn("_is", F.lit(True))
    rows = continuity(slots).withColumnRenamed("refusal", "_chain")
    rows = rows.join(known.withColumnRenamed("_is", "_leader_is"), rows["leader"] == F.col("_m"), "left").drop("_m")
    rows = rows.join(known.withColumnRenamed("_is", "_author_is"), rows["author"] == F.col("_m"), "left").drop("_m")
    optional = lambda c: F.coalesce(F.col(c), F.lit(True)) if c in slots.columns else F.lit(True)
    named = F.col("entry_journal").eqNullSafe(F.col("journal")) if "entry_journal" in slots.columns else F.lit(True)
    future = F.lit(False)
    if terms is not None:
        rows = rows.join(F.broadcast(terms.agg(F.max("epoch").alias("_last_term"))))  # one row
        first = rows.groupBy("journal").agg(F.min(position()).alias("_first"))
        rows = rows.join(first, "journal")
        future = (position() == F.col("_first")) & (F.col("epoch") > F.col("_last_term"))
    of_kind = F.when(F.col("kind").isin("genesis", "create_journal", "join", "leave", "epoch", "merge"), "wrong_journal_type")
    if not reslotted:
        of_kind = (
            F.when((F.col("kind") == "data") & (F.col("allow_append") == "false"), "journal_frozen")
            .when((F.col("kind") == "stale") & (F.col("stale_enforce") != "author"), "staleness_disabled")
            .when((F.col("kind") == "stale") & (F.col("target_author") != F.col("author")), "not_author")
            .when(F.col("kind").isin("genesis", "create_journal", "join", "leave", "epoch", "merge"), "wrong_journal_type")
        )
    before = (
        F.when(F.col("_chain").isNotNull(), F.col("_chain"))
        .when(future, "bad_position")
        .when(F.col("_leader_is").isNull(), "not_leader")
        .when(~optional("slot_signature_ok"), "bad_signature")
        .when(~named, "wrong_journal")
        .when(F.col("_author_is").isNull(), "unknown_author")
        .when(~F.coalesce(F.col("signature_ok"), F.lit(True)), "bad_signature")
        .when(~F.coalesce(F.col("payload_ok"), F.lit(True)), "bad_payload_hash")
    )
    after = F.when(F.col("payload_len") > max_entry_bytes, "too_large").otherwise(of_kind)
    rows = rows.withColumn("_before", before).withColumn("_after", after)
    entry = F.col("kind").isNotNull()
    good = entry & F.col("_before").isNull() & F.col("_after").isNull()
    by_author = Window.partitionBy("journal", "author").orderBy("epoch", "seq").rowsBetween(Window.unboundedPreceding, -1)
    by_id = Window.partitionBy(*ID).orderBy("epoch", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_above", F.coalesce(F.col("author_seq") > F.max(F.when(good, F.col("author_seq"))).over(by_author), F.lit(True)))
    accepted = F.first(F.when(good, F.struct(F.col("entry_hash").alias("h"), F.col("_above").alias("above"))), ignorenulls=True).over(by_id)
    conflict = ~F.col("_above") & ~F.coalesce(accepted["above"] & (accepted["h"] == F.col("entry_hash")), F.lit(False))
    refusal = F.when(~entry, F.col("_chain")).when(F.col("_before").isNotNull(), F.col("_before")).when(conflict, "duplicate_conflict").otherwise(F.col("_after"))
    return rows.select(*slots.columns, refusal.alias("refusal"))


def genesis_refusal(records: DataFrame) -> DataFrame:
    """genesis records with ``refusal``: the first slot of its chain at 1:1, written and led by its founder.

    ``records``: journal, epoch, seq, is_first, author, leader, founder_key (all binary ids), signature_ok, payload_ok.
    """
    founder = F.substring(F.unhex(F.sha2("founder_key", 256)), 1, 16)
    bad = ~F.col("is_first") | (F.col("epoch") != 1) | (F.col("seq") != 1) | (F.octet_length("founder_key") != 32) | (F.col("author") != founder) | (F.col("leader") != founder)
    r = F.when(bad, "bad_genesis").when(~F.coalesce("signature_ok", F.lit(True)), "bad_signature").when(~F.coalesce("payload_ok", F.lit(True)), "bad_payload_hash")
    return records.withColumn("refusal", r)


def create_journal_refusal(rows: DataFrame, existing: DataFrame, most: int = 1024) -> DataFrame:
    """create_journal records with ``refusal``: unique id, a name of 1 to 256 characters, and the cap, in this order.

    Only accepted records take an id and a place below the cap. So of each id's records the first with a good name is
    taken up, if the cap allows, and these are counted in order; once the cap is reached no later one is accepted.
    """
    own = Window.partitionBy("id").orderBy("epoch", "seq").rowsBetween(Window.unboundedPreceding, -1)
    n = existing.agg(F.count_distinct("id").alias("_n"))
    good = F.coalesce(F.length("name").between(1, 256), F.lit(False))
    j = rows.join(existing.select("id").distinct().withColumn("_old", F.lit(1)), "id", "left").join(F.broadcast(n))  # n is one row
    j = j.withColumn("_first", good & F.col("_old").isNull() & ~F.coalesce(F.max(good).over(own), F.lit(False)))
    # no more than ``most`` can be accepted, so the places of the first ``most`` are all that matter
    takers = j.where("_first").select("id", F.col("epoch").alias("_e"), F.col("seq").alias("_s")).orderBy("_e", "_s").limit(most)
    takers = takers.withColumn("_place", F.row_number().over(Window.orderBy("_e", "_s")))
    j = j.join(takers, "id", "left")
    fits = F.col("_n") + F.col("_place") <= most
    taken = F.col("_old").isNotNull() | (F.coalesce(fits, F.lit(False)) & (position() > position("_e", "_s")))
    r = F.when(taken, "journal_exists").when(~good, "bad_journal_name").when(~F.coalesce(fits, F.lit(False)), "too_many_journals")
    return j.select(*rows.columns, r.alias("refusal"))


def assign(entries: DataFrame, heads: DataFrame, now_ms: int, epoch: int) -> DataFrame:
    """Slots for entries (journal, arrival, ...) after their journal's head (journal, epoch, seq, slot_ts_ms).

    Numbers go on from the head within its epoch, else from 1. The stamp is the clock's, but never before the head's.
    """
    w = Window.partitionBy("journal").orderBy("arrival")  # of one micro-batch, or of what a queue of bounded size holds
    h = heads.select("journal", F.col("epoch").alias("_e"), F.col("seq").alias("_s"), F.col("slot_ts_ms").alias("_t"))
    base = F.when(F.col("_e") == epoch, F.col("_s")).otherwise(0)
    out = entries.join(h, "journal", "left").withColumn("epoch", F.lit(epoch).cast("bigint")).withColumn("seq", F.coalesce(base, F.lit(0)) + F.row_number().over(w))
    return out.withColumn("slot_ts_ms", F.greatest(F.lit(now_ms).cast("bigint"), F.coalesce("_t", F.lit(0)))).drop("_e", "_s", "_t")


def fold_summary(slots: DataFrame) -> DataFrame:
    """By journal: head, entries by kind, authors, bytes, and a digest of all that is stored, whatever its order.

    The digest adds up the rows' hashes in 32-bit parts, so it is combined before the shuffle and needs no gathering.
    """
    h = F.sha2(F.concat_ws("|", "journal", "epoch", "seq", "entry_hash", "prev_slot_hash"), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint"))
    digest = F.concat_ws("-", *[part(k).cast("string") for k in range(3)])
    head = F.max(position()).alias("head")
    out = slots.groupBy("journal").agg(head, F.count("*").alias("n_slots"), F.count_if(F.col("kind") == "data").alias("n_data"), F.count_if(F.col("kind") != "data").alias("n_control"), F.count_distinct("author").alias("n_authors"), F.sum("payload_len").alias("payload_bytes"), digest.alias("digest"))
    return out.select("journal", F.col("head.epoch").alias("head_epoch"), F.col("head.seq").alias("head_seq"), "n_slots", "n_data", "n_control", "n_authors", "payload_bytes", "digest")


def state_digest(summary: DataFrame, settings_hash: DataFrame, members: DataFrame) -> DataFrame:
    """journal and a digest of all that a fold knows: what is stored (fold_summary()), the settings in force (journal, hash),
    and the members of its cluster (journal, member, joined_epoch, joined_seq), by seniority."""
    line = F.concat_ws(":", F.lpad(F.col("joined_epoch").cast("string"), 20, "0"), F.lpad(F.col("joined_seq").cast("string"), 20, "0"), F.col("member").cast("string"))
    listed = members.groupBy("journal").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("_members"))
    all_of = summary.join(settings_hash.select("journal", F.col("hash").alias("_settings")), "journal", "left").join(listed, "journal", "left")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("head_epoch", "head_seq", "digest", "_settings", "_members")]
    return all_of.select("journal", F.sha2(F.concat_ws("|", *parts), 256).alias("digest"))


def doctor(slots: DataFrame, members: DataFrame, terms: DataFrame) -> DataFrame:
    """item, value: what an operator looks at first."""
    one = lambda df, name, value: df.select(F.lit(name).alias("item"), value.cast("string").alias("value"))
    per_journal = slots.groupBy("journal").agg(F.max(position()).alias("h")).select(F.concat(F.lit("head "), "journal").alias("item"), F.concat_ws(":", "h.epoch", "h.seq").alias("value"))
    out = one(terms.agg(F.max("epoch").alias("v")), "epoch", F.col("v"))
    out = out.union(one(members.agg(F.count("*").alias("v")), "members", F.col("v")))
    return out.union(one(slots.select("journal").distinct().agg(F.count("*").alias("v")), "journals", F.col("v"))).union(per_journal)
