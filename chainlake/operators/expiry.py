"""Time to live, staleness, visibility, and what checkpoints remove.

The rules are column expressions; the facts about entries are one as-of join to settings, one self-join of stale marks
to their targets, and as-of lookups of the first checkpoint that removes an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import position, sat_add, sat_sub
from ..schema import ID
from .merge import is_reslot, settle_verdict

TTL_KEYS = ["ttl.enforce", "ttl.default_ms", "ttl.max_ms", "ttl.action"]
STALE_KEYS = ["stale.enforce", "stale.cleanup"]


def effective_ttl(ttl: Column, enforce: Column, default_ms: Column, max_ms: Column) -> Column:
    """Null: never expires. The cap also holds for the default."""
    asked = F.when(enforce == "off", F.lit(None)).when(ttl > 0, ttl).when(enforce == "all", default_ms)
    return F.when(max_ms == 0, asked).when(asked.isNotNull(), F.least(asked, max_ms))


def expires_at(slot_ts: Column, ttl: Column) -> Column:
    return sat_add(slot_ts, ttl)


def past(expires: Column, now: Column, grace: Column) -> Column:
    return F.coalesce(expires <= sat_sub(now, grace), F.lit(False))


def is_stale(expires: Column, action: Column, marked: Column, now: Column, grace: Column) -> Column:
    return marked | ((action == "mark_stale") & past(expires, now, grace))


def is_expired(expires: Column, action: Column, now: Column, grace: Column) -> Column:
    return (action == "delete") & past(expires, now, grace)


def state(removed: Column, expires: Column, action: Column, marked: Column, now: Column, grace: Column) -> Column:
    """removed, stale, expired or live, tested in this order."""
    return (
        F.when(removed, "removed")
        .when(is_stale(expires, action, marked, now, grace), "stale")
        .when(is_expired(expires, action, now, grace), "expired")
        .otherwise("live")
    )


def visible(state: Column, include_stale: bool = False, include_expired: bool = False) -> Column:
    return state.isin(["live"] + ["stale"] * include_stale + ["expired"] * include_expired)


def stamped(slots: DataFrame, ttl_columns: bool = False) -> DataFrame:
    """slots with settings in force (ttl_*, see settings.in_force) get expires_at_ms and ttl_action; only data expires."""
    ttl = effective_ttl(F.col("ttl_ms"), F.col("ttl_enforce"), F.col("ttl_default_ms").cast("bigint"), F.col("ttl_max_ms").cast("bigint"))
    data = F.col("kind") == "data"
    out = slots.withColumn("effective_ttl_ms", F.when(data, ttl)).withColumn("expires_at_ms", F.when(data, expires_at(F.col("slot_ts_ms"), ttl)))
    return out.withColumn("ttl_action", F.when(data, F.col("ttl_action")).otherwise("mark_stale"))


def stale_marks(slots: DataFrame) -> DataFrame:
    """By target id the position of the mark that counts.

    ``slots`` has target_author, target_seq and stale_enforce on rows of kind stale. A mark counts if staleness is on
    at its slot, it is the target's author's own, and the target was slotted before it. The first one wins.
    """
    marks = slots.where((F.col("kind") == "stale") & (F.col("stale_enforce") == "author") & (F.col("target_author") == F.col("author")))
    marks = marks.select("journal", F.col("target_author").alias("author"), F.col("target_seq").alias("author_seq"), position().alias("mark"))
    target = slots.where(F.col("kind").isNotNull()).groupBy(*ID).agg(F.min(position()).alias("slotted"))
    good = marks.join(target, ID).where("mark > slotted").groupBy(*ID).agg(F.min("mark").alias("mark"))
    return good.select(*ID, F.col("mark.epoch").alias("stale_epoch"), F.col("mark.seq").alias("stale_seq"))


FACTS = ["epoch", "seq", "slot_ts_ms", "kind", "entry_hash", "payload_len", "effective_ttl_ms", "expires_at_ms", "ttl_action"]


def entry_info(stamped_slots: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per id: the latest position and its stamp, and whether its author marked it stale."""
    rows = stamped_slots.where(F.col("kind").isNotNull())
    last = rows.groupBy(*ID).agg(F.max_by(F.struct(*FACTS), position()).alias("r")).select(*ID, "r.*")
    return last.join(marks, ID, "left").withColumn("stale_marked", F.col("stale_epoch").isNotNull())


def occurrences(stamped_slots: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per slot of an id: its stamp, the id's stale mark, and ``until``, the position at which it is slotted again.

    What is known of an entry is its last slot's stamp, but marks and removals stay: so a checkpoint judges an entry by
    the slot that was the last one then. Ids that are slotted once, nearly all, have no ``until``.
    """
    rows = stamped_slots.where(F.col("kind").isNotNull()).select(*ID, *FACTS)
    again = F.lead(position()).over(Window.partitionBy(*ID).orderBy("epoch", "seq"))
    return rows.withColumn("until", again).join(marks, ID, "left").withColumn("stale_marked", F.col("stale_epoch").isNotNull())


def checkpoint_verdicts(checkpoints: DataFrame, terms: DataFrame | None = None, merges: DataFrame | None = None, settle_ms: int = 30000) -> DataFrame:
    """checkpoints (journal, epoch, seq, slot_ts_ms, author, through_epoch, through_seq, ...) with ``verdict``: apply,
    no_op, or the name under which it is refused.

    A checkpoint counts only if its author led the term that its slot names (``terms``: epoch, leader); else a merge has
    slotted it again and it does nothing, as in a term that isn't known. It must not reach beyond its own slot. Before
    the stamp of the last merge (``merges``: merge_ts_ms, one row at most) it does nothing, and soon after it is refused.
    Without the columns through_* a checkpoint reaches to its own slot.
    """
    out = checkpoints
    if "through_epoch" not in out.columns:
        out = out.withColumn("through_epoch", F.col("epoch")).withColumn("through_seq", F.col("seq"))
    led = F.lit(True)
    if terms is not None:
        out = out.join(terms.select("epoch", F.col("leader").alias("_led")), "epoch", "left")
        led = ~is_reslot(F.col("author"), F.col("_led"))
    settled = F.lit("apply")
    if merges is not None:
        out = out.join(F.broadcast(merges.agg(F.max("merge_ts_ms").alias("_merge"))))  # one row
        settled = settle_verdict(F.col("slot_ts_ms"), F.col("_merge"), F.lit(settle_ms))
    verdict = F.when(~led, "no_op").when(position("through_epoch", "through_seq") > position(), "bad_checkpoint").otherwise(settled)
    return out.withColumn("verdict", verdict).drop("_led", "_merge")


#: Rows that one task looks up at most, about: the rows of a journal are spread over so many parts as this needs, each
#: with all checkpoints of the journal.
LOOKUP = 1 << 20


def first_checkpoint(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """rows with ``by``: the first checkpoint (struct epoch, seq) that reaches the row's position and its not_before.

    rows and checkpoints have journal and lane (which checkpoints serve which rows); rows have epoch, seq and not_before,
    checkpoints epoch, seq, slot_ts_ms, through_epoch and through_seq. A checkpoint serves a row that stands before it
    and not beyond what it reaches, and whose not_before its stamp has reached. Stamps don't fall along a chain, and
    checkpoints nearly always reach as far as the one before: so it is the later of two, the first that reaches the
    position and the first whose stamp suffices. Each is an as-of lookup by a descending window over the union of both
    sides, and its frame ends at the current row: no product of entries and checkpoints, and no frame that looks ahead.
    Where the checkpoint so found doesn't reach the row after all, which takes one that reaches less far than an earlier
    one, the row is compared with all of its lane.
    """
    reach = F.least(position("through_epoch", "through_seq"), F.struct(F.col("epoch").alias("epoch"), (F.col("seq") - 1).alias("seq")))
    marks = checkpoints.select("journal", "lane", position().alias("_at"), F.col("slot_ts_ms").alias("_ts"), reach.alias("_reach"))
    parts = rows.groupBy("journal", "lane").agg(F.ceil(F.count("*") / LOOKUP).cast("bigint").alias("_parts"))
    spread = rows.join(parts, ["journal", "lane"]).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).drop("_parts")
    copied = marks.join(parts, ["journal", "lane"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    by_place = _next(spread, position(), copied, F.col("_reach"), "_by_place")
    by_time = _next(by_place, F.col("not_before"), copied, F.col("_ts"), "_by_time")
    both = F.when(F.col("_by_place").isNotNull() & F.col("_by_time").isNotNull(), F.when(F.col("_by_place._at") >= F.col("_by_time._at"), F.col("_by_place")).otherwise(F.col("_by_time")))
    found = by_time.withColumn("_by", both).drop("_by_place", "_by_time", "_part")
    sure = F.col("_by").isNull() | (F.col("_by._reach") >= position())
    done = found.where(sure).select(*rows.columns, F.col("_by._at").alias("by"))
    rest = found.where(~sure).drop("_by").join(marks, ["journal", "lane"]).where((F.col("_reach") >= position()) & (F.col("_ts") >= F.col("not_before")))
    return done.union(rest.groupBy(*rows.columns).agg(F.min("_at").alias("by")))


def _next(rows: DataFrame, value: Column, marks: DataFrame, mark_value: Column, name: str) -> DataFrame:
    """The first checkpoint, by position, of those of the row's lane whose value is at or beyond the row's.

    Frames take the least position among all values so far, so values of checkpoints need not rise with positions.
    """
    mark = F.struct("_at", "_reach")
    a = rows.select("journal", "lane", "_part", value.alias("_v"), F.lit(1).alias("_side"), F.struct(*[c for c in rows.columns if c not in ("journal", "lane", "_part")]).alias("_row"), F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType).alias("_mark"))
    # from high to low: at equal values a checkpoint stands before the rows that it serves
    b = marks.select("journal", "lane", "_part", mark_value.alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), mark.alias("_mark"))
    w = Window.partitionBy("journal", "lane", "_part").orderBy(F.desc("_v"), F.asc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.union(b).withColumn(name, F.min("_mark").over(w)).where("_row is not null")
    return seen.select("journal", "lane", "_part", "_row.*", name)


def removals(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """By id the position of the checkpoint that removes the entry; ids that stay are left out.

    ``entries`` is occurrences(), or entry_info() where no id is slotted twice. ``checkpoints``: journal, epoch, seq,
    slot_ts_ms and stale_cleanup in force, and through_epoch and through_seq (else its own position); only those that
    apply, see checkpoint_verdicts(). A checkpoint covers what stands before it, up to what it reaches. It removes what
    has expired under action delete; with cleanup delete also what is stale, by its author's mark or by its time. The
    first one that removes an entry counts, and the entry stays removed when it is slotted again.
    """
    if "until" not in entries.columns:
        entries = entries.withColumn("until", F.lit(None).cast("struct<epoch: bigint, seq: bigint>"))
    if "through_epoch" not in checkpoints.columns:
        checkpoints = checkpoints.withColumn("through_epoch", F.col("epoch")).withColumn("through_seq", F.col("seq"))
    lane = F.when(F.col("ttl_action") == "delete", "every").otherwise("cleaning")
    by_time = F.struct(lane.alias("lane"), F.col("epoch"), F.col("seq"), F.col("expires_at_ms").alias("not_before"))
    # a checkpoint that removes by a mark must reach the mark too, at any time
    marked = F.greatest(position(), position("stale_epoch", "stale_seq"))
    by_mark = F.struct(F.lit("cleaning").alias("lane"), marked["epoch"].alias("epoch"), marked["seq"].alias("seq"), F.when(F.col("stale_marked"), F.lit(0).cast("bigint")).alias("not_before"))
    causes = entries.select(*ID, "until", F.explode(F.filter(F.array(by_time, by_mark), lambda x: x["not_before"].isNotNull())).alias("c")).select(*ID, "until", "c.*")
    lanes = F.filter(F.array(F.lit("every"), F.when(F.col("stale_cleanup") == "delete", "cleaning")), lambda x: x.isNotNull())
    served = checkpoints.select("journal", "epoch", "seq", "slot_ts_ms", "through_epoch", "through_seq", F.explode(lanes).alias("lane"))
    found = first_checkpoint(causes, served).where("by is not null and (until is null or by < until)")
    return found.groupBy(*ID).agg(F.min("by").alias("by")).select(*ID, F.col("by.epoch").alias("removed_epoch"), F.col("by.seq").alias("removed_seq"))


def removals_by_join(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The same by the definition: every slot of an entry against every checkpoint of its journal. For few checkpoints
    and tests."""
    if "until" not in entries.columns:
        entries = entries.withColumn("until", F.lit(None).cast("struct<epoch: bigint, seq: bigint>"))
    through = position("through_epoch", "through_seq") if "through_epoch" in checkpoints.columns else position()
    c = checkpoints.select("journal", position().alias("_at"), through.alias("_through"), F.col("slot_ts_ms").alias("_ts"), "stale_cleanup")
    j = entries.join(c, "journal").where((position() < F.col("_at")) & (position() <= F.col("_through")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    gone = F.coalesce(F.col("expires_at_ms") <= F.col("_ts"), F.lit(False))
    mark = position("stale_epoch", "stale_seq")
    marked = F.col("stale_epoch").isNotNull() & (mark < F.col("_at")) & (mark <= F.col("_through"))
    hit = ((F.col("ttl_action") == "delete") & gone) | ((F.col("stale_cleanup") == "delete") & (marked | ((F.col("ttl_action") == "mark_stale") & gone)))
    return j.where(hit).groupBy(*ID).agg(F.min("_at").alias("by")).select(*ID, F.col("by.epoch").alias("removed_epoch"), F.col("by.seq").alias("removed_seq"))


def removal_set(info: DataFrame, through: tuple[int, int], stamp_ms: int, cleanup: str) -> DataFrame:
    """What one checkpoint would remove, of the entries that aren't removed yet: a filter."""
    e, s = through
    at = (F.col("epoch") < e) | ((F.col("epoch") == e) & (F.col("seq") <= s))
    marked = F.col("stale_marked") & ((F.col("stale_epoch") < e) | ((F.col("stale_epoch") == e) & (F.col("stale_seq") <= s)))
    gone = F.coalesce(F.col("expires_at_ms") <= stamp_ms, F.lit(False))
    hit = (F.col("ttl_action") == "delete") & gone
    if cleanup == "delete":
        hit = hit | marked | ((F.col("ttl_action") == "mark_stale") & gone)
    return info.where(at & hit & ~F.col("removed"))


def may_remove(info: DataFrame) -> DataFrame:
    """By journal: whether anything may ever expire away, and whether anything may ever be stale."""
    timed = F.col("expires_at_ms").isNotNull()
    return info.groupBy("journal").agg(
        F.bool_or(timed & (F.col("ttl_action") == "delete")).alias("may_expire_delete"),
        F.bool_or((timed & (F.col("ttl_action") == "mark_stale")) | F.col("stale_marked")).alias("may_remove_stale"),
    )


def pending_bytes(removable: DataFrame) -> DataFrame:
    return removable.groupBy("journal").agg(F.sum("payload_len").alias("pending_bytes"), F.count("*").alias("n"))


def checkpoint_due(now: Column, last_ms: Column, every_ms: Column, pending: Column, threshold: Column) -> Column:
    """Cadence: by time, or by how much could be removed; neither if both are off (0)."""
    by_time = (every_ms > 0) & (now - last_ms >= every_ms)
    by_size = (threshold > 0) & (pending >= threshold)
    return by_time | by_size
