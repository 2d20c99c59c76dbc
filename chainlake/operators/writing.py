"""What a node writes: slots for queued entries with what it refuses, stale marks, checkpoints, merge markers, settings,
new journals and the first record of a cluster.

Each function returns the rows to append; nothing is changed in place. Payloads are put together by expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import encode_changes
from ..functions.scalar import le_bytes, member_id
from ..schema import ID
from ..shipping import ship
from . import chain, expiry
from .settings import as_value
from .storage import truncate


def append(queue: DataFrame, journals: DataFrame, heads: DataFrame, now_ms: int, epoch: int) -> DataFrame:
    """queue with ``refusal``, and epoch, seq and slot_ts_ms for what is accepted.

    ``queue``: journal, arrival, payload_len, ... ``journals``: journal, allow_append, max_entry_bytes in force at the
    head. An entry for a journal that isn't there is refused, then one for a frozen journal, then one that is too large.
    A refused entry takes no number of the chain.
    """
    known = journals.select("journal", F.col("allow_append").alias("_open"), F.col("max_entry_bytes").cast("bigint").alias("_most"))
    refusal = F.when(F.col("_open").isNull(), "unknown_journal").when(F.col("_open") == "false", "journal_frozen").when(F.col("payload_len") > F.col("_most"), "too_large")
    judged = queue.join(known, "journal", "left").withColumn("refusal", refusal).drop("_open", "_most")
    taken = chain.assign(judged.where("refusal is null"), heads, now_ms, epoch)
    none = judged.where("refusal is not null").withColumns({"epoch": F.lit(None).cast("bigint"), "seq": F.lit(None).cast("bigint"), "slot_ts_ms": F.lit(None).cast("bigint")})
    return taken.withColumn("seq", F.col("seq").cast("bigint")).unionByName(none)


def _entry(kind: str, payload: Column) -> list[Column]:
    """Columns of an entry that has a control payload; these never expire."""
    return [F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("ttl_ms"), payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_len")]


def stale_records(targets: DataFrame, last_seqs: DataFrame, as_id: Column | None = None) -> DataFrame:
    """Entries (journal, author, author_seq, kind, ttl_ms, payload, payload_len) by which authors mark entries of their own.

    ``targets``: the ids to mark; ``last_seqs``: journal, author, last_seq. Numbers go on from each author's last, in the
    order of the targets' numbers. ``as_id``: an author as 16 bytes, where the column isn't that yet.
    """
    rows = targets.select(*ID).distinct().groupBy("journal", "author").agg(F.sort_array(F.collect_list("author_seq")).alias("_t")).join(last_seqs.select("journal", "author", "last_seq"), ["journal", "author"], "left")
    each = rows.select("journal", "author", F.coalesce("last_seq", F.lit(0)).alias("_last"), F.posexplode("_t").alias("_k", "_target"))
    payload = F.concat(F.col("author") if as_id is None else as_id, le_bytes(F.col("_target"), 8))
    return each.select("journal", "author", (F.col("_last") + F.col("_k") + 1).cast("bigint").alias("author_seq"), *_entry("stale", payload))


def checkpoint_records(info: DataFrame, heads: DataFrame, settings: DataFrame, leader: Column, last_seqs: DataFrame, now_ms: int) -> DataFrame:
    """A checkpoint entry for each journal in which one would remove something and is due; journals without get none.

    ``info``: entry_info() with ``removed``. ``heads``: journal, epoch, seq; a checkpoint reaches to the head.
    ``settings``: journal, stale_cleanup, every_ms, threshold (bytes) and last_ms (stamp of the last checkpoint, null:
    none yet). It is due by time or by how much it would remove.
    """
    at = info.join(settings.select("journal", F.col("stale_cleanup").alias("_cleanup"), "every_ms", "threshold", "last_ms"), "journal")
    keep, delete = (expiry.removal_set(at, (1 << 62, 0), now_ms, c) for c in ("keep", "delete"))
    removable = keep.where("_cleanup <> 'delete'").union(delete.where("_cleanup = 'delete'"))
    pending = removable.groupBy("journal", "every_ms", "threshold", "last_ms").agg(F.sum("payload_len").alias("pending"))
    due = expiry.checkpoint_due(F.lit(now_ms), F.coalesce("last_ms", F.lit(0)), F.col("every_ms"), F.col("pending"), F.col("threshold"))
    wanted = pending.where(due).join(heads.select("journal", "epoch", "seq"), "journal").withColumn("author", leader)
    numbered = wanted.join(last_seqs.select("journal", "author", "last_seq"), ["journal", "author"], "left")
    payload = F.concat(le_bytes(F.col("epoch"), 8), le_bytes(F.col("seq"), 8))
    return numbered.select("journal", "author", (F.coalesce("last_seq", F.lit(0)) + 1).cast("bigint").alias("author_seq"), *_entry("checkpoint", payload))


def merge_markers(branches: DataFrame, leader: Column, last_seqs: DataFrame) -> DataFrame:
    """The entry that opens each merge: it names the head (journal, epoch, seq) of the branch that is slotted again after it."""
    rows = branches.select("journal", "epoch", "seq").withColumn("author", leader).join(last_seqs.select("journal", "author", "last_seq"), ["journal", "author"], "left")
    payload = F.concat(le_bytes(F.col("epoch"), 8), le_bytes(F.col("seq"), 8))
    return rows.select("journal", "author", (F.coalesce("last_seq", F.lit(0)) + 1).cast("bigint").alias("author_seq"), *_entry("merge", payload))


#: An empty list of settings changes.
NO_CHANGES = b"\0\0"


def with_encoded_changes(rows: DataFrame, column: str = "changes") -> DataFrame:
    """rows with their changes (array of key, value; lists joined by commas) as payload bytes; null is no change."""
    ship(rows.sparkSession)
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [encode_changes([(c["key"], as_value(c["key"], c["value"])) for c in x or ()]) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()) if n == column else batch.column(n) for n in names], names)

    return rows.mapInArrow(run, kinds)


def settings_records(changes: DataFrame, leader: Column, last_seqs: DataFrame, journal_id: Column | None = None) -> DataFrame:
    """One settings entry per journal with all of its changes (journal, key, value), in the order of their keys.

    ``journal_id``: the journal as 16 bytes; without it the changes are the cluster's. Whether the changes are allowed is
    for the fold that takes the entry.
    """
    pairs = changes.groupBy("journal").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("changes"))
    rows = with_encoded_changes(pairs).withColumn("author", leader).join(last_seqs.select("journal", "author", "last_seq"), ["journal", "author"], "left")
    scope = F.concat(F.lit(b"\0"), F.lit(bytes(16))) if journal_id is None else F.concat(F.lit(b"\1"), journal_id)
    return rows.select("journal", "author", (F.coalesce("last_seq", F.lit(0)) + 1).cast("bigint").alias("author_seq"), *_entry("settings", F.concat(scope, F.col("changes"))))


def create_journal_records(names: DataFrame, leader: Column, last_seqs: DataFrame) -> DataFrame:
    """One create_journal entry per row of ``names``: journal (the control journal), id (16 bytes), name, and changes
    (binary, see with_encoded_changes()) if there are any. Numbers go on from the leader's last, in the order of ids."""
    changes = F.coalesce(F.col("changes"), F.lit(NO_CHANGES)) if "changes" in names.columns else F.lit(NO_CHANGES)
    name = F.col("name").cast("binary")
    rows = names.withColumn("author", leader).join(last_seqs.select("journal", "author", "last_seq"), ["journal", "author"], "left")
    place = F.row_number().over(Window.partitionBy("journal").orderBy("id"))  # a control chain has few
    payload = F.concat(F.col("id"), le_bytes(F.octet_length(name), 2), name, changes)
    return rows.select("journal", "author", (F.coalesce("last_seq", F.lit(0)) + place).cast("bigint").alias("author_seq"), *_entry("create_journal", payload))


def genesis_records(founders: DataFrame) -> DataFrame:
    """The first entry of each cluster: journal (binary id) and founder_key, and changes (binary) if there are any."""
    changes = F.coalesce(F.col("changes"), F.lit(NO_CHANGES)) if "changes" in founders.columns else F.lit(NO_CHANGES)
    return founders.select("journal", member_id(F.col("founder_key")).alias("author"), F.lit(1).cast("bigint").alias("author_seq"), *_entry("genesis", F.concat(F.col("founder_key"), changes)))


def refold(slots: DataFrame, journal, last: tuple[int, int], again: DataFrame) -> DataFrame:
    """The slots after a merge: the journal up to the common prefix's end, then what was slotted again.

    ``again``: the columns of slots. The other journals stay as they are. What follows from the slots, settings, states
    and removals, is computed anew from the result.
    """
    return truncate(slots, journal, last).unionByName(again)
