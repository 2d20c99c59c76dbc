"""Changes to what is stored: truncation, compaction, and the queue of entries without a slot.

Tables are never changed in place: each function returns the new content, which is written to a new version."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import record_bytes
from ..schema import ENTRY_HEADER_BYTES, ID, QUEUE_BYTES, RECORD_PREFIX_BYTES
from ..shipping import ship
from .reads import Position, at_or_before

#: What a queued entry takes besides its payload.
QUEUE_OVERHEAD = RECORD_PREFIX_BYTES + ENTRY_HEADER_BYTES


def truncate(slots: DataFrame, journal, last: Position) -> DataFrame:
    """The journal up to a position, the other journals as they are."""
    return slots.where((F.col("journal") != journal) | at_or_before(last))


def compact(slots: DataFrame, removed: DataFrame, retain: str = "header") -> DataFrame:
    """Slots with the payload ('header') or the whole entry ('none') dropped where the id was removed; slots stay.

    ``removed`` (ids) is joined by its key, so it may be as large as the journal.
    """
    gone = F.col("_gone").isNotNull()
    marked = slots.join(removed.select(*ID).distinct().withColumn("_gone", F.lit(1)), ID, "left")
    kept = {"payload": F.when(~gone, F.col("payload"))}
    if retain == "none":
        kept |= {c: F.when(~gone, F.col(c)) for c in ("kind", "author", "author_seq", "ttl_ms", "payload_len")}
    omitted = gone & F.lit(retain == "header")
    out = marked.select(*[kept.get(c, F.col(c)).alias(c) for c in slots.columns], omitted.alias("payload_omitted"), record_bytes(retain, ~gone, F.col("payload_len")).alias("record_bytes"))
    return out


def compact_in_force(slots: DataFrame, removed: DataFrame, current: DataFrame) -> DataFrame:
    """compact() with what each journal's ttl.retain in force (settings.current()) keeps of a removed entry."""
    retain = current.where("key = 'ttl.retain'").select("journal", F.col("value").alias("_retain"))
    rows = slots.join(retain, "journal", "left")
    parts = [compact(rows.where(F.col("_retain").eqNullSafe("none") if r == "none" else ~F.col("_retain").eqNullSafe("none")).drop("_retain"), removed, r) for r in ("header", "none")]
    return parts[0].unionByName(parts[1])


def queue_gate(queue: DataFrame, limit: int = QUEUE_BYTES) -> DataFrame:
    """journal, arrival, accepted, queued_bytes: whether each entry fits into its journal's queue when it arrives.

    An entry that is refused takes no room, so later ones may still fit: a fold over the sizes in order of arrival, per
    journal and without payloads. ``queue`` has journal, arrival, payload_len.
    """
    ship(queue.sparkSession)

    def gate(group: pa.Table) -> pa.Table:
        group = group.sort_by("arrival")
        accepted, queued, used = [], [], 0
        for size in group.column("payload_len").to_pylist():
            fits = used + size + QUEUE_OVERHEAD <= limit
            used += (size + QUEUE_OVERHEAD) * fits
            accepted.append(fits)
            queued.append(used)
        return pa.Table.from_arrays([group.column("journal"), group.column("arrival"), pa.array(accepted, pa.bool_()), pa.array(queued, pa.int64())], ["journal", "arrival", "accepted", "queued_bytes"])

    kind = queue.schema["journal"].dataType.simpleString()
    return queue.select("journal", "arrival", "payload_len").groupBy("journal").applyInArrow(gate, f"journal {kind}, arrival bigint, accepted boolean, queued_bytes bigint")


def unslotted(queue: DataFrame, slots: DataFrame) -> DataFrame:
    """Queued entries that the chain doesn't have yet: what a replay has to slot."""
    return queue.join(slots.where(F.col("kind").isNotNull()).select(*ID).distinct(), ID, "left_anti")


def remove_queued(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.join(ids.select(*ID).distinct(), ID, "left_anti")


def pages(records: DataFrame, limit: int) -> DataFrame:
    """journal, epoch, seq, page: each page takes records while their bytes fit, and one at least.

    A greedy cut can't be a window. It runs over (seq, bytes) per journal and epoch, without payloads; pages start anew
    with each epoch. Each group is cut by jumps over its running sum, one search a page.
    """
    ship(records.sparkSession)

    def cut(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        total = np.cumsum(group.column("record_bytes").to_numpy())
        page, at, n = np.zeros(len(total), np.int64), 0, 0
        while at < len(total):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            page[at:end] = n
            at, n = end, n + 1
        return pa.Table.from_arrays([group.column("journal"), group.column("epoch"), group.column("seq"), pa.array(page)], ["journal", "epoch", "seq", "page"])

    kind = records.schema["journal"].dataType.simpleString()
    return records.select("journal", "epoch", "seq", "record_bytes").groupBy("journal", "epoch").applyInArrow(cut, f"journal {kind}, epoch bigint, seq bigint, page bigint")
