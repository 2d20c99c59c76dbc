"""Reads of a journal table: ranges, filters, points, heads. All are predicates on the scan, so they prune files and
row groups; none of them sorts unless an order is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalar import position, position_text
from ..schema import ID

Position = tuple[int, int]


def at_or_after(p: Position) -> Column:
    """Written out, as the comparison of structs isn't pushed down to the scan."""
    e, s = p
    return (F.col("epoch") >= e) & ((F.col("epoch") > e) | (F.col("seq") >= s))


def at_or_before(p: Position) -> Column:
    e, s = p
    return (F.col("epoch") <= e) & ((F.col("epoch") < e) | (F.col("seq") <= s))


def scan(slots: DataFrame, journal=None, first: Position | None = None, last: Position | None = None) -> DataFrame:
    """Rows of a journal (None: of all) between two positions, both included. A position that isn't there is no error."""
    out = slots if journal is None else slots.where(F.col("journal") == journal)
    if first:
        out = out.where(at_or_after(first))
    return out.where(at_or_before(last)) if last else out


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy("journal", "epoch", "seq")


def point(slots: DataFrame, journal, p: Position) -> DataFrame:
    return slots.where((F.col("journal") == journal) & (F.col("epoch") == p[0]) & (F.col("seq") == p[1]))


def entries(slots: DataFrame) -> DataFrame:
    """Without slots whose entry is gone; no read yields those."""
    return slots.where(F.col("kind").isNotNull())


def read(slots: DataFrame, journal=None, first=None, last=None, author=None, kind=None, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """The generic read: window, then author, kind and time. Every stored occurrence of an id is yielded."""
    out = entries(scan(slots, journal, first, last))
    for column, value in (("author", author), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if since_ms is not None:
        out = out.where(F.col("slot_ts_ms") >= since_ms)
    return out if until_ms is None else out.where(F.col("slot_ts_ms") <= until_ms)


def read_by_ids(slots: DataFrame, ids: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """The latest occurrence of each id asked for. The ids go to the slots, and only what they match is ranked.

    ``visible``: the ids that a reader may see (expiry.visible() of their states); others are as if they didn't exist.
    """
    asked = ids.select(*ID).distinct()
    if visible is not None:
        asked = asked.join(visible.select(*ID), ID, "left_semi")
    hit = entries(slots).join(asked, ID, "left_semi")
    last = hit.groupBy(*ID).agg(F.max_by(F.struct(*[c for c in slots.columns if c not in ID]), position()).alias("_r"))
    return last.select(*ID, "_r.*").select(*slots.columns)


def heads(slots: DataFrame, *values: str) -> DataFrame:
    """By journal the last position, and what the last row holds in the columns asked for."""
    last = slots.groupBy("journal").agg(F.max(F.struct("epoch", "seq", *values)).alias("h"))
    return last.select("journal", "h.*")


def first_kinds(slots: DataFrame) -> DataFrame:
    """By journal the kind of the first record; the control journal's is genesis."""
    return slots.groupBy("journal").agg(F.min_by("kind", position()).alias("kind"))


def journals(slots: DataFrame) -> DataFrame:
    return slots.groupBy("journal").agg(F.count("*").alias("n_slots"), F.count("kind").alias("n_entries"))


def journal_by_name(names: DataFrame, name: str, control: str = "__cluster__") -> DataFrame:
    """id of a journal's name; of several that share it the oldest. Unknown names give no row."""
    own = names.where(F.col("is_control") if name == control else (~F.col("is_control") & (F.col("name") == name)))
    return own.agg(F.min_by("id", F.struct("created_epoch", "created_seq", "id")).alias("id")).where("id is not null")


def projection(df: DataFrame) -> DataFrame:
    """What the command line prints of a record."""
    author = F.concat_ws(":", F.col("author").cast("string"), F.col("author_seq").cast("string"))
    return df.select("journal", position_text(F.col("epoch"), F.col("seq")).alias("pos"), author.alias("id"), "kind", F.col("payload").cast("string").alias("payload"))


def page_after(slots: DataFrame, journal, cursor: Position | None, size: int) -> DataFrame:
    """The next rows of a journal behind a cursor: keyset pagination, a top-k over a pruned scan."""
    own = slots.where(F.col("journal") == journal)
    if cursor:
        own = own.where((F.col("epoch") >= cursor[0]) & ((F.col("epoch") > cursor[0]) | (F.col("seq") > cursor[1])))
    return own.orderBy("epoch", "seq").limit(size)


def for_each(slots: DataFrame, callback: Callable[[Row], None]) -> None:
    """Calls back with every record, in the tasks that read them; in chain order if slots are sorted within partitions."""

    def run(rows: Iterator[Row]) -> None:
        for row in rows:
            callback(row)

    slots.foreachPartition(run)
