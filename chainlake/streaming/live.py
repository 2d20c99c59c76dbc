"""Journals as streams: following, redelivery, failure detection, expiry timers, ingestion.

The checkpoint of a query is the follower's cursor. Event time is the slot's stamp, which never falls along a chain.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.scalar import sat_add, sat_sub
from ..operators.reads import Position, at_or_after
from ..schema import ID
from ..shipping import ship

# The worker that starts a stateful processor doesn't see shipped files: its class travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROCKS_KEY = "spark.sql.streaming.stateStore.providerClass"


def slots_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """A stored journal as a stream; files that are added later are pushed. A backfill takes so many files or bytes at a time."""
    reader = spark.readStream.schema(schema)
    for option, value in (("maxFilesPerTrigger", files_per_batch), ("maxBytesPerTrigger", bytes_per_batch)):
        reader = reader if value is None else reader.option(option, value)
    return reader.parquet(path)


def follow(slots: DataFrame, journal=None, cursor: Position = (1, 1)) -> DataFrame:
    """What a follower is given from an inclusive cursor on: everything, stale and expired entries too."""
    own = slots if journal is None else slots.where(F.col("journal") == journal)
    return own.where(at_or_after(cursor) & F.col("kind").isNotNull())


def deduplicated(slots: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row per entry id: what is delivered again within the delay is dropped, and state is too after it."""
    timed = slots.withColumn("slot_time", F.timestamp_millis("slot_ts_ms")).withWatermark("slot_time", delay)
    return timed.dropDuplicatesWithinWatermark([*ID, "entry_hash"])


def deliver(slots: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls back with each micro-batch; the callback must bear being called again with the same batch number."""
    writer = slots.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_rocks(spark: SparkSession) -> SparkSession:
    """Stateful processors need this store. The session's setting is changed only where it is unset or not this one."""
    ship(spark)
    if spark.conf.get(ROCKS_KEY, None) != ROCKS:
        spark.conf.set(ROCKS_KEY, ROCKS)
    return spark


class SilenceDetector(StatefulProcessor):
    """Emits a member as lost when it has been silent for a time, and as a member when it is heard again.

    A gap between two heartbeats is found when the second comes, whether or not a timer has run out between, so what is
    emitted doesn't depend on how the stream is cut into batches.
    """

    def __init__(self, suspect_after_ms: int):
        self.suspect_after_ms = suspect_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "heard_ms bigint, lost boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        heard, lost = self.last.get() if self.last.exists() else (-1, True)
        changes = []
        for t in sorted({int(t) for r in rows for t in r["heard_ms"]}):
            if t <= heard:
                continue
            if not lost and t - heard >= self.suspect_after_ms:
                changes.append(("lost", heard + self.suspect_after_ms))
                lost = True
            if lost:
                changes.append(("member", t))
            heard, lost = t, False
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((heard, lost))
        if not lost:
            self.handle.registerTimer(heard + self.suspect_after_ms)
        if changes:
            yield pd.DataFrame([(key[0], key[1], *c) for c in changes], columns=["cluster", "member", "state", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        heard, _ = self.last.get()
        self.last.update((heard, True))
        yield pd.DataFrame({"cluster": [key[0]], "member": [key[1]], "state": ["lost"], "at_ms": [heard + self.suspect_after_ms]})

    def close(self) -> None:
        pass


def silence(heartbeats: DataFrame, suspect_after_ms: int, delay: str = "0 seconds") -> DataFrame:
    """A stream of (cluster, member, state, at_ms) changes from one of heartbeats (cluster, member, heard_ms)."""
    with_rocks(heartbeats.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in heartbeats.schema}
    timed = heartbeats.withColumn("heard", F.timestamp_millis("heard_ms")).withWatermark("heard", delay)
    return timed.groupBy("cluster", "member").transformWithStateInPandas(
        SilenceDetector(suspect_after_ms), f"cluster {kinds['cluster']}, member {kinds['member']}, state string, at_ms bigint", "Update", "EventTime"
    )


#: Parts of the entries that wait for their instant.
PARTS = 1024


class ExpiryTimer(StatefulProcessor):
    """Emits entries when their expiry instant and the grace have passed; forgets them then.

    The last position of an entry counts: slotted again, it has the new stamp, or none (-1). Only entries that wait for
    their instant are kept. A key is a part of the entries, with one value and one timer, that of its first instant: each
    call to the state store is a message to another process, so no entry has calls of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "entries binary")

    def known(self) -> dict[tuple, tuple]:
        """By id the epoch, seq, instant and action."""
        kept = self.waiting.get()
        return pickle.loads(kept[0]) if kept else {}

    def keep(self, known: dict[tuple, tuple], timers: list[int]) -> None:
        """timers: those of the part that haven't run out."""
        first = min((x[2] for x in known.values()), default=None)
        for t in timers:
            if t != first:
                self.handle.deleteTimer(t)
        if first is None:
            self.waiting.clear()
            return
        self.waiting.update((pickle.dumps(known, 4),))
        if first not in timers:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last: dict[tuple, tuple] = {}
        for r in rows:
            values = zip(*[r[c].tolist() for c in ("epoch", "seq", "at_ms", "ttl_action")])
            for entry, x in zip(zip(*[r[c].tolist() for c in ID]), values):
                if entry not in last or last[entry][:2] < x[:2]:
                    last[entry] = x
        known = self.known()
        for entry, x in last.items():
            if entry not in known or known[entry][:2] <= x[:2]:
                if x[2] < 0:
                    known.pop(entry, None)
                else:
                    known[entry] = x
        self.keep(known, list(self.handle.listTimers()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, now = self.known(), timerValues.getCurrentWatermarkInMs()
        due = [(*entry, "expired" if x[3] == "delete" else "stale", x[2]) for entry, x in known.items() if x[2] <= now]
        self.keep({entry: x for entry, x in known.items() if x[2] > now}, [])
        yield pd.DataFrame(due, columns=[*ID, "becomes", "at_ms"])

    def close(self) -> None:
        pass


def expiries(stamped: DataFrame, parts: int = PARTS) -> DataFrame:
    """A stream of what becomes stale or expired as the chains' time moves on.

    ``stamped``: see expiry.stamped(), with epoch and seq, and grace_ms if there is a grace. A batch reads and writes the
    parts that it touches; for many millions of entries that wait at once, take a thousandth of their number as ``parts``.
    A checkpoint holds for one number of parts.
    """
    with_rocks(stamped.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in stamped.schema}
    grace = F.col("grace_ms") if "grace_ms" in stamped.columns else F.lit(0).cast("bigint")
    timed = stamped.withColumn("slot_time", F.timestamp_millis("slot_ts_ms")).withColumn("at_ms", F.coalesce(sat_add(F.col("expires_at_ms"), grace), F.lit(-1).cast("bigint"))).withWatermark("slot_time", "0 seconds")
    # numbers travel as text, as pandas would make inexact ones of a batch with a null
    plain = {c: kinds[c] if kinds[c] in ("string", "binary") else "string" for c in ID}
    part = F.pmod(F.xxhash64(*ID), F.lit(parts)).alias("part")
    due = timed.select(part, *[F.col(c).cast(plain[c]).alias(c) for c in ID], "epoch", "seq", "at_ms", "ttl_action", "slot_time").groupBy("part").transformWithStateInPandas(
        ExpiryTimer(), ", ".join(f"{c} {plain[c]}" for c in ID) + ", becomes string, at_ms bigint", "Append", "EventTime"
    )
    return due.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ID], "becomes", "at_ms")


def late_by(slots: DataFrame, now_ms: int) -> DataFrame:
    """How far each journal's head is behind the clock."""
    return slots.groupBy("journal").agg(F.max("slot_ts_ms").alias("head_ms")).withColumn("behind_ms", sat_sub(F.lit(now_ms), F.col("head_ms")))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ingest(queue: DataFrame, table_path: str, checkpoint: str, slot: Callable[[DataFrame, DataFrame | None], DataFrame]) -> StreamingQuery:
    """Slots the entries of a queue stream: each micro-batch is given its slots after the stored heads and appended.

    ``slot(batch, heads)`` returns the rows to append, with epoch, seq and slot_ts_ms, and refusal for those that are
    not (see writing.append()); heads has journal, epoch, seq, slot_ts_ms, and is None before anything is stored. Rows go
    to table_path, refused ones to table_path-refused, and what the next batch has to know to table_path-state: by journal
    its head, by author the last number. A number at or below the last one was delivered before and is left out. So a
    batch reads as much as there are journals and authors, however long the chains are.

    A batch writes folders of its own number, over what it may have written before, so a restart neither loses nor
    doubles it. So the checkpoint belongs to the table: a new one would count its batches from 0 again.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = heads = None
        for k in range(number - 1, -1, -1):
            if exists(spark, f"{table_path}-state/batch={k}/_SUCCESS"):
                state = spark.read.parquet(f"{table_path}-state/batch={k}")
                heads = state.where("author is null").select("journal", "epoch", "seq", "slot_ts_ms")
                break
        new = batch.dropDuplicates(ID)
        if state is not None:
            last = state.where("author is not null").select("journal", F.col("author").alias("_a"), F.col("last_seq").alias("_last"))
            seen = (new["journal"] == last["journal"]) & (new["author"] == last["_a"]) & (new["author_seq"] <= last["_last"])
            new = new.join(last, seen, "left_anti")
        judged = slot(new, heads)
        refused = F.col("refusal").isNotNull() if "refusal" in judged.columns else F.lit(False)
        judged.where(refused).write.mode("overwrite").parquet(f"{table_path}-refused/batch={number}")
        judged.where(~refused).write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        done = spark.read.schema(judged.schema).parquet(f"{table_path}/batch={number}")
        nothing = lambda *names: [F.lit(None).cast("bigint").alias(n) for n in names]
        authors = done.select("journal", "author", F.col("author_seq").cast("bigint").alias("last_seq"), *nothing("epoch", "seq", "slot_ts_ms"))
        tops = done.select("journal", F.lit(None).cast(done.schema["author"].dataType).alias("author"), *nothing("last_seq"), *[F.col(c).cast("bigint") for c in ("epoch", "seq", "slot_ts_ms")])
        both = authors.union(tops) if state is None else authors.union(tops).unionByName(state.select("journal", "author", "last_seq", "epoch", "seq", "slot_ts_ms"))
        top = F.max(F.struct("epoch", "seq", "slot_ts_ms")).alias("h")
        left = both.groupBy("journal", "author").agg(F.max("last_seq").alias("last_seq"), top).select("journal", "author", "last_seq", "h.*")
        left.write.mode("overwrite").parquet(f"{table_path}-state/batch={number}")

    return queue.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
