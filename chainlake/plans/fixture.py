"""A journal derived from the ``events`` table, and cluster tables derived from the others: test and bench input.

Eight journals by user. Every row of ``events`` becomes a slot; what kind it is follows from its place and its type.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import le_bytes
from ..operators import expiry, settings

HOUR = 3600000
START, TERM = 1704067200000, 864000000
MID, END = 1705276800000, 1706659200000
KEYS = ["ttl.enforce", "ttl.default_ms", "ttl.max_ms", "ttl.action", "ttl.grace_ms", "stale.enforce", "stale.cleanup"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all runs on one machine, one for temporary files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chainlake-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
    return f"{base.rstrip('/')}/chainlake-engine/{what}-{uuid.uuid4().hex}"


#: By application, input and name the folder and schema of a table that is stored once and read by all queries.
_stored: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table as a store keeps it: files by journal, sorted by position, so that predicates prune folders and row groups."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        folder = work_folder(spark, name)
        df = make()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(parts, "journal", "epoch").sortWithinPartitions("journal", "epoch", "seq").write.partitionBy("journal").parquet(folder)
        _stored[key] = folder, df.schema
    folder, schema = _stored[key]
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journals' slots, from the stored table."""
    return stored(spark, sf_dir, "slots", lambda: derived(spark, sf_dir))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots as they follow from events."""
    e = load(spark, sf_dir, "events").select(
        "event_id", "event_type",
        F.concat(F.lit("j"), (F.col("user_id") % 8).cast("string")).alias("journal"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("slot_ts_ms"),
        F.col("user_id").alias("author"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.col("props").alias("payload"),
    )
    order = ["slot_ts_ms", "event_id"]
    e = e.withColumn("epoch", (1 + F.floor((F.col("slot_ts_ms") - START) / TERM)).cast("bigint"))
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("journal", "epoch").orderBy(*order)).cast("bigint"))
    by_author = Window.partitionBy("journal", "author").orderBy(*order)
    e = e.withColumn("author_seq", F.row_number().over(by_author).cast("bigint"))
    kind = F.when(F.col("seq") % 40 == 0, "checkpoint").when(F.col("event_type") == "error", "stale").when((F.col("event_type") == "signup") & (F.col("k") < 5), "settings").otherwise("data")
    e = e.withColumn("kind", kind).withColumn("ttl_ms", F.when(F.col("kind") == "data", F.col("k") * HOUR).otherwise(0)).withColumn("payload_len", F.octet_length("payload").cast("bigint"))
    last_data = F.last(F.when(F.col("kind") == "data", F.col("author_seq")), ignorenulls=True).over(by_author.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("target_seq", F.when(F.col("kind") == "stale", last_data)).withColumn("target_author", F.when(F.col("kind") == "stale", F.col("author")))
    e = e.withColumn("entry_hash", F.sha2(F.concat_ws("|", "journal", "author", "author_seq", "kind", "ttl_ms", "payload"), 256))
    e = e.withColumn("slot_hash", F.sha2(F.concat_ws("|", "journal", "epoch", "seq", "slot_ts_ms", "entry_hash"), 256))
    chain = Window.partitionBy("journal").orderBy("epoch", "seq")
    e = e.withColumn("prev_slot_hash", F.coalesce(F.lag("slot_hash").over(chain), F.lit("0" * 64)))
    return e.withColumn("leader", (F.col("epoch") * 3 + F.col("author") % 8) % 15)


def changes(s: DataFrame) -> DataFrame:
    """The settings changes of the settings records: journal, epoch, seq, key, value."""
    k = F.col("k")
    value = {
        "ttl.enforce": F.get(F.array(F.lit("off"), F.lit("per_entry"), F.lit("all")), (k % 3).cast("int")),
        "ttl.default_ms": ((k + 1) * HOUR).cast("string"),
        "ttl.max_ms": F.when(k >= 3, F.lit("172800000")),
        "ttl.action": F.when(k.isin(1, 4), "delete").when(k == 2, "mark_stale"),
        "ttl.grace_ms": F.when(k == 3, F.lit("3600000")),
        "stale.enforce": F.when(k == 0, "off").otherwise("author"),
        "stale.cleanup": F.when(k % 2 == 0, "delete").otherwise("keep"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in value.items()])
    return s.where("kind = 'settings'").select("journal", "epoch", "seq", F.explode(pairs).alias("c")).select("journal", "epoch", "seq", "c.*").where("value is not null")


def in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slots with the settings in force before each."""
    s = slots(spark, sf_dir)
    return settings.in_force(s, changes(s), KEYS)


def info(stamped: DataFrame) -> DataFrame:
    return expiry.entry_info(stamped, expiry.stale_marks(stamped))


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stamped slots, the facts about entries, and the removal of each removed entry; the slots are stamped once and stored."""
    stamped = stored(spark, sf_dir, "stamped", lambda: expiry.stamped(in_force(spark, sf_dir)))
    known = info(stamped)
    return stamped, known, expiry.removals(known, stamped.where("kind = 'checkpoint'"))


def slotted_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stamped slots and behind them a fifth term, in which every twentieth data entry is slotted again, an hour after
    another, and every 40th event is one more checkpoint, by an author of its own."""
    stamped = stored(spark, sf_dir, "stamped", lambda: expiry.stamped(in_force(spark, sf_dir)))
    again = stamped.where("event_id % 20 = 3 and kind = 'data'")
    more = stamped.where("event_id % 40 = 1").withColumn("kind", F.lit("checkpoint")).withColumn("author_seq", F.col("author_seq") + 1000000)
    late = again.union(more)
    late = late.withColumn("epoch", F.lit(5).cast("bigint")).withColumn("seq", F.row_number().over(Window.partitionBy("journal").orderBy("event_id")).cast("bigint"))
    late = late.withColumn("slot_ts_ms", END + F.col("seq") * HOUR)
    # what is slotted again is stamped with the settings in force there; all that matters is the journal's last state
    last = settings.current(changes(stamped), stamped.select("journal").distinct()).where(F.col("key").isin(*KEYS)).groupBy("journal").pivot("key", KEYS).agg(F.first("value"))
    last = last.toDF("journal", *[settings.column_of(k) for k in KEYS])
    plain = late.drop(*[settings.column_of(k) for k in KEYS], "effective_ttl_ms", "expires_at_ms", "ttl_action").join(last, "journal")
    return stamped.unionByName(expiry.stamped(plain).select(*stamped.columns))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cluster's members look like to an election; clusters by nation."""
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") % 5).cast("bigint").alias("cluster"), key.alias("member"), F.lower(F.lpad(F.hex(key), 32, "0")).alias("hex_id"),
        F.concat(F.lit("host-"), key.cast("string"), F.lit(":7000")).alias("address"), (1 + key % 3).alias("joined_epoch"), key.alias("joined_seq"),
        F.when(F.col("s_acctbal") > 0, "member").otherwise("lost").alias("state"), (1 + F.col("s_nationkey") % 3).cast("bigint").alias("ack_epoch"), (key * 7 % 50).alias("ack_seq"),
    )


def authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier by address, every fourth by id."""
    v = views(spark, sf_dir)
    a = v.where("member % 3 = 0").select("cluster", (F.col("member") % 11).alias("place"), F.col("address").alias("authority"))
    return a.union(v.where("member % 4 = 0").select("cluster", (F.col("member") % 7).alias("place"), F.col("hex_id").alias("authority")))


def member_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins and leaves: sign-ups and errors of users, in five clusters."""
    s = slots(spark, sf_dir).where("event_type in ('signup', 'error')")
    return s.select((F.col("author") % 5).alias("cluster"), "epoch", F.col("event_id").alias("seq"), F.col("author").alias("member"), F.when(F.col("event_type") == "signup", "join").otherwise("leave").alias("what"), F.concat(F.lit("host-"), F.col("k").cast("string")).alias("address"))


def control_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control chain for each journal, in its stored form: a genesis, then joins, leaves and new journals by the founder."""
    key = lambda m: F.unhex(F.sha2(m.cast("string").cast("binary"), 256))
    member = lambda m: F.substring(F.unhex(F.sha2(key(m), 256)), 1, 16)
    no_changes, founder = F.lit(b"\0\0"), F.lit(-1)
    m = F.col("author") % 12
    address = F.concat(F.lit("host-"), m.cast("string"))
    # every tenth join comes with another member's key
    joins = F.concat(member(m), key(F.when(F.col("k") % 10 == 9, m + 100).otherwise(m)), le_bytes(F.octet_length(address), 2), address.cast("binary"))
    name = F.concat(F.lit("name-"), F.col("k").cast("string"))
    creates = F.concat(F.substring(F.unhex(F.sha2(name.cast("binary"), 256)), 1, 16), le_bytes(F.octet_length(name), 2), name.cast("binary"), no_changes)
    s = slots(spark, sf_dir).where("event_type in ('signup', 'error') or (event_type = 'purchase' and k < 10)")
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "leave").otherwise("create_journal")
    payload = F.when(kind == "join", joins).when(kind == "leave", member(m)).otherwise(creates)
    order = Window.partitionBy("journal").orderBy("event_id")
    rows = s.select("journal", (F.row_number().over(order) + 1).cast("bigint").alias("seq"), "slot_ts_ms", kind.alias("kind"), payload.alias("payload"))
    first = slots(spark, sf_dir).select("journal").distinct().select("journal", F.lit(1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("slot_ts_ms"), F.lit("genesis").alias("kind"), F.concat(key(founder), no_changes).alias("payload"))
    every = first.union(rows)
    untested = [F.lit(None).cast("boolean").alias(c) for c in ("signature_ok", "slot_signature_ok", "payload_ok")]
    return every.select(
        F.col("journal").alias("cluster"), F.lit(1).cast("bigint").alias("epoch"), "seq", "slot_ts_ms", "kind", member(founder).alias("author"), F.col("seq").alias("author_seq"),
        F.unhex(F.sha2(F.concat(F.col("payload"), le_bytes(F.col("seq"), 8)), 256)).alias("entry_hash"), F.col("journal").cast("binary").alias("entry_journal"), member(founder).alias("slot_leader"), "payload", *untested, F.lit(None).cast("string").alias("refusal"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir)
    return s.select("journal", F.col("author").alias("member"), F.col("slot_ts_ms").alias("heard_ms"), F.col("epoch").alias("head_epoch"), F.col("author_seq").alias("head_seq")).withColumnRenamed("journal", "cluster")


def branch(s: DataFrame) -> DataFrame:
    """A losing branch: from the last term on, every other entry, with hashes of its own."""
    b = s.where("epoch >= 2 and event_id % 2 = 1")
    return b.withColumn("slot_hash", F.sha2(F.concat("slot_hash", F.lit("b")), 256))


def survivor(s: DataFrame) -> DataFrame:
    """What the winning side has: all of the first term, and of the others what the branch has in every third."""
    return s.where("epoch < 2 or event_id % 2 = 0 or event_id % 3 = 0")
