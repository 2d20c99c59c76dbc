"""Prefix computations along a chain without one task per journal.

A chain is cut into buckets of at most BUCKET consecutive numbers of one epoch. Each bucket is sorted by itself; what it
takes from before comes in as a row of a small table, which has one row per bucket (a millionth of the slots) and is
the only thing that is ordered per journal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of one bucket at most; numbers are dense within an epoch.
BUCKET = 1 << 20


def bucket(seq: str = "seq") -> Column:
    return F.floor(F.col(seq) / F.lit(BUCKET)).cast("bigint")


def lagged(slots: DataFrame, values: dict[str, Column], key: str = "journal") -> DataFrame:
    """slots with columns of the given names: the values of the row before, by (epoch, seq); null for the first.

    Values must not be null. Rows at equal positions stand in no defined order.
    """
    names = list(values)
    rows = slots.withColumn("_b", bucket()).withColumn("_v", F.struct(*[v.alias(n) for n, v in values.items()]))
    ends = rows.groupBy(key, "epoch", "_b").agg(F.max_by("_v", "seq").alias("_end"))
    carried = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(key).orderBy("epoch", "_b"))).drop("_end")
    within = Window.partitionBy(key, "epoch", "_b").orderBy("seq")
    out = rows.join(carried, [key, "epoch", "_b"]).withColumn("_p", F.coalesce(F.lag("_v").over(within), F.col("_carry")))
    return out.select(*[F.col(f"`{c}`") for c in slots.columns], *[F.col(f"_p.{n}").alias(n) for n in names])


def last_known(slots: DataFrame, facts: DataFrame, columns: list[str], inclusive: bool, key: str = "journal") -> DataFrame:
    """slots with ``columns``: of each the last value that isn't null among the facts before the slot (or at it).

    facts: key, epoch, seq and the columns, one row per position. Only facts at the positions of slots count.
    """
    placed = slots.withColumn("_b", bucket())
    known = facts.select(key, "epoch", "seq", *[F.col(c).alias(f"_{c}") for c in columns])
    # of each bucket with facts the last value by column; then, over buckets, the last one before
    ends = known.withColumn("_b", bucket()).groupBy(key, "epoch", "_b").agg(*[F.max_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns])
    before = Window.partitionBy(key).orderBy("epoch", "_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.select(key, "epoch", "_b").distinct().join(ends, [key, "epoch", "_b"], "left")
    carried = buckets.select(key, "epoch", "_b", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns])
    within = Window.partitionBy(key, "epoch", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = placed.join(known, [key, "epoch", "seq"], "left").join(carried, [key, "epoch", "_b"])
    found = [F.coalesce(F.last(f"_{c}", ignorenulls=True).over(within), F.col(f"_carry_{c}")).alias(c) for c in columns]
    return rows.select(*[F.col(f"`{c}`") for c in slots.columns], *found)


def numbered(rows: DataFrame, name: str, first: Column | None = None, key: str = "journal") -> DataFrame:
    """rows with their number (from 1) within the journal, by (first, epoch, seq); ``first`` defaults to a constant."""
    placed = rows.withColumn("_f", F.lit(0) if first is None else first).withColumn("_b", bucket())
    counts = placed.groupBy(key, "_f", "epoch", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_f", "epoch", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(key, "_f", "epoch", "_b").orderBy("seq")
    out = placed.join(starts, [key, "_f", "epoch", "_b"]).withColumn(name, (F.col("_start") + F.row_number().over(within)).cast("bigint"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], name)
