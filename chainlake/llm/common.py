"""Helpers shared by the training-data operators: table access, Arrow passes, the shared folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows in one Arrow batch handed to Python; texts may be long, so the default of 10,000 is too many.
ROWS_PER_BATCH = 1000
#: An Arrow batch is closed early once it holds this many bytes.
BYTES_PER_BATCH = 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the memory of one Arrow batch (a session setting that may change at any time), and ships the package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def place_of(df: DataFrame, name: str) -> int:
    """Which column a name means: the one that is called so, else the only one that differs from it in case."""
    same = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(same) != 1:
        raise ValueError(f"{'no' if not same else 'more than one'} column {name!r} in {df.columns}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ...: whatever they are called, no name clashes with another, in any case."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text is the empty text.

    Selecting first keeps extra columns, whatever their names, out of the operator.
    """
    doc_id, text = (F.col(f"c{place_of(df, c)}") for c in (id_col, text_col))
    return numbered(df).select(doc_id.alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def kept_columns(df: DataFrame, new: Iterable[str]) -> list[int]:
    """Places of the columns that stay when columns called ``new``, in any case, are replaced."""
    gone = {c.lower() for c in new}
    return [k for k, c in enumerate(df.columns) if c.lower() not in gone]


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of numbered(df); maps and variants by their JSON, as they have no hash of their own."""
    plain = lambda f: F.to_json(f.name) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col(f.name)
    return F.xxhash64(*[plain(f) for f in numbered(df).schema])


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """A narrow (shuffle-free) pass over Arrow batches in the Python workers."""
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is the cluster's. Only where it is unset and everything runs on one machine (tests) a folder for
    temporary files is used; on a cluster that would lose rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "chainlake-shared")
    return f"{base.rstrip('/')}/chainlake/{what}-{uuid.uuid4().hex}"


class _Folders(threading.local):
    """Folders that materialise() has written for this thread's work and nobody has deleted yet, the oldest first."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Folders()


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors. See discard()."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    _written.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many folders of this thread materialise() has written that are still there: a place for discard()."""
    return len(_written.paths)


def discard(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Deletes this thread's folders from place ``first`` on, up to ``last`` (not included), or all.

    For when a result has been written: operators return DataFrames that still read these folders.
    """
    for path in _written.paths[first:last]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written.paths[first:last]
