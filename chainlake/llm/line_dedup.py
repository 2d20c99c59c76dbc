"""Line dedup: lines that too many documents share are dropped everywhere.

Lines are normalised and exploded, their 128-bit hashes are counted by distinct document, and the hashes over the
threshold form a table. Exploded again, each document finds its lines in that table; the positions to drop come back
to the document, which is put together from the others in order. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, materialise, numbered, place_of

#: The white space of a line's ends, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents in which a line is dropped.
THRESHOLD = 10


def line_key(line: Column) -> Column:
    """What makes two lines the same."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hash128(key: Column) -> list[Column]:
    """Two 64-bit hashes of different seeds: lines of different keys don't meet."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def frequent_lines(texts: DataFrame, threshold: int = THRESHOLD, least: int = 1) -> DataFrame:
    """h1, h2 of the keys of at least ``least`` characters that occur in ``threshold`` documents or more.

    texts: doc_id, text. A document counts once for each of its keys. The explode is of a row's distinct keys, and rows
    are counted, combined before the shuffle, which makes a line that all documents hold as cheap as any other. Rows
    that share an id are one document: their lines (``again``: id, hashes, rows beyond the first) are taken off.
    """
    row_keys = lambda rows: rows.select("doc_id", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_key))).alias("key")).where(F.char_length("key") >= least)
    rows = row_keys(texts).select(*hash128(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    several = materialise(texts.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated-ids")
    if not several.isEmpty():
        again = row_keys(texts.join(several, "doc_id", "left_semi")).select("doc_id", *hash128(F.col("key"))).groupBy("doc_id", "h1", "h2").agg((F.count("*") - 1).alias("more")).where("more > 0")
        again = again.groupBy("h1", "h2").agg(F.sum("more").alias("more"))
        rows = rows.where(F.col("n") >= threshold).join(again, ["h1", "h2"], "left").select("h1", "h2", (F.col("n") - F.coalesce("more", F.lit(0))).alias("n"))
    return rows.where(F.col("n") >= threshold).select("h1", "h2")


def dropped_lines(texts: DataFrame, frequent: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, t1, t2 (hashes of the whole text) and the positions to drop, for the documents that have any."""
    lines = texts.select("doc_id", "t1", "t2", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least).select("doc_id", "t1", "t2", "at", *hash128(F.col("key")))
    found = keyed.join(frequent, ["h1", "h2"], "left_semi")
    return found.groupBy("doc_id", "t1", "t2").agg(F.collect_set("at").alias("gone"))


def dedup_lines(df: DataFrame, threshold: int = THRESHOLD, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df, with the text as it is left, and n_lines and n_dropped (long).

    A null or empty text is one empty line. A line's key is the line without white space at both ends and with A-Z in
    lower case; empty keys are never dropped. A text that loses all lines is empty. Rows that share an id are one
    document for the count of documents, and each row with a null id is one of its own; every row loses its frequent
    lines, so repeated rows get the same result. Names are matched by case only if two columns differ in nothing else.
    Columns of df that are called n_lines or n_dropped, in any case, are replaced. An empty table gives an empty result.

    The small tables (ids of several rows; frequent lines; positions by document that has such lines) are written to
    the shared folder. Their size is then known, and Spark broadcasts them only below
    spark.sql.autoBroadcastJoinThreshold; beyond, the joins shuffle, and AQE splits what a very frequent line brings
    together.
    """
    at_id, at_text = place_of(df, id_col), place_of(df, text_col)
    rows = numbered(df)
    whole = rows.withColumn("text", F.coalesce(F.col(f"c{at_text}").cast("string"), F.lit("")))
    own = [F.col(f"c{at_id}").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")]
    texts = whole.select(*own)
    frequent = materialise(frequent_lines(texts.select("doc_id", "text"), threshold, least), "frequent-lines")
    gone = materialise(dropped_lines(texts, frequent, least), "dropped-lines").withColumnRenamed("doc_id", "gone_id")
    on = F.col(f"c{at_id}").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("t1")) & (F.xxhash64(F.lit("text"), "text") == F.col("t2"))
    split = lines_of(F.col("text"))
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    # the outer transform binds the split lines, which else would be split again for each of them
    put_together = F.transform(F.array(split), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))[0]
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(put_together)
    counts = {"n_lines": F.size(split).cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    stays = kept_columns(df, counts)
    return whole.join(gone, on, "left").select(*[kept if k == at_text else F.col(f"c{k}") for k in stays], *counts.values()).toDF(*[df.columns[k] for k in stays], *counts)
