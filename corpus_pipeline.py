"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, with n_chars that of the text as it then is; columns that
docs has besides are left behind, whatever they are called. In every stage an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm import line_dedup, packing, pii, quality, simhash
from chainlake.llm.common import discard, materialise, numbered, place_of, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def taken(df: DataFrame) -> DataFrame:
    """The columns of documents alone; names are matched by case only if two columns differ in nothing else."""
    return numbered(df).select(*[F.col(f"c{place_of(df, c)}").alias(c) for c in COLUMNS])


def documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the n-gram model reject go.

    Null and empty texts are rejected. Each row is judged by its text, so repeated rows stay or go together, also with
    null ids; a text of any length is judged as a whole; a score at the threshold stays.
    """
    return documents(quality.judge_documents(taken(docs), table(spark, sf_dir, "labels")).where("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go, in all documents; no row goes.

    A null text becomes an empty one, and so does a text that loses all lines. Rows that share an id count as one
    document, rows with null ids as one each; repeated rows get the same result.
    """
    return documents(line_dedup.dedup_lines(taken(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike (5-word shingles, similarity 0.8) the one with the smallest id stays.

    Null texts and texts without words are alike. Ties on the id go by text, then by the whole row; of rows that are
    equal in everything one stays; a row with a null id stays only if no row of its group has an id.
    """
    return documents(simhash.one_of_each(taken(docs)))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become others of their format; no row goes.

    Null texts stay null and empty ones empty; equal values get equal pseudonyms in all rows, so repeated rows stay
    equal. The key is read from spark.chainlake.pseudonymKey.
    """
    return documents(pii.pseudonymise(taken(docs), pii.key_of(spark), counts=False))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, of documents that share telling words.

    Null and empty texts are their end id alone; long texts are cut over sequences; repeated rows are packed each, and
    ties are broken by id and tokens.
    """
    return packing.pack(taken(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("packing", pack),
]

#: SQL expresses neither the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage has written for itself is deleted once its result is written, and a
    stage's result once the next one's is; the last stage's folders stay, as its result is read from them."""
    docs = table(spark, sf_dir, "documents")
    place = written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, place, written() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
