"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, line_dedup, packing, pii, quality, secret_scan, simhash, tiff, token_count, warc
from .common import id_and_text, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a multi-page TIFF, read back page by page."""
    texts = id_and_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    media = tiff.write_payloads(texts.select("doc_id", F.col("text").cast("binary").alias("payload")))
    return tiff.tiff_digests(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-pair tokens of every text."""
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; digests of both."""
    return bpe_codec.codec_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, which are read back as chunk rows (their bytes stay with the reader); of
    each record its last row, which has the digest of the whole payload."""
    index, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    last = warc.chunk_table(index, folder, data=False).where("is_last")
    return last.select(
        warc.page_column(F.col("record_id")).alias("page_id"),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("sha1_so_far").alias("payload_digest"),
        "record_type",
        warc.page_column(F.col("refers_to")).alias("refers_to"),
    )


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal values replaced under the session's key, and counts by kind."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return pii.pseudonymise(documents, pii.key_of(spark)).drop("lang")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in sequences of 2048 tokens, a row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), window=2048)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the group of every text."""
    found = simhash.groups(table(spark, sf_dir, "documents"), words=3, bits=64, radius=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.verdicts(documents, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines of ten documents or more, as a digest."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.dedup_lines(documents, threshold=10, least=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_tiff_media, op2_token_counts, op3_bpe_codec, op4_warc_chunks, op5_pseudonyms, op6_packing, op7_simhash, op8_secret_scan, op9_quality, op10_line_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_chunks": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM g""",
    "op10_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN r END) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM f)) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
        FROM k GROUP BY r, doc_id""",
}
