"""WARC archives written and read as a table of payload chunks.

Writing: every task streams its rows into one gzip-per-record archive in the shared folder and returns an index row for
each few megabytes of it. Reading: an index row is a unit of work; its records are streamed as (record_id, chunk_no)
rows of bounded size, each with the SHA-1 of the payload so far, so that no record is held as a whole.

Archives are opened through pyarrow's file systems (file, hdfs, s3, gs URIs), so they lie wherever the cluster's shared
folder is. An archive's name holds a random part: a task that runs twice writes two archives, and only the one whose
index rows were kept is read.

The reader takes any archive of version 1, of gzip members or plain, with records of all types; archive_index() lists
those of a folder that others have written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, materialise, numbered, place_of, shared_dir

#: Bytes of payload in one chunk row, of archive in one index row, and of one read.
CHUNK, SEGMENT, READ = 1 << 16, 2 << 20, 1 << 16
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 1000
#: Over so many parts the rows of one payload are spread when its response is looked up.
SALTS = 32
#: A block whose HTTP head doesn't end within this many bytes has none: all of it is payload. WARC headers, which are
#: held as a whole, may have any length.
MOST_HTTP = 1 << 20
#: The types of records whose block starts with an HTTP head if its content type says so.
WITH_HTTP = ("response", "request", "revisit")


class WarcError(ValueError):
    pass


# --- which record is which ----------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1), n_bytes, refers_to (null: a response).

    Of the rows with equal payloads of at least ``least`` bytes, those with the largest page_id are responses and the
    others refer to it. Rows are counted by (digest, salt) first and the result is joined by (digest, salt), so a
    payload that a third of all rows share is spread over SALTS tasks. Only repeated payloads are in that table.
    Payloads must not be null. Rows with a null page_id are never referred to; rows that repeat the largest page_id of
    their payload are responses too. No rows, no rows.
    """
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    rows = pages.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("salt", salt)
    parts = rows.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes", "salt").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = parts.groupBy("digest", "n_bytes").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    repeated = groups.where("n > 1 and last is not null").select("digest", "n_bytes", "last", F.explode("salts").alias("salt"))
    found = rows.join(materialise(repeated, "warc-repeated"), ["digest", "n_bytes", "salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return found.select("page_id", "url", "payload", "digest", "n_bytes", refers.alias("refers_to"))


# --- writing ------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    """The WARC-Record-ID of a page: a version 8 UUID that holds the page_id; the all-zero UUID for a null one."""
    low = (page_id or 0) & ((1 << 64) - 1)
    value = 0 if page_id is None else (low >> 16 << 80) | (8 << 76) | (2 << 62) | (low & 0xFFFF)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def one_line(s: str | None) -> str:
    """A header value: whatever could end the line is dropped."""
    return "".join(c for c in s or "" if c not in "\r\n\0")


def head_of(page_id: int | None, url: str | None, n: int, digest: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header that stands before the payload."""
    http = b"" if refers_to is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n}",
    ]
    if refers_to is None:
        lines.append("Content-Type: application/http;msgtype=response")
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (n if refers_to is None else 0)}")
    return "\r\n".join([*lines, "", ""]).encode(), http


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Index rows (archive, start, stop, n_records) of the archives that the rows of with_revisits() are written to.

    The result is written to the shared folder at once, so that the archives are written once. Null urls, digests and
    payloads are written as empty ones; a payload or url of any length is one record; repeated rows are records each.
    Without rows there is no archive and no index row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        index: list[tuple[str, int, int, int]] = []
        at = start = n = 0
        out = None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, digest, refers_to = (row[k].as_py() for k in (0, 1, 3, 4))
                payload = memoryview(row[2].as_buffer() or b"")
                gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                for part in head_of(page_id, url, len(payload), digest, refers_to):
                    at += out.write(gz.compress(part))
                for k in range(0, 0 if refers_to is not None else len(payload), CHUNK):
                    at += out.write(gz.compress(payload[k : k + CHUNK]))
                at += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                n += 1
                if at - start >= SEGMENT:
                    index.append((name, start, at, n))
                    start, n = at, 0
        if n:
            index.append((name, start, at, n))
        if out:
            out.close()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], ["archive", "start", "stop", "n_records"])

    return materialise(arrow_pass(records, run, "archive string, start long, stop long, n_records long"), "warc-index")


# --- reading ------------------------------------------------------------------------------------------------------


class Members:
    """The bytes of an archive's records, read in pieces of bounded size: of consecutive gzip members, or as they are."""

    def __init__(self, raw, stop: int):
        self.raw, self.stop, self.buffer, self.rest = raw, stop, bytearray(), b""
        start = raw.tell()
        self.packed = raw.read(min(2, stop - start)) == b"\x1f\x8b"
        raw.seek(start)
        self.gz = zlib.decompressobj(31)

    def more(self) -> bool:
        """Adds at most READ bytes to the buffer; False at the end."""
        while True:
            if self.packed and self.gz.eof:
                self.rest, self.gz = self.gz.unused_data or self.rest, zlib.decompressobj(31)
            if self.packed and not self.rest and (got := self.gz.decompress(b"", READ)):
                self.buffer += got
                return True
            if not self.rest:
                left = self.stop - self.raw.tell()
                if left <= 0:
                    return False
                self.rest = self.raw.read(min(READ, left))
                if not self.rest:
                    raise WarcError("the archive is shorter than its index says")
            if not self.packed:
                self.buffer += self.rest
                self.rest = b""
                return True
            try:
                got = self.gz.decompress(self.rest, READ)
            except zlib.error as e:
                raise WarcError(f"the archive's compression is broken: {e}") from None
            self.rest = self.gz.unconsumed_tail or (self.gz.unused_data if self.gz.eof else b"")
            if got:
                self.buffer += got
                return True

    def head(self, most: int | None = None) -> bytes | None:
        """The bytes up to and with an empty line; None at the end, or if there is none within ``most`` bytes."""
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3), most)) < 0:
            seen = len(self.buffer)
            if most is not None and seen >= most:
                return None
            if not self.more():
                if self.buffer and most is None:
                    raise WarcError("a record is cut off")
                return None
        out = bytes(self.buffer[: end + 4])
        del self.buffer[: end + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of at most CHUNK."""
        while n:
            while len(self.buffer) < min(n, CHUNK):
                if not self.more():
                    raise WarcError("a record is cut off")
            piece = bytes(self.buffer[: min(n, CHUNK)])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def fields_of(head: bytes) -> dict[str, str]:
    """The named fields of a WARC header, names in lower case; a line that starts with white space goes on with the one
    before, and the first of several fields of a name counts."""
    lines = head[:-4].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise WarcError("a record doesn't start with its version")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += f" {line.strip()}"
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        if name in out:
            name = ""  # and what goes on with it is dropped too
        else:
            out[name] = value.strip()
    return out


def sha1_of(said: str | None) -> str | None:
    """A labelled SHA-1 as lower-case hex, from hex or base32; null for another algorithm or what is none."""
    label, _, value = (said or "").partition(":")
    if label.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def read_chunks(raw, stop: int) -> Iterator[dict]:
    """The chunk rows of the records between the file's place and stop.

    The payload is the block, without the HTTP head that a request or response starts with. Its digest and length are
    those of the bytes read; a SHA-1 in the header must be theirs, and so must this module's own X-Payload-Length.
    Those of a revisit are the header's (null if it has none), as its payload is elsewhere.
    """
    stream = Members(raw, stop)
    while (head := stream.head()) is not None:
        said = fields_of(head)
        try:
            size = int(said["content-length"])
            length = int(said["x-payload-length"]) if "x-payload-length" in said else None
            row = {"record_id": said["warc-record-id"], "record_type": said["warc-type"]}
        except (KeyError, ValueError) as e:
            raise WarcError(f"a header lacks a field or its number: {e}") from None
        if size < 0:
            raise WarcError("a block's length is negative")
        digest = sha1_of(said.get("warc-payload-digest"))
        row |= {"target_uri": said.get("warc-target-uri"), "refers_to": said.get("warc-refers-to")}
        left = size
        if row["record_type"] in WITH_HTTP and said.get("content-type", "").lower().startswith("application/http"):
            http = stream.head(min(size, MOST_HTTP))
            left -= len(http or b"")
        else:
            digest = digest or sha1_of(said.get("warc-block-digest"))
        if row["record_type"] == "revisit":
            for _ in stream.take(left):
                pass
            yield row | {"chunk_no": 0, "is_last": True, "data": b"", "bytes_so_far": length, "sha1_so_far": digest}
        else:
            sha, n = hashlib.sha1(usedforsecurity=False), 0
            for k, piece in enumerate(stream.take(left) if left else [b""]):
                sha.update(piece)
                n += len(piece)
                yield row | {"chunk_no": k, "is_last": n == left, "data": piece, "bytes_so_far": n, "sha1_so_far": sha.hexdigest()}
            if n != (n if length is None else length) or sha.hexdigest() != (digest or sha.hexdigest()):
                raise WarcError(f"the payload of {row['record_id']} isn't what its header says")
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise WarcError("a record doesn't end with two empty lines")


FIELDS = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "chunk_no": pa.int64(), "is_last": pa.bool_(), "data": pa.binary(), "bytes_so_far": pa.int64(), "sha1_so_far": pa.string()}


def chunk_table(index: DataFrame, folder: str, data: bool = True) -> DataFrame:
    """The chunk rows of all archives of an index; without ``data`` they lack the payload's bytes.

    Each index row (archive, start, stop, n_records; null: any number) is a unit of work. Damage fails the read. A null
    in a header is an absent field; an empty payload is one row; no index rows, no rows.
    """
    fields = {k: v for k, v in FIELDS.items() if data or k != "data"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in fields.items()], list(fields))
        for batch in batches:
            for part in batch.to_pylist():
                with store.open_input_file(f"{root}/{part['archive']}") as raw:
                    raw.seek(part["start"])
                    rows, records = [], 0
                    for row in read_chunks(raw, part["stop"]):
                        records += row["is_last"]
                        rows.append(row)
                        if len(rows) >= (64 if data else 4096):
                            yield batch_of(rows)
                            rows = []
                    if part["n_records"] not in (None, records):
                        raise WarcError("an archive doesn't hold the records that its index names")
                    if rows:
                        yield batch_of(rows)

    schema = ", ".join(f"{k} {'string' if v == pa.string() else 'boolean' if v == pa.bool_() else 'binary' if v == pa.binary() else 'bigint'}" for k, v in fields.items())
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_pass(index.repartition(parts, "archive", "start"), run, schema)


def archive_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows of all archives (.warc, .warc.gz) below a folder, whoever wrote them; an archive is one unit of work.

    Only names and sizes are read on the driver. An empty folder gives no rows.
    """
    store, root = fs.FileSystem.from_uri(folder)
    found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]
    rows = [(f.path[len(root) :].lstrip("/"), 0, f.size, None) for f in sorted(found, key=lambda f: f.path)]
    return spark.createDataFrame(rows, "archive string, start long, stop long, n_records long")


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes a record per row and returns the index of the archives and their folder.

    A null payload is empty; a null url is an empty one. Rows with a null id are responses unless an equal payload has
    an id; rows that repeat the largest id of their payload are all responses. An empty table writes no archive. Other
    columns, whatever they are called, are not read. The archives stay in the shared folder until it is cleaned.
    """
    page_id, url, html = (F.col(f"c{place_of(df, c)}") for c in (id_col, url_col, html_col))
    pages = numbered(df).select(page_id.cast("long").alias("page_id"), url.cast("string").alias("url"), F.coalesce(html.cast("string"), F.lit("")).cast("binary").alias("payload"))
    folder = folder or shared_dir(df.sparkSession, "warc")
    return write_archives(with_revisits(pages, least), folder), folder


def page_column(record: Column) -> Column:
    """page_id out of a record id: the inverse of record_id()."""
    plain = F.regexp_replace(F.regexp_extract(record, "uuid:([0-9a-f-]+)", 1), "-", "")
    low = F.concat(F.substring(plain, 1, 12), F.substring(plain, 29, 4))
    return F.when(plain != "0" * 32, F.conv(low, 16, -10).cast("long"))
