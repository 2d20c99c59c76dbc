"""TIFF as a media column: write multi-page files, walk their image directories, one row per page.

Reads II and MM files; strips and tiles; no compression, PackBits, LZW and Deflate; predictors 1 and 2; 1, 2, 4, 8 and 16
bits a sample; any number of samples, interleaved or in planes. A page that asks for something else gives a row with
``error`` set, and the pages behind it are read all the same; a chain of directories that breaks off gives such a row at
its end. Never a crash, and never more memory than a page and its blocks need.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, numbered, place_of

#: TIFF 6.0 tags and codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, PLANAR, FILL_ORDER = 322, 323, 324, 325, 284, 266
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
FIELD = {1: "B", 3: "H", 4: "I"}
CLEAR, END = 256, 257

#: The payload image: samples in a row, rows in a page, rows in a strip, side of a tile.
ROW, PAGE_ROWS, STRIP_ROWS, TILE = 64, 1024, 128, 64
#: Ways in which pages are stored, in turn: compression, tiles or strips, predictor.
WAYS = ((PACKBITS, False, 1), (DEFLATE, True, 2), (LZW, False, 1), (PACKBITS, True, 1), (DEFLATE, False, 1), (LZW, True, 2))
#: A tile may be wider or higher than twice the page up to this side; beyond, a file is hostile.
LARGE_TILE = 4096
#: Bytes of a page's samples at most: a row's cell holds no more.
MOST_BYTES = (1 << 31) - 1


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples


# --- codecs -------------------------------------------------------------------------------------------------------


def packbits_encode(rows: np.ndarray) -> bytes:
    """Each row by itself, as the format asks."""
    raw = rows.tobytes()
    width = rows.shape[1]
    if width <= 128 and not re.search(rb"(.)\1\1", raw, re.S):
        return np.insert(rows, 0, width - 1, axis=1).tobytes()
    out = bytearray()
    for i in range(0, len(raw), width):
        row, at = raw[i : i + width], 0
        for m in re.finditer(rb"(.)\1{2,127}", row, re.S):
            for k in range(at, m.start(), 128):
                part = row[k : min(k + 128, m.start())]
                out.append(len(part) - 1)
                out += part
            out += bytes((257 - len(m[0]), m[1][0]))
            at = m.end()
        for k in range(at, width, 128):
            part = row[k : k + 128]
            out.append(len(part) - 1)
            out += part
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = [], 0, len(data)
    got = 0
    while got < size and i < n:
        k = data[i]
        if k < 128:
            part = data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k > 128:
            part = data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
            continue
        out.append(part)
        got += len(part)
    return b"".join(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: one more as soon as the table has 511, 1023, 2047 entries."""
    return np.searchsorted([511, 1023, 2047], np.arange(258, 258 + n), "right") + 9


WIDTHS = _widths(4096 - 256)
STARTS = np.concatenate([[0], np.cumsum(WIDTHS)])
SINGLE = [bytes((b,)) for b in range(256)] + [b"", b""]
PLACES = np.arange(12)


def _bits(codes: list[int]) -> np.ndarray:
    """The bits of the codes of one table, which end in a clear or end code."""
    part = np.array(codes, np.uint16)
    return ((part[:, None] >> (11 - PLACES)) & 1).astype(np.uint8)[PLACES >= 12 - WIDTHS[: len(part), None]]


def lzw_encode(raw: bytes) -> bytes:
    bits = [np.array([1, 0, 0, 0, 0, 0, 0, 0, 0], np.uint8)]  # a clear code
    codes: list[int] = []
    table: dict[int, int] = {}
    word = -1
    for b in raw:
        if word < 0:
            word = b
            continue
        key = word << 8 | b
        if key in table:
            word = table[key]
            continue
        codes.append(word)
        table[key] = 257 + len(codes)
        word = b
        if len(codes) == 3836:
            bits.append(_bits([*codes, word, CLEAR]))
            codes, table, word = [], {}, -1
    if word >= 0:
        codes.append(word)
    bits.append(_bits([*codes, END]))
    return np.packbits(np.concatenate(bits)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    at, bits, got = 0, 8 * len(data), 0
    out: list[bytes] = []
    while got < size:
        n = int(np.searchsorted(STARTS, bits - at, "right")) - 1
        if n <= 0:
            break
        first = at + STARTS[:n]
        k = first >> 3
        codes = ((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> (24 - (first & 7) - WIDTHS[:n])) & ((1 << WIDTHS[:n]) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        table = SINGLE[:]
        last = b""
        for c in codes[:stop].tolist():
            if c < len(table):
                word = table[c]
            elif last and c == len(table):
                word = last + last[:1]
            else:
                raise TiffError("bad LZW code")
            if last:
                table.append(last + word[:1])
            out.append(word)
            got += len(word)
            last = word
        if stop == n or codes[stop] == END:
            break
        at += int(STARTS[stop + 1])
    return b"".join(out)[:size]


def encode_block(rows: np.ndarray, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(rows)
    if compression == LZW:
        return lzw_encode(rows.tobytes())
    return zlib.compress(rows.tobytes(), 6) if compression == DEFLATE else rows.tobytes()


def decode_block(data: bytes, compression: int, size: int) -> bytes:
    if compression == PACKBITS:
        out = packbits_decode(data, size)[:size]
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"bad Deflate data: {e}") from None
    elif compression == NONE:
        out = data[:size]
    else:
        raise TiffError(f"compression {compression} is not supported")
    if len(out) != size:
        raise TiffError("a strip or tile is too short")
    return out


# --- files --------------------------------------------------------------------------------------------------------


def write_tiff(pages: list[tuple[np.ndarray, int, bool, int]]) -> bytes:
    """A file of 8-bit grey pages, each given as (rows x columns, compression, tiled, predictor)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4  # where the place of the next directory belongs
    for pixels, compression, tiled, predictor in pages:
        h, w = pixels.shape
        blocks = []
        if tiled:
            full = np.zeros((-(-h // TILE) * TILE, -(-w // TILE) * TILE), np.uint8)
            full[:h, :w] = pixels
            parts = [full[y : y + TILE, x : x + TILE] for y in range(0, full.shape[0], TILE) for x in range(0, full.shape[1], TILE)]
        else:
            parts = [pixels[y : y + STRIP_ROWS] for y in range(0, h, STRIP_ROWS)]
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            blocks.append((len(out), encode_block(np.ascontiguousarray(part), compression)))
            out += blocks[-1][1]
        places, sizes = [a for a, _ in blocks], [len(b) for _, b in blocks]
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tiled:
            fields += [(TILE_WIDTH, 3, [TILE]), (TILE_HEIGHT, 3, [TILE]), (TILE_OFFSETS, 4, places), (TILE_SIZES, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_SIZES, 4, sizes)]
        rows = b""
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) & 1)
                raw, place = struct.pack("<I", len(out)), raw
                out += place
            rows += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) & 1)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + rows
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def iter_pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of the directories; one at a time is in memory. Raises TiffError on what it can't read."""
    for page in readable(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def readable(data: bytes) -> Iterator[Page | TiffError]:
    """The pages in the order of the directories, and an error in the place of each that can't be read; then, if the
    chain of directories breaks off, an error for that."""
    broken = (struct.error, IndexError, KeyError, ValueError, OverflowError, MemoryError)
    try:
        for order, at, n in directories(data):
            try:
                yield _page(data, order, Tags(data, order, at, n))
            except broken as e:
                yield e if isinstance(e, TiffError) else TiffError(f"broken page: {e}")
    except broken as e:
        yield e if isinstance(e, TiffError) else TiffError(f"broken file: {e}")


def directories(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Byte order, place and number of entries of each directory. Each is at a place of its own, so the chain ends."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        yield order, at, n
        at = following


class Tags:
    """A directory's entries; values are decoded when they are asked for, and only as many as are needed."""

    def __init__(self, data: bytes, order: str, at: int, n: int):
        self.data, self.order, self.first = data, order, at + 2
        tags = np.frombuffer(data, np.uint8, 12 * n, self.first).reshape(n, 12)[:, :2].copy().view(f"{order}u2").ravel()
        self.place = dict(zip(tags[::-1].tolist(), range(n - 1, -1, -1)))  # of a tag that occurs twice the first counts

    def __contains__(self, tag: int) -> bool:
        return tag in self.place

    def values(self, tag: int, most: int) -> tuple[int, ...]:
        """At most so many values of a tag; a KeyError if it is missing or not of whole numbers."""
        at = self.first + 12 * self.place[tag]
        _, kind, count = struct.unpack_from(self.order + "HHI", self.data, at)
        code = FIELD[kind]
        at += 8
        if count * struct.calcsize(code) > 4:
            (at,) = struct.unpack_from(self.order + "I", self.data, at)
        return struct.unpack_from(f"{self.order}{min(count, most)}{code}", self.data, at)

    def one(self, tag: int, default: int | None = None) -> int:
        if default is not None and tag not in self.place:
            return default
        return self.values(tag, 1)[0]


def _page(data: bytes, order: str, tags: Tags) -> Page:
    w, h, samples, bits = tags.one(WIDTH), tags.one(HEIGHT), tags.one(SAMPLES, 1), tags.one(BITS, 1)
    compression, predictor, tiled = tags.one(COMPRESSION, NONE), tags.one(PREDICTOR, 1), TILE_OFFSETS in tags
    planes = samples if samples > 1 and tags.one(PLANAR, 1) == 2 else 1
    if bits not in (1, 2, 4, 8, 16) or (BITS in tags and len({*tags.values(BITS, samples)}) > 1):
        raise TiffError("only 1, 2, 4, 8 and 16 bits a sample are supported")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise TiffError(f"predictor {predictor} is not supported with {bits} bits")
    if tags.one(FILL_ORDER, 1) != 1:
        raise TiffError("reversed bits are not supported")
    bw, bh = (tags.one(TILE_WIDTH), tags.one(TILE_HEIGHT)) if tiled else (w, min(tags.one(ROWS_PER_STRIP, h), h))
    if min(w, h, samples, bw, bh) < 1 or w * h * samples * max(bits, 8) // 8 > MOST_BYTES:
        raise TiffError("no sensible size")
    if tiled and (bw > max(2 * w, LARGE_TILE) or bh > max(2 * h, LARGE_TILE)):
        raise TiffError("tiles are far larger than the page")
    across, down = -(-w // bw), -(-h // bh)
    n = across * down * planes
    places, sizes = (tags.values(tag, n) for tag in ((TILE_OFFSETS, TILE_SIZES) if tiled else (STRIP_OFFSETS, STRIP_SIZES)))
    if len(places) < n or len(sizes) < n:
        raise TiffError("strips or tiles are missing")
    kind = np.dtype(f"{order}u{max(bits, 8) // 8}")
    pixels = np.empty((h, w, samples), kind.newbyteorder("="))
    each = samples // planes
    for k in range(n):
        plane, at = divmod(k, across * down)
        y, x = at // across * bh, at % across * bw
        rows = bh if tiled else min(bh, h - y)
        width = -(-bw * each * bits // 8)  # bytes of a row
        raw = decode_block(data[places[k] : places[k] + sizes[k]], compression, rows * width)
        if bits < 8:
            block = unpacked(np.frombuffer(raw, np.uint8).reshape(rows, width), bits)[:, : bw * each].reshape(rows, bw, each)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, bw, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=pixels.dtype)
        pixels[y : y + bh, x : x + bw, plane : plane + each] = block[: h - y, : w - x]
    return Page(w, h, samples, bits, NAMES[compression], predictor, tiled, pixels)


def unpacked(rows: np.ndarray, bits: int) -> np.ndarray:
    """Samples of fewer than 8 bits, the first in the highest bits, as a byte each."""
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(len(rows), -1).astype(np.uint8)


def payload_tiff(payload: bytes) -> bytes:
    """The payload, a positive multiple of ROW bytes, as grey samples; pages take the WAYS in turn.

    The first way follows from the payload's length, so that short payloads use them all too.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_tiff([(rows[y : y + PAGE_ROWS], *WAYS[(len(rows) + k) % len(WAYS)]) for k, y in enumerate(range(0, len(rows), PAGE_ROWS))])


# --- operators ----------------------------------------------------------------------------------------------------


def padded(raw: bytes, to: int = ROW) -> bytes:
    return raw + b"\0" * ((-len(raw)) % to or (0 if raw else to))


def write_payloads(df: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """doc_id, n_bytes and media (a TIFF file that holds the payload, padded with zeros) of every row; narrow.

    A null payload is an empty one, and an empty one is stored as one row of zeros. A null id stays null; repeated
    rows are stored each; an empty table gives an empty result. Other columns are not read.
    """
    doc_id, payload = (F.col(f"c{place_of(df, c)}") for c in (id_col, payload_col))
    rows = numbered(df).select(doc_id.alias("doc_id"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in small(batch, "payload"):
                media = [payload_tiff(padded(x)) for x in raw]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_pass(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def small(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and values in runs of about ``most`` bytes."""
    start, size, values = 0, 0, []
    for k, v in enumerate(batch.column(column)):
        values.append(v.as_py())
        size += len(values[-1] or b"")
        if size >= most:
            yield batch.column("doc_id").slice(start, len(values)), values
            start, size, values = k + 1, 0, []
    if values:
        yield batch.column("doc_id").slice(start, len(values)), values


PAGE_FIELDS = {"page": ("int", pa.int32()), "width": ("int", pa.int32()), "height": ("int", pa.int32()), "samples": ("int", pa.int32()), "bits": ("int", pa.int32()), "compression": ("string", pa.string()), "predictor": ("int", pa.int32()), "tiled": ("boolean", pa.bool_()), "pixels": ("binary", pa.binary()), "error": ("string", pa.string())}
#: Bytes of pixels in one batch of page rows; a page that is larger has a batch to itself.
BATCH = 4 << 20


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: doc_id, page (from 0), the page's form, its pixels row by row (a byte each up to 8 bits, 16-bit
    samples little-endian), error; then the columns of df named in ``carry``.

    A page that can't be read is a row with ``error`` and nulls in its place, and so is what breaks off a file; a file
    without a page, a null and an empty value give one such row. A file's rows follow one another in order. A null id
    stays null; repeated rows are read each; an empty table gives an empty result. Names are matched by case only if
    two columns differ in nothing else; columns that aren't named are not read.
    """
    doc_id, media, *rest = (F.col(f"c{place_of(df, c)}") for c in (id_col, media_col, *carry))
    rows = numbered(df).select(doc_id.alias("doc_id"), F.coalesce(media, F.lit(b"")).alias("media"), *[c.alias(n) for c, n in zip(rest, carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found, size = [], [], 0

            def flush() -> pa.RecordBatch:
                at = pa.array(of, pa.int64())
                cols = [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(PAGE_FIELDS.values())]
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *cols, *[batch.column(c).take(at) for c in carry]], ["doc_id", *PAGE_FIELDS, *carry])  # noqa: B023

            for k, media in enumerate(batch.column("media")):
                for row in page_rows(media.as_py()):
                    of.append(k)
                    found.append(row)
                    size += len(row[8] or b"")
                    if size >= BATCH or len(of) >= 4096:
                        yield flush()
                        of, found, size = [], [], 0
            if of:
                yield flush()

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return arrow_pass(rows, run, ", ".join([f"doc_id {kind('doc_id')}", *[f"{n} {k}" for n, (k, _) in PAGE_FIELDS.items()], *[f"`{c}` {kind(c)}" for c in carry]]))


def page_rows(media: bytes) -> Iterator[tuple]:
    k = -1
    for k, p in enumerate(readable(media)):
        if isinstance(p, TiffError):
            yield k, None, None, None, None, None, None, None, None, str(p)
            continue
        raw = p.pixels.astype(p.pixels.dtype.newbyteorder("<"), copy=False).tobytes()
        yield k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, raw, None
    if k < 0:
        yield 0, None, None, None, None, None, None, None, None, "a file without pages"


def tiff_digests(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """One row per file, folded from its page rows: what the pixels hold and what the file is.

    payload_bytes and payload_sha256 are those of all pages' pixels in order, tail_crc32 the CRC-32 of the last 64 of
    these bytes, and feature tells pages, codecs, mean sample and a 16-bin histogram. A file with a page that can't be
    read has ``error`` (the first) and nulls instead. The page rows of a file follow one another in the task that reads
    it, so they are folded there, page by page, without a shuffle. Nulls, names and repeated rows: as for tiff_pages.
    """
    doc_id, n_bytes, media = (F.col(f"c{place_of(df, c)}") for c in (id_col, bytes_col, media_col))
    media = F.coalesce(media, F.lit(b""))
    files = numbered(df).select(doc_id.alias("doc_id"), n_bytes.cast("long").alias("n_bytes"), media.alias("media"), F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"))
    pages = tiff_pages(files, carry=("n_bytes", "media_bytes", "media_sha256"))
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_kind, now, done = None, None, []

        def flush() -> pa.RecordBatch:
            cols = [pa.array([d[0] for d in done], doc_kind), *[pa.array([d[1][c] for d in done], k) for c, k in kinds.items()]]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *kinds])

        for batch in batches:
            doc_kind = batch.schema.field("doc_id").type
            numbers, errors, codecs = (batch.column(c).to_pylist() for c in ("page", "error", "compression"))
            for k, number in enumerate(numbers):
                if number == 0:  # a file begins
                    if now:
                        done.append((now.doc_id, now.result()))
                    now = Digest(*(batch.column(c)[k].as_py() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")))
                now.add(batch.column("pixels")[k].as_buffer(), codecs[k], errors[k])
            if len(done) >= 1000:
                yield flush()
                done = []
        if now:
            done.append((now.doc_id, now.result()))
            yield flush()

    kind = files.schema["doc_id"].dataType.simpleString()
    return arrow_pass(pages, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


class Digest:
    """What is known of a file after some of its pages."""

    def __init__(self, doc_id, n_bytes: int | None, media_bytes: int, media_sha256: str):
        self.doc_id, self.own = doc_id, {"n_bytes": n_bytes, "media_bytes": media_bytes, "media_sha256": media_sha256}
        self.sha, self.size, self.tail, self.pages = hashlib.sha256(), 0, b"", 0
        self.bins, self.total, self.codecs, self.error = np.zeros(16, np.int64), 0, set(), None

    def add(self, pixels: pa.Buffer | None, codec: str | None, error: str | None) -> None:
        if error is not None:
            self.error = self.error or error
            return
        self.sha.update(pixels)
        self.size += len(pixels)
        self.tail = (self.tail + bytes(memoryview(pixels)[-64:]))[-64:]
        self.pages += 1
        seen = np.frombuffer(pixels, np.uint8)
        self.bins += np.bincount(seen >> 4, minlength=16)
        self.total += int(seen.sum(dtype=np.int64))
        self.codecs.add(codec)

    def result(self) -> dict:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "feature")
        if self.error is not None:
            return self.own | dict.fromkeys(names) | {"error": self.error}
        per = lambda n: n * 1000 // max(self.size, 1)
        feature = f"pages={self.pages};codecs={'+'.join(sorted(self.codecs))};mean={per(self.total)};hist={','.join(map(str, per(self.bins)))}"
        return self.own | dict(zip(names, (self.size, self.sha.hexdigest(), zlib.crc32(self.tail), feature))) | {"error": None}
