import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlake.llm import tiff

from .util import ODD, documents


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(raw):
    assert tiff.lzw_decode(tiff.lzw_encode(raw), len(raw)) == raw
    rows = np.frombuffer(tiff.padded(raw), np.uint8).reshape(-1, 64)
    assert tiff.packbits_decode(tiff.packbits_encode(rows), rows.size) == rows.tobytes()


@pytest.mark.parametrize("raw", [b"", b"\0" * 70000, os.urandom(70000), b"ab" * 40000])
def test_lzw_tables_and_pages(raw):
    assert tiff.lzw_decode(tiff.lzw_encode(raw), len(raw)) == raw
    payload = tiff.padded(raw)
    pages = list(tiff.iter_pages(tiff.payload_tiff(payload)))
    assert b"".join(p.pixels.tobytes() for p in pages) == payload
    assert len(pages) == -(-len(payload) // (64 * 1024))


def test_a_published_lzw_stream():
    # the example of the format's specification: 7 7 7 8 8 7 7 6 6
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
def test_every_way_of_storing(compression, tiled, predictor):
    a = np.random.default_rng(1).integers(0, 50, (150, 100), np.uint8)
    (p,) = tiff.iter_pages(tiff.write_tiff([(a, compression, tiled, predictor)]))
    assert (p.pixels[:, :, 0] == a).all() and (p.width, p.height, p.tiled, p.predictor) == (100, 150, tiled, predictor)


def test_big_endian_16_bits_and_three_samples():
    a = np.arange(2 * 4 * 3, dtype=np.uint16).reshape(2, 4, 3) * 1000
    diff = np.concatenate([a[:, :1], np.diff(a, axis=1)], axis=1).astype(">u2").tobytes()
    fields = [(256, 3, 4), (257, 3, 2), (258, 3, 16), (259, 3, 8), (277, 3, 3), (278, 3, 2), (317, 3, 2)]
    data = zlib.compress(diff)
    rows = [struct.pack(">HHIHH", t, k, 1, v, 0) for t, k, v in fields]
    rows += [struct.pack(">HHII", 273, 4, 1, 8), struct.pack(">HHII", 279, 4, 1, len(data))]
    at = 8 + len(data)
    raw = b"MM\0*" + struct.pack(">I", at) + data + struct.pack(">H", len(rows)) + b"".join(sorted(rows)) + b"\0" * 4
    (p,) = tiff.iter_pages(raw)
    assert (p.pixels == a).all()


def test_one_row_per_page(spark):
    payload = bytes(range(256)) * 600
    media = spark.createDataFrame([(1, bytearray(tiff.payload_tiff(payload)), "x"), (2, bytearray(b"junk"), "x"), (3, None, "x"), (None, bytearray(tiff.payload_tiff(payload)[:-200]), "x")], "doc_id bigint, media binary, pixels string")
    rows = tiff.tiff_pages(media).collect()
    good = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["page"])
    assert b"".join(bytes(r["pixels"]) for r in good) == payload and [r["page"] for r in good] == [0, 1, 2]
    assert all(r["error"] for r in rows if r["doc_id"] in (2, 3)) and any(r["error"] for r in rows if r["doc_id"] is None)
    assert tiff.tiff_pages(media.where("false")).count() == 0
    assert tiff.tiff_pages(media.union(media)).count() == 2 * len(rows)


def directory(order, fields, data=b""):
    """A file of one page: entries (tag, kind, count, value) and the data that stands at 8."""
    at = 8 + len(data)
    rows = [struct.pack(f"{order}HHI", t, k, n) + (struct.pack(f"{order}HH", v, 0) if k == 3 and n == 1 else struct.pack(f"{order}I", v)) for t, k, n, v in sorted(fields)]
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", at) + data + struct.pack(f"{order}H", len(rows)) + b"".join(rows) + b"\0" * 4


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("order", "<>")
def test_samples_of_few_bits(bits, order):
    a = np.random.default_rng(bits).integers(0, 1 << bits, (5, 13), np.uint8)
    rows = [sum(int(v) << (8 - bits - i % (8 // bits) * bits) for i, v in enumerate(r) if i // (8 // bits) == k) for r in a for k in range(-(-13 * bits // 8))]
    data = bytes(rows)
    (p,) = tiff.iter_pages(directory(order, [(256, 3, 1, 13), (257, 3, 1, 5), (258, 3, 1, bits), (259, 3, 1, 1), (273, 4, 1, 8), (278, 3, 1, 5), (279, 4, 1, len(data))], data))
    assert (p.pixels[:, :, 0] == a).all() and p.bits == bits


def test_samples_in_planes():
    a = np.arange(3 * 4 * 5, dtype=np.uint8).reshape(3, 4, 5)
    places = struct.pack("<3I", 8 + 24, 8 + 24 + 20, 8 + 24 + 40)
    sizes = struct.pack("<3I", 20, 20, 20)
    fields = [(256, 3, 1, 5), (257, 3, 1, 4), (258, 3, 1, 8), (259, 3, 1, 1), (277, 3, 1, 3), (284, 3, 1, 2), (273, 4, 3, 8), (278, 3, 1, 4), (279, 4, 3, 20)]
    (p,) = tiff.iter_pages(directory("<", fields, places + sizes + a.tobytes()))
    assert (p.pixels == a.transpose(1, 2, 0)).all()


def test_a_page_that_cant_be_read_hides_no_other(spark):
    pages = [(np.full((4, 64), k, np.uint8), tiff.NONE, False, 1) for k in range(3)]
    raw = bytearray(tiff.write_tiff(pages))
    order, at, n = list(tiff.directories(bytes(raw)))[1]
    place = at + 2 + 12 * tiff.Tags(bytes(raw), order, at, n).place[tiff.PREDICTOR]
    raw[place + 8] = 3
    df = spark.createDataFrame([(1, bytearray(raw), 5)], "doc_id bigint, MEDIA binary, n_bytes bigint")
    rows = sorted(tiff.tiff_pages(df).collect(), key=lambda r: r["page"])
    assert [r["page"] for r in rows] == [0, 1, 2] and "predictor" in rows[1]["error"] and rows[1]["pixels"] is None
    assert [bytes(r["pixels"])[0] for r in (rows[0], rows[2])] == [0, 2]
    (d,) = tiff.tiff_digests(df).collect()
    assert "predictor" in d["error"] and d["payload_bytes"] is None and d["media_bytes"] == len(raw)


def test_loops_and_bombs_are_errors():
    import time
    import tracemalloc

    shared = struct.pack("<100000I", *range(100000))
    many = directory("<", [(40000 + k, 4, 100000, 8) for k in range(3000)] + [(256, 3, 1, 1), (257, 3, 1, 1), (258, 3, 1, 8), (273, 4, 100000, 8), (279, 4, 100000, 8)], shared)
    wide = directory("<", [(256, 3, 1, 1), (257, 3, 1, 1), (258, 3, 1, 8), (259, 3, 1, 8), (322, 4, 1, 190 << 20), (323, 3, 1, 1), (324, 4, 1, 8), (325, 4, 1, 200000)], zlib.compress(bytes(190 << 20)))
    tracemalloc.start()
    began = time.time()
    assert len(list(tiff.readable(many))) == 1
    with pytest.raises(tiff.TiffError, match="tiles"):
        list(tiff.iter_pages(wide))
    assert time.time() - began < 2 and tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()
    raw = bytearray(tiff.payload_tiff(bytes(64)))
    (first,) = struct.unpack_from("<I", raw, 4)
    struct.pack_into("<I", raw, len(raw) - 4, first)
    with pytest.raises(tiff.TiffError, match="loop"):
        list(tiff.iter_pages(bytes(raw)))


def test_digests(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, ODD).select("doc_id", F.col("text").cast("binary").alias("payload"), "media")
    got = {r["doc_id"]: r for r in tiff.tiff_digests(tiff.write_payloads(docs)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(want[-64:]) and r["error"] is None
    assert got[6]["media_sha256"] == got[7]["media_sha256"] and got[6]["feature"] == got[7]["feature"]
    assert tiff.write_payloads(docs.where("false")).count() == 0
