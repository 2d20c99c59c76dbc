"""Ed25519 (RFC 8032) on Python integers: there is no such function in Spark. Verification of a column is an Arrow pass;
as it costs milliseconds a signature, chains are verified by their hashes and signatures only on demand."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

#: The curve.
P = 2**255 - 19
Q = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]  # extended coordinates


def add(a: Point, b: Point) -> Point:
    m, n = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    k, z = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = n - m, z - k, z + k, n + m
    return e * f % P, g * h % P, f * g % P, e * h % P


def times(n: int, a: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = add(out, a)
        a, n = add(a, a), n >> 1
    return out


def same(a: Point, b: Point) -> bool:
    return not ((a[0] * b[2] - b[0] * a[2]) % P or (a[1] * b[2] - b[1] * a[2]) % P)


def x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if not square:
        return None if odd else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != odd else x


BASE_Y = 4 * pow(5, P - 2, P) % P
BASE: Point = (x_of(BASE_Y, 0), BASE_Y, 1, x_of(BASE_Y, 0) * BASE_Y % P)


def pack(a: Point) -> bytes:
    inverse = pow(a[2], P - 2, P)
    x, y = a[0] * inverse % P, a[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def unpack(raw: bytes) -> Point | None:
    y = int.from_bytes(raw, "little")
    odd, y = y >> 255, y & ((1 << 255) - 1)
    x = x_of(y, odd)
    return None if x is None else (x, y, 1, x * y % P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % Q


def _expand(secret: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(secret).digest()
    return int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254, h[32:]


def public_key(secret: bytes) -> bytes:
    return pack(times(_expand(secret)[0], BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _expand(secret)
    own = pack(times(a, BASE))
    r = _hash(prefix, message)
    at = pack(times(r, BASE))
    return at + ((r + _hash(at, own, message) * a) % Q).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = unpack(key), unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= Q:
        return False
    return same(times(s, BASE), add(r, times(_hash(signature[:32], key, message), a)))


def with_verdict(df: DataFrame, key: str, message: str, signature: str, name: str = "signature_ok") -> DataFrame:
    """df with a boolean column; null where any of the three binary columns is null. A narrow pass."""
    ship(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in (key, message, signature)))
            ok = [None if None in r else verify(*r) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], [*b.schema.names, name])

    return df.mapInArrow(run, f"{kinds}, {name} boolean")
