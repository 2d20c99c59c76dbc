"""Scalar building blocks as column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KINDS, MAX_LONG


def sat_add(a: Column, b: Column) -> Column:
    """a + b, or the largest BIGINT where that overflows; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a, b), F.lit(MAX_LONG)))


def sat_sub(a: Column, b: Column) -> Column:
    """a - b for values that are not negative, 0 where that would be negative."""
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def le_bytes(value: Column, width: int) -> Column:
    """An integer as so many little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    pairs = [F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]
    return F.unhex(F.concat(*pairs))


def from_le_bytes(value: Column) -> Column:
    """The integer of at most 8 little-endian bytes, as BIGINT (values from 2^63 wrap)."""
    digits = F.hex(value)
    order = F.transform(F.sequence(F.octet_length(value) - 1, F.lit(0), F.lit(-1)), lambda i: F.substr(digits, 2 * i + 1, F.lit(2)))
    return F.conv(F.array_join(order, ""), 16, -10).cast("bigint")


def sha256(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def position_text(epoch: Column, seq: Column) -> Column:
    return F.concat_ws(":", epoch.cast("string"), seq.cast("string"))


def parse_position(text: Column) -> Column:
    """struct(epoch, seq) of 'epoch:seq'; null if it is anything else."""
    ok = text.rlike("^[0-9]{1,18}:[0-9]{1,18}$")
    parts = F.split(text, ":")
    return F.when(ok, F.struct(F.try_element_at(parts, F.lit(1)).cast("bigint").alias("epoch"), F.try_element_at(parts, F.lit(2)).cast("bigint").alias("seq")))


def position(epoch: Column | str = "epoch", seq: Column | str = "seq") -> Column:
    """(epoch, seq) as a struct, which Spark orders as positions are ordered."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(as_col(epoch).cast("bigint").alias("epoch"), as_col(seq).cast("bigint").alias("seq"))


def hex_id(value: Column) -> Column:
    return F.lower(F.hex(value))


def is_hex_id(text: Column, id_bytes: int = 16) -> Column:
    return text.rlike(f"^[0-9a-fA-F]{{{2 * id_bytes}}}$")


def kind_name(code: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, KINDS)), code.cast("int") + 1)


def kind_code(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, KINDS)), name)
    return F.when(at > 0, at - 1)


def is_control(kind: Column) -> Column:
    return kind != "data"


def member_id(key: Column) -> Column:
    """A member's id is the first half of its key's SHA-256."""
    return F.substring(sha256(key), 1, 16)


def address_safe(address: Column, longest: int = 255) -> Column:
    """Printable ASCII without blanks, neither empty nor too long."""
    return address.rlike("^[\\x21-\\x7e]+$") & (F.length(address) <= longest)


def entry_header(kind: Column, journal: Column, author: Column, author_seq: Column, author_ts: Column, ttl: Column, payload_len: Column, payload_hash: Column, sig: Column) -> Column:
    """The 164 bytes of an entry's header."""
    return F.concat(F.lit(b"CPPZ"), F.lit(b"\x01\x00"), le_bytes(kind_code(kind), 2), journal, author, le_bytes(author_seq, 8), le_bytes(author_ts, 8), le_bytes(ttl, 8), le_bytes(payload_len, 4), payload_hash, sig)


def slot_bytes(epoch: Column, seq: Column, ts: Column, entry_hash: Column, prev: Column, leader: Column, sig: Column) -> Column:
    """The 168 bytes of a slot."""
    return F.concat(le_bytes(epoch, 8), le_bytes(seq, 8), le_bytes(ts, 8), entry_hash, prev, leader, sig)


def record_bytes(shape: str, has_payload: Column, payload_len: Column) -> Column:
    """A record's size on disk: shape 'full', 'header' or 'none', the latter two only without the payload."""
    least = 8 + 168 + (0 if shape == "none" else 164)
    return F.when(has_payload, F.lit(340) + payload_len).otherwise(F.lit(least)).cast("bigint")
