"""SimHash near-dedup: fingerprints, bit-sliced comparison inside buckets, connected components.

Only distinct fingerprints are compared. Buckets come from masks: fingerprints that agree on a mask's bits share a
bucket. Two kinds of masks:

* exact, for small radii: the bits are cut into radius+1 parts, and the bits outside a part again into radius+1 parts.
  Two fingerprints within the radius agree on one part, and outside it on one part of the rest, so no link is lost.
* sampled, for large radii: so many random masks that a pair at a given distance meets with probability RECALL. The
  bits of a mask grow with the logarithm of the number of fingerprints, so buckets don't grow with the corpus; the
  number of masks then grows as a power of it (0.28 at 45 of 256 bits), and with it what is shuffled. Buckets of a
  thousand, which the bit-sliced comparison can afford, keep it low.

A bucket of an exact mask with more than BUCKET fingerprints is not compared but dealt again by masks that extend its
own; this ends because distinct fingerprints that agree on all bits don't exist. A bucket of a sampled mask with more
than SAMPLED_BUCKET is compared in blocks, each two in a task's reach, so no pair that shares a bucket is lost; this costs the square
of the bucket's size, but for those that are known to be of one group. Copies of a text are one fingerprint, so a large
group of copies costs nothing here.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, discard, id_and_text, materialise, numbered, place_of, row_hash, written

SEED = 42
#: Fingerprints compared with each other at most; beyond, a bucket of an exact mask is dealt again, one of a sampled
#: mask compared in blocks.
BUCKET, SAMPLED_BUCKET = 1024, 4096
#: The chance that sampled masks bring a pair at the given distance together, and the fingerprints of one bucket aimed at.
RECALL, AIM = 0.95, 1024
#: Bytes of shingle hashes that one block's verification holds, about; a block has at least one fingerprint.
BLOCK_BYTES = 32 << 20
#: Bits of the map by which rows that can't be looked for are left out before a shuffle.
MAP_BITS = 1 << 23
#: Texts of which a task remembers that it has written their shingles.
REMEMBERED = 1 << 17
#: (query, block) pairs in one step of the comparison.
STEP = 1 << 15
#: Over so many parts the edges of one node are spread.
SALTS = 16
#: 64 bits.
FULL = (1 << 64) - 1

LOWER = bytes(range(256)).lower()
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# --- fingerprints -------------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: 64 well-mixed bits for each value."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of all shingles of the words, A-Z in lower case, joined by a space; repeats count."""
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)


def fingerprint(text: str, words: int = 3, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half the shingles' hashes; no words: all zero.

    The first 64 bits are those of the hashes, further ones of their mixes.
    """
    return majority(shingle_hashes(text, words), bits)


def majority(h: np.ndarray, bits: int) -> bytes:
    if not len(h):
        return bytes(bits // 8)
    out = []
    for k in range(bits // 64):
        w = mixed(h + np.uint64(k * int(MIX[0]) & FULL)) if k else h
        rows = w.astype(">u8").view(np.uint8).reshape(-1, 8)
        count = np.zeros(64, np.int64)
        for at in range(0, len(rows), 255):  # so many bits add up in a byte
            count += np.add.reduce(np.unpackbits(rows[at : at + 255], axis=1), axis=0, dtype=np.uint8)
        out.append(np.packbits(2 * count > len(h)).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, words: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (binary, bits/8 bytes) of every row; one narrow pass.

    A null text is an empty one, and texts without words have fingerprint zero. Null ids stay null, repeated rows get
    equal rows, an empty table an empty result; other columns, whatever they are called, are not read.
    """
    rows = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), words, bits) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    return arrow_pass(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp binary")


def signatures(rows: DataFrame, words: int, bits: int) -> DataFrame:
    """The columns of rows but for text, and fp and shingles (ascending 64-bit hashes, each once); one narrow pass.

    Here fp is the fingerprint of the set of shingles and 64 bits more, a hash of the set, so that different sets are
    different nodes although their fingerprints may be equal. Of copies that a task meets soon after one another only
    the first has shingles, the others null: so a large group of copies weighs little.
    """
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fps, sets = [], []
            for t in batch.column("text"):
                h = np.unique(shingle_hashes(t.as_py(), words))
                raw = h.astype("<u8").tobytes()
                own = xxhash.xxh64_digest(raw, SEED)
                fps.append(majority(h, bits) + own)
                sets.append(None if fps[-1] in seen else raw)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(fps[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], [*others, "fp", "shingles"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return arrow_pass(rows, run, f"{kinds}, fp binary, shingles binary")


# --- masks and buckets --------------------------------------------------------------------------------------------


def parts(places: list[int], n: int) -> list[list[int]]:
    """The places in n runs of about equal length."""
    cut = [len(places) * k // n for k in range(n + 1)]
    return [places[a:b] for a, b in zip(cut, cut[1:])]


class Masks:
    """Which bits are compared to deal fingerprints out; a mask is known by its path."""

    def __init__(self, bits: int, radius: int, n: int, expected: float | None = None):
        """``expected``: the distance at which sampled masks are to find pairs; the radius if it isn't given."""
        self.bits, self.radius = bits, radius
        self.exact = (radius + 1) ** 2 <= 16
        if not self.exact:
            agree = 1 - (radius if expected is None else expected) / bits
            self.width = max(8, math.ceil(math.log2(max(n, 1) / AIM + 1)))
            self.tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**self.width)))

    def first(self) -> list[str]:
        if self.exact:
            return [f"{i}.{j}" for i in range(self.radius + 1) for j in range(self.radius + 1)]
        return [str(t) for t in range(self.tables)]

    def below(self, path: str) -> list[str]:
        """The masks that extend an exact mask whose bucket is too large."""
        return [f"{path}.{k}" for k in range(self.radius + 1)]

    def places(self, path: str) -> list[int]:
        fixed: list[int] = []
        rest = list(range(self.bits))
        for depth, step in enumerate(map(int, path.split("."))):
            if self.exact:
                more = parts(rest, self.radius + 1)[step]
            else:
                draw = random.Random(f"{'.'.join(path.split('.')[: depth + 1])}")
                more = draw.sample(rest, min(len(rest), self.width))
            fixed += more
            rest = [p for p in rest if p not in set(more)]
        return fixed

    def mask(self, path: str) -> np.ndarray:
        on = np.zeros(self.bits, np.uint8)
        on[self.places(path)] = 1
        return np.packbits(on).view(">u8").astype(np.uint64)


def words_of(fps: pa.Array, bits: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words; what stands behind their bits is left out."""
    raw = fps.to_pylist()
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)[:, : bits // 64]


def keyed(fps: DataFrame, masks: Masks, paths: list[str], carry: str = "") -> DataFrame:
    """key, path, fp, and the columns of fps named in ``carry`` (as a schema): each fingerprint once for each path. A key
    is a hash of the path and of the masked bits; should two meet, the comparison only sees some fingerprints more."""
    own = ["fp", *[c.split()[0] for c in carry.split(", ") if c]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(p, masks.mask(p), np.uint64(xxhash.xxh64_intdigest(p, SEED))) for p in paths]
        for batch in batches:
            w = words_of(batch.column("fp"), masks.bits)
            for path, mask, salt in made:
                key = np.full(len(w), salt)
                for k in range(w.shape[1]):
                    key = mixed((key ^ (w[:, k] & mask[k])) + MIX[0])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([path] * len(w), pa.string()), *[batch.column(c) for c in own]], ["key", "path", *own])

    return arrow_pass(fps.select(*own), run, "key long, path string, fp binary" + (f", {carry}" if carry else ""))


def extended(rows: DataFrame, masks: Masks) -> DataFrame:
    """The rows of buckets that are too large, dealt by the masks that extend theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple[np.ndarray, np.uint64]] = {}
        for batch in batches:
            for path in set(batch.column("path").to_pylist()):
                own = batch.filter(pa.compute.equal(batch.column("path"), path))
                w = words_of(own.column("fp"), masks.bits)
                for p in masks.below(path):
                    if p not in made:
                        made[p] = masks.mask(p), np.uint64(xxhash.xxh64_intdigest(p, SEED))
                    mask, key = made[p][0], np.full(len(w), made[p][1])
                    for k in range(w.shape[1]):
                        key = mixed((key ^ (w[:, k] & mask[k])) + MIX[0])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([p] * len(w), pa.string()), own.column("fp")], ["key", "path", "fp"])

    return arrow_pass(rows, run, "key long, path string, fp binary")


# --- bit-sliced comparison ----------------------------------------------------------------------------------------


def add3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the sum and carry bits of three bits in every lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def at_most(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose number, given by its binary digits from the lowest, is at most radius."""
    less, same = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    if radius >> len(digits):
        return same
    for k in range(len(digits) - 1, -1, -1):
        if radius >> k & 1:
            less |= same & ~digits[k]
            same &= digits[k]
        else:
            same &= ~digits[k]
    return less | same


def near(fps: np.ndarray, sizes: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All that near_steps finds, at once."""
    found = list(near_steps(fps, sizes, radius))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def near_steps(fps: np.ndarray, sizes: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of fps, i in ascending order, of one bucket and within the radius; i = j included.

    The rows of a bucket stand together; 64 of them make a block, whose bits are stored by plane: word b of a block
    holds bit b of its 64 rows. A query adds its difference from plane after plane to vertical counters, eight planes
    at a time; blocks in which all 64 distances exceed the radius are dropped after each eight.
    """
    bits = fps.shape[1] * 64
    raw = np.unpackbits(fps.astype(">u8").view(np.uint8), axis=1)
    n_blocks = [-(-n // 64) for n in sizes]
    first_block = np.concatenate([[0], np.cumsum(n_blocks)]).astype(np.int64)
    first_row = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    slot = (first_block[bucket] * 64) + np.arange(len(fps)) - first_row[bucket]
    wide = np.zeros((first_block[-1] * 64, bits), np.uint8)
    wide[slot] = raw
    planes = np.packbits(np.ascontiguousarray(wide.T), axis=1, bitorder="little").view(np.uint64)
    there = np.zeros(first_block[-1] * 64, np.uint8)
    there[slot] = 1
    lanes = np.packbits(there, bitorder="little").view(np.uint64)
    row_of = np.zeros(len(there), np.int64)
    row_of[slot] = np.arange(len(fps))
    flips = np.uint64(0) - np.ascontiguousarray(raw.T).astype(np.uint64)  # all ones where the query's bit is set
    each = np.repeat(np.array(n_blocks), sizes)
    query = np.repeat(np.arange(len(fps)), each)
    block = np.arange(len(query)) - np.repeat(np.cumsum(each) - each, each) + first_block[bucket[query]]
    for at in range(0, len(query), STEP):
        q, b = query[at : at + STEP], block[at : at + STEP]
        zero = np.zeros(len(q), np.uint64)
        digits = [zero, zero, zero]  # ones, twos, fours, eights, ...
        for p in range(0, bits, 8):
            d = [planes[k][b] ^ flips[k][q] for k in range(p, p + 8)]
            ones, t1 = add3(digits[0], d[0], d[1])
            ones, t2 = add3(ones, d[2], d[3])
            twos, f1 = add3(digits[1], t1, t2)
            ones, t1 = add3(ones, d[4], d[5])
            ones, t2 = add3(ones, d[6], d[7])
            twos, f2 = add3(twos, t1, t2)
            fours, carry = add3(digits[2], f1, f2)
            high = digits[3:]
            for k in range(len(high)):
                high[k], carry = high[k] ^ carry, high[k] & carry
            digits = [ones, twos, fours, *high]
            if 8 << len(high) <= p + 8:
                digits.append(carry)
            close = at_most(digits, radius) & lanes[b]
            live = np.flatnonzero(close)
            if len(live) < 0.9 * len(q):
                q, b, close, digits = q[live], b[live], close[live], [x[live] for x in digits]
            if not len(q):
                break
        if len(q):
            hit = np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little"))
            yield q[hit >> 6], row_of[b[hit >> 6] * 64 + (hit & 63)]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that links reach; a is ascending and has every row."""
    label = np.arange(n)
    starts = np.searchsorted(a, np.arange(n))
    while True:
        new = np.minimum(np.minimum.reduceat(label[b], starts), label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(buckets: DataFrame, bits: int, radius: int) -> DataFrame:
    """a, b: in each bucket, every fingerprint that isn't its group's first is linked to that one.

    Groups are the connected ones within the bucket, so a group of n costs n - 1 links, however many pairs it has.
    """

    def flush(block: list[list[bytes]]) -> pa.RecordBatch:
        flat = [fp for fps in block for fp in fps]
        w = np.frombuffer(b"".join(flat), ">u8").astype(np.uint64).reshape(len(flat), -1)[:, : bits // 64]
        root = roots(len(flat), *near(w, [len(fps) for fps in block], radius))
        child = np.flatnonzero(root != np.arange(len(flat)))
        return pa.RecordBatch.from_arrays([pa.array([flat[i] for i in child], pa.binary()), pa.array([flat[i] for i in root[child]], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for fps in batch.column("fps"):
                block.append(fps.as_py())
                size += max(64, len(block[-1]))
                if size >= 1 << 14:
                    yield flush(block)
                    block, size = [], 0
        if block:
            yield flush(block)

    return arrow_pass(buckets, run, "a binary, b binary")


def links(fps: DataFrame, bits: int, radius: int) -> DataFrame:
    """a, b: links that connect what pairs within the radius connect. fps: distinct, written (it is read repeatedly).

    No fingerprints, or one: no links. A fingerprint is never linked to itself; equal links occur once.
    """
    masks = Masks(bits, radius, fps.count())
    if not masks.exact:
        own = fps.select("fp", F.xxhash64("fp").alias("label"), F.lit(0).cast("bigint").alias("size"))
        return materialise(linked(blocks(keyed(own, masks, masks.first(), NODE)).select("fps"), bits, radius), "links").distinct()
    rows = keyed(fps, masks, masks.first())
    collected = lambda rows: rows.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    found: list[DataFrame] = []
    while True:
        hot = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "hot-keys")
        if hot.isEmpty():
            found.append(materialise(linked(collected(rows), bits, radius), "links"))
            break
        found.append(materialise(linked(collected(rows.join(hot, "key", "left_anti")), bits, radius), "links"))
        rows = materialise(extended(rows.join(hot, "key", "left_semi").select("key", "path", "fp"), masks), "dealt-again")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


# --- verified pairs -----------------------------------------------------------------------------------------------


#: What a node of the search carries besides its fingerprint: the group that it is known to be of, the bytes of its set.
NODE = "label long, size long"


def over_buckets(buckets: DataFrame, bits: int, radius: int, pairs_of, schema: str) -> DataFrame:
    """The batches that pairs_of(rows, steps) makes of some buckets at a time, by columns of lists and single values.

    rows: by name the lists' values end to end, and single values repeated for each; steps: near_steps of the column fps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < len(batch):
                n, size = 0, 0
                while at + n < len(batch) and size < 1 << 14:
                    size += max(64, len(batch.column("fps")[at + n]))
                    n += 1
                part = batch.slice(at, n)
                at += n
                sizes = pa.compute.list_value_length(part.column("fps")).to_pylist()
                each = pa.array(np.repeat(np.arange(n), sizes))
                rows = {c: part.column(c).flatten() if pa.types.is_list(part.column(c).type) else part.column(c).take(each) for c in part.schema.names}
                yield from pairs_of(rows, near_steps(words_of(rows["fps"], bits), sizes, radius))

    return arrow_pass(buckets, run, schema)


def nearest_lower(rows: DataFrame, bits: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """b, a: every b that meets another within the radius, with the nearest lower one, null if all are above; and the
    keys (written) of buckets that are too large, which are cut at random here: what that leaves out is not seen.
    """
    hot = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SAMPLED_BUCKET), "hot-keys")
    cut = F.coalesce(F.pmod(F.xxhash64("fp", "key"), F.ceil(F.col("n") * 2 / SAMPLED_BUCKET)), F.lit(0))
    dealt = rows.join(hot, "key", "left").groupBy("key", cut.alias("cut")).agg(F.sort_array(F.collect_list("fp")).alias("fps"))

    def pairs_of(rows: dict, steps: Iterator) -> Iterator[pa.RecordBatch]:
        w = words_of(rows["fps"], bits)
        least, of, met = np.full(len(w), bits + 1), np.zeros(len(w), np.int64), np.zeros(len(w), bool)
        for i, j in steps:
            met[i[i != j]] = True
            below = np.flatnonzero(j < i)
            for at in range(0, len(below), 1 << 17):
                x, y = i[below[at : at + (1 << 17)]], j[below[at : at + (1 << 17)]]
                d = np.bitwise_count(w[x] ^ w[y]).sum(axis=1).astype(np.int64)
                order = np.lexsort((y, d, x))
                x, y, d = x[order], y[order], d[order]
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else order
                x, y, d = x[first], y[first], d[first]
                less = d < least[x]
                least[x[less]], of[x[less]] = d[less], y[less]
        b = np.flatnonzero(met)
        a = rows["fps"].take(pa.array(of[b], mask=least[b] > bits))
        yield pa.RecordBatch.from_arrays([a, rows["fps"].take(pa.array(b)), pa.array(least[b])], ["a", "b", "d"])

    found = over_buckets(dealt.where(F.size("fps") > 1).select("fps"), bits, radius, pairs_of, "a binary, b binary, d long")
    return found.groupBy("b").agg(F.min(F.when(F.col("a").isNotNull(), F.struct("d", "a"))).alias("x")).select("b", "x.a"), hot


def blocks(rows: DataFrame) -> DataFrame:
    """block, path, same, fps, labels, parts: of rows (key, path, fp, label, size) the sets in which every two of a key
    with different labels meet.

    A key of more than SAMPLED_BUCKET rows, or of sets of more than BLOCK_BYTES, is cut into parts, and each two of its parts meet
    in a set of their own, and each with itself (``same``); parts of the label that most of its rows have don't meet one
    another. A key with one label has nothing to compare.
    """
    each = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    most = F.max(F.struct("n", "bytes", "label"))
    keys = each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), most.alias("m"), F.count("*").alias("labels")).where("labels > 1")
    keys = materialise(keys.select("key", "n", "bytes", F.col("m.n").alias("n_most"), F.col("m.bytes").alias("bytes_most"), F.col("m.label").alias("most")), "mixed-keys")
    parts = lambda n, size: F.greatest(F.ceil(n / (SAMPLED_BUCKET // 2)), F.ceil(size / (BLOCK_BYTES // 2)), F.lit(1))
    p, q = parts(F.col("n") - F.col("n_most"), F.col("bytes") - F.col("bytes_most")), parts(F.col("n_most"), F.col("bytes_most"))
    small = (F.col("n") <= SAMPLED_BUCKET) & (F.col("bytes") <= BLOCK_BYTES)
    main = F.col("label") == F.col("most")
    zero = F.lit(0).cast("long")
    dealt = rows.join(keys, "key").withColumn("p", p).withColumn("q", q)
    part = F.when(small, zero).when(main, F.col("p") + F.pmod(F.xxhash64("fp"), F.col("q"))).otherwise(F.pmod(F.xxhash64("fp"), F.col("p")))
    others = F.when(small, F.array(zero)).when(main, F.sequence(zero, F.col("p") - 1)).otherwise(F.sequence(zero, F.col("p") + F.col("q") - 1))
    met = dealt.select("key", "path", "fp", "label", part.cast("long").alias("part"), others.alias("others")).select("key", "path", "fp", "label", "part", F.explode("others").alias("other"))
    sets = met.groupBy("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")).agg(F.first("path").alias("path"), F.collect_list(F.struct("fp", "label", "part")).alias("s")).where(F.size("s") > 1)
    return sets.select(F.xxhash64("key", "x", "y").alias("block"), "path", (F.col("x") == F.col("y")).alias("same"), *[F.col(f"s.{c}").alias(f"{c}s") for c in ("fp", "label", "part")])


def apart(w: np.ndarray, labels: np.ndarray, parts: np.ndarray, same: np.ndarray, table: np.ndarray, on: np.ndarray, steps: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs that steps find those that nobody else looks at: i < j, of different labels, of different parts if the
    set is of two, and without an earlier mask (``on``: by table) whose bits they share too."""
    for i, j in steps:
        keep = (i < j) & (labels[i] != labels[j]) & (same[i] | (parts[i] != parts[j]))
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            differ = w[x] ^ w[y]
            earlier = np.zeros(len(x), bool)
            for t in range(int(table[x].max(initial=0))):
                earlier |= ((differ & on[t]) == 0).all(axis=1) & (t < table[x])
            yield x[~earlier], y[~earlier]


def candidates(sets: DataFrame, masks: Masks) -> DataFrame:
    """block, path, same, fp, label, part: of every set the rows that have a pair to be looked at there."""
    on = np.array([masks.mask(p) for p in masks.first()])

    def pairs_of(rows: dict, steps: Iterator) -> Iterator[pa.RecordBatch]:
        w = words_of(rows["fps"], masks.bits)
        as_array = lambda c: rows[c].to_numpy(zero_copy_only=False)
        hit = np.zeros(len(w), bool)
        for x, y in apart(w, as_array("labels"), as_array("parts"), as_array("same"), as_array("path").astype(np.int64), on, steps):
            hit[x] = hit[y] = True
        at = pa.array(np.flatnonzero(hit))
        yield pa.RecordBatch.from_arrays([rows[c].take(at) for c in ("block", "path", "same", "fps", "labels", "parts")], ["block", "path", "same", "fp", "label", "part"])

    return over_buckets(sets, masks.bits, masks.radius, pairs_of, "block long, path string, same boolean, fp binary, label long, part long")


def jaccard_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of pairs of sets (ascending values, each once); two empty sets are equal.

    Values that only one set has are left out; the others are numbered, and sets are bit rows over a slice of the
    numbers at a time, so pairs are counted by AND and popcount, and memory stays bounded.
    """
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number, minlength=1)[number] > 1 if len(flat) else new
    number, owner = number[shared], owner[shared]
    number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1 if len(number) else number
    both = np.zeros(len(i), np.int64)
    width = 1 << 13
    for first in range(0, int(number.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(number, [first, first + width])
        rows = np.zeros((len(sets), width // 8), np.uint8)
        at = number[a:b] - first
        np.bitwise_or.at(rows, (owner[a:b], at >> 3), (1 << (at & 7)).astype(np.uint8))
        rows = rows.view(np.uint64)
        for k in range(0, len(i), 1 << 13):
            both[k : k + (1 << 13)] += np.bitwise_count(rows[i[k : k + (1 << 13)]] & rows[j[k : k + (1 << 13)]]).sum(axis=1, dtype=np.int64)
    union = sizes[i] + sizes[j] - both
    return np.where(union == 0, 1.0, both / np.maximum(union, 1))


def verified_blocks(found: DataFrame, sets: DataFrame, masks: Masks, least: float) -> DataFrame:
    """a, b: links within each block of candidates() that connect what its pairs of that similarity connect.

    sets: fp, shingles, each fp once. Sets come to the blocks, pairs never leave them: a block of n gives n - 1 links at
    most, however many pairs it has, and pairs that turn out not to be alike cost nothing beyond their comparison.
    """
    on = np.array([masks.mask(p) for p in masks.first()])
    held = found.join(sets, "fp")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("fp")
        fps = group.column("fp").to_pylist()
        w = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)[:, : masks.bits // 64]
        shingles = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        as_array = lambda c: group.column(c).to_numpy()
        root = np.arange(len(fps))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        steps = near_steps(w, [len(fps)], masks.radius)
        for i, j in apart(w, as_array("label"), as_array("part"), as_array("same"), as_array("path").astype(np.int64), on, steps):
            size = np.array([len(x) for x in shingles])
            likely = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])
            i, j = i[likely], j[likely]
            good = jaccard_pairs(shingles, i, j) >= least
            for x, y in zip(i[good].tolist(), j[good].tolist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        child = [k for k in range(len(fps)) if find(k) != k]
        return pa.Table.from_arrays([pa.array([fps[root[k]] for k in child], pa.binary()), pa.array([fps[k] for k in child], pa.binary())], ["a", "b"])

    return held.groupBy("block").applyInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), each b once, whose sets have a Jaccard similarity of at least ``least``. sets: fp, shingles.

    The sets of a, which many pairs may share, are joined by (node, salt), so that such a node is spread over tasks.
    """
    now = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    hubs = now.select(F.col("a").alias("fp"), "salt").distinct().join(sets, "fp").select(F.col("fp").alias("a"), "salt", F.col("shingles").alias("of_a"))
    now = now.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("of_b")), "b").join(hubs, ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    alike.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                alike.append(common >= least * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(alike, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return arrow_pass(now.select("a", "b", "of_a", "of_b"), run, "a binary, b binary")


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose fp is in ``wanted`` (fp, each once).

    First a bitmap of MAP_BITS hashed places, 131,072 words at any size, is broadcast, so that rows that aren't wanted
    mostly stay out of the join's shuffle as long as less than millions are wanted; then the join decides. It is an inner
    join, as a semi-join would be pushed below the one with the bitmap.
    """
    place = F.pmod(F.xxhash64("fp"), F.lit(MAP_BITS))
    bit = lambda: F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = wanted.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit()).alias("bits"))
    likely = rows.withColumn("place", place).withColumn("word", F.floor(F.col("place") / 64)).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit()) != 0)
    return likely.select(*rows.columns).join(wanted, "fp")


def distance_at(similarity: float, bits: int, deviations: float = 0) -> float:
    """The distance of fingerprints that sets of a Jaccard similarity are expected to have, and so many standard deviations
    more: each bit differs with the angle's share of the half turn."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits * p + deviations * math.sqrt(bits * p * (1 - p))


def alike(docs: DataFrame, bits: int, radius: int, least: float) -> DataFrame:
    """node, root: the components of the pairs within the radius that share a mask's bits and are at least so alike.

    ``docs`` (written): signatures(). First each node is tried with its nearest lower one, which joins a large group of
    near copies at a linear cost; then, of the nodes that meet any other, all pairs that are not in one component yet,
    inside their blocks. So no found pair goes unverified that could join two.
    """
    spark, place = docs.sparkSession, written()
    nodes = materialise(docs.select("fp").distinct(), "distinct-sets")
    masks = Masks(bits, radius, nodes.count(), distance_at(least, bits, 1))
    rows = keyed(nodes, masks, masks.first())
    near_ones, hot = nearest_lower(rows, bits, radius)
    near_ones = materialise(near_ones, "nearest")
    met = near_ones.select(F.col("b").alias("fp"))
    if not hot.isEmpty():
        met = met.union(rows.join(hot, "key", "left_semi").select("fp")).distinct()
    held = among(docs.where("shingles is not null").select("fp", "shingles"), materialise(met, "met"))
    sets = materialise(held.groupBy("fp").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    first = materialise(verified(near_ones.where("a is not null").select("a", "b"), sets, least), "verified")
    roots_of = components(first)
    named = sets.select("fp", F.octet_length("shingles").cast("long").alias("size")).join(roots_of.withColumnRenamed("node", "fp"), "fp", "left")
    named = materialise(named.select("fp", F.xxhash64(F.coalesce("root", "fp")).alias("label"), "size"), "labels")
    found = materialise(candidates(blocks(keyed(named, masks, masks.first(), NODE)), masks), "candidates")
    second = materialise(verified_blocks(found, sets, masks, least), "verified")
    out = materialise(roots_of if second.isEmpty() else components(first.union(second)), "near-duplicates")
    discard(spark, place, written() - 1)
    return out


# --- components ---------------------------------------------------------------------------------------------------


def with_least(rows: DataFrame, key: str, value: str, by: str, name: str) -> DataFrame:
    """rows with ``name``, the least ``value`` among those of equal ``key``; nulls are the greatest.

    Minima are taken and joined by (key, salt), salt from ``by``, so that the rows of one key are spread over tasks.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.min(value).alias(name))
    least = parts.groupBy(key).agg(F.min(name).alias(name), F.collect_set("salt").alias("salts")).select(key, name, F.explode("salts").alias("salt"))
    return salted.join(least, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of the edges (a, b) the smallest node that they connect it with.

    Large stars and small stars in turn, each a grouped minimum and a join; every round's edges are written to the
    shared folder, and those of the round before are deleted. It ends when a round changes nothing, which it does once
    every component is a star. Repeated edges count once, edges of a node with itself not at all; no edges, no rows.
    """
    place = written()
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "b", "m").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b").distinct()
        low = with_least(large, "a", "b", "b", "m")
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialise(small.where("a > b").distinct(), "edges")
        discard(edges.sparkSession, place, place + 1)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def groups(df: DataFrame, words: int = 3, bits: int = 64, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary), component_id of every row: the smallest doc_id that links reach, its own included.

    Texts whose fingerprints differ in at most ``radius`` bits are linked. A null text is an empty one; texts without
    words have fingerprint zero and are linked like any others; texts of fewer words than a shingle are one shingle. Null ids
    are never the smallest; a group of nulls only has a null component_id. Repeated rows are linked as equal texts are.
    An empty table gives an empty result. Other columns, whatever they are called, are not read.

    Rows are joined with their group by (fingerprint, salt), so that a third of all rows may be copies of one text.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    docs = materialise(fingerprints(df, words, bits, id_col, text_col).withColumn("salt", salt), "fingerprints")
    by_salt = docs.groupBy("fp", "salt").agg(F.min("doc_id").alias("rep"))
    reps = materialise(by_salt.groupBy("fp").agg(F.min("rep").alias("rep"), F.collect_set("salt").alias("salts")), "distinct-fingerprints")
    roots_of = components(links(reps, bits, radius))
    named = reps.join(roots_of, reps["fp"] == roots_of["node"], "left").select("fp", "rep", "salts", F.coalesce("root", "fp").alias("root"))
    several = with_least(materialise(named, "fingerprint-roots"), "root", "rep", "fp", "component_id")
    by_fp = several.select("fp", "component_id", F.explode("salts").alias("salt"))
    return docs.join(by_fp, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, words: int = 5, bits: int = 256, radius: int = 53, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of df without near duplicates: one row of each group stays, all columns as they are.

    Groups are the components of pairs whose sets of shingles have a Jaccard similarity of at least ``least``; each pair
    is verified on the sets (64-bit hashes) before it counts. Fingerprints only find the pairs. At a similarity of 0.8
    bits differ with probability arccos(2J / (1 + J)) / pi = 0.152, so 38.8 of 256 are expected, with a standard
    deviation of 5.7; the radius leaves a margin of 2.5 deviations, and the masks find pairs one deviation away with
    probability RECALL, so of pairs at 0.8 itself about 0.97 are found, and more of those above, at any size.

    The row with the smallest id stays; rows without an id come last, so one of them stays only if its group has no id.
    Ties (rows that share an id) go to the smaller MD5 of the text, then to the smaller hash of the whole row; of rows
    that are equal in everything one stays. Rows that share an id but not their text are documents of their own. Null
    texts and texts without words have the same, empty set of shingles: one of all of them stays. An empty table gives
    an empty result. Names are matched by case only if two columns differ in nothing else; extra columns may be called
    anything.
    """
    doc_id, text = F.col(f"c{place_of(df, id_col)}"), F.coalesce(F.col(f"c{place_of(df, text_col)}").cast("string"), F.lit(""))
    own = [doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.md5(text).alias("own"), row_hash(df).alias("whole")]
    keys = ["no_id", "doc_id", "own", "whole"]
    docs = materialise(signatures(numbered(df).select(*own, text.alias("text")), words, bits), "signatures")
    each = docs.groupBy("fp", *keys).agg(F.count("*").alias("n"))
    reps = each.groupBy("fp").agg(F.min(F.struct(*keys, "n")).alias("rep"))
    roots_of = alike(docs, bits, radius, least)
    named = reps.join(roots_of, reps["fp"] == roots_of["node"], "left").select("rep", F.coalesce("root", "fp").alias("root"))
    keep = materialise(named.groupBy("root").agg(F.min("rep").alias("rep")).select(*[F.col(f"rep.{c}").alias(f"keep_{c}") for c in (*keys, "n")]), "kept-rows")
    rows = numbered(df).select("*", *own)
    on = [F.col(c).eqNullSafe(F.col(f"keep_{c}")) for c in keys]
    out = rows.join(keep.where("keep_n = 1"), on, "left_semi")
    if not keep.where("keep_n > 1").isEmpty():
        out = out.union(rows.join(keep.where("keep_n > 1"), on, "left_semi").dropDuplicates(keys))
    return out.drop(*keys).toDF(*df.columns)
