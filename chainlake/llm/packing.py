"""Lexical retrieval packing: sequences of a fixed length, filled by a document and its nearest unused neighbours.

1. Every text is encoded once; its ids are written to the shared folder. Every task also writes the document
   frequencies of its rows. These are summed; a table of the vocabulary's size (a fixed bound) is all that reaches the
   driver.
2. Every document gets a key: its TELLING ids of highest weight (term frequency and rarity), the most telling first.
   Documents are sorted by key over the whole corpus, in ranges, so those with the same telling ids stand together. A
   frequent first id is cut by the second and so on, equal keys by a hash of the document: no key is too large. Where
   the ranges begin is told by the keys of SAMPLES documents a task.
3. The sorted stream of a task is cut into shards of about SHARD tokens, one of which is in memory at a time.
4. Each shard builds its BM25 inverted index. A seed document is looked up with all of its ids, and its unused
   neighbours, best first, fill the window. What doesn't fit is cut and seeds the next window, so only a shard's last
   window is short.

Neighbours are those of the shard, so a window's best neighbour in the whole corpus is found only if the keys bring it
there. An exact search would read, for each seed, the postings of all of its ids: a share of the corpus that doesn't
fall as it grows.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE, Memo, byte_symbols
from .common import arrow_pass, id_and_text, materialise

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
#: Tokens of one shard; a shard holds one document more at most.
SHARD = 1 << 20
#: Shards of one task, and tasks at most; beyond, a task takes more shards, one after the other.
TASK_SHARDS, MOST_TASKS = 4, 20_000
#: Ids that make up a document's key, and documents a task whose keys are looked at to deal out all of them.
TELLING, SAMPLES = 4, 64
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Postings of an id that over one in so many documents have are kept as a row of all documents.
DENSE = 8
#: Neighbours that are ranked at once.
SOON = 32

#: White space separates words, and is dropped, so texts are encoded word by word.
WORD = re.compile(f"[^{SPACE}]+")
#: In lower-case Latin-1, words are cut further, by the tokenizer's own pattern: letters, one digit, other marks.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(f"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^{SPACE}{_L}{_N}]+")
LETTERS, DIGIT = re.compile(f"[{_L}]+").fullmatch, re.compile(f"[{_N}]").fullmatch


LOWER = bytes(ord(chr(b).lower()) for b in range(256))


def pieces(text: str) -> list[str]:
    """Parts of a text that are encoded by themselves. Lower-casing Latin-1 and composing it are what the tokenizer does
    too; other texts, and texts that may hold a special token, are left to it word by word."""
    if "<|" in text:
        return WORD.findall(text)
    if text.isascii():
        return PIECE.findall(text.lower())
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return WORD.findall(text)
    return PIECE.findall(raw.translate(LOWER).decode("latin-1"))  # faster than lower(), which looks up each character


def tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and how often each occurs."""
    x = np.sort(x)
    last = np.flatnonzero(np.append(x[1:] != x[:-1], True)) if len(x) else np.empty(0, np.int64)
    return x[last], np.diff(last, prepend=-1)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class PieceIds(Memo):
    """Ids by piece, as bytes, by the tokenizers library.

    A run of lower-case Latin-1 letters is one word to the tokenizer and stays as it is, so it goes to the library's
    merges at once; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        whole, merges, self.kind = tokenizer(path).encode, tokenizer(path).model.tokenize, width_of(path)
        stand_in, code = dict(enumerate(byte_symbols())), "H" if self.kind == "<u2" else "I"

        def encode(piece: str) -> bytes:
            if piece.isalpha() and piece.isascii() and piece.islower():
                return array(code, [t.id for t in merges(piece)]).tobytes()
            if LETTERS(piece):
                return array(code, [t.id for t in merges(piece.encode().decode("latin-1").translate(stand_in))]).tobytes()
            return array(code, whole(piece, add_special_tokens=False).ids).tobytes()

        super().__init__(encode)


class Encoder:
    """Ids of whole texts, many at a time.

    Texts of Latin-1 without special tokens are laid end to end and cut into pieces by array operations: a piece starts
    where the class of its bytes changes, at every digit, and around contractions. A piece's hash is a difference of
    prefix sums of a polynomial modulo 2^64, brought to its start by the inverse power. Known hashes are found in an
    open-addressing table, which says where the piece's ids stand; pieces that are new, or too long to be remembered, go
    through PieceIds. Other texts are encoded by themselves.
    """

    #: Places of the table, and of pieces in it at most; then it starts anew. Bytes of text taken at once, which hold fewer.
    PLACES, MOST, AT_ONCE = 1 << 21, 1 << 20, 1 << 20
    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, path: str):
        self.known = PieceIds(path)
        self.kind = np.dtype(self.known.kind)
        self.classes = np.full(256, 3, np.uint8)  # 0: white space, 1: letters, 2: digits, 3: the rest
        for b in range(256):
            c = chr(b)
            self.classes[b] = 0 if not WORD.match(c) else 1 if LETTERS(c) else 2 if DIGIT(c) else 3
        self.powers, self.back = (self._powers(b, self.AT_ONCE) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        self.clear()

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def clear(self) -> None:
        self.hashes, self.places = np.zeros(self.PLACES, np.uint64), np.zeros(self.PLACES, np.int64)
        self.first, self.count, self.n = np.zeros(self.MOST, np.int64), np.zeros(self.MOST, np.int64), 0
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in turn."""
        done: list[bytes | None] = []
        part: list[bytes] = []
        size = 0
        for t in texts:
            raw = None
            if "<|" not in t:
                try:
                    raw = t.encode("latin-1")
                except UnicodeEncodeError:
                    pass
            if raw is None or len(raw) >= self.AT_ONCE // 2:
                done.append(b"".join(map(self.known.__getitem__, pieces(t))))
                continue
            if size + len(raw) >= self.AT_ONCE:
                yield from self.filled(done, part)
                done, part, size = [], [], 0
            done.append(None)
            part.append(raw)
            size += len(raw) + 1
        yield from self.filled(done, part)

    def filled(self, done: list[bytes | None], part: list[bytes]) -> Iterator[bytes]:
        found = iter(self.latin(part)) if part else iter(())
        for d in done:
            yield next(found) if d is None else d

    def latin(self, raws: list[bytes]) -> list[bytes]:
        text = b"\n".join([*raws, b""]).translate(LOWER)
        x = np.frombuffer(text, np.uint8)
        kind = self.classes[x]
        starts = np.empty(len(x), bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        starts |= kind == 2
        quotes = np.flatnonzero((x[:-1] == 39) & starts[:-1] & (kind[1:] == 1))
        if len(quotes):
            self.contract(x, kind, starts, quotes)
        first = np.flatnonzero(starts)
        end = np.append(first[1:], len(x))
        inside = kind[first] > 0
        first, end = first[inside], end[inside]
        sums = np.empty(len(x) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.powers[: len(x)], out=sums[1:])
        length = end - first
        h = (sums[end] - sums[first]) * self.back[first] + length.astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h |= np.uint64(1)
        place = self.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.n + len(new) > self.MOST:
                self.clear()
                place, new = np.full(len(h), -1), np.arange(len(h))
            distinct, at = np.unique(h[new], return_index=True)
            at = new[at]
            self.learn(distinct, [text[a:b].decode("latin-1") for a, b in zip(first[at].tolist(), end[at].tolist())])
            place[new] = self.find(h[new])
        n = self.count[place]
        total = np.cumsum(n)
        ids = self.flat[np.repeat(self.first[place] - total + n, n) + np.arange(total[-1] if len(total) else 0)]
        bounds = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        upto = np.concatenate([[0], total])[np.searchsorted(first, bounds)]
        raw, size = ids.tobytes(), self.kind.itemsize
        return [raw[a * size : b * size] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]

    @staticmethod
    def contract(x: np.ndarray, kind: np.ndarray, starts: np.ndarray, quotes: np.ndarray) -> None:
        """A quote by itself takes the letters of a contraction that follow it; what stands behind them starts anew."""
        a, b = x[quotes + 1], x[np.minimum(quotes + 2, len(x) - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for at, n in ((quotes[one], 2), (quotes[two], 3)):
            starts[at + 1] = False
            behind = at + n
            behind = behind[behind < len(x)]
            starts[behind[kind[behind] == 1]] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the known pieces, -1 for others."""
        at = (h >> np.uint64(64 - 21)).astype(np.int64)
        held = self.hashes[at]
        out = np.where(held == h, self.places[at], -1)
        left = np.flatnonzero((held != h) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) % self.PLACES
            held = self.hashes[at[left]]
            hit = held == h[left]
            out[left[hit]] = self.places[at[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def learn(self, hashes: np.ndarray, new: list[str]) -> None:
        """Encodes pieces and puts them into the table; hashes are distinct and not in it."""
        raw = [self.known.make(p) for p in new]
        n = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(raw), self.kind)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.kind)])
        self.flat[self.used : self.used + len(ids)] = ids
        numbers = np.arange(self.n, self.n + len(new))
        self.first[numbers], self.count[numbers] = self.used + np.cumsum(n) - n, n
        self.n, self.used = self.n + len(new), self.used + len(ids)
        at, left = (hashes >> np.uint64(64 - 21)).astype(np.int64), np.arange(len(new))
        while len(left):
            free = left[self.hashes[at[left]] == 0]
            _, one = np.unique(at[free], return_index=True)  # of several for one place the first takes it
            taken = free[one]
            self.hashes[at[taken]], self.places[at[taken]] = hashes[taken], numbers[taken]
            left = left[self.hashes[at[left]] != hashes[left]]
            at[left] = (at[left] + 1) % self.PLACES


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps what it has learned from task to task."""
    return Encoder(path)


def width_of(path: str) -> str:
    """How ids are stored: two bytes if the vocabulary allows it."""
    return "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def encoded(df: DataFrame, vocab_path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (binary, little-endian, END_ID included), n_tokens and a number of its own of every row; written.

    Rows without ids hold what a task has counted: ``df``, pairs of (id, documents) as 64-bit numbers. A null text is
    END_ID alone, as an empty one is; an empty table gives no rows.
    """
    rows = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = encoder(vocab_path), TaskContext.get().partitionId() << 40
        end, n_vocab = np.array([END_ID], encode.kind).tobytes(), tokenizer(vocab_path).get_vocab_size(with_added_tokens=True)
        seen = np.zeros(n_vocab, np.int64)
        names, doc_type = ["doc_id", "ids", "n_tokens", "row", "df"], None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            ids, tokens = [], []
            for own in encode.texts(batch.column("text").to_pylist()):
                raw = own + end
                x = np.frombuffer(raw, encode.kind)
                seen[tally(x)[0]] += 1
                ids.append(raw)
                tokens.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array(np.arange(n, n + len(ids))), pa.nulls(len(ids), pa.binary())], names)
            n += len(ids)
        if doc_type is not None:
            at = np.flatnonzero(seen)
            counted = np.stack([at, seen[at]], 1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([counted], pa.binary())], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialise(arrow_pass(rows, run, f"doc_id {kind}, ids binary, n_tokens long, row long, df binary"), "packing-ids")


def document_frequencies(table: DataFrame, n_vocab: int) -> np.ndarray:
    """By id the number of documents that have it, from what encoded() has counted; 0 for ids that none has, all 0 for an
    empty table. Repeated rows count each. Tasks add up and return n_vocab rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_vocab, np.int64)
        for batch in batches:
            for raw in batch.column("df"):
                at, k = np.frombuffer(raw.as_py(), "<i8").reshape(-1, 2).T
                n[at] += k
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    out = np.zeros(n_vocab, np.int64)
    for r in arrow_pass(table.where("df is not null").select("df"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def telling_key(raw: bytes, kind: str, weight: np.ndarray) -> bytes:
    """A document's telling ids as bytes that are ordered as the ids are.

    Ids of weight 0 tell nothing and are left out; fewer ids than TELLING give a shorter key.
    """
    terms, tf = tally(np.frombuffer(raw, kind)[:-1])
    w = tf / (tf + K1) * weight[terms]
    if len(w) > TELLING:
        best = np.argpartition(-w, TELLING)[:TELLING]
        terms, w = terms[best], w[best]
    return terms[np.lexsort((terms, -w))][: int((w > 0).sum())].astype(">u4").tobytes()


def cut_points(docs: DataFrame, n_docs: int, parts: int, kind: str, weight: np.ndarray) -> list[tuple[bytes, int, int]]:
    """The (key, salt, row) at which tasks begin but the first: keys of about SAMPLES documents a task, chosen by a hash of
    their rows, cut at equal numbers of tokens. That bounds what the driver holds; all documents are dealt by what comes of it."""
    if parts < 2:
        return []
    share = min(1.0, SAMPLES * parts / n_docs)
    chosen = docs.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < max(1, math.ceil(share * (1 << 20)))).select("salt", "row", "ids", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([telling_key(x.as_buffer(), kind, weight.value) for x in batch.column("ids")], pa.binary()), *(batch.column(c) for c in ("salt", "row", "n_tokens"))], ["key", "salt", "row", "n_tokens"])

    rows = sorted((bytes(r["key"]), r["salt"], r["row"], r["n_tokens"]) for r in arrow_pass(chosen, run, "key binary, salt long, row long, n_tokens long").collect())
    upto = np.cumsum([r[3] for r in rows])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts) if len(rows) else []
    return [rows[k][:3] for k in at]


def dealt(docs: DataFrame, cuts: list[tuple[bytes, int, int]], parts: int, kind: str, weight) -> DataFrame:
    """doc_id, ids of every document, in tasks between cuts and there in the order of key, salt and row."""
    points = docs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [telling_key(x.as_buffer(), kind, weight.value) for x in batch.column("ids")]
            part = [bisect_right(points.value, k) for k in zip(keys, batch.column("salt").to_pylist(), batch.column("row").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ids", "row", "salt")), pa.array(keys, pa.binary()), pa.array(part, pa.int32())], ["doc_id", "ids", "row", "salt", "key", "part"])

    keyed = arrow_pass(docs.select("doc_id", "ids", "row", "salt"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, row long, salt long, key binary, part int")
    return keyed.repartitionById(parts, "part").sortWithinPartitions("key", "salt", "row").select("doc_id", "ids")


class Shard:
    """The BM25 inverted index of one shard's documents: postings by id, with the weight of each.

    Frequent ids have rows of weights over all documents besides: at most DENSE numbers for each posting.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, self.n = docs, len(docs)
        lengths = np.array([len(d) for d in docs])
        kind = np.uint32 if self.n << 16 < 1 << 32 and docs[0].dtype.itemsize == 2 else np.int64
        keys, tf = tally(np.concatenate(docs).astype(kind) * kind(self.n) + np.repeat(np.arange(self.n, dtype=kind), lengths))
        term, self.doc = keys // kind(self.n), (keys % kind(self.n)).astype(np.int64)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / mean))
        self.terms, starts = np.unique(term, return_index=True)
        self.starts = np.append(starts, len(term))
        self.slot = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        frequent = np.flatnonzero(np.diff(self.starts) * DENSE > self.n)
        self.row = np.full(len(self.terms), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.n))
        held = self.row[self.slot] >= 0
        self.dense[self.row[self.slot[held]], self.doc[held]] = self.weight[held]
        self.by_doc = np.argsort(self.doc.astype(np.uint16 if self.n <= 1 << 16 else np.int64), kind="stable")
        self.cut = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.n))])

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """The unused documents that share an id with the seed, best first, the first on ties."""
        own = self.slot[self.by_doc[self.cut[seed] : self.cut[seed + 1]]]
        row = self.row[own]
        score = np.add.reduce(self.dense[row[row >= 0]], axis=0)
        own = own[row < 0]
        first, n = self.starts[own], self.starts[own + 1] - self.starts[own]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        score += np.bincount(self.doc[at], self.weight[at], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        if len(found) > 2 * SOON:  # a window takes a few; the others are sorted only if they are asked for
            least = np.partition(score[found], len(found) - SOON)[len(found) - SOON]
            parts = found[score[found] >= least], found[score[found] < least]
        else:
            parts = (found,)
        for part in parts:
            yield from part[np.argsort(-score[part], kind="stable")].tolist()


def fill(index: Shard, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (doc, start, length, sequence, offset) that hold every id of the shard once."""
    used = np.zeros(index.n, bool)
    free = 0  # documents before it are used
    sequence = offset = 0
    queue: Iterator[int] = iter(())
    doc, start = -1, 0
    seed = -1
    while True:
        if doc < 0:
            doc = next((d for d in queue if not used[d]), -1)
            if doc < 0:
                while free < index.n and used[free]:
                    free += 1
                if free == index.n:
                    return
                doc = free
            used[doc], start = True, 0
        if not offset:
            seed, queue = doc, iter(())
        n = min(len(index.docs[doc]) - start, window - offset)
        yield doc, start, n, sequence, offset
        start, offset = start + n, offset + n
        done = start == len(index.docs[doc])
        if offset == window:
            sequence, offset = sequence + 1, 0
        elif done and doc == seed:
            queue = index.neighbours(seed, used)
        if done:
            doc = -1


def pack(df: DataFrame, vocab_path: str, window: int = WINDOW, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A null or empty text is END_ID alone. A null id stays null; repeated rows are packed each, so a doc_id may have the
    same piece twice, and any number of them is spread over shards. Ties go to the document that comes first by a hash
    of its id and ids. An empty table gives an empty result. Other columns, whatever they are called, are not read.
    sequence_id is unique over all shards; the same files give the same sequences.
    """
    table = encoded(df, vocab_path, id_col, text_col)
    kind, n_vocab = width_of(vocab_path), tokenizer(vocab_path).get_vocab_size(with_added_tokens=True)
    docs = table.where("ids is not null").withColumn("salt", F.xxhash64("doc_id", "ids"))
    sums = docs.agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).first()
    n_docs, n_tokens = sums["docs"], sums["tokens"] or 0
    df_of = document_frequencies(table, n_vocab)
    idf = np.log1p((n_docs - df_of + 0.5) / (df_of + 0.5))
    mean = n_tokens / max(n_docs, 1)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(idf)  # a number for each id of the vocabulary
    telling = spark.sparkContext.broadcast(np.where(df_of > 1, idf, 0.0))  # an id of one document tells of no neighbour
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(MOST_TASKS, max(-(-n_tokens // (TASK_SHARDS * shard)), min(cores, -(-n_tokens // shard)))))
    ordered = dealt(docs, cut_points(docs, n_docs, parts, kind, telling), parts, kind, telling)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack_shard(rows: list[tuple], top: int, doc_type: pa.DataType) -> pa.RecordBatch:
        held = [np.frombuffer(r[1], kind) for r in rows]
        index = Shard(held, shared.value, mean)
        out = [(rows[d][0], a, n, zlib.crc32(held[d][a : a + n].astype("<u4").tobytes()), len(held[d]), top + s, at) for d, a, n, s, at in fill(index, window)]
        return pa.RecordBatch.from_arrays([pa.array(c, doc_type if k == 0 else pa.int64()) for k, c in enumerate(zip(*out))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size, rows = TaskContext.get().partitionId(), 0, 0, []
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                rows.append((doc_id, ids))
                size += len(ids) // np.dtype(kind).itemsize
                if size >= shard:
                    yield pack_shard(rows, task << 44 | n << 24, doc_type)
                    n, size, rows = n + 1, 0, []
        if rows:
            yield pack_shard(rows, task << 44 | n << 24, doc_type)

    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(ordered, run, f"doc_id {doc_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
