"""BPE encoding by a pair occurrence index, and decoding.

All pieces of a batch that are not known yet lie side by side in one symbol array. An index maps each adjacent pair
to all its positions there. The active ranks are applied in ascending order; one application merges the pair at all
its positions, in every piece at once, and moves the neighbouring positions to the lists of the new pairs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONGEST, Memo, Vocabulary, vocabulary
from .common import arrow_pass, id_and_text, numbered, place_of

#: Characters of text that share one index, unless a single text is longer.
INDEXED = 4 << 20


def encode_pieces(pieces: list[bytes], merge: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """The symbols that are left of each piece."""
    symbols: list[int] = []
    for p in pieces:
        symbols += p
        symbols.append(-1)  # no pair crosses the end of a piece
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    positions: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        positions[pair].append(i)
    active = [(*merge[p], p) for p in positions.keys() & merge.keys()]
    heapify(active)
    while active:
        _, new, pair = heappop(active)
        a, b = pair
        for i in sorted(positions.pop(pair)):
            j = after[i]
            if symbols[i] != a or symbols[j] != b:
                continue  # taken by an occurrence that overlaps
            symbols[i], symbols[j] = new, -2
            k = after[i] = after[j]
            before[k] = i
            if (near := (new, symbols[k])) in merge:
                if at := positions.get(near):
                    at.append(i)
                else:
                    positions[near] = [i]
                    heappush(active, (*merge[near], near))
            h = before[i]
            if (near := (symbols[h], new)) in merge and h >= 0:
                if at := positions.get(near):
                    at.append(h)
                else:
                    positions[near] = [h]
                    heappush(active, (*merge[near], near))
    out, start = [], 0
    for p in pieces:
        end = start + len(p)
        out.append([s for s in symbols[start:end] if s >= 0])
        start = end + 1
    return out


class PieceIds(Memo):
    """Ids by piece; learn() encodes all that is new in one index."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(lambda piece: self.of_block([piece])[0])
        self.vocab = vocab

    def of_block(self, pieces: list[str]) -> list[tuple[int, ...]]:
        id_of = self.vocab.id_of.__getitem__
        return [tuple(map(id_of, x)) for x in encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces], self.vocab.merge)]

    def learn(self, pieces: set[str]) -> None:
        """Those that are too long to be remembered are left to be encoded where they stand."""
        new = [p for p in pieces if p not in self and len(p) <= LONGEST]
        known = [(p, self.old[p]) for p in new if p in self.old]
        fresh = [p for p in new if p not in self.old]
        for p, ids in chain(known, zip(fresh, self.of_block(fresh))):
            self.keep(p, ids)


class Spelled(PieceIds):
    """By piece the number of its ids, the ids in decimal, and the bytes that they decode to."""

    def of_block(self, pieces: list[str]) -> list[tuple[int, str, bytes]]:
        return [self.spell(ids) for ids in super().of_block(pieces)]

    def spell(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.vocab.bytes_of.__getitem__, ids))


def values_of(texts: list[str], known: PieceIds, special: dict) -> Iterator[list]:
    """For each text what is known of its pieces, and of special strings, in order; the texts of a call share one index."""
    vocab = known.vocab
    cuts = [[p if k % 2 else vocab.pieces(p) for k, p in enumerate(vocab.parts(t))] for t in texts]
    known.learn(set(chain.from_iterable(c for cut in cuts for c in cut[::2])))
    for cut in cuts:
        out: list = []
        for k, c in enumerate(cut):
            if k % 2:
                out.append(special[c])
            else:
                out.extend(map(known.__getitem__, c))
        yield out


def encode_texts(texts: list[str], known: PieceIds) -> Iterator[list[int]]:
    """The ids of each text, special strings included."""
    for values in values_of(texts, known, {s: (i,) for s, i in known.vocab.special.items()}):
        yield list(chain.from_iterable(values))


@lru_cache(maxsize=2)
def piece_ids(vocab_path: str) -> PieceIds:
    """One for each Python worker, which keeps what it has learned from task to task."""
    return PieceIds(vocabulary(vocab_path))


@lru_cache(maxsize=2)
def spelled(vocab_path: str) -> Spelled:
    return Spelled(vocabulary(vocab_path))


def decode(ids: Iterable[int], vocab: Vocabulary) -> str:
    """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def slices(texts: list[str], most: int = INDEXED) -> Iterator[list[str]]:
    """Texts in turn, so many that they hold about ``most`` characters."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row; one narrow pass.

    Null and empty texts have no ids. Ids, repeated rows and other columns: as for decode_documents.
    """
    rows = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_ids(vocab_path)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text").to_pylist()):
                ids = pa.array(encode_texts(part, known), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), ids], ["doc_id", "ids"])
                at += len(part)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_pass(rows, run, f"doc_id {kind}, ids array<int>")


def decode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; the inverse of encode_documents. Null ids give the empty text."""
    doc_id, ids = (F.col(f"c{place_of(df, c)}") for c in (id_col, ids_col))
    rows = numbered(df).select(doc_id.alias("doc_id"), ids.cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            text = pa.array([decode(x.as_py() or (), vocab) for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])

    return arrow_pass(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def codec_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one narrow pass.

    The digests are those of the comma-joined decimal ids and of the decoded text, so no list of ids leaves a task; what a
    piece's ids are in decimal and in bytes is remembered with them.
    Null and empty texts have no ids. A null id stays null; repeated rows are encoded each; an empty table gives an
    empty result. Other columns are not read.
    """
    rows = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spelled(vocab_path)
        special = {s: known.spell((i,)) for s, i in known.vocab.special.items()}
        for batch in batches:
            n, coded, decoded = [], [], []
            for part in slices(batch.column("text").to_pylist()):
                for values in values_of(part, known, special):
                    n.append(sum([v[0] for v in values]))
                    coded.append(hashlib.sha256(",".join([v[1] for v in values]).encode()).hexdigest())
                    text = b"".join([v[2] for v in values]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_pass(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
