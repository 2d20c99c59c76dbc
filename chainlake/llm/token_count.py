"""Token counts by byte-pair merging on a heap and a linked list, without emitting identifiers.

A piece starts as one symbol per byte. The heap holds the adjacent pairs that have a rank; the pair of lowest rank
(leftmost on ties) is popped, its two symbols become one, and the pairs with the new neighbours go onto the heap.
The count is the initial number of symbols minus the merges made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, Vocabulary, vocabulary
from .common import arrow_pass, id_and_text


def merges_made(symbols: list[int], merge: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges the symbols allow; symbols is used up."""
    heap = [(*r, i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := merge.get(p))]
    if not heap:
        return 0
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    symbols.append(-1)  # the end: no pair has it
    heapify(heap)
    made = 0
    while heap:
        _, new, i, a, b = heappop(heap)
        j = after[i]
        if symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = new, -2
        k = after[i] = after[j]
        before[k] = i
        made += 1
        if r := merge.get(p := (new, symbols[k])):
            heappush(heap, (*r, i, *p))
        if (h := before[i]) >= 0 and (r := merge.get(p := (symbols[h], new))):
            heappush(heap, (*r, h, *p))
    return made


def count_piece(piece: str, merge: dict[tuple[int, int], tuple[int, int]]) -> int:
    symbols = list(piece.encode("utf-8", "surrogatepass"))
    n = len(symbols)
    return n - merges_made(symbols, merge)


class TokenCounter:
    """Tokens of a text; each distinct piece is counted when first met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.memo = vocab, Memo(lambda piece: count_piece(piece, vocab.merge))

    def of(self, text: str) -> int:
        parts = self.vocab.parts(text)
        return len(parts) // 2 + sum(sum(map(self.memo.__getitem__, self.vocab.pieces(p))) for p in parts[::2])


@lru_cache(maxsize=2)
def counter(vocab_path: str) -> TokenCounter:
    """One for each Python worker, which keeps what it has learned from task to task."""
    return TokenCounter(vocabulary(vocab_path))


def token_counts(df: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; one narrow pass.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text count as one token each. A null id
    stays null; repeated rows are counted each; an empty table gives an empty result. Other columns are not read.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocab_path)
        for batch in batches:
            n = [counts.of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_pass(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
