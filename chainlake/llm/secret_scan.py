"""Secret scanning behind a trigram inverted index.

Each rule's regex is parsed and turned into a Boolean query over trigrams that any match must contain. A block of
documents gets postings (trigram -> documents) for the trigrams that some query uses; each query intersects and
unites postings, and only its candidates are verified with the regex. A rule without mandatory trigrams scans all.
Trigrams are those of the UTF-8 bytes with A-Z in lower case, so one index serves rules of either case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from re import _constants as op, _parser as parser  # the standard library's own parser, from Python 3.11 on; it has no public name

from .common import arrow_pass, id_and_text


@dataclass(frozen=True)
class Rule:
    """A match counts if the group has at least ``least`` characters; its span is that of the whole match."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0

    def compile(self) -> re.Pattern:
        return re.compile(self.regex, re.ASCII)


#: The base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Published formats of well-known credentials.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

#: Strings that a part of a regex is expanded to at most; beyond, the part counts as unknown.
EXPANDED = 64
#: Bytes of text in one index block, unless a single text is longer.
BLOCK = 8 << 20

Query = tuple  # ("all",) | ("tri", int) | ("and", queries) | ("or", queries)
ALL: Query = ("all",)


def _code(gram: str) -> int:
    a, b, c = gram.encode("latin-1")
    return a << 16 | b << 8 | c


def conj(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def disj(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_strings(strings: set[str]) -> Query:
    """What a text that contains one of the strings must contain."""
    return disj([conj([("tri", _code(s[i : i + 3])) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _known(tree) -> tuple[set[str] | None, Query]:
    """The strings that the sub-regex matches, if they are few; else None and what every match must contain."""
    run: set[str] | None = {""}  # what may stand just before the current place, since the last unknown part
    needs: list[Query] = []
    exact = True

    def flush() -> None:
        nonlocal run, exact
        needs.append(of_strings(run))
        run, exact = {""}, False

    for what, arg in tree:
        part: set[str] | None = None
        need: Query = ALL
        if what is op.LITERAL and arg < 128:
            part = {chr(arg).lower()}
        elif what is op.IN and all(k is op.LITERAL and v < 128 for k, v in arg):
            part = {chr(v).lower() for _, v in arg}
        elif what is op.SUBPATTERN:
            part, need = _known(arg[3])
        elif what is op.BRANCH:
            sides = [_known(t) for t in arg[1]]
            if all(s is not None for s, _ in sides):
                part = set().union(*(s for s, _ in sides))
            else:
                need = disj([n if s is None else of_strings(s) for s, n in sides])
        elif what is op.MAX_REPEAT or what is op.MIN_REPEAT:
            least, most, sub = arg
            one, inner = _known(sub)
            if one is not None and most == 1:
                part = one | ({""} if least == 0 else set())
            elif one is not None and 1 <= least <= 4 and len(one) ** least <= EXPANDED:
                times = {""}
                for _ in range(least):
                    times = {a + b for a in times for b in one}
                if least == most:
                    part = times
                else:  # so often at least: what stands before may be followed by it
                    grown = {a + b for a in run for b in times}
                    run = grown if len(grown) <= EXPANDED else run
            elif least >= 1:
                need = inner if one is None else of_strings(one)
        elif what is op.AT:
            part = {""}
        if part is not None and len(part) * len(run) <= EXPANDED:
            run = {a + b for a in run for b in part}
        else:
            flush()
            needs.append(of_strings(part) if part is not None else need)
    if exact:
        return run, ALL
    needs.append(of_strings(run))
    return None, conj(needs)


def trigram_query(rule: Rule) -> Query:
    """A Boolean query that the text of every match fulfils; ALL if the regex has no mandatory trigram."""
    strings, query = _known(parser.parse(rule.regex))
    return query if strings is None else of_strings(strings)


def grams(query: Query) -> set[int]:
    return {query[1]} if query[0] == "tri" else set() if query == ALL else set().union(*map(grams, query[1]))


class Index:
    """Postings of the wanted trigrams over the documents of one block."""

    def __init__(self, blobs: list[bytes], slots: np.ndarray, n_slots: int):
        self.size = len(blobs)
        data = np.frombuffer(b"\0\0".join([*blobs, b""]).translate(LOWER), np.uint8)
        ends = np.cumsum([len(b) + 2 for b in blobs])
        codes = data[:-2].astype(np.uint32) << 16 if len(data) > 2 else np.empty(0, np.uint32)
        codes |= data[1:-1].astype(np.uint32) << 8
        codes |= data[2:]
        slot = slots[codes]
        at = np.flatnonzero(slot)
        hits = np.unique(slot[at].astype(np.int64) * self.size + np.searchsorted(ends, at, "right"))
        cut = np.searchsorted(hits, np.arange(n_slots + 1) * self.size)
        self.postings = [hits[a:b] - k * self.size for k, (a, b) in enumerate(zip(cut, cut[1:]))]

    def candidates(self, query: Query, slots: np.ndarray) -> np.ndarray:
        if query == ALL:
            return np.arange(self.size)
        if query[0] == "tri":
            return self.postings[slots[query[1]]]
        found = [self.candidates(q, slots) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out


LOWER = bytes(range(256)).lower()


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.regexes = rules, [r.compile() for r in rules]
        self.queries = [trigram_query(r) for r in rules]
        wanted = sorted(set().union(*map(grams, self.queries)))
        self.slots = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        self.slots[wanted] = np.arange(1, len(wanted) + 1)
        self.n_slots = len(wanted) + 1

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the matches as (start, rule, end) in code points, sorted."""
        index = Index([t.encode("utf-8", "surrogatepass") for t in texts], self.slots, self.n_slots)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.regexes, self.queries)):
            for i in index.candidates(query, self.slots).tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for found in out:
            found.sort()
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One per Python worker and set of rules."""
    return Scanner(rules)


def blocks(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BLOCK:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_secrets(df: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points; end exclusive) of every row; one narrow pass.

    Spans are sorted by start, then by the order of the rules. Null and empty texts have none; a null id stays null;
    repeated rows are scanned each; an empty table gives an empty result. Other columns are not read.
    """
    rows, rules = id_and_text(df, id_col, text_col), (*base, *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules).scan
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [x for part in blocks(batch.column("text").to_pylist()) for x in scan(part)]
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return arrow_pass(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>")
