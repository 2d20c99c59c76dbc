"""What the two byte-level BPE operators share: the vocabulary file and the cut into pieces."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from tokenizers import pre_tokenizers

#: Unicode White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Distinct pieces in one of the two generations that a Python worker remembers, and the longest piece remembered.
REMEMBERED, LONGEST = 500_000, 48
#: Latin-1 letters and numbers. A text of Latin-1 is cut here, by the published pattern of byte-level BPE; others are cut
#: by the library, as its Unicode version decides what a letter is.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{SPACE}{_L}{_N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Vocabulary:
    """Merge ranks and ids of a byte-level BPE file of the tokenizers library.

    A symbol is a byte, or 256 and an id. ``merge`` maps a pair of symbols to (rank, symbol that they become),
    ``id_of`` a symbol to its id, and ``bytes_of`` an id to its bytes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        symbol = {t: byte_of[t] if t in byte_of else 256 + i for t, i in ids.items()}
        self.id_of = [ids[c] for c in byte_symbols()] + list(range(len(ids) + 1))
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        made = {t: -1 for t in byte_of}
        for rank, (a, b) in enumerate(pairs):
            if made.get(a, rank) >= rank or made.get(b, rank) >= rank:
                raise ValueError(f"merge {rank} of {path} uses a symbol that no earlier merge makes")
            made.setdefault(a + b, rank)
            self.merge[symbol[a], symbol[b]] = (rank, symbol[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in ids.items() if all(c in byte_of for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def parts(self, text: str) -> list[str]:
        """Text and special tokens in turn; the special ones are at the odd places."""
        return self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else [text]

    def pieces(self, text: str) -> list[str]:
        """The pieces within which symbols merge."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [text[a:b] for _, (a, b) in self.cut(text)]
        return LATIN.findall(text)


class Memo(dict):
    """Remembers make(piece) in two generations of fixed size, so that frequent pieces stay and memory is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value

    def keep(self, piece: str, value) -> None:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = value


def byte_symbols() -> str:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the others follow from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in keep else next(others)) for b in range(256))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    return Vocabulary(path)
