"""Documents that hold what an operator must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, n_tokens string, kept string, media string, fp string, gone string, _id string, shard string, ids string"


def documents(spark, texts, ids=None):
    """Extra columns have names that operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, *["x"] * 8) for i, t in zip(ids, texts)], SCHEMA)


LONG = " ".join(f"word{i % 997} naïve-{i}" for i in range(30000))
ODD = ["", None, " ", "\n\n", "a", LONG, "tie tie tie", "tie tie tie", "Ünï çødé 日本語 \x00\x1c", "it's <|endoftext|> 'S\r\n\tx", "x" * 5000]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    repeated = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)
