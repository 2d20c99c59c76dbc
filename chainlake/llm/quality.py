"""Quality rules: cheap counts over each text, and a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of a text's tokens are hashed into a fixed number of buckets. Two multinomials over the buckets
are estimated: one from trusted documents, one from the raw corpus (every row). A document's score is the mean, over
its n-grams, of the log ratio of the two; it is kept if the score reaches a threshold. SQL expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, kept_columns, materialise, numbered, place_of

#: What separates words, and what counts as a symbol.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Tokens of the n-grams: runs of letters and digits, and runs of other marks.
TOKEN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"
#: Buckets of the hashed n-grams; the table of weights has so many rows at any size of the corpus.
BUCKETS = 1 << 14
#: Pseudo-counts, so many for each n-gram of the trusted texts, spread evenly over the buckets.
SMOOTHING = 0.02
#: A text is kept if its mean log ratio (nats per n-gram) is at least this. Ordinary text lies around 0 or above,
#: whatever its language, as most of the raw corpus is ordinary; text full of junk lies well below.
THRESHOLD = -0.35
#: Trusted documents used at most: those with the smallest hashes of their ids. Bounds what is broadcast.
TRUSTED = 16384
#: The rules of base_failed.
LEAST_WORDS, MOST_REPEATED = 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN, -1))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are compared by 64-bit hashes within one text. Only a text with a repeated window sorts them: equal hashes
    then stand side by side, and their places, sorted again, tell which words are covered. O(n log n) for any text.
    """

    def places(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        return let(tagged, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).cast("bigint").alias("n"))
        return F.aggregate(at, start, step)["n"]

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(places(h)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(hashes, of))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    filled = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(filled, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def base_counts(text: Column) -> dict[str, Column]:
    without = lambda chars: F.char_length(F.translate(text, chars, ""))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return {
        "_counts": counts,
        "word_chars": without(BLANKS).cast("bigint"),
        "n_symbols": (F.char_length(text) - without(SYMBOLS)).cast("bigint"),
        "n_dup_lines": repeated_lines(text),
    }


def ngrams(text: Column) -> Column:
    """The buckets of a text's unigrams, then of its bigrams, as short integers."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("smallint")
    both = lambda t: F.concat(F.transform(t, lambda x: bucket(x)), F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: bucket(a, b)))
    of = lambda t: F.when(F.size(t) < 2, F.transform(t, lambda x: bucket(x))).otherwise(both(t))
    return let(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), of)


def weights(rows: DataFrame, trusted: DataFrame) -> Column:
    """A literal array: by bucket, the log ratio of the trusted and the raw multinomial in millionths.

    It comes to the driver and into the plan, as it has BUCKETS numbers at any size of the corpus.

    ``rows``: doc_id, grams (see ngrams()). Raw counts are of all rows; trusted ones of the rows whose id is in
    ``trusted`` (doc_id, each once), of which TRUSTED are used. Counting is combined before its shuffle to BUCKETS rows a
    task at most.
    """
    chosen = trusted.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED).withColumn("good", F.lit(1))
    marked = rows.join(F.broadcast(chosen), "doc_id", "left").select(F.coalesce("good", F.lit(0)).alias("good"), F.explode("grams").alias("bucket"))
    counted = materialise(marked.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")), "ngram-counts")
    every = rows.sparkSession.range(BUCKETS).select(F.col("id").cast("smallint").alias("bucket")).join(counted, "bucket", "left")
    counts = every.select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    row = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    extra = F.lit(SMOOTHING) * F.col("n_good") + F.lit(1.0)
    share = lambda n, total: (n + extra / BUCKETS) / (total + extra)
    nats = lambda x: F.log(share(x["good"], F.col("n_good"))) - F.log(share(x["raw"], F.col("n_raw")))
    ratio = F.transform("c", lambda x: F.round(nats(x) * 1_000_000).cast("int"))
    # without trusted rows there is nothing to compare with: all weights are 0
    found = row.select(F.to_json(F.when(F.col("n_good") > 0, ratio).otherwise(F.transform("c", lambda x: F.lit(0)))).alias("w")).first()
    return F.from_json(F.lit(found["w"]), "array<int>")


def score(grams: Column, w: Column) -> Column:
    """The mean weight of n-grams; 0 if there are none."""
    total = lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, b: a + F.get(w, b))
    return let(grams, lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total(g) / F.size(g) / 1_000_000))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, each once, of those whose labels of quality that aren't null are all 1."""
    known = numbered(labels).select(F.col(f"c{place_of(labels, 'doc_id')}").alias("doc_id"), F.col(f"c{place_of(labels, 'quality')}").alias("quality"))
    return known.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1").select("doc_id")


JUDGED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def judged(rows: DataFrame, plain: list[str], llr: Column, threshold: float, names: list[str]) -> DataFrame:
    """The columns ``plain`` of rows, which has those of base_counts(), and JUDGED, all under their final names."""
    n_words, n_repeat = F.col("_counts")["n_words"], F.col("_counts")["n_repeat_words"]
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    out = rows.select("*", llr.alias("_llr"))
    return out.select(*plain, n_words, "word_chars", "n_symbols", "n_dup_lines", n_repeat, failed, "_llr", ~failed & (F.col("_llr") >= threshold)).toDF(*names, *JUDGED)


def judge_documents(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    ``labels`` has doc_id and quality; an id is trusted if all its labels that aren't null are 1. A null text has no
    words and fails the base rules, as an empty one does. Without trusted rows every score is 0 and the base rules alone
    decide. A null id is never trusted. Each row is judged by its text alone, so repeated rows get equal verdicts; in the
    raw counts each counts. A score at the threshold is kept. Names are matched by case only if two columns differ in
    nothing else; columns of df of the new names, in any case, are replaced. An empty table gives an empty result.

    The n-grams of each text are taken twice, for the counts and for the scores; see verdicts() for once.
    """
    texts = id_and_text(df, id_col, text_col)
    w = weights(texts.select("doc_id", ngrams(F.col("text")).alias("grams")), trusted_ids(labels))
    text = F.coalesce(F.col(f"c{place_of(df, text_col)}").cast("string"), F.lit(""))
    stays = kept_columns(df, JUDGED)
    plain = [f"c{k}" for k in stays]
    rows = numbered(df).select(*plain, *[c.alias(n) for n, c in base_counts(text).items()], ngrams(text).alias("_grams"))
    return judged(rows, plain, score(F.col("_grams"), w), threshold, [df.columns[k] for k in stays])


def verdicts(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What judge_documents() gives, but for the text: so each text is read and cut once.

    The base counts and the buckets of the n-grams, 14 bits each, are written to the shared folder and scored from there.
    """
    at_id, at_text = place_of(df, id_col), place_of(df, text_col)
    text = F.coalesce(F.col(f"c{at_text}").cast("string"), F.lit(""))
    stays = [k for k in kept_columns(df, JUDGED) if k != at_text]
    plain = [f"c{k}" for k in stays]
    own = numbered(df).select(F.col(f"c{at_id}").alias("doc_id"), *plain, *[c.alias(n) for n, c in base_counts(text).items()], ngrams(text).alias("grams"))
    rows = materialise(own, "ngrams")
    w = weights(rows.select("doc_id", "grams"), trusted_ids(labels))
    return judged(rows, plain, score(F.col("grams"), w), threshold, [df.columns[k] for k in stays])
