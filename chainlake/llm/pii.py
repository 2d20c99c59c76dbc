"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in SQL expressions only.

Validated numbers, dates and addresses are replaced by others of the same format: a card number stays one that passes
its check digit, a date a date, an IPv4 address one. A Feistel network is a bijection for any round function, so within
a format different values stay different, and equal values get equal pseudonyms in all documents (linkage survives).
Without the key the replacement can't be undone.

Two networks do all the work: one on a pair of numbers (l, r) in Z_a x Z_b, and one on strings, which shifts each digit
within the digits and each letter within its case and leaves other characters alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, numbered, place_of

#: Stands for the owner's secret; a production run passes its own, or sets it in the session.
KEY, KEY_SETTING = "set-your-own-key", "spark.chainlake.pseudonymKey"
ROUNDS = 8

#: What is looked for, in the order in which it is tried at a place. Java regexes.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*+)\.)++[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z_./-])(?:(?:19|20)\d\d([-/.])\d\d\1\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![0-9A-Za-z_]|[./-]\d)",
    "ip": r"(?<![0-9A-Za-z_.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z_]|\.\d)",
    "ssn": r"(?<![0-9A-Za-z_-])\d{3}-\d\d-\d{4}(?![0-9A-Za-z_]|-\d)",
    "card": r"(?<![0-9A-Za-z_])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3,}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z_])",
    "phone": r"(?<![0-9A-Za-z_+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![0-9A-Za-z_])",
}
KINDS = tuple(PATTERNS)
#: The one group of the date pattern is a back-reference; in the joined pattern it is still the first group.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: The first day of the dates' domain; 73,049 = 17 x 4,297 days follow, up to 2099-12-31.
DAY_ONE, DAYS_L, DAYS_R = "1900-01-01", 17, 4297


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def prf(key: str, tweak: str, i: Column, x: Column) -> Column:
    """64 hex digits that only the key's owner can tell from chance."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), x.cast("string")).cast("binary"), 256)


def feistel_numbers(l: Column, r: Column, a: int, b: int, key: str, tweak: str) -> Column:  # noqa: E741
    """struct(l, r): a keyed bijection of Z_a x Z_b."""
    word = lambda i, x: F.conv(F.substring(prf(key, tweak, i, x), 1, 15), 16, 10).cast("bigint")

    def one(s: Column, i: Column) -> Column:
        even = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(word(i, s["l"]), F.lit(b)), F.lit(b)).cast("bigint").alias("r"))
        odd = F.struct(F.pmod(s["l"] + F.pmod(word(i, s["r"]), F.lit(a)), F.lit(a)).cast("bigint").alias("l"), s["r"].alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(l.cast("bigint").alias("l"), r.cast("bigint").alias("r")), one)


def shifted(s: Column, stream: Column) -> Column:
    """s with each digit and letter moved on, within its class, by the byte of the stream at its place."""

    def one(j: Column) -> Column:
        c = F.substr(s, j, F.lit(1))
        by = F.conv(F.substr(stream, (j - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        within = lambda first, n: F.char((F.lit(first) + F.pmod(code - first + by, F.lit(n))).cast("bigint"))
        return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(c)

    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), ""))


def feistel_string(s: Column, key: str, tweak: str) -> Column:
    """A keyed bijection of the strings of one pattern of digits, letters and other characters."""
    half = F.floor(F.length(s) / 2).cast("int")

    def one(x: Column, i: Column) -> Column:
        even = F.struct(x["l"].alias("l"), let(prf(key, tweak, i, x["l"]), lambda p: shifted(x["r"], p)).alias("r"))
        odd = F.struct(let(prf(key, tweak, i, x["r"]), lambda p: shifted(x["l"], p)).alias("l"), x["r"].alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one), lambda x: F.concat(x["l"], x["r"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits."""

    def add(total: Column, j: Column) -> Column:
        v = F.substr(d, F.length(d) - j + 1, F.lit(1)).cast("int")
        return total + F.when(j % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def refilled(shape: Column, new: Column) -> Column:
    """shape with its digits replaced, in order, by those of new."""
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substr(new, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step)["out"]


def read_dates(m: Column, day_first: Column) -> tuple[Column, Column]:
    """The date of a match, null if there is no such day, and the order of its parts.

    Dates with slashes are read in the document's order, and in the other one if that gives no day.
    """
    parts = F.split(m, "[-/.]")
    of = lambda y, mo, d: F.try_to_date(F.concat_ws("-", parts[y], parts[mo], parts[d]), "yyyy-MM-dd")
    by_month, by_day = of(2, 0, 1), of(2, 1, 0)
    year_first, slash = F.length(parts[0]) == 4, F.substr(m, F.lit(3), F.lit(1)) == "/"
    month_first = slash & by_month.isNotNull() & ~(day_first & by_day.isNotNull())
    day = F.when(year_first, of(0, 1, 2)).when(month_first, by_month).otherwise(by_day)
    return day, F.when(year_first, F.lit("yyyyMMdd")).when(month_first, F.lit("MMddyyyy")).otherwise(F.lit("ddMMyyyy"))


def octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))


def dotted(m: Column, numbers: list[Column]) -> Column:
    """An address in the form of m: its numbers are padded to three digits if m has a leading zero."""
    padded = m.rlike(r"(?:^|\.)0\d")
    return F.concat_ws(".", *[F.when(padded, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")) for n in numbers])


def pieces(m: Column) -> Column:
    """The parts of a match that are judged by themselves: in a run of more than four groups of four digits, every four
    that pass the check, tried at each group from the left, and what is between them; else the match."""
    at = lambda k, n: F.substr(m, k * 5 + 1, F.lit(n))
    groups = F.floor((F.length(m) + 1) / 5).cast("int")

    def step(s: Column, k: Column) -> Column:
        card = let(digits(at(k, 19)), lambda d: (F.length(d) == 16) & (luhn(d) % 10 == 0) & ~d.rlike("^0+$"))
        state = lambda more, skip: F.struct(F.concat(s["out"], more).alias("out"), skip.alias("skip"))
        return F.when(s["skip"] > 0, state(F.array().cast("array<string>"), s["skip"] - 1)).when(card, state(F.array(at(k, 19), F.substr(m, k * 5 + 20, F.lit(1))), F.lit(3))).otherwise(state(F.array(at(k, 5)), F.lit(0)))

    cut = F.aggregate(F.sequence(F.lit(0), groups - 1), F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip")), step)["out"]
    return F.when(m.rlike(r"^\d{4}(?:[ -]\d{4}){4,}$"), cut).otherwise(F.array(m))


def kind_of(m: Column, day_first: Column) -> Column:
    """The kind of a match whose value is valid; null for others, which stay as they are."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    valid = {
        "email": F.lit(True),
        "date": read_dates(m, day_first)[0].isNotNull(),
        "ip": F.forall(octets(m), lambda x: x < 256),
        "ssn": ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        "card": let(digits(m), lambda d: (luhn(d) % 10 == 0) & ~d.rlike("^0+$")),
        "phone": F.length(digits(m)).between(7, 15),
    }
    out = F.when(whole["email"], F.lit("email"))
    for k in KINDS[1:]:
        out = out.when(whole[k], F.when(valid[k], F.lit(k)))
    return out


def pseudonym(m: Column, kind: Column, key: str, day_first: Column) -> Column:
    # of the domain the last label stays, as it belongs to nobody
    host, last = F.regexp_extract(m, r"@(.*)\.", 1), F.substring_index(m, ".", -1)
    email = F.concat(feistel_string(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), let(host, lambda h: feistel_string(h, key, "domain")), F.lit("."), last)

    day_of, order = read_dates(m, day_first)
    day = F.datediff(day_of, F.to_date(F.lit(DAY_ONE)))
    new_day = let(feistel_numbers(F.floor(day / DAYS_R), day % DAYS_R, DAYS_L, DAYS_R, key, "date"), lambda x: F.date_add(F.to_date(F.lit(DAY_ONE)), (x["l"] * DAYS_R + x["r"]).cast("int")))
    written = lambda d: F.when(order == "yyyyMMdd", F.date_format(d, "yyyyMMdd")).when(order == "MMddyyyy", F.date_format(d, "MMddyyyy")).otherwise(F.date_format(d, "ddMMyyyy"))
    date = let(new_day, lambda d: refilled(m, written(d)))

    pair = lambda o: feistel_numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    ip = let(let(octets(m), pair), lambda x: dotted(m, [v for s in ("l", "r") for v in (F.shiftright(x[s], 8), x[s] % 256)]))

    # areas 001 to 899 but for 666, groups 01 to 99, serials 0001 to 9999
    area = F.substr(m, F.lit(1), F.lit(3)).cast("bigint")
    left = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + F.substr(m, F.lit(5), F.lit(2)).cast("bigint") - 1
    to_ssn = lambda x: let(F.floor(x["l"] / 99), lambda a: F.concat_ws("-", F.lpad(F.when(a >= 665, a + 2).otherwise(a + 1).cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0")))
    ssn = let(feistel_numbers(left, F.substr(m, F.lit(8), F.lit(4)).cast("bigint") - 1, 898 * 99, 9999, key, "ssn"), to_ssn)

    checked = lambda p: F.concat(p, F.pmod(10 - luhn(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    card = let(let(digits(m), lambda d: let(feistel_string(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), checked)), lambda d: refilled(m, d))

    prefix = F.regexp_extract(m, r"^\+[0-9]+(?=[ .(-])", 0)  # a country code that stands by itself
    phone = let(prefix, lambda p: F.concat(p, let(F.substr(m, F.length(p) + 1, F.length(m)), lambda rest: let(digits(rest), lambda d: refilled(rest, feistel_string(d, key, "phone"))))))

    out = F.when(kind == "email", email)
    for k, v in (("date", date), ("ip", ip), ("ssn", ssn), ("card", card), ("phone", phone)):
        out = out.when(kind == k, v)
    return out.otherwise(m)


def pseudonymise(df: DataFrame, key: str = KEY, text_col: str = "text", counts: bool = True, lang_col: str = "lang") -> DataFrame:
    """All columns of df with the text pseudonymised, and, if asked for, n_<kind> (long) of what was replaced.

    One narrow pass of SQL expressions; a text is searched once, and one without a match stays. Null texts stay null and
    have counts of 0. Names are matched by case only if two columns differ in nothing else. Columns of df of the counts'
    names, in any case, are replaced. Repeated rows get equal results, and so do equal values in any rows; there are no
    ties, as each text is taken by itself. Dates with slashes are month first in English and where df has no column
    for the language or it is null, else day first, and read the other way where that gives no day. Addresses with
    leading zeros keep them. Numbers that fail their check (Luhn, octets, days of a month) are no personal data and
    stay. An empty table gives an empty result.
    """
    at = place_of(df, text_col)
    rows = numbered(df)
    text = F.col(f"c{at}").cast("string")
    languages = [k for k, c in enumerate(df.columns) if c == lang_col] or [k for k, c in enumerate(df.columns) if c.lower() == lang_col.lower()]
    day_first = ~F.coalesce(F.lower(F.col(f"c{languages[0]}").cast("string")), F.lit("en")).rlike("^en") if languages else F.lit(False)

    def replaced(found: Column) -> Column:
        one = lambda m: let(kind_of(m, day_first), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key, day_first).alias("new")))
        each = F.transform(found, lambda m: F.transform(pieces(m), one))
        joined = lambda new: F.struct(
            F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat(F.transform(new, lambda x: F.array_join(x["new"], "")), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "").alias("text"),
            F.transform(F.flatten(new), lambda x: x["kind"]).alias("kinds"),
        )
        return F.when(F.size(found) > 0, let(each, joined))

    done = let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replaced)
    names = [f"n_{k}" for k in KINDS] if counts else []
    number = lambda k: F.coalesce(F.size(F.filter(F.col("done")["kinds"], lambda x: x == k)), F.lit(0)).cast("long")
    stays = kept_columns(df, names)
    new = F.coalesce(F.col("done")["text"], text)
    return rows.withColumn("done", done).select(*[new if k == at else F.col(f"c{k}") for k in stays], *[number(k) for k in KINDS if counts]).toDF(*[df.columns[k] for k in stays], *names)
