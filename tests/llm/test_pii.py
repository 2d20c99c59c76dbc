import datetime
import hashlib
import re

from chainlake.llm import pii

from .util import ODD, documents


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_card string, `odd.name` string")
    return [r for r in sorted(pii.pseudonymise(df, key).collect(), key=lambda r: r["doc_id"])]


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_formats_stay_valid(spark):
    (r,) = run(spark, ["mail jo.5@x.example.com born 1999-12-31 or 02/29/2024 or 31.12.1999 ip 10.0.0.255 ssn 123-45-6789 card 4111 1111 1111 1111, 378282246310005 call +1 (743) 555-3824"])
    assert (r["n_email"], r["n_date"], r["n_ip"], r["n_ssn"], r["n_card"], r["n_phone"]) == (1, 3, 1, 1, 2, 1)
    m = re.fullmatch(r"mail ([a-z]{2}\.\d@[a-z]\.[a-z]{7}\.com) born (\d{4}-\d\d-\d\d) or (\d\d/\d\d/\d{4}) or (\d\d\.\d\d\.\d{4}) ip ([\d.]+) ssn (\d{3}-\d\d-\d{4}) card (\d{4} \d{4} \d{4} \d{4}), (\d{15}) call (\+1 \(\d{3}\) \d{3}-\d{4})", r["text"])
    assert m and luhn(m[7].replace(" ", "")) and luhn(m[8])
    assert all(int(x) < 256 for x in m[5].split("."))
    datetime.date.fromisoformat(m[2])
    datetime.datetime.strptime(m[3], "%m/%d/%Y")
    datetime.datetime.strptime(m[4], "%d.%m.%Y")
    assert not m[6].startswith(("000", "666", "9"))
    for raw in ("jo.5@", "1999-12-31", "10.0.0.255", "123-45-6789", "4111 1111", "378282246310005", "555-3824"):
        assert raw not in r["text"]


def test_what_is_not_valid_stays(spark):
    texts = ["card 4111111111111112", "ip 256.1.1.1", "date 2023-02-30", "ssn 000-12-3456", "version 1.2.3.4.5", "x4111111111111111", "0000000000000000", "a@b", "no digits at all"]
    assert [r["text"] for r in run(spark, texts)] == texts


def test_equal_values_stay_linked_and_differ_by_key(spark):
    a, b, c = run(spark, ["4111111111111111", "see 4111111111111111!", "5500005555555559"])
    assert b["text"] == f"see {a['text']}!" and a["text"] != c["text"]
    assert run(spark, ["4111111111111111"], "other")[0]["text"] != a["text"]


def test_feistel_is_a_bijection(spark):
    from pyspark.sql import functions as F

    n = spark.range(7 * 11).select(pii.feistel_numbers(F.floor(F.col("id") / 11), F.col("id") % 11, 7, 11, "k", "t").alias("x"))
    assert sorted((r["x"]["l"], r["x"]["r"]) for r in n.collect()) == [(i, j) for i in range(7) for j in range(11)]
    s = spark.range(1000).select(pii.feistel_string(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x"))
    assert sorted(r["x"] for r in s.collect()) == [f"{i:03d}" for i in range(1000)]
    s = spark.range(26).select(pii.feistel_string(F.char(F.col("id") + 97), "k", "t").alias("x"))
    assert sorted(r["x"] for r in s.collect()) == [chr(97 + i) for i in range(26)]


def test_dates_cover_their_domain(spark):
    days = spark.range(0, 73049, 37).selectExpr("id as doc_id", "cast(date_add(date'1900-01-01', cast(id as int)) as string) as text")
    got = [r["text"] for r in pii.pseudonymise(days).collect()]
    assert len(set(got)) == len(got) and all("1900-01-01" <= x <= "2099-12-31" for x in got)


def test_odd_rows(spark):
    got = {r["doc_id"]: r for r in pii.pseudonymise(documents(spark, ODD)).collect()}
    assert all(got[i]["text"] == t for i, t in enumerate(ODD))
    assert pii.pseudonymise(documents(spark, ODD).where("false")).count() == 0
    text = "at 1.2.3.4 " * 3000
    (r,) = run(spark, [text])
    assert r["n_ip"] == 3000 and len(set(r["text"].split())) == 2


def test_dates_are_read_in_either_order(spark):
    df = spark.createDataFrame([(0, "on 25/12/1980", "en"), (1, "on 12/25/1980", "fr"), (2, "on 03/04/1980", "fr"), (3, "on 03/04/1980", "en"), (4, "on 1980-04-03", "fr"), (5, "on 31/31/1980", "fr"), (6, "on 1980-12-25", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    new = {k: r["text"][3:] for k, r in got.items()}
    assert [got[k]["n_date"] for k in range(7)] == [1, 1, 1, 1, 1, 0, 1]
    turned = lambda d: "/".join(d.split("-")[::-1])
    assert new[0] == turned(new[6]) and new[2] == turned(new[4]) and new[3] != new[2]
    y, m, d = new[6].split("-")
    assert new[1] == f"{m}/{d}/{y}" and new[5] == "31/31/1980"


def test_a_card_behind_another_number_is_found(spark):
    alone, behind, two, none = run(spark, ["4111 1111 1111 1111", "2024 4111 1111 1111 1111, end", "4111 1111 1111 1111 5500-0055-5555-5559", "1234 1234 1234 1234 1235 0000"])
    assert behind["text"] == f"2024 {alone['text']}, end" and behind["n_card"] == 1
    assert two["n_card"] == 2 and two["text"].startswith(f"{alone['text']} ") and "5500-0055" not in two["text"]
    assert (none["text"], none["n_card"]) == ("1234 1234 1234 1234 1235 0000", 0)


# --- a plain Feistel network --------------------------------------------------------------------------------------

KEY = "brute"


def prf(tweak, i, x):
    return hashlib.sha256(f"{KEY}|{tweak}|{i}|{x}".encode()).hexdigest()


def numbers(left, right, a, b, tweak):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            right = (right + int(prf(tweak, i, left)[:15], 16)) % b
        else:
            left = (left + int(prf(tweak, i, right)[:15], 16)) % a
    return left, right


def moved(s, stream):
    out = ""
    for j, c in enumerate(s):
        by = int(stream[2 * (j % 32) : 2 * (j % 32) + 2], 16)
        for first, n in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + n:
                c = chr(ord(first) + (ord(c) - ord(first) + by) % n)
                break
        out += c
    return out


def string(s, tweak):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            right = moved(right, prf(tweak, i, left))
        else:
            left = moved(left, prf(tweak, i, right))
    return left + right


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def brute_card(m):
    d = re.sub(r"\D", "", m)
    body = string(d[:-1], "card")
    return refill(m, next(body + c for c in "0123456789" if luhn(body + c)))


def brute_ip(m):
    o = [int(x) for x in m.split(".")]
    left, right = numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    new = [left >> 8, left & 255, right >> 8, right & 255]
    return ".".join(f"{x:03d}" if re.search(r"(^|\.)0\d", m) else str(x) for x in new)


def brute_ssn(m):
    a, g, s = (int(x) for x in m.split("-"))
    left, right = numbers((a - 2 if a > 666 else a - 1) * 99 + g - 1, s - 1, 898 * 99, 9999, "ssn")
    area = left // 99
    return f"{area + 2 if area >= 665 else area + 1:03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def brute_date(m, order):
    at = datetime.datetime.strptime(re.sub(r"\D", "", m), order).date()
    n = (at - datetime.date(1900, 1, 1)).days
    left, right = numbers(n // pii.DAYS_R, n % pii.DAYS_R, pii.DAYS_L, pii.DAYS_R, "date")
    return refill(m, (datetime.date(1900, 1, 1) + datetime.timedelta(left * pii.DAYS_R + right)).strftime(order))


def brute_phone(m):
    prefix = re.match(r"\+[0-9]+(?=[ .(-])", m)
    prefix = prefix[0] if prefix else ""
    rest = m[len(prefix) :]
    return prefix + refill(rest, string(re.sub(r"\D", "", rest), "phone"))


def brute_email(m):
    name, domain = m.split("@")
    host, _, last = domain.rpartition(".")
    return f"{string(name, 'email')}@{string(host, 'domain')}.{last}"


VALUES = [
    *[(v, brute_card) for v in ("4111 1111 1111 1111", "378282246310005", "5500-0055-5555-5559", "6011000990139424")],
    *[(v, brute_ip) for v in ("10.0.0.255", "8.8.8.8", "192.168.001.010", "010.000.000.001")],
    *[(v, brute_ssn) for v in ("123-45-6789", "665-01-0001", "667-99-9999", "899-99-9999", "001-01-0001")],
    *[(v, lambda m: brute_date(m, "%Y%m%d")) for v in ("1999-12-31", "2000/02/29", "1900.01.01", "2099-12-31")],
    *[(v, lambda m: brute_date(m, "%m%d%Y")) for v in ("02/29/2024", "12/31/1999")],
    *[(v, lambda m: brute_date(m, "%d%m%Y")) for v in ("31.12.1999", "25/12/1980")],
    *[(v, brute_phone) for v in ("+1 (743) 555-3824", "743-555-3824", "+49 151 234 5678", "(743) 555-3824")],
    *[(v, brute_email) for v in ("jo.5@x.example.com", "A.b+c@host-1.org", "x@y.co")],
]


def test_pseudonyms_by_brute_force(spark):
    got = [r["text"] for r in run(spark, [f"see {v} there" for v, _ in VALUES], KEY)]
    assert got == [f"see {f(v)} there" for v, f in VALUES]
    assert len(set(got)) == len(got)


def test_the_registered_query_by_brute_force(spark):
    """On a whole table: what isn't personal stays as it is, what is becomes what plain Python makes of it."""
    from chainlake.llm import queries

    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        got = {r["doc_id"]: r for r in queries.op5_pseudonyms(spark, "/root/testdata/sf0.001").collect()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    ssn, email = re.compile(r"(?<![0-9A-Za-z_-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![0-9A-Za-z_]|-\d)"), re.compile(pii.PATTERNS["email"])
    for d in docs:
        text, new = d["text"] or "", got[d["doc_id"]]["text"] or ""
        assert got[d["doc_id"]]["n_email"] == len(email.findall(text))
        assert all(brute_email(m[0]) in new for m in email.finditer(text)) and all(brute_ssn(m[0]) in new for m in ssn.finditer(text))
        if not any(got[d["doc_id"]][f"n_{k}"] for k in pii.KINDS):
            assert text == new


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "at 1.2.3.4", "x", "y")], "ID bigint, Text string, N_Card string, `a.b` string")
    (r,) = pii.pseudonymise(df).collect()
    assert r["Text"] != "at 1.2.3.4" and r["n_ip"] == 1 and r["n_card"] == 0 and "N_Card" not in r.asDict() and r["a.b"] == "y"
    both = spark.createDataFrame([(1, "at 1.2.3.4", "at 1.2.3.4")], "id bigint, Text string, text string")
    (r,) = pii.pseudonymise(both, counts=False).collect()
    assert r[1] == "at 1.2.3.4" and r[2] != r[1]
