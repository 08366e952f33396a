"""Feistel pseudonyms: bijection, validity, linkage and layout."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from liftlake.llm import pii

from llm_cases import edge_docs, no_docs, pairs, small_docs

KEY = "test key"


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def one(spark, text, **options):
    row = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY, **options).first()
    return row.text, [(f.kind, f.value) for f in row.found]


SAMPLES = {
    "mail": ["jo.doe42@mail8.example.com", "X@y.org", "a_b-c+d%e@host.co.uk"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005", "6304000000000000"],
    "ip": ["42.144.35.254", "0.0.0.0", "255.255.255.255"],
    "phone": ["+1 (988) 555-2485", "(212) 555-0100", "212-555-0100", "+49 30 1234567", "+44 20 7946 0958", "+442071838750", "555 123 4567", "+14155552671",
              "+353 1 234 5678"],
    "ssn": ["123-45-6789", "899-99-9999", "001-01-0001"],
    "date": ["1999-12-31", "02/29/2000", "31.12.1985", "2099-12-31", "1900-01-01"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "NO93 8601 1117 947", "BE68539007547034"],
}


def check(kind, value):
    digits = re.sub(r"\D", "", value)
    if kind == "card":
        assert luhn(digits)
    if kind == "ip":
        assert all(0 <= int(x) <= 255 for x in value.split("."))
    if kind == "date":
        fmt = "%Y-%m-%d" if "-" in value else "%m/%d/%Y" if "/" in value else "%d.%m.%Y"
        assert 1900 <= datetime.datetime.strptime(value, fmt).year <= 2099
    if kind == "iban":
        plain = value.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "ssn":
        a, g, s = map(int, value.split("-"))
        assert 1 <= a <= 899 and a != 666 and g and s


@pytest.mark.parametrize("kind", SAMPLES)
def test_valid_values_become_other_valid_values_and_come_back(spark, kind):
    text = " ; ".join(SAMPLES[kind])
    new, found = one(spark, text)
    assert [k for k, _ in found] == [kind] * len(SAMPLES[kind])
    for old, (_, value) in zip(SAMPLES[kind], found):
        shape = (lambda s: re.sub(r"\d+", "9", s)) if kind == "ip" else (lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s))))
        assert value != old and shape(value) == shape(old)
        check(kind, value)
    assert new == " ; ".join(v for _, v in found)
    assert one(spark, new, reveal=True)[0] == text


@pytest.mark.parametrize("text", [
    "4111111111111112", "300.1.1.1", "1.2.3.4.5", "1999-02-30", "13/13/1999", "000-12-3456", "666-12-3456", "DE89370400440532013001",
    "no data here", "page 110. item 9.1. (2024)", "a@b", "word@", "version 1.2.3", "12345", "", "0000000000000000"])
def test_invalid_and_clean_text_stays(spark, text):
    assert one(spark, text) == (text, [])


@pytest.mark.parametrize("value,after", [
    ("ES91 2100 0418 4502 0005 1332", " EUR"), ("AT61 1904 3002 3457 3201", " BIC"), ("BE68 5390 0754 7034", " 2024"), ("DE89 3704 0044 0532 0130 00", " 7"),
    ("FR1420041010050500013M02606", " OK"), ("GB82WEST12345698765432", ". A")])
def test_iban_ends_where_its_country_says(spark, value, after):
    new, found = one(spark, f"to {value}{after} now")
    assert [k for k, _ in found] == ["iban"] and new == f"to {found[0][1]}{after} now" and found[0][1] != value
    check("iban", found[0][1])


def test_phone_numbers_link_with_and_without_separators(spark):
    _, found = one(spark, "+14155552671 ; +1 415 555 2671 ; +1 (415) 555-2671 ; (415) 555-2671 ; 415 555 2671 ; 415-555-2671")
    assert len(found) == 6 and len({re.sub(r"\D", "", v)[-10:] for _, v in found}) == 1
    assert [v[:2] for _, v in found[:3]] == ["+1"] * 3
    _, found = one(spark, "+442071838750 ; +44 20 7183 8750 ; +44-20-7183-8750")
    assert {re.sub(r"\D", "", v) for _, v in found} == {re.sub(r"\D", "", found[0][1])} and found[0][1].startswith("+44")


def plain_number(value, a, b, kind):
    """The Feistel permutation of 0 .. a * b - 1, in plain Python."""
    left, right = divmod(value, b)
    for i in range(pii.ROUNDS):
        seen = right if i % 2 == 0 else left
        amount = int(hashlib.sha256(f"{KEY}|{kind}|{i}|{seen}".encode()).hexdigest()[:15], 16)
        left, right = ((left + amount % a) % a, right) if i % 2 == 0 else (left, (right + amount % b) % b)
    return left * b + right


def plain_pseudonym(kind, value):
    """An address, date, card or phone number (plan +1) of SAMPLES as the method says, in plain Python."""
    digits = re.sub(r"\D", "", value)
    if kind == "ip":
        new = plain_number(int.from_bytes(bytes(map(int, value.split("."))), "big"), 65536, 65536, "ip")
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "date":
        fmt = "%Y-%m-%d" if "-" in value else "%m/%d/%Y" if "/" in value else "%d.%m.%Y"
        zero = datetime.datetime(1900, 1, 1)
        new = plain_number((datetime.datetime.strptime(value, fmt) - zero).days, 319, 229, "date")
        return (zero + datetime.timedelta(new)).strftime(fmt)
    if kind == "card":
        n = len(digits) - 1
        low = n // 2
        new = f"{plain_number(int(digits[:-1]), 10 ** (n - low), 10 ** low, 'card'):0{n}d}"
        new += next(c for c in "0123456789" if luhn(new + c))
    else:
        area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
        new = plain_number((area - 100) * 9_000_000 + (exchange - 100) * 10_000 + line, 90_000, 90_000, "phone+1")
        new = f"{new // 9_000_000 + 100}{new // 10_000 % 900 + 100}{new % 10_000:04d}"
        new = digits[:-10] + new
    out = iter(new)
    return re.sub(r"\d", lambda _: next(out), value)


@pytest.mark.parametrize("kind", ["ip", "date", "card", "phone"])
def test_pseudonyms_match_plain_python(spark, kind):
    values = [v for v in SAMPLES[kind] if kind != "phone" or len(re.sub(r"\D", "", v)) == 10 or v.startswith("+1")]
    _, found = one(spark, " ; ".join(values))
    assert [v for _, v in found] == [plain_pseudonym(kind, v) for v in values]


def test_equal_values_stay_linked_whatever_their_layout(spark):
    _, found = one(spark, "4111111111111111 or 4111-1111-1111-1111 x 4111 1111 1111 1111.")
    assert len({re.sub(r"\D", "", v) for _, v in found}) == 1
    other = pii.pseudonymise(spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string"), "other key").first()
    assert other.found[0].value != found[0][1]


@pytest.mark.parametrize("a,b", [(7, 5), (1, 9), (11, 1), (10, 100)])
def test_number_permutation_is_a_bijection(spark, a, b):
    v = F.col("id")
    out = spark.range(a * b).select(pii.permute_number(v, F.lit(a).cast("long"), F.lit(b).cast("long"), KEY, "t").alias("p"), "id")
    rows = out.withColumn("back", pii.permute_number(F.col("p"), F.lit(a).cast("long"), F.lit(b).cast("long"), KEY, "t", True)).collect()
    assert sorted(r.p for r in rows) == list(range(a * b)) and all(r.back == r.id for r in rows)


def test_large_numbers_are_exact(spark):
    values = [10**18 - 1, 999_999_999_999_999_999, 123_456_789_012_345_678]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    side = F.lit(10**9).cast("long")
    p = df.select("v", pii.permute_number(F.col("v"), side, side, KEY, "t").alias("p"))
    assert all(r.v == r.b for r in p.select("v", pii.permute_number(F.col("p"), side, side, KEY, "t", True).alias("b")).collect())


def test_planted_values_go_and_clean_documents_stay(spark):
    docs = small_docs(spark, "0.01")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    planted = re.compile(r"\S+@\S+\.\w+|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])")
    hits = 0
    for i, t in pairs(docs):
        old = {v for v in planted.findall(t or "") if len(v) != 16 or not v.isdigit() or luhn(v)}     # invalid numbers stay
        hits += len(old)
        assert not [v for v in old if v in (out[i].text or "")]
        assert old or out[i].text == t
        assert len(out[i].text or "") == len(t or "") or any(f.kind == "ip" for f in out[i].found)
    assert hits > 50


def test_edges(spark):
    docs = edge_docs(spark)
    got = sorted(map(str, ((r.doc_id, r.text) for r in pii.pseudonymise(docs, KEY).collect())))
    assert got == sorted(map(str, pairs(docs)))
    assert pii.pseudonymise(no_docs(spark), KEY).count() == 0
    long = ("x 4111111111111111 y " * 3_000)
    new, found = one(spark, long)
    assert len(found) == 3_000 and "4111111111111111" not in new
