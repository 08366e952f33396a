"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

DataFrame functions only. One expression finds candidates (mail addresses, card
numbers, IBANs, IPv4 addresses, phone numbers, social security numbers and
dates); each is validated (Luhn, modulo 97, octets, area and exchange codes,
calendar) and, if valid, replaced by another valid value of its kind, in the same
layout. Numbers are permuted by ten rounds of a Feistel network over two mixed
radices a * b with modular addition, keyed SHA-256 being the round function;
mail names and account letters by the same network over the characters of their
halves, letter for letter and digit for digit. The permutation depends on key
and kind alone, so equal values get equal pseudonyms in every document and
different values different ones; ``reveal`` inverts it.

Domains: cards keep length and separators, their check digit is recomputed;
phone numbers keep the country code (of a number without separators, the listed
code that it begins with), in plan +1 the area and exchange codes never begin with
0; dates stay in 1900 to 2099; a mail address keeps its domain; an IBAN, which is
as long as its country says, keeps its country.
Invalid candidates and all other text stay as they are.

Defined cases: a null text stays null; an empty text stays empty; null ids and
repeated rows are processed like any other; a text of any length is processed
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import let

ROUNDS = 10

# Length of an account number (IBAN) by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}

# Telephone country codes of one and of two digits; all others have three.
SHORT_CODES = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 "
               "60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98").split()


def _iban_pattern() -> str:
    """Each country's number by its length, in one piece or in groups of four."""
    def of(length: int, countries: str) -> str:
        fours, rest = divmod(length - 4, 4)
        return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(of(*x) for x in IBAN_LENGTHS.items())})(?![A-Za-z0-9])"


#: kind -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "mail": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": _iban_pattern(),
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![/-]?[0-9])",
    "card": r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+(?!1[ .(-])[0-9]{1,3}[ -](?:\([0-9]{1,4}\)[ -]?)?[0-9]{1,4}(?:[ -]?[0-9]{2,4}){1,3}"
             r"|\+[1-9][0-9]{6,14}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
ANY = "|".join(PATTERNS.values())
HINT = r"@|[0-9][^A-Za-z]{0,4}[0-9]"       # texts without it hold no candidate
FIRST_DAY, DAYS = "1900-01-01", 319 * 229   # 1900-01-01 to 2099-12-31


def _mix(key: str, kind: str, i: Column, value: Column) -> Column:
    """60 keyed bits of a round."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _rounds(invert: bool) -> Column:
    order = range(ROUNDS - 1, -1, -1) if invert else range(ROUNDS)
    return F.array(*[F.lit(i) for i in order])


def permute_number(value: Column, a: Column, b: Column, key: str, kind: str, invert: bool = False) -> Column:
    """A keyed permutation of 0 .. a * b - 1 (longs): even rounds add to the part in a, odd ones to the part in b."""
    sign = -1 if invert else 1

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["l"] + sign * F.pmod(_mix(key, kind, i, s["r"]), a), a)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(_mix(key, kind, i, s["l"]), b), b))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.call_function("div", value, b).alias("l"), F.pmod(value, b).alias("r"))
    return let(F.aggregate(_rounds(invert), start, step), lambda s: s["l"] * b + s["r"])


def _shifted(half: Column, other: Column, i: Column, key: str, kind: str, sign: int) -> Column:
    """``half`` with each letter or digit moved inside its class by a keyed amount."""
    # 4 hex digits a character; longer halves go round the 32 amounts again
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 512)

    def move(j: Column, stream_: Column) -> Column:
        code = F.ascii(F.substr(half, j, F.lit(1)))
        amount = sign * F.conv(F.substr(stream_, F.pmod(j - 1, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = F.substr(half, j, F.lit(1))
        for low, size in ((48, 10), (65, 26), (97, 26)):
            out = F.when(code.between(low, low + size - 1), F.char(F.pmod(code - low + amount, F.lit(size)) + low)).otherwise(out)
        return out

    places = F.sequence(F.lit(1), F.length(half))
    return F.when(F.length(half) == 0, F.lit("")).otherwise(let(stream, lambda s: F.array_join(F.transform(places, lambda j: move(j, s)), "")))


def permute_text(text: Column, key: str, kind: str, invert: bool = False) -> Column:
    """A keyed permutation of the texts with the same class (a-z, A-Z, 0-9, other) at each place."""
    sign = -1 if invert else 1

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shifted(s["l"], s["r"], i, key, kind, sign)).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(_shifted(s["r"], s["l"], i, key, kind, sign)).alias("r"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    return let(F.aggregate(_rounds(invert), start, step), lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(layout: Column, chars: Column, fill: str) -> Column:
    """``layout`` with its characters of class ``fill`` replaced, in order, by those of ``chars``."""
    def step(s: Column, i: Column) -> Column:
        c = F.substr(layout, i, F.lit(1))
        slot = c.rlike(fill)
        return F.struct(F.concat(s["out"], F.when(slot, F.substr(chars, s["at"], F.lit(1))).otherwise(c)).alias("out"),
                        (s["at"] + F.when(slot, 1).otherwise(0)).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.length(layout)), start, step, lambda s: s["out"])


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum; the digit at ``doubled_from_right`` (0 or 1) from the right is the first one doubled."""
    def step(t: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        two = d * 2 - F.when(d > 4, 9).otherwise(0)
        return t + F.when(i % 2 == doubled_from_right, two).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _padded(value: Column, n: Column) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _permuted_digits(digits: Column, key: str, kind: str, invert: bool) -> Column:
    """Any digit string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    return _padded(permute_number(digits.cast("long"), _pow10(n - low), _pow10(low), key, kind, invert), n)


def _card(m: Column, key: str, invert: bool) -> Column:
    def out(d: Column) -> Column:
        payload = _permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", invert)
        full = let(payload, lambda p: F.concat(p, F.pmod(-_luhn_sum(p, 0), F.lit(10)).cast("string")))
        return F.when((F.pmod(_luhn_sum(d, 1), F.lit(10)) == 0) & ~d.rlike("^0+$"), _refill(m, full, "[0-9]"))
    return let(_digits(m), out)


def _ip(m: Column, key: str, invert: bool) -> Column:
    def out(o: Column) -> Column:
        value = F.aggregate(o, F.lit(0).cast("long"), lambda t, x: t * 256 + x.cast("long"))
        new = permute_number(value, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip", invert)
        parts = [F.pmod(F.floor(new / F.lit(256 ** k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]
        return F.when(~F.exists(o, lambda x: x.cast("int") > 255), F.concat_ws(".", *parts))
    return let(F.split(m, r"\."), out)


def _date(m: Column, key: str, invert: bool) -> Column:
    layout = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("/"), "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    iso = (F.when(m.contains("-"), m)
           .when(m.contains("/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
           .otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))))
    day = F.datediff(F.call_function("try_to_date", iso, F.lit("yyyy-MM-dd")), F.lit(FIRST_DAY).cast("date")).cast("long")

    def out(d: Column) -> Column:
        new = permute_number(d, F.lit(319).cast("long"), F.lit(229).cast("long"), key, "date", invert)
        return F.when(d.between(0, DAYS - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), "yyyy-MM-dd"))

    def laid(x: Column) -> Column:
        y, mo, d = F.substring(x, 1, 4), F.substring(x, 6, 2), F.substring(x, 9, 2)
        return F.when(layout == "yyyy-MM-dd", x).when(layout == "MM/dd/yyyy", F.concat_ws("/", mo, d, y)).otherwise(F.concat_ws(".", d, mo, y))
    return let(let(day, out), lambda x: F.when(x.isNotNull(), laid(x)))


def _phone(m: Column, key: str, invert: bool) -> Column:
    def by_list(run: Column) -> Column:
        """The country code: digits set apart by a separator, or the listed code that a longer run begins with."""
        listed = [F.substring(run, 1, n) for n in (1, 2)]
        return (F.when(F.length(run) <= 3, run).when(listed[0].isin(SHORT_CODES), listed[0]).when(listed[1].isin(SHORT_CODES), listed[1])
                .otherwise(F.substring(run, 1, 3)))

    country = F.when(m.startswith("+"), let(F.regexp_extract(m, r"^\+([0-9]+)", 1), by_list)).otherwise("")

    def out(national: Column, code: Column, rest: Column) -> Column:
        area, exchange, line = (F.substr(national, F.lit(s), F.lit(n)).cast("long") for s, n in ((1, 3), (4, 3), (7, 4)))
        plan1 = (F.length(national) == 10) & code.isin("", "1") & (area >= 100) & (exchange >= 100)
        side = F.lit(90_000).cast("long")
        one = let(permute_number((area - 100) * 9_000_000 + (exchange - 100) * 10_000 + line, side, side, key, "phone+1", invert),
                  lambda v: F.concat((F.floor(v / 9_000_000) + 100).cast("string"),
                                     (F.pmod(F.floor(v / 10_000), F.lit(900)) + 100).cast("string"), _padded(F.pmod(v, F.lit(10_000)), F.lit(4))))
        other = m.startswith("+") & F.length(national).between(6, 15) & ~code.isin("1")
        new = F.when(plan1, one).when(other, _permuted_digits(national, key, "phone", invert))
        head = F.when(code == "", F.lit("")).otherwise(F.concat(F.lit("+"), code))
        return let(new, lambda x: F.when(x.isNotNull(), F.concat(head, _refill(rest, x, "[0-9]"))))

    def national(code: Column) -> Column:
        return F.when(code == "", m).otherwise(F.substr(m, F.length(code) + 2, F.length(m)))

    return let(country, lambda c: let(national(c), lambda p: let(_digits(p), lambda n: out(n, c, p))))


def _ssn(m: Column, key: str, invert: bool) -> Column:
    area, group, serial = (F.substring(m, s, n).cast("long") for s, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - F.when(area > 666, 2).otherwise(1)                    # 0 .. 897
    value = (rank * 99 + group - 1) * 9_999 + serial - 1

    def laid(v: Column) -> Column:
        r = F.floor(v / (99 * 9_999))
        a = r + F.when(r >= 665, 2).otherwise(1)
        return F.concat_ws("-", _padded(a, F.lit(3)), _padded(F.pmod(F.floor(v / 9_999), F.lit(99)) + 1, F.lit(2)), _padded(F.pmod(v, F.lit(9_999)) + 1, F.lit(4)))
    new = permute_number(value, F.lit(898 * 99).cast("long"), F.lit(9_999).cast("long"), key, "ssn", invert)
    return F.when(valid, let(new, laid))


def _mod97(chars: Column) -> Column:
    def step(t: Column, i: Column) -> Column:
        code = F.ascii(F.substr(chars, i, F.lit(1)))
        return F.pmod(F.when(code >= 65, t * 100 + code - 55).otherwise(t * 10 + code - 48), F.lit(97))
    return F.aggregate(F.sequence(F.lit(1), F.length(chars)), F.lit(0), step)


def _iban(m: Column, key: str, invert: bool) -> Column:
    def out(d: Column) -> Column:
        country = F.substring(d, 1, 2)
        new = permute_text(F.substr(d, F.lit(5), F.length(d)), key, "iban", invert)
        full = let(new, lambda p: F.concat(country, _padded(98 - _mod97(F.concat(p, country, F.lit("00"))), F.lit(2)), p))
        valid = (F.length(d).between(15, 34)) & (_mod97(F.concat(F.substr(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1)
        return F.when(valid, _refill(m, full, "[A-Z0-9]"))
    return let(F.regexp_replace(m, " ", ""), out)


def _mail(m: Column, key: str, invert: bool) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permute_text(name, key, "mail", invert), F.substr(m, F.length(name) + 1, F.length(m)))


_KINDS = {"mail": _mail, "iban": _iban, "ip": _ip, "date": _date, "card": _card, "phone": _phone, "ssn": _ssn}


def _kind(m: Column) -> Column:
    """The first kind whose whole pattern the candidate is."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _pseudonym(m: Column, key: str, invert: bool) -> Column:
    """struct(kind, value): the candidate's pseudonym, null if it is not valid."""
    def by_kind(kind: Column) -> Column:
        value = F.lit(None).cast("string")
        for name, make in _KINDS.items():
            value = F.when(kind == name, make(m, key, invert)).otherwise(value)
        return F.struct(kind.alias("kind"), value.alias("value"))
    return let(_kind(m), by_kind)


def pseudonymise(docs: DataFrame, key: str, reveal: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, found (array of struct(kind, value)) per row of ``docs(doc_id, text, ...)``."""
    none = F.array().cast("array<struct<kind:string,value:string>>")
    hinted = F.col("text").rlike(HINT)
    matches = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(0))
    new = F.transform(matches, lambda m: let(_pseudonym(m, key, reveal), lambda p: F.struct(
        p["kind"].alias("kind"), F.coalesce(p["value"], m).alias("value"), p["value"].isNotNull().alias("valid"))))
    rows = docs.select("doc_id", "text", F.when(hinted, new).alias("new"))
    pieces = F.split("text", ANY, -1)
    joined = let(pieces, lambda ps: F.array_join(F.transform(ps, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("new"), i)["value"], F.lit("")))), ""))
    some = F.size("new") > 0
    found = F.transform(F.filter("new", lambda x: x["valid"]), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
    return rows.select("doc_id", F.when(some, joined).otherwise(F.col("text")).alias("text"), F.when(some, found).otherwise(none).alias("found"))
