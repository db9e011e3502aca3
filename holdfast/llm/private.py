"""Personal data: format-preserving Feistel pseudonyms, with DataFrame functions only.

Candidates are found by one pattern and validated: card numbers (Luhn), IBANs (mod 97), social security
numbers and North American phone numbers (ranges), IPv4 addresses (octets), calendar dates; mail addresses
and secrets (access keys, hex tokens, passwords of 8 to 256 characters) by shape. What is valid is replaced by a keyed
permutation within its format: its characters become symbols of their own alphabet (digit, upper case,
lower case, octet, ...), one half of the symbols is shifted by a keyed hash of the other half, and the
halves take turns for ``ROUNDS`` rounds. That is a permutation of the values of a format under a key, so
equal values stay linked across documents, different ones stay different, and the key's holder can undo
it. Separators stay; check digits are recomputed; a date is permuted as a day of its 400-year cycle
(146,097 = 189 x 773 days), so any result is a calendar date, and equal dates of different layouts stay
linked.

Everything is one projection, so documents never move. Defined cases: null text stays null with no finds;
candidates that fail validation stay as they are; repeated rows give repeated results; further columns are
ignored, or kept by :func:`pseudonymise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import texts

ROUNDS = 8
#: The key of the registered query; callers pass their own secret.
KEY = "holdfast-demonstration-key"

#: The shapes of candidates. Alternatives are tried in this order at each place.
MAIL = r"[\p{L}0-9][\p{L}0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
KEY_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:password)=[^\x00-\x20\"'<>,;]{8,256}(?![^\x00-\x20\"'<>,;])|(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
PHONE = r"(?<![\d+])(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
PATTERN = "|".join([MAIL, KEY_ID, SECRET, IBAN, DATE, IP, PHONE, SSN, CARD])

KINDS = ["mail", "key", "secret", "iban", "date", "ip", "phone", "ssn", "card"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once (a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def feistel(symbols: Column, radix: Column, key: str, kind: str) -> Column:
    """Keyed permutation of an array of symbols, each below its entry of the array ``radix``.

    Position i of a half is shifted by 16 bits of the hash of the other half, modulo its radix."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def one(state: Column, r: Column) -> Column:
        first = r % 2 == 0  # the half that is hashed
        other = F.concat_ws(",", F.transform(F.when(first, F.slice(state, 1, half)).otherwise(F.slice(state, half + 1, F.size(state) - half)), lambda x: x.cast("string")))
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), F.array_join(F.transform(radix, lambda x: x.cast("string")), ","), r.cast("string"), other)
        stream = F.concat(*(F.sha2(F.concat(seed, F.lit(f"|{k}")), 256) for k in range(2)))

        def shifted(s: Column) -> Column:
            def symbol(x: Column, i: Column) -> Column:
                at = F.when(first, i - half).otherwise(i)
                moved = F.when(first, i >= half).otherwise(i < half)
                step = F.conv(F.substr(s, at % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.when(moved, (x + step) % F.get(radix, i)).otherwise(x)

            return F.transform(state, symbol)

        return _let(stream, shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols, one)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _ints(v: Column) -> Column:
    """Digits of a string as integers; null for the empty string is avoided by an empty array."""
    return F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _text(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda x: x.cast("string")), "")


def _refill(form: Column, fill: Column, slot: str = "[0-9]") -> Column:
    """``form`` with its slots, in order, taken from the string ``fill``."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    rank = F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.size(F.filter(F.slice(chars, 1, i), lambda c: c.rlike(slot))))
    return F.array_join(F.zip_with(chars, rank, lambda c, k: F.when(c.rlike(slot), F.substr(fill, k, F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    at = F.reverse(_ints(digits))
    doubled = F.transform(at, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(v: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        payload = F.slice(_ints(d), 2, F.length(d) - 2)  # the issuer's digit and the check digit aside
        moved = F.concat(F.substring(d, 1, 1), _text(feistel(payload, F.transform(payload, lambda x: F.lit(10)), key, "card")))
        check = lambda m: F.concat(m, ((10 - luhn_sum(F.concat(m, F.lit("0"))) % 10) % 10).cast("string"))
        return _refill(v, _let(moved, check))

    return _let(_digits(v), body)


def _mod97(s: Column) -> Column:
    """An alphanumeric string, letters read as 10 to 35, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), value), F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)


#: Alphabets of letters and digits: pattern, first code point, radix, and a code point to step over.
ALPHABETS = [("[0-9]", 48, 10, None), ("[A-Z]", 65, 26, None), ("[a-z]", 97, 26, None), ("[À-ÖØ-Þ]", 0xC0, 30, 0xD7), ("[à-öø-ÿ]", 0xE0, 31, 0xF7)]
ALNUM = "[A-Za-z0-9À-ÖØ-öø-ÿ]"


def _alphanumeric(s: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted within their alphabets; other characters stay."""

    def symbol(c: Column) -> Column:
        out = F
        for pattern, first, _, gap in ALPHABETS:
            at = F.ascii(c) - first
            out = out.when(c.rlike(pattern), at if gap is None else at - F.when(F.ascii(c) > gap, 1).otherwise(0))
        return out.otherwise(0)

    def radix(c: Column) -> Column:
        out = F
        for pattern, _, size, _ in ALPHABETS:
            out = out.when(c.rlike(pattern), F.lit(size))
        return out.otherwise(1)

    def back(c: Column, x: Column) -> Column:
        out = F
        for pattern, first, _, gap in ALPHABETS:
            at = x + first
            out = out.when(c.rlike(pattern), F.char(at if gap is None else at + F.when(at >= gap, 1).otherwise(0)))
        return out.otherwise(c)

    def body(chars: Column) -> Column:
        return F.array_join(F.zip_with(chars, feistel(F.transform(chars, symbol), F.transform(chars, radix), key, kind), back), "")

    plain = F.regexp_replace(s, "[^A-Za-z0-9À-ÖØ-öø-ÿ]", "")
    return _refill(s, _let(F.filter(F.split(plain, ""), lambda c: c != ""), body), ALNUM)


def _hex(s: Column, key: str) -> Column:
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    moved = feistel(F.transform(chars, lambda c: F.conv(c, 16, 10).cast("int")), F.transform(chars, lambda c: F.lit(16)), key, "hex")
    out = F.array_join(F.transform(moved, lambda x: F.conv(x.cast("string"), 10, 16)), "")
    return F.when(s.rlike("[a-f]"), F.lower(out)).otherwise(out)


def _secret(v: Column, key: str) -> Column:
    return F.when(v.rlike("^([0-9a-f]+|[0-9A-F]+)$"), _hex(v, key)).otherwise(_alphanumeric(v, key, "secret"))


def _iban(v: Column, key: str) -> Column:
    def body(s: Column) -> Column:
        account = _alphanumeric(F.substr(s, F.lit(5), F.length(s)), key, "iban")
        country = F.substring(s, 1, 2)
        check = lambda a: F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)
        return _refill(v, _let(account, check), "[A-Za-z0-9]")

    return _let(F.regexp_replace(v, " ", ""), body)


def _iban_ok(v: Column) -> Column:
    s = F.regexp_replace(v, " ", "")
    return (F.length(s).between(15, 34)) & (_mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def _phone(v: Column, key: str) -> Column:
    """The last ten digits; the first digits of area and exchange stay among 0 and 1, or 2 to 9."""
    def body(d: Column) -> Column:
        lead = lambda i: (i == 0) | (i == 3)
        own = _ints(F.substr(d, F.length(d) - 9, F.lit(10)))
        symbols = F.transform(own, lambda x, i: F.when(lead(i) & (x > 1), x - 2).otherwise(x))
        radix = F.transform(own, lambda x, i: F.when(~lead(i), F.lit(10)).when(x > 1, F.lit(8)).otherwise(F.lit(2)))
        moved = F.zip_with(feistel(symbols, radix, key, "phone"), radix, lambda x, r: F.when(r == 8, x + 2).otherwise(x))
        return _refill(v, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _text(moved)))

    return _let(_digits(v), body)


def _phone_ok(v: Column) -> Column:
    """Ten digits, or eleven after 1; without parentheses or prefix, area and exchange begin with 2 to 9."""
    return _digits(v).rlike(r"^1?\d{10}$") & (v.rlike(r"^\+1|\(") | _digits(v).rlike(r"^[2-9]\d{2}[2-9]\d{6}$"))


def _ssn_ok(v: Column) -> Column:
    return v.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def _ssn(v: Column, key: str) -> Column:
    """Area (898 values), group (99) and serial (9,999) as three symbols, the serial cut in two factors."""
    area, group, serial = F.substring(v, 1, 3).cast("int"), F.substring(v, 5, 2).cast("int"), F.substring(v, 8, 4).cast("int") - 1
    symbols = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, F.floor(serial / 101).cast("int"), serial % 101)
    radix = F.array(F.lit(898), F.lit(99), F.lit(99), F.lit(101))

    def body(m: Column) -> Column:
        area = F.when(m[0] + 1 >= 666, m[0] + 2).otherwise(m[0] + 1)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(area, 3), pad(m[1] + 1, 2), pad(m[2] * 101 + m[3] + 1, 4))

    return _let(feistel(symbols, radix, key, "ssn"), body)


def _ip(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(feistel(octets, F.transform(octets, lambda x: F.lit(256)), key, "ip"), lambda x: x.cast("string")), ".")


def _ip_ok(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))


def _day(v: Column) -> Column:
    """Days since 1700-01-01 of a date in any layout, null if the calendar has none or its year is not within 100 to
    9699, the cycles whose years all have four digits. A date with slashes is read month first, else day first."""
    parsed = F.coalesce(*(F.try_to_timestamp(v, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy")))
    days = F.unix_date(parsed.cast("date")) + 98615
    return F.when(days.between(-4 * 146097, 20 * 146097 - 1), days)


def _date(v: Column, key: str) -> Column:
    def body(n: Column) -> Column:
        cycle, day = F.floor(n / 146097).cast("int"), F.pmod(n, F.lit(146097))
        moved = feistel(F.array(F.floor(day / 773).cast("int"), day % 773), F.array(F.lit(189), F.lit(773)), key, "date")

        def shown(m: Column) -> Column:
            d = F.date_from_unix_date(cycle * 146097 + m[0] * 773 + m[1] - 98615)
            return F.when(v.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(v.contains("."), F.date_format(d, "dd.MM.yyyy")).otherwise(F.when(F.try_to_timestamp(v, F.lit("MM/dd/yyyy")).isNotNull(), F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")))

        return _let(moved, shown)

    return _let(_day(v), body)


def _mail(v: Column, key: str) -> Column:
    """The local part is permuted; the domain, which many addresses share, stays."""
    return F.concat(_alphanumeric(F.substring_index(v, "@", 1), key, "mail"), F.lit("@"), F.substring_index(v, "@", -1))


def kind_of(v: Column) -> Column:
    """The kind of a candidate, null if it fails validation."""
    whole = lambda p: v.rlike("^(?:" + p + ")$")
    return (
        F.when(v.contains("="), F.when(F.regexp_replace(v, "^[^=]*=", "").rlike(ALNUM), F.lit("secret")))
        .when(v.contains("@"), "mail")
        .when(whole(KEY_ID), "key")
        .when(whole(DATE) & _day(v).isNotNull(), "date")
        .when(whole(IP), F.when(_ip_ok(v), F.lit("ip")))
        .when(whole(SSN), F.when(_ssn_ok(v), F.lit("ssn")))
        .when(whole(CARD) & (luhn_sum(_digits(v)) % 10 == 0), "card")
        .when(whole(PHONE), F.when(_phone_ok(v), F.lit("phone")))
        .when(whole(IBAN) & _iban_ok(v), "iban")
        .when(whole(SECRET), "secret")
    )


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    """The value's image under the key; values without kind stay."""
    return (
        F.when(kind == "mail", _mail(v, key))
        .when(kind == "key", F.concat(F.substring(v, 1, 4), _alphanumeric(F.substr(v, F.lit(5), F.length(v)), key, "key")))
        .when(kind == "secret", F.when(v.contains("="), F.concat(F.substring_index(v, "=", 1), F.lit("="), _secret(F.regexp_replace(v, "^[^=]*=", ""), key))).otherwise(_secret(v, key)))
        .when(kind == "iban", _iban(v, key))
        .when(kind == "date", _date(v, key))
        .when(kind == "ip", _ip(v, key))
        .when(kind == "phone", _phone(v, key))
        .when(kind == "ssn", _ssn(v, key))
        .when(kind == "card", _card(v, key))
        .otherwise(v)
    )


def _found(docs: DataFrame, key: str) -> DataFrame:
    """With ``__hf_finds``: the candidates in order, as (value, kind, pseudonym)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    candidates = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    finds = F.transform(candidates, lambda v: _let(kind_of(v), lambda k: F.struct(v.alias("value"), k.alias("kind"), pseudonym(v, k, key).alias("pseudonym"))))
    return docs.withColumn("__hf_finds", finds)


def _replaced() -> Column:
    parts, finds = F.split(F.col("text").cast("string"), PATTERN, -1), F.col("__hf_finds.pseudonym")
    joined = F.array_join(F.zip_with(parts, F.concat(finds, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    return F.when(F.size("__hf_finds") == 0, F.col("text").cast("string")).otherwise(joined)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` pseudonymised; rows and other columns stay."""
    return _found(docs, key).withColumn("text", _replaced()).drop("__hf_finds")


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per row: doc_id, n_private, a count by kind, private (pseudonyms in order) and the new text."""
    found = _found(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), key)
    count = lambda k: F.size(F.filter("__hf_finds", lambda x: x["kind"] == k)).cast("long")
    valid = F.filter("__hf_finds", lambda x: x["kind"].isNotNull())
    return found.select("doc_id", F.size(valid).cast("long").alias("n_private"), *(count(k).alias(f"n_{k}") for k in KINDS), F.transform(valid, lambda x: x["pseudonym"]).alias("private"), _replaced().alias("text"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(texts(spark, sf_dir))
