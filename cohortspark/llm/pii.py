"""Format-preserving pseudonyms for personal data: a keyed Feistel network in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import let

ROUNDS = 8
#: Dates are permuted within DAY * DAY days from DAY_ZERO, that is up to 2102-07-24.
DAY, DAY_ZERO = 272, "1900-01-01"

_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Candidates by kind; the first kind that matches at a place is tried. What fails its validation is left as it is.
KINDS = {
    # Only where a run of its characters begins, but for signs in front, and never giving characters back: a long run
    # without an @ is read once.
    "email": _NO_WORD_BEFORE + r"(?<=(?<![\p{L}\p{N}._%+-])[._%+-]{0,32})[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    # Printed groups of four end with a group of one to four; capitals that follow may be taken for more groups.
    "iban": _NO_WORD_BEFORE + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,4})?)" + _NO_WORD_AFTER,
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # National 3-3-4; + and 7 to 15 digits in groups; ten bare digits of which the first, as in an area code, is 2 to 9.
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
             r"|(?<![\d+])\+(?:\d(?:[ ./-]|\) ?| ?\(|-\()?){6,14}\d(?!\d)|(?<![\d+.,/-])[2-9]\d{9}(?![\d-]|[.,]\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
PATTERN = "|".join(KINDS.values())
_DATE_FORMS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d{2}/": "MM/dd/yyyy", r"^\d{2}\.": "dd.MM.yyyy"}


def feistel(digits: Column, radices: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the arrays with ``radices``: digit i stays below radix i.

    In turn, one half's digits are shifted by numbers that a digest of the key, tweak, round and the other half gives.
    """
    half = F.floor(F.size(digits) / 2).cast("int")

    def one_round(state: Column, r: Column) -> Column:
        first = r % 2 == 1
        other = F.when(first, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, F.lit(1), half))
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)
        return let(digest, lambda h: F.transform(state, lambda x, i: F.when(
            (i < half) == first,
            F.pmod(x + F.conv(F.substring(h, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.get(radices, i))
        ).otherwise(x).cast("int")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), digits, one_round)


def _permuted_chars(text: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Digits, small and capital ASCII letters stay in their class and place; other characters stay."""
    def base(c: Column) -> Column:
        return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(0)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    shape = F.transform(chars, lambda c: F.struct(
        c.alias("c"), base(c).alias("base"),
        F.when(base(c) == 48, 10).when(base(c) == 0, 1).otherwise(letters).alias("radix"),
        F.when(base(c) == 0, 0).otherwise(F.ascii(c) - base(c)).alias("digit")))
    # The places of the other characters and the classes belong to the tweak: each format has its own permutation.
    return let(shape, lambda s: let(
        feistel(s["digit"], s["radix"], key, F.concat_ws(":", F.lit(kind), F.array_join(F.transform(
            s, lambda x: F.when(x["base"] == 0, x["c"]).otherwise(x["base"].cast("string"))), " "))),
        lambda d: F.array_join(F.transform(s, lambda x, i: F.when(x["base"] == 0, x["c"]).otherwise(
            F.chr((x["base"] + F.get(d, i)).cast("bigint")))), "")))


def _numbers(text: Column, pattern: str = r"\d+") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x.cast("int"))


def _luhn(body: Column) -> Column:
    """The check digit of the digits ``body``."""
    doubled = F.transform(F.reverse(body), lambda d, i: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.pmod(10 - F.pmod(F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def _card(m: Column, key: str) -> Column:
    digits = _numbers(m, r"\d")
    valid = F.element_at(digits, -1) == _luhn(F.slice(digits, F.lit(1), F.size(digits) - 1))
    body = _permuted_chars(F.substring(m, F.lit(1), F.length(m) - 1), key, "card")
    return F.when(valid, let(body, lambda b: F.concat(b, _luhn(_numbers(b, r"\d")).cast("string"))))


def _mod97(text: Column) -> Column:
    """The number with A = 10 ... Z = 35, modulo 97."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _plain_iban(m: Column, key: str) -> Column:
    country, body = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    return let(_permuted_chars(body, key, "iban"), lambda b: F.concat(
        country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))


def _iban(m: Column, key: str) -> Column:
    """The groups as printed; of a run of groups, the most that are valid together, the others staying behind them."""
    def compact(text: Column) -> Column:
        return F.regexp_replace(text, "[ -]", "")

    def valid(text: Column) -> Column:
        return let(compact(text), lambda c: (F.length(c) >= 15) & (F.length(c) <= 34) & (_mod97(F.concat(
            F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1))

    groups = F.split(m, "[ -]")
    ends = F.transform(F.reverse(F.sequence(F.lit(1), F.size(groups))), lambda n: F.aggregate(
        F.slice(groups, F.lit(1), n), n - 1, lambda a, g: a + F.length(g)))
    whole = F.get(F.filter(ends, lambda e: valid(F.substring(m, F.lit(1), e))), F.lit(0))

    def printed(head: Column) -> Column:
        chars = F.filter(F.split(head, ""), lambda c: c != "")
        return let(_plain_iban(compact(head), key), lambda new: F.array_join(F.transform(chars, lambda c, i: F.when(
            c.isin(" ", "-"), c).otherwise(F.substring(new, F.length(compact(F.substring(head, F.lit(1), i + 1))), F.lit(1)))), ""))

    return F.when(whole.isNotNull(), let(whole, lambda e: F.concat(
        let(F.substring(m, F.lit(1), e), printed), F.substring(m, e + 1, F.length(m)))))


def _ip(m: Column, key: str) -> Column:
    octets = _numbers(m)
    moved = feistel(octets, F.array_repeat(F.lit(256), 4), key, F.lit("ip"))
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(moved.cast("array<string>"), "."))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    n = _numbers(m)
    area, group, serial = (F.get(n, i) for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    digits = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    moved = feistel(digits, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, F.lit("ssn"))
    return F.when(valid, let(moved, lambda d: F.format_string(
        "%03d-%02d-%04d", F.get(d, 0) + F.when(F.get(d, 0) > 664, 2).otherwise(1), F.get(d, 1) + 1, F.get(d, 2) + 1)))


def _date(m: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for shape, form in _DATE_FORMS.items():
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(DAY_ZERO).cast("date"))
        moved = feistel(F.array(F.floor(day / DAY).cast("int"), F.pmod(day, F.lit(DAY))), F.array(F.lit(DAY), F.lit(DAY)), key, F.lit("date"))
        days = let(moved, lambda d: F.get(d, 0) * DAY + F.get(d, 1))
        printed = F.date_format(F.date_add(F.lit(DAY_ZERO).cast("date"), days), form)
        out = F.when(m.rlike(shape), F.when(day.between(0, DAY * DAY - 1), printed)).otherwise(out)
    return out


def _phone(m: Column, key: str) -> Column:
    """The country code stays, and the first of ten bare digits."""
    code = F.regexp_extract(m, r"^(?:\+\d{1,3}|\d(?=\d{9}$))", 0)
    return F.concat(code, _permuted_chars(F.substring(m, F.length(code) + 1, F.length(m)), key, "phone"))


def _email(m: Column, key: str) -> Column:
    """The domain stays."""
    local = F.substring_index(m, "@", 1)
    return F.concat(_permuted_chars(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """Struct (kind, text) for a match of PATTERN: its pseudonym, or kind null and the match itself if it is not valid."""
    made = {"email": _email(m, key), "secret": _permuted_chars(m, key, "secret", letters=6), "iban": _iban(m, key),
            "ip": _ip(m, key), "date": _date(m, key), "ssn": _ssn(m, key), "phone": _phone(m, key), "card": _card(m, key)}
    kind = F.lit(None).cast("string")
    text = F.lit(None).cast("string")
    for name in reversed(KINDS):
        full = m.rlike(f"^(?:{KINDS[name]})$")
        kind, text = F.when(full, F.lit(name)).otherwise(kind), F.when(full, made[name]).otherwise(text)
    return let(text, lambda t: F.struct(F.when(t.isNotNull(), kind).alias("kind"), F.coalesce(t, m).alias("text")))


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced, and _kinds, the kinds of its replacements in order.

    Emails, quoted or bare hexadecimal secrets, IBANs, IPv4 addresses, dates, social security, phone
    and card numbers that pass their validation (check digits, ranges, calendar) become other valid
    values of the same format by a permutation under ``key``: equal values stay equal in all
    documents, different ones of one format stay different. Anything else stays as it is. Null texts
    stay null with no kinds; empty texts stay empty. All rows and other columns pass. No shuffle.

    The key is a plan constant: keep plans and event logs where the key may be.
    """
    text = F.col(f"_row.`{text_column}`")
    found = F.when(text.rlike("[0-9@]|[a-fA-F]{32}"), F.transform(
        F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_found", found)
    joined = F.concat_ws("", F.flatten(F.transform(F.split(text, PATTERN, -1), lambda s, i: F.array(
        s, F.coalesce(F.get(F.col("_found.text"), i), F.lit(""))))))
    new = F.when(F.size("_found") > 0, joined).otherwise(text)
    none = F.array().cast("array<string>")
    return rows.select(*[(new if c == text_column else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns],
                       F.coalesce(F.filter(F.col("_found.kind"), lambda k: k.isNotNull()), none).alias("_kinds"))
