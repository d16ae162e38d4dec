"""Operator 4: format-preserving pseudonyms for personal data.

Numbers and dates are found by their formats, validated, permuted within all values of their format by a keyed Feistel
network, and written back in the place of their digits: separators stay, check digits are made anew, a date stays a date.
The permutation depends on a secret key (HMAC-SHA256 in every round), the kind and the value, so equal values have equal
pseudonyms in all documents, and two numbers or dates never share one. Only SQL expressions are used.

Kinds, in order of precedence: email (a keyed hash, as there is no number to permute), iban (check digits by 97), date
(days of 1900 to 2099), ip (four bytes), phone (an international prefix or an area code in brackets), ssn (area, group
and serial number in range) and card (13 to 19 digits, check digit by Luhn). What fails its check stays as it is.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fenced, read_table

#: Where a session keeps its key; without one, a session draws its own.
KEY_SETTING = "spark.sievetide.pseudonymKey"
ROUNDS = 10
# Month names, and the lengths of IBANs by country.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_MONTH = "|".join(sorted({m for names in MONTHS.values() for m in names}, key=lambda m: (-len(m), m)))
#: What may stand neither before nor after a number.
EDGE_BEFORE, EDGE_AFTER = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "iban": EDGE_BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + EDGE_AFTER,
    "date": EDGE_BEFORE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}|[0-9]{1,2}\.? (?:de )?(?i:" + _MONTH + r")(?: de)? [0-9]{4}|(?i:" + _MONTH + r") [0-9]{1,2}, [0-9]{4})" + EDGE_AFTER,
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,7}(?:[ .-]?[0-9]{2,7}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8})" + EDGE_AFTER + "(?!-[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}" + EDGE_AFTER,
}
#: What is looked for inside a match that fails its check, as it may have taken in what stands beside: the usual forms.
INSIDE = {
    "iban": EDGE_BEFORE + "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")" + EDGE_AFTER,
    "date": FORMATS["date"],
    "card": EDGE_BEFORE + r"(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})" + EDGE_AFTER,
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?[0-9]{2,4}[ .-]?[0-9]{6,8}" + EDGE_AFTER,
}
KINDS = tuple(FORMATS)
ANY, ANY_INSIDE = "|".join(FORMATS.values()), "|".join(INSIDE.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def keyed(key: str, kind: str, *parts: Column) -> Column:
    """52 bits of HMAC-SHA256."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in secret))
    message = F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]).cast("binary")
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return F.conv(F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 13), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str, form: Column) -> Column:
    """The pair (a, b), a below size_a and b below size_b, permuted: each round adds a keyed hash of one half to the other."""

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        h = keyed(key, kind, form, i, F.when(odd, acc["b"]).otherwise(acc["a"]))
        return F.struct(F.when(odd, (acc["a"] + h % size_a) % size_a).otherwise(acc["a"]).alias("a"), F.when(odd, acc["b"]).otherwise((acc["b"] + h % size_b) % size_b).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A string of up to 36 digits as another one of its length; zeros in front count."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    rest = (n - half).cast("int")
    pair = feistel(F.coalesce(F.substr(d, F.lit(1), half).try_cast("long"), F.lit(0)), F.coalesce(F.substr(d, half + 1).try_cast("long"), F.lit(0)), ten_to(half), ten_to(rest), key, kind, n)
    return F.concat(F.when(half > 0, F.lpad(pair["a"].cast("string"), half, "0")).otherwise(""), F.lpad(pair["b"].cast("string"), rest, "0"))


def refilled(x: Column, d: Column) -> Column:
    """x with its digits replaced by those of d, from the left."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(d, acc["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def luhn_sum(d: Column) -> Column:
    """The weighted sum of digits, as if a check digit followed: the last digit counts twice."""
    chars = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda acc, v: acc + v)


def luhn_digit(payload: Column) -> Column:
    return ((10 - luhn_sum(payload) % 10) % 10).cast("string")


def card(x: Column, key: str) -> Column:
    d = digits_of(x)
    payload = F.substr(d, F.lit(1), (F.length(d) - 1).cast("int"))
    fresh = permuted_digits(payload, key, "card")
    return F.when(luhn_digit(payload) == F.right(d, F.lit(1)), refilled(x, F.concat(fresh, luhn_digit(fresh))))


def mod97(x: Column) -> Column:
    """Remainder by 97 of letters and digits read as a number, letters as 10 to 35."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def iban(x: Column, key: str) -> Column:
    plain = F.replace(x, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    fresh = refilled(body, permuted_digits(digits_of(body), key, "iban"))
    check = F.lpad((98 - mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
    valid = (mod97(F.concat(body, country, F.substring(plain, 3, 2))) == 1) & (F.length(plain) >= 15) & (F.length(digits_of(body)) > 0)
    return F.when(valid, refilled(x, F.concat(check, digits_of(fresh))))


def ip(x: Column, key: str) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, "ip", F.lit(4))
    fresh = F.concat_ws(".", F.floor(pair["a"] / 256).cast("string"), (pair["a"] % 256).cast("string"), F.floor(pair["b"] / 256).cast("string"), (pair["b"] % 256).cast("string"))
    return F.when(F.forall(octets, lambda o: o <= 255), fresh)


def phone(x: Column, key: str) -> Column:
    """The digits after a country code of up to three, or a national zero, are permuted: the last ten, or all but the first of fewer than eleven with a plus."""
    d = digits_of(x)
    n = F.length(d)
    kept = F.when(x.startswith("+"), F.greatest(n - 10, F.lit(1))).when(x.startswith("0"), 1).otherwise(F.lit(0)).cast("int")
    tail = permuted_digits(F.substr(d, kept + 1), key, "phone")
    return F.when((n >= 8) & (n <= 15), refilled(x, F.concat(F.substr(d, F.lit(1), kept), tail)))


def ssn(x: Column, key: str) -> Column:
    """Areas 1 to 899 without 666, groups 1 to 99 and serial numbers 1 to 9999 as one range of pairs."""
    area, group, serial = (F.element_at(F.split(x, "-"), i).cast("int") for i in (1, 2, 3))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", F.lit(9))
    new_rank = F.floor(pair["a"] / 99)
    new_area = F.when(new_rank >= 665, new_rank + 2).otherwise(new_rank + 1)
    two = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), F.concat_ws("-", two(new_area, 3), two(pair["a"] % 99 + 1, 2), two(pair["b"] + 1, 4)))


def date(x: Column, key: str) -> Column:
    """Days from 1900-01-01 to 2099-12-31: 73,049 of them, 319 times 229. Of two readings the day comes first, then the month."""
    iso, dotted = F.regexp_extract(x, r"^(\d{4})-(\d{2})-(\d{2})$", 0) != "", x.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{4}$")
    parts = F.split(x, r"[^0-9]+")
    name, first = F.regexp_extract(x, r"(\p{L}{3,})", 1), x.rlike(r"^\p{L}")
    # The list of names that has this one, and its place there.
    lists = [F.array(*[F.lit(m) for m in names]) for names in MONTHS.values()]
    place = [F.array_position(F.transform(one, F.lower), F.lower(name)).cast("int") for one in lists]
    month_no = F.coalesce(*[F.when(p > 0, p) for p in place])
    day_no = F.regexp_extract(x, r"(?<![0-9])([0-9]{1,2})(?![0-9])", 1)
    make = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    day_first = make(F.right(x, F.lit(4)), F.get(parts, F.lit(1)), parts[0])
    month_first = make(F.right(x, F.lit(4)), parts[0], F.get(parts, F.lit(1)))
    swapped = dotted & day_first.isNull()
    day = F.when(iso, F.try_to_date(x, "yyyy-MM-dd")).when(dotted, F.coalesce(day_first, month_first)).otherwise(make(F.right(x, F.lit(4)), month_no, day_no))
    sep = F.regexp_extract(x, r"([./])", 1)
    between = lambda pattern: F.regexp_extract(x, pattern, 1)  # noqa: E731  what stands between number and name
    cased = lambda m: F.when(name == F.upper(name), F.upper(m)).when(F.left(name, F.lit(1)) == F.upper(F.left(name, F.lit(1))), F.concat(F.upper(F.left(m, F.lit(1))), F.substring(m, 2, 20))).otherwise(F.lower(m))

    def written_as(fresh: Column) -> Column:
        part = lambda form: F.date_format(fresh, form)
        as_dotted = F.concat(F.when(swapped, part("MM")).otherwise(part("dd")), sep, F.when(swapped, part("dd")).otherwise(part("MM")), sep, part("yyyy"))
        month = F.coalesce(*[F.when(p > 0, F.element_at(one, F.month(fresh))) for p, one in zip(place, lists, strict=True)])
        as_named = let(month, lambda m: F.when(first, F.concat(cased(m), F.lit(" "), part("d"), F.lit(", "), part("yyyy"))).otherwise(F.concat(part("d"), between(r"^[0-9]+(\.? (?:de )?)"), cased(m), between(r"((?: de)? )[0-9]{4}$"), part("yyyy"))))
        return F.when(iso, part("yyyy-MM-dd")).when(dotted, as_dotted).otherwise(as_named)

    def moved(n: Column) -> Column:
        pair = feistel(F.floor(n / 229), n % 229, F.lit(319), F.lit(229), key, "date", F.lit("day"))
        fresh = let(pair, lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * 229 + p["b"]).cast("int")))
        return F.when((n >= 0) & (n < 319 * 229), let(fresh, written_as))

    return let(F.datediff(day, F.lit("1900-01-01").cast("date")), moved)


def email(x: Column, key: str) -> Column:
    """Two keyed hashes of 104 bits: of the address, and of its domain, so that addresses of a domain stay together."""
    h = lambda kind, v: F.concat(*[F.lpad(F.lower(F.hex(keyed(key, kind, F.lit(i), F.lower(v)))), 13, "0") for i in (1, 2)])
    return F.concat(F.lit("u"), h("email", x), F.lit("@d"), h("domain", F.element_at(F.split(x, "@"), 2)), F.lit(".invalid"))


PSEUDONYM = {"email": email, "iban": iban, "date": date, "ip": ip, "phone": phone, "ssn": ssn, "card": card}


FOUND = "STRUCT<value: STRING, kind: STRING, pseudonym: STRING>"


def _judged(x: Column, key: str, formats: dict[str, str]) -> Column:
    """Of a match: itself, the first kind whose format and check it passes, and its pseudonym."""
    none = F.struct(x.alias("value"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("pseudonym"))
    options = [F.when(x.rlike(f"^(?:{formats[k]})$"), F.struct(x.alias("value"), F.lit(k).alias("kind"), PSEUDONYM[k](x, key).alias("pseudonym"))) for k in formats]
    return reduce(lambda rest, o: F.coalesce(let(o, lambda v: F.when(v["pseudonym"].isNotNull(), v)), rest), reversed(options), none)


def _parts(text: Column, key: str, pattern: str, formats: dict[str, str]) -> Column:
    """text as an array of (value, kind, pseudonym): matches with what stands between them, which has no kind."""
    plain = lambda x: F.struct(x.alias("value"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("pseudonym"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), found, lambda g, f: F.array(plain(g), F.when(f.isNotNull(), _judged(f, key, formats))))
    return F.filter(F.flatten(both), lambda p: p.isNotNull() & (p["value"] != ""))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, and pii: an array of (kind, pseudonym) in text order (replaced if docs has it).

    Null and empty texts stay as they are, with an empty array; a null doc_id plays no part; repeated rows and equal values
    get equal results; an empty table gives an empty one. Whole texts are searched; what lies beside the matches
    is copied unchanged. In a match that fails its checks the usual forms (INSIDE) are looked for once more, since it may
    have taken in what stands beside it.
    """
    own, name = fenced(docs)
    text = F.col(name["text"])
    # Without a digit or an @ nothing can match.
    out = own.withColumn("parts", F.when(text.rlike("[0-9@]"), _parts(text, key, ANY, FORMATS)))
    # A second step, over what was a match and failed; in a column of its own, so that the first is computed once.
    failed = lambda p: p["kind"].isNull() & p["value"].rlike(ANY_INSIDE)
    again = F.flatten(F.transform("parts", lambda p: F.when(failed(p), _parts(p["value"], key, ANY_INSIDE, INSIDE)).otherwise(F.array(p))))
    out = out.withColumn("parts", F.when(F.exists("parts", failed), again).otherwise(F.col("parts")))
    kinds = F.transform(F.filter("parts", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["pseudonym"].alias("pseudonym")))
    out = out.withColumn("pii", F.coalesce(kinds, F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, pseudonym: STRING>>)")))
    changed = F.array_join(F.transform("parts", lambda p: F.coalesce(p["pseudonym"], p["value"])), "")
    new = F.when(F.size("pii") > 0, changed).otherwise(text)
    return out.select(*[(new if c == "text" else F.col(name[c])).alias(c) for c in docs.columns if c.lower() != "pii"], "pii")


def session_key(spark: SparkSession) -> str:
    """The session's key: its setting, or one that it draws once and keeps. Pseudonyms of different keys don't meet."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms under the session's key, and how many of each kind they hold."""
    out = pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    of_kind = lambda k: F.size(F.filter("pii", lambda f: f["kind"] == k)).alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return out.select("doc_id", "text", *counts)
