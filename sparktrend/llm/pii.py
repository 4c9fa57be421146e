"""Format-preserving pseudonyms for personal data (DataFrame functions only).

Numbers and dates are found by pattern, validated (Luhn, IBAN check digits,
numbering plans, octets, the calendar), and permuted within their format by a
keyed Feistel network: a card stays a valid card, a date a date. The network is
a permutation, so equal values get equal pseudonyms in all documents and
different values different ones. The local part of an e-mail address is
permuted by the same network over its characters; its domain is the longest run
of letters, digits, hyphens and dots that ends in a dot and 2 to 24 letters, and
stays. What fails validation stays.

The key is a column: ``pseudonymise`` reads it by a scalar subquery, so that
plans, the web interface and event logs don't show it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import fresh

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NANP = r"[2-9]\d{2}"
#: Kinds in order of precedence, each with its pattern; matches never start or end inside a longer run. Only single
#: characters repeat without a bound: the matcher takes a call for each repetition of a group, and long texts would use up the stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=\.[A-Za-z]{2,24})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-])",
    "phone": rf"(?<![\w+])(?:\+?1[ .-]?)?\({_NANP}\)[ .-]?{_NANP}[ .-]?\d{{4}}(?!\w)|(?<![\w+])\+1[ .-]?{_NANP}[ .-]?{_NANP}[ .-]?\d{{4}}(?!\w)|(?<![\w+.-])(?:1[ .-])?{_NANP}[ .-]{_NANP}[ .-]\d{{4}}(?![\w-])",
    "abroad": r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(PATTERNS.values())


def _prf(key: Column, *parts: Column) -> Column:
    """60 bits of SHA-256 over the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def _of(key: Column, kind: str) -> Column:
    """The key of one kind."""
    return F.concat(key, F.lit(kind))


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The permutation of (a, b) in [0, size_a) x [0, size_b) under ``key``: a struct x, y. Sizes below 2^62."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"), size_a.cast("long").alias("p"), size_b.cast("long").alias("q"))
    turn = lambda s, i: F.struct(s["y"].alias("x"), ((s["x"] + _prf(key, i, s["p"], s["q"], s["y"]) % s["p"]) % s["p"]).alias("y"), s["q"].alias("p"), s["p"].alias("q"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), start, turn)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _characters(m: Column) -> Column:
    return F.regexp_extract_all(m, F.lit(r"(?s)."), F.lit(0))


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in turn by ``digits``; all else stays."""
    place = lambda i: F.length(_digits(F.substring(m, F.lit(1), i + 1)))
    return F.array_join(F.transform(_characters(m), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(d: Column, key: Column) -> Column:
    """A digit string permuted among those of its length (up to 34 digits)."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    left = F.when(half > 0, F.substring(d, F.lit(1), half)).otherwise(F.lit("0")).cast("long")
    moved = feistel(left, F.substring(d, half + 1, rest).cast("long"), power(half), power(rest), key)
    pad = lambda v, n: F.when(n > 0, F.lpad(v.cast("string"), n, "0")).otherwise(F.lit(""))
    return F.when(F.length(d) > 0, _let(moved, lambda s: F.concat(pad(s["x"], half), pad(s["y"], rest)))).otherwise(d)


def card(m: Column, key: Column) -> Column:
    """First digit and check rule kept; not Luhn-valid: unchanged."""
    d = _digits(m)
    body = _let(permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), _of(key, "card")), lambda p: F.concat(F.substring(d, 1, 1), p))
    checked = _let(body, lambda b: F.concat(b, F.element_at(F.filter(F.array(*[F.lit(str(k)) for k in range(10)]), lambda c: F.call_function("luhn_check", F.concat(b, c))), 1)))
    return F.when(F.call_function("luhn_check", d), _let(checked, lambda new: _refill(m, new))).otherwise(m)


def phone(m: Column, key: Column) -> Column:
    """Area and exchange in 200-999 and line permuted; a leading 1 kept."""
    d = _digits(m)
    part = lambda at, n: F.substring(d, F.length(d) - at, F.lit(n)).cast("long")
    moved = feistel((part(9, 3) - 200) * 800 + part(6, 3) - 200, part(3, 4), F.lit(640_000), F.lit(10_000), _of(key, "phone"))
    written = lambda s: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), (F.floor(s["x"] / 800) + 200).cast("string"), (s["x"] % 800 + 200).cast("string"), F.lpad(s["y"].cast("string"), 4, "0"))
    return _let(_let(moved, written), lambda new: _refill(m, new))


def abroad(m: Column, key: Column) -> Column:
    """International numbers of 8 to 15 digits; the first two digits (country) kept."""
    d = _digits(m)
    new = F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, F.lit(3), F.length(d) - 2), _of(key, "abroad")))
    return F.when(F.length(d).between(8, 15), _let(new, lambda n: _refill(m, n))).otherwise(m)


def ip(m: Column, key: Column) -> Column:
    o = lambda i: F.split(m, r"\.")[i].cast("long")
    moved = feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65_536), F.lit(65_536), _of(key, "ip"))
    return _let(moved, lambda s: F.concat_ws(".", *[v.cast("string") for h in (s["x"], s["y"]) for v in (F.floor(h / 256), h % 256)]))


def ssn(m: Column, key: Column) -> Column:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    moved = feistel((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9_999), _of(key, "ssn"))
    place = lambda s: F.floor(s["x"] / 99)
    return _let(moved, lambda s: F.concat_ws("-", F.lpad((place(s) + 1 + F.when(place(s) >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((s["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["y"] + 1).cast("string"), 4, "0")))


def date(m: Column, key: Column) -> Column:
    """Valid dates of the 400 years from 1800, permuted among those 146,097 = 189 x 773 days.

    Written year first, or day/month/year where that is valid, else
    month/day/year; the pseudonym has the same order and separator.
    """
    sign = F.regexp_extract(m, r"([-/.])", 1)
    part = F.split(m, r"[-/.]")
    iso = lambda y, mo, d: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    day_first, month_first = iso(part[2], part[1], part[0]), iso(part[2], part[0], part[1])
    value = F.when(sign == "-", iso(part[0], part[1], part[2])).otherwise(F.coalesce(day_first, month_first))
    order = F.when(sign == "-", F.lit("y-m-d")).when(day_first.isNotNull(), F.lit("d-m-y")).otherwise(F.lit("m-d-y"))
    start = F.lit("1800-01-01").cast("date")
    moved = lambda n: feistel(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), _of(key, "date"))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")

    def written(new: Column) -> Column:
        y, mo, d = F.year(new).cast("string"), two(F.month(new)), two(F.dayofmonth(new))
        return F.when(order == "y-m-d", F.concat_ws("-", y, mo, d)).when(order == "d-m-y", F.concat(d, sign, mo, sign, y)).otherwise(F.concat(mo, sign, d, sign, y))

    new = lambda n: F.date_add(start, _let(moved(n), lambda s: s["x"] * 773 + s["y"]).cast("int"))
    return _let(F.datediff(value, start), lambda n: F.when((n >= 0) & (n < 146_097), _let(new(n), written)).otherwise(m))


def _mod97(s: Column) -> Column:
    """Of letters and digits, letters as 10 to 35."""
    turn = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_characters(s), F.lit(0).cast("int"), turn)


def iban(m: Column, key: Column) -> Column:
    """The account's digits permuted, its check digits computed anew; an invalid one is unchanged."""
    plain = F.regexp_replace(m, " ", "")
    valid = _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))) == 1
    moved = permute_digits(_digits(F.substring(plain, F.lit(5), F.length(plain) - 4)), _of(key, "iban"))

    def checked(digits: Column) -> Column:
        account = _refill(F.substring(plain, F.lit(5), F.length(plain) - 4), digits)
        check = 98 - _mod97(F.concat(account, F.substring(plain, 1, 2), F.lit("00")))
        return F.concat(F.lpad(check.cast("string"), 2, "0"), digits)

    return F.when(valid, _let(_let(moved, checked), lambda new: _refill(m, new))).otherwise(m)


def email(m: Column, key: Column) -> Column:
    """The local part, permuted among those with the same letter cases, digits and signs; the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")

    def shifted(x: Column, hexed: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(hexed, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            turned = lambda low, n: F.char(F.lit(low) + (F.ascii(c) - low + by) % n)
            return F.when(c.rlike("[a-z]"), turned(97, 26)).when(c.rlike("[A-Z]"), turned(65, 26)).when(c.rlike("[0-9]"), turned(48, 10)).otherwise(c)

        return F.array_join(F.transform(_characters(x), move), "")

    turn = lambda s, i: F.struct(s["y"].alias("x"), _let(F.sha2(F.concat_ws("|", _of(key, "email"), i.cast("string"), s["y"]), 256), lambda h: shifted(s["x"], h)).alias("y"))
    start = F.struct(F.substring(local, F.lit(1), half).alias("x"), F.substring(local, half + 1, F.length(local) - half).alias("y"))
    moved = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)
    return F.concat(_let(moved, lambda s: F.concat(s["x"], s["y"])), F.lit("@"), domain)


KINDS = {"email": email, "iban": iban, "ip": ip, "ssn": ssn, "date": date, "phone": phone, "abroad": abroad, "card": card}


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one match of ``ANY``."""
    out = None
    for kind, f in KINDS.items():
        whole = m.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(whole, f(m, key)) if out is None else out.when(whole, f(m, key))
    return out.otherwise(m)


def _shown(key: str, docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the key as a column."""
    held = docs.sparkSession.createDataFrame([(key,)], "k string")
    return docs.withColumn(name, held.scalar())


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by pseudonyms under ``key``.

    ``count``: name of an added column (int) of how many values changed.
    Null texts stay null, empty ones empty; texts without digits or @ aren't
    searched; very long texts, runs of any kind's characters and e-mail
    domains of any number of labels are searched whole, in time that grows with
    the length and without deep recursion; all other columns, repeated rows and
    the row count stay; an empty table gives no rows; no shuffle. Matches don't
    overlap, and the leftmost, then the first kind of ``PATTERNS``, wins.
    """
    t = F.col(f"`{text}`")
    maybe = t.rlike(r"@|\d[\d ().-]{5,}\d|\d/\d|[A-Z]{2}\d\d")
    found, news, fresh_text, fresh_key = (fresh(f"__{n}", docs.columns) for n in ("found", "news", "text", "key"))
    matched = _shown(key, docs, fresh_key).withColumn(found, F.when(maybe, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    moved = matched.withColumn(news, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, F.col(fresh_key)))))
    joined = F.array_join(F.zip_with(F.split(t, ANY, -1), F.concat(F.col(news), F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), "")
    out = moved.withColumn(fresh_text, F.when(F.col(news).isNotNull(), joined).otherwise(t))
    changed = F.coalesce(F.size(F.filter(F.zip_with(found, news, lambda a, b: a != b), lambda x: x)), F.lit(0))
    columns = [F.col(fresh_text).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count]
    return out.select(*columns, *([F.when(F.col(news).isNotNull(), changed).otherwise(0).cast("int").alias(count)] if count else []))
