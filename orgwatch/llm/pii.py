"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Card numbers (Luhn digit right), social-security numbers (issued ranges), telephone numbers (ten digits; bare ones only
where area and exchange begin with no 0; behind a + and another country's code, which stays, 8 to 15 digits; behind a trunk 0,
9 to 12 digits in groups), IPv4 addresses (octets up to 255, without leading zeros) and dates (real days of 1800-2199, with
or without leading zeros; with slashes the month comes first where it can) that pass validation are permuted within their own
format by a keyed Feistel network over two mixed moduli, so a pseudonym is again valid, two values never meet in one pseudonym, and
equal values stay linked across documents. An e-mail address, which has no fixed format, becomes a keyed digest that
has an address's form. What fails validation stays as it is. What is found in a text does not depend on what else is in it.

Defined cases: a null text stays null with 0 findings; an empty text stays empty; extra columns pass through; repeated
rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Fixed formats; the first that matches at a place wins. No pattern can start inside a longer run of its own characters.
#: Loops over groups are possessive, so that none recurses over a long text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?<=\.[A-Za-z]{2,63})"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[0-9]{7,12}|(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-][0-9]{1,8}){2,6})(?![0-9])"
TRUNK = r"(?<![0-9+])0[0-9]{3,4}[ .-][0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])"
DATE = (
    r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|(?<!/)[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
    r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|(?<!\.)[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"
)
#: All but e-mail begin with a digit, a + or a bracket; other places are passed by after one look.
NUMBERS = f"(?=[0-9+(])(?:{'|'.join((IPV4, CARD, SSN, PHONE, ABROAD, TRUNK, DATE))})"
PATTERN = f"{EMAIL}|{NUMBERS}"
#: Every finding has an @ (e-mail), a digit, a dot and a digit (addresses), a + and a digit (telephone abroad) or three digits
#: in a row (all others), so a text without any of them has no finding. What may begin one is told by its first character.
HINT = r"[@0-9+](?:(?<=@)|(?<=[0-9])(?:[0-9]{2}|\.[0-9])|(?<=\+)[1-9])"

#: 400 years of the calendar are this many days, 189 times 773; so many of them, 9 times 9,833, are later than a 12th.
ERA, ERA_A, ERA_B = 146_097, 189, 773
LATE_A, LATE_B = 9, 9833


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(hexdigits: Column) -> Column:
    """The first 60 bits of a digest, as a long."""
    return F.conv(F.substring(hexdigits, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, tag: str, key: str, rounds: int = 8) -> Column:
    """Permute the pairs (left below a, right below b): each round adds a keyed digest of one half to the other."""

    def step(at: Column, i: Column) -> Column:
        a, b = at["a"], at["b"]
        odd = i % 2 == 1
        mixed = _number(_digest(key, F.lit(tag), a, b, i, F.when(odd, at["l"]).otherwise(at["r"])))
        return F.struct(
            a.alias("a"),
            b.alias("b"),
            F.when(odd, at["l"]).otherwise(F.pmod(at["l"] + F.pmod(mixed, a), a)).alias("l"),
            F.when(odd, F.pmod(at["r"] + F.pmod(mixed, b), b)).otherwise(at["r"]).alias("r"),
        )

    start = F.struct(*[c.cast("long").alias(name) for c, name in ((a, "a"), (b, "b"), (left, "l"), (right, "r"))])
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def _tens(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _luhn(payload: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(payload)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(payload, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.lit(10) - F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10, F.lit(10)).cast("string")


def _put(token: Column, digits: Column) -> Column:
    """``token`` with its digits replaced by ``digits`` in turn."""

    def step(at: Column, i: Column) -> Column:
        c = F.substr(token, i, F.lit(1))
        isdigit = c.rlike("[0-9]")
        return F.struct(
            F.concat(at["out"], F.when(isdigit, F.substr(digits, at["k"], F.lit(1))).otherwise(c)).alias("out"),
            (at["k"] + F.when(isdigit, 1).otherwise(0)).alias("k"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.length(token)), start, step)["out"]


def _card(token: Column, digits: Column, key: str) -> Column:
    n = F.length(digits)
    payload = F.substr(digits, F.lit(1), n - 1)
    half = F.floor(n / 2).cast("int")
    lsize, rsize = half, n - 1 - half
    pair = feistel(F.substr(payload, F.lit(1), half).cast("long"), F.substr(payload, half + 1, rsize).cast("long"), _tens(lsize), _tens(rsize), "card", key)
    return F.transform(
        F.array(pair),
        lambda p: F.when(
            F.substr(digits, n, F.lit(1)) == _luhn(payload),
            F.transform(
                F.array(F.concat(F.lpad(p["l"].cast("string"), lsize, F.lit("0")), F.lpad(p["r"].cast("string"), rsize, F.lit("0")))),
                lambda new: _put(token, F.concat(new, _luhn(new))),
            )[0],
        ).otherwise(token),
    )[0]


def _phone(token: Column, digits: Column, key: str) -> Column:
    """Ten digits. Behind a country code or with the area in brackets any will do; bare ones are taken for a number only
    where area and exchange begin with no 0. Where one begins with 2 to 9, as issued ones do, so does its pseudonym."""
    n = F.length(digits)
    area, rest = F.substr(digits, n - 9, F.lit(3)).cast("long"), F.substr(digits, n - 6, F.lit(7)).cast("long")
    issued = lambda x, least: F.when(x >= 2 * least, 2 * least).when(x >= least, least).otherwise(0)
    low, high = issued(area, 100), issued(rest, 1_000_000)
    size = lambda lowest, least: F.when(lowest > least, 8 * least).otherwise(least).cast("long")
    pair = feistel(area - low, rest - high, size(low, 100), size(high, 1_000_000), "phone", key)
    shown = lambda x, n: F.lpad(x.cast("string"), n, "0")
    new = F.transform(F.array(pair), lambda p: F.concat(shown(p["l"] + low, 3), shown(p["r"] + high, 7)))[0]
    return F.when(token.rlike(r"[(+]") | ((area >= 100) & (rest >= 1_000_000)), _put(token, F.concat(F.substr(digits, F.lit(1), n - 10), new))).otherwise(token)


def _numbered(token: Column, digits: Column, key: str, tag: str, kept: int) -> Column:
    """``token`` with the digits after the first ``kept`` permuted by their number, where it has 8 to 15 digits."""
    n = F.length(digits)
    lsize = F.floor((n - kept) / 2).cast("int")
    rsize = n - kept - lsize
    halves = F.substr(digits, F.lit(kept + 1), lsize).cast("long"), F.substr(digits, lsize + kept + 1, rsize).cast("long")
    pair = feistel(*halves, _tens(lsize), _tens(rsize), tag, key)
    new = F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["l"].cast("string"), lsize, F.lit("0")), F.lpad(p["r"].cast("string"), rsize, F.lit("0"))))[0]
    return F.when((n >= 8) & (n <= 15), _put(token, F.concat(F.substr(digits, F.lit(1), F.lit(kept)), new))).otherwise(token)


def _ssn(token: Column, key: str) -> Column:
    area, group, serial = (F.substring(token, at, size).cast("long") for at, size in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key)
    shown = F.transform(
        F.array(pair),
        lambda p: F.concat_ws(
            "-",
            F.lpad((p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"),
        ),
    )[0]
    return F.when(valid, shown).otherwise(token)


def _ipv4(token: Column, key: str) -> Column:
    octets = F.transform(F.split(token, r"\."), lambda x: x.cast("long"))
    pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), "ipv4", key)
    shown = F.transform(
        F.array(pair),
        lambda p: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)]),
    )[0]
    plain = F.concat_ws(".", F.transform(octets, lambda x: x.cast("string"))) == token
    return F.when(plain & F.forall(octets, lambda x: x < 256), shown).otherwise(token)


def _date(token: Column, key: str) -> Column:
    """A date in its own form: with leading zeros, or without where one part of it has none."""
    forms = {"-": ("yyyy-MM-dd", "yyyy-MM-dd"), "/": ("MM/dd/yyyy", "M/d/yyyy"), ".": ("dd.MM.yyyy", "d.M.yyyy")}
    day, shown = F.lit(None).cast("date"), F.lit(None).cast("string")
    origin = F.lit("1800-01-01").cast("date")
    for mark, (_, form) in forms.items():
        day = F.when(token.contains(mark), F.try_to_timestamp(token, F.lit(form)).cast("date")).otherwise(day)
    index = F.datediff(day, origin)
    pair = feistel(F.floor(index / ERA_B), F.pmod(index, F.lit(ERA_B)), F.lit(ERA_A), F.lit(ERA_B), "date", key)
    moved = F.transform(F.array(pair), lambda p: F.date_add(origin, (p["l"] * ERA_B + p["r"]).cast("int")))[0]
    for mark, (full, short) in forms.items():
        shown = F.when(token.contains(mark), F.when(_padded(token), F.date_format(moved, full)).otherwise(F.date_format(moved, short))).otherwise(shown)
    return F.when((index >= 0) & (index < ERA), shown).when(token.contains("/") & day.isNull(), _day_first(token, key)).otherwise(token)


def _padded(token: Column) -> Column:
    return F.length(token) == 10


def _day_first(token: Column, key: str) -> Column:
    """A date like 25/12/2024, whose day can be no month, becomes another such date: those of 400 years are counted in order,
    and the count is permuted. Twelve days of each month have no such date, so a date's count is its day's number less
    twelve for each month begun; back from a count, the month is within two of a 4,800th of the whole."""
    origin = F.lit("1800-01-01").cast("date")
    d, m, y = (F.split_part(token, F.lit("/"), F.lit(i)).cast("int") for i in (1, 2, 3))
    day = F.try_to_timestamp(token, F.lit("d/M/yyyy")).cast("date")
    count = F.datediff(day, origin) - ((y - 1800) * 12 + m) * 12
    pair = feistel(F.floor(count / LATE_B), F.pmod(count, F.lit(LATE_B)), F.lit(LATE_A), F.lit(LATE_B), "day first", key)
    first = lambda k: F.datediff(F.add_months(origin, k), origin) - k * 12  # noqa: E731  the count of the 13th of the k-th month

    def moved(p: Column) -> Column:
        new = (p["l"] * LATE_B + p["r"]).cast("int")
        near = F.floor(new * 4800 / (LATE_A * LATE_B)).cast("int")
        month = F.array_max(F.filter(F.sequence(near - 2, near + 2), lambda k: (k >= 0) & (k < 4800) & (first(k) <= new)))
        return F.transform(F.array(month), lambda k: F.date_add(F.add_months(origin, k), new - first(k) + 12))[0]

    date = F.transform(F.array(pair), moved)[0]
    shown = F.when(_padded(token), F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "d/M/yyyy"))
    return F.when(day.isNotNull() & (d > 12) & y.between(1800, 2199), shown).otherwise(token)


def _email(token: Column, key: str) -> Column:
    d = _digest(key, F.lit("email"), F.lower(token))
    return F.concat(F.lit("u"), F.substring(d, 1, 16), F.lit("@"), F.lit("d"), F.substring(d, 17, 8), F.lit(".invalid"))


def pseudonym(token: Column, key: str) -> Column:
    """The pseudonym of one finding, or the finding itself where validation fails."""
    digits = F.regexp_replace(token, "[^0-9]", "")
    return F.transform(F.array(digits), lambda d: _by_format(token, d, key))[0]  # a lambda over one item: they are found once


def _by_format(token: Column, digits: Column, key: str) -> Column:
    kept = F.when(token.rlike(r"^\+1[0-9]{10}$"), 0).when(token.rlike(r"^\+") & ~token.rlike(f"^{PHONE}$"), 3).when(token.rlike(f"^{TRUNK}$"), 1).otherwise(0)
    return (
        F.when(token.contains("@"), _email(token, key))
        .when(token.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _ipv4(token, key))
        .when(token.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(token, key))
        .when(token.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})$"), _date(token, key))
        .when(~token.rlike(r"[(+]") & (F.length(digits) >= 13), _card(token, digits, key))
        .when(kept == 3, _numbered(token, digits, key, "abroad", 3))
        .when(kept == 1, _numbered(token, digits, key, "trunk", 1))
        .otherwise(_phone(token, digits, key))
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the pseudonyms in place in ``text``, plus ``n_pii``, the number of values replaced. Who has ``key``
    can undo the pseudonyms, so it has no default.

    A text is taken apart into its findings and the gaps between them and put together again, row by row: no shuffle.
    """
    found, new = fresh(docs, "_found"), fresh(docs, "_new")
    body = F.col(text)
    # Without an @ no e-mail address can match, so its pattern is left out there; the findings are the same.
    by_form = lambda read: F.when(body.contains("@"), read(PATTERN)).otherwise(read(NUMBERS))
    hit = F.when(body.rlike(HINT), by_form(lambda p: F.regexp_extract_all(body, F.lit(p), F.lit(0))))
    some = F.size(F.coalesce(F.col(found), F.array().cast("array<string>"))) > 0
    df = docs.withColumn(found, hit).withColumn(new, F.when(some, F.transform(F.col(found), lambda t: pseudonym(t, key))))
    gaps = by_form(lambda p: F.split(body, p, -1))
    whole = F.array_join(F.zip_with(gaps, F.col(new), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(F.col(found), F.col(new), lambda x, y: x != y), lambda x: x))
    out = [F.when(some, whole).otherwise(body).alias(text) if c == text else F.col(c) for c in docs.columns if c != "n_pii"]
    return df.select(*out, F.when(some, changed).otherwise(0).cast("long").alias("n_pii"))
