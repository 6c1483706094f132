"""Format-preserving pseudonyms for personal data, with DataFrame operations only.

What looks like personal data is first validated (Luhn digits of cards, octets of addresses, real calendar dates,
assignable numbers) and then permuted within its own format by a keyed Feistel network. A number is two numbers that
in turn are shifted by a keyed SHA-256 of the other, each modulo the size of its range; a text is two halves whose
characters in turn are shifted, each within the alphabet of its place, by a keyed SHA-256 stream as long as the half,
drawn from the other. Both are bijections, for ranges of any size and texts of any length. Every class of values (a
form of dates, numbers inside and outside of a plan, hexadecimal and other secrets) is mapped onto itself: pseudonyms
look and validate like the originals, equal values get equal pseudonyms in all documents, and different values never
meet. All of it is row-local: no shuffle, no state.
"""

from __future__ import annotations

from datetime import date as day
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Kinds and their patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?i:password|passwd|pwd|secret|token|api_?key)[\"']? ?[=:] ?[\"']?[A-Za-z0-9]{6,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])",
}
#: Only dates have groups, so their numbers hold in the whole, too.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
HEX_LETTERS, OTHER_LETTERS = LETTERS[:6], LETTERS[6:]
FIRST_YEAR, YEARS = 1900, 200
#: 29 February from 1904 to 2096, every four years: 7 times 7 days.
FIRST_LEAP, LEAPS = 1904, 7


def let(use, *values: Column) -> Column:
    """``use(*values)`` with each value written, and evaluated, once: the plan stays small."""
    if len(values) == 1:
        return F.transform(F.array(values[0]), use)[0]
    names = [f"v{i}" for i in range(len(values))]
    return F.transform(F.array(F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))), lambda s: use(*(s[n] for n in names)))[0]


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: str | Column) -> Column:
    """A keyed permutation of pairs of left in [0, a) and right in [0, b): a struct l, r of longs."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def shift(i: Column, other: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, a, b, i, other), 256)
        return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long") % size

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, (s["l"] + shift(i, s["r"], a)) % a).otherwise(s["l"])
        right = F.when(i % 2 == 1, (s["r"] + shift(i, s["l"], b)) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def characters(s: Column) -> Column:
    """The characters of a text that is not empty."""
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)))


def permute_text(s: Column, alphabets: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the texts of any length that have at each place a character of that place's alphabet.

    alphabets: an array of strings, one for each character of ``s``; what they are must not depend on more of ``s`` than
    the permutation keeps. A place whose alphabet is one character keeps it.
    """

    def permuted(s: Column, alphabets: Column, n: Column) -> Column:
        places = F.zip_with(characters(s), alphabets, lambda c, a: F.struct((F.position(c, a) - 1).alias("x"), F.length(a).alias("m")))
        half = F.floor(n / 2).cast("int")
        halves = let(lambda p: F.struct(F.slice(p, F.lit(1), n - half).alias("l"), F.slice(p, n - half + 1, half).alias("r")), places)

        def stream(i: Column, other: Column, long: Column) -> Column:
            said = F.array_join(F.transform(other, lambda p: p["x"].cast("string")), ",")
            return let(
                lambda said: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(long / 16).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(f"{key}|{tweak}"), n, i, b, said), 256)), ""), said
            )

        def shifted(part: Column, i: Column, other: Column) -> Column:
            # four hexadecimal digits of the stream for each place
            move = lambda h, p, j: (p["x"] + F.conv(F.substr(h, 4 * j + 1, F.lit(4)), 16, 10).cast("int")) % p["m"]
            return let(lambda h: F.transform(part, lambda p, j: F.struct(move(h, p, j).alias("x"), p["m"].alias("m"))), stream(i, other, F.size(part)))

        # a turn moves the left half by the right one and then changes them over; an even number of turns leaves them in place
        turn = lambda s, i: F.struct(s["r"].alias("l"), shifted(s["l"], i, s["r"]).alias("r"))
        turned = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: F.concat(s["l"], s["r"]))
        return F.array_join(F.zip_with(turned, alphabets, lambda p, a: F.substr(a, p["x"] + 1, F.lit(1))), "")

    return let(permuted, s, alphabets, F.size(alphabets))


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    return let(lambda d: permute_text(d, F.transform(characters(d), lambda _: F.lit(DIGITS)), key, tweak), digits)


def in_case_of(new: Column, old: Column) -> Column:
    """``new`` with capitals where ``old``, of the same length, has them."""
    return F.array_join(F.zip_with(characters(new), characters(old), lambda c, o: F.when(o.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")


def fill(shape: Column, chars: Column) -> Column:
    """``shape`` with its digits replaced one by one by the characters of ``chars``."""
    pieces = F.split(shape, "[0-9]")
    return F.array_join(F.zip_with(pieces, F.concat(characters(chars), F.array(F.lit(""))), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counted once."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct((F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)) * (1 + i % 2)).alias("x"))),
        F.lit(0), lambda s, d: s + F.floor(d["x"] / 10).cast("int") + d["x"] % 10,
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, the last makes the Luhn sum right; numbers that fail it stay."""

    def made(d: Column) -> Column:
        body = permute_digits(F.left(d, F.length(d) - 1), key, "card")
        whole = let(lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")), body)
        return F.when(luhn_sum(d) % 10 == 0, fill(m, whole)).otherwise(m)

    return let(made, _digits(m))


def phone(m: Column, key: str) -> Column:
    """A country code stays. Ten digits of the North American plan (area and exchange from 200 on) are permuted among
    themselves, and so are ten digits outside of it, and the numbers of each other length."""

    def north(d: Column, area: Column, exchange: Column, inside: Column) -> Column:
        # outside: areas below 200 with any exchange, then the other areas with exchanges below 200
        nth = F.when(inside, (area - 200) * 800 + exchange - 200).when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        pair = let(lambda size: feistel(nth, F.right(d, F.lit(4)).cast("int"), size, F.lit(10_000), key, "phone"), F.when(inside, 640_000).otherwise(360_000))

        def written(x: Column, last: Column) -> Column:
            area = F.when(inside, F.floor(x / 800) + 200).when(x < 200_000, F.floor(x / 1000)).otherwise(F.floor((x - 200_000) / 200) + 200)
            exchange = F.when(inside, x % 800 + 200).when(x < 200_000, x % 1000).otherwise((x - 200_000) % 200)
            return F.concat(*(F.lpad(c.cast("string"), n, "0") for c, n in ((area, 3), (exchange, 3), (last, 4))))

        return let(lambda p: written(p["l"], p["r"]), pair)

    def made(code: Column, rest: Column, d: Column) -> Column:
        area, exchange = F.left(d, F.lit(3)).cast("int"), F.substr(d, F.lit(4), F.lit(3)).cast("int")
        ten = let(lambda a, e: north(d, a, e, (a >= 200) & (e >= 200)), area, exchange)
        return F.concat(code, fill(rest, F.when(F.length(d) == 10, ten).otherwise(permute_digits(d, key, "phone"))))

    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .-]?)", 1)
    return let(lambda code: let(lambda rest: made(code, rest, _digits(rest)), F.substr(m, F.length(code) + 1)), code)


def ip(m: Column, key: str) -> Column:
    """All of IPv4 is one format; what has an octet above 255 or with a leading zero stays."""

    def made(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536), key, "ip")
        parts = let(lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256), pair)
        return F.when((F.array_max(o) <= 255) & ~m.rlike(r"(?:^|\.)0[0-9]"), parts).otherwise(m)

    return let(made, F.transform(F.split(m, r"\."), lambda x: x.cast("int")))


def ssn(m: Column, key: str) -> Column:
    """Assignable numbers (area 001-899 but 666, group and serial not zero) are permuted among themselves."""

    def made(area: Column, group: Column, serial: Column) -> Column:
        good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        nth = area - F.when(area > 666, 2).otherwise(1)
        pair = feistel(nth * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9_999), key, "ssn")
        return F.when(good, let(lambda p: written(F.floor(p["l"] / 99), p["l"] % 99 + 1, p["r"] + 1), pair)).otherwise(m)

    def written(nth: Column, group: Column, serial: Column) -> Column:
        area = nth + F.when(nth > 664, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))

    part = lambda i: F.get(F.split(m, "-"), F.lit(i)).cast("int")
    return let(made, part(0), part(1), part(2))


def date_form(a: str, b: str, year_first: bool) -> str:
    """The form of a date by its two short parts as written: which readings they allow, and how they are padded.

    Padding: both of two digits; none padded and one short; or one short beside a padded one, the first or the second.
    """
    reading = "ymd" if year_first else "both" if max(int(a), int(b)) <= 12 else "dmy" if int(a) > 12 else "mdy"
    padding = "2" if len(a) == len(b) == 2 else "0a" if a[0] == "0" else "0b" if b[0] == "0" else "1"
    return f"{reading}-{padding}"


def date_forms() -> dict[str, list[str]]:
    """The pairs of short parts of each form that are a day of every year, as ``a~b``, sorted."""
    forms: dict[str, set[str]] = {}
    for k in range(365):
        d = day(2001, 1, 1) + timedelta(k)
        for x in {str(d.month), f"{d.month:02d}"}:
            for y in {str(d.day), f"{d.day:02d}"}:
                for a, b, year_first in ((x, y, True), (x, y, False), (y, x, False)):
                    forms.setdefault(date_form(a, b, year_first), set()).add(f"{a}~{b}")
    return {k: sorted(v) for k, v in sorted(forms.items())}


def date(m: Column, key: str) -> Column:
    """Real dates from 1900 to 2099 are permuted among the dates written in the same form: order of parts, readings
    that are possible (day first, month first, either), separator and padding stay. Leap days are a form of their own."""
    lists = F.create_map(*(c for k, v in date_forms().items() for c in (F.lit(k), F.split(F.lit(",".join(v)), ","))))

    def written(first: Column, sep: Column, year: Column, short: Column) -> Column:
        y = F.lpad(year.cast("string"), 4, "0")
        return F.replace(F.concat_ws("~", F.when(first, y), short, F.when(~first, y)), F.lit("~"), sep)

    def made(first: Column, sep: Column, year: Column, a: Column, b: Column) -> Column:
        ia, ib = a.cast("int"), b.cast("int")
        reading = F.when(first, "ymd").when(F.greatest(ia, ib) <= 12, "both").when(ia > 12, "dmy").otherwise("mdy")
        padding = F.when(F.length(a) + F.length(b) == 4, "2").when(a.startswith("0"), "0a").when(b.startswith("0"), "0b").otherwise("1")
        leap_day = ((ia == 2) & (ib == 29)) | (~first & (ia == 29) & (ib == 2))
        leap = leap_day & (year % 4 == 0) & year.between(FIRST_LEAP, FIRST_LEAP + 4 * LEAPS * LEAPS - 1)
        nth = F.floor((year - FIRST_LEAP) / 4)
        leaps = let(lambda q: written(first, sep, FIRST_LEAP + 4 * (q["l"] * LEAPS + q["r"]), F.concat_ws("~", a, b)), feistel(F.floor(nth / LEAPS), nth % LEAPS, F.lit(LEAPS), F.lit(LEAPS), key, "leap"))

        def moved(form: Column, days: Column, at: Column, size: Column) -> Column:
            pair = feistel(year - FIRST_YEAR, at - 1, F.lit(YEARS), size, key, F.concat(F.lit("date-"), form))
            new = let(lambda q: written(first, sep, q["l"] + FIRST_YEAR, F.get(days, q["r"].cast("int"))), pair)
            return F.when((at > 0) & year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), new).otherwise(m)

        placed = lambda form, days: let(moved, form, days, F.array_position(days, F.concat_ws("~", a, b)), F.size(days))
        found = lambda form: let(lambda days: placed(form, days), F.coalesce(F.try_element_at(lists, form), F.array().cast("array<string>")))
        return F.when(leap, leaps).otherwise(let(found, F.concat_ws("-", reading, padding)))

    def split(p: Column, first: Column) -> Column:
        year = F.when(first, p[0]).otherwise(p[2]).cast("int")
        return let(lambda *v: made(first, *v), F.regexp_extract(m, "([-/.])", 1), year, F.when(first, p[1]).otherwise(p[0]), F.when(first, p[2]).otherwise(p[1]))

    return let(lambda p: let(split, p, F.length(p[0]) == 4), F.split(m, "[-/.]"))


def email(m: Column, key: str) -> Column:
    """Letters and digits before the @ are permuted, each among its own kind, in any case alike; capitals, all other
    characters and the domain stay."""

    def made(local: Column, low: Column) -> Column:
        alphabets = F.transform(characters(low), lambda c: F.when(c.rlike("[a-z]"), LETTERS).when(c.rlike("[0-9]"), DIGITS).otherwise(c))
        return let(lambda new: in_case_of(new, local), permute_text(low, alphabets, key, "email"))

    local = F.substring_index(m, "@", 1)
    return F.concat(let(made, local, F.translate(local, LETTERS.upper(), LETTERS)), F.lit("@"), F.substring_index(m, "@", -1))


def secret(m: Column, key: str) -> Column:
    """The value after ``=`` or ``:`` is permuted; the name, quotes and blanks stay.

    Digits stay digits. Hexadecimal values whose letters are of one case stay such: digits up to the first letter, a
    letter there, any of the sixteen from there on. In other values digits stay digits and letters letters of their
    case: up to f before the first one beyond f, beyond f there, any from there on, so that none becomes hexadecimal.
    """
    name = F.regexp_extract(m, "^([A-Za-z_]+[\"']? ?[=:] ?[\"']?)", 1)

    def made(value: Column, low: Column, hexadecimal: Column) -> Column:
        begin = F.when(hexadecimal, F.length(F.regexp_extract(low, "^[0-9]*", 0))).otherwise(F.length(F.regexp_extract(low, "^[0-9a-f]*", 0)))

        def alphabet(c: Column, j: Column, begin: Column) -> Column:
            either = F.when(j < begin, DIGITS).when(j == begin, HEX_LETTERS).otherwise(DIGITS + HEX_LETTERS)
            return F.when(hexadecimal, either).when(c.rlike("[0-9]"), DIGITS).when(j < begin, HEX_LETTERS).when(j == begin, OTHER_LETTERS).otherwise(LETTERS)

        new = permute_text(low, let(lambda begin: F.transform(characters(low), lambda c, j: alphabet(c, j, begin)), begin), key, "secret")
        return let(lambda new: F.when(hexadecimal & (value != low), F.upper(new)).when(hexadecimal, new).otherwise(in_case_of(new, value)), new)

    split = lambda name: F.concat(name, let(lambda v: let(made, v, F.lower(v), v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), F.substr(m, F.length(name) + 1)))
    return let(split, name)


def access_key(m: Column, key: str) -> Column:
    new = lambda rest: permute_text(rest, F.transform(characters(rest), lambda _: F.lit(LETTERS.upper() + DIGITS)), key, "key")
    return F.concat(F.left(m, F.lit(4)), let(new, F.substr(m, F.lit(5))))


MAKERS = {"email": email, "secret": secret, "key": access_key, "ip": ip, "ssn": ssn, "date": date, "card": card, "phone": phone}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, by the first kind whose whole pattern it is."""
    kinds = [(m.rlike(f"^(?:{PATTERNS[k]})$"), make(m, key)) for k, make in MAKERS.items()]
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(kinds), m)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the texts replaced, and ``n_pii``, how many values were.

    Values that fail their validation stay and do not count. Null texts stay null and empty ones empty, with no values;
    texts of any length are read whole; texts without personal data stay as they are. All columns stay, but one named
    ``n_pii`` is replaced. Rows are treated one by one, so repeats and order matter not; an empty table gives no rows.
    ``key`` is the secret that links pseudonyms; another key gives others.
    """
    text = F.col(f"`{text_col}`")
    hit = F.coalesce(text.rlike("[0-9@=:]|A[KS]IA") & text.rlike(ANY), F.lit(False))
    found = F.when(hit, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("__found", found)
    out = out.withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", lambda m: pseudonym(m, key))).otherwise(F.array().cast("array<string>")))
    joined = F.array_join(F.zip_with(F.split(text, ANY), F.concat("__new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    n = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x)).cast("long")
    return out.withColumn("__text", F.when(F.size("__found") > 0, joined).otherwise(text)).select(
        *(F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_pii"), n.alias("n_pii")
    )
