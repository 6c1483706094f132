"""Text functions over columns: sentences, words, tokens, matches in context, truncation.

All are built-in expressions; none shuffles. Patterns match as Unicode-aware engines do: word characters, digits and
white space of any script. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions.patterns import by_letter, lowered, needed
from narrata.packs import fixed

#: White space of any script, with the separators U+001C to U+001F.
WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
#: Code points that are no characters and stand in no text; were the first in one, it would become the second.
MARK, OTHER = "\ufdd0", "\ufdd1"


def rx(pattern: str, cased: bool = False) -> str:
    """``pattern`` with Unicode classes, and any case unless ``cased``; long alternations go by their first letters."""
    return "(?U)" + by_letter(pattern, True) if cased else "(?iU)" + by_letter(pattern)


def rx_low(pattern: str) -> str:
    """``rx(pattern)`` for texts that are ``folded``, where letters are compared as they are."""
    return "(?U)" + by_letter(lowered(pattern))


def tells(low: Column, pattern: str) -> Column:
    """Whether ``folded`` text has one of the plain texts that each match of ``pattern`` needs."""
    return reduce(Column.__or__, map(low.contains, needed(pattern)), F.lit(not needed(pattern)))


def search(low: Column, pattern: str) -> Column:
    """Whether ``pattern``, of any case, is found in ``folded`` text; searched for only where ``tells`` lets it be."""
    return tells(low, pattern) & low.rlike(rx_low(pattern))


def let(use: Callable[..., Column], *values: Column) -> Column:
    """``use(*values)`` with each value written, and evaluated, once."""
    if len(values) == 1:
        return F.transform(F.array(values[0]), use)[0]
    names = [f"v{i}" for i in range(len(values))]
    return F.transform(F.array(F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))), lambda s: use(*(s[n] for n in names)))[0]


def folded(c: Column) -> Column:
    """``c`` in lower case, with the four letters that patterns of any case take for plain ones as those."""
    plain = F.octet_length(c) == F.length(c)
    return F.lower(F.when(plain, c).otherwise(F.translate(c, "\u017f\u0131\u0130\u212a", "siik")))


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """``c`` without white space at its ends; null: empty."""
    return F.btrim(text_of(c), F.lit(WS_CHARS))


def texts(values) -> Column:
    """An array of strings."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def sentences(c: Column) -> Column:
    """Sentences of a text, in order.

    A full stop glued to a capital letter ends a sentence, except between capitals. Lines end sentences. The
    letter after a sentence may have either case; what follows one of the known abbreviations stays with it.
    """
    guards = "".join(rf"(?<!\b{a.replace('.', chr(92) + '.')}{WS})" for a in fixed.ABBREVIATIONS)
    spaced = F.regexp_replace(text_of(c), r"\.(?<=[a-z0-9%)]\.)(?=[A-Z])", ". ")
    # the white space comes first, so that most places are held against one class
    broken = F.regexp_replace(spaced, rf"""(?iu){WS}(?<=[.!?]{WS}){guards}{WS}*+(?=[A-Z\["'])""", "\n")
    return F.filter(F.transform(F.split(broken, "\n"), strip), lambda s: s != "")


def word_count(c: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(text_of(c), F.lit(f"(?:[!-~]++|{NOT_WS})++"))


def content_words(c: Column) -> Column:
    """Distinct runs of three or more letters a to z, lower-cased, without stop words; in order of appearance."""
    return F.array_except(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z]{3,}"), F.lit(0)), texts(fixed.STOP_WORDS))


def overlap(a: Column, b: Column) -> Column:
    """Share of the members of ``a`` that ``b`` has; 0 for an empty ``a``."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))


def first_of(values: Column, take: Callable[[Column], Column]) -> Column:
    """The first result of ``take``, a string, that is not null, over an array in its order; what stands behind it is not looked at."""
    return F.aggregate(values, F.lit(None).cast("string"), lambda got, x: F.when(got.isNotNull(), got).otherwise(take(x)))


def matches(c: Column, pattern: str) -> Column:
    """The distinct matches of ``pattern``, with Unicode classes. Texts of ASCII have the same without their tables, faster."""
    every = lambda c, flags: F.regexp_extract_all(c, F.lit(flags + pattern), F.lit(0))
    return F.array_distinct(let(lambda c: F.when(F.octet_length(c) == F.length(c), every(c, "")).otherwise(every(c, "(?U)")), c))


def number_tokens(c: Column) -> Column:
    """Distinct numbers, with their inner ``. , ;``, that no letter or underscore touches."""
    return matches(text_of(c), r"(?=\d)(?<!\w)\d+(?:[.,;]\d+)*(?!\w)")


def plain_number(c: Column) -> Column:
    return F.translate(c, ",;", "")


def acronyms(c: Column) -> Column:
    """Distinct capitals followed by capitals, digits or hyphens; the class name ATC doesn't count."""
    return F.array_except(matches(text_of(c), r"(?=[A-Z])\b[A-Z][A-Z0-9-]{1,}\b"), texts(["ATC"]))


def upper_tokens(c: Column) -> Column:
    """Distinct tokens of capitals, digits and hyphens of the upper-cased text."""
    return matches(F.upper(text_of(c)), r"\b[A-Z0-9-]+\b")


def designators(c: Column) -> Column:
    """Named places like ``Gate B7``: distinct structs of name and token."""
    found = F.regexp_extract_all(text_of(c), F.lit("(?=[A-Z])" + rx(fixed.DESIGNATOR, cased=True)), F.lit(0))
    pair = lambda m: F.struct(F.regexp_extract(m, rx(fixed.DESIGNATOR, cased=True), 1).alias("name"), F.regexp_extract(m, rx(fixed.DESIGNATOR, cased=True), 2).alias("token"))
    return F.array_distinct(F.transform(found, pair))


def normal_hash(c: Column) -> Column:
    """SHA-256 of the lower-cased text, its words joined by one space. Texts whose white space is single spaces are taken as they are."""
    joined = lambda c: F.when(c.contains("  ") | c.rlike(WS.replace(r"\x20", r"\x1F")), F.regexp_replace(c, f"{WS}+", " ")).otherwise(c)
    return F.sha2(let(joined, strip(F.lower(text_of(c)))), 256)


def marked(c: Column, pattern: str) -> Column:
    """The text between matches of ``pattern`` and the matches, in turn, as an array.

    Splitting at one plain character needs no pattern; Spark compiles the pattern of ``split`` anew for each value.
    """
    return F.split(F.regexp_replace(F.translate(c, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)


def any_match(c: Column, pattern: str, test: Callable[[Column, Column], Column]) -> Column:
    """Whether some match of ``pattern`` in ``c`` passes ``test(before, after)``, the texts on its two sides.

    The text between matches and the matches add up to the whole, so one pass that sums their lengths has the place
    of each match.
    """

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.length(x)
        passes = F.when(state["match"] & ~state["ok"], test(F.substring(c, F.lit(1), state["at"]), F.substring(c, end + 1, F.length(c)))).otherwise(state["ok"])
        return F.struct(end.alias("at"), (~state["match"]).alias("match"), passes.alias("ok"))

    seen = F.aggregate(marked(c, pattern), F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.lit(False).alias("ok")), step, lambda s: s["ok"])
    return F.when(F.regexp_like(c, F.lit(pattern)), seen).otherwise(F.lit(False))


def replace_each(c: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``c`` with each match of ``pattern`` replaced by ``new(match)``."""
    joined = F.array_join(F.transform(marked(c, pattern), lambda x, i: F.when(i % 2 == 1, new(x)).otherwise(x)), "")
    return F.when(F.regexp_like(c, F.lit(pattern)), joined).otherwise(c)


def truncate(c: Column, cap: int) -> Column:
    """A struct of the text within ``cap`` code points and whether it was cut.

    Two thirds of the room go to the head, cut back to its last full stop, the rest to the tail, which starts after
    its first full stop; a marker stands between them. ``cap`` must leave room for the marker.
    """
    room = cap - len(fixed.OMITTED)
    if room < 3:
        raise ValueError(f"cap must be over {len(fixed.OMITTED) + 2}")
    text, first = text_of(c), room * 2 // 3
    head = F.regexp_replace(F.left(text, F.lit(first)), r"(?s)\A(.*)\. .*\z", "$1.")
    tail = F.regexp_replace(F.right(text, F.lit(room - first)), r"(?s)\A.*?\. ", "")
    cut = F.length(text) > cap
    return F.struct(F.when(cut, F.concat(head, F.lit(fixed.OMITTED), tail)).otherwise(text).alias("text"), cut.alias("truncated"))
