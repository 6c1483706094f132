"""Specifics of an output that its source text does not have."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.patterns import any_of
from narrata.functions.text import acronyms, designators, folded, let, number_tokens, plain_number, rx_low, search, text_of, texts, upper_tokens
from narrata.packs import fixed
from narrata.plans.fence import fence


@dataclass(frozen=True)
class Source:
    """What outputs are held against, computed once per source text."""

    text: Column
    low: Column
    numbers: Column
    tokens: Column

    @classmethod
    def of(cls, c: Column) -> Source:
        return cls(text_of(c), folded(text_of(c)), F.transform(number_tokens(c), plain_number), upper_tokens(c))

    def columns(self, prefix: str) -> dict[str, Column]:
        """The parts as named columns, for ``DataFrame.withColumns``; ``named`` finds them again."""
        return {f"{prefix}_{k}": v for k, v in self.__dict__.items()}

    @classmethod
    def named(cls, prefix: str) -> Source:
        return cls(*(F.col(f"{prefix}_{k}") for k in cls.__dataclass_fields__))


#: The part of a source that each kind of flag is held against.
PART_OF = {"numbers": "numbers", "acronyms": "tokens", "events": "low", "designators": "text"}


def with_source(df: DataFrame, narrative: str, prefix: str = "source", kinds: Iterable[str] = tuple(PART_OF)) -> DataFrame:
    """``df`` with the columns of ``Source.named(prefix)``, evaluated once per row; those that no flag of ``kinds`` needs
    are null. Numbers and tokens that are null are read from the text, if it is there, by outputs that have such things."""
    columns = Source.of(F.col(narrative)).columns(prefix)
    read = {f"{prefix}_{PART_OF[kind]}" for kind in kinds}
    blank = {name: F.lit(None).cast("array<string>" if name.endswith(("_numbers", "_tokens")) else "string") for name in columns if name not in read}
    df = df.withColumns({name: c for name, c in columns.items() if name in read})
    return fence(df, *(name for name in columns if name in read)).withColumns(blank)


def heads_of(claim: str) -> list[str]:
    """The literals, lower-cased, with one of which each match of a claim begins, at the beginning of a word."""
    heads = []
    for part in claim.split(r"|\b"):
        found = re.match(r"(?:\\b)?([A-Za-z]+)", part)
        if not found or part.startswith("("):
            raise ValueError(f"A claim must begin with a word: {claim}")
        heads.append(found[1].lower())
    return heads


HEADS = {name: heads_of(claim) for name, claim, _ in fixed.EVENT_CLASSES}
#: The longest first, so that a match is the longest head that fits; no head begins with another.
EVERY_HEAD = tuple(sorted({h for heads in HEADS.values() for h in heads}, key=lambda h: (-len(h), h)))
ANY_HEAD = rx_low(rf"\b(?:{'|'.join(EVERY_HEAD)})")


def claim_heads(low: Column) -> Column:
    """The distinct heads of claims that stand in ``folded`` text, found by one search."""
    return F.array_distinct(F.when(low.rlike(any_of(EVERY_HEAD)), F.regexp_extract_all(low, F.lit(ANY_HEAD), F.lit(0))).otherwise(texts([])))


def unsupported_classes(source: Source, output: Column) -> Column:
    """Event classes that an output claims and its source has no evidence for, in the order of the pack.

    A class is looked for only where one of its heads stands, and the source is searched only for what is claimed.
    """

    def found(heads: Column, low: Column) -> Column:
        stands = lambda name: reduce(Column.__or__, (F.array_contains(heads, h) for h in HEADS[name]))
        classes = (F.when(stands(name) & low.rlike(rx_low(claim)) & ~search(source.low, evidence), name) for name, claim, evidence in fixed.EVENT_CLASSES)
        return F.when(F.size(heads) > 0, F.array_compact(F.array(*classes))).otherwise(texts([]))

    return let(lambda low: let(lambda heads: found(heads, low), claim_heads(low)), folded(text_of(output)))


def grounding_flags(source: Source, output: Column) -> Column:
    """A struct of four lists: numbers, acronyms, event classes and designators of ``output`` that lack support.

    Numbers compare without their commas and semicolons and are reported as written; lists other than ``events``
    are sorted. The class name ATC needs no support.
    """
    text = lambda c: F.when(source.text.isNotNull(), c)
    own_numbers = F.coalesce(source.numbers, text(F.transform(number_tokens(source.text), plain_number)))
    own_tokens = F.coalesce(source.tokens, text(upper_tokens(source.text)))
    # the source is read only where an output has something to hold against it
    if_any = lambda found, held: let(lambda found: F.when(F.size(found) > 0, held(found)).otherwise(found), found)
    numbers = F.array_sort(if_any(number_tokens(output), lambda found: let(lambda own: F.filter(found, lambda n: ~F.array_contains(own, plain_number(n))), own_numbers)))
    names = F.array_sort(if_any(acronyms(output), lambda found: F.array_except(found, own_tokens)))
    events = unsupported_classes(source, output)
    absent = lambda d: ~F.contains(source.text, d["token"]) | ~F.regexp_like(source.text, F.concat(F.lit("(?<![A-Za-z0-9])"), d["token"], F.lit("(?![A-Za-z0-9])")))
    places = F.array_sort(F.transform(F.filter(designators(output), absent), lambda d: F.concat_ws(" ", d["name"], d["token"])))
    return F.struct(numbers.alias("numbers"), names.alias("acronyms"), events.alias("events"), places.alias("designators"))


def any_flag(flags: Column) -> Column:
    return sum((F.size(flags[k]) for k in ("acronyms", "events", "designators")), F.size(flags["numbers"])) > 0


def no_flags() -> Column:
    return F.struct(*(texts([]).alias(k) for k in ("numbers", "acronyms", "events", "designators")))
