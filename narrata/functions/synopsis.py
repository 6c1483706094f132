"""Synopses held against their narratives: what the narrative does not attest is generalised, or the synopsis goes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.grounding import Source, any_flag, grounding_flags, with_source
from narrata.functions.text import content_words, folded, let, overlap, replace_each, rx, search, sentences, strip, text_of, texts, word_count
from narrata.packs import fixed
from narrata.plans.fence import fence

ROLE_GROUP = rf"\b(?:{fixed.ROLE_MODIFIER}\s+){{0,2}}"


def swap(c: Column, pattern: Column | str, new: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(new))


def generalise_roles(c: Column, narrative: Column) -> Column:
    """Roles that the narrative lacks become the reporter; so do roles it names only as somebody else, where the
    synopsis lets them report."""

    def step(c: Column, role: str) -> Column:
        whole, reports = rx(rf"{ROLE_GROUP}{role}\b"), r"(?=[^.]{0,40}\breport)"
        absent = ~narrative.rlike(rx(rf"\b{role}\b"))
        other = narrative.rlike(rx(fixed.THIRD.format(role))) & ~narrative.rlike(rx(fixed.CLAIMED.format(role)))
        # the narrative is searched for the roles that are told only
        told = F.when(absent, swap(c, whole, "reporter")).when(other, swap(c, whole + reports, "reporter")).otherwise(c)
        return F.when(c.rlike(rx(rf"\b{role}\b")), told).otherwise(c)

    # no step writes a role, so those that a text lacks at first it lacks to the end
    named = lambda c, low, role: F.when(low.contains(role.lower()), let(lambda c: step(c, role), c)).otherwise(c)
    steps = lambda c, low: reduce(lambda c, role: let(lambda c: named(c, low, role), c), fixed.ROLES, c)
    every = rx(rf"\b(?:{'|'.join(fixed.ROLES)})\b")
    c = let(lambda c: F.when(c.rlike(every), let(lambda low: steps(c, low), folded(c))).otherwise(c), c)

    def plainer(c: Column) -> Column:
        c = swap(c, rx(r"\breporter (?:pilot|personnel|crew|controller)\b"), "reporter")
        c = swap(c, rx(rf"\b{fixed.ROLE_MODIFIER}\s+(?=reporter\b)"), "")
        return swap(c, rx(r"\breporter reporter\b"), "reporter")

    return let(lambda c: F.when(folded(c).contains("reporter"), plainer(c)).otherwise(c), c)


def generalise_types(c: Column, narrative: Column) -> Column:
    """Aircraft codes and names that the narrative lacks become "aircraft"."""

    def seen(m: Column) -> Column:
        return F.when(F.regexp_like(narrative, F.concat(F.lit(r"(?iU)\b\Q"), m, F.lit(r"\E\b"))), m).otherwise(F.lit("aircraft"))

    # each step names its text thrice; unbound, the one before it would be evaluated as often
    return reduce(lambda text, pattern: let(lambda c: replace_each(c, rx(pattern, cased=True), seen), text), (fixed.AIRCRAFT_TYPE, fixed.AIRCRAFT_NAME), c)


#: Qualifiers made of others are looked at when those are gone; the rest do not overlap, so each pass reads a text once.
_EVERY = fixed.QUALIFIERS.split("|")
_COMPOUND = {q for q in _EVERY if " " in q and {w.lower() for w in q.split(" ")} & {x.lower() for x in _EVERY}}
QUALIFIER_PASSES = tuple("|".join(q for q in _EVERY if (q in _COMPOUND) == compound) for compound in (False, True))


def drop_qualifiers(c: Column, narrative: Column) -> Column:
    """Qualifiers that the narrative lacks go where they stand before an aircraft or its crew.

    What the narrative attests is looked up for each match in a list of its qualifiers, which one search finds."""
    before = rf"(?=(?:\s+(?:{fixed.QUALIFIERS}))*\s+(?:{fixed.QUALIFIED})\b)"
    plain = lambda m: F.translate(folded(m), "-", " ")

    def dropped(c: Column, some: str) -> Column:
        held = F.transform(F.regexp_extract_all(narrative, F.lit(rx(rf"\b(?:{some})\b")), F.lit(0)), plain)
        return let(lambda c, held: replace_each(c, rx(rf"\b(?:{some}){before}"), lambda m: F.when(F.array_contains(held, plain(m)), m).otherwise("")), c, held)

    # one search tells the texts, nearly all, that no word is to be dropped from
    return let(lambda c: F.when(c.rlike(rx(rf"\b(?:{fixed.QUALIFIERS}){before}")), reduce(dropped, QUALIFIER_PASSES, c)).otherwise(c), c)


#: What every pattern of the last steps needs.
TIDIED = "aircraft"


def tidy(c: Column) -> Column:
    steps = lambda c: reduce(lambda text, step: swap(text, rx(step[0]), step[1]), fixed.TIDY, c)
    spaced = let(lambda c: strip(F.when(c.contains("  "), swap(c, " +", " ")).otherwise(c)), c)
    return let(lambda c: F.when(folded(c).contains(TIDIED), steps(c)).otherwise(c), spaced)


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def cause_ok(s: Column, words: Column, source_words: Column, hedged: Column, hedged_only: Column) -> Column:
    """A stated cause has 0.6 of its words in the narrative, and does not rest on what the narrative only guesses."""

    def holds(cause: Column) -> Column:
        attested = (F.size(cause) == 0) | (overlap(cause, source_words) >= 0.6)
        terms = F.when(F.size(cause) > 0, cause).when(s.rlike(rx(fixed.CAUSE_VERB)), words).otherwise(texts([]))
        guessed = (F.size(hedged) > 0) & ((F.size(F.array_intersect(terms, hedged)) >= 2) | F.arrays_overlap(words, hedged_only))
        return attested & ~guessed

    return let(holds, content_words(F.regexp_extract(s, rx(rf"(?s){fixed.CAUSAL}(.*)\z"), 1)))


def supported_synopsis(df: DataFrame, synopsis: str, narrative: str, out: str = "supported", prefix: str = "source", given: str | None = None) -> DataFrame:
    """``df`` with ``out``: the first two sentences of the synopsis, in general terms, that the narrative supports.

    Empty where the narrator is unsure, where the first sentence lacks support, or where there is none. The columns
    of ``Source`` for the narrative are added under ``prefix`` and stay for later use, numbers and tokens as null. So do its content words and,
    where it guesses, its sentences, as ``words`` and ``parts``; both are null where nothing is left to be held against them, which is told first.
    given: a column of results that are known; where it is not null nothing is computed again.
    """
    text, told = text_of(F.col(narrative)), text_of(F.col(synopsis))
    if given:
        told = F.when(F.col(given).isNull(), told).otherwise("")
    df = with_source(df, narrative, prefix, ("events", "designators"))
    source, parts = Source.named(prefix), F.col(f"{prefix}_parts")
    high = reduce(Column.__or__, (F.lower(told).contains(p) & ~F.lower(text).contains(p) for p in fixed.AIRPORT_PHRASES))
    df = fence(df.withColumn("__live", (told != "") & ~search(source.low, fixed.UNSURE) & ~high), "__live")
    live = lambda c: F.when(F.col("__live"), c)
    # narratives that guess nowhere, nearly all, are not searched sentence by sentence
    df = df.withColumns({f"{prefix}_words": live(content_words(text)), f"{prefix}_parts": F.when(F.col("__live") & search(source.low, fixed.HEDGE), sentences(text))})
    df = fence(df.withColumn("__told", live(generalise_types(generalise_roles(told, text), text))), f"{prefix}_words", f"{prefix}_parts", "__told")
    told_words = lambda kept: F.array_distinct(F.flatten(F.transform(kept, content_words)))
    guesses = lambda keep: F.filter(parts, lambda s: s.rlike(rx(fixed.HEDGE)) == F.lit(keep))
    whole_event = rx(f"^(?:{fixed.EVENT_WORDS})$")
    none = F.struct(texts([]).alias("all"), texts([]).alias("only"))
    split = lambda a, b: F.struct(a.alias("all"), F.filter(F.array_except(a, b), lambda w: w.rlike(whole_event)).alias("only"))
    df = df.withColumn("__hedged", F.when(parts.isNotNull(), let(split, told_words(guesses(True)), told_words(guesses(False)))).otherwise(none))
    df = fence(df.withColumn("__claims", live(sentences(tidy(drop_qualifiers(F.col("__told"), text))))), "__hedged", "__claims")

    def holds(s: Column) -> Column:
        def attested(words: Column) -> Column:
            near = overlap(words, F.col(f"{prefix}_words")) >= 0.5
            return near & cause_ok(s, words, F.col(f"{prefix}_words"), F.col("__hedged.all"), F.col("__hedged.only"))

        event = s.rlike(rx(fixed.EVENT_WORDS)) & ~s.rlike(rx(fixed.HYPOTHETICAL)) & ~s.endswith("?") & (word_count(s) <= 65)
        return F.when(event & let(attested, content_words(s)), ~any_flag(grounding_flags(source, s))).otherwise(F.lit(False))

    def step(state: Column, s: Column) -> Column:
        kept = state["kept"]
        # it is over with the first sentence where that does not hold, else with the second that does
        told = lambda ok: F.struct(F.when(ok, F.array_append(kept, capitalised(s))).otherwise(kept).alias("kept"), (ok == (F.size(kept) == 1)).alias("over"))
        after = lambda ok: F.when(ok | (F.size(kept) == 0), told(ok)).otherwise(state)
        return F.when(state["over"], state).otherwise(let(after, F.coalesce(holds(s), F.lit(False))))

    found = F.aggregate(F.coalesce("__claims", texts([])), F.struct(texts([]).alias("kept"), F.lit(False).alias("over")), step, lambda state: state["kept"])
    df = df.withColumn(out, F.coalesce(F.col(given), found) if given else found)
    return fence(df.drop("__live", "__hedged", "__told", "__claims"), out)
