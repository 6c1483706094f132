"""Rules that read evidence out of a narrative: outcome, near miss, lesson, contributors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions.codes import split_codes
from narrata.functions.patterns import any_of, needed
from narrata.functions.text import WS, any_match, first_of, folded, let, rx, rx_low, search, tells, text_of, texts, word_count
from narrata.packs import fixed

LEFT, RIGHT = 70, 45


def unnegated(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` has a match that its own clause, within 70 characters before it, does not negate.

    For completed events, a clause that places the event after a recovery does, too, as does being told right after
    that it was avoided.
    """

    def counts(before: Column, after: Column) -> Column:
        clause = F.regexp_replace(F.right(before, F.lit(LEFT)), r"(?sU)\A.*(?:[;,]|\bbut\b|\bafter\b)", "")
        ok = ~clause.rlike(rx_low(fixed.NEGATION))
        if pattern == fixed.COMPLETED:
            ok = ok & ~F.left(after, F.lit(RIGHT)).rlike(rx_low(fixed.AVOIDED)) & ~clause.rlike(rx_low(fixed.BEFORE_EVENT))
        return ok

    return let(lambda low: F.when(tells(low, pattern), any_match(low, rx_low(pattern), counts)).otherwise(F.lit(False)), folded(c))


def recoverable(parts: Column) -> Column:
    """A struct of label and evidence, given sentences: the first completed event (No), else the first intervention
    (Yes), else Unknown and no evidence."""

    def first(pattern: str) -> Column:
        return first_of(parts, lambda s: F.when(unnegated(s, pattern), s))

    def told(label: Column, evidence: Column) -> Column:
        return F.struct(F.when(evidence.isNull(), fixed.UNKNOWN).otherwise(label).alias("label"), F.coalesce(evidence, F.lit("")).alias("evidence"))

    saved = let(lambda s: told(F.lit("Yes"), s), first(fixed.SUCCESS))
    return let(lambda done: F.when(done.isNull(), saved).otherwise(told(F.lit("No"), done)), first(fixed.COMPLETED))


def near_miss(parts: Column, happened: Column) -> Column:
    """The first sentence that tells of a near miss and does not prescribe; else "None stated"."""

    def told(s: Column) -> Column:
        return unnegated(s, fixed.NEAR_MISS) & (s != happened) & (word_count(s) <= 60) & ~s.rlike(rx(fixed.PRESCRIPTIVE)) & ~s.rlike(rx(fixed.FILED))

    return F.coalesce(first_of(parts, lambda s: F.when(told(s), s)), F.lit(fixed.NONE))


def without_labels(s: Column) -> Column:
    """A sentence without list numbers and section labels at its ends."""
    s = F.regexp_replace(s, rf"(?U)^\d{{1,2}}[.)]{WS}+", "")
    s = F.regexp_replace(s, rx(fixed.SECTION_LABEL), "")
    return F.regexp_replace(s, rf"(?U)\.{WS}*\d{{1,2}}\.$", ".")


#: What sentences that recommend have one of, with their labels or without.
LESSON_WORDS = any_of(tuple(sorted({*needed(fixed.LESSON_START), *needed(fixed.LESSON_MODAL)})))


def lesson(parts: Column, *exclude: Column) -> Column:
    """The last sentence that recommends something, without its labels; else "None stated."."""
    def recommends(s: Column) -> Column:
        fits = s.endswith(".") & s.rlike(r"""^[A-Z0-9"'\[(]""") & ~s.contains("?")
        for other in exclude:
            fits = fits & (s != other)
        # the dearest pattern is tried last, on what passed all others
        return fits & (s.rlike(rx(fixed.LESSON_START)) | let(lambda low: search(low, fixed.LESSON_MODAL), folded(s))) & word_count(s).between(5, 35) & ~s.rlike(rx(fixed.ANAPHORA)) & ~s.rlike(rx(fixed.NOT_A_LESSON))

    found = lambda s: F.when(folded(s).rlike(LESSON_WORDS), let(lambda s: F.when(recommends(s), s), without_labels(s)))
    return F.coalesce(first_of(F.reverse(parts), found), F.lit(fixed.NO_LESSON))


def contributors(narrative: Column, human_factors: Column, factors: Column, most: int = 5) -> Column:
    """Phrases of the narrative that attest coded contributors, in the order of the codes, each once in any case."""
    codes = F.concat(split_codes(human_factors), split_codes(factors))
    text = text_of(narrative)

    def attested(pattern: str) -> Column:
        def found(at: Column) -> Column:
            before = F.right(F.left(text, at - 1), F.lit(25))
            return F.when((at > 0) & ~before.rlike(rx(fixed.NEGATION)), F.regexp_extract(text, rx(pattern), 0))

        return let(found, F.regexp_instr(text, F.lit(rx(pattern))))

    def phrase(code: Column) -> Column:
        # a pattern that is a literal is compiled once, one looked up anew for each code
        return F.coalesce(*(F.when(code == name, attested(pattern)) for name, pattern in fixed.CONTRIBUTOR_PHRASES.items()))

    found = F.array_compact(F.transform(codes, phrase))
    add = lambda got, p: F.when(F.exists(got, lambda q: F.lower(q) == F.lower(p)), got).otherwise(F.array_append(got, p))
    return F.slice(F.aggregate(found, texts([]), add), 1, most)
