"""The seven-section brief: rendering, strict parsing, prompts, and the gold brief of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import rules
from narrata.functions.codes import map_factor, map_phase
from narrata.functions.synopsis import supported_synopsis
from narrata.functions.text import LINE_END, MARK, sentences, strip, text_of, texts, word_count
from narrata.packs import fixed
from narrata.plans.fence import fence

FIELDS = ("what_happened", "what_almost_happened", "phase_of_flight", "primary_factor", "contributing_factors", "recoverable", "recoverable_note", "lesson")
ANY_HEADING = r"(?md)^([A-Za-z][A-Za-z -]*):[ \t]*$"
HEADING = rf"(?md)^(?:{'|'.join(fixed.HEADINGS)}):[ \t]*\n"


def render(b: Column) -> Column:
    """The text of a brief struct."""
    bullets = F.when(F.size(b["contributing_factors"]) > 0, F.array_join(F.transform(b["contributing_factors"], lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(fixed.NONE))
    outcome = F.concat(b["recoverable"], F.when(b["recoverable_note"] != "", F.concat(F.lit("\n"), b["recoverable_note"])).otherwise(F.lit("")))
    values = (b["what_happened"], b["what_almost_happened"], b["phase_of_flight"], b["primary_factor"], bullets, outcome, b["lesson"])
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{h}:\n"), v) for h, v in zip(fixed.HEADINGS, values, strict=True)))


def parse(df: DataFrame, text: str, brief: str = "brief", error: str = "parse_error") -> DataFrame:
    """``df`` with a strictly parsed brief, and null in ``error``; or null, and the first rule that the text breaks.

    Nothing is repaired: a wrapper, a repeated or hidden heading, a missing blank line make a text invalid. Null
    text counts as empty.
    """
    wrong = fixed.PARSE_ERRORS
    df = df.withColumn("__text", strip(F.col(text)))
    t = F.col("__text")
    # the split at a pattern compiles it for each text, so texts are split at a mark that none of them should have
    between = F.when(t.contains(MARK), F.split(t, HEADING)).otherwise(F.split(F.regexp_replace(t, HEADING, MARK), MARK))
    df = fence(df.withColumns({"__names": F.regexp_extract_all(t, F.lit(ANY_HEADING), F.lit(1)), "__between": between}), "__names", "__between")
    raw = lambda i: F.get("__between", F.lit(i + 1))
    df = fence(df.withColumn("__v", F.transform(F.slice("__between", 2, 7), strip)), "__v")
    happened, almost, phase, factor, bullets, outcome, lesson = (F.get("__v", F.lit(i)) for i in range(7))
    lines = lambda c: F.when(c.rlike(LINE_END.replace(r"\n", "")), F.split(c, LINE_END)).otherwise(F.split(c, "\n"))
    df = df.withColumns({"__out": lines(outcome), "__bul": F.when(bullets == fixed.NONE, texts([])).otherwise(lines(bullets))})
    sections = []
    for i, name in enumerate(fixed.HEADINGS):
        if i < 6:
            sections.append(F.when(~raw(i).endswith("\n\n"), wrong[2]))
        sections.append(F.when(F.get("__v", F.lit(i)) == "", wrong[3] + name))
    good_bullet = lambda x: x.startswith("- ") & (strip(F.substring(x, 3, 1 << 30)) != "")
    n = F.size(sentences(happened))
    late = [
        F.when(~(phase.isin(*fixed.PHASES) & factor.isin(*fixed.FACTORS)), wrong[4]),
        F.when(~F.get("__out", F.lit(0)).isin(*fixed.RECOVERABLE) | (F.size("__out") > 2), wrong[5]),
        F.when(~F.forall("__bul", good_bullet) | (F.size("__bul") > 5), wrong[6]),
        F.when((n < 1) | (n > 3), wrong[7]),
        F.when((F.size(sentences(lesson)) != 1) | lesson.contains("\n") | ~lesson.rlike(r"[.!?]\z"), wrong[8]),
    ]
    first = [F.when(F.col("__names") != texts(fixed.HEADINGS), wrong[0]), F.when((F.size("__between") < 8) | (F.get("__between", F.lit(0)) != ""), wrong[1])]
    df = fence(df.withColumn(error, F.coalesce(*first, *sections, *late)), error, "__out", "__bul")
    values = (happened, almost, phase, factor, F.transform("__bul", lambda x: strip(F.substring(x, 3, 1 << 30))), F.get("__out", F.lit(0)), F.coalesce(F.get("__out", F.lit(1)), F.lit("")), lesson)
    df = df.withColumn(brief, F.when(F.col(error).isNull(), F.struct(*(v.alias(k) for k, v in zip(FIELDS, values, strict=True)))))
    return fence(df.drop("__text", "__names", "__between", "__v", "__out", "__bul"), brief)


def envelope(brief: str, error: str, raw: str) -> Column:
    """JSON of a brief, or of the error and the untouched output."""
    return F.when(F.col(error).isNull(), F.to_json(F.col(brief))).otherwise(F.to_json(F.struct(F.col(error).alias("error"), F.col(raw).alias("raw_output"))))


def prompt(narrative: Column) -> Column:
    """The two messages put to a generator."""
    user = F.concat(F.lit(fixed.FORMAT_PROMPT + "\n<narrative>\n"), text_of(narrative), F.lit("\n</narrative>"))
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(fixed.SYSTEM_PROMPT)), ("user", user))))


def prompt_length(narrative: Column) -> Column:
    """The code points of ``prompt(narrative)``, which is not written for it."""
    return F.length(text_of(narrative)) + len(fixed.SYSTEM_PROMPT + fixed.FORMAT_PROMPT + "\n<narrative>\n" + "\n</narrative>")


def gold(df: DataFrame, out: str = "gold", given: str | None = None, parsed: str | None = None) -> DataFrame:
    """``df`` with the gold brief that the rules read from ``narrative``, ``synopsis`` and the coded fields; null
    where the synopsis lacks support or the rendered brief would not parse. Evidence columns ``source_*`` stay.
    Narratives of unsupported synopses, which have no brief, are read no further.
    given: a column of supported synopses where they are known. parsed: a column for what ``parse`` reads from ``gold_text``."""
    df = supported_synopsis(df, "synopsis", "narrative", given=given)
    live = F.size("supported") > 0
    df = fence(df.withColumn("source_parts", F.when(live, F.coalesce("source_parts", sentences(F.col("narrative"))))), "source_parts")
    parts, narrative = F.when(live, F.col("source_parts")).otherwise(texts([])), F.when(live, F.col("narrative"))
    df = df.withColumns({"__happened": F.array_join("supported", " "), "__outcome": rules.recoverable(parts)})
    df = fence(df, "__happened", "__outcome")
    df = df.withColumn("__almost", rules.near_miss(parts, F.col("__happened")))
    df = fence(df, "__almost")
    evidence = F.col("__outcome.evidence")
    note = F.when((word_count(evidence) <= 40) & ~F.col("__happened").contains(evidence), evidence).otherwise(F.lit(""))
    values = (
        F.col("__happened"), F.col("__almost"), map_phase(F.col("phase")), map_factor(F.col("factor"), narrative, F.col("reporter_function")),
        rules.contributors(narrative, F.col("human_factors"), F.col("contributors")), F.col("__outcome.label"), note,
        rules.lesson(parts, F.col("__happened"), F.col("__almost")),
    )
    df = df.withColumn("__gold", F.struct(*(v.alias(k) for k, v in zip(FIELDS, values, strict=True))))
    df = fence(df, "__gold")
    df = parse(fence(df.withColumn("gold_text", F.when(live, render(F.col("__gold")))), "gold_text"), "gold_text", "__parsed", "__error")
    keep = live & F.col("__error").isNull()
    df = df.withColumns({out: F.when(keep, F.col("__gold")), "gold_text": F.when(keep, F.col("gold_text"))} | ({parsed: F.when(keep, F.col("__parsed"))} if parsed else {}))
    return fence(df.drop("__happened", "__outcome", "__almost", "__gold", "__parsed", "__error"), out, "gold_text")
