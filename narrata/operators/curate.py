"""From raw reports to eligible rows: ordered filters that charge each row to the first rule it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import brief as briefs
from narrata.functions.grounding import Source, any_flag, grounding_flags
from narrata.functions.text import normal_hash, strip, text_of, truncate
from narrata.packs import fixed
from narrata.plans.fence import fence

RELATED = r"(?U)\b\d{6,8}\b"


def report_fields(raw: DataFrame, *more: Column) -> DataFrame:
    """Raw columns under their short names, as strings, and ``more``; columns that are missing are null."""
    have = set(raw.columns)
    field = lambda name: F.col(f"`{name}`") if name in have else F.lit(None)
    short = {"id": "report_id"}
    return raw.select(*(field(name).cast("string").alias(short.get(key, key)) for key, name in fixed.COLUMNS.items()), *more)


def related_ids(c: Column) -> Column:
    """Word-bounded runs of six to eight digits."""
    return F.regexp_extract_all(text_of(c), F.lit(RELATED), F.lit(0))


def cheap_reasons(reports: DataFrame, pos: str, least: int = 200) -> DataFrame:
    """``reports`` with ``drop_reason`` by the rules that need no extraction: missing id, repeated id (the first by
    ``pos`` counts, whatever becomes of it), short narrative, neither synopsis nor factor. Null: none of these.

    Rows of one blank id would all meet in one task, so they are charged before the window deals out the rest.
    """
    df = reports.withColumns({"report_id": strip(F.col("report_id")), "narrative": strip(F.col("narrative"))})
    blank = df.where("report_id = ''").withColumn("drop_reason", F.lit("drop_missing_id"))
    first = F.min(pos).over(Window.partitionBy("report_id"))
    empty = (F.coalesce(F.col("synopsis"), F.lit("")) == "") & (F.coalesce(F.col("factor"), F.lit("")) == "")
    reason = F.when(F.col(pos) > F.col("__first"), "drop_duplicate_id").when(F.length("narrative") < least, "drop_short_narrative").when(empty, "drop_no_supervision")
    rest = df.where("report_id <> ''").withColumn("__first", first).withColumn("drop_reason", reason).drop("__first")
    return blank.unionByName(rest)


def curate(reports: DataFrame, pos: str = "pos", narrative_chars: int = 6000, max_chars: int = 20000, least: int = 200) -> DataFrame:
    """All reports with the gold brief and ``drop_reason`` (null: eligible), ``truncated``, flags and metadata.

    ``reports`` has the short names of ``report_fields`` and ``pos``, the file order, without ties. Lengths are code
    points. The synopsis is checked against the whole narrative, then the brief is read from the truncated one. Rows
    are read no further than to the rule that drops them; what later rules would find in them is left empty.
    """
    df = cheap_reasons(reports, pos, least)
    live = lambda c: F.when(F.col("drop_reason").isNull(), F.col(c))
    whole = briefs.supported_synopsis(df.withColumns({"__live_narrative": live("narrative"), "__live_synopsis": live("synopsis")}), "__live_synopsis", "__live_narrative", out="__whole", prefix="__w")
    whole = whole.drop("__live_narrative", "__live_synopsis", *(c for c in whole.columns if c.startswith("__w_")))
    cut = truncate(F.col("narrative"), narrative_chars)
    no = F.col("drop_reason").isNull() & (F.size("__whole") == 0)
    df = whole.withColumns({"drop_reason": F.when(no, "drop_unsupported_synopsis").otherwise(F.col("drop_reason")), "__cut": cut})
    df = df.withColumn("__sha", F.when(F.col("__cut.truncated"), normal_hash(F.col("narrative"))))
    df = df.withColumns({"truncated": F.col("drop_reason").isNull() & F.col("__cut.truncated"), "__narrative": F.col("__cut.text"), "__synopsis": F.col("synopsis")}).drop("__cut")
    df = fence(df, "drop_reason", "truncated", "__narrative")
    # what was not cut has been checked already
    known = F.when(F.col("drop_reason").isNotNull(), F.array().cast("array<string>")).when(~F.col("truncated"), F.col("__whole"))
    df = df.withColumns({"__whole": known, "narrative": live("__narrative"), "synopsis": live("synopsis")})
    df = briefs.gold(df, given="__whole").withColumns({"narrative": F.col("__narrative"), "synopsis": F.col("__synopsis")}).drop("__narrative", "__synopsis", "__whole")
    df = df.withColumn("flags", grounding_flags(Source.named("source"), F.col("gold_text")))
    df = fence(df, "flags")
    length = briefs.prompt_length(F.col("narrative")) + F.length("gold_text")
    reason = F.coalesce(
        F.col("drop_reason"),
        F.when(F.col("gold").isNull(), "drop_unsupported_synopsis"),
        F.when(any_flag(F.col("flags")), "drop_grounding"),
        F.when(length > max_chars, "drop_sequence_length"),
    )
    df = df.withColumns({
        "drop_reason": reason, "token_count": length, "near_miss_gold": F.col("gold.what_almost_happened") != fixed.NONE,
        "recovery_no_gold": F.col("gold.recoverable") == "No",
    })
    df = fence(df.drop(*(c for c in df.columns if c.startswith("source_")), "supported"), "drop_reason", "token_count")
    # behind the last fence, so that they are worked out only for rows that are read, and not at all where nothing asks for them
    messages = F.concat(briefs.prompt(F.col("narrative")), F.array(F.struct(F.lit("assistant").alias("role"), F.col("gold_text").alias("content"))))
    sha = F.coalesce("__sha", normal_hash(F.col("narrative")))
    return df.withColumns({"messages": messages, "narrative_sha256": sha, "related_ids": related_ids(F.col("related_id"))}).drop("__sha")


def eligible(curated: DataFrame) -> DataFrame:
    """The rows to split, with the columns that training and scoring read."""
    return curated.where("drop_reason is null").select("report_id", "messages", "narrative", "related_ids", "narrative_sha256", "truncated", "token_count", "near_miss_gold", "recovery_no_gold", "gold", "gold_text")


def funnel(curated: DataFrame) -> DataFrame:
    """(drop_reason, n_rows), with ``kept`` for eligible rows."""
    return curated.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n_rows"))


def drifted(rows: DataFrame) -> DataFrame:
    """Rows whose messages are not the prompt of their narrative and one answer that parses, with the ``fault``."""
    df = briefs.parse(rows.withColumn("__answer", F.get("messages", F.lit(2))["content"]), "__answer", "__brief", "__error")
    fault = F.coalesce(
        F.when(F.size("messages") != 3, "Expected three messages"),
        F.when(F.slice("messages", 1, 2) != briefs.prompt(F.col("narrative")), "Prompt drift"),
        F.when(F.get("messages", F.lit(2))["role"] != "assistant", "Last message must be the assistant's"),
        F.col("__error"),
    )
    return df.withColumn("fault", fault).where("fault is not null").drop("__answer", "__brief", "__error")


def frequencies(reports: DataFrame, columns: tuple[str, ...] = ("phase", "factor")) -> DataFrame:
    """(field, value, n_rows) of coded columns; null counts as empty."""
    long = reports.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text_of(F.col(c)).alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("field", "value").agg(F.count("*").alias("n_rows"))
