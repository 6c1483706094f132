"""The contract of a brief generator, and a rule-based one that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import brief as briefs
from narrata.functions.text import strip, truncate

Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def valid_inputs(rows: DataFrame) -> DataFrame:
    """Rows (id, narrative) with a narrative that is not blank; a missing id is the narrative's hash."""
    return rows.where(strip(F.col("narrative")) != "").withColumn("id", F.coalesce(F.col("id").cast("string"), F.sha2("narrative", 256)))


def generate(rows: DataFrame, generator: Generator, narrative_chars: int = 6000) -> DataFrame:
    """Outputs of a model: (id, narrative, input_truncated, text, tokens).

    ``generator`` maps batches of (id, messages) to batches of (id, text, tokens), a row for a row; it may load its
    model once per task. Results join back on the id, so a generator may reorder its batches.
    """
    cut = rows.withColumn("__cut", truncate(F.col("narrative"), narrative_chars)).select("id", F.col("__cut.text").alias("narrative"), F.col("__cut.truncated").alias("input_truncated"))
    made = cut.select("id", F.to_json(briefs.prompt(F.col("narrative"))).alias("messages")).mapInPandas(generator, "id string, text string, tokens int")
    return cut.join(made, "id")


def rule_briefs(rows: DataFrame) -> DataFrame:
    """(id, text, tokens) of the rules' own briefs; reports whose synopsis lacks support have none. Tokens are words."""
    done = briefs.gold(rows).where("gold is not null")
    return done.select("id", F.col("gold_text").alias("text"), F.regexp_count("gold_text", F.lit(r"\S+")).alias("tokens"))


def envelopes(outputs: DataFrame) -> DataFrame:
    """(id, valid, output, input_truncated): JSON of the brief, or of the error with the untouched text."""
    df = briefs.parse(outputs, "text")
    return df.select("id", F.col("parse_error").isNull().alias("valid"), briefs.envelope("brief", "parse_error", "text").alias("output"), "input_truncated")
