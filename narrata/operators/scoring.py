"""Scores of paired outputs against gold briefs, their metrics, acceptance gates, and reviews."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import brief as briefs
from narrata.functions.grounding import Source, any_flag, grounding_flags, with_source
from narrata.functions.text import content_words, let, overlap
from narrata.packs import fixed
from narrata.plans.fence import fence

#: Metrics of the paired table, in the order of the report.
REPORTED = ("valid_schema", "factor_acc", "phase_acc", "recoverable_acc", "recoverable_known_acc", "grounding_fail", "median_tokens", "near_miss_distinct", "lesson_recall", "lesson_emitted", "lesson_grounded")
GATES = ("schema_at_least_95_percent", "schema_not_worse", "factor_gain_15pp", "phase_gain_10pp", "grounding_at_most_10_percent", "grounding_not_worse", "recoverable_improves", "recoverable_binary_support", "recoverable_not_collapsed")

#: The columns of the narrative that scores are held against.
EVIDENCE = (*(f"source_{part}" for part in Source.__dataclass_fields__), "source_words")


def pair(evaluation: DataFrame, outputs: DataFrame) -> DataFrame:
    """Rows of both tables joined on ``report_id``; ``ValueError`` unless each has every id of the other once."""
    sides = evaluation.select("report_id", F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(outputs.select("report_id", F.lit(0).alias("e"), F.lit(1).alias("o")))
    odd = sides.groupBy("report_id").agg(F.sum("e").alias("e"), F.sum("o").alias("o")).where("e <> 1 or o <> 1")
    if odd.limit(1).count():
        raise ValueError("Saved outputs do not match the evaluation rows")
    return evaluation.join(outputs, "report_id")


def prepared(rows: DataFrame) -> DataFrame:
    """``rows`` (narrative, gold_text, ...) with what ``score`` takes from these two. It is the same for each model, so it
    is best worked out before rows are doubled for theirs. The evidence that ``briefs.gold`` leaves, and ``gold`` and
    ``gold_error`` as ``briefs.parse`` reads them, are taken as they are."""
    df = rows if {"gold", "gold_error"} <= set(rows.columns) else briefs.parse(rows, "gold_text", "gold", "gold_error")
    if set(EVIDENCE) <= set(df.columns):
        return df
    return fence(with_source(df, "narrative").withColumn("source_words", content_words(F.col("narrative"))), "source_words")


def score(rows: DataFrame) -> DataFrame:
    """Scores of (report_id, model, narrative, gold_text, text, tokens, near_miss_gold), ``prepared`` or not.

    Flags are taken from invalid outputs, too; all else of them counts as wrong, and their prediction is "invalid".
    Gold must parse; a row whose gold does not has null scores. An output that is its gold brief is not parsed again.
    """
    df = rows if set(EVIDENCE) <= set(rows.columns) and {"gold", "gold_error"} <= set(rows.columns) else prepared(rows)
    same = F.col("text").eqNullSafe(F.col("gold_text"))
    df = briefs.parse(df.withColumn("__other", F.when(~same, F.col("text"))), "__other", "__brief", "__error")
    df = df.withColumns({"brief": F.when(same, F.col("gold")).otherwise(F.col("__brief")), "parse_error": F.when(same, F.col("gold_error")).otherwise(F.col("__error"))})
    df = fence(df.withColumn("grounding_flags", grounding_flags(Source.named("source"), F.col("text"))), "grounding_flags")
    valid, b, g = F.col("parse_error").isNull(), F.col("brief"), F.col("gold")
    right = lambda field: valid & (b[field] == g[field])
    told = valid & (b["lesson"] != fixed.NO_LESSON)
    distinct = valid & ~b["what_almost_happened"].isin(fixed.NONE, fixed.UNKNOWN) & (b["what_almost_happened"] != b["what_happened"])
    words = content_words(b["lesson"])
    return df.select(
        "report_id", "model", valid.alias("schema_valid"), right("primary_factor").alias("factor_correct"), right("phase_of_flight").alias("phase_correct"),
        right("recoverable").alias("recoverable_correct"), (g["recoverable"] != fixed.UNKNOWN).alias("recoverable_known"), g["recoverable"].alias("recoverable_gold"),
        any_flag(F.col("grounding_flags")).alias("grounding_fail"), "grounding_flags", "tokens", F.coalesce("near_miss_gold", F.lit(False)).alias("near_miss_gold"),
        distinct.alias("near_miss_distinct"), F.when(valid, b["recoverable"]).otherwise("invalid").alias("recoverable_prediction"),
        (g["lesson"] != fixed.NO_LESSON).alias("lesson_gold"), told.alias("lesson_present"), (told & (let(lambda w: overlap(w, F.coalesce("source_words", content_words(F.col("source_text")))), words) >= 0.6)).alias("lesson_grounded"), "parse_error",
    )


def rate(c: str | Column, among: str | None = None) -> Column:
    """Share of true among the rows, or among those where ``among`` holds; null where there are none."""
    value = (F.col(c) if isinstance(c, str) else c).cast("int").cast("double")
    return F.avg(value if among is None else F.when(F.col(among), value))


def metrics(scores: DataFrame) -> DataFrame:
    """One row per model. The median is exact; label counts are in long form in ``label_counts``."""
    n = lambda c: F.count_if(F.col(c))
    known = lambda label, c: F.count_if(F.col("recoverable_known") & (F.col(c) == label))
    return scores.groupBy("model").agg(
        F.count("*").alias("n"), rate("schema_valid").alias("valid_schema"), rate("factor_correct").alias("factor_acc"), rate("phase_correct").alias("phase_acc"),
        rate("recoverable_correct").alias("recoverable_acc"), rate("recoverable_correct", "recoverable_known").alias("recoverable_known_acc"), n("recoverable_known").alias("recoverable_known_n"),
        rate("grounding_fail").alias("grounding_fail"), F.median("tokens").alias("median_tokens"), rate("near_miss_distinct", "near_miss_gold").alias("near_miss_distinct"), n("near_miss_gold").alias("near_miss_n"),
        rate("lesson_present", "lesson_gold").alias("lesson_recall"), n("lesson_gold").alias("lesson_n"), rate("lesson_present").alias("lesson_emitted"), rate("lesson_grounded", "lesson_present").alias("lesson_grounded"),
        known("Yes", "recoverable_gold").alias("gold_yes"), known("No", "recoverable_gold").alias("gold_no"), known("Yes", "recoverable_prediction").alias("known_yes"), known("No", "recoverable_prediction").alias("known_no"),
    )


def checked_metrics(scores: DataFrame) -> DataFrame:
    """``metrics``, but an empty set is an error."""
    if not scores.limit(1).count():
        raise ValueError("Cannot evaluate an empty set")
    return metrics(scores)


def label_counts(scores: DataFrame) -> DataFrame:
    """(model, distribution, label, n_rows): predictions; gold of known rows; predictions of known rows."""
    known = F.col("recoverable_known")
    kinds = F.array(
        F.struct(F.lit("recoverable_distribution").alias("distribution"), F.col("recoverable_prediction").alias("label")),
        F.when(known, F.struct(F.lit("recoverable_gold_distribution").alias("distribution"), F.col("recoverable_gold").alias("label"))),
        F.when(known, F.struct(F.lit("recoverable_known_distribution").alias("distribution"), F.col("recoverable_prediction").alias("label"))),
    )
    long = scores.select("model", F.explode(F.array_compact(kinds)).alias("x")).select("model", "x.*")
    return long.groupBy("model", "distribution", "label").agg(F.count("*").alias("n_rows"))


def paired(table: DataFrame) -> DataFrame:
    """(metric, base, adapter) of the two models' metrics."""
    pairs = F.create_map(*chain.from_iterable((F.lit(m), F.col(m).cast("double")) for m in REPORTED))
    long = table.select("model", F.explode(pairs).alias("metric", "value"))
    side = lambda m: F.max(F.when(F.col("model") == m, F.col("value"))).alias(m)
    return long.groupBy("metric").agg(side("base"), side("adapter"))


def gates(table: DataFrame, smoke: bool = False) -> DataFrame:
    """One row: the nine gates of ``metrics`` of the models base and adapter, and the decision."""
    side = lambda m: F.max(F.when(F.col("model") == m, F.struct(*table.columns)))
    one = table.agg(side("base").alias("b"), side("adapter").alias("a"))
    b, a = F.col("b"), F.col("a")
    values = (
        a["valid_schema"] >= 0.95, a["valid_schema"] >= b["valid_schema"], a["factor_acc"] - b["factor_acc"] >= 0.15 - 1e-9, a["phase_acc"] - b["phase_acc"] >= 0.10 - 1e-9,
        a["grounding_fail"] <= 0.10, a["grounding_fail"] <= b["grounding_fail"], F.coalesce(a["recoverable_known_acc"] > b["recoverable_known_acc"], F.lit(False)),
        (a["gold_yes"] > 0) & (a["gold_no"] > 0), (a["known_yes"] > 0) & (a["known_no"] > 0),
    )
    df = one.select(*(v.alias(k) for k, v in zip(GATES, values, strict=True)))
    verdict = F.when(~F.col("grounding_not_worse"), fixed.DECISIONS["stop"]).when(F.forall(F.array(*GATES), lambda x: x), fixed.DECISIONS["pass"]).otherwise(fixed.DECISIONS["fail"])
    return df.withColumn("decision", F.lit(fixed.DECISIONS["smoke"]) if smoke else verdict)


def review_rates(reviews: DataFrame) -> DataFrame:
    """(split, n, concern_rate, violation_rate) of review rows, with a row for all of them under ``all``; a missing
    violation takes the concern. ``ValueError`` where a concern or a note is missing."""
    if reviews.where("grounding_concern is null or coalesce(note, '') = ''").limit(1).count():
        raise ValueError("A review row lacks its concern or its note")
    df = reviews.withColumn("violation", F.coalesce("grounding_rule_violation", "grounding_concern"))
    return df.rollup("split").agg(F.count("*").alias("n"), rate("grounding_concern").alias("concern_rate"), rate("violation").alias("violation_rate")).fillna("all", ["split"])


def review_fields(reviews: DataFrame) -> DataFrame:
    """(field, n_rows) over the rows with a concern."""
    return reviews.where("grounding_concern").select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("n_rows"))


def approved(reviews: DataFrame, most: float = 0.20, n: int | None = None) -> bool:
    """Whether the share of violations is within bounds, for exactly ``n`` rows if given."""
    row = review_rates(reviews).where("split = 'all'").first()
    return row is not None and row["violation_rate"] <= most and n in (None, row["n"])
