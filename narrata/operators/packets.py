"""What people read of an evaluation: the report, the rubric packet and the lesson packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import brief as briefs
from narrata.operators import linkage, scoring
from narrata.sources.files import packet

INVALID = "Invalid brief; raw output follows:\n\n"


def rubric_rows(evaluation: DataFrame, scores: DataFrame, seed: int, n: int = 20, most_failures: int = 10) -> DataFrame:
    """(report_id, rank): a seeded sample of the rows, then the first of the adapter's grounding failures, by id, that it lacks."""
    failures = scores.where("model = 'adapter' and grounding_fail").select("report_id", F.lit(0).alias("pos")).orderBy("report_id").limit(most_failures)
    numbered = failures.withColumn("pos", F.row_number().over(linkage._by("report_id")))
    return linkage.review_union(linkage.seeded_sample(evaluation.select("report_id"), n, "report_id", seed), numbered, "report_id", most_failures)


def rubric_packet(evaluation: DataFrame, outputs: DataFrame, scores: DataFrame, seed: int = 42, n: int = 20) -> DataFrame:
    """(rank, key, block): Markdown blocks with narrative and the adapter's output, in the order in which they are read."""
    rows = scoring.pair(evaluation.select("report_id", "narrative"), outputs).select("report_id", "narrative", F.col("adapter.text").alias("output"))
    chosen = rubric_rows(evaluation, scores, seed, n)
    blocks = packet(rows.join(F.broadcast(chosen.select("report_id")), "report_id"), narrative="narrative", output="output")
    return blocks.join(F.broadcast(chosen), blocks["key"] == chosen["report_id"]).select("rank", "key", "block")


def lesson_packet(evaluation: DataFrame, outputs: DataFrame, seed: int = 42, n: int = 50) -> DataFrame:
    """(rank, key, block): narrative and lesson of a seeded sample, by the next seed; an output that does not parse is shown whole."""
    chosen = linkage.seeded_sample(evaluation.select("report_id"), n, "report_id", seed + 1)
    rows = scoring.pair(evaluation.select("report_id", "narrative"), outputs).select("report_id", "narrative", F.col("adapter.text").alias("text"))
    parsed = briefs.parse(rows.join(F.broadcast(chosen.select("report_id")), "report_id"), "text", "brief", "error")
    told = parsed.withColumn("lesson", F.when(F.col("error").isNull(), F.col("brief.lesson")).otherwise(F.concat(F.lit(INVALID), F.coalesce("text", F.lit("")))))
    blocks = packet(told, narrative="narrative", lesson="lesson")
    return blocks.join(F.broadcast(chosen), blocks["key"] == chosen["report_id"]).select("rank", "key", "block")


def report_lines(table: DataFrame, gates: DataFrame) -> DataFrame:
    """(place, line): the report of an evaluation as Markdown; metrics that do not exist are N/A."""
    number = lambda c: F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.3f", c))
    order = F.array_position(F.array(*map(F.lit, scoring.REPORTED)), F.col("metric")).cast("int")
    metrics = scoring.paired(table).select((order + 4).alias("place"), F.concat(F.lit("| "), "metric", F.lit(" | "), number("base"), F.lit(" | "), number("adapter"), F.lit(" |")).alias("line"))
    adapter = table.where("model = 'adapter'")
    line = lambda place, text: F.struct(F.lit(place).alias("place"), text.alias("line"))
    first = (F.lit("# Evaluation"), F.concat(F.lit("N = "), F.col("n").cast("string")), F.lit(""), F.lit("| Metric | Base | Adapter |"), F.lit("|---|---:|---:|"))
    head = adapter.select(F.inline(F.array(*(line(i, text) for i, text in enumerate(first)))))
    counts = F.concat(
        F.lit("Recovery is scored on "), F.col("recoverable_known_n").cast("string"), F.lit(" rows whose outcome is known, near misses on "), F.col("near_miss_n").cast("string"),
        F.lit(", lessons on "), F.col("lesson_n").cast("string"), F.lit("."),
    )
    tail = adapter.select(F.lit(100).alias("place"), counts.alias("line")).unionByName(gates.select(F.lit(101).alias("place"), F.concat(F.lit("**"), "decision", F.lit("**")).alias("line")))
    return head.unionByName(metrics).unionByName(tail)
