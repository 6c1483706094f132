"""Briefs of reports as they arrive. Extraction is row-local, so a stream runs the batch operators unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from narrata.functions import brief as briefs
from narrata.functions.text import strip
from narrata.operators.curate import report_fields
from narrata.plans.storage import fresh_path
from narrata.sources.files import REPORT_SCHEMA


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of raw reports from a folder of JSON lines, with ``arrived``, the time of the file."""
    raw = spark.readStream.schema(REPORT_SCHEMA).option("mode", "FAILFAST").json(folder)
    return report_fields(raw, F.col("_metadata.file_modification_time").alias("arrived"))


def first_reports(reports: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first report of each id; ids are forgotten after ``delay``, which bounds the state."""
    named = reports.withColumn("report_id", strip(F.col("report_id"))).where("report_id <> ''")
    return named.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["report_id"])


def brief_stream(reports: DataFrame) -> DataFrame:
    """Gold briefs of a stream of reports; those whose synopsis lacks support are left out."""
    return briefs.gold(reports).where("gold is not null").select("report_id", "gold_text")


def funnel_stream(reports: DataFrame, least: int = 200) -> DataFrame:
    """Running counts of reports by the first row-local rule they fail; for output mode ``complete``."""
    empty = (F.coalesce(F.col("synopsis"), F.lit("")) == "") & (F.coalesce(F.col("factor"), F.lit("")) == "")
    reason = F.when(strip(F.col("report_id")) == "", "drop_missing_id").when(F.length(strip(F.col("narrative"))) < least, "drop_short_narrative").when(empty, "drop_no_supervision").otherwise("kept")
    return reports.groupBy(reason.alias("drop_reason")).agg(F.count("*").alias("n_rows"))


def write_parquet(stream: DataFrame, path: str) -> StreamingQuery:
    """Append a stream to Parquet, all that is there now, then stop; its state lies in the shared folder."""
    checkpoint = fresh_path(stream.sparkSession, "stream")
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
