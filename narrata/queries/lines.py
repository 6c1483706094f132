"""Places of lines in many files, and what depends on them: which copy of an id comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators import curate, places
from narrata.plans.storage import Workspace, fresh_path
from narrata.queries import table

LEAST = 5


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read again: file k has the 2k + 1 events from the square of k on, so sizes
    differ, files grow in number with the events, and paths in order of text are not in order of k."""
    path, e = fresh_path(spark, "event-lines"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, "user_id", "event_type", F.floor(F.sqrt(e.cast("double"))).alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "event_id").write.partitionBy("file").json(path)
    return spark.read.schema("event_id long, user_id long, event_type string").json(path)


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "placed")
    return places.line_places(work.table("lines", places.marked_lines(event_lines(spark, sf_dir).drop("file"))), "place")


def line_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each event's line over all files."""
    return placed_events(spark, sf_dir).select("event_id", "place")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of their users: the first line of a user over all files counts, whatever becomes of it; types of
    fewer than five letters are too short."""
    rows = placed_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("report_id"), F.col("event_type").alias("narrative"), F.lit("s").alias("synopsis"), F.lit("").alias("factor"), "place", "event_id")
    return curate.cheap_reasons(rows, "place", LEAST).select("event_id", F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"))


PLACED = """placed as (select event_id, user_id, event_type, row_number() over (order by 'file=' || floor(sqrt(event_id::double))::bigint || '/', event_id) - 1 as place from events)"""

QUERIES = {"line_places": line_places, "first_lines": first_lines}
ORACLES = {
    "line_places": f"with {PLACED} select event_id, place from placed",
    "first_lines": f"""with {PLACED}, r as (select *, row_number() over (partition by user_id order by place) as k from placed)
        select event_id, case when k > 1 then 'drop_duplicate_id' when length(event_type) < {LEAST} then 'drop_short_narrative' else 'kept' end as drop_reason from r""",
}
