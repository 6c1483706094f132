"""Operators on rows that arrive in batches, held against what all rows together give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.plans.storage import Workspace, fresh_path
from narrata.queries.reports import CHEAP_FUNNEL
from narrata.queries.splits import GROUPS, linked_rows
from narrata.queries.templates import reports
from narrata.streaming import components, funnel

BATCHES = 4


def arriving(rows: DataFrame, batch: Column) -> DataFrame:
    """A stream of ``rows``, which arrive in four batches by ``batch``, 0 to 3; each is a file a core, written by as many tasks.

    The rows are worked out once, into a table of their own, not once for each batch."""
    spark = rows.sparkSession
    path, cores = fresh_path(spark, "arriving"), spark.sparkContext.defaultParallelism
    dealt = Workspace(spark, "arriving").table("dealt", rows.withColumn("__batch", batch))
    for k in range(BATCHES):
        dealt.where(F.col("__batch") == k).drop("__batch").repartition(cores).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", cores).parquet(path)


def streamed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of linked reports that came in four batches, dealt by id."""
    rows = linked_rows(spark, sf_dir).select("report_id", "related_ids", "narrative_sha256")
    stream = arriving(rows, F.pmod(F.xxhash64("report_id"), F.lit(BATCHES)))
    store = components.ComponentStore(spark, fresh_path(spark, "components"))
    components.link_stream(stream, store).awaitTermination()
    ids = rows.select("report_id").distinct()
    return ids.join(store.components().withColumnRenamed("node", "report_id"), "report_id").select("report_id", F.col("component").alias("group_id"))


def streamed_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by the first of the cheap filters; they came in four batches, later places before earlier ones."""
    rows = reports(spark, sf_dir).select("pos", "report_id", "narrative", "synopsis", "factor")
    stream = arriving(rows, F.pmod(-F.col("pos"), F.lit(BATCHES)))
    store = funnel.FunnelStore(spark, fresh_path(spark, "funnel-store"))
    funnel.funnel_stream(stream, store).awaitTermination()
    return store.funnel()


QUERIES = {"streamed_components": streamed_components, "streamed_funnel": streamed_funnel}
ORACLES = {
    "streamed_funnel": CHEAP_FUNNEL,
    "streamed_components": f"with recursive {GROUPS} select report_id, group_id from groups",
}
