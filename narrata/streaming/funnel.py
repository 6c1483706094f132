"""The drop funnel of reports that arrive in any order, exact after each batch.

The first report of an id by its place counts, whatever comes first in time. So the state keeps for each id, on disk and
without expiry, how many reports it has and what the earliest of them comes to; a report that arrives late from an earlier
place takes its turn, and the one that stood there becomes a repeat. Each batch writes the ids that changed under its own
number, so a batch that is run again writes the same; the funnel reads the last word on each id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from narrata.functions.text import strip, text_of
from narrata.plans.storage import fresh_path, session_settings

CHANGES = "report_id string, n long, reason string"
#: Keyed state on local disk with its log in the shared folder, not on the heap of executors.
DISK_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def own_reason(least: int = 200) -> Column:
    """The first rule that a report fails by itself, repeats aside; ``passed`` for none."""
    empty = (text_of(F.col("synopsis")) == "") & (text_of(F.col("factor")) == "")
    return F.when(strip(F.col("report_id")) == "", "drop_missing_id").when(F.length(strip(F.col("narrative"))) < least, "drop_short_narrative").when(empty, "drop_no_supervision").otherwise("passed")


def firsts(reports: DataFrame, pos: str = "pos", least: int = 200) -> DataFrame:
    """(report_id, n, reason) of a stream or a table: how many reports an id has and what the first by ``pos`` comes to.
    Reports without an id share an empty one; they are added up before they meet."""
    rows = reports.select(strip(F.col("report_id")).alias("report_id"), own_reason(least).alias("reason"), F.col(pos).alias("pos"))
    return rows.groupBy("report_id").agg(F.count("*").alias("n"), F.min_by("reason", "pos").alias("reason"))


@dataclass(frozen=True)
class FunnelStore:
    """What is known of each id, batch by batch, below ``path`` in a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{self.path}/batch=-1")

    def take(self, changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def funnel(self) -> DataFrame:
        """(drop_reason, n_rows) of all reports so far."""
        rows = self.spark.read.schema(f"{CHANGES}, batch long").parquet(self.path)
        last = rows.groupBy("report_id").agg(F.max_by(F.struct("n", "reason"), "batch").alias("x")).select("report_id", "x.*")
        blank = F.col("report_id") == ""
        parts = F.array(F.struct(F.col("reason").alias("drop_reason"), F.when(blank, F.col("n")).otherwise(1).alias("n")), F.struct(F.lit("drop_duplicate_id").alias("drop_reason"), F.when(blank, 0).otherwise(F.col("n") - 1).alias("n")))
        return last.select(F.inline(parts)).groupBy("drop_reason").agg(F.sum("n").cast("long").alias("n_rows")).where("n_rows > 0")


def funnel_stream(reports: DataFrame, store: FunnelStore, pos: str = "pos", least: int = 200) -> StreamingQuery:
    """Feed a stream of reports with their places to a store, all that is there now; then it stops."""
    with session_settings(store.spark, DISK_STATE):
        changes = firsts(reports, pos, least).writeStream.outputMode("update").foreachBatch(store.take)
        return changes.option("checkpointLocation", fresh_path(store.spark, "funnel")).trigger(availableNow=True).start()
