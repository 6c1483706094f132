"""Connected components of links that arrive in batches, with work that follows the batch, not the store.

The store has two tables. ``nodes`` gives each node the label of its component as it was when the node came; such a row is
never written again. ``roots`` says which label a label has become since. A batch's links are contracted onto the present
roots of their ends, so components are sought among those roots alone; what merges changes rows of ``roots``, of which there
is one a merged label, not one a member. Each batch writes its rows into folders of its own number and reads only folders
of smaller ones, so a batch that is run again after a failure writes what it wrote before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from narrata.operators.components import connected_components
from narrata.operators.linkage import edges_of
from narrata.operators.skew import join_counted
from narrata.plans.storage import Workspace, fresh_path

NODES, ROOTS = "node string, label string", "label string, root string"


@dataclass(frozen=True)
class ComponentStore:
    """Components that grow batch by batch, below ``path`` in a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        for name, schema in (("nodes", NODES), ("roots", ROOTS)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}/batch=-1")

    def _before(self, name: str, schema: str, batch: int | None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        return rows if batch is None else rows.where(F.col("batch") < batch)

    def roots(self, batch: int | None = None) -> DataFrame:
        """(label, root): labels that are no longer the name of their component; before a batch, or now."""
        return self._before("roots", ROOTS, batch).groupBy("label").agg(F.max_by("root", "batch").alias("root"))

    def components(self, batch: int | None = None) -> DataFrame:
        """(node, component) of all nodes; before a batch, or now. A component is named by its smallest node."""
        nodes = self._before("nodes", NODES, batch)
        return nodes.join(self.roots(batch), "label", "left").select("node", F.coalesce("root", "label").alias("component"))

    def add(self, edges: DataFrame, batch: int) -> None:
        """Take in links (src, dst). Links with a null end are ignored, repeated ones and either direction count once. Batches
        are numbered upwards; the last one may be given again."""
        work = Workspace(self.spark, "arrived")
        edges = work.table("edges", edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src is not null and dst is not null").distinct())
        roots = work.table("roots", self.roots(batch))
        ends = work.table("ends", edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")))
        known = ends.join(self._before("nodes", NODES, batch).select("node", "label"), "node", "left")
        named = work.table("named", known.join(roots, "label", "left").select("node", "n", F.col("label").isNull().alias("new"), F.coalesce("root", "label", "node").alias("name")))
        total = 2 * edges.count()
        at = lambda rows, end: join_counted(rows.withColumnRenamed(end, "node"), named.select("node", "n", "name"), "node", total).drop("node", "n").withColumnRenamed("name", f"{end}_name")
        contracted = at(at(edges, "src"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
        found = work.table("found", connected_components(contracted))
        merged = found.where("node <> component")
        # names that were roots before: their own rows, and those of labels that had become them
        old = work.table("old", merged.join(named.where("not new").select(F.col("name").alias("node")).distinct(), "node", "left_semi"))
        moved = roots.join(old.select(F.col("node").alias("root"), "component"), "root").select("label", F.col("component").alias("root"))
        became = old.select(F.col("node").alias("label"), F.col("component").alias("root"))
        fresh = named.where("new").join(found.withColumnRenamed("node", "name"), "name").select("node", F.col("component").alias("label"))
        moved.unionByName(became).write.mode("overwrite").parquet(f"{self.path}/roots/batch={batch}")
        fresh.write.mode("overwrite").parquet(f"{self.path}/nodes/batch={batch}")
        work.drop("edges", "roots", "ends", "named", "found", "old")


def link_stream(reports: DataFrame, store: ComponentStore) -> StreamingQuery:
    """Feed a stream of reports (report_id, related_ids, narrative_sha256) to a store, all that is there now; then it stops."""

    def take(rows: DataFrame, batch: int) -> None:
        store.add(edges_of(rows), batch)

    return reports.writeStream.foreachBatch(take).option("checkpointLocation", fresh_path(store.spark, "links")).trigger(availableNow=True).start()
