"""Exact duplicates by stateful streaming, built of DataFrame operations only.

The rows are written to a content table and arrive from there as a stream, in micro-batches. Disk-backed keyed state
(RocksDB, checkpointed to the shared folder, never expired) holds for each SHA-256 digest of a normalised text how many
rows had it, and the row that stays: its length, its stable id and its locator (file and row of the content table).
Counts and maxima are combined before they are shuffled, so a third of all rows with one text is one row per task.

Since a digest only stands for a text, the full bytes are checked on hits: the texts of digests that several rows have,
and no others, are read from the content table, and must be one text for each digest. Digests with more are grouped by
the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.tables import SPACE
from narrata.operators.skew import join_counted
from narrata.plans.storage import Workspace, fresh_path, session_settings

#: State on the executors' disks; many small stores must not each reserve space ahead, and the stores of an executor,
#: which stay open for a while after their query, share one bound for blocks and writes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _keeper(*locator: Column) -> Column:
    return F.struct("n_chars", F.bitwise_not("id").alias("not_id"), *locator)


def _registry(content: DataFrame, path: str, batches: int, digest: Column) -> DataFrame:
    """(digest, n, keeper) over the stream of the files below ``path``; each batch adds the groups it changed."""
    spark = content.sparkSession
    out = fresh_path(spark, "exact-registry")
    stream = spark.readStream.schema(content.select("id", "n_chars", "sha").schema)
    if batches > 1:
        stream = stream.option("maxFilesPerTrigger", max(1, -(-len(content.inputFiles()) // batches)))
    keeper = _keeper(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    state = stream.parquet(path).withColumns({"keeper": keeper, "digest": digest}).groupBy("digest").agg(F.count("*").alias("n"), F.max("keeper").alias("keeper"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")  # a batch that runs again replaces its own

    with session_settings(spark, STATE):
        query = state.writeStream.outputMode("update").option("checkpointLocation", fresh_path(spark, "exact-state")).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    changed = spark.read.schema(state.schema).parquet(f"{out}/*") if query.lastProgress else spark.createDataFrame([], state.schema)
    if batches == 1:
        return changed  # each group once
    return changed.groupBy("digest").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"))  # later states are larger


class _Groups:
    """The content table of one call, and the groups of equal texts in it."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, carried: list[str], batches: int, digest_chars: int) -> None:
        self.work = work = Workspace(docs.sparkSession, "exact")
        text = F.col(f"`{text_col}`")
        digest = F.left(F.col("sha"), F.lit(digest_chars)).alias("digest")
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.char_length(F.coalesce(text, F.lit(""))).alias("n_chars"), F.sha2(normalised(text), 256).alias("sha"), F.struct(*(F.col(f"`{c}`") for c in carried)).alias("content"))
        content = work.table("content", rows)
        registry = work.table("registry", _registry(content, work.paths["content"], batches, digest))
        self.content = content.select("id", "n_chars", "sha", digest, "content", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        self.body = normalised(F.col(f"content.`{text_col}`"))
        self.total = content.count()

        hits = work.table("hits", registry.where("n > 1").select("digest", "n", "keeper"))
        bodies = join_counted(self.content.select("digest", self.body.alias("body")), hits.select("digest", "n"), "digest", self.total, how="left_semi").distinct()
        self.mixed = work.table("mixed", bodies.groupBy("digest").count().where("count > 1").select("digest"))
        self.is_mixed = not self.mixed.isEmpty()
        self.registry, self.hits = (x.join(self.mixed, "digest", "left_anti") if self.is_mixed else x for x in (registry, hits))

    def by_text(self) -> DataFrame:
        """The rows whose digest stands for several texts, with ``body``, ``n`` and ``keeper`` of their text."""
        rows = self.work.table("by-text", self.content.join(self.mixed, "digest", "left_semi").withColumn("body", self.body))
        best = rows.groupBy("body").agg(F.count("*").alias("n"), F.max(_keeper("file", "row")).alias("keeper"))
        return rows.join(best, "body")


def _stays() -> Column:
    return (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1, digest_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the normalised text, hex),
    length (code points of its text).

    Texts are equal when they are identical without ASCII white space; null is the empty text, which groups like
    any other. The row with the most code points in the original text stays, of those the one with the smallest
    id (null ids come last), of rows alike in both one. Repeated rows give a row each, of which one at most is kept.
    Other columns are not read, whatever their names. An empty table gives no rows.

    batches: micro-batches the rows come in; later ones meet the state of those before, and the result is the same.
    digest_chars: hex digits of the digest that key the state; fewer than 64 make sense in tests only, to force collisions.
    """
    groups = _Groups(docs, id_col, text_col, [text_col], batches, digest_chars)
    shown = [F.col("id").alias(id_col), F.bitwise_not("keeper.not_id").alias("keep_id"), F.col("n").alias("group_size"), _stays().alias("kept"), F.col("sha").alias("text_sha256"), F.col("n_chars").alias("length")]
    found = join_counted(groups.content.select("id", "n_chars", "sha", "digest", "file", "row"), groups.registry, "digest", groups.total).select(*shown)
    return found.unionByName(groups.by_text().select(*shown)) if groups.is_mixed else found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1, digest_chars: int = 64) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that :func:`exact_duplicates` keeps; all columns stay."""
    groups = _Groups(docs, id_col, text_col, docs.columns, batches, digest_chars)
    # rows of one text only are in no group, so they need no partner
    rows = groups.content.join(groups.mixed, "digest", "left_anti") if groups.is_mixed else groups.content
    kept = join_counted(rows, groups.hits, "digest", groups.total, how="left").where(F.col("keeper").isNull() | _stays())
    found = kept.select("content.*")
    return found.unionByName(groups.by_text().where(_stays()).select("content.*")) if groups.is_mixed else found
