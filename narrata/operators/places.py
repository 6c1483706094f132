"""Places in an order that no single task or driver ever holds whole: running totals, row numbers, lines of many files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.skew import join_counted
from narrata.plans.storage import Workspace

FILE, BLOCK, TURN = "__file", "__block", "__turn"


def running_total(rows: DataFrame, order: list[str], n: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of ``n`` over all rows before this one in ``order`` (ascending, nulls first).

    ``order`` must tell all rows apart. Rows are sorted into ranges; only one sum a range passes the driver, and the
    sums within a range are a window over that range alone. ``__range`` and ``__before`` are names of its own.
    """
    spark, work = rows.sparkSession, Workspace(rows.sparkSession, "places")
    ranged = work.table("ranged", rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranged.groupBy("__range").agg(F.sum(n).cast("long").alias("n")).orderBy("__range").collect():
        offsets.append((r["__range"], before))
        before += r["n"] or 0
    held = spark.createDataFrame(offsets, "__range int, __before long")
    within = F.sum(n).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(held), "__range").withColumn(out, F.col("__before") + F.coalesce(within, F.lit(0)).cast("long")).drop("__range", "__before")


def numbered(rows: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """``rows`` with their place in ``order``, from 0."""
    return running_total(rows.withColumn("__one", F.lit(1)), order, "__one", out).drop("__one")


def marked_lines(scan: DataFrame) -> DataFrame:
    """A scan of line files with the file and the block of each line, and its turn among the lines that its task reads.

    Only for a plain scan: the columns name where Spark reads a line, which a shuffle before would hide."""
    return scan.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias(TURN))


def line_places(marked: DataFrame, out: str = "pos") -> DataFrame:
    """Lines of :func:`marked_lines` with their place over all files: files by their path, lines as they stand in the file.

    ``marked`` must be a written table, since it is read twice. Tasks read blocks whole and in order, but in no given
    order of blocks, so turns count within a block only: a block's first place is the number of lines of all blocks
    before it, in order of path and start. Places have no gaps; an empty file takes none.
    """
    work = Workspace(marked.sparkSession, "lines")
    blocks = marked.groupBy(FILE, BLOCK).agg(F.count("*").alias("__n"), F.min(TURN).alias("__first"))
    placed = work.table("blocks", running_total(blocks, [FILE, BLOCK], "__n", "__start"))
    total = placed.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    found = join_counted(marked, placed, [FILE, BLOCK], total, n="__n")
    return found.withColumn(out, F.col("__start") + F.col(TURN) - F.col("__first")).drop(FILE, BLOCK, TURN, "__n", "__first", "__start")
