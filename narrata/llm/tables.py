"""Helpers that several operators share: reading a table, and dropping rows by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators.skew import SMALL
from narrata.plans.storage import Workspace

#: ASCII white space, as a character class for Java's and RE2's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Whole texts go to Python in batches of so many bytes and rows, since both sides hold a batch at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", BATCH_BYTES: str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; read by Spark alone, so any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on batches to Python are bounded by bytes, where the session does not say otherwise. For operators whose
    results are computed when they are read, after the operator has returned."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, SMALL_BATCHES[BATCH_BYTES])


def text_key(text: Column) -> Column:
    """Tells the texts under one id apart."""
    return F.xxhash64(text, F.char_length(text))


def with_columns_kept(docs: DataFrame, gone: DataFrame, id_col: str, of: Column) -> DataFrame:
    """``docs`` without the rows whose id and ``of`` are in ``gone`` (two columns: id and of), all columns kept whatever
    their names; null matches null.

    The pairs are counted first: few are sent to the rows, which then need no shuffle; more meet them in a merge."""
    drop = few_broadcast(Workspace(docs.sparkSession, "gone").table("ids", gone.toDF("__gone", "__of").distinct()))
    return docs.join(drop, docs[id_col].eqNullSafe(drop["__gone"]) & of.eqNullSafe(drop["__of"]), "left_anti")


def few_broadcast(keys: DataFrame, small: int = SMALL) -> DataFrame:
    """A table, marked for a broadcast if it has at most ``small`` rows, else for a merge join."""
    return F.broadcast(keys) if keys.limit(small + 1).count() <= small else keys.hint("merge")
