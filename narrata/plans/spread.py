"""Inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks a core that rows are dealt into, so that no task holds more than a small share of them.
TASKS_A_CORE = 8


def spread(rows: DataFrame, files: int | None = None) -> DataFrame:
    """``rows`` of a scan, dealt over several tasks a core where it has fewer ``files`` than that.

    A row group is one task, whatever rules follow and however many splits its file is cut into: the splits in which no
    row group begins are empty. Moving raw rows costs microseconds each, the rules a large part of a millisecond. Inputs
    of many files are left as they are, without a shuffle.
    """
    tasks = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if (len(rows.inputFiles()) if files is None else files) < tasks else rows
