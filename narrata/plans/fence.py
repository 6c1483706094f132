"""Columns that are evaluated once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, *computed: str) -> DataFrame:
    """``df`` with the ``computed`` columns evaluated here, once per row, and put last.

    The optimizer merges projections and pushes filters below them by copying expressions into each place that
    names them, into lambdas too; with chains of dozens of steps the copies multiply without bound. A generator of
    one row stops that for the columns named, while filters on all other columns still reach the scan.
    """
    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [quote(c) for c in df.columns if c not in computed]
    return df.select(*kept, F.inline(F.array(F.struct(*map(quote, computed)))))
