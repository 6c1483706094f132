"""Joins on keys of which a few may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sides of at most so many rows are sent to every task; and so many keys at most are ever called hot.
SMALL, MOST_HOT, LEAST_HOT = 100_000, 4_096, 64


def hot_limit(total: int) -> int:
    """The number of rows beyond which a key is hot. Of ``total`` rows, at most ``MOST_HOT`` keys can have more."""
    return max(LEAST_HOT, -(-total // MOST_HOT))


def join_counted(rows: DataFrame, keyed: DataFrame, on: str | list[str], total: int, n: str = "n", how: str = "inner", small: int = SMALL) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key and in ``n`` how many of the ``total`` rows have it.

    how: inner, left or left_semi. Where ``keyed`` is small it is broadcast. Else the hot keys are: their number is bounded,
    since each has over ``hot_limit(total)`` rows, and their rows stay where they are. The rest is shuffled and merged;
    no key of it has more rows than the limit. ``keyed`` is read several times, so it should be a table.
    """
    keys = [on] if isinstance(on, str) else on
    if keyed.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(keyed), keys, how)
    hot = F.broadcast(keyed.where(F.col(n) > hot_limit(total)))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(n) <= hot_limit(total)).hint("merge"), keys, how)
    return rows.join(hot, keys, "left_semi" if how == "left_semi" else "inner").unionByName(cold)
