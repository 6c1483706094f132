"""Greedy filling of rooms of bounded size, without a walk over all groups.

Groups come in an order; each goes to the first room with space left for it. What is left of a room only shrinks, so what a
room takes is said by a few steps: from a place on, nothing larger than a limit fits. These steps are found from sums over
ranges of the order, by powers of two of the sizes; a range is looked into only where the sums leave open what fits, and
then again by its own ranges. The driver holds the sums of ``FAN`` ranges at a time, or at the bottom the sizes of
``LEAF`` groups, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits by which the order is cut into ranges at a time, and groups that are read one by one.
DIGITS, LEAF = 3, 4_096


@dataclass
class Steps:
    """What a room takes: from the place ``at`` of a step on, groups up to its limit; before the first step, all."""

    left: int
    steps: list[tuple[str, int]] = field(default_factory=list)

    def close(self, at: str) -> None:
        """From ``at`` on nothing larger than what is left fits."""
        if not self.steps or self.left < self.steps[-1][1]:
            self.steps.append((at, self.left))

    def takes(self, at: Column, n: Column) -> Column:
        """Whether the room takes a group. The last step at or before a group's place holds."""
        if not self.steps:
            return F.lit(True)
        steps = F.array(*(F.struct(F.lit(a).alias("at"), F.lit(k).cast("long").alias("limit")) for a, k in self.steps))
        return ~F.exists(steps, lambda s: (s["at"] <= at) & (s["limit"] < n))


def _sums(groups: DataFrame, prefix: str, digits: int) -> dict[str, list]:
    """Sums of the ranges below a prefix: for each, (power, groups, size, smallest, largest) of its sizes by powers of two."""
    at = F.substring("at", 1, len(prefix) + digits)
    power = F.floor(F.log2(F.col("n") + 0.5)).cast("int")
    rows = groups.where(F.col("at").startswith(prefix)).groupBy(at.alias("r"), power.alias("p")).agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("n").alias("least"), F.max("n").alias("most"))
    out: dict[str, list] = {}
    for r in rows.collect():
        out.setdefault(r["r"], []).append((r["p"], r["c"], r["s"], r["least"], r["most"]))
    return out


def _fill(groups: DataFrame, room: Steps, prefix: str, digits: int, leaf: int) -> None:
    """Fill the room from the range of a prefix."""
    for at, parts in sorted(_sums(groups, prefix, digits).items()):
        if not room.left:
            room.close(at)
            return
        fits = sum(s for _, _, s, _, most in parts if most <= room.left)
        if fits <= room.left and all(most <= room.left or least > room.left for _, _, _, least, most in parts):
            if any(most > room.left for *_, most in parts):
                room.close(at)
            room.left -= fits
        elif sum(c for _, c, *_ in parts) <= leaf or len(at) >= 64:
            for row in groups.where(F.col("at").startswith(at)).select("at", "n").orderBy("at").collect():
                if row["n"] <= room.left:
                    room.left -= row["n"]
                else:
                    room.close(row["at"])
        else:
            _fill(groups, room, at, digits, leaf)


def fill_room(groups: DataFrame, size: int, digits: int = DIGITS, leaf: int = LEAF) -> Steps:
    """The steps of a room of ``size`` that takes from ``groups`` (at, n) in the order of ``at``, hexadecimal hashes that
    tell them apart, whatever still fits.

    ``groups`` should be a table in the order of ``at``, so that a range reads few of its files. A step each is kept for
    sizes that cease to fit, so no more of them than different sizes; sizes are at least 1.
    """
    room = Steps(size)
    _fill(groups, room, "", digits, leaf)
    return room
