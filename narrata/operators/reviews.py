"""Reviews bound to what was reviewed: aligned with their packets, and with digests of the data they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.places import numbered
from narrata.operators.scoring import review_rates
from narrata.plans.storage import Workspace
from narrata.sources.files import ordered_digest

VERDICTS = ("aligned", "missing", "foreign", "repeated", "out of order")


def _sequence(rows: DataFrame, side: str) -> DataFrame:
    """(split, report_id, copy, <side>_pos): the k-th time that an id stands in its split is its copy k."""
    copy = F.row_number().over(Window.partitionBy("split", "report_id").orderBy("pos"))
    return rows.select(F.coalesce(F.col("split").cast("string"), F.lit("")).alias("split"), F.coalesce(F.col("report_id").cast("string"), F.lit("")).alias("report_id"), F.col("pos").cast("long").alias("pos")).select("split", "report_id", copy.alias("copy"), F.col("pos").alias(f"{side}_pos"))


def aligned(packet: DataFrame, reviews: DataFrame) -> DataFrame:
    """(split, report_id, packet_pos, review_pos, verdict) of two sequences (split, pos, report_id), each in the order of pos
    within its split.

    A row of the packet that nobody reviewed is missing; a review of an id that the packet lacks is foreign, one beyond the
    number of its rows repeated. What both have is aligned where it has the same rank among what both have, else out
    of order. Null ids count as empty. Ranks come from sorted ranges, so neither side is gathered.
    """
    work = Workspace(packet.sparkSession, "aligned")
    keys = ["split", "report_id", "copy"]
    both = work.table("both", _sequence(packet, "packet").join(_sequence(reviews, "review"), keys, "full_outer"))
    common = both.where("packet_pos is not null and review_pos is not null").select(*keys, "packet_pos", "review_pos")
    ranks = [numbered(common, ["split", f"{side}_pos"], f"{side}_rank").select(*keys, f"{side}_rank") for side in ("packet", "review")]
    ranked = both.join(ranks[0].join(ranks[1], keys), keys, "left")
    known = packet.select(F.coalesce(F.col("split").cast("string"), F.lit("")).alias("split"), F.coalesce(F.col("report_id").cast("string"), F.lit("")).alias("report_id"), F.lit(True).alias("known")).distinct()
    verdict = (
        F.when(F.col("review_pos").isNull(), "missing").when(F.col("packet_pos").isNull() & F.col("known").isNull(), "foreign").when(F.col("packet_pos").isNull(), "repeated")
        .when(F.col("packet_rank") == F.col("review_rank"), "aligned").otherwise("out of order")
    )
    return ranked.join(known, ["split", "report_id"], "left").select("split", "report_id", "packet_pos", "review_pos", verdict.alias("verdict"))


def check_aligned(packet: DataFrame, reviews: DataFrame) -> None:
    """``ValueError`` with the first row that is not aligned, by split and place."""
    first = aligned(packet, reviews).where("verdict <> 'aligned'").orderBy("split", F.coalesce("packet_pos", "review_pos"), "report_id").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['split']}: review of {first[0]['report_id']} is {first[0]['verdict']}")


def decide(reviews: DataFrame, train: DataFrame, evaluation: DataFrame, columns: tuple[str, ...], most: float = 0.20) -> dict:
    """The decision of a review, to be kept as one JSON object: whether the share of violations is within bounds, how many
    rows were read, and the digests of the data in their order (``pos``), which a run must find again."""
    rates = review_rates(reviews).where("split = 'all'").first()
    if rates is None or not rates["n"]:
        raise ValueError("Nothing was reviewed")
    return {
        "approved": rates["violation_rate"] <= most, "n_reviewed": rates["n"], "concern_rate": round(rates["concern_rate"], 3), "violation_rate": round(rates["violation_rate"], 3),
        "train_digest": ordered_digest(train, "pos", *columns).first()["digest"], "eval_digest": ordered_digest(evaluation, "pos", *columns).first()["digest"],
    }


def check_bound(decision: dict | None, train: DataFrame, evaluation: DataFrame, columns: tuple[str, ...], n: int = 100) -> None:
    """``ValueError`` unless a review of exactly ``n`` rows approved just these data in just this order."""
    if not decision:
        raise ValueError("The data were not reviewed")
    if not decision.get("approved"):
        raise ValueError("The review did not approve the data")
    if decision.get("n_reviewed") != n:
        raise ValueError(f"The review has {decision.get('n_reviewed')} rows, not {n}")
    for part, rows in (("train", train), ("eval", evaluation)):
        if decision.get(f"{part}_digest") != ordered_digest(rows, "pos", *columns).first()["digest"]:
            raise ValueError(f"The review belongs to other {part} data, or to another order of them")
