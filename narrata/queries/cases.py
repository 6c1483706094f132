"""Rules on short texts that each try one clause of them: negation, recollection, labels, hedges, qualifiers.

Every event takes one case by its id. What a rule must find is written by hand beside the text; the SQL states those
literals and shares nothing with the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import rules
from narrata.functions.synopsis import supported_synopsis
from narrata.functions.text import sentences
from narrata.plans.spread import spread
from narrata.queries import table
from narrata.queries.templates import NO, NO_LESSON, quoted

#: narrative, outcome, evidence
OUTCOMES = (
    ("We went around and landed safely.", "Yes", "We went around and landed safely."),
    ("We never went around on that day.", "Unknown", ""),
    ("There was no room, but the tug slowed and we rejected the takeoff.", "Yes", "There was no room, but the tug slowed and we rejected the takeoff."),
    ("The crew would have rejected the takeoff at once.", "Unknown", ""),
    ("Another crew went around ahead of us.", "Unknown", ""),
    ("Last year we went around at this field.", "Unknown", ""),
    ("The wing struck the ground hard.", "No", "The wing struck the ground hard."),
    ("I contacted the ground control office.", "Unknown", ""),
    ("The truck nearly hit the fence.", "Unknown", ""),
    ("There was a prop strike avoided by luck.", "Unknown", ""),
    ("I recovered before the tail strike could happen.", "Unknown", ""),
    ("It was dark. We regained control of the aircraft.", "Yes", "We regained control of the aircraft."),
    ("The tug stopped. We stopped.", "Yes", "We stopped."),
    ("We stopped the climb at five thousand.", "Unknown", ""),
    ("We diverted our attention to the door.", "Unknown", ""),
    ("We diverted to the north field. We landed in a field.", "No", "We landed in a field."),
    ("Nobody was injured. The gear collapsed.", "No", "The gear collapsed."),
    ("The approach was uneventful.", "Yes", "The approach was uneventful."),
    ("Nothing to tell.", "Unknown", ""),
)
#: narrative, near miss
NEAR = (
    ("It was a close call.", "It was a close call."),
    ("It was dark. We almost hit a tug.", "We almost hit a tug."),
    ("It was not a close call.", NO),
    ("I almost forgot the list.", NO),
    ("Crews should report each close call.", NO),
    ("I filed a close call report.", NO),
    ("Last year I had a close call.", NO),
    ("A jet passed below us by 200 feet.", "A jet passed below us by 200 feet."),
    ("We came very close to the fence. A close call.", "We came very close to the fence."),
    ("It could have been worse.", "It could have been worse."),
    ("We narrowly missed a truck, but nobody saw it.", "We narrowly missed a truck, but nobody saw it."),
)
#: narrative, lesson
LESSONS = (
    ("Crews should brief the taxi route before each push.", "Crews should brief the taxi route before each push."),
    ("Should we stop here for a while? We did not.", NO_LESSON),
    ("The captain said we should wait for the tug here.", NO_LESSON),
    ("This should be briefed by all crews each day.", NO_LESSON),
    ("1. Pilots should check the fuel before each leg.", "Pilots should check the fuel before each leg."),
    ("Recommendations: Crews need to slow down near the ramp.", "Crews need to slow down near the ramp."),
    ("Pilots must rest.", NO_LESSON),
    ("I should mention that the door was open.", NO_LESSON),
    ("We will always use two wing walkers here. Next time we will ask for help first.", "Next time we will ask for help first."),
    ("We should have received the notice before the leg.", NO_LESSON),
    ("Never did the crew see the sign on the ramp.", NO_LESSON),
    ("Do not push back when the ramp is full of carts.", "Do not push back when the ramp is full of carts."),
    ("No lessons were learned, but crews should slow down there.", NO_LESSON),
)
#: narrative, synopsis, what of it is supported
SYNOPSES = (
    ("I am not sure what hit us. The panel was lost.", "The panel was lost.", ""),
    ("We hit a sign near the hill.", "We hit a sign at a high altitude airport.", ""),
    ("We hit a sign at the high altitude airport near the hill.", "We hit a sign at the high altitude airport.", "We hit a sign at the high altitude airport."),
    ("The aircraft struck a fence by the road.", "A B737 struck a fence.", "An aircraft struck a fence."),
    ("The B737 struck a fence by the road.", "A B737 struck a fence.", "A B737 struck a fence."),
    ("The aircraft struck a fence by the road.", "The small transport aircraft struck a fence.", "The aircraft struck a fence."),
    ("The small aircraft struck a fence by the road.", "The small transport aircraft struck a fence.", "The small aircraft struck a fence."),
    ("The small aircraft struck a fence by the transport office.", "The small transport aircraft struck a fence.", "The aircraft struck a fence."),
    ("The SMALL TRANSPORT aircraft struck a fence by the road.", "The small transport aircraft struck a fence.", "The small transport aircraft struck a fence."),
    ("The twin engine aircraft struck a fence.", "The twin-engine, light aircraft struck a fence.", "The twin-engine, aircraft struck a fence."),
    ("The panel was lost. The bolts probably failed.", "The panel was lost due to failed bolts.", ""),
    ("The panel was lost. The bolts failed.", "The panel was lost due to failed bolts.", "The panel was lost due to failed bolts."),
    ("The panel was lost.", "The panel was lost due to heavy rain.", ""),
    ("The panel was lost.", "The First Officer reported the panel was lost.", "The reporter reported the panel was lost."),
    ("The captain said he lost the panel. I saw it.", "Captain reported the panel was lost.", "Reporter reported the panel was lost."),
    ("As the captain I lost the panel.", "Captain reported the panel was lost.", "Captain reported the panel was lost."),
    ("The panel was lost.", "The panel would have been lost.", ""),
    ("The panel was lost.", "Was the panel lost?", ""),
    ("The panel was lost.", "The panel was lost at 300 feet.", ""),
    ("The panel was lost. The door failed. The window was hit.", "The panel was lost. The door failed. The window was hit.", "The panel was lost. The door failed."),
    ("The panel was lost.", "The engine failed. The panel was lost.", ""),
    ("The panel was lost.", None, ""),
)


def cases(spark: SparkSession, sf_dir: str, rows, *columns: str) -> DataFrame:
    """(pos, columns): each event with the case that its id falls on."""
    held = F.array(*(F.struct(*(F.lit(v).cast("string").alias(c) for c, v in zip(columns, r, strict=False))) for r in rows))
    events = spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("pos")))
    return events.select("pos", F.get(held, (F.col("pos") % len(rows)).cast("int")).alias("x")).select("pos", "x.*")


def expected(rows, select: str, at: tuple[int, ...]) -> str:
    values = ", ".join(f"({k}, {', '.join(quoted(r[i]) for i in at)})" for k, r in enumerate(rows))
    names = ", ".join(f"v{i}" for i in range(len(at)))
    return f"with c(k, {names}) as (values {values}) select event_id as pos, {select} from events join c on event_id % {len(rows)} = k"


def parts() -> Column:
    return sentences(F.col("narrative"))


def outcome_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of narratives with negated, recollected, avoided and completed events."""
    return cases(spark, sf_dir, OUTCOMES, "narrative").select("pos", rules.recoverable(parts()).alias("r")).select("pos", F.col("r.label").alias("outcome"), "r.evidence")


def near_miss_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near misses, and what only sounds like one."""
    return cases(spark, sf_dir, NEAR, "narrative").select("pos", rules.near_miss(parts(), F.lit("")).alias("near_miss"))


def lesson_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons with list numbers and labels, and reported, told or short ones that are none."""
    return cases(spark, sf_dir, LESSONS, "narrative").select("pos", rules.lesson(parts()).alias("lesson"))


def synopsis_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synopses with types, roles, qualifiers, causes and numbers that their narratives may lack."""
    df = supported_synopsis(cases(spark, sf_dir, SYNOPSES, "narrative", "synopsis"), "synopsis", "narrative")
    return df.select("pos", F.array_join("supported", " ").alias("supported"))


QUERIES = {"outcome_cases": outcome_cases, "near_miss_cases": near_miss_cases, "lesson_cases": lesson_cases, "synopsis_cases": synopsis_cases}
ORACLES = {
    "outcome_cases": expected(OUTCOMES, "v0 as outcome, v1 as evidence", (1, 2)),
    "near_miss_cases": expected(NEAR, "v0 as near_miss", (1,)),
    "lesson_cases": expected(LESSONS, "v0 as lesson", (1,)),
    "synopsis_cases": expected(SYNOPSES, "v0 as supported", (2,)),
}
