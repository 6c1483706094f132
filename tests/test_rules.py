"""Rules on sentences of our own; each case names the behaviour it covers."""

import pytest
from pyspark.sql import functions as F

from narrata.functions import codes, rules
from narrata.functions.text import sentences
from narrata.packs import fixed


def outcome(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i")
    return [r[0]["label"] for r in df.select(rules.recoverable(sentences(F.col("s")))).collect()]


OUTCOMES = {
    "We stopped. The line was clear.": "Yes",
    "We went around and joined the pattern.": "Yes",
    "The First Officer and I queried ATC about it.": "Yes",
    "I queried ATC about it.": "Yes",
    "We did not hit a truck.": "Unknown",
    "Our wing hit a truck. We stopped.": "No",
    "No one was hurt, but the tug struck the fence.": "No",
    "We were on a collision course.": "Unknown",
    "We almost collided over the field.": "Unknown",
    "A collision was avoided by the other pilot.": "Yes",
    "The glider landed in a field.": "No",
    "Two ramp workers were injured.": "No",
    "We contacted ground control.": "Unknown",
    "The aircraft contacted the ground control frequency.": "Unknown",
    "The aircraft contacted the ground.": "No",
    "I diverted my attention to the radio.": "Unknown",
    "We diverted to a nearby field.": "Yes",
    "I recovered before the wing tip struck the ground.": "Unknown",
    "I remember that another crew crashed there.": "Unknown",
    "The aircraft rolled into the grass.": "No",
    "A truck was parked in the grass.": "Unknown",
    "We stopped the climb at the new level.": "Unknown",
    "": "Unknown",
}


def test_outcomes(spark):
    assert dict(zip(OUTCOMES, outcome(spark, OUTCOMES), strict=True)) == OUTCOMES


def test_negation_reaches_seventy_characters_of_the_clause(spark):
    far = "Not " + "x" * 70 + " we crashed."
    assert outcome(spark, [far, "Not long ago we crashed.", "Not bad, we crashed.", "The panel departed was avoided.", None]) == ["No", "Unknown", "No", "Unknown", "Unknown"]


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "s string").select(expr(sentences(F.col("s")))).first()[0]


NEAR = {
    "We nearly hit a truck. It was late.": "We nearly hit a truck.",
    "I almost forgot the checklist.": fixed.NONE,
    "We must not come so close; we nearly hit it.": fixed.NONE,
    "It passed below us by 300 feet.": "It passed below us by 300 feet.",
    "I filed a near miss report.": fixed.NONE,
    "It came too close to the wing.": "It came too close to the wing.",
    "We did not have a near miss.": fixed.NONE,
}


def test_near_miss(spark):
    for text, want in NEAR.items():
        assert one(spark, text, lambda p: rules.near_miss(p, F.lit(""))) == want
    assert one(spark, "We nearly hit a truck.", lambda p: rules.near_miss(p, F.lit("We nearly hit a truck."))) == fixed.NONE


LESSON = {
    "Pilots should brief the route. We landed.": "Pilots should brief the route.",
    "Next time I will ask for a turn.": "Next time I will ask for a turn.",
    "1. Procedures - Crews should read the notes twice.": "Crews should read the notes twice.",
    "Crews should slow down early. Crews must be ready to turn.": "Crews must be ready to turn.",
    "Tower told us we should turn left now.": fixed.NO_LESSON,
    "Should pilots brief the route more often?": fixed.NO_LESSON,
    "This should be fixed by the company.": fixed.NO_LESSON,
    "We should go.": fixed.NO_LESSON,
    "We were higher than we should have been.": fixed.NO_LESSON,
    "I should mention that the day was warm.": fixed.NO_LESSON,
    "Never did we see the other one.": fixed.NO_LESSON,
    "pilots should brief the whole route.": fixed.NO_LESSON,
}


def test_lesson(spark):
    for text, want in LESSON.items():
        assert one(spark, text, rules.lesson) == want, text
    assert one(spark, "Pilots should brief the route.", lambda p: rules.lesson(p, F.lit("Pilots should brief the route."))) == fixed.NO_LESSON


def test_contributors(spark):
    rows = [
        (0, "I was tired and rushed. The Fog came in.", "Fatigue; Time Pressure;Fatigue", "Weather;Staffing"),
        (1, "There was no fog.", None, "Weather"),
        (2, "Tired, confused, rushed, unaware, icing, workload.", "Fatigue;Confusion;Time Pressure;Situational Awareness;Workload", "Weather"),
        (3, None, None, None),
        (4, "TIRED", "Fatigue;fatigue", None),
    ]
    df = spark.createDataFrame(rows, "i int, n string, h string, c string").orderBy("i")
    got = [r[0] for r in df.select(rules.contributors(F.col("n"), F.col("h"), F.col("c"))).collect()]
    assert got == [["tired", "rushed", "Fog"], [], ["Tired", "confused", "rushed", "unaware", "workload"], [], ["TIRED"]]


@pytest.mark.parametrize(("code", "want"), [("Cruise; Taxi", "Cruise"), ("Moon", "Other"), (" ; ", "Unknown"), (None, "Unknown"), ("Takeoff / Launch", "Takeoff")])
def test_phase(spark, code, want):
    assert spark.createDataFrame([(code,)], "c string").select(codes.map_phase(F.col("c"))).first()[0] == want


def test_factor(spark):
    rows = [
        (0, "Human Factors", "Tower gave us the wrong runway.", None, "ATC"),
        (1, "Human Factors", "I failed to check the strip.", "Approach;Local", "ATC"),
        (2, "Human Factors", "The pilot failed to turn.", "Approach", "Human"),
        (3, "Human Factors", "I failed to turn.", "Captain", "Human"),
        (4, "Aircraft", "Tower gave us the wrong runway.", None, "Equipment"),
        (5, "Moon", "x", None, "Unknown"),
        (6, None, None, None, "Unknown"),
        (7, " Staffing ", "x", None, "Human"),
    ]
    df = spark.createDataFrame(rows, "i int, c string, n string, f string, want string").orderBy("i")
    assert [(a, b) for a, b in df.select(codes.map_factor(F.col("c"), F.col("n"), F.col("f")), "want").collect()] == [(r[4], r[4]) for r in rows]
