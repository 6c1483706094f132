"""Briefs: round trips, broken texts, grounding and synopses."""

import pytest
from pyspark.sql import functions as F

from narrata.functions import brief as b
from narrata.functions.grounding import Source, grounding_flags
from narrata.functions.synopsis import supported_synopsis
from narrata.packs import fixed

GOOD = ("We slid off the runway.", "None stated", "Landing", "Weather", ["fog"], "No", "We slid off.", "Crews should slow down early.")
SCHEMA = "struct<what_happened string, what_almost_happened string, phase_of_flight string, primary_factor string, contributing_factors array<string>, recoverable string, recoverable_note string, lesson string>"


def text_of(spark, values):
    return spark.createDataFrame([(values,)], f"b {SCHEMA}").select(b.render(F.col("b"))).first()[0]


def parsed(spark, *texts):
    return [(r["brief"] and tuple(r["brief"]), r["parse_error"]) for r in b.parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i"), "text").collect()]


def test_round_trip(spark):
    plain = (*GOOD[:4], [], "Unknown", "", fixed.NO_LESSON)
    texts = [text_of(spark, v) for v in (GOOD, plain)]
    assert texts[1].count("None stated") == 3 and "- fog" in texts[0]
    assert [x[0] for x in parsed(spark, *texts)] == [GOOD, plain]


E = fixed.PARSE_ERRORS


def test_broken_texts(spark):
    t = text_of(spark, GOOD)
    broken = {
        "Here it is:\n" + t: E[0],
        "Sure. " + t: E[0],
        t + "\n\nNote:\nx": E[0],
        t.replace("slid off the runway.", "slid.\nHidden:\nmore."): E[0],
        "x\n" + t: E[1],
        t[: t.index("Lesson:") + 7]: E[1],
        t.replace("\n\nLesson", "\nLesson"): E[2],
        t.replace("Phase of flight:\nLanding", "Phase of flight:\n"): E[3] + "Phase of flight",
        t.replace("Landing", "Lunar"): E[4],
        t.replace("No\nWe slid off.", "Maybe"): E[5],
        t.replace("No\nWe slid off.", "No\na\nb"): E[5],
        t.replace("- fog", "fog"): E[6],
        t.replace("- fog", "\n".join("- a" for _ in range(6))): E[6],
        t.replace("We slid off the runway.", "One. Two. Three. Four."): E[7],
        t.replace("early.", "early. Then more."): E[8],
        t.replace("early.", "early"): E[8],
        "": E[0],
        None: E[0],
    }
    got = parsed(spark, *broken)
    assert [x[1] for x in got] == list(broken.values()) and all(x[0] is None for x in got)
    assert [x[1] for x in parsed(spark, "\n " + t + " \n")] == [None]


FLAGS = [
    ("We held 1,200 feet.", "We held 1200 feet.", [[], [], [], []]),
    ("We held 1,200 feet.", "We held 1300 feet.", [["1300"], [], [], []]),
    ("The controller called.", "ATC called on TCAS.", [[], ["TCAS"], [], []]),
    ("We saw a hawk.", "A bird strike and a fire.", [[], [], ["fire"], []]),
    ("At gate B7 we stood.", "At Gate B7, then Gate C2.", [[], ["C2"], [], ["Gate C2"]]),
    ("We left Alpha.", "On Taxiway A.", [[], [], [], ["Taxiway A"]]),
    (None, None, [[], [], [], []]),
]


def test_grounding(spark):
    df = spark.createDataFrame([(i, n, o) for i, (n, o, _) in enumerate(FLAGS)], "i int, n string, o string").orderBy("i")
    got = df.select(grounding_flags(Source.of(F.col("n")), F.col("o")).alias("f")).collect()
    assert [list(r["f"]) for r in got] == [x[2] for x in FLAGS]


SYNOPSES = [
    ("the engine failed and the crew landed", "Small aircraft engine failed and landed.", ["Aircraft engine failed and landed."]),
    ("The Captain lost the radio on a small field.", "Captain lost the radio on a small field.", ["Captain lost the radio on a small field."]),
    ("I lost the radio on a field.", "Air carrier Captain lost the radio on a field.", ["Reporter lost the radio on a field."]),
    ("I lost the radio on a field.", "B737-800 crew lost the radio on a field.", ["Aircraft crew lost the radio on a field."]),
    ("The PA28 lost the radio on a field.", "PA28 lost the radio on a field.", ["PA28 lost the radio on a field."]),
    ("I lost the radio on a field.", "A Cessna lost the radio on a field.", ["An aircraft lost the radio on a field."]),
    ("I lost the radio. I am not sure why.", "Pilot lost the radio.", []),
    ("I lost the radio.", "Pilot lost the radio at 3000 feet.", []),
    ("I lost the radio and the lights.", "Pilot lost the radio due to corroded wiring.", []),
    ("I lost the radio. The wiring was corroded.", "Pilot lost the radio due to corroded wiring.", ["Pilot lost the radio due to corroded wiring."]),
    ("I lost the radio. It was probably corroded wiring.", "Pilot lost the radio due to corroded wiring.", []),
    ("I lost the radio.", "Dogs bark loudly. Pilot lost the radio.", []),
    ("I lost the radio. I hit a fence. The radio failed again.", "Lost the radio. Pilot hit a fence. The radio failed again.", ["Lost the radio.", "Pilot hit a fence."]),
    ("I lost the radio.", "High altitude airport pilot lost the radio.", []),
    ("I lost the radio.", "The pilot would have lost the radio.", []),
    ("I lost the radio.", "", []),
    (None, None, []),
]


def test_synopses(spark):
    df = spark.createDataFrame([(i, n, s) for i, (n, s, _) in enumerate(SYNOPSES)], "i int, narrative string, synopsis string").orderBy("i")
    got = supported_synopsis(df, "synopsis", "narrative").collect()
    assert [r["supported"] for r in got] == [x[2] for x in SYNOPSES]


@pytest.mark.parametrize("text", ["", "text with <tags>"])
def test_prompt(spark, text):
    system, user = spark.createDataFrame([(text,)], "s string").select(b.prompt(F.col("s"))).first()[0]
    assert (system["role"], user["role"]) == ("system", "user") and user["content"].endswith(f"<narrative>\n{text}\n</narrative>")
