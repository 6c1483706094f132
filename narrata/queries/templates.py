"""Raw reports made of the events table: one report per event, in one of twelve templates that exercise the rules.

The event's id stands for ``@@``. Each template carries what the rules must find in it, written by hand; the SQL of
the queries states that as literals, so it shares nothing with the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.plans.spread import spread
from narrata.queries import table

INPUT = ("narrative", "synopsis", "phase", "factor", "contributors", "human_factors", "reporter_function")
NO, NO_LESSON = "None stated", "None stated."

TEMPLATES = [
    {
        "narrative": "I was flying on trip @@ when fog covered the field. We nearly hit a truck at the end of the runway. I went around and climbed to 3,000 feet. The crew was tired and the display failed. Next time pilots should brief the missed approach early.",
        "synopsis": "Captain reported the display failed in fog on a small Cessna.",
        "phase": "Final Approach;Landing", "factor": "Weather", "contributors": "Weather", "human_factors": "Fatigue; Human-Machine Interface", "reporter_function": "Captain",
        "supported": "Reporter reported the display failed in fog on an aircraft.", "near": "We nearly hit a truck at the end of the runway.",
        "label": "Yes", "evidence": "I went around and climbed to 3,000 feet.", "lesson": "Next time pilots should brief the missed approach early.",
        "found": ["tired", "display", "fog"], "phase_of_flight": "Approach", "primary_factor": "Weather", "reason": None,
    },
    {
        "narrative": "On trip @@ the runway was wet and the brakes were weak. The aircraft slid off the side of the runway and stopped. Nobody was hurt. We called the tower and waited for the tug to arrive. Airport crews should clear the water from the runway before each landing.",
        "synopsis": "The aircraft slid off the runway and the brakes were weak. Two people were hurt at 300 feet.",
        "phase": "Landing", "factor": "Human Factors", "contributors": "Weather;Airport", "human_factors": None, "reporter_function": "Captain",
        "supported": "The aircraft slid off the runway and the brakes were weak.", "near": NO,
        "label": "No", "evidence": "The aircraft slid off the side of the runway and stopped.", "lesson": "Airport crews should clear the water from the runway before each landing.",
        "found": [], "phase_of_flight": "Landing", "primary_factor": "Human", "reason": None,
    },
    {
        "narrative": "I was working the local position on case @@. I failed to hold a departure short and two jets lost separation. I stopped the second jet before the runway. My supervisor took over and I was relieved. I would recommend that the tower add a second person at night.",
        "synopsis": "Local Controller reported two jets lost separation due to a failed hold short.",
        "phase": "", "factor": "Human Factors", "contributors": None, "human_factors": "Situational Awareness", "reporter_function": "Ground;Local",
        "supported": "Reporter reported two jets lost separation due to a failed hold short.", "near": NO,
        "label": "Unknown", "evidence": "", "lesson": "I would recommend that the tower add a second person at night.",
        "found": [], "phase_of_flight": "Unknown", "primary_factor": "ATC", "reason": None,
    },
    {
        "narrative": "We saw smoke in the cabin on trip @@ and I am not sure where it came from. The crew declared an emergency and returned to the gate. The smoke went away after the engine was shut down. Mechanics looked at the engine and the ducts for two days and found a small oil leak near the seal.",
        "synopsis": "Crew reported smoke in the cabin and returned to the gate.",
        "phase": "Cruise", "factor": "Aircraft", "contributors": "Aircraft", "human_factors": "Confusion", "reporter_function": None,
        "supported": "", "near": NO, "label": "Yes", "evidence": "The crew declared an emergency and returned to the gate.", "lesson": NO_LESSON,
        "found": [], "phase_of_flight": "Cruise", "primary_factor": "Equipment", "reason": "drop_unsupported_synopsis",
    },
    {
        "narrative": "We stopped the push on trip @@. It was fine.", "synopsis": "Tug hit a sign.",
        "phase": "Parked", "factor": "Moon", "contributors": None, "human_factors": None, "reporter_function": None,
        "supported": "", "near": NO, "label": "Unknown", "evidence": "", "lesson": NO_LESSON,
        "found": [], "phase_of_flight": "Parked / ramp", "primary_factor": "Unknown", "reason": "drop_short_narrative",
    },
    {
        "narrative": "The tug crew on trip @@ pushed us back with the door open. The wing tip hit the hangar and the door was bent. I was rushed and I did not notice the sign. We should have waited for the second wing walker. Crews must not rush a push back when the ramp is full of carts, and they need to slow down.",
        "synopsis": None,
        "phase": "Moon;Taxi", "factor": None, "contributors": None, "human_factors": "Time Pressure;Situational Awareness", "reporter_function": "Captain",
        "supported": "", "near": NO, "label": "No", "evidence": "The wing tip hit the hangar and the door was bent.",
        "lesson": "Crews must not rush a push back when the ramp is full of carts, and they need to slow down.",
        "found": ["rushed", "did not notice"], "phase_of_flight": "Other", "primary_factor": "Unknown", "reason": "drop_no_supervision",
    },
    {
        "narrative": "On trip @@ the landing gear warning came on while we were low. We climbed and ran the list with the help of the company. The gear came down after the second try and we landed safely. Maintenance found a failed switch and changed it that day. The rest of the trip was normal and on time.",
        "synopsis": "Landing gear warning came on while low and maintenance found a failed switch.",
        "phase": "Go Around", "factor": "Procedure", "contributors": None, "human_factors": None, "reporter_function": None,
        "supported": "Landing gear warning came on while low and maintenance found a failed switch.", "near": NO,
        "label": "Yes", "evidence": "The gear came down after the second try and we landed safely.", "lesson": NO_LESSON,
        "found": [], "phase_of_flight": "Go-around", "primary_factor": "Procedure", "reason": "drop_grounding",
    },
    {
        "narrative": "We lost the left engine on trip @@ during the climb. I believe corroded wiring was the cause. The engine failed at once and we diverted to a field near the coast. The company sent a van and we flew home the next day. It was a long day for all of us and the people in the back.",
        "synopsis": "Left engine failed due to corroded wiring.",
        "phase": "Initial Climb", "factor": "Equipment / Tooling", "contributors": None, "human_factors": None, "reporter_function": None,
        "supported": "", "near": NO, "label": "Yes", "evidence": "The engine failed at once and we diverted to a field near the coast.", "lesson": NO_LESSON,
        "found": [], "phase_of_flight": "Climb", "primary_factor": "Equipment", "reason": "drop_unsupported_synopsis",
    },
    {
        "narrative": "The Captain was flying trip @@ and he missed a turn at Gate B7. I called TCAS traffic and the Captain turned back. ATC gave us the wrong runway and we corrected the error. The company manual must be clear about this turn. I was confused by the chart and the lights, and the ramp was dark and wet at that hour.",
        "synopsis": "Captain reports a wrong runway and an incorrect turn at Gate B7.",
        "phase": "Taxi", "factor": "Human Factors", "contributors": None, "human_factors": "Confusion", "reporter_function": "First Officer",
        "supported": "Reporter reports a wrong runway and an incorrect turn at Gate B7.", "near": NO,
        "label": "Yes", "evidence": "ATC gave us the wrong runway and we corrected the error.", "lesson": "The company manual must be clear about this turn.",
        "found": ["confused"], "phase_of_flight": "Taxi", "primary_factor": "ATC", "reason": None,
    },
    {
        "narrative": "On trip @@ the panel departed the airplane in flight at 4,500 feet. We heard a bang and felt a bump but the airplane flew well. We landed without incident and looked at the hole. The mechanics put on a new panel and a new latch. Operators need to inspect the latch more often than once a year.",
        "synopsis": "B737-800 crew reported an engine fire at 4500 feet.",
        "phase": "Cruise;Descent", "factor": "Software and Automation", "contributors": "Weather", "human_factors": None, "reporter_function": None,
        "supported": "", "near": NO, "label": "No", "evidence": "On trip @@ the panel departed the airplane in flight at 4,500 feet.",
        "lesson": "Operators need to inspect the latch more often than once a year.",
        "found": [], "phase_of_flight": "Cruise", "primary_factor": "Equipment", "reason": "drop_unsupported_synopsis",
    },
    {
        "narrative": "I was the First Officer on trip @@ in a PA28 with a student. We missed a call and the tower issued a conflicting heading. I regained control after a hard turn and we landed safely. We talked about it with the tower by phone. In hindsight I was overloaded with the radio, the chart and the new screen.",
        "synopsis": "First Officer reported a conflicting heading and a missed call with a student in a PA28.",
        "phase": "Initial Approach", "factor": "Human Factors", "contributors": "Procedure", "human_factors": "Workload", "reporter_function": "First Officer",
        "supported": "Reporter reported a conflicting heading and a missed call with a student in a PA28.", "near": NO,
        "label": "Yes", "evidence": "I regained control after a hard turn and we landed safely.", "lesson": "In hindsight I was overloaded with the radio, the chart and the new screen.",
        "found": ["overloaded"], "phase_of_flight": "Approach", "primary_factor": "ATC", "reason": None,
    },
    {
        "narrative": "The dispatcher sent trip @@ with the wrong fuel load. We saw it at the gate and asked for more. The fuel truck driver said that we should wait for the next load. The delay was one hour and we left with the right load. The system was slow that day and two other crews had the same kind of problem with it.",
        "synopsis": None,
        "phase": None, "factor": "ATC", "contributors": "Staffing", "human_factors": "Training / Qualification", "reporter_function": None,
        "supported": "", "near": NO, "label": "Unknown", "evidence": "", "lesson": NO_LESSON,
        "found": [], "phase_of_flight": "Unknown", "primary_factor": "ATC", "reason": "drop_unsupported_synopsis",
    },
]


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, k, report_id, the coded fields and texts, related_id) of every event. One id in 97 is blank, and ids
    that end in nine repeat the one before."""
    each = [F.struct(F.lit(k).alias("k"), *(F.lit(t[c]).cast("string").alias(c) for c in INPUT)) for k, t in enumerate(TEMPLATES)]
    rows = spark.range(1).select(F.inline(F.array(*each)))
    e = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        e.alias("pos"), (e % len(TEMPLATES)).cast("int").alias("k"),
        F.when(e % 97 == 0, " ").when(e % 10 == 9, (e - 1).cast("string")).otherwise(e.cast("string")).alias("report_id"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("See "), (F.col("user_id") + 100000).cast("string"), F.lit(" and 12345 or "), (F.col("user_id") + 99990000).cast("string"))).alias("related_id"),
    )
    df = spread(events).join(F.broadcast(rows), "k")  # a row for each template
    return df.withColumn("narrative", F.replace("narrative", F.lit("@@"), F.col("pos").cast("string")))


def quoted(value) -> str:
    return "null" if value is None else "'" + str(value).replace("'", "''") + "'"


def reports_sql(*expected: str) -> str:
    """Common table expressions: ``n`` like ``reports``, with ``expected`` columns of the templates."""
    columns = (*INPUT, *expected)
    rows = ", ".join(f"({k}, {', '.join(quoted(t[c]) for c in columns)})" for k, t in enumerate(TEMPLATES))
    filled = ", ".join(f"replace({c}, '@@', event_id::varchar) as {c}" for c in columns)
    return f"""t(k, {', '.join(columns)}) as (values {rows}),
        n as (select event_id as pos, t.k, case when event_id % 97 = 0 then ' ' when event_id % 10 = 9 then (event_id - 1)::varchar else event_id::varchar end as report_id,
                     case when user_id % 5 = 0 then 'See ' || (user_id + 100000) || ' and 12345 or ' || (user_id + 99990000) end as related_id, {filled}
              from events join t on event_id % {len(TEMPLATES)} = t.k)"""


def gold_text(t: dict) -> str:
    """The brief of a template, written out."""
    note = "" if not t["evidence"] else "\n" + t["evidence"]
    bullets = "\n".join("- " + x for x in t["found"]) or NO
    return f"What happened:\n{t['supported']}\n\nWhat almost happened:\n{t['near']}\n\nPhase of flight:\n{t['phase_of_flight']}\n\nPrimary factor:\n{t['primary_factor']}\n\nContributing factors:\n{bullets}\n\nRecoverable:\n{t['label']}{note}\n\nLesson:\n{t['lesson']}"


for _t in TEMPLATES:
    _t["phrases"] = "; ".join(_t["found"])
    _t["written"] = gold_text(_t) if _t["supported"] else None
