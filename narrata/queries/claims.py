"""Event claims by rules that are rows. The SQL has its own patterns, written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators import claims
from narrata.plans.storage import fresh_path
from narrata.queries.templates import quoted, reports, reports_sql

#: What a report's output says, by its place: claims of every class, words that only look like one, and none.
SAID = (
    "It was a near miss.", "Two near-misses in one day.", "We nearly missed the turn.", "A near midair was filed.", "An NMAC report followed.", "A near collision with a drone.",
    "There was a loss of separation.", "A separation error was logged.", "Separation was lost at once.", "Separation anxiety is no event.", "It was a runway incursion.", "Runway incursions are rare.",
    "A runway excursion at dusk.", "The excursion was short.", "We had an engine failure.", "The engine failed.", "It was a hard landing.", "Landing was hard.", "A bird strike on climb.", "A birdstrike on final.",
    "The bird was struck.", "A tail strike was found.", "A tailstrike was found.", "The propeller strike bent a blade.", "A prop strike.", "Fire in the galley.", "Firearms were stowed.", "Smoke came in.", "Smokey haze.",
    "We did a go-around.", "We had to go around again.", "A rejected takeoff.", "The RTO was late.", "The crew declared an emergency.", "They declared emergency fuel.", "We diverted.", "A diversion took an hour.", "Diverting was planned.",
    "Fatigue played a part.", "An injury was seen.", "Two were injured.", "An injurious fall.", "Wake turbulence hit us.", "CFIT was near.", "It was night.", "At nighttime we left.", "A knight passed.", "Icing built up.", "The icing and deicing.",
    "Fog came in.", "Foggy all day.", "Thunderstorms were near.", "A thunderstorm passed.", "Snow fell.", "Snowy roads.", "A crosswind gust.", "Cross winds were strong.", "Wind shear on final.", "Windshear on final.", "Some turbulence.", "FOG, SNOW and FIRE.", "Nothing happened.",
)


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, narrative, output): reports, and an output for each that claims something or nothing."""
    lines = F.array(*map(F.lit, SAID))
    return reports(spark, sf_dir).select("pos", "narrative", F.get(lines, (F.col("pos") % len(SAID)).cast("int")).alias("output"))


def rules(spark: SparkSession) -> DataFrame:
    """The pack's rules as they come back from a table that also has an older version, with one rule."""
    path = fresh_path(spark, "rules")
    claims.write_rules(claims.rule_table(spark, (("night", r"\bnight\b", r"dark"),), version=1), path)
    claims.write_rules(claims.rule_table(spark), path)
    return claims.read_rules(spark, path)


def claim_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that each output claims, a row for each."""
    return claims.claim_matches(said(spark, sf_dir), rules(spark), ["pos"], "output").select("pos", "class")


def claims_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By class: outputs that claim it, and those whose narrative has evidence."""
    found = claims.claim_matches(said(spark, sf_dir), rules(spark), ["pos"], "output", "narrative")
    return found.groupBy("class").agg(F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"))


#: class, claim and evidence for DuckDB, written out anew.
PATTERNS = (
    ("near miss", r"\b(near[- ]miss|near[- ]misses|nmac|near[- ]collision)\b|\bnear mid[- ]?air\b", "near[- ]?miss|mid[- ]?air|nmac|near[- ]collision|close call|almost|nearly|evasive|too close|very close|collision|collid"),
    ("loss of separation", r"\b(loss of separation|separation loss|separation error|separation was lost)\b", "separation|less than|closer than|within [0-9]|miles? (apart|from|of)|feet (apart|from|of|vertical|lateral)"),
    ("runway incursion", r"\brunway incursion\b", "incursion|(onto|entered|crossed|across|into) ((the|an|a) )?((active|wrong) )?runway|hold short|runway without"),
    ("runway excursion", r"\brunway excursion\b", "excursion|off the (runway|side|end)|departed the runway|ran off|left the (runway|pavement)|into the grass"),
    ("engine failure", r"\bengine failure\b", "engine (fail|quit|stop|flame|loss|out|problem|trouble)|lost ((the |an |#?[0-9] ))?engine|power loss|loss of power|dead engine"),
    ("hard landing", r"\bhard landing\b", "hard landing|landed hard|hard touchdown|firm landing|bounced|g[- ]?load|g[- ]?force"),
    ("bird strike", r"\bbird ?strike\b", "bird|goose|geese|wildlife|hawk|gull|duck|vulture"),
    ("tail strike", r"\btail ?strike\b", "tail ?strike|tail struck|tail (contact|scrap|hit)|struck the tail|tail skid"),
    ("prop strike", r"\b(prop|propeller) strike\b", "prop"), ("fire", r"\bfire\b", "fire|flame|burn"), ("smoke", r"\bsmoke\b", "smoke|fume|odor|smell|haze"),
    ("go-around", r"\bgo[- ]around\b", "go[- ]around|went around|missed approach"), ("rejected takeoff", r"\b(rejected takeoff|rto)\b", "reject|abort|rto"),
    ("declared emergency", r"\bdeclared an emergency\b", "emergency|declar|mayday|pan[- ]pan|priority"), ("diversion", r"\b(diverted|divertion)\b", "divert|alternate"),
    ("fatigue", r"\bfatigue\b", r"fatigue|tired|exhaust|sleep|rest\b|duty day"), ("injury", r"\b(injury|injuries|injured)\b", "injur|hurt|medical|paramedic|wound"),
    ("wake turbulence", r"\bwake turbulence\b", "wake"), ("CFIT", r"\bcfit\b", "cfit|terrain|gpws|pull up"), ("night", r"\b(night|nighttime)\b", "night|dark|evening|dusk|sunset|hours of darkness"),
    ("icing", r"\bicing\b", r"\b(ice|icing|iced)\b|frost|rime|anti-?ice|de-?ice"), ("fog", r"\bfog\b", "fog|mist|visibility"), ("thunderstorm", r"\bthunderstorm[a-z0-9_]*\b", "storm|convective|lightning|cell"),
    ("snow", r"\bsnow\b", "snow|slush|winter|blizzard"), ("crosswind", r"\bcross[- ]?winds?\b", "wind"), ("wind shear", r"\bwind ?shear\b", "shear|microburst|gust"), ("turbulence", r"\bturbulence\b", "turbulen|chop|bump|rough air|jolt"),
)
CLAIMED = f"""{reports_sql()}, said(i, output) as (values {", ".join(f"({i}, {quoted(s)})" for i, s in enumerate(SAID))}),
        c(class, claim, evidence) as (values {", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(e)})" for a, b, e in PATTERNS)}),
        m as (select pos, class, regexp_matches(narrative, evidence, 'i') as supported from n join said on n.pos % {len(SAID)} = i join c on regexp_matches(output, claim, 'i'))"""

QUERIES = {"claim_matches": claim_matches, "claims_supported": claims_supported}
ORACLES = {
    "claim_matches": f"with {CLAIMED} select pos, class from m",
    "claims_supported": f"with {CLAIMED} select class, count(*) as n_claims, count(*) filter (where supported) as n_supported from m group by 1",
}
