"""Reports: codes, evidence rules, synopses, briefs, grounding, curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import brief as briefs
from narrata.functions import codes, rules
from narrata.functions import synopsis as syn
from narrata.functions.grounding import Source, any_flag, grounding_flags, with_source
from narrata.functions.text import designators, sentences
from narrata.operators import curate
from narrata.packs import fixed
from narrata.queries.templates import quoted, reports, reports_sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def expected(columns: str, *needed: str) -> str:
    return f"with {reports_sql(*needed)} select pos, {columns} from n"


FIRST = """trim(report_id) as rid, row_number() over (partition by trim(report_id) order by pos) as copy"""
CHEAP = """case when rid = '' then 'drop_missing_id' when copy > 1 then 'drop_duplicate_id' when length(narrative) < 200 then 'drop_short_narrative'
        when coalesce(synopsis, '') = '' and coalesce(factor, '') = '' then 'drop_no_supervision'"""


CHEAP_FUNNEL = f"with {reports_sql()}, c as (select *, {FIRST} from n) select coalesce({CHEAP} end, 'passed') as drop_reason, count(*) as n_rows from c group by 1"


@query(CHEAP_FUNNEL)
def cheap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by the first of the filters that need no extraction."""
    df = curate.cheap_reasons(reports(spark, sf_dir), "pos")
    return df.groupBy(F.coalesce("drop_reason", F.lit("passed")).alias("drop_reason")).agg(F.count("*").alias("n_rows"))


@query(f"with {reports_sql()}, c as (select *, {FIRST} from n) select pos, rid as report_id, copy > 1 as repeated from c where rid <> ''")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an earlier row has a report's id."""
    df = curate.cheap_reasons(reports(spark, sf_dir), "pos").where("report_id <> ''")
    return df.select("pos", "report_id", (F.coalesce("drop_reason", F.lit("")) == "drop_duplicate_id").alias("repeated"))


REASONED = f"""with {reports_sql("reason", "written", "label", "near")}, c as (select *, {FIRST} from n),
        r as (select *, {CHEAP} else reason end as drop_reason from c)"""


@query(f"{REASONED} select coalesce(drop_reason, 'kept') as drop_reason, count(*) as n_rows from r group by 1")
def curate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by the first of all filters, through the whole curation."""
    return curate.funnel(curate.curate(reports(spark, sf_dir)))


@query(f"""{REASONED} select rid as report_id, written as gold_text, label = 'No' as recovery_no_gold, near <> 'None stated' as near_miss_gold, false as truncated,
        sha256(trim(regexp_replace(lower(narrative), '\\s+', ' ', 'g'))) as narrative_sha256, array_to_string(regexp_extract_all(coalesce(related_id, ''), '\\b(\\d{{6,8}})\\b', 1), ',') as related from r where drop_reason is null""")
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated rows with their gold briefs."""
    rows = curate.eligible(curate.curate(reports(spark, sf_dir)))
    return rows.select("report_id", "gold_text", "recovery_no_gold", "near_miss_gold", "truncated", "narrative_sha256", F.array_join("related_ids", ",").alias("related"))


@query(f"""with {reports_sql()}, v as (select 'phase' as field, coalesce(phase, '') as value from n union all select 'factor', coalesce(factor, '') from n)
        select field, value, count(*) as n_rows from v group by all""")
def column_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.frequencies(reports(spark, sf_dir))


@query(expected(r"array_to_string(regexp_extract_all(coalesce(related_id, ''), '\b(\d{6,8})\b', 1), ',') as related"))
def related_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", F.array_join(curate.related_ids(F.col("related_id")), ",").alias("related"))


@query(expected("array_to_string(list_filter(list_transform(string_split(coalesce(human_factors, '') || ';' || coalesce(contributors, ''), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') as codes"))
def split_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(codes.split_codes(F.col("human_factors")), codes.split_codes(F.col("contributors")))
    return reports(spark, sf_dir).select("pos", F.array_join(both, "|").alias("codes"))


PHASES = """case trim(string_split(coalesce(phase, ''), ';')[1]) when '' then 'Unknown' when 'Parked' then 'Parked / ramp' when 'Taxi' then 'Taxi' when 'Initial Climb' then 'Climb' when 'Cruise' then 'Cruise'
        when 'Initial Approach' then 'Approach' when 'Final Approach' then 'Approach' when 'Landing' then 'Landing' when 'Go Around' then 'Go-around' else 'Other' end"""


@query(expected(f"{PHASES} as phase_of_flight"))
def map_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", codes.map_phase(F.col("phase")).alias("phase_of_flight"))


FACTORS = """case coalesce(factor, '') when 'Human Factors' then 'Human' when 'Weather' then 'Weather' when 'Procedure' then 'Procedure' when 'ATC' then 'ATC'
        when 'Aircraft' then 'Equipment' when 'Equipment / Tooling' then 'Equipment' when 'Software and Automation' then 'Equipment' else 'Unknown' end"""


@query(expected(f"{FACTORS} as primary_factor"))
def map_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", codes.map_factor(F.col("factor")).alias("primary_factor"))


@query(expected("primary_factor", "primary_factor"))
def atc_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return reports(spark, sf_dir).select("pos", codes.map_factor(c("factor"), c("narrative"), c("reporter_function")).alias("primary_factor"))


@query(expected("label as recoverable, evidence", "label", "evidence"))
def recoverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", rules.recoverable(sentences(F.col("narrative"))).alias("r")).select("pos", F.col("r.label").alias("recoverable"), "r.evidence")


@query(expected("near as near_miss", "near"))
def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", rules.near_miss(sentences(F.col("narrative")), F.lit("")).alias("near_miss"))


@query(expected("lesson", "lesson"))
def lesson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", rules.lesson(sentences(F.col("narrative"))).alias("lesson"))


@query(expected("phrases", "phrases"))
def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return reports(spark, sf_dir).select("pos", F.array_join(rules.contributors(c("narrative"), c("human_factors"), c("contributors")), "; ").alias("phrases"))


@query(expected(r"case when narrative ~ '.*' and regexp_matches(lower(narrative), '\b(went around|corrected the error|regained control|returned to the gate|landed safely|landed without incident|we diverted)\b') then true else false end as intervened"))
def unnegated_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a narrative tells of a successful intervention that nothing negates."""
    found = F.exists(sentences(F.col("narrative")), lambda s: rules.unnegated(s, rules.fixed.SUCCESS))
    return reports(spark, sf_dir).select("pos", found.alias("intervened"))


@query(expected("supported", "supported"))
def synopsis_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = syn.supported_synopsis(reports(spark, sf_dir), "synopsis", "narrative")
    return df.select("pos", F.array_join("supported", " ").alias("supported"))


ROLE_STEPS = """replace(replace(replace(replace(synopsis, 'Captain reported', 'reporter reported'), 'Local Controller reported', 'reporter reported'), 'Captain reports', 'reporter reports'), 'First Officer reported', 'reporter reported')"""


@query(expected(f"coalesce({ROLE_STEPS}, '') as told"))
def role_generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", syn.generalise_roles(F.coalesce("synopsis", F.lit("")), F.col("narrative")).alias("told"))


@query(expected("coalesce(replace(replace(synopsis, 'B737-800', 'aircraft'), 'Cessna', 'aircraft'), '') as told"))
def type_generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", syn.generalise_types(F.coalesce("synopsis", F.lit("")), F.col("narrative")).alias("told"))


@query(expected("coalesce(replace(replace(replace(synopsis, 'B737-800', 'aircraft'), 'Cessna', 'aircraft'), 'a small aircraft', 'an aircraft'), '') as told"))
def qualifier_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = syn.generalise_types(F.coalesce("synopsis", F.lit("")), F.col("narrative"))
    return reports(spark, sf_dir).select("pos", syn.tidy(syn.drop_qualifiers(named, F.col("narrative"))).alias("told"))


@query(expected("coalesce(synopsis not like '%due to corroded%' and (synopsis not like '%due to%' or narrative like '%failed to hold a departure short%'), true) as supported"))
def cause_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cause that a synopsis states is attested, and as more than a guess."""
    parts = sentences(F.col("narrative"))
    guess = lambda keep: F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda s: s.rlike(syn.rx(syn.fixed.HEDGE)) == F.lit(keep)), syn.content_words)))
    df = reports(spark, sf_dir).withColumns({"s": F.coalesce("synopsis", F.lit("")), "hedged": guess(True), "plain": guess(False)})
    only = F.filter(F.array_except("hedged", "plain"), lambda w: w.rlike(syn.rx(f"^(?:{syn.fixed.EVENT_WORDS})$")))
    return df.select("pos", syn.cause_ok(F.col("s"), syn.content_words(F.col("s")), syn.content_words(F.col("narrative")), F.col("hedged"), only).alias("supported"))


@query(expected("written as brief", "written"))
def brief_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered gold brief; null where the synopsis lacks support."""
    return briefs.gold(reports(spark, sf_dir)).select("pos", F.col("gold_text").alias("brief"))


#: What is done to a gold brief by ``pos % 8``, and the error that must follow.
BREAKS = [
    ("{0}", None),
    ("concat('Sure: ', {0})", "Unexpected, duplicated, or missing section heading"),
    ("concat('x', chr(10), {0})", "Expected exactly seven headings in the required order"),
    ("replace({0}, concat(chr(10), chr(10), 'Lesson'), concat(chr(10), 'Lesson'))", "Sections must have a blank line between them"),
    ("replace({0}, concat('factor:', chr(10)), concat('factor:', chr(10), 'Big '))", "Invalid phase or primary factor"),
    ("replace({0}, concat('Recoverable:', chr(10)), concat('Recoverable:', chr(10), 'Perhaps'))", "Invalid recoverable flag or justification"),
    ("concat({0}, ' Then more.')", "Lesson must be exactly one sentence"),
    ("replace({0}, concat('Contributing factors:', chr(10)), concat('Contributing factors:', chr(10), '* x', chr(10)))", "Contributing factors must be at most five bullets"),
]
BROKEN = "case pos % 8 " + " ".join(f"when {i} then {how.format('written')}" for i, (how, _) in enumerate(BREAKS)) + " end"
ERRORS = "case pos % 8 " + " ".join(f"when {i} then '{why}'" for i, (_, why) in enumerate(BREAKS) if why) + " end"


@query(f"with {reports_sql('written', 'label', 'phrases')} select pos, {ERRORS} as parse_error, case when pos % 8 = 0 then label end as recoverable, case when pos % 8 = 0 then phrases end as phrases from n where written is not null")
def brief_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold briefs, broken in seven ways, parsed strictly."""
    df = briefs.gold(reports(spark, sf_dir)).where("gold is not null").withColumn("broken", F.expr(BROKEN.replace("written", "gold_text")))
    return briefs.parse(df, "broken").select("pos", "parse_error", "brief.recoverable", F.array_join("brief.contributing_factors", "; ").alias("phrases"))


@query(f"with {reports_sql('written')} select pos, pos % 8 = 0 as valid from n where written is not null")
def brief_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an output passes, from its JSON envelope."""
    df = briefs.gold(reports(spark, sf_dir)).where("gold is not null").withColumn("broken", F.expr(BROKEN.replace("written", "gold_text")))
    out = briefs.parse(df, "broken").select("pos", briefs.envelope("brief", "parse_error", "broken").alias("o"))
    return out.select("pos", F.get_json_object("o", "$.raw_output").isNull().alias("valid"))


OUTPUT = "concat('At Gate C9 on trip ', {0}, ' of 7,500 feet the ECAM showed fire, fog and a bird strike at Gate B7 and ATC said 3000.')"
OUTPUT_SQL = OUTPUT.format("pos::varchar")


def flagged(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = with_source(reports(spark, sf_dir).withColumn("o", F.expr(OUTPUT.format("pos"))), "narrative", kinds=(kind,))
    flags = grounding_flags(Source.named("source"), F.col("o"))
    return df.select("pos", F.array_join(flags[kind], ";").alias(kind))


# the trip's own number supports 3000 or 7,500 on the two reports that have it
@query(expected("array_to_string(list_filter([case when narrative not like '%3,000%' and pos <> 3000 then '3000' end, case when pos <> 7500 then '7,500' end], lambda x: x is not null), ';') as numbers"))
def grounding_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir, "numbers")


@query(expected("case when narrative like '%B7%' then 'C9;ECAM' else 'B7;C9;ECAM' end as acronyms"))
def grounding_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir, "acronyms")


@query(expected("array_to_string(list_filter(['bird strike', 'fire', case when not regexp_matches(lower(narrative), 'fog|mist|visibility') then 'fog' end], lambda x: x is not null), ';') as events"))
def grounding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir, "events")


@query(expected("case when narrative like '%B7%' then 'Gate C9' else 'Gate B7;Gate C9' end as designators"))
def grounding_designators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir, "designators")


#: An output that claims every class of events.
ALL_CLAIMS = (
    "'A near miss, loss of separation, runway incursion, runway excursion, engine failure, hard landing, bird strike, tail strike, prop strike, fire, smoke, go-around, "
    "rejected takeoff, we declared an emergency, a diversion, fatigue, injuries, wake turbulence, CFIT, night, icing, fog, thunderstorms, snow, a crosswind, wind shear.'"
)
CLASSES = ", ".join(f"({quoted(name)}, {quoted(claim)}, {quoted(evidence)})" for name, claim, evidence in fixed.EVENT_CLASSES)


@query(f"with {reports_sql()}, c(name, claim, evidence) as (values {CLASSES}) select name as event_class, count(*) as n_rows from n join c on regexp_matches({ALL_CLAIMS}, claim, 'i') and not regexp_matches(narrative, evidence, 'i') group by 1")
def unsupported_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event classes, of all there are, that an output claims without support, counted."""
    df = with_source(reports(spark, sf_dir), "narrative")
    flags = grounding_flags(Source.named("source"), F.expr(ALL_CLAIMS))
    return df.select(F.explode(flags["events"]).alias("event_class")).groupBy("event_class").agg(F.count("*").alias("n_rows"))


@query(expected(r"array_to_string(list_distinct(regexp_extract_all(narrative, '\b(?:Taxiway|Runway|Gate|Ramp|Spot|Pad|Intersection)\s+[A-Z0-9][A-Z0-9-]{0,4}\b')), ';') as places"))
def designator_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("pos", F.array_join(F.transform(designators(F.col("narrative")), lambda d: F.concat_ws(" ", d["name"], d["token"])), ";").alias("places"))


@query(f"with {reports_sql('written')} select case when pos % 2 = 0 then 'Prompt drift' else 'Expected three messages' end as fault, count(*) as n_rows from n where written is not null group by 1")
def prompt_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows whose prompt was changed, or whose answer was doubled."""
    df = briefs.gold(reports(spark, sf_dir)).where("gold is not null")
    answer = F.array(F.struct(F.lit("assistant").alias("role"), F.col("gold_text").alias("content")))
    changed = F.concat(briefs.prompt(F.concat("narrative", F.lit("!"))), answer)
    df = df.withColumn("messages", F.when(F.col("pos") % 2 == 0, changed).otherwise(F.concat(briefs.prompt(F.col("narrative")), answer, answer)))
    return curate.drifted(df).groupBy("fault").agg(F.count("*").alias("n_rows"))


@query(f"with {reports_sql('written', 'reason')} select count(*) as n_rows, count(*) filter (written is not null and k <> 6) as grounded from n where written is not null")
def gold_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold briefs, and how many of them claim nothing that their narrative lacks."""
    df = briefs.gold(reports(spark, sf_dir)).where("gold is not null")
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~any_flag(grounding_flags(Source.named("source"), F.col("gold_text")))).alias("grounded"))
