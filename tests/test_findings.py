"""What the findings of a round showed, on tables made for it."""

import hashlib

from pyspark.sql import functions as F

from narrata import registry
from narrata.functions import brief, rules, synopsis
from narrata.functions.grounding import Source, grounding_flags, with_source
from narrata.functions.patterns import by_letter
from narrata.operators import curate, scoring
from narrata.packs import fixed
from narrata.queries.scores import outputs
from narrata.queries.splits import split_rows
from narrata.queries.templates import reports
from tests.compare import of_duckdb, of_spark


def test_texts_beyond_ascii_as_in_sql(spark, tmp_path):
    asked = "Pages 5–10 of ٣ books, STRAßE 7½, 4,500 and ÉCAM; ÁB"
    told = "Page 10, 5 and ٣5, 12–13, 45;00, STRASSE, CAM’S ATC, ILS—VOR, x\U0001f600\U0001f6007 AB-1"
    rows = [(1, 0, "user", asked), (1, 1, "assistant", told), (2, 0, "user", told), (2, 1, "assistant", asked), (3, 4, "user", None), (3, 5, "assistant", told)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("answer_grounding", "number_tokens", "acronym_tokens"):
        assert of_spark(registry.QUERIES[name](spark, str(tmp_path))) == of_duckdb(registry.ORACLES[name], str(tmp_path)), name


def test_scores_of_prepared_rows(spark, sf):
    """Gold and narrative are read once a report, before its rows are doubled; the scores are those of bare rows."""
    rows = outputs(spark, sf).where("cast(report_id as long) < 40")
    assert {"gold", "gold_error", *scoring.EVIDENCE} <= set(rows.columns)
    bare = rows.drop("gold", "gold_error", *scoring.EVIDENCE)
    assert of_spark(scoring.score(rows)) == of_spark(scoring.score(bare))


def test_alternatives_before_a_lookahead_go_by_letter():
    p = r"\b(?:Small|Light|Large)(?=\s+crew\b)"
    assert by_letter(p) == r"(?=[ls])\b(?:(?=[l])(?:Light|Large)|(?=[s])(?:Small))(?=\s+crew\b)"
    assert by_letter(r"\b(?:Boeing|baron)\b", True) == r"(?=[Bb])\b(?:(?=[B])(?:Boeing)|(?=[b])(?:baron))\b"
    assert by_letter(r"\b(?:ab|cd)+x") != by_letter(r"\b(?:ab|cd)x").replace("x", "+x")


def test_flags_of_one_kind_read_one_part_of_the_source(spark):
    row = with_source(spark.createDataFrame([("Fog at Gate B7, 300 feet.",)], "t string"), "t", kinds=("events",)).first()
    assert (row["source_low"], row["source_numbers"], row["source_tokens"], row["source_text"]) == ("fog at gate b7, 300 feet.", None, None, None)


def test_no_rule_is_tried_where_no_synopsis_is_supported(spark, monkeypatch):
    """Rules that would call every report a lesson see no sentence of a narrative whose synopsis is not supported."""
    seen = []
    monkeypatch.setattr(brief.rules, "lesson", lambda parts, *other: seen.append(parts) or F.concat_ws("|", parts))
    rows = [("The panel was lost. It was dark.", "The panel was lost."), ("The panel was lost. It was dark.", "The engine failed.")]
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], "narrative string, synopsis string, phase string, factor string, contributors string, human_factors string, reporter_function string")
    marked = brief.gold(df)
    held = [r["p"] for r in marked.select("supported", seen[0].alias("p")).orderBy(F.size("supported").desc()).collect()]
    assert held == [["The panel was lost.", "It was dark."], []]


def test_texts_are_hashed_once_for_a_split(spark, sf):
    assert not [f for f in split_rows(spark, sf).inputFiles() if "documents" in f]


def test_a_step_of_the_synopsis_is_written_once(spark):
    """Each step names its text more than once; nested unbound, the steps before it were written nine times."""
    df = spark.range(1).select(synopsis.generalise_types(F.concat(F.lit("only-here "), F.col("id").cast("string")), F.lit("")).alias("t"))
    assert df._jdf.queryExecution().analyzed().toString().count("only-here") == 1


def test_numbers_and_tokens_are_read_from_the_text_where_an_output_has_some(spark):
    rows = [("Fog at Gate B7, 3,000 feet, TCAS.", "We had 3000 feet, 5 miles, TCAS and RA at Gate B7."), ("Fog.", "Fog."), (None, "At 7 NMAC."), ("ILS 9.", None)]
    df = spark.createDataFrame(rows, "t string, o string")
    flags = lambda df: [tuple(r) for r in df.select(grounding_flags(Source.named("source"), F.col("o")).alias("f")).select("f.*").collect()]
    assert flags(with_source(df, "t", kinds=("events", "designators"))) == flags(with_source(df, "t")) != [([], [], [], [])] * 4


def test_an_output_that_is_its_gold_brief_is_not_parsed_again(spark, sf, monkeypatch):
    rows = outputs(spark, sf).where("cast(report_id as long) < 40")
    whole, parse = of_spark(scoring.score(rows.withColumn("gold_text", F.concat("gold_text", F.lit("\n"))))), brief.parse  # no output is this text
    seen = []
    monkeypatch.setattr(brief, "parse", lambda df, text, *names: seen.append(df.select("model", F.col(text).alias("t"), "text", "gold_text")) or parse(df, text, *names))
    assert of_spark(scoring.score(rows)) == whole
    assert seen[0].where("t is null").count() == seen[0].where("text = gold_text").count() > 0
    assert seen[0].where("t <> text").count() == 0 and len(seen) == 1


def test_no_sentence_behind_the_first_that_counts_is_looked_at(spark, monkeypatch):
    """A rule that fails on what need not be read: sentences behind an event, before a lesson, behind a near miss."""
    seen = lambda s: F.when(s == "Unread.", F.raise_error(F.lit("read")).cast("boolean")).otherwise(s.startswith("Told"))
    monkeypatch.setattr(rules, "unnegated", lambda s, pattern: seen(s))
    monkeypatch.setattr(rules, "without_labels", lambda s: F.when(s.startswith("We should never"), F.raise_error(F.lit("read"))).otherwise(s))
    df = spark.createDataFrame([(["So.", "Told.", "Unread."], ["We should never read.", "Next time we should all slow down."])], "a array<string>, b array<string>")
    row = df.select(rules.recoverable(F.col("a")).alias("o"), rules.near_miss(F.col("a"), F.lit("")).alias("n"), rules.lesson(F.col("b")).alias("l")).first()
    assert (row["o"]["evidence"], row["n"], row["l"]) == ("Told.", "Told.", "Next time we should all slow down.")


def test_narratives_are_read_only_for_synopses_that_can_be_supported(spark):
    told = "The panel was lost."
    rows = [(told, told), (told, None), (told + " I am not sure.", told), ("I believe it. " + told, told)]
    got = synopsis.supported_synopsis(spark.createDataFrame(rows, "narrative string, synopsis string").coalesce(1), "synopsis", "narrative").collect()
    assert [r["supported"] for r in got] == [[told], [], [], [told]]
    assert [r["source_words"] for r in got] == [["panel", "lost"], None, None, ["believe", "panel", "lost"]]
    assert [r["source_parts"] for r in got] == [None, None, None, ["I believe it.", told]]


def test_hashes_are_taken_of_eligible_rows_only(spark):
    """The hash is taken behind the last rule, of the whole narrative though it was cut; the length is that of the messages."""
    text = "The panel was lost. " + "We flew on for a day. " * 20
    rows = [(0, "a", text, "The panel was lost.", "Weather"), (1, "b", " \t" + text.replace("a day", "a\x85 day") + text, "The panel was lost.", "Weather")]
    df = spark.createDataFrame(rows, "pos long, report_id string, narrative string, synopsis string, factor string")
    df = df.select("*", *(F.lit(None).cast("string").alias(c) for c in ("phase", "contributors", "human_factors", "reporter_function", "related_id")))
    got = curate.eligible(curate.curate(df, narrative_chars=600))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("AS narrative_sha256") < plan.index("Generate inline")
    want = {i: hashlib.sha256(" ".join(t.lower().replace("\x85", " ").split()).encode()).hexdigest() for _, i, t, *_ in rows}
    assert {r["report_id"]: (r["narrative_sha256"], r["truncated"], r["token_count"]) for r in got.collect()} == {
        r["report_id"]: (want[r["report_id"]], r["report_id"] == "b", sum(len(m["content"]) for m in r["messages"])) for r in got.collect()
    }


def test_prompts_are_not_written_to_be_counted(spark, sf):
    plan = curate.funnel(curate.curate(reports(spark, sf)))._jdf.queryExecution().optimizedPlan().toString()
    assert fixed.SYSTEM_PROMPT[:20] not in plan and "sha2(" not in plan
