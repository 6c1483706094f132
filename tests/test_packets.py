"""What people read of an evaluation, and where narratives and settings come from."""

import io

import pytest
from pyspark.sql import functions as F

from narrata.functions.brief import FIELDS, render
from narrata.operators import checkpoints, packets
from narrata.plans import build
from narrata.sources import files


def brief_of(lesson):
    values = {"what_happened": "The panel was lost.", "what_almost_happened": "None stated", "phase_of_flight": "Cruise", "primary_factor": "Human", "recoverable": "Unknown", "recoverable_note": "", "lesson": lesson}
    return F.struct(*(F.array().cast("array<string>").alias(k) if k == "contributing_factors" else F.lit(values[k]).alias(k) for k in FIELDS))


def test_packets_of_an_evaluation(spark):
    ids = spark.range(30).select(F.format_string("r%02d", "id").alias("report_id"))
    rows = ids.select("report_id", F.lit("The panel was lost. Crews should look at the panel.").alias("narrative"), render(brief_of("Crews should look at the panel.")).alias("gold_text"), F.lit(False).alias("near_miss_gold"))
    bad = F.when(F.col("report_id") > "r25", "raw text with 4711 in it").otherwise(render(brief_of("Crews should look at the panel.")))
    side = lambda text: F.struct(text.alias("text"), F.lit(60).alias("tokens"))
    told = ids.select("report_id", side(F.lit("nothing")).alias("base"), side(bad).alias("adapter"))
    rows, told = (spark.createDataFrame(df.collect(), df.schema) for df in (rows, told))
    scores, table, gates = build.evaluate(rows, told)
    rubric = packets.rubric_packet(rows, told, scores, n=5).orderBy("rank").collect()
    sampled, failed = [r["key"] for r in rubric[:5]], {"r26", "r27", "r28", "r29"}
    assert [r["rank"] for r in rubric] == list(range(1, len(rubric) + 1)) and {r["key"] for r in rubric[5:]} == failed - set(sampled)
    assert all("### Narrative" in r["block"] and "### Output" in r["block"] for r in rubric)
    lessons = packets.lesson_packet(rows, told).collect()
    assert len(lessons) == 30 and all((packets.INVALID in r["block"]) == (r["key"] in failed) for r in lessons)
    assert [r["key"] for r in sorted(packets.lesson_packet(rows, told, n=5).collect(), key=lambda r: r["rank"])] != sampled
    lines = [r["line"] for r in packets.report_lines(table, gates).orderBy("place", "line").collect()]
    assert lines[1] == "N = 30" and "| recoverable_known_acc | N/A | N/A |" in lines and "| median_tokens | 60.000 | 60.000 |" in lines and lines[-1].startswith("**") and len(lines) == 5 + 11 + 2


def test_sources_of_narratives(spark, tmp_path):
    (tmp_path / "a.txt").write_text("We left.\n")
    (tmp_path / "b.jsonl").write_text('{"id": "x", "narrative": "We left."}\n{"narrative": "We came."}\n')
    (tmp_path / "c.jsonl").write_text('{"id": "x", "narrative": " "}\n')
    one = lambda **k: [r["narrative"].strip() for r in files.narratives_of(spark, **k).collect()]
    assert one(text="We left.") == one(file=f"file://{tmp_path}/a.txt") == one(stdin=io.StringIO("We left.")) == ["We left."]
    assert one(batch=f"file://{tmp_path}/b.jsonl") == ["We left.", "We came."]
    for bad in ({}, {"text": "a", "file": "b"}, {"text": " "}, {"batch": f"file://{tmp_path}/c.jsonl"}):
        with pytest.raises(ValueError):
            files.narratives_of(spark, **bad)


def test_settings_of_saved_weights():
    saved = {"model_id": "m", "model_revision": "1", "narrative_tokens": 5, "max_seq_length": 9, "seed": 1}
    assert checkpoints.settings_for(saved, None) == saved and checkpoints.settings_for(None, saved) == saved
    assert checkpoints.settings_for(saved, saved | {"seed": 2})["seed"] == 2
    for key in checkpoints.BOUND_SETTINGS:
        with pytest.raises(ValueError, match=key):
            checkpoints.settings_for(saved, saved | {key: "other"})
    with pytest.raises(ValueError, match="No saved"):
        checkpoints.settings_for(None, None)
