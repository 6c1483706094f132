"""Whole runs: build a dataset, evaluate saved outputs, brief narratives. Each step writes a table that the next reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from narrata.operators import curate, generate, linkage, places, scoring
from narrata.plans import staged
from narrata.plans.storage import Workspace, fresh_path
from narrata.sources import files

DEFAULTS = {
    "version": "v03", "seed": 42, "train_size": 4000, "eval_size": 400, "oversample_near_miss": 3, "oversample_recovery_no": 3,
    "narrative_chars": 6000, "max_chars": 20000, "review_rows": 50,
}


def build(spark: SparkSession, source: str, out: str, license: str | None, config: dict | None = None, resume: str | None = None) -> DataFrame:
    """Raw reports (JSON lines) to splits below ``out``; returns the manifest.

    resume: a folder for the tables of the stages. A run that failed is taken up there after the last stage it finished, as
    long as the files of the source and the settings a stage depends on are the same; without it all is made anew.

    Writes train (with its oversampled copies), eval, reserve ids only, a sample, the column inventory, the rules,
    review packets and the manifest. Lines stand in the order of the paths of their files and of their places in these, so
    the first copy of an id is the first in that order, however Spark cuts and deals the files.
    """
    c = {**DEFAULTS, **(config or {})}
    work = Workspace(spark, "build")
    run = staged.StagedRun(spark, resume or fresh_path(spark, "build-run"))
    run.given("source", staged.listing_digest(spark, source))
    raw, mode = files.read_reports(spark, source, license, marked=True), "overwrite" if resume else "error"
    lines = run.stage("lines", lambda: raw, ("source",), {"license": license})
    reports = run.stage("reports", lambda: places.line_places(lines, "pos"), ("lines",))
    curate.frequencies(reports).write.mode(mode).json(f"{out}/column_inventory")
    curated = run.stage("curated", lambda: curate.curate(reports, "pos", c["narrative_chars"], c["max_chars"]), ("reports",), _some(c, "narrative_chars", "max_chars"))
    seen = Observation("split")

    def divided() -> DataFrame:
        return linkage.observed(linkage.group_split(curate.eligible(curated).drop("gold"), c["eval_size"], c["train_size"], c["seed"]), seen)

    fits = lambda: linkage.check_observed(seen, c["eval_size"], c["train_size"])
    split = run.stage("split", divided, ("curated",), _some(c, "eval_size", "train_size", "seed"), fits)
    if leak := linkage.leaks(split).orderBy("key", "value").limit(1).collect():
        raise ValueError(f"Evaluation leaked into training ({leak[0]['key']})")
    train, held = (split.where(F.col("split") == k).drop("split") for k in ("train", "eval"))
    more = linkage.oversample(train, {"near_miss_gold": c["oversample_near_miss"], "recovery_no_gold": c["oversample_recovery_no"]})
    digests = {}
    for name, rows in (("train", more), ("eval", held)):
        files.write_jsonl(rows, f"{out}/{name}", mode)
        digests[name] = files.dataset_digest(rows, *(("report_id", "gold_text", "copy") if name == "train" else ("report_id", "gold_text"))).first()["digest"]
        sample = linkage.seeded_sample(rows.dropDuplicates(["report_id"]), c["review_rows"], "report_id", c["seed"])
        files.packet(sample, narrative="narrative", gold="gold_text").orderBy("key").select("block").write.mode(mode).text(f"{out}/review_{name}")
    files.write_ids(split.where("split = 'reserve'").orderBy("report_id"), f"{out}/reserve_ids", mode=mode)
    files.write_jsonl(train.orderBy("report_id").limit(10), f"{out}/sample", mode)
    files.write_object(spark, f"{out}/label_map.json", files.label_map())
    parts = split.groupBy(F.col("split").alias("drop_reason")).agg(F.count("*").alias("n_rows"))
    manifest = work.table("manifest", files.manifest(spark, c, curate.funnel(curated).unionByName(parts), digests))
    manifest.write.mode(mode).text(f"{out}/manifest")
    if not resume:
        run.clear()
    return manifest


def _some(config: dict, *names: str) -> dict:
    return {n: config[n] for n in names}


def evaluate(evaluation: DataFrame, outputs: DataFrame, smoke: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, metrics, gates) of paired outputs (report_id, base, adapter; each a struct of text and tokens)."""
    paired = scoring.pair(evaluation, outputs)
    sides = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m)["text"].alias("text"), F.col(m)["tokens"].alias("tokens")) for m in ("base", "adapter")))
    rows = paired.select("report_id", "narrative", "gold_text", "near_miss_gold", F.explode(sides).alias("x")).select("report_id", "narrative", "gold_text", "near_miss_gold", "x.*")
    seen = Observation("scores")
    scores = Workspace(rows.sparkSession, "evaluate").table("scores", scoring.score(rows).observe(seen, F.count("*").alias("rows")))
    if not seen.get["rows"]:
        raise ValueError("Cannot evaluate an empty set")
    table = scoring.metrics(scores)
    return scores, table, scoring.gates(table, smoke)


def infer(rows: DataFrame, generator: generate.Generator, narrative_chars: int = 6000) -> DataFrame:
    """(id, valid, output, input_truncated) of a generator's briefs of (id, narrative)."""
    return generate.envelopes(generate.generate(generate.valid_inputs(rows), generator, narrative_chars))
