"""Splits, gates, files, checkpoints, streams and the whole build, on small data."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from narrata.operators import checkpoints, curate, generate, linkage, scoring
from narrata.packs import fixed
from narrata.plans import build
from narrata.queries.templates import TEMPLATES
from narrata.sources import files
from narrata.streaming import briefs as streams

ROW = "report_id string, related_ids array<string>, narrative_sha256 string"


def rows_of_groups():
    rows = [(f"{i:03}", [], f"h{i}") for i in range(40)]
    rows[1] = ("001", ["777"], "h1")
    rows[2] = ("002", ["777"], "h2")  # linked through an id that has no row
    rows[3] = ("003", [], "h2")  # and on, by its text
    rows[5] = ("005", ["006", None], "h5")
    return rows


def plain_split(groups, eval_size, train_size, seed):
    import hashlib

    used, out = {"eval": 0, "train": 0}, {}
    for g in sorted(groups, key=lambda g: (hashlib.sha256(f"{seed}:{g}".encode()).hexdigest(), g)):
        n = len(groups[g])
        part = "eval" if used["eval"] + n <= eval_size else "train" if used["train"] + n <= train_size else "reserve"
        if part != "reserve":
            used[part] += n
        out |= dict.fromkeys(groups[g], part)
    return out


def test_split_ignores_order_and_links_through_others(spark):
    rows, seen = rows_of_groups(), []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = linkage.group_split(spark.createDataFrame(rows, ROW).repartition(seed + 1), 6, 20, 42).collect()
        seen.append({r["report_id"]: (r["group_id"], r["split"]) for r in got})
    assert seen[0] == seen[1]
    assert {seen[0][i][0] for i in ("001", "002", "003")} == {"001"} and seen[0]["005"][0] == seen[0]["006"][0] == "005"
    groups = {}
    for i, (g, _) in seen[0].items():
        groups.setdefault(g, []).append(i)
    assert {i: s for i, (_, s) in seen[0].items()} == plain_split(groups, 6, 20, 42)


@pytest.mark.parametrize(("sizes", "eval_size", "train_size"), [((1, 2, 3, 5, 8, 40, 90), 97, 1200), ((7, 30, 31, 64), 300, 500), ((5,), 12, 13), ((1, 1, 1, 2), 5000, 0)])
def test_fill_of_many_sizes(spark, sizes, eval_size, train_size):
    rng = random.Random(eval_size)
    groups = {f"g{i}": ["r"] * rng.choice(sizes) for i in range(300)}
    named = {g: [g] * len(n) for g, n in groups.items()}
    df = spark.createDataFrame([(g, len(n)) for g, n in named.items()], "group_id string, n long").repartition(3)
    want = plain_split(named, eval_size, train_size, 42)
    for ranges in ({}, {"digits": 1, "leaf": 5}):  # read one by one, and by sums of sums of ranges
        assert {r["group_id"]: r["split"] for r in linkage.fill(df, eval_size, train_size, 42, **ranges).collect()} == want
    assert linkage.fill(df.limit(0), 3, 3, 42).count() == 0


def test_split_falls_short_and_leaks_are_found(spark):
    df = spark.createDataFrame(rows_of_groups(), ROW)
    with pytest.raises(ValueError, match="Insufficient eligible groups"):
        linkage.group_split(df, 30, 30, 42)
    split = df.withColumns({"group_id": F.lit("g"), "split": F.when(F.col("report_id") < "010", "eval").otherwise("train")})
    assert {r["key"] for r in linkage.leaks(split).collect()} == {"group_id"}
    with pytest.raises(ValueError, match="leaked"):
        linkage.assert_disjoint(split)
    with pytest.raises(ValueError, match="Missing"):
        linkage.leaks(df.withColumn("split", F.lit("eval")))


def test_counts_come_from_the_write(spark, tmp_path):
    rows = spark.createDataFrame(rows_of_groups(), ROW).withColumns({"group_id": F.col("report_id"), "split": F.when(F.col("report_id") < "010", "eval").otherwise("train")})
    for change, sizes, says in ((rows, (10, 30), None), (rows, (11, 29), "train=30, eval=10"), (rows.withColumn("narrative_sha256", F.lit(None).cast("string")), (10, 30), "Missing"), (rows.limit(0), (0, 0), "empty")):
        seen = Observation()
        linkage.observed(change, seen).write.mode("overwrite").parquet(f"file://{tmp_path}/split")
        if says:
            with pytest.raises(ValueError, match=says):
                linkage.check_observed(seen, *sizes)
        else:
            linkage.check_observed(seen, *sizes)
    with pytest.raises(ValueError, match="empty set"):
        build.evaluate(spark.createDataFrame([], "report_id string, narrative string, gold_text string, near_miss_gold boolean"), spark.createDataFrame([], "report_id string, base struct<text string, tokens int>, adapter struct<text string, tokens int>"))


METRIC = dict(valid_schema=1.0, factor_acc=0.5, phase_acc=0.5, grounding_fail=0.05, recoverable_known_acc=0.5, gold_yes=1, gold_no=1, known_yes=1, known_no=1)


@pytest.mark.parametrize(
    ("change", "kind"),
    [({}, "pass"), ({"grounding_fail": 0.07}, "stop"), ({"factor_acc": 0.34}, "fail"), ({"known_no": 0}, "fail"), ({"recoverable_known_acc": None}, "fail")],
)
def test_gates(spark, change, kind):
    base = METRIC | {"factor_acc": 0.2, "phase_acc": 0.4, "grounding_fail": 0.06, "recoverable_known_acc": 0.4, "model": "base"}
    schema = "model string, " + ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in METRIC.items())
    table = spark.createDataFrame([(r["model"], *(r[k] for k in METRIC)) for r in (base, METRIC | change | {"model": "adapter"})], schema)
    assert scoring.gates(table).first()["decision"] == fixed.DECISIONS[kind]
    assert scoring.gates(table, smoke=True).first()["decision"] == fixed.DECISIONS["smoke"]


def test_checkpoints(spark):
    whole = [("r", "checkpoint-9", n, 1) for n in checkpoints.REQUIRED] + [("r", "checkpoint-10", n, 1) for n in checkpoints.REQUIRED]
    part = [("r", "checkpoint-11", n, 1) for n in checkpoints.REQUIRED[1:]] + [("r", "checkpoint-12", n, int(n != "optimizer.pt")) for n in checkpoints.REQUIRED] + [("r", "checkpoint-x", n, 1) for n in checkpoints.REQUIRED]
    files_ = spark.createDataFrame(whole + part, "run string, directory string, name string, length long")
    assert [tuple(r) for r in checkpoints.latest_checkpoints(files_).collect()] == [("r", 10)]
    marker = {"config": {"a": 1}, "train_sha256": "x", "train_rows": 3}
    checkpoints.check_resumable(marker, {"a": 1}, "x", 3)
    for bad in (({"a": 2}, "x", 3), ({"a": 1}, "y", 3), ({"a": 1}, "x", 4)):
        with pytest.raises(ValueError):
            checkpoints.check_resumable(marker, *bad)


def raw_lines(n):
    keys = ("narrative", "synopsis", "phase", "factor", "contributors", "human_factors", "reporter_function")
    for i in range(n):
        t = TEMPLATES[i % len(TEMPLATES)]
        yield {fixed.COLUMNS["id"]: str(100 + i)} | {fixed.COLUMNS[k]: t[k] and t[k].replace("@@", str(i)) for k in keys}


def test_build(spark, tmp_path):
    source = tmp_path / "raw.jsonl"
    source.write_text("\n\n".join(json.dumps(x) for x in raw_lines(48)) + "\n")
    with pytest.raises(ValueError, match="license"):
        files.read_reports(spark, str(source), " ")
    out = str(tmp_path / "out")
    manifest = json.loads(build.build(spark, f"file://{source}", f"file://{out}", "CC0", {"train_size": 12, "eval_size": 4}).first()["manifest"])
    assert manifest["counts"] == {"drop_grounding": 4, "drop_no_supervision": 4, "drop_short_narrative": 4, "drop_unsupported_synopsis": 16, "kept": 20, "train": 12, "eval": 4, "reserve": 4}
    resumed = {"train_size": 12, "eval_size": 4}
    with pytest.raises(ValueError, match="Insufficient"):
        build.build(spark, f"file://{source}", f"file://{out}2", "CC0", resumed | {"train_size": 900}, f"file://{tmp_path}/run")
    again = json.loads(build.build(spark, f"file://{source}", f"file://{out}2", "CC0", resumed, f"file://{tmp_path}/run").first()["manifest"])
    assert again["counts"] == manifest["counts"] and again["digests"] == manifest["digests"]
    train = spark.read.json(f"{out}/train")
    flags = train.where("copy = 0").select("near_miss_gold", "recovery_no_gold").collect()
    assert train.count() == sum(1 + 2 * r[0] + 2 * r[1] for r in flags) and len(flags) == 12
    assert spark.read.text(f"{out}/reserve_ids").count() == 4 and json.load(open(f"{out}/label_map.json"))["version"] == 4
    assert "### Narrative" in spark.read.text(f"{out}/review_eval", wholetext=True).first()[0]


def test_inference_contract(spark):
    def repeat(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": "nothing", "tokens": 1})

    rows = spark.createDataFrame([("a", "We left."), ("b", "  "), (None, "We came.")], "id string, narrative string")
    got = build.infer(rows, repeat).collect()
    assert len(got) == 2 and not any(r["valid"] for r in got) and all(json.loads(r["output"])["raw_output"] == "nothing" for r in got)
    assert generate.valid_inputs(rows).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [*raw_lines(12), *raw_lines(2)]
    (folder / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    stream = streams.brief_stream(streams.first_reports(streams.read_reports(spark, str(folder))))
    streams.write_parquet(stream, str(tmp_path / "briefs")).awaitTermination()
    got = {r["report_id"]: r["gold_text"] for r in spark.read.parquet(str(tmp_path / "briefs")).collect()}
    want = {str(100 + k): t["written"].replace("@@", str(k)) for k, t in enumerate(TEMPLATES) if t["written"]}
    assert got == want


def test_digest_and_config(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "")], "i int, s string")
    same = [files.dataset_digest(x).first()["digest"] for x in (df, df.repartition(3), df.orderBy(F.desc("i")), df.unionByName(df.limit(1)))]
    assert same[0] == same[1] == same[2] != same[3]
    (tmp_path / "c.yaml").write_text("# settings\nversion: v03\nseed: 7  # fixed\nname: 'x'\n")
    assert files.read_config(str(tmp_path / "c.yaml")) == {"version": "v03", "seed": 7, "name": "x"}
    (tmp_path / "c.yaml").write_text("version: 3\n")
    with pytest.raises(ValueError):
        files.read_config(str(tmp_path / "c.yaml"))
    assert curate.related_ids(F.lit("12345 123456 a1234567 87654321 123456789")) is not None
