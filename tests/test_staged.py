"""Staged runs that are taken up again, reviews bound to their data, and the funnel of a stream."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from narrata.operators import reviews
from narrata.plans import staged
from narrata.streaming import funnel


def test_a_run_is_taken_up_after_its_second_stage_failed(spark, tmp_path):
    made, broken = [], [True]

    def run(settings, digest="d1"):
        r = staged.StagedRun(spark, f"file://{tmp_path}/run")
        r.given("input", digest)

        def stage(name, rows, fail=False):
            def make():
                made.append(name)
                return rows().withColumn("bad", F.raise_error(F.lit("lost"))) if fail else rows()

            return make

        a = r.stage("a", stage("a", lambda: spark.range(5)), ("input",))
        b = r.stage("b", stage("b", lambda: a.where(F.col("id") < settings["most"]), broken[0]), ("a",), settings)
        return r.stage("c", stage("c", lambda: b.agg(F.sum("id").alias("s"))), ("b",)), r

    with pytest.raises(Exception, match="lost"):
        run({"most": 3})
    assert made == ["a", "b"] and not staged.StagedRun(spark, f"file://{tmp_path}/run", {"b": "x"}).finished("b")
    broken[0] = False
    assert run({"most": 3})[0].first()["s"] == 3 and made == ["a", "b", "b", "c"]
    out, again = run({"most": 3})
    assert out.first()["s"] == 3 and len(made) == 4 and again.finished("c")
    assert run({"most": 2})[0].first()["s"] == 1 and made[4:] == ["b", "c"]
    assert run({"most": 2}, "d2")[0].first()["s"] == 1 and made[6:] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="has not run"):
        again.stage("d", lambda: out, ("nothing",))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("{}")
    before = staged.listing_digest(spark, f"file://{tmp_path}/in")
    (tmp_path / "in" / "y.json").write_text("{}")
    assert before != staged.listing_digest(spark, f"file://{tmp_path}/in") == staged.listing_digest(spark, f"file://{tmp_path}/in")


PACKET = "split string, pos long, report_id string"


def test_reviews_are_aligned(spark):
    packet = spark.createDataFrame([("train", i, x) for i, x in enumerate("abcdee")] + [("eval", 0, "a"), ("eval", 1, None)], PACKET)
    reviews.check_aligned(packet, packet.withColumn("pos", F.col("pos") * 7))
    found = reviews.aligned(packet, spark.createDataFrame([("train", i, x) for i, x in enumerate("acbdxee")] + [("train", 9, "e"), ("eval", 0, "a")], PACKET))
    got = {(r["split"], r["report_id"], r["packet_pos"], r["review_pos"]): r["verdict"] for r in found.collect()}
    assert got == {
        ("train", "a", 0, 0): "aligned", ("train", "b", 1, 2): "out of order", ("train", "c", 2, 1): "out of order", ("train", "d", 3, 3): "aligned", ("train", "e", 4, 5): "aligned",
        ("train", "e", 5, 6): "aligned", ("train", "e", None, 9): "repeated", ("train", "x", None, 4): "foreign", ("eval", "a", 0, 0): "aligned", ("eval", "", 1, None): "missing",
    }
    with pytest.raises(ValueError, match="eval: review of  is missing"):
        reviews.check_aligned(packet, packet.where("report_id is not null"))


def test_a_review_is_bound_to_its_data(spark):
    rows = spark.createDataFrame([("train", False, None, ["x"], "read")] * 9 + [("eval", True, True, ["x"], "read")], "split string, grounding_concern boolean, grounding_rule_violation boolean, fields array<string>, note string")
    data = spark.createDataFrame([(i, f"r{i}", f"text {i}") for i in range(6)], "pos long, report_id string, gold_text string")
    columns = ("report_id", "gold_text")
    decision = json.loads(json.dumps(reviews.decide(rows, data, data.limit(3), columns)))
    assert decision["approved"] and decision["n_reviewed"] == 10
    reviews.check_bound(decision, data.repartition(3), data.limit(3), columns, 10)
    swapped = data.withColumn("pos", F.when(F.col("pos") < 2, 1 - F.col("pos")).otherwise(F.col("pos")))
    for change, train, evaluation, says in (
        (None, data, data.limit(3), "not reviewed"), ({"approved": False}, data, data.limit(3), "approve"), ({"n_reviewed": 99}, data, data.limit(3), "99 rows"),
        ({}, swapped, data.limit(3), "other train"), ({}, data.limit(5), data.limit(3), "other train"), ({}, data, data.limit(2), "other eval"),
    ):
        with pytest.raises(ValueError, match=says):
            reviews.check_bound(None if change is None else decision | change, train, evaluation, columns, 10)
    assert not reviews.decide(rows.where("split = 'eval'"), data, data, columns)["approved"]
    with pytest.raises(ValueError, match="Nothing"):
        reviews.decide(rows.limit(0), data, data, columns)


def test_funnel_in_any_order_of_files(spark, tmp_path):
    long = "x" * 30
    rows = [(0, " ", long, "s", None), (1, "a", "short", "s", None), (2, "a", long, "s", None), (3, "b", long, "", None), (4, "b", long, "s", "f"), (5, "c", long, "s", "f"), (6, None, long, "s", "f"), (7, "c", "short", "s", "f"), (8, "d", long, None, "f")]
    schema = "pos long, report_id string, narrative string, synopsis string, factor string"
    want = {"drop_missing_id": 2, "drop_short_narrative": 1, "drop_duplicate_id": 3, "drop_no_supervision": 1, "passed": 2}
    for k, order in enumerate(itertools.islice(itertools.permutations(range(3)), 0, 6, 2)):
        folder, store = tmp_path / f"in{k}", funnel.FunnelStore(spark, f"file://{tmp_path}/store{k}")
        for part in order:
            spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
        funnel.funnel_stream(stream, store, least=20).awaitTermination()
        assert {r["drop_reason"]: r["n_rows"] for r in store.funnel().collect()} == want
