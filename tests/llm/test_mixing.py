"""The mix itself: its rows are those of its plan, also where rows repeat, and shards are written in their order."""

from collections import Counter

from pyspark.sql import functions as F

from narrata.llm import mixing


def test_mix_takes_what_the_plan_says(spark, tmp_path):
    words = "w " * 58 + "w"
    rows = [(1, words, "s", k) for k in range(40)] + [(1, words, "t", 0), (2, None, "s", 0), (None, "x y", None, 0), (None, "x y", None, 0)]
    rows += [(k, "v " * (k % 50), "st"[k % 2], k) for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").withColumn("mix_shard", F.lit("z"))
    planned = Counter()
    for r in mixing.mix_plan(docs, shard_words=500).collect():
        planned[r["doc_id"], r["mix_source"]] += r["copies"]
    mixed = mixing.mix(docs, shard_words=500)
    assert sorted(mixed.columns) == sorted([*docs.columns, "mix_copy", "mix_order"])
    got = mixed.collect()
    assert +planned == Counter((r["doc_id"], r["source"]) for r in got)
    one = Counter((r["source"], r["n"]) for r in got if r["doc_id"] == 1 and r["source"] == "s")
    assert max(one.values()) - min(one.get(("s", k), 0) for k in range(40)) <= 1
    mixing.write_mix(mixed, f"file://{tmp_path}/mix")
    back = spark.read.parquet(f"file://{tmp_path}/mix")
    assert back.count() == len(got)
    for part in (tmp_path / "mix").glob("mix_shard=*"):
        (path,) = part.glob("*.parquet")
        orders = [r["mix_order"] for r in spark.read.parquet(f"file://{path}").collect()]
        assert orders == sorted(orders) and len(orders) > 0


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "s")], docs.schema)).count() == 0
