"""Patterns arranged by first letters and guarded by plain texts find what they found."""

import pytest
from pyspark.sql import functions as F

from narrata.functions import patterns, text
from narrata.packs import fixed
from narrata.plans.spread import TASKS_A_CORE, spread
from narrata.queries.templates import TEMPLATES

LONG = {n: getattr(fixed, n) for n in ("COMPLETED", "SUCCESS", "NEAR_MISS", "NEGATION", "HEDGE", "UNSURE", "EVENT_WORDS", "PRESCRIPTIVE")} | {f"evidence of {n}": e for n, _, e in fixed.EVENT_CLASSES}
ODD = [
    "The ſtruck LOſT the panel; BRAKED hard, İnjuries and hıt the ground", "Ditchedé éditched ditched", "prop strike, propeller  strike near-miss NEAR  miss", "", "wingtip hit; wing tip hit a tug",
    "We über the top went into the grass. It ıce ICE iced. Within 5 of", "I think possibly. unsure, can’t be quite sure; highly suspect", "collision was avoided, collision with a rest restored RTO g-load gload",
]


def test_arranged_patterns_find_the_same(spark):
    told = [t[c] for t in TEMPLATES for c in ("narrative", "synopsis") if t[c]] + ODD
    df = spark.createDataFrame([(x,) for x in told], "s string").withColumn("low", text.folded(F.col("s")))
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    for name, p in LONG.items():
        plain = "(?iU)" + p
        odd = df.where((every(F.col("s"), plain) != every(F.col("s"), text.rx(p))) | (F.col("s").rlike(plain) != text.search(F.col("low"), p)) | (F.transform(every(F.col("s"), plain), text.folded) != every(F.col("low"), text.rx_low(p))))
        assert odd.collect() == [], name


def test_long_patterns_are_arranged():
    assert all(patterns.by_letter(p) != p for n, p in LONG.items())
    assert patterns.by_letter("(a)|b") == "(a)|b"
    assert patterns.by_letter(r"\d|b") == r"\d|b"


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [("a(?:b|c)?dd of|(?:fool|bar) (?:q )?end", ["bar", "dd of", "fool"]), ("x[yz]*ok+p", []), (r"\b(?:it|we) (?:\w+ ){0,3}?into the", ["into the"]), ("near[- ]?miss|miss", ["miss", "near"])],
)
def test_needed_texts(pattern, texts):
    assert patterns.needed(pattern) == texts


def test_one_row_group_of_many_splits_is_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000b")
    try:
        scan = spark.read.parquet(f"{tmp_path}/t")
        assert scan.rdd.getNumPartitions() >= cores
        rows = spread(scan).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == TASKS_A_CORE * cores and max(r["count"] for r in rows) < 20000 / cores
