"""Components that grow batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from narrata.operators.components import connected_components
from narrata.queries import arriving
from narrata.streaming.components import ComponentStore


@pytest.mark.parametrize("shape", ["chain", "random"])
def test_components_by_batches(spark, tmp_path, shape):
    rng = random.Random(3)
    names = [f"n{i:03}" for i in range(120)]
    edges = list(zip(names, names[1:], strict=False)) if shape == "chain" else [(rng.choice(names), rng.choice(names)) for _ in range(90)]
    rng.shuffle(edges)
    edges += [(edges[0][1], edges[0][0]), (None, "n001"), ("alone", "alone")]
    batches = [edges[i::3] for i in range(3)] + [[]]
    store, seen = ComponentStore(spark, f"file://{tmp_path}/store"), []
    for k, batch in enumerate(batches):
        seen += batch
        for _ in range(2 if k == 1 else 1):  # a batch that is run again
            store.add(spark.createDataFrame(batch, "src string, dst string"), k)
        want = {tuple(r) for r in connected_components(spark.createDataFrame(seen, "src string, dst string")).collect()}
        assert {tuple(r) for r in store.components().collect()} == want
    nodes = spark.read.parquet(f"{tmp_path}/store/nodes")
    assert nodes.count() == nodes.select("node").distinct().count()  # written once each
    rows = spark.read.parquet(f"{tmp_path}/store/roots").where("batch = 2").count()
    assert rows < nodes.count() / 2


def test_a_batch_is_written_by_many_tasks_and_taken_at_once(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("pos"))
    stream = arriving.arriving(rows, F.col("pos") % arriving.BATCHES)
    seen = []
    take = lambda df, k: seen.append((k, df.count(), df.select(F.input_file_name()).distinct().count()))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(k, 1000, spark.sparkContext.defaultParallelism) for k in range(arriving.BATCHES)]
