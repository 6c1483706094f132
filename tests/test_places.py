"""Places over sorted ranges and over the lines of many files."""

import json
import random

from narrata.operators import curate, places
from narrata.packs import fixed
from narrata.plans.storage import Workspace, session_settings
from narrata.sources import files


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(f"{i:04}", rng.randrange(9)) for i in range(900)]
    want, before = {}, 0
    for k, n in rows:
        want[k], before = before, before + n
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int").repartition(7)
    assert {r["k"]: r["before"] for r in places.running_total(df, ["k"], "n", "before").collect()} == want
    assert sorted(r["place"] for r in places.numbered(df, ["k"]).collect()) == list(range(900))
    assert places.numbered(df.limit(0), ["k"]).columns == ["k", "n", "place"] and places.numbered(df.limit(0), ["k"]).count() == 0


def lines_of(folder, sizes):
    """Files of report lines, of unequal sizes; the last id of each file but the first is the first id of all."""
    folder.mkdir()
    order = []
    for name in sorted(sizes):
        rows = [{fixed.COLUMNS["id"]: "same" if i in (0, sizes[name] - 1) else f"{name}{i}", fixed.COLUMNS["narrative"]: f"{name} {i} " + "x" * (i % 50)} for i in range(sizes[name])]
        order += [r[fixed.COLUMNS["narrative"]] for r in rows]
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return order


def test_places_of_lines_in_many_files(spark, tmp_path):
    order = lines_of(tmp_path / "in", {"a.jsonl": 1, "b.jsonl": 3000, "b1.jsonl": 2, "c.jsonl": 400})
    for block in ("1000000", "5000"):  # few blocks, and many
        with session_settings(spark, {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "100"}):
            marked = Workspace(spark, "test").table("lines", files.read_reports(spark, f"file://{tmp_path}/in", "CC0", marked=True))
        assert marked.select(places.FILE, places.BLOCK).distinct().count() > (3 if block == "1000000" else 40)
        placed = places.line_places(marked).persist()
        assert [r["narrative"] for r in placed.orderBy("pos").collect()] == order
        assert [r[0] for r in placed.select("pos").orderBy("pos").collect()] == list(range(len(order)))
        first = curate.cheap_reasons(placed, "pos").where("report_id = 'same' and not drop_reason <=> 'drop_duplicate_id'").collect()
        assert [r["narrative"] for r in first] == ["a.jsonl 0"]
