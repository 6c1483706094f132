"""Rules as rows against rules as columns, and their versions."""

import pytest
from pyspark.sql import functions as F

from narrata.functions.grounding import Source, heads_of, unsupported_classes
from narrata.operators import claims
from narrata.packs import fixed
from narrata.queries.claims import SAID


def test_rows_and_columns_agree(spark):
    texts = [(i, s, "We saw smoke, ice and a bird near the runway.") for i, s in enumerate(SAID)] + [(100, None, "x"), (101, "", "x"), (102, "A fire, a ſnow and fog" + " word" * 30000 + " by night", None), (103, "KIcing icing", "")]
    df = spark.createDataFrame(texts, "id long, output string, source string")
    rules = claims.rule_table(spark)
    got = {(r["id"], r["class"]) for r in claims.claim_matches(df, rules, ["id"], "output", "source").where("not supported").collect()}
    columns = df.select("id", F.explode(unsupported_classes(Source.of(F.col("source")), F.col("output"))).alias("class"))
    assert got == {tuple(r) for r in columns.collect()} and len({c for _, c in got}) > 15
    assert (102, "night") in got and (102, "snow") in got
    assert claims.claim_matches(df.limit(0), rules, ["id"], "output").count() == 0
    assert claims.claim_matches(df, rules.limit(0), ["id"], "output").count() == 0
    twice = claims.claim_matches(df.unionAll(df), rules, ["id"], "output")
    assert twice.count() == claims.claim_matches(df, rules, ["id"], "output").count()


def test_versions_of_rules(spark, tmp_path):
    path = f"file://{tmp_path}/rules"
    for version, name in ((1, "old"), (2, "new"), (2, "newer")):
        claims.write_rules(claims.rule_table(spark, ((name, r"\bfire\b", "flame"),), version), path)
    assert [r["class"] for r in claims.read_rules(spark, path).collect()] == ["newer"]
    assert [r["class"] for r in claims.read_rules(spark, path, 1).collect()] == ["old"]
    with pytest.raises(ValueError, match="No rules of version 3"):
        claims.read_rules(spark, path, 3)
    with pytest.raises(ValueError, match="begin with a word"):
        heads_of(r"(?:a|b)c")
    assert all(heads_of(claim) for _, claim, _ in fixed.EVENT_CLASSES)
