"""Event rules as rows: a versioned table, joined to the texts that can meet them.

The pack's rules are also columns (``functions/grounding.py``), one expression for each. Here a rule is a row, so rules can
be added, dated and compared without a new plan: each is filed under the words that its claim can begin with, the words of
a text fetch the rules filed under them, and only those are tried as patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions.grounding import heads_of
from narrata.functions.text import folded, text_of
from narrata.operators.skew import SMALL
from narrata.packs import fixed

RULE_SCHEMA = "version int, class string, place int, claim string, evidence string, heads array<string>"


def rule_table(spark: SparkSession, rules=fixed.EVENT_CLASSES, version: int = fixed.PACK_VERSION) -> DataFrame:
    """(version, class, place, claim, evidence, heads), a row a rule. ``ValueError`` for a claim that does not begin with words."""
    return spark.createDataFrame([(version, name, i, claim, evidence, sorted(set(heads_of(claim)))) for i, (name, claim, evidence) in enumerate(rules)], RULE_SCHEMA)


def write_rules(rules: DataFrame, path: str) -> None:
    """Add a version of the rules to a table; a version that is there already is replaced, others stay."""
    rules.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def read_rules(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rules of one version, the latest where none is named. ``ValueError`` if there is no such version."""
    every = spark.read.schema(RULE_SCHEMA).parquet(path)
    wanted = every.agg(F.max("version")).first()[0] if version is None else version
    found = every.where(F.col("version") == F.lit(wanted))
    if wanted is None or found.isEmpty():
        raise ValueError(f"No rules of version {wanted} in {path}")
    return found


def _stem(c: Column, size: int) -> Column:
    return F.left(folded(c), F.lit(size))


def candidates(texts: DataFrame, rules: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``texts`` with each rule that one of its words fetches: the row's ``keys``, text and rule. A rule is fetched once a text.

    Words and heads are compared by their first letters, as many as the shortest head has; what the words of a
    text cannot meet is dropped before its rows multiply.
    """
    filed = rules.select("*", F.explode("heads").alias("head"))
    size = filed.agg(F.min(F.length("head"))).first()[0] or 1
    filed = filed.withColumn("stem", _stem(F.col("head"), size))
    stems = filed.select("stem").distinct()
    small = rules.limit(SMALL + 1).count() <= SMALL
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))
    words = F.array_distinct(F.transform(F.regexp_extract_all(text_of(F.col(text)), F.lit(r"(?U)\b\w+"), F.lit(0)), lambda w: _stem(w, size)))
    rows = texts.select(*keys, F.col(text).alias("__text"), words.alias("__words"))
    if small:  # the stems of all rules as one literal
        rows = rows.withColumn("__words", F.array_intersect("__words", F.array(*(F.lit(r["stem"]) for r in stems.collect())).cast("array<string>")))
    met = rows.select(*keys, "__text", F.explode("__words").alias("stem")).join(held(filed), "stem")
    return met.where(F.contains(folded(F.col("__text")), F.col("head")))


def claim_matches(texts: DataFrame, rules: DataFrame, keys: list[str], text: str, source: str | None = None) -> DataFrame:
    """(keys, class, place), and ``supported`` where a ``source`` column is named: the rules whose claims a text makes, a row
    for each, and whether the source has evidence of it. Null texts claim nothing, null sources support nothing; repeated
    rows of equal keys count once. ``keys`` should tell the texts apart.
    """
    more = [*keys, source] if source else keys
    found = candidates(texts.withColumn(source, text_of(F.col(source))) if source else texts, rules, more, text)
    like = lambda c, pattern: F.regexp_like(c, F.concat(F.lit("(?iU)"), F.col(pattern)))
    made = found.where(like(F.col("__text"), "claim"))
    supported = [like(F.col(source), "evidence").alias("supported")] if source else []
    return made.select(*keys, "class", "place", *supported).distinct()
