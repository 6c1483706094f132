"""Files in and out. Paths may be of any file system that Spark knows; only one-row results pass the driver."""

from __future__ import annotations

import json
import os
import re
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators.curate import report_fields
from narrata.operators.places import BLOCK, FILE, TURN, marked_lines
from narrata.packs import fixed

REPORT_SCHEMA = ", ".join(f"`{name}` string" for name in fixed.COLUMNS.values())
NARRATIVE_SCHEMA = "id string, narrative string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, bad lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_reports(spark: SparkSession, path: str, license: str | None, marked: bool = False) -> DataFrame:
    """Raw reports under their short names. The source must name its license. marked: with the columns that
    ``places.line_places`` makes their places of."""
    if not (license or "").strip():
        raise ValueError("Source has no license; record provenance before building")
    raw = read_jsonl(spark, path, REPORT_SCHEMA)
    return report_fields(marked_lines(raw), *map(F.col, (FILE, BLOCK, TURN))) if marked else report_fields(raw)


def read_narratives(spark: SparkSession, path: str) -> DataFrame:
    """(id, narrative) from ``.jsonl``, or one narrative per text file, its path the id."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, NARRATIVE_SCHEMA)
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("narrative"))


def narratives_of(spark: SparkSession, text: str | None = None, file: str | None = None, batch: str | None = None, stdin: TextIO | None = None) -> DataFrame:
    """(id, narrative) of exactly one source: a text, a text file, JSON lines with narratives and ids, or a stream of
    characters. ``ValueError`` for none, for several, and for a narrative that is missing or blank."""
    given = [x for x in (text, file, batch, stdin) if x is not None]
    if len(given) != 1:
        raise ValueError("Name exactly one of text, file, batch and stdin")
    if batch is not None:
        rows = read_jsonl(spark, batch, NARRATIVE_SCHEMA)
    elif file is not None:
        rows = spark.read.option("wholetext", True).text(file).select(F.lit(None).cast("string").alias("id"), F.col("value").alias("narrative"))
    else:
        rows = spark.createDataFrame([(None, text if text is not None else stdin.read())], NARRATIVE_SCHEMA)
    blank = rows.where(~F.coalesce(F.col("narrative"), F.lit("")).rlike(r"(?U)\S")).limit(1)
    if rows.isEmpty() or not blank.isEmpty():
        raise ValueError("A narrative must be a text that is not blank")
    return rows


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with nulls written out; a folder of parts that appears whole or not at all."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_ids(df: DataFrame, path: str, id_col: str = "report_id", mode: str = "error") -> None:
    """Ids and nothing else, one a line."""
    df.select(F.col(id_col).cast("string")).write.mode(mode).text(path)


def write_losses(df: DataFrame, path: str, columns: tuple[str, ...] = ("step", "loss", "eval_loss", "learning_rate", "epoch")) -> None:
    """CSV with a header of fixed columns; others are left out, missing ones stay empty."""
    have = set(df.columns)
    df.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns)).write.option("header", True).csv(path)


def write_object(spark: SparkSession, path: str, value: dict) -> None:
    """One small JSON object, written beside its place and then renamed into it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray((json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) + "\n").encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"Cannot write {path}")


def read_config(path: str) -> dict:
    """Settings of a run: JSON, or flat ``key: value`` lines with comments. The version is ``v`` and two digits or more."""
    with open(os.fspath(path), encoding="utf-8") as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        config = json.loads(text)
    else:
        config = {}
        for line in text.splitlines():
            if found := re.match(r"([A-Za-z_]\w*):\s*(.*?)\s*(?:#.*)?$", line):
                config[found[1]] = _scalar(found[2])
    if "version" in config and not re.fullmatch(r"v\d{2,}", str(config["version"])):
        raise ValueError("version must be v and at least two digits")
    return config


def _scalar(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def row_digest(*columns: str) -> Column:
    """SHA-256 of a row's values as text, each after its length; null is told from empty."""
    value = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(value, columns)), 256)


def dataset_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row (n_rows, digest): a digest of the rows as a multiset, the same in any order and any partitions.

    Row hashes are cut into five numbers, each is summed, and the sums are hashed; so nothing is gathered."""
    rows = df.select(row_digest(*(columns or df.columns)).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 13 * k + 1, 13), 16, 10).cast("decimal(20,0)")) for k in range(5)]
    text = F.concat_ws(",", F.count("*").cast("string"), *(F.coalesce(s, F.lit(0)).cast("decimal(38,0)").cast("string") for s in sums))
    return rows.agg(F.count("*").alias("n_rows"), F.sha2(text, 256).alias("digest"))


def ordered_digest(df: DataFrame, place: str, *columns: str) -> DataFrame:
    """One row (n_rows, digest) of the rows in the order of ``place``, from 0 without gaps: each row is hashed together
    with its place, so the sums of a multiset tell another order, and still nothing is gathered or sorted."""
    return dataset_digest(df, place, *(c for c in columns or df.columns if c != place))


def label_map() -> dict:
    """The rule pack as one object, to be kept beside the data it labelled."""
    return {
        "version": fixed.PACK_VERSION,
        "columns": fixed.COLUMNS,
        "phases": fixed.PHASE_OF_CODE,
        "factors": fixed.FACTOR_OF_CODE,
        "controller_functions": list(fixed.CONTROLLER_FUNCTIONS),
        "contributor_phrases": fixed.CONTRIBUTOR_PHRASES,
        "patterns": {k.lower(): getattr(fixed, k) for k in ("CONTROLLER_ERROR", "OWN_ERROR", "NEGATION", "COMPLETED", "SUCCESS", "NEAR_MISS", "LESSON_START", "LESSON_MODAL", "NOT_A_LESSON")},
        "event_classes": {name: [claim, evidence] for name, claim, evidence in fixed.EVENT_CLASSES},
        "multi_phase_policy": "first source code (not chronological)",
    }


def manifest(spark: SparkSession, config: dict, counts: DataFrame, digests: dict[str, str]) -> DataFrame:
    """One row of JSON: settings, counts by reason, digests of the parts, version of the rules."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("drop_reason", "n_rows"))))
    held = {"config": json.dumps(config, sort_keys=True), "digests": json.dumps(digests, sort_keys=True)}
    return counts.agg(pairs.alias("counts")).select(F.to_json(F.struct(F.col("counts"), F.lit(fixed.PACK_VERSION).alias("pack_version"), *(F.lit(v).alias(k) for k, v in held.items()))).alias("manifest"))


def packet(df: DataFrame, title: str = "report_id", **sections: str) -> DataFrame:
    """(key, block): a Markdown block for each row, to be read by people; write it with ``DataFrame.write.text``."""
    body = [F.concat(F.lit(f"### {name.replace('_', ' ').capitalize()}\n\n"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in sections.items()]
    return df.select(F.col(title).alias("key"), F.concat_ws("\n\n", F.concat(F.lit("## "), F.col(title).cast("string")), *body, F.lit("Review: pending")).alias("block"))
