"""Linked reports, leakage-safe splits, and exact samples.

Ids are strings, ordered by code point. Order comes from SHA-256 of seed and key, so it depends on neither row order
nor partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from narrata.operators import rooms
from narrata.operators.components import connected_components
from narrata.plans.storage import Workspace

PARTS = ("eval", "train", "reserve")


def seeded(seed: int, key: Column) -> Column:
    """The place of a key in the seeded order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def edges_of(rows: DataFrame, report_id: str = "report_id", related: str = "related_ids", text_hash: str = "narrative_sha256") -> DataFrame:
    """Links from each report to its related ids, present or not, and to the node of its text."""
    rid = F.col(report_id).cast("string")
    to = F.concat(F.coalesce(F.col(related), F.array().cast("array<string>")), F.array(F.concat(F.lit("text:"), F.col(text_hash))))
    return rows.select(rid.alias("src"), F.explode(to).alias("dst")).where("src is not null and dst is not null")


def link_groups(rows: DataFrame, report_id: str = "report_id", related: str = "related_ids", text_hash: str = "narrative_sha256") -> DataFrame:
    """(report_id, group_id): reports that share a text or are related, however indirectly, share a group. The group
    is named by its smallest node, which may be an id that has no row, or a text's. Reports of null id have none."""
    found = connected_components(edges_of(rows, report_id, related, text_hash))
    ids = rows.select(F.col(report_id).cast("string").alias("report_id")).where("report_id is not null").distinct()
    return ids.join(found.withColumnRenamed("node", "report_id"), "report_id", "left").select("report_id", F.coalesce("component", "report_id").alias("group_id"))


def fill(sizes: DataFrame, eval_size: int, train_size: int, seed: int, **ranges: int) -> DataFrame:
    """(group_id, n, split) for (group_id, n): groups in seeded order go to eval if they fit, else to train if they fit,
    else to reserve.

    Whether a group fits depends on all before it. The order is cut into ranges, and what each room takes follows from their
    sums (``operators/rooms.py``), so neither a task nor the driver walks the groups. A null n or one below 1 counts as 1.
    """
    work = Workspace(sizes.sparkSession, "fill")
    n = F.greatest(F.coalesce(F.col("n").cast("long"), F.lit(1)), F.lit(1))
    ordered = work.table("ordered", sizes.select("group_id", n.alias("n"), seeded(seed, F.col("group_id")).alias("at")).repartitionByRange("at").sortWithinPartitions("at"))
    in_eval = rooms.fill_room(ordered, eval_size, **ranges).takes(F.col("at"), F.col("n"))
    in_train = rooms.fill_room(ordered.where(~in_eval), train_size, **ranges).takes(F.col("at"), F.col("n"))
    return ordered.select("group_id", "n", F.when(in_eval, "eval").when(in_train, "train").otherwise("reserve").alias("split"))


def group_split(rows: DataFrame, eval_size: int, train_size: int, seed: int = 42, strict: bool = True) -> DataFrame:
    """``rows`` (report_id, related_ids, narrative_sha256, ...) with ``group_id`` and ``split``. No group is divided.
    ``strict``: both parts must come out at their exact size, else ``ValueError``. Repeated report ids count each."""
    linked = rows.join(Workspace(rows.sparkSession, "split").table("groups", link_groups(rows)), "report_id")
    parts = fill(linked.groupBy("group_id").agg(F.count("*").alias("n")), eval_size, train_size, seed)
    if strict:  # the sizes tell, no row is joined for it
        check_sizes({r["split"]: r["n"] for r in parts.groupBy("split").agg(F.sum("n").alias("n")).collect()}, eval_size, train_size)
    return linked.join(parts.drop("n"), "group_id")


def check_sizes(got: dict[str, int], eval_size: int, train_size: int) -> None:
    if got.get("train", 0) != train_size or got.get("eval", 0) != eval_size:
        raise ValueError(f"Insufficient eligible groups: train={got.get('train', 0)}, eval={got.get('eval', 0)}")


def observed(split: DataFrame, seen: Observation) -> DataFrame:
    """``split``, whose rows are counted for :func:`check_observed` while they are written, without a job for it."""
    lacks = F.col("group_id").isNull() | F.col("report_id").isNull() | F.col("narrative_sha256").isNull()
    return split.observe(seen, F.count("*").alias("rows"), F.count_if(lacks).alias("lacks"), *(F.count_if(F.col("split") == p).alias(p) for p in PARTS))


def check_observed(seen: Observation, eval_size: int, train_size: int) -> None:
    """``ValueError`` where the rows written were none, had no leakage metadata, or were not as many as they should be."""
    got = seen.get
    if not got["rows"]:
        raise ValueError("Cannot split an empty set")
    if got["lacks"]:
        raise ValueError("Missing leakage metadata")
    check_sizes(got, eval_size, train_size)


def leaks(split: DataFrame, keys: tuple[str, ...] = ("report_id", "group_id", "narrative_sha256")) -> DataFrame:
    """(key, value) that both train and eval hold, and report ids that eval repeats (key "repeated"). Empty: no leak."""
    if missing := [k for k in keys if k not in split.columns]:
        raise ValueError(f"Missing leakage metadata: {missing[0]}")
    long = split.where("split in ('train', 'eval')").select("split", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")).select("split", "x.*")
    both = long.groupBy("key", "value").agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "eval").alias("e"))
    repeated = both.where((F.col("key") == "report_id") & (F.col("e") > 1)).select(F.lit("repeated").alias("key"), "value")
    return both.where("t > 0 and e > 0").select("key", "value").unionByName(repeated)


def assert_disjoint(split: DataFrame) -> None:
    if split.where("group_id is null or report_id is null or narrative_sha256 is null").limit(1).count():
        raise ValueError("Missing leakage metadata")
    if found := leaks(split).orderBy("key", "value").limit(1).collect():
        raise ValueError(f"Evaluation leaked into training ({found[0]['key']})")


def oversample(rows: DataFrame, copies: dict[str, int]) -> DataFrame:
    """Rows and, for each flag that is true on a row, its copies less one more; the flags count independently.
    ``copy`` numbers a row's copies, 0 is the row itself. A null flag is false."""
    extra = sum((F.when(F.coalesce(F.col(flag), F.lit(False)), n - 1).otherwise(0) for flag, n in copies.items()), F.lit(0))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), extra)))


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows, or all if there are fewer, by the seeded order of ``key``; ``rank`` counts from 1."""
    first = rows.withColumn("__at", seeded(seed, F.col(key))).orderBy("__at", key).limit(n)
    ranked = first.withColumn("rank", F.row_number().over(_by("__at", key)))
    return ranked.drop("__at")


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.orderBy(*cols)


def review_union(sample: DataFrame, failures: DataFrame, key: str, most_failures: int = 10) -> DataFrame:
    """Sampled rows, then the first failures by ``pos`` that the sample lacks; ``rank`` gives the order."""
    late = failures.orderBy("pos", key).limit(most_failures).select(key, (F.lit(1 << 40) + F.col("pos")).alias("rank"))
    both = sample.select(key, F.col("rank").cast("long").alias("rank")).unionByName(late)
    return both.groupBy(key).agg(F.min("rank").alias("r")).withColumn("rank", F.row_number().over(_by("r", key))).drop("r")


def top_counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties by value."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), key).limit(n)
