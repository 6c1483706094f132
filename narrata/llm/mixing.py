"""Mixing sources to target weights, with DataFrame operations only.

Documents fall by a keyed hash into blocks of their source. A source's target, in words, fixes how often each of
its blocks is drawn: whole passes over all blocks, then blocks in permuted order while they fit, then documents of
one last block. These exact quotas of blocks are split among the output shards by a binary tree: a node draws how
many blocks of each source go left from the multivariate hypergeometric distribution, as dealing them out blindly
would, and what is left goes right. A shard's blocks are a range of its source's permuted order, so shards are
disjoint; within a shard rows are ordered by a keyed hash. Only sums by (source, block), of bounded number, are
ever gathered: a source that holds a third of all rows has its rows spread over its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.tables import WORD
from narrata.plans.storage import Workspace

#: Blocks of a source: a share of the rows each, and no more than so many.
BLOCK_ROWS, MOST_BLOCKS = 512, 1 << 16


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, ord, weight, target) of a table (source, source_size), a row for each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the sum of all sizes by weight; no
    target is above ``most`` times the source's size, the excess is shared again by weight until none is above.
    In closed form: ordered by limit over weight, the sources before the first one that its share does not fill
    get their limit, the others a common level times their weight.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("weight", (F.col("ord") - 1) % 3 + 1).withColumn("limit", F.lit(most) * F.col("source_size"))
    before = every.orderBy(F.col("limit") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    found = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
    found = found.withColumn("at", F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "ord", "level"))).over(every)["level"])
    return found.select("source", "source_size", "ord", "weight", F.least(F.col("limit").cast("double"), F.col("at") * F.col("weight")).alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The u-quantile of the number of ``good`` among ``draws`` out of ``total``.

    The weights of neighbouring values have a simple ratio; they are summed over eight standard deviations and
    eight values to each side of the mode (what lies beyond is less than a double can tell from zero)."""
    n, k, c = total.cast("double"), good.cast("double"), draws.cast("double")
    lo, hi = F.greatest(F.lit(0), draws - (total - good)), F.least(good, draws)
    mode = F.floor((k + 1) * (c + 1) / (n + 2))
    sd = F.sqrt(c * (k / n) * (1 - k / n) * (n - c) / F.greatest(n - 1, F.lit(1.0)))
    reach = (8 * F.ceil(sd) + 8).cast("long")
    first, last = F.greatest(lo, F.least(mode - reach, hi)).cast("long"), F.least(hi, F.greatest(mode + reach, lo)).cast("long")

    def weight(before: Column, x: Column) -> Column:
        y = x.cast("double")
        step = (k - y + 1) * (c - y + 1) / (y * (n - k - c + y))
        return F.when(x == first, F.lit(0.0)).otherwise(before + F.log(step))

    values = F.sequence(first, last)
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("z"))

    def add(s: Column, x: Column) -> Column:
        w = weight(s["w"], x)
        return F.struct(w.alias("w"), (s["z"] + F.exp(w)).alias("z"))

    whole = F.aggregate(values, start, add, lambda s: s["z"])
    seek = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("z"), first.alias("x"), (u * whole).alias("goal"))

    def pick(s: Column, x: Column) -> Column:
        w = weight(s["w"], x)
        z = s["z"] + F.exp(w)
        return F.struct(w.alias("w"), z.alias("z"), F.when(z < s["goal"], F.least(x + 1, last)).otherwise(s["x"]).alias("x"), s["goal"].alias("goal"))

    drawn = F.aggregate(values, seek, pick, lambda s: s["x"])
    return F.when((total <= 0) | (good <= 0) | (draws <= 0), F.lit(0).cast("long")).otherwise(drawn)


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(ord, shard, start, n): which range of each source's blocks each of 2**levels shards gets.

    quotas: (ord int, n long), the number of blocks of each source.
    """
    empty = F.array().cast("array<long>")
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("q")).select(
        F.lit(0).cast("long").alias("shard"), F.col("q.ord").alias("ords"), F.col("q.n").alias("n"), F.transform("q.n", lambda _: F.lit(0).cast("long")).alias("start")
    )
    for level in range(levels):
        if level == 8:
            nodes = nodes.repartition("shard")  # from here on many tasks draw
        total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.withColumn("total", total).withColumn("left", F.floor((F.col("total") + 1) / 2).cast("long"))
        begin = F.struct(F.col("total").alias("rest"), F.col("left").alias("draws"), empty.alias("out"))

        def draw(s: Column, q: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), F.col("shard"), F.size(s["out"]))  # noqa: B023  used at once
            x = hypergeometric(s["rest"], q, s["draws"], u)
            return F.struct((s["rest"] - q).alias("rest"), (s["draws"] - x).alias("draws"), F.concat(s["out"], F.array(x)).alias("out"))

        nodes = nodes.withColumn("x", F.aggregate("n", begin, draw, lambda s: s["out"]))
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("x").alias("n"), F.col("start").alias("start")),
            F.struct(
                (F.col("shard") * 2 + 1).alias("shard"),
                F.zip_with("n", "x", lambda a, b: a - b).alias("n"),
                F.zip_with("start", "x", lambda a, b: a + b).alias("start"),
            ),
        )
        nodes = nodes.select("ords", F.explode(halves).alias("h")).select("ords", "h.shard", "h.n", "h.start")
    each = nodes.select("shard", F.explode(F.arrays_zip("ords", "start", "n")).alias("r"))
    return each.select(F.col("r.ords").alias("ord"), "shard", "r.start", "r.n").where("n > 0")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = 250_000, seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, copies, shards (one for each copy), mix_key, mix_source.

    size counts words (null text: 0). Each source's taken words come as near its target as its documents' sizes
    allow; no document is taken more than three times; the same rows and seed give the same plan. A null source is
    a source; sources without words have target 0. Rows with a null id are placed by their text. Repeated rows are
    rows of their own. Other columns are not read. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "mix")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = work.table("rows", docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")))
    buckets = max(1, min(MOST_BLOCKS, math.ceil(rows.count() / BLOCK_ROWS)))
    rows = rows.withColumn("block", F.pmod("key", F.lit(buckets)).cast("int"))
    blocks = work.table("blocks", rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    targets = work.table("targets", source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size"))))

    order = Window.partitionBy("ord").orderBy(F.xxhash64(F.lit(seed), "ord", "block"), "block")
    ranked = blocks.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "block", "words", "ord", "source_size", "target")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    ranked = ranked.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    ranked = ranked.withColumn("at", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("n_blocks", F.count("*").over(Window.partitionBy("ord")))
    spare = F.col("rest") - (F.col("upto") - F.col("words"))
    ranked = ranked.withColumn("whole", F.col("passes") + F.when(F.col("rest") >= F.col("upto"), F.least(F.lit(1), F.ceil("rest"))).otherwise(0).cast("int"))
    ranked = ranked.withColumn("part", F.when((F.col("rest") < F.col("upto")) & (spare > 0), spare))
    ranked = work.table("ranked", ranked.withColumn("units", F.col("whole") + F.col("part").isNotNull().cast("int")))

    units = ranked.where("units > 0").select("ord", "source", "block", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("pass"), "n_blocks", "at")
    units = units.select("ord", "source", "block", "pass", (F.col("pass") * F.col("n_blocks") + F.col("at")).cast("long").alias("pos"))
    quotas = work.table("quotas", ranked.groupBy("ord").agg(F.sum("units").alias("n")))
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    levels = max(0, math.ceil(math.log2(max(1.0, words / shard_words))))
    ranges = split_quotas(quotas, levels, seed)
    dealt = ranges.select("ord", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
    shards = units.join(dealt, ["ord", "pos"]).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("s"))
    placed = ranked.alias("r").join(shards.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.block") == F.col("s.block")), "left")
    placed = work.table("placed", placed.select("r.source", "r.block", "source_size", "target", "whole", "part", F.col("s.s.shard").alias("shards")))

    full = rows.alias("d").join(placed.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.block") == F.col("p.block")))
    full = full.select("id", "size", "key", "d.source", "d.block", "source_size", "target", "whole", "part", "shards")
    # Of the block that is drawn in part, documents in keyed order while they fit; then the one nearest to what is left.
    block = Window.partitionBy("source", "block")
    inside = block.orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    part = full.where("part is not null").withColumn("nth", F.count("*").over(inside)).withColumn("fits", F.sum("size").over(inside) <= F.col("part"))
    part = part.withColumn("gap", F.col("part") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))).over(block), F.lit(0)))
    part = part.withColumn("best", F.min(F.when(~F.col("fits"), F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "nth"))).over(block))
    last = (F.col("nth") == F.col("best.nth")) & (F.col("best.off") < F.col("gap"))
    part = part.withColumn("copies", F.col("whole") + (F.col("fits") | F.coalesce(last, F.lit(False))).cast("int"))
    counted = part.select(*full.columns, "copies").unionByName(full.where("part is null").withColumn("copies", F.col("whole")))
    return counted.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
        F.slice(F.coalesce("shards", F.array().cast("array<long>")), F.lit(1), F.greatest("copies", F.lit(0))).alias("shards"), F.col("key").alias("mix_key"), F.col("source").alias("mix_source"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, **options) -> DataFrame:
    """The rows of the mix: the columns of ``docs``, a row for each copy, with ``mix_shard``, ``mix_copy`` and ``mix_order``.

    Copies are those of :func:`mix_plan`, row by row: of rows alike in id, text and source just as many get a further
    copy as the plan says. Only such repeated rows are numbered, in a sort of their own that spills. Columns of ``docs``
    of those three names are replaced. Written with :func:`write_mix`, each shard is one run of rows in shuffled order.
    """
    work = Workspace(docs.sparkSession, "mixed")
    plan = mix_plan(docs, id_col, text_col, source_col, seed=seed, **options).select(F.xxhash64("mix_key", "mix_source").alias("__row"), F.col("shards").alias("__shards"))
    plan = work.table("plan", plan)
    again = work.table("again", plan.groupBy("__row").count().where("count > 1").select("__row"))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    keyed = docs.withColumns({"__key": key, "__row": F.xxhash64(key, F.col(source_col).cast("string"))})
    if again.isEmpty():
        rows = keyed.join(plan, "__row")
    else:
        alike = Window.partitionBy("__row")
        numbered = keyed.join(again, "__row", "left_semi").withColumn("__nth", F.row_number().over(alike.orderBy("__key")))
        told = plan.join(again, "__row", "left_semi").withColumn("__nth", F.row_number().over(alike.orderBy(F.size("__shards").desc())))
        rows = keyed.join(plan.join(again, "__row", "left_anti"), "__row").unionByName(numbered.join(told, ["__row", "__nth"]).drop("__nth"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("mix_shard", "mix_copy", "mix_order")]
    rows = rows.select(*kept, "__key", F.posexplode("__shards").alias("mix_copy", "mix_shard"))
    return rows.withColumn("mix_order", F.xxhash64(F.lit(seed), "__key", "mix_copy", "mix_shard")).drop("__key")


def write_mix(rows: DataFrame, path: str) -> None:
    """Write what :func:`mix` returns, a folder for each shard, its rows in shuffled order."""
    rows.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)
