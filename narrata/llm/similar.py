"""Near copies by exact similarity of word shingles: prefix filters as Spark joins, then whole sets are compared.

Two texts are near where their sets of shingles have a Jaccard similarity of ``least`` or more. Such sets overlap in
``least`` of either at least, so in any one order of shingles their beginnings meet. A first pass deals out only those
beginnings, by hash, and leaves the few documents whose beginning others share widely enough. Of these the rarest
shingles make buckets; in rounds all members of a bucket are compared with its smallest id, which then leaves the bucket,
so a large group of near copies costs a comparison a member. Two sets are compared only where enough of both is left from
the shingle they meet in. In what outlasts the rounds the smaller set of a pair is met only in the still shorter beginning
that one of its own size would need, so sets that a bucket merely brings together, such as many edits of one text that
are less alike than ``least``, are not paired. No pair is lost on the way: the filters are necessary conditions, not samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.tables import SMALL_BATCHES, few_broadcast, text_key, with_columns_kept
from narrata.operators.places import numbered
from narrata.operators.skew import join_counted
from narrata.plans.storage import Workspace, session_settings

ROUNDS = 6


def shingles_of(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles. All words are the one shingle where they are fewer; no words: the empty one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) if words else np.zeros(1, dtype=np.int64)
    begin, end = [0, *ends[: n - 1].tolist()], (ends[min(words_per_shingle, len(ends)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[b : max(b, e)]) for b, e in zip(begin, end, strict=True)), np.uint64, n).view(np.int64))


def overlap(n, least: float):
    """So many of its ``n`` shingles a set has in common with any near one, at least."""
    return np.ceil(n * least - 1e-9).astype(np.int64)


def _beginnings(words_per_shingle: int, least: float):
    @F.pandas_udf("n int, head array<long>")
    def heads(texts: pd.Series) -> pd.DataFrame:
        found = [shingles_of(t, words_per_shingle) for t in texts]
        return pd.DataFrame({"n": [len(s) for s in found], "head": [s[: len(s) - overlap(len(s), least) + 1 + len(s) // 10] for s in found]})

    return heads


def _shingles(words_per_shingle: int):
    @F.pandas_udf("array<long>")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t, words_per_shingle) for t in texts], dtype=object)

    return whole


def _repeated(batches):
    """Of rows sorted by h: id and n of those whose h others have, too."""
    last = None  # the row before, and whether it is out
    for rows in batches:
        if not len(rows):
            continue
        h = rows["h"].to_numpy()
        same = h[1:] == h[:-1]
        again = np.r_[False, same] | np.r_[same, False]
        out = rows[["id", "n"]]
        if last is not None and last[0] == h[0]:
            again[0] = True
            if not last[2]:
                yield last[1]
        last = (h[-1], out.iloc[-1:], again[-1])
        yield out[again]


def similar_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, least: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """(id): documents to drop, so that no two near ones stay; each is near to one of a smaller id.

    Rows with a null id are not read. Rows that share an id are one document, and should be of one text.
    """
    work = Workspace(docs.sparkSession, "similar")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    heads = texts.select("id", _beginnings(words_per_shingle, least)("text").alias("s")).select("id", "s.n", F.explode("s.head").alias("h"))
    shared = heads.repartition("h").sortWithinPartitions("h").mapInPandas(_repeated, "id long, n int")
    # a near set has ``least`` of the size at least, and so much of the tenth that beginnings are longer than they need be
    with session_settings(docs.sparkSession, SMALL_BATCHES):
        some = work.table("some", shared.groupBy("id", "n").count().where(F.col("count") >= 1 + F.floor(F.floor(F.col("n") * least + 1e-9) / 10)).select("id").distinct())
        sets = work.table("sets", texts.join(few_broadcast(some), "id", "left_semi").dropDuplicates(["id"]).select("id", _shingles(words_per_shingle)("text").alias("s")))
    every = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = work.table("often", every.groupBy("h").count().where("count > 1"))
    total = sets.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0]
    by_id = join_counted(every, often, "h", total, n="count").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "h"))).alias("often"))
    # shingles of its own come first in a set's order, and meet nothing; left: shingles from this one on, itself included
    size = F.size("often") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    begun = by_id.where(size > 0).select("id", "n", F.size("often").alias("m"), F.posexplode(F.slice("often", F.lit(1), size)).alias("k", "o"))
    buckets = work.table("buckets-0", begun.select(F.col("o.h").alias("h"), "id", "n", (F.col("m") - F.col("k")).alias("left")))
    work.drop("some", "often")

    def room(a: str, b: str) -> Column:
        """Whether sets whose first common shingle this is can be near: what is left of both is as much as they must share."""
        must = least * (F.col(f"{a}.n") + F.col(f"{b}.n"))
        return F.least(f"{a}.left", f"{b}.left") * (1 + least) >= must - 1e-9

    def near(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.distinct().join(a, "a").join(b, "b").where(both >= least * (F.size("sa") + F.size("sb") - both) - 1e-9).select(F.col("b").alias("id")).distinct()

    gone = work.table("gone-0", sets.select("id").limit(0))
    for k in range(1, rounds + 1):
        first = work.table("first", buckets.groupBy("h").agg(F.min(F.struct("id", "n", "left")).alias("a"), F.count("*").alias("m")).where("m > 1"))
        met = join_counted(buckets.select("h", F.struct("id", "n", "left").alias("b")), first, "h", buckets.count(), n="m")
        members = work.table("members", met.where("b.id <> a.id").select("h", "b.*", F.when(room("a", "b"), F.col("a.id")).alias("a")))
        if members.isEmpty():
            return gone
        found = work.table("found", near(members.where("a is not null").select("a", F.col("id").alias("b"))))
        gone = work.table(f"gone-{k}", gone.unionByName(found))
        buckets = work.table(f"buckets-{k}", members.drop("a").join(found, "id", "left_anti").select(*buckets.columns))
        work.drop(f"gone-{k - 1}", f"buckets-{k - 1}")
    # the smaller set of a near pair has this shingle early enough for one of its own size; then both must have room
    small = buckets.where(F.col("left") * (1 + least) >= 2 * least * F.col("n") - 1e-9)
    fits = (F.col("x.h") == F.col("y.h")) & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id")) & room("x", "y")
    rest = small.alias("x").join(buckets.alias("y"), fits).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return gone.unionByName(near(rest)).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies of rows with smaller ids; all columns and rows with a null id stay.

    Two texts under one id are two documents, the one of the smaller hash first; rows alike in id and text share one fate.
    An empty table stays empty. ``docs`` is read several times, so it should not be dear to compute."""
    of, named = text_key(F.col(text_col)), docs.where(F.col(id_col).isNotNull())
    keys = named.select(F.col(id_col).cast("long").alias("id"), of.alias("of"))
    if keys.groupBy("id").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a <> b").isEmpty():
        gone = similar_ids(docs, id_col, text_col, **options)
        return with_columns_kept(docs, gone.select("id", F.lit(0)), id_col, F.lit(0))
    # ids do not tell the documents apart: places in the order of id and text do
    places = Workspace(docs.sparkSession, "similar").table("places", numbered(keys.distinct(), ["id", "of"], "place"))
    texts = named.select(F.col(id_col).cast("long").alias("id"), of.alias("of"), F.col(text_col).alias("text")).join(places, ["id", "of"])
    gone = similar_ids(texts.select("place", "text"), "place", "text", **options).withColumnRenamed("id", "place")
    return with_columns_kept(docs, gone.join(places, "place").select("id", "of"), id_col, text_key(docs[text_col]))
