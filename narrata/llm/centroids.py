"""Centroid clustering: exact rounds of nearest centroids over integer vectors, found by annulus search.

A vector can be no nearer to a centroid than their norms differ. So the centroids are sorted by norm; the one whose norm
is next to a vector's gives an upper bound for its distance; two binary searches then cut out the centroids with norms
inside that annulus, boundary ties included, and only those are compared, exactly, in integers.

Distribution. Vectors are turned into integers once, written, and read again in each round; they never move. A task
returns sums and counts for each centroid, which Spark adds up, so a round shuffles ``k`` sums of a task and the driver
sees ``k`` centroids, whatever the number of vectors, and a cluster with most of the rows costs no more than any other.
All arithmetic is of whole numbers, so results depend on neither partitions nor retries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.plans.storage import Workspace

#: Components below this in size keep squared distances of up to 128 components within a long.
MOST = 1 << 27


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double. A component too large for exact distances ends the job."""
    big = F.raise_error(F.concat(F.lit("Component too large for exact distances: "), F.to_json(vector)))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(F.exists(vector, lambda x: F.abs(x.cast("double")) >= MOST / scale), big.cast("array<int>")).otherwise(whole.cast("array<int>"))


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none null or non-finite."""
    finite = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
    norms = np.sqrt((centroids * centroids).sum(axis=1).astype(np.float64))
    order = np.lexsort((np.arange(len(norms)), norms))
    norms, sorted_ = norms[order], centroids[order]
    own = np.sqrt((x * x).sum(axis=1).astype(np.float64))
    at = np.clip(np.searchsorted(norms, own), 1, len(norms)) - 1
    after = np.minimum(at + 1, len(norms) - 1)
    at = np.where(np.abs(norms[after] - own) < np.abs(norms[at] - own), after, at)
    best = ((x - sorted_[at]) ** 2).sum(axis=1)
    number = order[at]
    # rounding must not cut off a tie on the edge
    width = np.sqrt(best.astype(np.float64)) * (1 + 1e-12) + (own + 1) * 1e-12 + norms[-1] * 1e-12
    low, high = np.searchsorted(norms, own - width, "left"), np.searchsorted(norms, own + width, "right")
    for p in range(len(norms)):
        rows = np.flatnonzero((low <= p) & (p < high) & (at != p))
        if len(rows):
            d = ((x[rows] - sorted_[p]) ** 2).sum(axis=1)
            won = (d < best[rows]) | ((d == best[rows]) & (order[p] < number[rows]))
            best[rows[won]], number[rows[won]] = d[won], order[p]
    return number, best


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; those without vectors stay."""
    k, dims = centroids.shape

    def sums(batches):
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            number, _ = nearest(x, centroids)
            for c in np.unique(number).tolist():
                total[c, :dims] += x[number == c].sum(axis=0)
                total[c, dims] += int((number == c).sum())
        used = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_pydict({"c": pa.array(np.repeat(used, dims + 1), pa.int32()), "j": pa.array(np.tile(np.arange(dims + 1), len(used)), pa.int32()), "s": pa.array(total[used].ravel(), pa.int64())})

    # the sums of a component pass 63 bits only beyond 2^36 vectors of the largest components; decimals have no such edge
    added = vectors.select("v").mapInArrow(sums, "c int, j int, s long").groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out, found = centroids.copy(), {}
    for r in added.collect():  # k * (dims + 1) rows at most
        found.setdefault(r["c"], {})[r["j"]] = int(r["s"])
    for c, s in found.items():
        out[c] = [s[j] // s[dims] for j in range(dims)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each usable vector.

    Vectors of another length, null ones and such with null or non-finite components are left out. Components become
    floor(scale * x). The first centroids are the ``k`` vectors whose ids have the smallest SHA-256 of ``seed:id``, fewer
    if there are fewer vectors; repeated ids are ordered by their vectors, null ids come last. Rounds end early only
    where no centroid moves. Repeated rows count each; distances are squared. Other columns are not read,
    whatever their names. An empty table gives no rows. ``ValueError`` if ``dims`` is over 128; a component of 2^27 / scale
    or more fails the job, since distances would leave the range of a long.
    """
    if not 1 <= dims <= 128:
        raise ValueError("Distances are exact for 1 to 128 components")
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "centroids")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).where(usable(F.col("x"), dims))
    rows = work.table("vectors", rows.select("id", scaled(F.col("x"), scale).alias("v")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = rows.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in seeds], dtype=np.int64).reshape(-1, dims)
    for _ in range(rounds if len(seeds) else 0):
        before, centroids = centroids, _moved(rows, centroids)
        if (before == centroids).all():
            break

    def assigned(batches):
        for batch in batches:
            number, d = nearest(_matrix(batch, dims), centroids) if len(centroids) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(d, pa.int64())], names=["id", "cluster", "distance"])

    last = work.table("assigned", rows.mapInArrow(assigned, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    work.drop("vectors")
    inertia = {r["cluster"]: r["d"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = [(c, d, sum(inertia.values()), digest(c)) for c, d in inertia.items()]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
