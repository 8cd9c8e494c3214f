"""k-means and its cost."""

from __future__ import annotations

from collections.abc import Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Centroids that are broadcast at once.
BLOCK = 10_000
#: Fits that run at once: rounds of small jobs leave most cores waiting for the driver.
FITS = 8


def as_vectors(df: DataFrame, column: str) -> DataFrame:
    return df.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("features"))


def kmeans(vectors: DataFrame, k: int, max_iter: int = 100, init: str = "k-means||", seed: int = 1):
    """A fitted model; ``init`` is ``k-means||`` or ``random``. Its cost is ``summary.trainingCost``."""
    return KMeans(k=k, maxIter=max_iter, initMode=init, seed=seed, featuresCol="features").fit(vectors)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cost(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """The sum of squared distances of points (``v``) to their nearest centroids (``v``).

    Centroids go out as arrays, one broadcast row for each block of about ``BLOCK``; each point takes
    the least distance over all blocks in place, so no row is shuffled or multiplied.
    """
    c = centroids.where("v is not null").select(F.col("v").alias("c"))
    blocks = max(1, -(-c.count() // BLOCK))
    near = points.select("v", F.lit(None).cast("double").alias("d"))
    for i in range(blocks):
        block = c.where(F.pmod(F.xxhash64("c"), F.lit(blocks)) == i) if blocks > 1 else c
        block = block.agg(F.collect_list("c").alias("cs"))
        best = F.array_min(F.transform("cs", lambda x: squared_distance(F.col("v"), x)))
        near = near.crossJoin(F.broadcast(block)).select("v", F.least("d", best).alias("d"))
    return near.agg(F.sum("d").alias("cost"))


def cost_sweep(vectors: DataFrame, ks: Iterable[int] = range(2, 21), inits: Iterable[str] = ("k-means||", "random"), seed: int = 1) -> DataFrame:
    """init, k and cost of one fit each, over cached vectors; fits run side by side."""
    vectors = vectors.cache()
    vectors.count()
    tried = [(init, k) for init in inits for k in ks]
    one = inheritable_thread_target(vectors.sparkSession)(lambda t: float(kmeans(vectors, t[1], init=t[0], seed=seed).summary.trainingCost))
    with ThreadPool(FITS) as pool:
        costs = dict(pool.map(lambda t: (t, one(t)), tried[::-1], chunksize=1))  # the longest fits first
    vectors.unpersist()
    return vectors.sparkSession.createDataFrame([(*t, costs[t]) for t in tried], "init string, k int, cost double")
