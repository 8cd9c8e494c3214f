"""Moments, standardisation, singular values and principal components.

Matrices are tall: moments are sums over rows in one aggregate, and only d x d numbers reach the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each column less its mean, over its sample standard deviation; constant columns give 0."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    scaled = (F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.when(F.col(c).isNotNull(), 0.0)).alias(c) for c in columns)
    return df.crossJoin(F.broadcast(stats)).select(*keys, *scaled)


def standardize(vectors: DataFrame, column: str = "features") -> DataFrame:
    """The same on a vector column, by the library's scaler."""
    model = StandardScaler(inputCol=column, outputCol="scaled", withMean=True, withStd=True).fit(vectors)
    return model.transform(vectors)


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i, j and the sum of products of columns i and j, for i <= j, in one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.agg(*(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i, j in pairs))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("value")) for i, j in pairs))).alias("e")).select("e.*")


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i, j and the sample covariance of columns i and j, for i <= j."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.agg(*(F.covar_samp(columns[i], columns[j]).alias(f"c_{i}_{j}") for i, j in pairs))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c_{i}_{j}").alias("value")) for i, j in pairs))).alias("e")).select("e.*")


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns with their entry of largest size made positive."""
    return v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1, 1)


def svd(df: DataFrame, columns: Sequence[str], k: int = 2, r_cond: float = 1e-9) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The leading ``k`` singular triplets: U as rows of ``df``'s columns u0.., s, and V.

    From the Gram matrix; values below ``r_cond`` times the largest are left out.
    """
    g = np.zeros((len(columns), len(columns)))
    for r in gram_matrix(df, columns).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["value"]
    w, v = np.linalg.eigh(g)
    s, v = np.sqrt(np.maximum(w[::-1][:k], 0)), _signed(v[:, ::-1][:, :k])
    keep = s > r_cond * max(s[0], 1e-300)
    s, v = s[keep], v[:, keep]
    u = df.select(*(sum((F.col(c) * float(v[i, t]) for i, c in enumerate(columns)), F.lit(0.0)).__truediv__(float(s[t])).alias(f"u{t}") for t in range(len(s))))
    return u, s, v


def svd_v(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """component, column, the entry of V and the singular value."""
    _, s, v = svd(df, columns, k)
    rows = [(t, c, float(v[i, t]), float(s[t])) for t in range(len(s)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "component int, column string, value double, singular double")


def principal_components(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """component, column and loading of the leading ``k`` principal components."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    pc = _signed(PCA(k=k, inputCol="features", outputCol="out").fit(vectors).pc.toArray())
    rows = [(t, c, float(pc[i, t])) for t in range(k) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "component int, column string, value double")
