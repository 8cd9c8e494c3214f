"""Exact top-k search by inner product with MaxScore.

A vector's components are its impacts: dimension d with sign s is a term, and its postings are
the rows whose component in d has that sign. A query splits its terms by their bounds (the
largest gain a row of the shard can have from the term): terms whose bounds together stay below
the k-th best score so far are non-essential. Rows in the postings of the essential terms are
scored over those first; the others are probed term by term, largest bound first, only for the
rows that can still compete. Gains are exact integers; losses (opposite signs) count as they come.

Vectors stay where they are: a task takes its rows in shards of bounded size. Queries come in blocks
of bounded size, each of which is sent to all tasks with a first threshold for each query, the k-th
best score among a bounded sample of rows; the k best of the shards that reach it are merged. So
nothing is shuffled but candidates, and vectors are read once for each block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Rows of a shard, queries of a block, and rows of the sample for first thresholds, about.
SHARD, BLOCK, SAMPLE = 16_384, 16_384, 2_048


def maxscore(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, postings: tuple[np.ndarray, np.ndarray], least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k best of one shard, ties to the smaller id; never the row ``own``.

    ``x`` is (dimensions, rows); ``postings`` holds each dimension's largest and smallest value.
    Rows that score below ``least`` may be left out.
    """
    high, low = postings
    gains = np.where(q > 0, q * high, q * low)
    if gains.sum() < least:  # no row of the shard can get there
        return np.empty(0, np.int64), np.empty(0)
    bounds = np.maximum(0, gains)
    order = np.argsort(bounds, kind="stable")  # least first
    free = ids != own

    def best(rows, scores):
        if len(rows) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= kth
            rows, scores = rows[keep], scores[keep]
        at = np.lexsort((ids[rows], -scores))[:k]
        return rows[at], scores[at]

    # a first threshold from the rows with the highest impact in the strongest term
    top = order[-1]
    gain = q[top] * x[top]
    some = np.argpartition(gain, max(0, len(gain) - 4 * k - 1))[max(0, len(gain) - 4 * k - 1) :] if len(gain) > 4 * k + 1 else np.arange(len(gain))
    some = some[free[some]]
    scores = q @ x[:, some]
    theta = max(np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf, least)
    sums = np.cumsum(bounds[order])
    split = int(np.searchsorted(sums, theta, side="left"))  # these terms together stay below theta
    essential, rest = order[split:][::-1], order[:split][::-1]
    if len(rest):
        in_postings = np.zeros(len(ids), bool)
        for d in essential:  # most rows are found in the first lists
            in_postings |= q[d] * x[d] > 0
            if in_postings.all():
                break
        rows = np.flatnonzero(in_postings & free)
        partial = q[essential] @ x[essential] if len(rows) == len(ids) else q[essential] @ x[np.ix_(essential, rows)]
        partial = partial[rows] if len(partial) != len(rows) else partial
        left = sums[split - 1]
        keep = partial + left >= theta
        rows, partial = rows[keep], partial[keep]
        for s in range(0, len(rest), 4):
            if not len(rows):
                break
            dims = rest[s : s + 4]
            partial = partial + q[dims] @ x[np.ix_(dims, rows)]
            left -= bounds[dims].sum()
            keep = partial + left >= theta
            rows, partial = rows[keep], partial[keep]
        return best(rows, partial)
    rows = np.flatnonzero(free)
    return best(rows, (q @ x)[rows])


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def _kind(x: np.ndarray, q: np.ndarray):
    """Floats hold these integers exactly, and their products are fast; else integers."""
    big = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float64 if big < 2**52 else np.int64


def _thresholds(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """For each query, the k-th best score among a sample of rows."""
    out = np.full(len(q_ids), -np.inf)
    width = max(x.shape[1], q.shape[1])
    x, q = _wide(x, width), _wide(q, width)
    kind = _kind(x, q)
    for i in range(0, len(q_ids), 1024):
        scores = (q[i : i + 1024].astype(kind) @ x.T.astype(kind)).astype(float)
        scores[q_ids[i : i + 1024, None] == ids] = -np.inf
        if scores.shape[1] > k:
            out[i : i + 1024] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return out


def _search(shared, k: int):
    def run(batches):
        q_ids, queries, least = shared.value
        held: list[pa.RecordBatch] = []

        def shard():
            rows = pa.Table.from_batches(held)
            ids, x = rows.column("vec_id").to_numpy().astype(np.int64), _matrix(rows.column("v"))
            width = max(x.shape[1], queries.shape[1])
            kind = _kind(_wide(x, width), queries)
            xt = np.ascontiguousarray(_wide(x, width).T).astype(kind)
            ends = (xt.max(1), xt.min(1))
            out: list[list] = [[], [], []]
            for own, q, low in zip(q_ids.tolist(), _wide(queries, width).astype(kind), least.tolist(), strict=True):
                at, scores = maxscore(xt, ids, q, own, k, ends, low)
                out[0] += [own] * len(at)
                out[1] += ids[at].tolist()
                out[2] += [int(s) for s in scores]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(0, b.num_rows, SHARD):
                held.append(b.slice(i, SHARD))
                if sum(h.num_rows for h in held) >= SHARD:
                    yield shard()
                    held = []
        if any(h.num_rows for h in held):
            yield shard()

    return run


def dense_topk(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` best other rows, all if there are fewer.

    ``is_query`` is a condition on ``vec_id``. Components become floor(scale * x). Rows whose id
    or vector is null, empty or holds a null or non-finite component take no part. Shorter vectors
    count as ending in zeros. Rows that repeat an id and a vector count once; rows that share an id
    but not the vector are candidates each, and as queries ask together; no row of a query's id is
    its candidate. Ties go to the smaller id. An empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    whole = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")))
    sound = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    base = vectors.where(F.col("vec_id").isNotNull() & sound & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    base = write_table(base.distinct(), "vectors")
    sizes = base.agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).first()
    blocks = max(1, -(-(sizes["q"] or 0) // BLOCK))
    some = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(max(1, sizes["n"] // SAMPLE))) == 0
    sample = base.where(some).toArrow()
    ids, x = sample.column("vec_id").to_numpy().astype(np.int64), _matrix(sample.column("v"))
    found = None
    for block in range(blocks):
        rows = base.where(is_query & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block)).toArrow()
        q_ids, q = rows.column("vec_id").to_numpy().astype(np.int64), _matrix(rows.column("v"))
        shared = base.sparkSession.sparkContext.broadcast((q_ids, q, _thresholds(ids, x, q_ids, q, k)))
        got = base.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            got = write_table(got, "best")
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows by brute force.
SQL = """
WITH t AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM t q JOIN t c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
