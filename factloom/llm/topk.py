"""Exact top-k inner-product search, pruned by multi-resolution segment statistics.

A vector is cut into segments, and of each segment only the mean and the deviation are looked at first. With segment
length m, means a and b, and deviations s and t, the inner product of two segments lies within m*a*b +- m*s*t, so

    score(q, x) <= sum over segments of m * (a_q * a_x + s_q * s_x)

(for vectors of one norm this is the lower bound on their distance). Few segments give a loose bound that costs little;
every finer level tightens it for what survived, and only the last survivors are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score long"
_SAFE = 2**53


def quantize(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) with x as double; Python integers where 64 bits don't hold them."""
    floors = np.floor(scale * vectors.astype(np.float64))
    if floors.size and np.abs(floors).max() >= 2**62:
        return np.vectorize(int, otypes=[object])(floors)
    return floors.astype(np.int64)


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of ``segments`` parts, each weighted by the root of its length, side by side."""
    edges = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    starts, lengths = edges[:-1], np.diff(edges)
    means = np.add.reduceat(vectors, starts, axis=1) / lengths
    squares = np.add.reduceat(vectors * vectors, starts, axis=1) / lengths
    deviations = np.sqrt(np.maximum(squares - means * means, 0))
    return np.concatenate([means * np.sqrt(lengths), deviations * np.sqrt(lengths)], axis=1)


def block_topk(query_ids, queries, ids, vectors, k: int, levels: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the k best of one block: (query id repeated, ids, scores)."""
    width = vectors.shape[1]
    exact = object in (vectors.dtype, queries.dtype) or width * float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) >= _SAFE
    wide_v, wide_q = vectors.astype(np.float64), queries.astype(np.float64)
    levels = tuple(g for g in levels if g <= width) or (1,)
    stats = [] if exact or not width else [(segment_statistics(wide_v, g), segment_statistics(wide_q, g)) for g in levels]
    norm = np.sqrt((wide_v**2).sum(axis=1).max(initial=0)) if not exact else 0.0
    for i, own in enumerate(query_ids):
        alive = np.flatnonzero(ids != own)
        if stats and len(alive) > 4 * k:
            slack = 1e-9 * norm * float(np.sqrt((wide_q[i] ** 2).sum())) + 1e-6
            bound = stats[0][0][alive] @ stats[0][1][i]
            seeds = alive[np.argpartition(-bound, 2 * k)[: 2 * k]]
            floor = np.sort(wide_v[seeds] @ wide_q[i])[-k] - slack
            alive = alive[bound >= floor]
            for of_vectors, of_queries in stats[1:]:
                if len(alive) <= 2 * k:
                    break
                alive = alive[of_vectors[alive] @ of_queries[i] >= floor]
        if exact:
            scores = np.array([min(max(sum(int(a) * int(b) for a, b in zip(v, queries[i])), -(2**63)), 2**63 - 1) for v in vectors[alive]], dtype=np.int64)
        else:
            scores = np.rint(wide_v[alive] @ wide_q[i]).astype(np.int64)
        best = np.lexsort((ids[alive], -scores))[:k] if not exact else np.array(sorted(range(len(alive)), key=lambda j: (-int(scores[j]), int(ids[alive][j])))[:k], dtype=int)
        yield np.full(len(best), own), ids[alive][best], scores[best]


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    levels: tuple[int, ...] = (4, 16),
    block_rows: int = 8192,
    query_rows: int = 8192,
    block_values: int = 1 << 19,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` where ``is_query`` holds, its k best other rows.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Score: integer inner product of
    floor(scale * x). Ties go to the smaller id. Null ids, null vectors and those that hold a null or a non-finite
    component take no part; of rows with one id the least vector counts; vectors of different lengths aren't compared;
    a score beyond 64 bits is held at their limit. Queries and candidates are dealt into blocks by a hash of the id, of
    ``query_rows`` and ``block_rows`` rows and about ``block_values`` components at most, and each pair of blocks is one group:
    no group grows with the data. A vector is sent once for each block of the other side, so larger blocks send less.
    """
    spark = vectors.sparkSession
    clean = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query"))
        .where(F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"), F.first("is_query").alias("is_query"))
        .withColumn("dim", F.size("embedding"))
    )
    n, n_queries, dim = clean.agg(F.count("*"), F.count_if("is_query"), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(64, block_values // max(1, dim))
    blocks, query_blocks = max(1, math.ceil(n / min(block_rows, most))), max(1, math.ceil(n_queries / min(query_rows, most)))
    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = clean.where("is_query").select("dim", block(query_blocks).alias("qb"), every(blocks).alias("cb"), "vec_id", "embedding")
    rows = clean.select("dim", every(query_blocks).alias("qb"), block(blocks).alias("cb"), "vec_id", "embedding")

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        q, v = (quantize(np.stack(x["embedding"].to_numpy()), scale) for x in (asked, held))
        found = list(block_topk(asked["vec_id"].to_numpy(), q, held["vec_id"].to_numpy(), v, k, levels))
        return pd.DataFrame({name: np.concatenate([x[i] for x in found]) for i, name in enumerate(("query_id", "vec_id", "score"))})

    by = ["dim", "qb", "cb"]
    met = queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(best, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
