"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become whole numbers floor(64 x). A vector is cut into segments, few and long first, then
more and shorter; each keeps its mean and its deviation (the length of what is left after the
mean). Over a segment of n components the inner product of q and x is n times the product of the
means plus the product of what is left, which is at most the product of the deviations. Summed
over segments this bounds the inner product from above, the same as a lower bound on the
distance |q|^2 + |x|^2 - 2qx. A block of queries meets a block of candidates: the coarse bound
picks candidates whose exact scores set each query's threshold, coarse and then fine bounds
below it drop the rest, and only survivors get exact scores. The bounds never drop a winner.

Queries and candidates are dealt in blocks of at most ``BLOCK`` rows on average; each pair of
blocks is a task that returns k rows a query, which are merged in one more step. Blocks are by
a hash of the row and its stored number, so copies of one vector spread like any others, and all
copies of a row that a deal makes carry the same block number.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; an
empty vector scores 0; only vectors of one length are compared; rows whose id repeats are rows of
their own, but never candidates of a query of the same id; rows with a null id take no part.
Components must fit floor(64 x) within 2^23. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K, QUERY_MODULUS, SCALE = 20, 20, 64
BLOCK = 8192
#: Segments per vector, coarse to fine.
LEVELS = (4, 16)
#: Queries whose bounds are held at a time.
STRIPE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: whole numbers as doubles, of the vectors that take part."""
    x = lambda e: e.cast("double")
    sound = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < float("inf")))
    d = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: F.floor(x(e) * SCALE).cast("double")).alias("v"))


def statistics(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of the segment's length, and deviations, by row and segment."""
    cuts = np.linspace(0, v.shape[1], min(segments, max(1, v.shape[1])) + 1).astype(int)
    means, left = [], []
    for a, b in zip(cuts, cuts[1:]):
        part = v[:, a:b]
        n = max(1, b - a)
        total = part.sum(1)
        means.append(total / math.sqrt(n))
        left.append(np.sqrt(np.maximum(0.0, (part * part).sum(1) - total * total / n)))
    return np.stack(means, 1), np.stack(left, 1)


def bounds(q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    # A little is added, more than rounding can take away.
    out = q[0] @ x[0].T + q[1] @ x[1].T
    return out + 1e-6 * (1.0 + np.abs(out))


def best(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best candidates of another id, ties to smaller ids.

    A stripe of queries is worked on together: its exact scores are one product over the candidates
    that survive for any of them, in which those that a query's bounds dropped do not count.
    """
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    coarse, fine = (statistics(x, s) for s in LEVELS)
    out, m = [], min(2 * k, len(x))
    for at in range(0, len(q), STRIPE):
        block, own = q[at : at + STRIPE], q_ids[at : at + STRIPE]
        upper = bounds(statistics(block, LEVELS[0]), coarse)
        upper[own[:, None] == x_ids[None, :]] = -np.inf
        # Exact scores of the candidates with the highest bounds set each query's threshold.
        tried = np.argpartition(-upper, m - 1, axis=1)[:, :m]
        scores = np.einsum("imd,id->im", x[tried], block)
        scores[np.take_along_axis(upper, tried, 1) == -np.inf] = -np.inf
        least = np.partition(scores, m - k, axis=1)[:, m - k] if m >= k else np.full(len(block), -np.inf)
        alive = (upper >= least[:, None]) & (upper > -np.inf)
        some = np.flatnonzero(alive.any(0))
        alive = alive[:, some] & (bounds(statistics(block, LEVELS[1]), (fine[0][some], fine[1][some])) >= least[:, None])
        left = np.flatnonzero(alive.any(0))
        some, alive = some[left], alive[:, left]
        scores = np.where(alive, block @ x[some].T, -np.inf)
        for i, row in enumerate(scores):
            if len(row) > k:
                row_least = max(np.partition(row, len(row) - k)[len(row) - k], -1e300)
                hit = np.flatnonzero(row >= row_least)
            else:
                hit = np.flatnonzero(row > -np.inf)
            top = hit[np.lexsort((hit, -row[hit]))[:k]]
            out += [(int(own[i]), int(x_ids[some[t]]), int(row[t])) for t in top]
    return out


def top_k(vectors: DataFrame, k: int = K, modulus: int = QUERY_MODULUS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``modulus`` its k best other rows."""
    # The row's number is stored: worked out beside an explode it would differ between a row's copies.
    rows = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "search-vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % modulus == 0)).first()
    q_blocks, x_blocks = max(1, math.ceil(n_queries / BLOCK)), max(1, math.ceil(n / BLOCK))
    at = lambda blocks: F.pmod(F.xxhash64("vec_id", "v", "row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.where(F.col("vec_id") % modulus == 0).select(F.lit(True).alias("asks"), "vec_id", "v", at(q_blocks).alias("qb"), every(x_blocks).alias("xb"))
    candidates = rows.select(F.lit(False).alias("asks"), "vec_id", "v", every(q_blocks).alias("qb"), at(x_blocks).alias("xb"))
    dealt = queries.unionByName(candidates.select("asks", "vec_id", "v", "qb", "xb")).withColumn("dim", F.size("v"))

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids = group.column("vec_id").to_numpy()
        dim = group.column("dim")[0].as_py()
        v = group.column("v").combine_chunks()
        flat = (v.flatten() if isinstance(v, (pa.ListArray, pa.LargeListArray)) else pa.concat_arrays([c.flatten() for c in v.chunks])).to_numpy().reshape(len(ids), dim)
        found = best(ids[asks], flat[asks], ids[~asks], flat[~asks], k) if asks.any() and (~asks).any() else []
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    found = dealt.groupBy("dim", "qb", "xb").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
