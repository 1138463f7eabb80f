"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Candidates are cut into blocks and turned into postings (dimension -> rows, weights). A query is its non-zero
dimensions; each scatters weight x posting into a dense score array of the block. A block gives at most k rows
per query, which a window merges. Queries meet candidates block against block, so neither side is ever whole
in one task; nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): v[i] = floor(scale * x) of the double x. Rows with a null id, a null vector or a null or non-finite component are left out."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))


def _postings(vectors: list[np.ndarray]) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per dimension: the rows with a weight (None: all of them) and the weights. Missing components are zero."""
    width = max(map(len, vectors))
    dense = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        dense[i, : len(v)] = v
    out = []
    for column in np.ascontiguousarray(dense.T):
        rows = np.flatnonzero(column)
        out.append((None, column) if len(rows) == len(column) else (rows, column[rows]))
    return out


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place; `own` places take no part."""
    places = np.delete(np.arange(len(scores)), own) if len(own) else np.arange(len(scores))
    held = scores[places]
    if len(held) > k:
        least = np.partition(held, len(held) - k)[len(held) - k]
        above, equal = np.flatnonzero(held > least), np.flatnonzero(held == least)
        places = places[np.concatenate([above, equal[: k - len(above)]])]
    return places


def _search(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        block = block.sort_values("id", kind="stable")
        ids, postings = block["id"].to_numpy(), _postings(list(block["v"]))
        found = []
        for query, vector in zip(queries["id"], queries["v"], strict=True):
            scores = np.zeros(len(ids), dtype=np.int64)
            for dim in np.flatnonzero(vector[: len(postings)]):
                rows, weights = postings[dim]
                if rows is None:
                    scores += vector[dim] * weights
                else:
                    scores[rows] += vector[dim] * weights
            first, end = np.searchsorted(ids, query, "left"), np.searchsorted(ids, query, "right")
            best = _best(scores, np.arange(first, end), k)
            found.append(np.column_stack([np.full(len(best), query), ids[best], scores[best]]))
        return pd.DataFrame(np.concatenate(found), columns=["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int, candidate_block: int = 4096, query_block: int = 8192) -> DataFrame:
    """Each query's k highest inner products among the candidates of another id: (query_id, rank, vec_id, score).

    Both sides are (id long, v array<long>); |v| must stay below 2**26 so that scores fit in a long. Fewer than
    k candidates: all of them. Candidates that repeat an id are candidates each; queries that repeat an id share one
    list of k. Vectors of unequal length are filled up with zeros. Empty tables give no rows.
    """
    n_blocks = max(1, -(-candidates.count() // candidate_block))
    q_blocks = max(1, -(-queries.count() // query_block))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    c = candidates.withColumn("cb", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
