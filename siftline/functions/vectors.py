"""Vector columns in double precision, and exact top-k search in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(as_double(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def exact_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, *, earlier: bool = False, query_block: int = 2048, vector_block: int = 65536,
) -> DataFrame:
    """(query_id, id, similarity, rank): the k vectors of greatest dot product for each query.

    ``queries`` and ``vectors``: (id, v), of one length. Blocks of queries meet
    blocks of vectors, one task a pair of blocks, and only the best k of each meeting
    are shuffled on. With ``earlier`` a query sees ids below its own only; a query
    never finds its own id.
    """
    n_q, n_v = queries.count(), vectors.count()
    qb, vb = -(-max(1, n_q) // query_block), -(-max(1, n_v) // vector_block)
    left = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.pmod(F.xxhash64("id"), F.lit(qb)).cast("long").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(vb - 1))).alias("vb"))
    right = vectors.select(F.col("id").alias("vid"), F.col("v").alias("vv"), F.pmod(F.xxhash64("id"), F.lit(vb)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1)).cast("array<bigint>")).alias("qb"))
    id_type = dict(vectors.dtypes)["id"]

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": q["qid"][:0], "id": v["vid"][:0], "similarity": np.zeros(0)})
        x, y = np.stack(q["qv"].to_list()).astype(np.float64), np.stack(v["vv"].to_list()).astype(np.float64)
        qid, vid = q["qid"].to_numpy(), v["vid"].to_numpy()
        out = []
        for s in range(0, len(x), 256):
            sim = x[s : s + 256] @ y.T
            own = qid[s : s + 256, None] <= vid[None] if earlier else qid[s : s + 256, None] == vid[None]
            sim[own] = -np.inf
            edge = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k, None] if sim.shape[1] > k else np.full((len(sim), 1), -np.inf)
            i, j = np.nonzero((sim >= edge - 1e-9) & np.isfinite(sim))
            out.append(pd.DataFrame({"query_id": qid[s + i], "id": vid[j], "similarity": sim[i, j]}))
        return pd.concat(out)

    met = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(meet, f"query_id {id_type}, id {id_type}, similarity double")
    met = met.withColumn("similarity", F.round("similarity", 9))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)
