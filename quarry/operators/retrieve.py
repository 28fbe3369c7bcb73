"""Exact nearest-neighbour search by squared L2 distance (K1) and metadata join (K2).

The index is read once for all queries whose vectors together take at most
``query_bytes`` (checked before they are collected; a larger set is dealt by hash into
parts of that size, one reading of the index each). A task computes the distances of a block of its
rows to a block of queries as one matrix product. That product rounds, so it only rules rows out:
those that may be as near as the query's k-th so far, allowing for rounding, are measured exactly. Each task keeps its
local top k per query, so at most partitions x k candidates per query are shuffled; the
final top k per query is chosen among those. Nothing of size index x queries is ever held.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that the driver and each task hold at once (half a million vectors of 64 doubles).
QUERY_BYTES = 256 << 20
_BLOCK = 512  # queries, and rows, of one matrix product


def _local_topk(q_ids, q_mat, k, id_col, vec_col):
    n_q, dim = q_mat.shape
    q_norm = (q_mat ** 2).sum(axis=1)

    def run(batches):
        near = np.full((n_q, k), np.inf)       # distances, ascending; ids beside them break ties
        ids_of = np.full((n_q, k), np.iinfo(np.int64).max)
        for pdf in batches:
            vecs = pdf[vec_col].tolist()
            ok = [i for i, v in enumerate(vecs) if v is not None and len(v) == dim]
            ids = pdf[id_col].to_numpy()
            for at in range(0, len(ok), _BLOCK):
                rows = ok[at:at + _BLOCK]
                x = np.array([np.asarray(vecs[i], dtype=np.float64) for i in rows])
                block_ids = ids[rows].astype(np.int64)
                x_norm = (x ** 2).sum(axis=1)
                # far more than what a product of this many terms can round
                slack = 1e-12 * dim * (x_norm.max(initial=0.0) + q_norm.max(initial=0.0))
                for b in range(0, n_q, _BLOCK):
                    q = slice(b, b + _BLOCK)
                    about = q_norm[q, None] - 2.0 * (q_mat[q] @ x.T) + x_norm
                    limit = near[q, -1]
                    if about.shape[1] > k:
                        limit = np.minimum(limit, np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * slack)
                    # not "<=": vectors with components that are not finite stay in
                    qi, xi = np.nonzero(~(about > (limit + 2 * slack)[:, None]))
                    if not len(qi):
                        continue
                    d = ((x[xi] - q_mat[b + qi]) ** 2).sum(axis=1)
                    touched = np.unique(qi)
                    all_q = np.concatenate([qi, np.repeat(touched, k)])
                    all_d = np.concatenate([d, near[b + touched].ravel()])
                    all_i = np.concatenate([block_ids[xi], ids_of[b + touched].ravel()])
                    order = np.lexsort((all_i, all_d, all_q))
                    starts = np.searchsorted(all_q[order], touched)
                    take = order[starts[:, None] + np.arange(k)]
                    near[b + touched], ids_of[b + touched] = all_d[take], all_i[take]
        qi, place = np.nonzero(near < np.inf)
        if len(qi):
            yield pd.DataFrame({"_q": qi, "_query": np.asarray(q_ids)[qi], id_col: ids_of[qi, place], "distance": near[qi, place]})
    return run


def knn_l2(index: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "vec_id",
           vec_col: str = "embedding", query_id_col: str = "query_id", query_vec_col: str = "query_vec",
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """K1: for each query the k nearest index rows: (query_id, id, distance, score = 1/(1+d), rank).

    Rows whose vector length differs from the queries' dimension, and rows at no finite
    distance, are ignored. Ties are broken by id. Queries may share an id; one without a vector has no hits.
    """
    spark = index.sparkSession
    wanted = queries.select(F.col(query_id_col).cast("long").alias("q"), F.col(query_vec_col).cast("array<double>").alias("v")).where("v is not null")
    total = wanted.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    parts = -(-total // query_bytes)
    results = []
    for part in range(parts):
        mine = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("q", "v"), F.lit(parts)) == part)
        got = mine.toArrow()                                   # bounded by query_bytes
        if not got.num_rows:
            continue
        q_mat = np.array([np.asarray(v, dtype=np.float64) for v in got.column("v").to_pylist()])
        local = index.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInPandas(
            _local_topk(got.column("q").to_numpy(), q_mat, k, id_col, vec_col),
            f"_q long, _query long, {id_col} long, distance double")
        # queries are told apart by their place in the part: two may have one id
        w = Window.partitionBy("_q").orderBy(F.asc("distance"), F.asc(id_col))
        # each query's window holds at most (#partitions x k) candidates
        top = local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        results.append(top.select(F.col("_query").alias("query_id"), id_col, "distance", "rank"))
    if not results:
        return spark.createDataFrame([], f"{query_id_col} long, {id_col} long, distance double, score double, rank int")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.col("query_id").alias(query_id_col), id_col, "distance",
                      (1.0 / (1.0 + F.col("distance"))).alias("score"), "rank")


def with_metadata(hits: DataFrame, metadata: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """K2: attach each hit's metadata row (hits are bounded: queries x k)."""
    return hits.join(metadata, id_col, "left")


def label_centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label (a distributed group-by over (label, dimension))."""
    exploded = vectors.select(label_col, F.posexplode(vec_col).alias("pos", "x"))
    means = exploded.groupBy(label_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (means.groupBy(label_col)
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
                 .select(F.col(label_col).cast("long").alias("query_id"),
                         F.transform("s", lambda e: e["m"]).alias("query_vec")))
