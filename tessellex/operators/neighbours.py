"""Exact nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 2000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, other, sim``: the k vectors of greatest cosine for each query.

    Queries go to the tasks in blocks of ``block_rows``; each task keeps k
    candidates per query, so only those shuffle. A query isn't its own
    neighbour; ties go to the smaller id; null vectors match nothing.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block_rows))
    rows = vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v"))
    parts = None
    for b in range(blocks):
        some = queries.where((F.pmod(F.xxhash64(id_column), F.lit(blocks)) == b) & F.col(vector_column).isNotNull()).select(id_column, vector_column).collect()
        if not some:
            continue
        ids = np.array([r[0] for r in some], np.int64)
        unit = np.array([r[1] for r in some], np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((ids, unit))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, q = shared.value
            for batch in batches:
                other = batch["vec_id"].to_numpy(np.int64)
                v = np.stack(batch["v"].to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                sim = np.round(q @ v.T, 5)
                sim[own[:, None] == other[None]] = -np.inf
                out = []
                for i in range(len(own)):
                    best = np.lexsort((other, -sim[i]))[:k]
                    out.extend((int(own[i]), int(other[j]), float(sim[i, j])) for j in best if np.isfinite(sim[i, j]))
                yield pd.DataFrame(out, columns=["vec_id", "other", "sim"])

        part = rows.mapInPandas(run, "vec_id bigint, other bigint, sim double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "vec_id bigint, other bigint, sim double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "other"))
    return parts.withColumn("place", place).where(F.col("place") <= k).drop("place")
