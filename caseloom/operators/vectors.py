"""Best matches of a stated set of query vectors among all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors in a block, which is broadcast: 10,000 of 64 doubles are five megabytes, whatever the table.
BLOCK = 10_000
QUERY_STEP = 50


def _block_scores(vectors: DataFrame, ids: np.ndarray, block: np.ndarray, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, unit = shared.value
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            m = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(rows), -1)
            norms = np.linalg.norm(m, axis=1)
            ok = norms > 0
            rows, m = rows[ok], m[ok] / norms[ok, None]
            if not len(rows):
                continue
            scores = np.round(unit @ m.T, 6)
            scores[asked[:, None] == rows[None, :]] = -np.inf
            top = np.lexsort((np.broadcast_to(rows, scores.shape), -scores), axis=1)[:, :k]
            q, s, v = np.repeat(asked, top.shape[1]), np.take_along_axis(scores, top, 1).ravel(), rows[top].ravel()
            keep = np.isfinite(s)
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(v[keep]), pa.array(s[keep])], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def top_matches(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, embedding) -> query_id, vec_id, score: the k likest by cosine of every vec_id divisible by QUERY_STEP.

    Queries go in blocks of a fixed size; each is held against all rows in one
    pass, in which every batch keeps k rows per query before anything is
    shuffled. Ties go to the smaller vec_id. Null vectors, and such of length 0,
    match nothing.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    asked = v.where(F.col("vec_id") % QUERY_STEP == 0)
    lo, hi = asked.agg(F.min("vec_id"), F.max("vec_id")).first()
    parts = []
    for begin in range(lo, hi + 1, BLOCK * QUERY_STEP) if lo is not None else ():
        rows = asked.where(F.col("vec_id").between(begin, begin + BLOCK * QUERY_STEP - 1)).collect()  # BLOCK different ids at most
        m = np.array([r.e for r in rows], np.float64)
        norms = np.linalg.norm(m, axis=1) if len(rows) else np.zeros(0)
        ok = norms > 0
        if ok.any():
            parts.append(_block_scores(v, np.array([r.vec_id for r in rows])[ok], m[ok] / norms[ok, None], k))
    if not parts:
        return v.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("_r", r).where(F.col("_r") <= k).drop("_r")
