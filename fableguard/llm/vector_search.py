"""Exact top-k inner product by vector-approximation files.

Vectors are packed into blocks of bounded size. A block keeps, beside its exact vectors, a quantised copy: the cell of
every component (16 cells per dimension and block) and the cells' edges. A query reads the cells first, which bound
its score with every vector from both sides, and then reads exact vectors in order of the upper bound until no
remaining bound reaches the kth score found. Blocks of queries meet blocks of vectors; each pair returns its k best ids.
Where the query blocks are small enough for Spark to broadcast they come to the vectors; else both sides are dealt over
the pairs of a part of the queries and a part of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fableguard.llm.common import saved, table

CELLS = 16
BLOCK = "dim int, ids binary, cells binary, low binary, high binary, vectors binary"


def usable(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & ok


def _pack(ids: list[int], vectors: np.ndarray) -> dict:
    if len(set(ids)) < len(ids):  # equal rows once
        rows = np.unique(np.column_stack([np.asarray(ids, np.int64), vectors]), axis=0)
        ids, vectors = rows[:, 0], np.ascontiguousarray(rows[:, 1:])
    low, high = vectors.min(0), vectors.max(0)
    cells = np.minimum((vectors - low) * CELLS // np.maximum(high - low + 1, 1), CELLS - 1).astype(np.uint8)
    low_of, high_of = np.zeros((CELLS, vectors.shape[1]), np.int64), np.zeros((CELLS, vectors.shape[1]), np.int64)
    for c in range(CELLS):  # the edges of a cell: its least and greatest component
        at = cells == c
        low_of[c] = np.where(at, vectors, np.iinfo(np.int64).max).min(0)
        high_of[c] = np.where(at, vectors, np.iinfo(np.int64).min).max(0)
    return {"dim": vectors.shape[1], "ids": np.asarray(ids, np.int64).tobytes(), "cells": cells.tobytes(), "low": low_of.tobytes(), "high": high_of.tobytes(), "vectors": vectors.tobytes()}


def blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows (id, vec of whole numbers) as blocks of up to ``size`` vectors of one dimension; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["vec"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield pd.DataFrame([_pack(ids, np.array(vectors, np.int64))])
                    del held[len(v)]
        for ids, vectors in held.values():
            yield pd.DataFrame([_pack(ids, np.array(vectors, np.int64))])

    return df.mapInPandas(run, BLOCK)


def _best(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Where each id has its best score."""
    order = np.lexsort((-scores, ids))
    return order[np.diff(ids[order], prepend=ids[order[0]] - 1) != 0]


def _scan(row: dict, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score): each query's k best ids of the block, an id counting by its best vector."""
    dim = row["dim"]
    ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
    once = len(np.unique(ids)) == len(ids)
    best = lambda of, scores: np.arange(len(of)) if once else _best(of, scores)
    exact = np.frombuffer(row["vectors"], np.int64).reshape(-1, dim)
    queries = np.frombuffer(row["q_vectors"], np.int64).reshape(-1, dim).astype(np.float64)
    cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, dim)
    low = np.take_along_axis(np.frombuffer(row["low"], np.int64).reshape(CELLS, dim), cells, 0).astype(np.float64)
    high = np.take_along_axis(np.frombuffer(row["high"], np.int64).reshape(CELLS, dim), cells, 0).astype(np.float64)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    # What sums of doubles may be off by: nothing that counts until they pass 2^50.
    slack = dim * float(np.abs(queries).max(initial=0)) * float(np.abs(exact.astype(np.float64)).max(initial=0)) * 2.0**-50
    for at in range(0, len(queries), 128):
        upper = plus[at : at + 128] @ high.T + minus[at : at + 128] @ low.T + slack
        lower = plus[at : at + 128] @ low.T + minus[at : at + 128] @ high.T - slack
        for j, (up, lo) in enumerate(zip(upper, lower, strict=True), at):
            other = ids != own[j]
            if not other.any():
                continue
            least = lo[other][best(ids[other], lo[other])]
            sure = np.partition(least, -k)[-k] if len(least) > k else -np.inf  # k ids score at least this
            left = np.flatnonzero(other & (up >= sure))
            left = left[np.argsort(-up[left], kind="stable")]
            scores, kth, read = np.empty(0, np.int64), -np.inf, 0
            while read < len(left) and up[left[read]] >= kth:
                scores = np.append(scores, exact[left[read : read + 64]] @ queries[j].astype(np.int64))
                read = len(scores)
                at_best = best(ids[left[:read]], scores)
                kth = np.partition(scores[at_best], -k)[-k] if len(at_best) >= k else -np.inf
            for n in at_best[np.lexsort((ids[left[at_best]], -scores[at_best]))[:k]]:
                yield int(own[j]), int(ids[left[n]]), int(scores[n])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192, query_block: int = 1024, task_blocks: int = 64) -> DataFrame:
    """The k best of vectors for each row of queries, both (id, vec of whole numbers): query_id, rank, vec_id, score.

    A query's own id is no candidate; repeated rows of one id count as one, by their best vector; ties go to the smaller
    id; vectors of another dimension than the query's are no candidates. Scores are exact below 2^63. Empty tables give
    no rows.
    """
    parts, salts = max(1, -(-queries.count() // query_block)), max(1, -(-vectors.count() // (block * task_blocks)))
    # Queries are dealt into parts of about query_block; a part may make more than one block, of one dimension each.
    dealt = queries.repartition(parts, F.pmod(F.xxhash64("id", "vec"), F.lit(parts)))
    asked = blocks(dealt, query_block).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("q_ids"), F.lit(parts))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    asked = saved(asked, "query-blocks")
    # Blocks meet blocks, a stated query set against all rows: each pair is one row of bounded size.
    held = blocks(vectors, block).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    pairs = held.join(asked, (F.col("dim") == F.col("q_dim")) & (held["part"] == asked["part"]) & (held["salt"] == asked["salt"])).select(*held.columns[:6], "q_ids", "q_vectors")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame(_scan(row, k), columns=["query_id", "vec_id", "score"]).astype("int64")

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_approximation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vec"))
    rows = saved(rows, "vectors")
    return search(rows, rows.where(F.col("id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, max(CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT)) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q) GROUP BY a.vec_id, b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
