"""Hard negatives by exact integer products in residues.

Whole-number vectors are reduced modulo several primes below 1024, so small that a float32 product of centred residues is
exact over a strip of dimensions. The products of all primes give the exact signed score by Chinese remaindering. Blocks of
anchors meet blocks of vectors twice: for the best rows of the anchor's label, and, with the limits that these set, for the
best rows of other labels within them. Each pair of blocks returns a few rows an anchor, and windows select among these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fableguard.llm.common import saved, table
from fableguard.llm.vector_search import usable

BLOCK = "block long, dim int, ids binary, labels binary, vectors binary, limits binary"
#: Rows of an anchor strip: what is held at once is a strip's scores with one block.
STRIP = 64
LOWEST = np.iinfo(np.int64).min


def _primes(below: int = 1024) -> list[int]:
    """Largest first."""
    sieve = np.ones(below, bool)
    sieve[:2] = False
    for k in range(2, int(below**0.5) + 1):
        sieve[k * k :: k] = sieve[k * k :: k] & ~sieve[k]
    return np.flatnonzero(sieve)[::-1].tolist()


PRIMES = _primes()


def moduli(bound: int) -> list[int]:
    """Primes whose product is above 2 * bound, so that a number between -bound and bound is told by its residues."""
    taken, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            return taken
        taken, product = [*taken, p], product * p
    raise ValueError("scores are too large for the residue system")


def residues(vectors: np.ndarray, p: int) -> np.ndarray:
    """Centred residues, as float32."""
    return ((vectors + p // 2) % p - p // 2).astype(np.float32)


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """The product of residues a (n, dim) and b (m, dim) modulo p, from exact float32 strips: int32 (n, m)."""
    strip = max(1, (2**24 - 1) // (p // 2) ** 2)
    total = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], strip):
        total += (a[:, at : at + strip] @ b[:, at : at + strip].T).astype(np.int32) % p
        total %= p
    return total


def largest(a: np.ndarray, b: np.ndarray) -> int:
    """A bound of all scores of a with b: the product of the longest vectors' lengths."""
    length = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0))
    return int(length(a) * length(b) * (1 + 1e-9)) + 1


class Residues:
    """The vectors of a block, reduced by all moduli that its scores need."""

    def __init__(self, vectors: np.ndarray, others: np.ndarray) -> None:
        self.bound = largest(vectors, others)
        self.primes = moduli(self.bound)
        self.parts = [residues(vectors, p) for p in self.primes]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact scores of anchors with the block, int64 (n, m); beyond 2^63 they wrap like a long product."""
        digits: list[np.ndarray] = []  # of score + bound, in mixed radix
        value, radix = None, 1
        for k, (p, part) in enumerate(zip(self.primes, self.parts, strict=True)):
            left = (product(residues(anchors, p), part, p) + self.bound % p) % p
            weight = 1
            for q, digit in zip(self.primes[:k], digits, strict=True):
                left -= digit * (weight % p) % p
                weight *= q
            digit = left % p * pow(radix, -1, p) % p
            digits.append(digit)
            with np.errstate(over="ignore"):
                term = digit.astype(np.uint64) * np.uint64(radix % 2**64)
                value = term if value is None else value + term
            radix *= p
        with np.errstate(over="ignore"):
            return (value - np.uint64(self.bound % 2**64)).view(np.int64)


def _pack(rows: list[tuple], limits: int) -> dict:
    ids, labels, vectors, *rest = zip(*rows, strict=True)
    ids, labels, vectors = np.array(ids, np.int64), np.array(labels, np.int64), np.array(vectors, np.int64)
    small = next(t for t in (np.int16, np.int32, np.int64) if (np.abs(vectors) <= np.iinfo(t).max).all() or t is np.int64)
    order = np.lexsort((ids, labels))
    out = {"block": int(ids.min()), "dim": vectors.shape[1], "ids": ids[order].tobytes(), "labels": labels[order].tobytes()}
    out["vectors"] = np.dtype(small).str.encode() + vectors[order].astype(small).tobytes()
    held = np.array(rest[0], np.int64).reshape(len(ids), limits)[order] if limits else np.empty(0, np.int64)
    return out | {"limits": held.tobytes()}


def _vectors(packed: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(packed, np.dtype(packed[:3].decode()), offset=3).reshape(-1, dim).astype(np.int64)


def blocks(df: DataFrame, size: int, limits: int = 0) -> DataFrame:
    """Rows (id, label, vec and, if asked, so many limits) as blocks of up to ``size`` rows of one dimension; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                rows = held.setdefault(len(row[2]), [])
                rows.append(row)
                if len(rows) == size:
                    yield pd.DataFrame([_pack(held.pop(len(row[2])), limits)])
        for rows in held.values():
            yield pd.DataFrame([_pack(rows, limits)])

    return df.mapInPandas(run, BLOCK)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above LOWEST, ties by smaller id."""
    at = np.flatnonzero(scores > LOWEST)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _same_label(row: dict, k: int) -> Iterator[tuple]:
    """(anchor, vec_id, score): each anchor's k best rows of its own label in the block."""
    dim = row["dim"]
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    anchors, of = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
    vectors, asked = _vectors(row["vectors"], dim), _vectors(row["a_vectors"], dim)
    for label in np.unique(of):
        low, high = np.searchsorted(labels, [label, label + 1])
        if low == high:
            continue
        part, mine = Residues(vectors[low:high], asked), np.flatnonzero(of == label)
        for at in range(0, len(mine), STRIP):
            strip = mine[at : at + STRIP]
            scores = part.scores(asked[strip])
            scores[ids[None, low:high] == anchors[strip, None]] = LOWEST
            for own, n in zip(scores, strip, strict=True):
                for j in _best(own, ids[low:high], k):
                    yield int(anchors[n]), int(ids[low + j]), int(own[j])


def _other_labels(row: dict, k: int, positives: int) -> Iterator[tuple]:
    """(anchor, positive_id, positive_score, negative_id, negative_score): k best rows of other labels within the limits."""
    dim = row["dim"]
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    anchors, of = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
    asked = _vectors(row["a_vectors"], dim)
    part = Residues(_vectors(row["vectors"], dim), asked)
    limits = np.frombuffer(row["a_limits"], np.int64).reshape(len(anchors), 1 + 2 * positives)
    for at in range(0, len(anchors), STRIP):
        all_scores = part.scores(asked[at : at + STRIP])
        all_scores[labels[None] == of[at : at + STRIP, None]] = LOWEST
        for own, n in zip(all_scores, range(at, len(anchors)), strict=False):
            for j in range(limits[n, 0]):
                positive, score = limits[n, 1 + 2 * j : 3 + 2 * j]
                least, most = -(-score // 2), score - (-(-score // 20))  # of 50 p <= 100 n <= 95 p
                if least > most:
                    continue
                for m in _best(np.where((own >= least) & (own <= most), own, LOWEST), ids, k):
                    yield int(anchors[n]), int(positive), int(score), int(ids[m]), int(own[m])


def _met(held: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """Every block of anchors with every block of vectors of its dimension; a row is bounded by two blocks.

    Where the anchors are few enough Spark broadcasts them; else both sides are dealt over parts of either.
    """
    asked = asked.select(F.col("dim").alias("a_dim"), *(F.col(c).alias(f"a_{c}") for c in ("block", "ids", "labels", "vectors", "limits")))
    asked = asked.withColumn("a_part", F.pmod(F.xxhash64("a_block"), F.lit(parts)).cast("int"))
    spread = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread.join(asked, (F.col("dim") == F.col("a_dim")) & (F.col("part") == F.col("a_part")))


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, block: int = 16384, anchor_block: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of anchors against all vectors.

    Both are (id, label, vec of whole numbers) with one row an id. Positives are an anchor's best other rows of its label;
    negatives of a positive the best rows of other labels with a score from 50 to 95 hundredths of the positive's. Ties go to
    the smaller id. Vectors of another dimension are neither. Scores are exact below 2^63. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    n = vectors.count()
    size = max(256, min(block, -(-n // tasks)))
    dealt = vectors.repartition(max(1, -(-n // size)), "id")
    held = saved(blocks(dealt, size), "vector-blocks")
    parts = max(1, -(-anchors.count() // anchor_block))
    by_part = anchors.repartition(parts, F.pmod(F.xxhash64("id"), F.lit(parts)))

    def positive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame(_same_label(row, positives), columns=["anchor_id", "positive_id", "score"]).astype("int64")

    def negative(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
                yield pd.DataFrame(_other_labels(row, negatives, positives), columns=names).astype("int64")

    asked = saved(blocks(by_part, anchor_block), "anchor-blocks")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = _met(held, asked, parts).mapInPandas(positive, "anchor_id long, positive_id long, score long")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    # An anchor's positives: how many, then id and score of each, the rest zeros.
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))), lambda x: F.array(x["positive_id"], x["score"])))
    full = F.concat(F.array(F.count("*")), flat, F.array_repeat(F.lit(0).cast("long"), (2 * positives - F.size(flat)).cast("int")))
    limits = saved(found.groupBy(F.col("anchor_id").alias("id")).agg(full.alias("limits")), "positives")
    limited = by_part.join(limits, "id").select("id", "label", "vec", "limits")
    limited = limited.repartition(parts, F.pmod(F.xxhash64("id"), F.lit(parts)))
    asked = saved(blocks(limited, anchor_block, 1 + 2 * positives), "limited-blocks")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = _met(held, asked, parts).mapInPandas(negative, schema)
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def rows_of(embeddings: DataFrame) -> DataFrame:
    """id, label, vec of the rows that take part; of rows with one vec_id the one with the smallest label, then vector."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    label = F.col("label").cast("long")
    rows = embeddings.where(ok).select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vec"),
    )
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.*")


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors, the rows with vec_id divisible by 50, among all rows."""
    rows = saved(rows_of(table(spark, sf_dir, "embeddings")), "vectors")
    return mine(rows, rows.where(F.col("id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT DISTINCT ON (vec_id) vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ORDER BY vec_id, label, q),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score,
       s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
