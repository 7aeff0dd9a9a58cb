"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary per partition finds the digests that may be frequent. Their exact counts and winners are
verified, broadcast (at most ``counters`` rows) and decide all losing rows on the map side; only the other digests are
shuffled. The winners' rows, equal in id and digest, are counted and made again from their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fableguard.llm.common import repeated, saved, table


def summaries(keyed: DataFrame, counters: int) -> DataFrame:
    """Misra-Gries summaries (digest, weight), one of at most ``counters`` entries per partition.

    A digest that holds more than 1/(counters+1) of all rows does so in some partition too, and is in its summary.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for pdf in batches:
            for digest, n in pdf["digest"].value_counts().items():
                held[digest] = held.get(digest, 0) + int(n)
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {d: n - cut for d, n in held.items() if n > cut}
        yield pd.DataFrame({"digest": list(held), "weight": list(held.values())}).astype({"digest": str, "weight": "int64"})

    return keyed.select("digest").mapInPandas(run, "digest string, weight long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as empty. Among repeated rows (same id, same
    text) exactly one is kept; rows without id stay only if no row of their group has one. An empty table gives no rows.
    """
    keyed = saved(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest")), "digests")
    total = keyed.count()
    candidates = summaries(keyed, counters).groupBy("digest").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "digest").limit(counters).select("digest")
    heavy = keyed.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("heavy_size"), F.max("doc_id").alias("heavy_keep"))
    # Verified: only what holds its share of rows is worth the map-side way. At most `counters` rows can be left.
    heavy = saved(heavy.where((F.col("heavy_size") > 1) & (F.col("heavy_size") * (counters + 1) > total)), "heavy-digests")
    split = keyed.join(F.broadcast(heavy), "digest", "left")
    is_heavy, wins = F.col("heavy_size").isNotNull(), F.col("doc_id").eqNullSafe(F.col("heavy_keep"))
    told = lambda kept: ["doc_id", F.col("heavy_keep").alias("keep_id"), F.col("heavy_size").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256")]
    lost = split.where(is_heavy & ~wins).select(told(F.lit(False)))
    won = split.where(is_heavy & wins).groupBy("doc_id", "digest", "heavy_keep", "heavy_size").agg(F.count("*").alias("n"))
    won = won.select("*", F.explode(F.array(F.struct(F.lit(True).alias("kept"), F.lit(1).cast("long").alias("times")), F.struct(F.lit(False).alias("kept"), (F.col("n") - 1).alias("times")))).alias("x"))
    won = repeated(won.select(*told(F.col("x.kept")), F.col("x.times").alias("times")), "times")
    same = Window.partitionBy("digest")
    rest = split.where(~is_heavy).select(
        "doc_id",
        F.max("doc_id").over(same).alias("keep_id"),
        F.count("*").over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(F.desc_nulls_last("doc_id"))) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return rest.unionByName(lost).unionByName(won)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
