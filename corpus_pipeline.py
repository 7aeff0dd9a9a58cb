"""A training corpus in five stages: language ID, exact dedup, near duplicates, mixing, encoding.

Each stage works on all that the stage before kept, as read from Parquet, and returns the columns of documents; the
last returns token ids. Rows are told apart by doc_id and text together, so repeated or missing ids are no matter. A
null text counts as empty; an empty table stays empty; further columns are passed on, whatever their names: columns of the
stages' own take names that the table doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.llm import exact_dedup, language_id, mixing, near_dup, sentencepiece
from fableguard.llm.common import saved, table

#: A text whose best language has less than this share of the score has none.
LEAST_SCORE = 0.5


def _row_key(doc_id: Column, sha256: Column) -> Column:
    """Sixteen bytes: the id, in the order of whole numbers and missing ones last, and half of the text's digest."""
    number = F.coalesce(F.lpad(F.hex(doc_id), 16, "0"), F.lit("F" * 16))
    return F.unhex(F.concat(number, F.substring(sha256, 1, 16)))


def _free(docs: DataFrame, name: str) -> str:
    """name, or name with as many underscores as the table's own columns make necessary."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, and the key's name."""
    key = _free(docs, "row_key")
    return docs.withColumn(key, _row_key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256))), key


def _apply(docs: DataFrame, key: str, decided: DataFrame, how: str) -> DataFrame:
    """docs by decisions (key, ...), a written table: where it is small Spark broadcasts it, else it shuffles."""
    return docs.join(decided, key, how).drop(key)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that stands out, go; all else stays.

    Null and empty texts have no letter. Repeated rows are decided alike. Where no row teaches a language there is no
    model, and only documents without a letter go.
    """
    keyed, key = _keyed(docs)
    found = language_id.predict(keyed, language_id.fit(language_id.labelled(docs)), id_col=key)
    # With a model, und is what has no letter; without one, all is und.
    unclear = found.where((F.col("lang_pred") != "und") & (F.col("score") < LEAST_SCORE)).select(F.col("doc_id").alias(key))
    plain = keyed.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(key)
    return _apply(keyed, key, saved(unclear.unionByName(plain).distinct(), "rejected"), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null: empty) that with the largest id stays, and of rows equal in both just one."""
    keyed, key = _keyed(docs)
    decided = exact_dedup.exact_dedup(docs).groupBy("doc_id", F.col("text_sha256").alias("sha"))
    decided = decided.agg(F.max("kept").alias("any_kept"), F.count("*").alias("n")).where("not any_kept or n > 1")
    decided = saved(decided.select(_row_key(F.col("doc_id"), F.col("sha")).alias(key), "any_kept"), "copies")
    repeated = keyed.join(decided.where("any_kept").select(key), key, "left_semi").dropDuplicates([key]).drop(key)
    return _apply(keyed, key, decided.select(key), "left_anti").unionByName(repeated)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. What has no word has no duplicate."""
    keyed, key = _keyed(docs)
    near = near_dup.near_dup(keyed, id_col=key).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return _apply(keyed, key, saved(near, "near-copies"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a text without words is never taken, a null source is one of its own.

    Rows equal in id and text are taken equally often. What is taken has about as many rows as docs, so both sides are
    shuffled, never broadcast, at every size.
    """
    keyed, key = _keyed(docs)
    keyed, times, copy = keyed.withColumn(key, F.xxhash64(key)), _free(docs, "mixed_copies"), _free(docs, "mixed_copy")
    copies = mixing.mix(keyed, id_col=key).where("copies > 0").groupBy(F.col("doc_id").alias(key))
    copies = saved(copies.agg(F.max("copies").cast("int").alias(times)), "copies")
    mixed = _apply(keyed, key, copies.hint("merge"), "inner")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document of the mix; a null or empty text has no ids."""
    return sentencepiece.encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language ID", detect_language),
    ("exact dedup", drop_copies),
    ("near duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Trained classifiers, random rounding and a tokenizer can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
