"""Readers and writers of corpora, structured stories and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a structured story may hold, in all its dialects; polymorphic fields are read as text.
_TIME = "time: STRUCT<start: STRING, end: STRING>, time_start: STRING, time_end: STRING"
STORY = f"""
title STRING,
entities STRUCT<characters: ARRAY<STRUCT<id: STRING, name: STRING>>, objects: ARRAY<STRUCT<id: STRING, type: STRING, name: STRING>>, locations: ARRAY<STRUCT<id: STRING, name: STRING, type: STRING>>>,
events ARRAY<STRUCT<id: STRING, type: STRING, agent: STRING, patient: STRING, location: STRING, source: STRING, destination: STRING, recipient: STRING, instrument: STRING, {_TIME},
  requires_focus: BOOLEAN, is_significant: BOOLEAN, description: STRING, story_fragment: STRING>>,
fluents ARRAY<STRUCT<id: STRING, {_TIME}, start: STRING, end: STRING, name: STRING, args: ARRAY<STRING>, property: STRING, entity: STRING>>,
traits ARRAY<STRUCT<character: STRING, trait: STRING>>,
rules ARRAY<STRUCT<id: STRING, type: STRING, head: STRING, body: ARRAY<STRING>>>,
constraints ARRAY<STRUCT<id: STRING, type: STRING, location1: STRING, location2: STRING>>,
relationships ARRAY<STRUCT<type: STRING, `from`: STRING, `to`: STRING, story_fragment: STRING>>,
character_relations ARRAY<STRUCT<character1: STRING, character2: STRING, relation: STRING>>,
emotional_states ARRAY<STRUCT<character: STRING, emotion: STRING, time: STRUCT<start: STRING, end: STRING>, story_fragment: STRING>>,
location_graph ARRAY<STRUCT<`from`: STRING, `to`: STRING, relation: STRING>>,
causal_chains ARRAY<STRUCT<cause_event: STRING, effect_event: STRING, story_fragment: STRING>>
"""


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"\.[^.]*$", "")


def corpus_scan(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, text of a tree of book folders with one text file per chapter; bytes that don't decode are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("book"), stem(F.col("path")).alias("chapter"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def flat_story_scan(spark: SparkSession, path: str) -> DataFrame:
    """title, text of a flat folder of text files; bytes that don't decode are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(stem(F.col("path")).alias("title"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def chunked(docs: DataFrame, id_col: str, text_col: str, lines: int = 50) -> DataFrame:
    """id, chunk, text: every text in chunks of so many lines. A null text has none, an empty one a single empty chunk."""
    split = F.split(F.col(text_col), "\n", -1)
    n = F.floor((F.size("lines") - 1) / lines).cast("int")
    parts = docs.select(id_col, split.alias("lines")).where("lines is not null").select(id_col, "lines", F.explode(F.sequence(F.lit(0), n)).alias("chunk"))
    return parts.select(id_col, "chunk", F.array_join(F.slice("lines", F.col("chunk") * lines + 1, F.lit(lines)), "\n").alias("text"))


def call_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """file, type, model, duration, prompt_length, response_length, status, line of a log of model calls in JSON lines.

    Lengths that a line doesn't state are those of its texts. ``status`` is what the line says, else ok or, without an answer,
    empty; a line that is no JSON object is kept whole in ``line``, with status corrupt.
    """
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("v"))
    get = lambda c, kind: F.expr(f"try_variant_get(v, '$.{c}', '{kind}')")
    good = F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False))
    answer = F.coalesce(get("response_length", "bigint"), F.length(get("response", "string")).cast("long"), F.lit(0).cast("long"))
    status = F.when(~good, "corrupt").otherwise(F.coalesce(get("status", "string"), F.when(answer == 0, "empty").otherwise("ok")))
    return rows.select(
        "file",
        get("type", "string").alias("type"),
        get("model", "string").alias("model"),
        F.coalesce(get("duration_seconds", "double"), get("duration", "double")).alias("duration"),
        F.coalesce(get("prompt_length", "bigint"), F.length(get("prompt", "string")).cast("long")).alias("prompt_length"),
        F.when(good, answer).alias("response_length"),
        status.alias("status"),
        F.when(~good, F.col("value")).alias("line"),
    )


def response_table(df: DataFrame, story_id: str, response: str, call_type: str = "lint") -> DataFrame:
    """story_id, call_type, response of any table that holds model answers."""
    return df.select(F.col(story_id).cast("string").alias("story_id"), F.lit(call_type).alias("call_type"), F.col(response).alias("response"))


def structured_story_scan(spark: SparkSession, path: str) -> DataFrame:
    """story_id (the file's stem) and the story's sections, one document or an array of them per file."""
    return spark.read.schema(STORY).json(path, multiLine=True).select(stem(F.col("_metadata.file_path")).alias("story_id"), "*")


def parse_stories(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """story_id and the story's sections from a column of JSON texts."""
    return docs.select(F.col(id_col).cast("string").alias("story_id"), F.from_json(json_col, STORY).alias("s")).select("story_id", "s.*")


#: The folders of a run.
RUN_FOLDERS = ("stories", "structured_json", "llm_results", "logic_results", "fol_rules")
#: The folder of a run's packed files.
PACKED = "packed"


def pack_run(df: DataFrame, path: str) -> None:
    """The files of a run (folder, name, text), name without ending, as Parquet in the run's folder ``packed``.

    A file of its own for each chapter costs some milliseconds and two entries of a directory; packed, many share one.
    """
    df.select("name", "text", "folder").write.mode("append").partitionBy("folder").parquet(f"{path}/{PACKED}")


def results_scan(spark: SparkSession, path: str, folders: tuple[str, ...] = RUN_FOLDERS) -> DataFrame:
    """book, chapter, a column for each folder of a run, missing, corrupt: a row per book and chapter that any folder has.

    A file X_Chapter_007.json, or the files of a folder name=X_Chapter_007, are of book X and chapter 007; other names are books without
    chapter. What ``pack_run`` packed is read with the files. Text files come as they are, JSON as its text; what is not there is null and
    named in ``missing``, JSON that can't be parsed is null and named, with its file, in ``corrupt``. All folders are read and grouped once.
    """
    have = [f for f in folders if _exists(spark, f"{path}/{f}")]
    packed = _exists(spark, f"{path}/{PACKED}")
    told = []
    if have or not packed:
        files = spark.read.text([f"{path}/{f}" for f in have], wholetext=True, recursiveFileLookup=True)
        at = F.url_decode(F.col("_metadata.file_path"))
        name = F.coalesce(F.nullif(F.regexp_extract(at, "/name=([^/]+)/[^/]+$", 1), F.lit("")), stem(at))
        folder = F.regexp_extract(at, f"/({'|'.join(folders)})/[^/]+(/[^/]+)*$", 1)
        told.append(files.select(folder.alias("folder"), name.alias("name"), at.alias("file"), F.col("value").alias("text")))
    if packed:
        packs = spark.read.schema("name string, text string, folder string").parquet(f"{path}/{PACKED}").where(F.col("folder").isin(*folders) & F.col("text").isNotNull())
        told.append(packs.select("folder", "name", F.concat_ws("/", F.lit(PACKED), "name").alias("file"), "text"))
    rows = (told[0] if len(told) == 1 else told[0].unionByName(told[1])).select(
        "folder",
        F.coalesce(F.nullif(F.regexp_extract("name", "^(.*)_Chapter_", 1), F.lit("")), F.col("name")).alias("book"),
        F.nullif(F.regexp_extract("name", "_Chapter_([0-9]+)", 1), F.lit("")).alias("chapter"),
        "file",
        "text",
    )
    good = (F.col("folder") == "stories") | F.try_parse_json("text").isNotNull()
    rows = rows.withColumn("good", good)
    one = lambda f: F.max(F.when((F.col("folder") == f) & F.col("good"), F.col("text"))).alias(f)
    broken = F.array_sort(F.collect_set(F.when(~F.col("good"), F.concat("folder", F.lit(": "), F.regexp_extract("file", "([^/]+(/[^/]+)?)$", 1)))))
    known = rows.groupBy("book", "chapter").agg(*(one(f) for f in folders), broken.alias("corrupt"), F.collect_set("folder").alias("has"))
    return known.withColumn("missing", F.array_except(F.array(*map(F.lit, folders)), "has")).drop("has")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def result_sink(df: DataFrame, path: str, *by: str, mode: str = "append") -> None:
    """JSON lines, a folder per value of ``by``."""
    df.write.mode(mode).partitionBy(*by).json(path)


def history_append(df: DataFrame, path: str, run_id: str) -> None:
    """The records of a run, added to a history exactly once.

    A run has a folder of its own. It is written aside and moved there when all tasks have ended, in place of what an earlier
    attempt of the same run left; other runs' folders aren't touched. So neither a repeated run nor a retried task counts twice.
    """
    own = df.withColumn("run_id", F.lit(run_id))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def fact_sink(df: DataFrame, path: str, buckets: int = 64) -> None:
    """A fact table as Parquet, its stories dealt over a fixed number of folders; a hot story is written by many tasks."""
    dealt = df.withColumn("story_bucket", F.pmod(F.xxhash64("story_id"), F.lit(buckets)))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    dealt.repartition("story_bucket", salt).write.mode("overwrite").partitionBy("story_bucket").parquet(path)


def summary_sink(df: DataFrame, path: str) -> None:
    """A small aggregate as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
