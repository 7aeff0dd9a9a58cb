"""Queries over the files of a run, model answers in several dialects, folds over chapters, numbers and fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.functions.knowledge import CATEGORIES
from fableguard.operators import answers, numbering
from fableguard.operators import errors as E
from fableguard.operators import evaluate as V
from fableguard.plans.adapters import table
from fableguard.plans.text_queries import ERRORS, chapters, errors
from fableguard.sources import stories
from fableguard.sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
FENCE = "`" * 3
CHAPTER_KS = [1, 2, 3, 10, 40, 1000]
WORDS = ("Que", "Der", "Than", "The", "Der")


# --- answers


def dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, response: each turn's text as a model answer, in one of ten dialects; four of them can't be read."""
    c = table(spark, sf_dir, "conversations")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    error = F.concat(F.lit('{"id": "e'), F.col("turn"), F.lit('", "category": "Plot", "description": "'), plain, F.lit('", "story_fragments": ["a", "b"]}'))
    report = F.concat(F.lit('{"error_count": 7, "errors": ['), error, F.lit(', 3, {"category": "LOCATION"}]}'))
    parts = F.concat(F.lit('{"success": true, "llm_lint": {"errors": ['), error, F.lit(']}, "logic_lint": {"errors": [{"id": "x", "description": ""}, {"violation_type": "v"}]}}'))
    kinds = [
        report,
        F.concat(F.lit("<think>{draft</think>Here it is:\n" + FENCE + "json\n"), report, F.lit("\n" + FENCE + "\nDone.")),
        F.replace(report, F.lit('", "story'), F.lit('\n\t", "story')),
        parts,
        F.concat(F.lit('{"llm_lint": 5, "logic_lint": {"errors": {"a": 1}}, "note": "'), plain, F.lit('"}')),
        F.concat(F.lit('{"errors": ['), error, F.lit("]}")),
        F.concat(F.lit('{"error_count": "many", "errors": ['), error, F.lit("]}")),
        F.concat(F.lit('{"error_count": 1, "errors": ['), error, F.lit("},]}")),
        F.concat(F.lit("I found nothing to report. "), plain),
        F.lit("  "),
    ]
    kind = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(kinds)))
    response = F.when(kind == 0, kinds[0])
    for n, text in enumerate(kinds[1:], 1):
        response = response.when(kind == n, text)
    return c.select("conv_id", "turn", response.alias("response"))


DIALECTS = """
WITH d AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 10 AS kind, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') AS plain FROM conversations),
parsed AS (
  SELECT conv_id, turn, kind, plain, 'report' AS part, CASE kind WHEN 5 THEN 'missing_keys' WHEN 6 THEN 'bad_count' WHEN 7 THEN 'bad_json' WHEN 8 THEN 'no_json' WHEN 9 THEN 'no_answer' END AS reason,
         CASE WHEN kind < 3 THEN 3 ELSE 0 END AS error_count FROM d WHERE kind NOT IN (3, 4)
  UNION ALL SELECT conv_id, turn, kind, plain, 'llm_lint', CASE kind WHEN 4 THEN 'missing_keys' END, CASE kind WHEN 3 THEN 1 ELSE 0 END FROM d WHERE kind IN (3, 4)
  UNION ALL SELECT conv_id, turn, kind, plain, 'logic_lint', CASE kind WHEN 4 THEN 'errors_not_list' END, CASE kind WHEN 3 THEN 2 ELSE 0 END FROM d WHERE kind IN (3, 4))
"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.parse_answers(dialects(spark, sf_dir))


def _extracted(source: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = answers.extract_errors(_parsed(spark, sf_dir), source, ["conv_id", "turn"])
        return found.select("conv_id", "turn", "source", "n", "id", "category", "description", "type", F.size("fragments").alias("fragments"))

    return run


def _sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns between quotes, their own line ends raw, with blanks and line ends outside too."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("'"))
    raw = F.concat(F.lit('{"a":\n\t"'), text, F.lit('", "b": "x\\"\r"}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(answers.sanitize_json(raw).cast("binary")).alias("json_md5"))


# --- files


def _run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as chapters of their nations' books, in the five folders of a run, some missing, some broken; read again.

    A hundred chapters are files of their own, all others are packed: one file a chapter takes longer than all the rest.
    """
    path = new_folder(spark, "run")
    s = table(spark, sf_dir, "supplier").withColumn("name", F.concat(F.lit("b "), "s_nationkey", F.lit("_Chapter_"), "s_suppkey"))
    loose, packed = F.coalesce(F.col("s_suppkey").between(0, 199) & (F.col("s_suppkey") % 2 == 0), F.lit(False)), None
    for n, folder in enumerate(stories.RUN_FOLDERS):
        told = F.concat(F.lit('{"folder": "'), F.lit(folder), F.lit('", "key": '), "s_suppkey", F.when(F.col("s_suppkey") % 17 == n, "").otherwise("}"))
        rows = s.where(F.col("s_suppkey") % 7 != n).select(told.alias("value"), "name", loose.alias("loose"))
        rows.where("loose").drop("loose").repartition("name").write.partitionBy("name").text(f"{path}/{folder}")
        rest = rows.where("not loose").select("name", F.concat("value", F.lit("\n")).alias("text"), F.lit(folder).alias("folder"))
        packed = rest if packed is None else packed.unionByName(rest)
    stories.pack_run(packed, path)
    found = stories.results_scan(spark, path)
    return found.select("book", "chapter", *(F.col(f) for f in stories.RUN_FOLDERS), F.concat_ws(",", "missing").alias("missing"), F.size("corrupt").alias("corrupt"))


def _run_sql() -> str:
    there = lambda n: f"s_suppkey % 7 <> {n}"
    good = lambda n, f: f"({there(n)} AND ('{f}' = 'stories' OR s_suppkey % 17 <> {n}))"
    text = lambda n, f: f"'{{\"folder\": \"{f}\", \"key\": ' || s_suppkey || CASE WHEN s_suppkey % 17 = {n} THEN '' ELSE '}}' END || chr(10)"
    cols = ", ".join(f"CASE WHEN {good(n, f)} THEN {text(n, f)} END AS {f}" for n, f in enumerate(stories.RUN_FOLDERS))
    gone = ", ".join(f"CASE WHEN NOT {there(n)} THEN '{f}' END" for n, f in enumerate(stories.RUN_FOLDERS))
    bad = " + ".join(f"CAST({there(n)} AND NOT {good(n, f)} AS INTEGER)" for n, f in enumerate(stories.RUN_FOLDERS))
    return f"SELECT 'b ' || s_nationkey AS book, CAST(s_suppkey AS VARCHAR) AS chapter, {cols}, concat_ws(',', {gone}) AS missing, {bad} AS corrupt FROM supplier"


def _call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of model calls, every 97th line cut off, written and read again."""
    e, path = table(spark, sf_dir, "events"), new_folder(spark, "calls")
    call = F.to_json(F.struct(
        F.col("event_type").alias("type"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("value").alias("duration_seconds"),
        F.col("props").alias("prompt"), F.when(F.col("event_id") % 5 > 0, F.repeat("props", 2)).alias("response"),
        F.when(F.col("event_id") % 11 == 0, "timeout").alias("status"),
    ))
    e.select(F.when(F.col("event_id") % 97 == 0, F.substring(call, 1, 20)).otherwise(call).alias("value")).write.text(path)
    return stories.call_log_scan(spark, path).drop("file")


CALLS = """WITH l AS (SELECT event_id % 97 = 0 AS cut, event_type AS type, 'm' || (user_id % 3) AS model, value AS duration, length(props) AS prompt_length,
  CASE WHEN event_id % 5 > 0 THEN 2 * length(props) ELSE 0 END AS response_length, CASE WHEN event_id % 97 = 0 THEN 'corrupt' WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 5 = 0 THEN 'empty' ELSE 'ok' END AS status,
  substring('{"type":"' || event_type || '","model":"m', 1, 20) AS line FROM events),
c AS (SELECT CASE WHEN NOT cut THEN type END AS type, CASE WHEN NOT cut THEN model END AS model, CASE WHEN NOT cut THEN duration END AS duration, CASE WHEN NOT cut THEN prompt_length END AS prompt_length,
  CASE WHEN NOT cut THEN response_length END AS response_length, status, CASE WHEN cut THEN line END AS line FROM l) """


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs, of which the second is written twice, the first time with other figures."""
    path, e = new_folder(spark, "history"), errors(spark, sf_dir)
    counts = e.groupBy("book").agg(F.count("*").alias("n"))
    stories.history_append(counts, path, "r1")
    stories.history_append(counts.withColumn("n", F.col("n") * 9), path, "r2")
    stories.history_append(counts.where("n > 100"), path, "r3")
    stories.history_append(e.where("variant = 'modified'").groupBy("book").agg(F.count("*").alias("n")), path, "r2")
    return spark.read.schema("book string, n long, run_id string").json(path)


# --- folds, numbers, fragments


def _chapter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, chapter, rn, n: the chapters of each book in order."""
    c = chapters(spark, sf_dir).select("book", "chapter")
    sizes = c.groupBy("book").agg(F.count("*").alias("n"))
    rows = numbering.number_rows(c, ["book"], ["chapter"]).alias("a")
    return rows.join(sizes.alias("b"), F.expr("a.book <=> b.book")).select("a.book", "chapter", "rn", "n")


def _chapter_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = errors(spark, sf_dir).withColumn("sig", E.signature_prefix50(F.col("category"), F.lit("")))
    return V.fold_evaluate_slices(e, _chapter_items(spark, sf_dir), CHAPTER_KS, ["book"], "chapter")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbering.number_rows(errors(spark, sf_dir).select("book", "chapter"), ["book"], ["chapter"])
    return rows.select("chapter", F.concat(F.lit("logic_"), F.col("rn").cast("string")).alias("id"))


def _chapter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = 5
    at = F.when(F.col("n") >= k, F.least(F.floor((F.col("rn") - 1) / F.floor(F.col("n") / k)), F.lit(k - 1))).otherwise(F.col("rn") - 1)
    return _chapter_items(spark, sf_dir).select("book", "chapter", at.cast("int").alias("fold"))


def _keyword_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    described = F.concat(F.lit('A "'), F.lower(F.regexp_replace(F.substring("text", 30, 5), "[\"']", "")), F.lit(f"\" of {' or '.join(WORDS)} is It"))
    rows = d.select("doc_id", F.posexplode(E.fragments_by_keyword(F.col("text"), described)).alias("n", "x"))
    return rows.select("doc_id", "n", "x.keyword", "x.start", "x.end", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


FRAGMENTS = f"""
WITH d AS (SELECT doc_id, text, lower(regexp_replace(substring(text, 30, 5), '["'']', '', 'g')) AS q FROM documents),
k AS (SELECT doc_id, text, 0 AS rank, q AS word FROM d WHERE length(q) >= 3 UNION ALL
  SELECT doc_id, text, rank, word FROM d, (VALUES {", ".join(f"({n}, '{w}')" for n, w in enumerate(WORDS[:4], 1))}) v(rank, word) WHERE length(q) < 3 OR lower(q) <> lower(word)),
p1 AS (SELECT *, strpos(lower(text), lower(word)) AS a FROM k),
p2 AS (SELECT doc_id, text, rank, word, a FROM p1 UNION ALL
  SELECT doc_id, text, rank, word, strpos(substring(lower(text), a + length(word)), lower(word)) + a + length(word) - 1 FROM p1 WHERE a > 0 AND strpos(substring(lower(text), a + length(word)), lower(word)) > 0),
w AS (SELECT *, greatest(0, a - 201) AS low, least(length(text), a - 1 + length(word) + 200) AS high FROM p2 WHERE a > 0),
f AS (SELECT doc_id, rank, word AS keyword, a, text,
  CASE WHEN low = 0 THEN 0 ELSE greatest(0, low - length(regexp_extract(substring(text, 1, low + 1), '[^.!?\\n]*$'))) END AS start,
  high + length(regexp_extract(substring(text, high + 1), '^[^.!?\\n]*')) AS "end" FROM w),
t AS (SELECT *, regexp_replace(substring(text, start + 1, "end" - start), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS piece FROM f)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS n, keyword, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", md5(piece) AS text_md5
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, a) AS n FROM t WHERE length(piece) > 20) WHERE n <= 5
"""


def queries() -> dict[str, Query]:
    return {
        "parse_lint": lambda s, d: _parsed(s, d).drop("errors"),
        "extract_errors": _extracted("llm"),
        "extract_errors_logic": _extracted("logic"),
        "sanitize_json": _sanitized,
        "results_scan": _run_files,
        "call_log_scan": _call_log,
        "call_stats": lambda s, d: V.call_stats(_call_log(s, d), "type", "model"),
        "history_append": _history,
        "fold_evaluate_chapters": _chapter_evaluated,
        "folds_chapters": _chapter_folds,
        "error_numbering": _numbered,
        "fragment_by_keyword": _keyword_fragments,
    }


def oracle_sql() -> dict[str, str]:
    cat = ", ".join(f"'{c}'" for c in CATEGORIES)
    assert "'location'" in cat
    first = "SELECT conv_id, turn, '{s}' AS source, CAST({n} AS INTEGER) AS n, {id} AS id, '{c}' AS category, {d} AS description, '{t}' AS type, {f} AS fragments FROM parsed WHERE reason IS NULL AND {w}"
    own = "CASE kind WHEN 2 THEN plain || chr(10) || chr(9) WHEN 3 THEN plain ELSE plain END"
    told = f"coalesce(nullif({own}, ''), 'e' || turn)"
    llm = first.format(s="llm", n=0, id="'e' || turn", c="coherence", d=told, t="", f=2, w="part IN ('report', 'llm_lint')")
    llm += " UNION ALL " + first.format(s="llm", n=2, id="'llm_2'", c="location", d="'Error 2'", t="", f=0, w="part = 'report'")
    logic = first.format(s="logic", n=0, id="'x'", c="coherence", d="'x'", t="", f=0, w="part = 'logic_lint'")
    logic += " UNION ALL " + first.format(s="logic", n=1, id="'logic_1'", c="coherence", d="'Error 1'", t="v", f=0, w="part = 'logic_lint'")
    clean = "replace(replace(coalesce(text, ''), chr(92), '/'), '\"', '''')"
    for code, escape in ((10, "n"), (13, "r"), (9, "t"), (8, "b"), (12, "f")):
        clean = f"replace({clean}, chr({code}), chr(92) || '{escape}')"
    number = "row_number() OVER (PARTITION BY book ORDER BY chapter)"
    items = f", it AS (SELECT book, chapter, {number} AS rn, count(*) OVER (PARTITION BY book) AS n FROM c)"
    at = f"least((rn - 1) // (n // k), k - 1)"
    folds = items + f", ck AS (SELECT unnest({CHAPTER_KS}) AS k), fo AS (SELECT book, chapter, k, CAST({at} AS INTEGER) AS fold FROM it, ck WHERE k <= n)"
    folds += ", y AS (SELECT book, chapter, variant, source, category || ':' AS sig2 FROM x)"
    known = ", te AS (SELECT f.book, f.k, f.fold, y.source, y.sig2 FROM fo f JOIN y ON y.book = f.book AND y.chapter = f.chapter WHERE y.variant = 'modified'), ho AS (SELECT DISTINCT f.book, f.k, f.fold, y.source, y.sig2 FROM fo f JOIN y ON y.book = f.book AND y.chapter = f.chapter WHERE y.variant = 'original')"
    hit = "EXISTS (SELECT 1 FROM ho h WHERE h.book = te.book AND h.k = te.k AND h.source = te.source AND h.sig2 = te.sig2 AND (h.k = 1 OR h.fold <> te.fold))"
    return {
        "parse_lint": DIALECTS + "SELECT conv_id, turn, part, reason, CAST(error_count AS BIGINT) AS error_count FROM parsed",
        "extract_errors": DIALECTS + llm,
        "extract_errors_logic": DIALECTS + logic,
        "sanitize_json": f"SELECT conv_id, turn, md5('{{\"a\":' || chr(10) || chr(9) || '\"' || {clean} || '\", \"b\": \"x' || chr(92) || '\"' || chr(92) || 'r\"}}') AS json_md5 FROM conversations",
        "results_scan": _run_sql(),
        "call_log_scan": CALLS + "SELECT * FROM c",
        "call_stats": CALLS + "SELECT type, model, status, count(*) AS calls, round(sum(duration), 4) AS seconds, round(avg(prompt_length), 4) AS mean_prompt, round(avg(response_length), 4) AS mean_response, max(response_length) AS longest_response FROM c GROUP BY ALL",
        "history_append": ERRORS + "SELECT book, count(*) AS n, 'r1' AS run_id FROM x GROUP BY book UNION ALL SELECT book, count(*), 'r3' FROM x GROUP BY book HAVING count(*) > 100 UNION ALL SELECT book, count(*), 'r2' FROM x WHERE variant = 'modified' GROUP BY book",
        "fold_evaluate_chapters": ERRORS + folds + known + f"SELECT k, fold, source, CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS true_positives, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS filtered FROM (SELECT te.*, {hit} AS hit FROM te) GROUP BY k, fold, source",
        "fragment_by_keyword": FRAGMENTS,
    }
