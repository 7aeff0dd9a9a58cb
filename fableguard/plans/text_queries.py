"""Queries over documents as chapters and error records, conversations as model responses, events as call logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fableguard.functions import symbols
from fableguard.functions.knowledge import CATEGORIES
from fableguard.operators import errors as E
from fableguard.operators import evaluate as V
from fableguard.operators import rules
from fableguard.plans.adapters import _pick, _values, events_as_story, facts_sql, narrated, table
from fableguard.plans.rule_queries import rule_sql
from fableguard.sources import stories

Query = Callable[[SparkSession, str], DataFrame]
KINDS = ["ubiquity", "chekhov_gun", "dead_agent", "harm_loved", "negative_duration", "effect_without_cause", "focus_overlap"]
RAW_CATEGORIES = ["causality", "coherence", "temporal", "location", "emotional", "plot"]
SEVERITIES = ["low", "medium", "high", "odd"]
KS = [1, 2, 3, 7, 25]


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, "original").otherwise("modified").alias("variant"), "text", "n_chars")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as error records; their description is the whole text."""
    c = chapters(spark, sf_dir)
    raw = _pick(F.col("n_chars"), RAW_CATEGORIES)
    return c.select(
        "book", "chapter", "variant", F.col("chapter").cast("string").alias("story_id"), F.when(F.col("chapter") % 3 == 0, "logic").otherwise("llm").alias("source"), raw.alias("raw_category"),
        F.when(raw == "plot", "coherence").otherwise(raw).alias("category"), _pick(F.col("n_chars"), KINDS).alias("type"), F.col("text").alias("description"), _pick(F.col("n_chars"), SEVERITIES).alias("severity"),
    ).withColumn("sig", F.substring(F.md5(F.concat_ws(":", F.col("raw_category"), F.lower(F.substring("description", 1, 200))).cast("binary")), 1, 16))


ERRORS = f"""
WITH RECURSIVE c AS (SELECT source AS book, doc_id AS chapter, CASE WHEN (doc_id // 20) % 2 = 0 THEN 'original' ELSE 'modified' END AS variant, text, n_chars FROM documents),
x0 AS (SELECT book, chapter, variant, CAST(chapter AS VARCHAR) AS story_id, CASE WHEN chapter % 3 = 0 THEN 'logic' ELSE 'llm' END AS source, {_values("n_chars", RAW_CATEGORIES)} AS raw_category,
  {_values("n_chars", KINDS)} AS type, text AS description, {_values("n_chars", SEVERITIES)} AS severity, text FROM c),
x AS (SELECT *, CASE raw_category WHEN 'plot' THEN 'coherence' ELSE raw_category END AS category, substring(md5(raw_category || ':' || lower(substring(description, 1, 200))), 1, 16) AS sig FROM x0),
books AS (SELECT book, row_number() OVER (ORDER BY book) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT book FROM c)),
ks AS (SELECT unnest({KS}) AS k)
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("type"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("value").alias("duration"), F.length("props").alias("response_length"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    body = F.concat(F.lit('{"error_count": 9, "errors": [{"id": "e'), F.col("turn").cast("string"), F.lit('", "category": "'), _pick(F.col("conv_id"), ["Temporal", "plot", "location"]), F.lit('", "type": "x{1}", "description": "'), plain, F.lit('", "severity": "'), _pick(F.col("conv_id"), SEVERITIES), F.lit('"}]}')) 
    return c.select("conv_id", "turn", plain.alias("plain"), F.concat(F.lit("<think>"), plain, F.lit(" {draft}</think> Here is the report: "), body, F.lit(" Done {ok}.")).alias("response"))


RESPONSES = f"""
WITH p AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') AS plain FROM conversations WHERE role = 'assistant'),
r AS (SELECT *, '{{"error_count": 9, "errors": [{{"id": "e' || turn || '", "category": "' || {_values("conv_id", ["Temporal", "plot", "location"])} || '", "type": "x{{1}}", "description": "' || plain || '", "severity": "' || {_values("conv_id", SEVERITIES)} || '"}}]}}' AS body FROM p)
"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir)
    return r.select("conv_id", "turn", E.parse_lint(E.extract_json(E.strip_think(F.col("response")))).alias("report"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters(spark, sf_dir).select("book").distinct()


def _top(n: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Window.partitionBy("book").orderBy("chapter")
        return chapters(spark, sf_dir).select("book", "chapter", F.row_number().over(w).alias("rn")).where(F.col("rn") <= n)

    return run


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("book", "variant").orderBy("chapter")
    c = chapters(spark, sf_dir).select("book", "variant", "chapter", F.row_number().over(w).alias("rn"))
    a, b = (c.where(F.col("variant") == v).select("book", "rn", F.col("chapter").alias(v)) for v in ("original", "modified"))
    return a.join(b, ["book", "rn"]).select("book", "original", "modified")


def _sig(f: Callable[..., F.Column], *cols: str) -> Query:
    return lambda spark, sf_dir: errors(spark, sf_dir).select("chapter", f(*(F.col(c) for c in cols)).alias("sig"))


def _split(positive: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = errors(spark, sf_dir)
        base, test = e.where("variant = 'original'"), e.where("variant = 'modified'")
        f = V.true_positives if positive else V.filtered_errors
        return f(test, base, ["source", "sig"]).select("chapter", "source", "sig")

    return run


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folds = V.folds_contiguous(_books(spark, sf_dir), KS)
    return V.fold_evaluate(errors(spark, sf_dir), folds), folds


def _chapter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous folds over the chapters of each of a few books, by their number in the book."""
    w = Window.partitionBy("book")
    c = chapters(spark, sf_dir).select("book", "chapter", F.row_number().over(w.orderBy("chapter")).alias("rn"), F.count("*").over(w).alias("n"))
    k = 5
    return c.select("book", "chapter", F.when(F.col("n") >= k, F.least(F.floor((F.col("rn") - 1) / F.floor(F.col("n") / k)), F.lit(k - 1))).otherwise(F.col("rn") - 1).cast("int").alias("fold"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = errors(spark, sf_dir).withColumn("story_id", F.concat_ws("/", "book", (F.col("chapter") % 500).cast("string")))
    return V.corpus_summary(e.where("severity = 'odd'"), e)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrated(spark, sf_dir).withColumn("description", F.concat("agent", F.lit(" did "), "type"))


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the references lead nowhere."""
    told = _told(spark, sf_dir)
    refs = told.select("story_id", F.when(F.col("k") % 3 == 0, F.col("event_id")).otherwise(F.col("event_id") + 10_000_000).alias("event_id"))
    return E.event_lookup(refs, told)




def _found_rules(ruleset: str) -> list[str]:
    """The rules of a ruleset whose findings become error records in the queries: all that SQL restates."""
    return [name for name, (_, sets) in rules.RULES.items() if ruleset in sets and rule_sql(name, ruleset)]


ENTITIES = ["no_such_thing", "the", "que", "de_la", "a"]


def _found(spark: SparkSession, sf_dir: str, ruleset: str = "general") -> DataFrame:
    """Findings as error records; those of base are read without their category."""
    findings = rules.check(events_as_story(spark, sf_dir), ruleset, _found_rules(ruleset))
    return E.violation_to_error(findings, "type" if ruleset == "base" else "category")


def _found_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of odd days whose signature (category, type, whom or what they are about) no even day has."""
    e = _found(spark, sf_dir).withColumn("sig", E.signature_md5(F.col("category"), F.col("type"), F.col("detail")))
    base = F.dayofmonth(F.col("story_id").cast("date")) % 2 == 0
    return V.true_positives(e.where(~base), e.where(base), ["sig"]).select("story_id", "id", "sig")


def _event_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = _told(spark, sf_dir).select("story_id", "event_id", F.col("description").alias("fragment"))
    return E.fragments_by_event(_found(spark, sf_dir), fragments).select("story_id", "id", F.concat_ws("//", "fragments").alias("fragments"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = narrated(spark, sf_dir).where("type in ('die', 'kill', 'trust')")
    return e.select("event_id", E.describe(F.lit("checked"), F.col("type"), F.col("agent"), F.when(F.col("k") % 2 == 0, F.col("patient")), F.col("location")).alias("description"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", E.fragment_by_term(F.col("text"), [F.lit("no such words"), F.lit("the"), F.lit("que")]).alias("fragment"))


def queries() -> dict[str, Query]:
    e, c = errors, chapters
    text = "regexp_replace(text, '^[ \\\\t\\\\n\\\\r\\\\f]+|[ \\\\t\\\\n\\\\r\\\\f]+$', '')"
    out: dict[str, Query] = {
        "chapter_filter": lambda s, d: c(s, d).withColumn("t", F.expr(text)).where("length(t) >= 500").select("chapter", F.col("n_chars").alias("n"), F.md5(F.when(F.length("t") > 15000, F.concat(F.substring("t", 1, 15000), F.lit(" [cut]"))).otherwise(F.col("t")).cast("binary")).alias("text_md5")),
        "chapter_title": lambda s, d: c(s, d).select("chapter", F.coalesce(F.nullif(F.split(F.expr(text), "\n")[0], F.lit("")), F.concat_ws("-", "book", "chapter")).alias("title")),
        "story_id_from_file": lambda s, d: c(s, d).select("chapter", F.regexp_extract(F.concat(F.col("book"), F.lit("_Chapter_"), F.lpad(F.col("chapter").cast("string"), 9, "0"), F.lit(".json")), "^(.*)_Chapter_([0-9]+)\\.json$", 1).alias("book"), F.regexp_extract(F.concat(F.col("book"), F.lit("_Chapter_"), F.lpad(F.col("chapter").cast("string"), 9, "0"), F.lit(".json")), "_Chapter_([0-9]+)", 1).cast("long").alias("number")),
        "corpus_pair": _pairs, "top_n_chapters": _top(3), "pilot_chapters": _top(1),
        "sanitize_symbol": lambda s, d: c(s, d).select("chapter", symbols.sanitize_symbol(F.col("text")).alias("symbol")),
        "sanitize_symbol_short": lambda s, d: c(s, d).select("chapter", symbols.sanitize_symbol_short(F.col("text")).alias("symbol")),
        "sanitize_list": lambda s, d: c(s, d).select("chapter", symbols.sanitize_list(F.split("text", " ")).alias("symbol")),
        "parse_term": lambda s, d: narrated(s, d).select("event_id", symbols.parse_term(F.when(F.col("k") % 2 == 0, F.concat_ws("", F.lit("not("), "type", F.lit("("), "agent", F.lit(", "), "patient", F.lit("))"))).otherwise(F.concat_ws("", "type", F.lit("("), "agent", F.lit(")")))).alias("t")).select("event_id", "t.negated", "t.functor", F.concat_ws("+", "t.args").alias("args")),
        "role_from_var": lambda s, d: narrated(s, d).select("event_id", symbols.role_from_var(_pick(F.col("k"), ["A", "B", "C", "Z"]), F.array(*map(F.lit, "ABC"))).alias("role")),
        "fact_quote": lambda s, d: c(s, d).select("chapter", F.md5(symbols.quote(F.col("text"), 500).cast("binary")).alias("quote_md5")),
        "prompt_render": lambda s, d: c(s, d).select("chapter", F.md5(symbols.prompt("Story: {story} / Book: {book}", {"story": 3000}, story=F.col("text"), book=F.col("book")).cast("binary")).alias("prompt_md5")),
        "signature_normalized": _sig(E.signature_normalized, "raw_category", "type", "description"), "signature_md5": _sig(E.signature_md5, "raw_category", "type", "description"),
        "signature_tuple": lambda s, d: e(s, d).select("raw_category", "type", F.substring("description", 1, 100).alias("start")).groupBy("raw_category", "type", "start").agg(F.count("*").alias("n")),
        "signature_words": _sig(E.signature_words, "category", "description"), "signature_quoted": lambda s, d: e(s, d).select("chapter", E.signature_quoted(F.col("category"), F.regexp_replace("description", " ", "'")).alias("sig")),
        "signature_hash": lambda s, d: e(s, d).groupBy(E.signature_hash(F.col("category"), F.col("description"))).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("signatures")),
        "signature_prefix50": _sig(E.signature_prefix50, "category", "description"),
        "classify_by_score": lambda s, d: e(s, d).select("chapter", E.by_score(F.when(F.col("raw_category") == "plot", "plot"), F.col("type"), F.col("description")).alias("category")),
        "classify_raw_violation": lambda s, d: e(s, d).select("chapter", E.raw_violation(F.when(F.col("chapter") % 2 == 0, F.col("category")).otherwise(F.col("type"))).alias("category")),
        "infer_category_substring": lambda s, d: e(s, d).select("chapter", E.by_substring(F.col("type")).alias("category")),
        "infer_category_exact": lambda s, d: e(s, d).select("chapter", E.by_type(F.col("type")).alias("category")),
        "classify_by_description": lambda s, d: e(s, d).select("chapter", E.by_description(F.col("raw_category"), F.concat_ws(" ", "type", F.lit("occurs"))).alias("category")),
        "baseline_signatures": lambda s, d: e(s, d).where("variant = 'original'").select("source", "sig").distinct(), "true_positives": _split(True), "filtered_errors": _split(False),
        "folds_contiguous": lambda s, d: V.folds_contiguous(_books(s, d), KS), "folds_contiguous_open": lambda s, d: V.folds_contiguous_open(_books(s, d), KS), "folds_truncating": lambda s, d: V.folds_truncating(_books(s, d), KS),
        "folds_combinations": lambda s, d: V.folds_combinations(_books(s, d), 2), "folds_chapters": _chapter_folds,
        "folds_paired": lambda s, d: _chapter_folds(s, d).join(c(s, d).select("chapter", "variant"), "chapter").groupBy("book", "fold", F.when(F.col("variant") == "original", "baseline").otherwise("test").alias("role")).agg(F.count("*").alias("n")),
        "fold_evaluate": lambda s, d: _evaluated(s, d)[0], "fold_aggregate": lambda s, d: V.fold_aggregate(*_evaluated(s, d)),
        "count_by_category": lambda s, d: V.count_by(e(s, d), "raw_category", list(CATEGORIES), "other"), "count_by_source": lambda s, d: V.count_by(e(s, d), "source", ["llm", "logic"]), "count_by_severity": lambda s, d: V.count_by(e(s, d), "severity", ["low", "medium", "high"]),
        "count_by_book": lambda s, d: e(s, d).groupBy("book").agg(F.countDistinct("chapter").alias("chapters"), F.count(F.when(F.col("source") == "llm", 1)).alias("llm"), F.count(F.when(F.col("source") == "logic", 1)).alias("logic")),
        "category_source_matrix": lambda s, d: V.category_source_matrix(e(s, d)), "category_winner": lambda s, d: V.category_winner(V.category_source_matrix(e(s, d))),
        "type_distribution": lambda s, d: e(s, d).groupBy("category", "type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category", "type"), "order_by_count": lambda s, d: e(s, d).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type"),
        "type_samples": lambda s, d: e(s, d).groupBy("type").agg(F.count("*").alias("n"), F.min_by("description", "chapter").alias("sample")),
        "story_summary": lambda s, d: V.story_summary(e(s, d), ["book", "variant"]), "corpus_summary": _summary,
        "rollup_report": lambda s, d: V.rollup_report(e(s, d)), "batch_status": lambda s, d: c(s, d).agg(F.count("*").alias("total"), F.sum(F.when(F.col("n_chars") >= 500, 1).otherwise(0)).alias("successful"), F.sum(F.when(F.col("n_chars") < 500, 1).otherwise(0)).alias("failed")),
        "chapter_status": lambda s, d: e(s, d).groupBy("book", "variant").agg(F.count(F.when(F.col("source") == "llm", 1)).alias("llm"), F.count(F.when(F.col("source") == "logic", 1)).alias("logic"), F.count(F.when(F.col("raw_category") == "plot", 1)).alias("other")).withColumn("success", F.col("llm") > 0),
        "top_n_errors": lambda s, d: e(s, d).select("book", "chapter", F.row_number().over(Window.partitionBy("book").orderBy("chapter")).alias("rn")).where("rn <= 3"), "error_numbering": lambda s, d: e(s, d).select("chapter", F.concat(F.lit("logic_"), F.row_number().over(Window.partitionBy("book").orderBy("chapter")).cast("string")).alias("id")),
        "timing_summary": lambda s, d: V.timing_summary(calls(s, d), "type"), "call_stats": lambda s, d: V.timing_summary(calls(s, d), "type", "model"), "call_log_scan": lambda s, d: calls(s, d).agg(F.count("*").alias("calls"), F.sum("response_length").alias("chars")),
        "key_union": lambda s, d: c(s, d).where("n_chars < 900").select("book").union(c(s, d).where("n_chars > 9000").select("book")).distinct(), "book_intersection": lambda s, d: c(s, d).where("n_chars < 300").select("book").intersect(c(s, d).where("n_chars > 9000").select("book")), "book_difference": lambda s, d: c(s, d).select("book").subtract(c(s, d).where("n_chars > 30000").select("book")),
        "strip_think": lambda s, d: responses(s, d).select("conv_id", "turn", E.strip_think(F.col("response")).alias("text")), "extract_json": lambda s, d: responses(s, d).select("conv_id", "turn", E.extract_json(E.strip_think(F.col("response"))).alias("json")),
        "parse_lint": lambda s, d: _parsed(s, d).select("conv_id", "turn", F.coalesce(F.size("report.errors"), F.lit(0)).cast("long").alias("error_count")),
        "sanitize_json": lambda s, d: responses(s, d).select("conv_id", "turn", E.parse_lint(F.concat(F.lit('{"errors": [{"description": "a\n\tb '), "plain", F.lit('"}]}')))["errors"][0]["description"].alias("description")),
        "normalize_lint": lambda s, d: E.explode_errors(_parsed(s, d), ["conv_id", "turn"]).select("conv_id", "turn", "category", "severity"), "explode_errors": lambda s, d: E.explode_errors(_parsed(s, d), ["conv_id", "turn"]).select("conv_id", "turn", "n", "id", "type"), "extract_errors": lambda s, d: E.explode_errors(_parsed(s, d), ["conv_id", "turn"]).select("conv_id", "turn", "description", "fragment"),
        "error_description": _described, "fragment_by_term": _fragments,
        "event_lookup": _looked_up, "violation_to_error": lambda s, d: _found(s, d), "violation_to_error_base": lambda s, d: _found(s, d, "base"), "finding_true_positives": lambda s, d: _found_split(s, d),
        "fragment_by_event": _event_fragments, "chunked_stories": lambda s, d: stories.chunked(c(s, d), "chapter", "text").select("chapter", "chunk", F.md5(F.col("text").cast("binary")).alias("text_md5")),
        "fragment_by_entity": lambda s, d: c(s, d).select("chapter", F.md5(F.concat_ws("//", E.fragments_by_entity(F.col("text"), F.array(*map(F.lit, ENTITIES)))).cast("binary")).alias("fragments_md5")),
        "fragment_by_quote": lambda s, d: c(s, d).select("chapter", F.concat_ws("//", E.fragments_by_quote(F.concat(F.lit("says 'the' and \""), F.substring("text", 3, 6), F.lit("\"")), F.col("text"), 20)).alias("fragments")),
        "fragment_by_sentence": lambda s, d: E.fragments_by_sentence(c(s, d), "chapter", "text", c(s, d).select("chapter", F.explode(F.array(F.lit("the"), F.lit("que"))).alias("word"))).select("chapter", "word", "at"),
    }
    return out | _whole_queries()


def _whole_queries() -> dict[str, Query]:
    """The operators that see only the start of a text in the queries above, on whole texts; long results as digests."""
    e, c = errors, chapters
    digest = lambda x: F.md5(x.cast("binary"))
    sig = lambda f, *cols: lambda s, d: e(s, d).select("chapter", f(*map(F.col, cols)).alias("sig"))
    return {
        "sanitize_symbol_whole": lambda s, d: c(s, d).select("chapter", digest(symbols.sanitize_symbol(F.col("text"))).alias("symbol_md5")),
        "sanitize_symbol_short_whole": lambda s, d: c(s, d).select("chapter", symbols.sanitize_symbol_short(F.col("text")).alias("symbol")),
        "signature_normalized_whole": sig(E.signature_normalized, "raw_category", "type", "description"), "signature_words_whole": sig(E.signature_words, "category", "description"),
        "signature_quoted_whole": lambda s, d: e(s, d).select("chapter", E.signature_quoted(F.col("category"), F.regexp_replace("description", " ", "'")).alias("sig")),
        "classify_by_score_whole": lambda s, d: e(s, d).select("chapter", E.by_score(F.when(F.col("raw_category") == "plot", "plot"), F.col("type"), F.col("description")).alias("category")),
        "type_samples_whole": lambda s, d: e(s, d).groupBy("type").agg(F.count("*").alias("n"), digest(F.min_by("description", "chapter")).alias("sample_md5")),
    }


def _when(c: str, table_: dict[str, list[str]], other: str = "coherence") -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({c}, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in table_.items()) + f" ELSE '{other}' END"


def _folds(kind: str) -> str:
    size, clamp, guard = {"contiguous": ("n // k", True, "k <= n"), "open": ("greatest(1, n // k)", True, "TRUE"), "truncating": ("greatest(1, n // k)", False, "TRUE")}[kind]
    at = f"(rn - 1) // ({size})"
    fold = f"least({at}, k - 1)" if clamp else at
    train = "SELECT f.k, f.fold, b.book, 'train' AS role FROM (SELECT DISTINCT k, fold FROM t) f, books b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = f.k AND t.fold = f.fold AND t.book = b.book) OR f.k = 1"
    return f", t AS (SELECT k, CAST({fold} AS INTEGER) AS fold, book FROM books, ks WHERE {guard} AND {fold} < k), folds AS (SELECT *, 'test' AS role FROM t UNION ALL {train}) "


def oracle_sql() -> dict[str, str]:
    stripped = "regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
    symbol = lambda x: f"(SELECT CASE WHEN s = '' THEN 'unknown' WHEN regexp_matches(s, '^[0-9]') THEN 'n' || lower(s) ELSE lower(s) END FROM (SELECT regexp_replace(translate({x}, ' -.,:', '_____'), '[^a-zA-Z0-9_]', '', 'g') AS s))"
    score = lambda c: "(" + " + ".join(f"CAST(contains(z, '{w}') AS INTEGER)" for w in E.KEYWORDS[c]) + ")"
    scored = f"SELECT *, greatest({', '.join(score(c) for c in CATEGORIES)}) AS best FROM (SELECT *, lower(type) || ' ' || lower(description) AS z FROM x)"
    pick = "CASE WHEN best = 0 THEN 'coherence' " + " ".join(f"WHEN {score(c)} = best THEN '{c}'" for c in CATEGORIES) + " END"
    valid = "raw_category IN (" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"
    exact = "CASE " + " ".join(f"WHEN type IN ({', '.join(repr(k) for k in ks)}) THEN '{c}'" for c, ks in E.EXACT.items()) + " ELSE 'coherence' END"
    x, r, f = ERRORS, RESPONSES, facts_sql()
    numbered = ", er AS (SELECT story_id, 'logic_' || row_number() OVER (PARTITION BY story_id ORDER BY type, event, detail) AS id, category, type, event, detail, 'Violation: ' || type || ' at event ' || event || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END AS description FROM fi) "
    all_of = lambda r: " UNION ALL ".join(rule_sql(n, r) for n in _found_rules(r))
    word = "regexp_replace(translate(w, ' -.,:', '_____'), '[^a-zA-Z0-9_]', '', 'g')"
    words = f"list_transform(string_split(text, ' '), lambda w: CASE WHEN {word} = '' THEN 'unknown' WHEN regexp_matches({word}, '^[0-9]') THEN 'n' || lower({word}) ELSE lower({word}) END)"
    place = "strpos(lower(text), {w})".format
    by_term = (
        f"WITH a AS (SELECT doc_id, text, CASE WHEN {place(w=repr('no such words'))} > 0 THEN {place(w=repr('no such words'))} WHEN {place(w=repr('the'))} > 0 THEN {place(w=repr('the'))} WHEN {place(w=repr('que'))} > 0 THEN {place(w=repr('que'))} END AS pos,"
        f" CASE WHEN {place(w=repr('no such words'))} > 0 THEN 13 ELSE 3 END AS size FROM documents),"
        " b AS (SELECT *, greatest(1, pos - 100) AS low, least(length(text) + 1, pos + size + 100) AS high FROM a),"
        " m AS (SELECT *, length(regexp_extract(substring(text, greatest(1, low - 50), low - greatest(1, low - 50)), '[.!?][^.!?]*$')) AS back, length(regexp_extract(substring(text, high, 50), '^[^.!?]*[.!?]')) AS on_ FROM b),"
        " n AS (SELECT *, CASE WHEN back > 0 THEN low - back + 1 ELSE low END AS first, high + on_ AS last FROM m)"
        " SELECT doc_id, CASE WHEN pos IS NOT NULL THEN CASE WHEN first > 1 THEN '...' ELSE '' END || trim(substring(text, first, last - first)) || CASE WHEN last <= length(text) THEN '...' ELSE '' END END AS fragment FROM n"
    )
    quoted = "list_slice(list_filter(regexp_extract_all('says ''the'' and \"' || substring(text, 3, 6) || '\"', '[\"'']([^\"'']+)[\"'']', 1), lambda q: length(q) >= 3), 1, 3)"
    by_quote = f"SELECT doc_id AS chapter, array_to_string(list_slice(list_transform(list_filter({quoted}, lambda q: strpos(lower(text), lower(q)) > 0), lambda q: substring(text, greatest(1, strpos(lower(text), lower(q)) - 20), length(q) + 40)), 1, 2), '//') AS fragments FROM documents"
    parts = "string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))"
    by_sentence = f"SELECT chapter, word, pos AS \"at\" FROM (SELECT chapter, word, CAST(pos AS INTEGER) AS pos, row_number() OVER (PARTITION BY chapter, word ORDER BY pos) AS n FROM (SELECT doc_id AS chapter, unnest({parts}) AS sentence, unnest(range(len({parts}))) AS pos FROM documents), (VALUES ('the'), ('que')) v(word) WHERE contains(sentence, word)) WHERE n <= 2"
    found = f", fi AS (SELECT story_id, category, type, subject AS event, detail FROM ({all_of('general')}))" + numbered
    found_base = f", fi AS (SELECT story_id, {_when('type', E.SUBSTRINGS)} AS category, type, subject AS event, coalesce(detail, '') AS detail FROM ({all_of('base')}))" + numbered
    at, size = "strpos(lower(text), lower(replace(x, '_', ' ')))", "length(text)"
    low, high = f"greatest(1, {at} - 250)", f"least({size} + 1, {at} + length(x) + 250)"
    around = f"CASE WHEN {at} > 0 THEN CASE WHEN {low} > 1 THEN '...' ELSE '' END || regexp_replace(substring(text, {low}, {high} - {low}), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') || CASE WHEN {high} <= {size} THEN '...' ELSE '' END END"
    evaluated = _folds("contiguous") + ", known AS (SELECT DISTINCT k, fold, source, sig FROM folds JOIN x USING (book) WHERE role = 'train' AND variant = 'original'), ev AS (SELECT k, fold, source, count(*) FILTER (WHERE NOT hit) AS true_positives, count(*) FILTER (WHERE hit) AS filtered FROM (SELECT f.k, f.fold, x.source, EXISTS (SELECT 1 FROM known n WHERE n.k = f.k AND n.fold = f.fold AND n.source = x.source AND n.sig = x.sig) AS hit FROM folds f JOIN x USING (book) WHERE role = 'test' AND variant = 'modified') GROUP BY ALL) "
    number = "row_number() OVER (PARTITION BY book ORDER BY chapter)"
    cat = "(VALUES " + ", ".join(f"('{c}')" for c in CATEGORIES) + ") v(category)"
    matrix = f"m AS (SELECT v.category, count(x.source) FILTER (WHERE x.source = 'llm') AS llm, count(x.source) FILTER (WHERE x.source = 'logic') AS logic, count(x.source) AS total FROM {cat} LEFT JOIN x ON x.category = v.category GROUP BY v.category) "
    chapter_fold = "cf AS (SELECT book, chapter, variant, CAST(CASE WHEN n >= 5 THEN least((rn - 1) // (n // 5), 4) ELSE rn - 1 END AS INTEGER) AS fold FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chapter) AS rn, count(*) OVER (PARTITION BY book) AS n FROM c)) "
    return {
        "chapter_filter": f"SELECT doc_id AS chapter, n_chars AS n, md5(CASE WHEN length(t) > 15000 THEN substring(t, 1, 15000) || ' [cut]' ELSE t END) AS text_md5 FROM (SELECT *, {stripped} AS t FROM documents) WHERE length(t) >= 500",
        "chapter_title": f"SELECT doc_id AS chapter, coalesce(nullif(split_part({stripped}, chr(10), 1), ''), source || '-' || doc_id) AS title FROM documents",
        "story_id_from_file": "SELECT doc_id AS chapter, source AS book, doc_id AS number FROM documents",
        "corpus_pair": x + ", o AS (SELECT book, variant, chapter, row_number() OVER (PARTITION BY book, variant ORDER BY chapter) AS rn FROM c) SELECT a.book, a.chapter AS original, b.chapter AS modified FROM o a JOIN o b ON a.book = b.book AND a.rn = b.rn AND a.variant = 'original' AND b.variant = 'modified'",
        "top_n_chapters": x + f"SELECT book, chapter, rn FROM (SELECT book, chapter, CAST({number} AS INTEGER) AS rn FROM c) WHERE rn <= 3",
        "pilot_chapters": x + f"SELECT book, chapter, rn FROM (SELECT book, chapter, CAST({number} AS INTEGER) AS rn FROM c) WHERE rn <= 1",
        "sanitize_symbol": f"SELECT doc_id AS chapter, {symbol('text')} AS symbol FROM documents",
        "sanitize_symbol_short": "SELECT chapter, substring(CASE WHEN regexp_matches(s, '^[0-9]') THEN 'x' || s ELSE s END, 1, 50) AS symbol FROM (SELECT doc_id AS chapter, regexp_replace(lower(text), '[^a-z0-9_]', '_', 'g') AS s FROM documents)",
        "parse_term": f + "SELECT event_id, k % 2 = 0 AS negated, type AS functor, CASE WHEN k % 2 = 0 THEN agent || '+' || patient ELSE agent END AS args FROM e",
        "role_from_var": f + "SELECT event_id, CASE k % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'patient' WHEN 2 THEN 'arg3' ELSE 'unknown' END AS role FROM e",
        "fact_quote": "SELECT doc_id AS chapter, md5(substring(replace(replace(text, chr(10), ' '), '\"', chr(92) || '\"'), 1, 500)) AS quote_md5 FROM documents",
        "prompt_render": "SELECT doc_id AS chapter, md5('Story: ' || substring(text, 1, 3000) || ' / Book: ' || source) AS prompt_md5 FROM documents",
        "signature_normalized": x + f"SELECT chapter, CASE WHEN {valid} THEN raw_category ELSE {pick} END || '|' || type || '|' || substring(trim(regexp_replace(regexp_replace(lower(description), '\\b(e[0-9]+|t[0-9]+)\\b', 'EID', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 100) AS sig FROM ({scored})",
        "signature_md5": x + "SELECT chapter, substring(md5(raw_category || ':' || type || ':' || lower(substring(description, 1, 200))), 1, 16) AS sig FROM x",
        "signature_tuple": x + "SELECT raw_category, type, substring(description, 1, 100) AS start, count(*) AS n FROM x GROUP BY ALL",
        "signature_words": x + "SELECT chapter, category || ':' || array_to_string(list_sort(list_distinct(list_slice(regexp_extract_all(lower(description), '[0-9a-z_]{4,}'), 1, 5))), ':') AS sig FROM x",
        "signature_quoted": x + "SELECT chapter, category || ':' || array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(lower(replace(description, ' ', '''')), '''([^'']+)''', 1))), 1, 3), ':') AS sig FROM x",
        "signature_hash": x + "SELECT n, count(*) AS signatures FROM (SELECT count(*) AS n FROM x GROUP BY category, substring(description, 1, 100)) GROUP BY n",
        "signature_prefix50": x + "SELECT chapter, category || ':' || substring(description, 1, 50) AS sig FROM x",
        "classify_by_score": x + f"SELECT chapter, {pick} AS category FROM ({scored})",
        "classify_raw_violation": x + f"SELECT chapter, {_when('w', E.KEYWORDS)} AS category FROM (SELECT *, CASE WHEN chapter % 2 = 0 THEN category ELSE type END AS w FROM x)",
        "infer_category_substring": x + f"SELECT chapter, {_when('type', E.SUBSTRINGS)} AS category FROM x",
        "infer_category_exact": x + f"SELECT chapter, {exact} AS category FROM x",
        "classify_by_description": x + f"SELECT chapter, CASE WHEN {valid} THEN raw_category ELSE {_when('w', E.DESCRIBED)} END AS category FROM (SELECT *, type || ' occurs' AS w FROM x)",
        "baseline_signatures": x + "SELECT DISTINCT source, sig FROM x WHERE variant = 'original'",
        "true_positives": x + "SELECT chapter, source, sig FROM x WHERE variant = 'modified' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.variant = 'original' AND b.source = x.source AND b.sig = x.sig)",
        "filtered_errors": x + "SELECT chapter, source, sig FROM x WHERE variant = 'modified' AND EXISTS (SELECT 1 FROM x b WHERE b.variant = 'original' AND b.source = x.source AND b.sig = x.sig)",
        "folds_contiguous": x + _folds("contiguous") + "SELECT k, fold, book, role FROM folds",
        "folds_contiguous_open": x + _folds("open") + "SELECT k, fold, book, role FROM folds",
        "folds_truncating": x + _folds("truncating") + "SELECT k, fold, book, role FROM folds",
        "folds_combinations": x + "SELECT a.book AS b1, b.book AS b2 FROM books a JOIN books b ON a.book < b.book",
        "folds_chapters": x + ", " + chapter_fold + "SELECT book, chapter, fold FROM cf",
        "folds_paired": x + ", " + chapter_fold + "SELECT book, fold, CASE variant WHEN 'original' THEN 'baseline' ELSE 'test' END AS role, count(*) AS n FROM cf GROUP BY ALL",
        "fold_evaluate": x + evaluated + "SELECT * FROM ev",
        "fold_aggregate": x + evaluated + "SELECT k, count(*) AS folds, CAST(sum(tp) AS BIGINT) AS true_positives, CAST(sum(fi) AS BIGINT) AS filtered, round(avg(tp), 6) AS mean_true_positives FROM (SELECT f.k, f.fold, coalesce(sum(true_positives), 0) AS tp, coalesce(sum(filtered), 0) AS fi FROM (SELECT DISTINCT k, fold FROM folds) f LEFT JOIN ev ON ev.k = f.k AND ev.fold = f.fold GROUP BY ALL) GROUP BY k",
        "count_by_category": x + f"SELECT v.raw_category, count(x.book) AS n FROM (SELECT * FROM {cat.replace('category', 'raw_category')} UNION ALL SELECT 'other') v LEFT JOIN x ON CASE WHEN {valid.replace('raw_category', 'x.raw_category')} THEN x.raw_category ELSE 'other' END = v.raw_category GROUP BY v.raw_category",
        "count_by_source": x + "SELECT v.source, count(x.book) AS n FROM (VALUES ('llm'), ('logic')) v(source) LEFT JOIN x ON x.source = v.source GROUP BY v.source",
        "count_by_severity": x + "SELECT v.severity, count(x.book) AS n FROM (VALUES ('low'), ('medium'), ('high')) v(severity) LEFT JOIN x ON x.severity = v.severity GROUP BY v.severity",
        "count_by_book": x + "SELECT book, count(DISTINCT chapter) AS chapters, count(*) FILTER (WHERE source = 'llm') AS llm, count(*) FILTER (WHERE source = 'logic') AS logic FROM x GROUP BY book",
        "category_source_matrix": x + ", " + matrix + "SELECT category, llm, logic, total, round(total / nullif(sum(total) OVER (), 0), 6) AS share, round(logic / nullif(llm, 0), 6) AS ratio FROM m",
        "category_winner": x + ", " + matrix + "SELECT category, CASE WHEN llm > logic THEN 'llm' ELSE 'logic' END AS winner FROM m WHERE llm <> logic",
        "type_distribution": x + "SELECT category, type, count(*) AS n FROM x GROUP BY ALL", "order_by_count": x + "SELECT type, count(*) AS n FROM x GROUP BY ALL",
        "type_samples": x + "SELECT type, count(*) AS n, arg_min(description, chapter) AS sample FROM x GROUP BY type",
        "story_summary": x + "SELECT book, variant, count(*) FILTER (WHERE source = 'llm') AS llm, count(*) FILTER (WHERE source = 'logic') AS logic, count(*) AS total FROM x GROUP BY ALL",
        "corpus_summary": x + ", st AS (SELECT book || '/' || (chapter % 500) AS s, count(*) FILTER (WHERE severity = 'odd') AS n FROM x GROUP BY ALL) SELECT count(*) AS stories, CAST(sum(n) AS BIGINT) AS errors, round(avg(n), 6) AS mean, count(*) FILTER (WHERE n >= 1) AS with_errors, (SELECT count(DISTINCT sig) FROM x WHERE severity = 'odd') AS signatures, (SELECT count(DISTINCT book) FROM x WHERE severity = 'odd') AS books FROM st",
        "rollup_report": x + "SELECT category, source, book, count(*) AS n, CAST(grouping_id(category, source, book) AS BIGINT) AS level FROM x GROUP BY ROLLUP (category, source, book)",
        "batch_status": "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars >= 500) AS successful, count(*) FILTER (WHERE n_chars < 500) AS failed FROM documents",
        "chapter_status": x + "SELECT book, variant, count(*) FILTER (WHERE source = 'llm') AS llm, count(*) FILTER (WHERE source = 'logic') AS logic, count(*) FILTER (WHERE raw_category = 'plot') AS other, count(*) FILTER (WHERE source = 'llm') > 0 AS success FROM x GROUP BY ALL",
        "top_n_errors": x + f"SELECT book, chapter, rn FROM (SELECT book, chapter, CAST({number} AS INTEGER) AS rn FROM x) WHERE rn <= 3",
        "error_numbering": x + f"SELECT chapter, 'logic_' || {number} AS id FROM x",
        "timing_summary": "SELECT event_type AS type, count(*) AS calls, round(sum(value), 4) AS seconds, round(avg(value), 4) AS mean_seconds FROM events GROUP BY ALL",
        "call_stats": "SELECT event_type AS type, 'm' || (user_id % 3) AS model, count(*) AS calls, round(sum(value), 4) AS seconds, round(avg(value), 4) AS mean_seconds FROM events GROUP BY ALL",
        "call_log_scan": "SELECT count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS chars FROM events",
        "key_union": "SELECT source AS book FROM documents WHERE n_chars < 900 UNION SELECT source FROM documents WHERE n_chars > 9000",
        "book_intersection": "SELECT source AS book FROM documents WHERE n_chars < 300 INTERSECT SELECT source FROM documents WHERE n_chars > 9000",
        "book_difference": "SELECT source AS book FROM documents EXCEPT SELECT source FROM documents WHERE n_chars > 30000",
        "strip_think": r + "SELECT conv_id, turn, 'Here is the report: ' || body || ' Done {ok}.' AS text FROM r", "extract_json": r + "SELECT conv_id, turn, body AS json FROM r",
        "parse_lint": r + "SELECT conv_id, turn, CAST(1 AS BIGINT) AS error_count FROM r", "sanitize_json": r + "SELECT conv_id, turn, 'a' || chr(10) || chr(9) || 'b ' || plain AS description FROM r",
        "normalize_lint": r + "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'temporal' WHEN 1 THEN 'coherence' ELSE 'location' END AS category, CASE conv_id % 4 WHEN 0 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS severity FROM r",
        "explode_errors": r + "SELECT conv_id, turn, 0 AS n, 'e' || turn AS id, 'x{1}' AS type FROM r", "extract_errors": r + "SELECT conv_id, turn, plain AS description, '' AS fragment FROM r",
        "error_description": f + "SELECT event_id, 'Violation: checked | Event type: ' || type || ' | Agent: ' || agent || CASE WHEN k % 2 = 0 THEN ' | Patient: ' || patient ELSE '' END || ' | Detail: ' || location AS description FROM e WHERE type IN ('die', 'kill', 'trust')",
        "sanitize_list": f"SELECT doc_id AS chapter, array_to_string({words}, '__') AS symbol FROM documents",
        "fragment_by_term": by_term,
        "fragment_by_quote": by_quote,
        "fragment_by_sentence": by_sentence,
        "sanitize_symbol_whole": f"SELECT doc_id AS chapter, md5({symbol('text')}) AS symbol_md5 FROM documents",
        "sanitize_symbol_short_whole": "SELECT chapter, substring(CASE WHEN regexp_matches(s, '^[0-9]') THEN 'x' || s ELSE s END, 1, 50) AS symbol FROM (SELECT doc_id AS chapter, regexp_replace(lower(text), '[^a-z0-9_]', '_', 'g') AS s FROM documents)",
        "signature_normalized_whole": x + f"SELECT chapter, CASE WHEN {valid} THEN raw_category ELSE {pick} END || '|' || type || '|' || substring(trim(regexp_replace(regexp_replace(lower(description), '\\b(e[0-9]+|t[0-9]+)\\b', 'EID', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 100) AS sig FROM ({scored})",
        "signature_words_whole": x + "SELECT chapter, category || ':' || array_to_string(list_sort(list_distinct(list_slice(regexp_extract_all(lower(description), '[0-9a-z_]{4,}'), 1, 5))), ':') AS sig FROM x",
        "signature_quoted_whole": x + "SELECT chapter, category || ':' || array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(lower(replace(description, ' ', '''')), '''([^'']+)''', 1))), 1, 3), ':') AS sig FROM x",
        "classify_by_score_whole": x + f"SELECT chapter, {pick} AS category FROM ({scored})",
        "type_samples_whole": x + "SELECT type, count(*) AS n, md5(arg_min(description, chapter)) AS sample_md5 FROM x GROUP BY type",
        "event_lookup": f + "SELECT r.story_id, r.event_id, coalesce(e.type, 'unknown') AS type, coalesce(e.agent, 'unknown') AS agent, coalesce(e.patient, 'unknown') AS patient, coalesce(e.agent || ' did ' || e.type, 'unknown') AS description FROM (SELECT story_id, CASE WHEN k % 3 = 0 THEN event_id ELSE event_id + 10000000 END AS event_id FROM e) r LEFT JOIN e ON e.story_id = r.story_id AND e.event_id = r.event_id",
        "violation_to_error": f + found + "SELECT story_id, id, 'logic' AS source, category, type, event, detail, description FROM er",
        "violation_to_error_base": f + found_base + "SELECT story_id, id, 'logic' AS source, category, type, event, detail, description FROM er",
        "finding_true_positives": f + found + ", si AS (SELECT *, substring(md5(category || ':' || type || ':' || lower(detail)), 1, 16) AS sig, day(CAST(story_id AS DATE)) % 2 = 0 AS base FROM er) SELECT story_id, id, sig FROM si t WHERE NOT base AND NOT EXISTS (SELECT 1 FROM si b WHERE b.base AND b.sig = t.sig)",
        "fragment_by_event": f + found + "SELECT er.story_id, er.id, coalesce(a.agent || ' did ' || a.type, '') || coalesce('//' || b.agent || ' did ' || b.type, '') AS fragments FROM er LEFT JOIN e a ON a.story_id = er.story_id AND CAST(a.event_id AS VARCHAR) = er.event LEFT JOIN e b ON b.story_id = er.story_id AND CAST(b.event_id AS VARCHAR) = er.detail",
        "chunked_stories": "SELECT doc_id AS chapter, CAST(n AS INTEGER) AS chunk, md5(array_to_string(l[n * 50 + 1 : n * 50 + 50], chr(10))) AS text_md5 FROM (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 50 + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
        "fragment_by_entity": f"SELECT doc_id AS chapter, md5(array_to_string(list_slice(list_filter(list_transform({ENTITIES}, lambda x: {around}), lambda y: y IS NOT NULL), 1, 3), '//')) AS fragments_md5 FROM documents",
    }
