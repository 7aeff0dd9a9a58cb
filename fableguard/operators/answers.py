"""Model answers read as VARIANT: one row for each answer and part, with a reason where it can't be read.

Answers come in several dialects: a report ``{"error_count": n, "errors": [...]}``, a result with the parts ``llm_lint`` and
``logic_lint``, either within other text, in a fence, after a <think> block, or with raw control characters in strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fableguard.functions.knowledge import CATEGORIES
from fableguard.operators.errors import extract_json, strip_think

PARTS = ("llm_lint", "logic_lint")
#: A JSON string, what stands between strings, or a quote that nothing closes.
_TOKENS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'
_CONTROL = {"\n": r"\n", "\r": r"\r", "\t": r"\t", "\b": r"\b", "\f": r"\f"}


def sanitize_json(text: Column) -> Column:
    """Raw control characters within strings as escapes; others than the five that have a letter are dropped."""

    def clean(token: Column) -> Column:
        for raw, escape in _CONTROL.items():
            token = F.replace(token, F.lit(raw), F.lit(escape))
        return F.regexp_replace(token, r"[\x00-\x1F]", "")

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"') & (F.length(t) > 1), clean(t)).otherwise(t)), "")


def _get(v: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def parse_answers(answers: DataFrame, response: str = "response") -> DataFrame:
    """The other columns of answers with part, reason, error_count and errors (array of VARIANT).

    A row for each answer: ``part`` is ``report``; or one for each of PARTS that it has. ``reason`` is null or one of no_answer,
    no_json, bad_json, missing_keys, errors_not_list, bad_count; then errors is null and error_count 0. A stated count that
    differs from the list's length gives way to it. Parts need no count.
    """
    keys = [c for c in answers.columns if c != response]
    own = F.col(response)
    rows = answers.withColumn("raw_", F.coalesce(extract_json(own), extract_json(strip_think(own))))
    rows = rows.withColumn("doc_", F.coalesce(F.try_parse_json("raw_"), F.try_parse_json(sanitize_json(F.col("raw_")))))
    held = F.array_compact(F.array(*(F.when(_get("doc_", p, "variant").isNotNull(), F.lit(p)) for p in PARTS)))
    whole = F.col("doc_").isNull() | (F.size(held) == 0)
    rows = rows.withColumn("part", F.explode(F.when(whole, F.array(F.lit("report"))).otherwise(held)))
    part = F.when(F.col("part") == PARTS[0], _get("doc_", PARTS[0], "variant")).when(F.col("part") == PARTS[1], _get("doc_", PARTS[1], "variant"))
    rows = rows.withColumn("report_", F.when(F.col("part") == "report", F.col("doc_")).otherwise(part))
    errors, count = _get("report_", "errors", "variant"), _get("report_", "error_count", "variant")
    counted = F.col("part") == "report"
    listed = F.expr("schema_of_variant(try_variant_get(report_, '$.errors', 'variant'))").startswith("ARRAY")
    reason = (
        F.when(own.isNull() | (F.trim(own) == ""), "no_answer")
        .when(F.col("raw_").isNull(), "no_json")
        .when(F.col("doc_").isNull(), "bad_json")
        .when(errors.isNull() | (counted & count.isNull()), "missing_keys")
        .when(~F.coalesce(listed, F.lit(False)), "errors_not_list")
        .when(counted & _get("report_", "error_count", "double").isNull(), "bad_count")
    )
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("errors", F.when(F.col("reason").isNull(), _get("report_", "errors", "array<variant>")))
    return rows.select(*keys, "part", "reason", F.when(F.col("reason").isNull(), F.size("errors")).otherwise(0).cast("long").alias("error_count"), "errors")


def extract_errors(parsed: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """keys, source, n, id, category, description, type, fragments, entities: the errors of the part of a source.

    The part is ``{source}_lint``; reports count as the part of ``llm``. What is no object is left out, and keeps its number.
    Unknown categories count as coherence; without description the id stands in, or its number.
    """
    parts = [f"{source}_lint", *(["report"] if source == "llm" else [])]
    rows = parsed.where(F.col("part").isin(parts) & F.col("reason").isNull())
    rows = rows.select(*keys, F.posexplode("errors").alias("n", "e")).where(F.expr("schema_of_variant(e)").startswith("OBJECT"))
    category, told = F.lower(_get("e", "category", "string")), lambda c: F.nullif(_get("e", c, "string"), F.lit(""))
    number = F.col("n").cast("string")
    return rows.select(
        *keys,
        F.lit(source).alias("source"),
        "n",
        F.coalesce(told("id"), F.concat(F.lit(f"{source}_"), number)).alias("id"),
        F.when(category.isin(*CATEGORIES), category).otherwise("coherence").alias("category"),
        F.coalesce(told("description"), told("id"), F.concat(F.lit("Error "), number)).alias("description"),
        F.coalesce(told("violation_type"), told("type"), F.lit("")).alias("type"),
        F.coalesce(_get("e", "story_fragments", "array<string>"), F.array().cast("array<string>")).alias("fragments"),
        F.coalesce(_get("e", "involved_entities", "array<string>"), F.array().cast("array<string>")).alias("entities"),
    )
