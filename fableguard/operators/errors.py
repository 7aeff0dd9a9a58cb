"""Error records: classes, signatures, descriptions and evidence. All are column functions or joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fableguard.functions.knowledge import CATEGORIES

# --- fixed values: keywords of each category, in the order in which they are tried
KEYWORDS = {
    "causality": ["chekhov", "uncaused", "cause", "effect", "precondition", "unexplained"],
    "coherence": ["dead_agent", "non_edible", "physical_impossibility", "focus_overlap", "edible", "semantic", "logical"],
    "temporal": ["circular_time", "negative_duration", "explicit_order", "temporal", "before", "after", "overlap", "duration"],
    "location": ["ubiquity", "proximity", "impossible_travel", "location", "spatial", "distance", "teleport"],
    "emotional": ["harm_loved", "help_enemy", "approach_feared", "misplaced_trust", "state_action_mismatch", "emotion", "relationship", "loves", "hates"],
}
SUBSTRINGS = {
    "causality": ["chekhov", "cause", "effect", "precondition"],
    "coherence": ["dead", "edible", "physical", "focus"],
    "temporal": ["time", "duration", "order", "temporal"],
    "location": ["ubiquity", "proximity", "travel", "location"],
    "emotional": ["harm", "help", "enemy", "love", "fear", "trust", "emotion"],
}
EXACT = {
    "location": ["ubiquity", "proximity_required", "impossible_travel"],
    "temporal": ["circular_time", "negative_duration", "explicit_order_violated"],
    "causality": ["chekhov_gun", "uncaused_event", "effect_without_cause", "precondition_missing"],
    "emotional": ["harm_loved", "help_enemy", "approach_feared", "misplaced_trust", "state_action_mismatch"],
}
DESCRIBED = {
    "causality": ["cause", "chekhov", "unexplained", "effect", "precondition"],
    "temporal": ["time", "temporal", "before", "after", "duration", "order", "simultaneous"],
    "location": ["location", "place", "ubiquity", "distance", "travel", "spatial", "teleport"],
    "emotional": ["emotion", "love", "hate", "fear", "trust", "relationship", "feeling"],
}


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words[1:], c.contains(words[0]))


def _first(c: Column, table: dict[str, list[str]]) -> Column:
    """The first category with a keyword in c, else coherence."""
    out = F.when(F.lit(False), "")
    for category, words in table.items():
        out = out.when(_any(c, words), category)
    return out.otherwise("coherence")


def _in_texts(table: dict[str, list[str]]) -> Callable[[Column], Column]:
    """A function of texts: array<int>, how many of its ASCII keywords, in lower case, each category has in a text of any case.

    A task searches the bytes of an Arrow batch. Of signs outside ASCII but two become such letters when lower-cased, so whole
    texts need no case mapping, which takes longer than the search.
    """
    words = [[w.encode() for w in ws] for ws in table.values()]

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        def of(text: bytes) -> list[int]:
            plain = text.replace("\u212a".encode(), b"k").replace("\u0130".encode(), "i\u0307".encode()).lower()
            return [sum(w in plain for w in ws) for ws in words]

        return pa.array((None if x is None else of(x) for x in texts.cast(pa.binary()).to_pylist()), pa.list_(pa.int32()))

    return count


def by_score(category: Column, kind: Column, description: Column) -> Column:
    """A valid category as it is, else the one with most keywords in type and description; the earlier of equals."""
    valid = F.coalesce(F.lower(category).isin(*CATEGORIES), F.lit(False))
    # Lower-casing ASCII is cheap here; other texts are left to the search.
    told = F.when(F.octet_length(description) == F.length(description), F.lower(F.coalesce(description, F.lit("")))).otherwise(description)
    text = F.when(~valid, F.concat_ws(" ", F.lower(F.coalesce(kind, F.lit(""))), told))
    scores = _in_texts({c: KEYWORDS[c] for c in CATEGORIES})(text)
    pick = _let(scores, lambda s: F.when(F.array_max(s) == 0, "coherence").otherwise(F.element_at(F.array(*map(F.lit, CATEGORIES)), F.array_position(s, F.array_max(s)).cast("int"))))
    return F.when(valid, F.lower(category)).otherwise(pick)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value, used many times, is computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def raw_violation(first: Column) -> Column:
    """By the first part of a raw finding, whatever that is."""
    return _first(F.lower(F.coalesce(first, F.lit(""))), KEYWORDS)


def by_substring(kind: Column) -> Column:
    return _first(F.lower(kind), SUBSTRINGS)


def by_type(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for category, kinds in EXACT.items():
        out = out.when(F.lower(kind).isin(kinds), category)
    return out.otherwise("coherence")


def by_description(category: Column, description: Column) -> Column:
    return F.when(F.lower(category).isin(*CATEGORIES), F.lower(category)).otherwise(_first(F.lower(description), DESCRIBED))


# --- signatures


def signature_normalized(category: Column, kind: Column, description: Column) -> Column:
    plain = F.regexp_replace(F.lower(description), r"\b(e[0-9]+|t[0-9]+)\b", "EID")
    plain = F.substring(F.trim(F.regexp_replace(plain, "[ \\t\\n\\r\\f\\x0B]+", " ")), 1, 100)
    return F.concat_ws("|", by_score(category, kind, description), kind, plain)


def signature_md5(category: Column, kind: Column, description: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lower(category), F.lower(kind), F.lower(F.substring(description, 1, 200))).cast("binary")), 1, 16)


def signature_words(category: Column, description: Column) -> Column:
    words = F.slice(F.regexp_extract_all(F.lower(description), F.lit(r"[0-9a-z_]{4,}"), F.lit(0)), 1, 5)
    return F.concat_ws(":", category, F.array_join(F.array_sort(F.array_distinct(words)), ":"))


def signature_quoted(category: Column, description: Column) -> Column:
    words = F.regexp_extract_all(F.lower(description), F.lit("'([^']+)'"), F.lit(1))
    return F.concat_ws(":", category, F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 3), ":"))


def signature_hash(category: Column, description: Column) -> Column:
    """A hash that is the same in every process."""
    return F.concat_ws(":", category, F.xxhash64(F.substring(description, 1, 100)).cast("string"))


def signature_prefix50(category: Column, description: Column) -> Column:
    return F.concat_ws(":", category, F.substring(description, 1, 50))


# --- evidence


def fragment_by_term(text: Column, terms: list[Column], around: int = 100, widen: int = 50) -> Column:
    """Text around the first term found, widened to sentence ends that are near, with ellipses where it is cut; null if none is."""
    places = [F.position(F.lower(t), F.lower(text)) for t in terms]
    at = F.coalesce(*(F.when((F.length(t) > 2) & (p > 0), p) for t, p in zip(terms, places, strict=True)))
    size = F.coalesce(*(F.when((F.length(t) > 2) & (p > 0), F.length(t)) for t, p in zip(terms, places, strict=True)))
    low, high = F.greatest(F.lit(1), at - around), F.least(F.length(text) + 1, at + size + around)
    margin = F.substring(text, F.greatest(F.lit(1), low - widen), low - F.greatest(F.lit(1), low - widen))
    to_left = F.length(F.regexp_extract(margin, r"[.!?][^.!?]*$", 0))
    start = F.when(to_left > 0, low - to_left + 1).otherwise(low)
    to_right = F.length(F.regexp_extract(F.substring(text, high, F.lit(widen)), r"^[^.!?]*[.!?]", 0))
    end = high + to_right
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.trim(F.substring(text, start, end - start)), F.when(end <= F.length(text), "...").otherwise(""))
    return F.when(at.isNotNull(), cut)


def fragments_by_quote(description: Column, text: Column, around: int = 100, least: int = 3, tried: int = 3, most: int = 2) -> Column:
    """Text around what the description quotes, where the text has it."""
    quotes = F.slice(F.filter(F.regexp_extract_all(description, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), lambda q: F.length(q) >= least), 1, tried)
    low = lambda q: F.greatest(F.lit(1), F.position(F.lower(q), F.lower(text)) - around)
    near = F.transform(F.filter(quotes, lambda q: F.position(F.lower(q), F.lower(text)) > 0), lambda q: F.substring(text, low(q), F.length(q) + 2 * around))
    return F.slice(near, 1, most)


def fragments_by_sentence(docs: DataFrame, id_col: str, text_col: str, words: DataFrame, per_word: int = 2, most: int = 5) -> DataFrame:
    """(id, word, sentence): sentences that hold the id's words (id, word), the first few of each."""
    sentences = docs.select(id_col, F.posexplode(F.split(text_col, r"(?<=[.!?])\s+")).alias("at", "sentence"))
    hits = sentences.join(words, id_col).where(F.col("sentence").contains(F.col("word")))
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy(id_col, "word").orderBy("at"))).where(F.col("n") <= per_word)
    hits = hits.withColumn("m", F.row_number().over(Window.partitionBy(id_col).orderBy("at", "word"))).where(F.col("m") <= most)
    return hits.select(id_col, "word", "at", "sentence")


def describe(kind: Column, event_type: Column, agent: Column, patient: Column, detail: Column) -> Column:
    """``Violation: t | Event type: ... | ...`` without the parts that are null."""
    labelled = lambda label, c: F.concat(F.lit(label), c)
    return F.concat_ws(" | ", labelled("Violation: ", kind), labelled("Event type: ", event_type), labelled("Agent: ", agent), labelled("Patient: ", patient), labelled("Detail: ", detail))


def fragments_by_entity(text: Column, entities: Column, around: int = 250, most: int = 3) -> Column:
    """Text around the first mention of each entity (its _ read as blanks), the first few, with ellipses where it is cut."""
    blank = "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$"

    def around_mention(entity: Column) -> Column:
        at = F.position(F.lower(F.replace(entity, F.lit("_"), F.lit(" "))), F.lower(text))
        start = F.greatest(F.lit(1), at - around)
        end = F.least(F.length(text) + 1, at + F.length(entity) + around)
        cut = F.regexp_replace(F.substring(text, start, end - start), blank, "")
        return F.when((at > 0) & (entity != ""), F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end <= F.length(text), "...").otherwise("")))

    return F.slice(F.array_compact(F.transform(entities, around_mention)), 1, most)


def fragments_by_event(errors: DataFrame, fragments: DataFrame) -> DataFrame:
    """errors with fragments: what fragments (story_id, event_id, fragment) has for the error's event and, if it names one, its detail."""
    named = errors.select("story_id", "id", F.posexplode(F.array("event", "detail")).alias("at", "event_id")).where("event_id is not null")
    quoted = fragments.select("story_id", F.col("event_id").cast("string").alias("event_id"), "fragment").where("fragment is not null")
    found = named.join(quoted, ["story_id", "event_id"]).groupBy("story_id", "id").agg(F.array_sort(F.collect_set(F.struct("at", "fragment"))).alias("f"))
    return errors.join(found, ["story_id", "id"], "left").withColumn("fragments", F.coalesce(F.col("f.fragment"), F.array().cast("array<string>"))).drop("f")


# --- findings of rules as error records


def error_of_parts(parts: Column) -> Column:
    """struct(category, type, event, detail) of a raw finding: with four parts as they are, with two or three without its category, else null."""
    part = lambda k: F.get(parts, F.lit(k))
    four = F.struct(F.lower(part(0)).alias("category"), part(1).alias("type"), part(2).alias("event"), part(3).alias("detail"))
    fewer = F.struct(by_substring(part(0)).alias("category"), part(0).alias("type"), part(1).alias("event"), F.coalesce(part(2), F.lit("")).alias("detail"))
    return F.when(F.size(parts) >= 4, four).when(F.size(parts) >= 2, fewer)


def violation_to_error(findings: DataFrame, first: str = "category") -> DataFrame:
    """story_id, id, source, category, type, event, detail, description of the findings of ``rules.check``.

    Errors are numbered per story by type, event and detail. With ``first="type"`` findings are read without their
    category, as those of ruleset base are, and get it from their type.
    """
    parts = F.array_compact(F.array(*[c for c in ("category", "type") if c >= first], "subject", "detail"))
    e = findings.select("story_id", error_of_parts(parts).alias("e")).where("e is not null").select("story_id", "e.*")
    described = F.concat(F.lit("Violation: "), F.col("type"), F.lit(" at event "), F.col("event"), F.when(F.col("detail") != "", F.concat(F.lit(" ("), F.col("detail"), F.lit(")"))).otherwise(""))
    number = F.row_number().over(Window.partitionBy("story_id").orderBy("type", "event", "detail"))
    return e.select("story_id", F.concat(F.lit("logic_"), number.cast("string")).alias("id"), F.lit("logic").alias("source"), "category", "type", "event", "detail", described.alias("description"))


def event_lookup(refs: DataFrame, events: DataFrame) -> DataFrame:
    """refs (story_id, event_id, ...) with type, agent, patient and description of events; what isn't found is ``unknown``."""
    told = ["type", "agent", "patient", "description"]
    out = refs.join(events.select("story_id", "event_id", *told), ["story_id", "event_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in told})


def keywords_of(description: Column) -> Column:
    """What a description quotes, then its capitalised words: three letters at least, each once whatever its case."""
    found = [F.regexp_extract_all(description, F.lit(p), F.lit(1)) for p in ('"([^"]+)"', "'([^']+)'", r"\b([A-Z][a-z]+)\b")]
    long = F.filter(F.concat(*found), lambda w: F.length(w) >= 3)
    numbered = F.transform(long, lambda w, k: F.struct(w.alias("word"), k.alias("at")))
    lowered = F.transform(long, F.lower)
    return F.transform(F.filter(numbered, lambda x: F.array_position(lowered, F.lower(x["word"])) == x["at"] + 1), lambda x: x["word"])


def fragments_by_keyword(text: Column, description: Column, context: int = 200, each: int = 2, most: int = 5) -> Column:
    """Array of (keyword, start, end, text): the sentences of the text around the keywords of a description.

    Of each keyword the first ``each`` places count, in any case, ``most`` of all in the keywords' order. A fragment has ``context``
    characters on both sides and goes on to the ends of its sentences; one of 20 characters or less is none. Start counts from 0, end is
    exclusive. A place is looked up after the one before, so the work is a few passes over the text for each keyword.
    """
    return _let(F.struct(text.alias("text"), F.lower(text).alias("plain"), F.length(text).alias("size")), lambda t: _keyword_pieces(t["text"], t["plain"], t["size"], description, context, each, most))


def _keyword_pieces(text: Column, plain: Column, size: Column, description: Column, context: int, each: int, most: int) -> Column:
    def piece(word: Column, at: Column) -> Column:
        low, high = F.greatest(F.lit(0), at - 1 - context), F.least(size, at - 1 + F.length(word) + context)
        # Read backwards the start of a sentence is found at once, not tried for at every place.
        tail = F.length(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), low + 1)), r"^[^.!?\n]*+", 0))
        start = F.when(low == 0, 0).otherwise(F.greatest(F.lit(0), low - tail))
        end = high + F.length(F.regexp_extract(F.substring(text, high + 1, size), r"^[^.!?\n]*+", 0))
        cut = F.regexp_replace(F.substring(text, start + 1, end - start), r"^\s+|\s+$", "")
        return F.struct(word.alias("keyword"), start.cast("int").alias("start"), end.cast("int").alias("end"), cut.alias("text"))

    def of(word: Column) -> Column:
        step = lambda acc, _: F.when(F.element_at(acc, -1) == 0, acc).otherwise(F.array_append(acc, _locate(F.lower(word), plain, F.element_at(acc, -1) + F.length(word))))
        at = F.aggregate(F.sequence(F.lit(2), F.lit(each)), F.array(_locate(F.lower(word), plain, F.lit(1))), step) if each > 1 else F.array(_locate(F.lower(word), plain, F.lit(1)))
        return F.transform(F.filter(at, lambda a: a > 0), lambda a: piece(word, a))

    every = F.flatten(F.transform(keywords_of(description), of))
    return F.slice(F.filter(every, lambda x: F.length(x["text"]) > 20), 1, most)


def _locate(word: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", word, text, start)


# --- model responses


def strip_think(c: Column) -> Column:
    """Without the first <think> block."""
    start, end = F.position(F.lit("<think>"), c), F.position(F.lit("</think>"), c)
    rest = F.concat(F.substring(c, F.lit(1), start - 1), F.substring(c, end + 8, F.length(c)))
    return F.trim(F.when((start > 0) & (end > start), rest).otherwise(c))


def extract_json(c: Column) -> Column:
    """The text itself if it is one object, else the first object with balanced braces (those in strings count too)."""
    text = F.trim(c)
    start = F.position(F.lit("{"), text)
    rest = F.substring(text, start, F.length(text))
    # between braces there is nothing to decide: walk from brace to brace
    steps = F.regexp_extract_all(rest, F.lit(r"[{}][^{}]*"), F.lit(0))
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def walk(acc: Column, s: Column) -> Column:
        depth = acc["depth"] + F.when(s.startswith("{"), 1).otherwise(-1)
        closed = depth == 0
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["length"] + F.when(closed, 1).otherwise(F.length(s))).alias("length"), closed.alias("done")))

    found = F.aggregate(steps, begin, walk)
    return F.when(text.startswith("{") & text.endswith("}"), text).when((start > 0) & found["done"], F.substring(rest, F.lit(1), found["length"]))


REPORT = "STRUCT<error_count: BIGINT, errors: ARRAY<STRUCT<id: STRING, category: STRING, type: STRING, description: STRING, fragment: STRING, severity: STRING>>>"


def parse_lint(c: Column) -> Column:
    """The report in a response, raw control characters allowed; null where there is none (answers.parse_answers tells why)."""
    return F.from_json(c, REPORT, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})


def explode_errors(parsed: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """keys, n, and the fields of each error with defaults: unknown category -> coherence, unknown severity -> medium."""
    e = parsed.select(*keys, F.posexplode_outer(F.col(report)["errors"]).alias("n", "e"))
    category, severity = F.lower(F.col("e.category")), F.lower(F.col("e.severity"))
    return e.select(
        *keys, "n", F.coalesce("e.id", F.concat(F.lit("llm_"), (F.col("n") + 1).cast("string"))).alias("id"), F.when(category.isin(*CATEGORIES), category).otherwise("coherence").alias("category"),
        F.coalesce("e.type", F.lit("unknown")).alias("type"), F.coalesce("e.description", F.lit("")).alias("description"), F.coalesce("e.fragment", F.lit("")).alias("fragment"), F.when(severity.isin("low", "medium", "high"), severity).otherwise("medium").alias("severity"),
    )
