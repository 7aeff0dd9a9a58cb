"""Queries of the structured-story reader, over one JSON story per user and day of the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.functions import knowledge as K
from fableguard.operators import fluents, rules, structured
from fableguard.plans.adapters import events_as_story, facts_sql, narrated
from fableguard.plans.facts import everywhere, small
from fableguard.sources.stories import parse_stories

Query = Callable[[SparkSession, str], DataFrame]
MINUTE = 60_000_000


def story_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story_id, json. Agents are single or listed, patients may be null, ends may be missing, names need cleaning."""
    e = narrated(spark, sf_dir)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    who, k = F.concat(F.lit("U-"), F.col("user_id").cast("string")), F.col("k")
    at = lambda c: F.concat(F.lit("T."), F.floor(F.col(c) / MINUTE).cast("string"))
    event = F.concat(
        F.lit('{"id": "E '), F.col("event_id").cast("string"), F.lit('", "type": '), q(F.col("type")), F.lit(', "agent": '), F.when(k % 3 == 0, F.concat(F.lit("["), q(who), F.lit(', "Old Friend"]'))).otherwise(q(who)),
        F.lit(', "patient": '), F.when(k % 5 == 0, "null").otherwise(q(F.col("patient"))), F.when(k % 7 == 0, ', "instrument": "Key 1", "recipient": "u9"').otherwise(""), F.when(k % 11 == 0, ', "source": "Pier 1", "destination": "Den 2"').otherwise(""), F.lit(', "location": "Loc. '), (F.col("event_id") % 7).cast("string"), F.lit('", "time": {"start": '), q(at("t_start")),
        F.when(k % 2 == 0, F.concat(F.lit(', "end": '), q(at("t_end")))).otherwise(""), F.lit('}, "requires_focus": '), F.when(k % 4 == 0, "true").otherwise("false"), F.lit(', "is_significant": '), F.when(F.col("value") > 100, "true").otherwise("false"),
        F.lit(', "story_fragment": "said\\n'), F.col("type"), F.lit(' \\"loud\\""}'),
    )
    told = e.groupBy("story_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", event.alias("j")))).alias("events"))
    who = q(F.concat(F.lit("U-"), F.col("user_id").cast("string")))
    json = F.concat(
        F.lit('{"title": "day", "entities": {"characters": [{"id": '), who, F.lit('}], "objects": [{"id": "o1", "type": "Rock Solid"}, {"id": "o1", "type": "Rock Solid"}], "locations": [{"id": "Loc. 1", "type": "Cave"}]}, "events": ['), F.array_join(F.transform("events", lambda x: x["j"]), ", "),
        F.lit('], "fluents": [{"id": "afraid('), F.concat(F.lit("U-"), F.col("user_id").cast("string")), F.lit(')", "time_start": "T0"}, {"id": "not(open(a,b))"}], "traits": [{"character": '), who, F.lit(', "trait": "Deaf"}], "relationships": [{"type": "enemy", "from": '), who,
        F.lit(', "to": "u9"}], "causal_chains": [{"cause_event": "E 1", "effect_event": "E 2"}], "rules": [{"type": "precondition", "head": "eat(A,B)", "body": ["not(stale(B))", "two(A,B)", "owned(C)"]}'), F.when(F.col("user_id") % 3 == 0, ', {"type": "precondition", "head": "lock(A,B)", "body": ["shut(B)"]}').otherwise(""),
        F.lit('], "emotional_states": [{"character": '), who, F.lit(', "emotion": "Joy", "time": {"start": "T0"}, "story_fragment": "said \\"hi\\""}], "constraints": [{"type": "distance", "location1": "Loc. 2", "location2": "Loc. 6"}], "location_graph": [{"from": "Loc. 1", "to": "Loc. 5", "relation": "distant"}, {"from": "x", "to": "y", "relation": "odd"}]}'),
    )
    return told.select(F.concat_ws("/", "story_id", F.col("user_id").cast("string")).alias("story_id"), json.alias("json"))


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.story_defaults(parse_stories(story_json(spark, sf_dir), "story_id", "json"))


def _of(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_stories(spark, sf_dir))


def _default_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the default effects bring about among the narrated events, possession included."""
    facts = events_as_story(spark, sf_dir)
    facts.tables["effects"] = everywhere(small(spark, [*K.EFFECTS, *K.DOMAIN_EFFECTS], "type", "polarity", "prop", "role"))
    both = fluents.effects(facts, "pos").withColumn("polarity", F.lit("pos")).unionByName(fluents.effects(facts, "neg").withColumn("polarity", F.lit("neg")))
    return both.where("pred = 'has'").select("story_id", "polarity", "pred", "arg", "t")


def queries() -> dict[str, Query]:
    ev, points = structured.events, lambda s: structured.time_points_ranked(structured.events(s))
    role = lambda s, r: structured.event_role(s).where(F.col("role") == r).select("story_id", "event_id", "arg")
    return {
        "fact_event": _of(lambda s: ev(s).select("story_id", "event_id", "type")), "fact_agent": _of(lambda s: role(s, "agent")), "fact_patient": _of(lambda s: role(s, "patient")),
        "fact_event_location": _of(lambda s: ev(s).where("location is not null").select("story_id", "event_id", "location")), "fact_time": _of(lambda s: ev(s).select("story_id", "event_id", "t_start", "t_end")),
        "fact_requires_focus": _of(lambda s: ev(s).where("requires_focus").select("story_id", "event_id")), "fact_story_fragment": _of(lambda s: ev(s).select("story_id", "event_id", "fragment")),
        "time_points_ranked": _of(points), "fact_time_order": _of(lambda s: structured.time_order(points(s))), "fact_character": _of(lambda s: structured.entities(s, "characters").select("story_id", "id")),
        "fact_object_type": _of(lambda s: structured.entities(s, "objects").select("story_id", "id", "obj_type")), "fact_fluent": _of(lambda s: structured.fluents(s).drop("args")), "fact_relationship": _of(structured.relationships),
        "relationship_inference": _of(lambda s: structured.relationship_inference(structured.relationships(s))), "fact_trait": _of(structured.traits), "fact_rule": _of(structured.rules), "fact_causal_chain": _of(structured.causal_chain),
        "fact_location_graph": _of(structured.location_graph), "initial_event": _of(lambda s: ev(s).where("pos = 0").select("story_id", "event_id")), "significant_event": _of(lambda s: ev(s).where("is_significant").select("story_id", "event_id")),
        "domain_emotions": _of(lambda s: structured.domain_emotions(structured.fluents(s), ["afraid"])), "domain_entities": _of(lambda s: structured.entities(s, "characters").select("id").distinct()),
        "fact_object": _of(lambda s: structured.entities(s, "objects").select("story_id", "id")), "fact_location": _of(lambda s: structured.entities(s, "locations").select("story_id", "id")), "fact_location_type": _of(structured.location_types),
        "fact_emotional_state": _of(structured.emotional_states), "fact_emotional_quote": _of(structured.emotional_quotes), "fact_source": _of(lambda s: role(s, "source")), "fact_destination": _of(lambda s: role(s, "destination")), "fact_instrument": _of(lambda s: role(s, "instrument")), "fact_recipient": _of(lambda s: role(s, "recipient")),
        "domain_relationships": _of(structured.domain_relationships), "domain_distance": _of(structured.domain_distance), "domain_rules": _of(lambda s: structured.rules(s).select("type", "polarity", "prop", "role").distinct()),
        "default_effects": lambda spark, sf_dir: _default_effects(spark, sf_dir), "domain_union": _of(lambda s: structured.domain_union(s, s.sparkSession.sql("SELECT 'decorative' AS kind, 'Old Vase' AS id"))),
        "reference_validation": _of(lambda s: structured.validate(s).groupBy("story_id", "problem").agg(F.count("*").alias("n"))), "story_defaults": _of(lambda s: s.select("story_id", F.size("relationships").alias("relationships"), F.size("character_relations").alias("character_relations"))),
        "scoped_precondition": _of(lambda s: rules.precondition_not_met(structured.load(s), "base").where("detail = 'shut'").select("story_id", "subject", "detail")), "scoped_distance": _of(lambda s: structured.load(s).location_graph),
        "structured_physical_impossibility": _of(lambda s: rules.physical_impossibility(structured.load(s), "general").select("story_id", "subject", "detail")),
        "structured_non_edible_food": _of(lambda s: rules.non_edible_food(structured.load(s), "base").select("story_id", "subject")),
    }


def oracle_sql() -> dict[str, str]:
    f = facts_sql().rstrip() + f""", s AS (SELECT story_id || '/' || user_id AS story_id, 'e_' || event_id AS event_id, event_id AS n, type, k, value, patient, 'u_' || user_id AS who, 'loc__' || (event_id % 7) AS location,
  't_' || (t_start // {MINUTE}) AS t_start, CASE WHEN k % 2 = 0 THEN 't_' || (t_end // {MINUTE}) ELSE 't_' || (t_start // {MINUTE}) END AS t_end FROM e),
tp AS (SELECT story_id, t, row_number() OVER (PARTITION BY story_id ORDER BY min(n * 2 + side)) AS t_ord FROM (SELECT story_id, t_start AS t, n, 0 AS side FROM s UNION ALL SELECT story_id, t_end, n, 1 FROM s) GROUP BY story_id, t),
st AS (SELECT DISTINCT story_id, who FROM s) """  # noqa: S608
    return {k: f + v for k, v in {
        "fact_event": "SELECT story_id, event_id, type FROM s", "fact_agent": "SELECT story_id, event_id, who AS arg FROM s UNION ALL SELECT story_id, event_id, 'old_friend' FROM s WHERE k % 3 = 0",
        "fact_patient": "SELECT story_id, event_id, patient AS arg FROM s WHERE k % 5 <> 0", "fact_event_location": "SELECT story_id, event_id, location FROM s", "fact_time": "SELECT story_id, event_id, t_start, t_end FROM s",
        "fact_requires_focus": "SELECT story_id, event_id FROM s WHERE k % 4 = 0", "fact_story_fragment": "SELECT story_id, event_id, 'said ' || type || ' ' || chr(92) || '\"loud' || chr(92) || '\"' AS fragment FROM s",
        "time_points_ranked": "SELECT story_id, t, t_ord FROM tp", "fact_time_order": "SELECT a.story_id, a.t AS t1, b.t AS t2 FROM tp a JOIN tp b ON a.story_id = b.story_id AND b.t_ord = a.t_ord + 1",
        "fact_character": "SELECT story_id, who AS id FROM st", "fact_object_type": "SELECT story_id, 'o1' AS id, 'rock_solid' AS obj_type FROM st",
        "fact_fluent": "SELECT story_id, 'afraid' AS pred, who AS arg, 't0' AS t_start, 't_unknown' AS t_end, FALSE AS negated FROM st UNION ALL SELECT story_id, 'open', NULL, 't_unknown', 't_unknown', TRUE FROM st",
        "fact_relationship": "SELECT story_id, 'enemy' AS rel, who AS src, 'u9' AS dst FROM st", "relationship_inference": "SELECT story_id, 'hates' AS rel, who AS src, 'u9' AS dst FROM st",
        "fact_trait": "SELECT story_id, who AS character, 'deaf' AS trait FROM st", "fact_rule": "SELECT story_id, 'precondition' AS kind, 'eat' AS type, 'neg' AS polarity, 'stale' AS prop, 'patient' AS role FROM st UNION ALL SELECT story_id, 'precondition', 'eat', 'pos', 'owned', 'unknown' FROM st UNION ALL SELECT story_id, 'precondition', 'lock', 'pos', 'shut', 'patient' FROM st WHERE CAST(substr(who, 3) AS INTEGER) % 3 = 0",
        "fact_causal_chain": "SELECT story_id, 'e_1' AS cause, 'e_2' AS effect FROM st", "fact_location_graph": "SELECT story_id, 'distant' AS relation, 'loc__1' AS src, 'loc__5' AS dst FROM st",
        "initial_event": "SELECT story_id, event_id FROM s QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY n) = 1", "significant_event": "SELECT story_id, event_id FROM s WHERE value > 100",
        "domain_emotions": "SELECT story_id, who AS character, 'afraid' AS emotion, 't0' AS t FROM st", "domain_entities": "SELECT DISTINCT who AS id FROM st",
        "fact_object": "SELECT story_id, 'o1' AS id FROM st", "fact_location": "SELECT story_id, 'loc__1' AS id FROM st", "fact_location_type": "SELECT story_id, 'loc__1' AS location, 'cave' AS kind FROM st",
        "fact_emotional_state": "SELECT story_id, who AS character, 'joy' AS emotion, 't0' AS t FROM st", "fact_emotional_quote": "SELECT story_id, who AS character, 'joy' AS emotion, 'said ' || chr(92) || '\"hi' || chr(92) || '\"' AS fragment FROM st",
        "fact_source": "SELECT story_id, event_id, 'pier_1' AS arg FROM s WHERE k % 11 = 0", "fact_destination": "SELECT story_id, event_id, 'den_2' AS arg FROM s WHERE k % 11 = 0",
        "fact_instrument": "SELECT story_id, event_id, 'key_1' AS arg FROM s WHERE k % 7 = 0", "fact_recipient": "SELECT story_id, event_id, 'u9' AS arg FROM s WHERE k % 7 = 0",
        "domain_relationships": "SELECT DISTINCT 'enemy' AS rel, who AS src, 'u9' AS dst FROM st", "domain_distance": "SELECT story_id, 'loc__2' AS src, 'loc__6' AS dst FROM st UNION ALL SELECT story_id, 'loc__6', 'loc__2' FROM st",
        "domain_rules": "SELECT DISTINCT * FROM (SELECT 'eat' AS type, 'neg' AS polarity, 'stale' AS prop, 'patient' AS role FROM st UNION SELECT 'eat', 'pos', 'owned', 'unknown' FROM st UNION SELECT 'lock', 'pos', 'shut', 'patient' FROM st WHERE CAST(substr(who, 3) AS INTEGER) % 3 = 0)",
        "default_effects": "SELECT DISTINCT story_id, CASE type WHEN 'take' THEN 'pos' ELSE 'neg' END AS polarity, 'has' AS pred, agent AS arg, t_end AS t FROM e WHERE type IN ('take', 'give') UNION SELECT story_id, 'pos', 'has', patient, t_end FROM e WHERE type = 'give'",
        "domain_union": "SELECT 'distant' AS kind, 'loc__2' AS a, 'loc__6' AS b, NULL AS c UNION SELECT 'distant', 'loc__6', 'loc__2', NULL UNION SELECT 'relationship', 'enemy', who, 'u9' FROM st UNION SELECT 'significant_event', event_id, NULL, NULL FROM s WHERE value > 100 "
        "UNION SELECT 'initial_event', min_by(event_id, n), NULL, NULL FROM s GROUP BY story_id UNION SELECT 'decorative', 'old_vase', NULL, NULL UNION SELECT 'precondition', 'eat', 'neg', 'stale' UNION SELECT 'precondition', 'eat', 'pos', 'owned' UNION SELECT 'precondition', 'lock', 'pos', 'shut' "
        + "".join(f"UNION SELECT 'effect', '{t}', '{p}', '{x}' " for t, p, x, _ in (*K.EFFECTS, *K.DOMAIN_EFFECTS)),
        "reference_validation": "SELECT story_id, problem, count(*) AS n FROM (SELECT story_id, 'duplicate_id' AS problem, 'o1' AS ref FROM st UNION SELECT story_id, 'malformed_id', x FROM st, (VALUES ('U'), ('Loc')) v(x) UNION SELECT story_id, 'malformed_event_id', event_id FROM s UNION SELECT story_id, 'malformed_time', t FROM tp UNION SELECT story_id, 'malformed_time', 'T0' FROM st "
        "UNION SELECT story_id, 'missing_reference', location FROM s WHERE location <> 'loc__1' UNION SELECT story_id, 'missing_reference', 'old_friend' FROM s WHERE k % 3 = 0 UNION SELECT story_id, 'missing_reference', patient FROM s WHERE k % 5 <> 0 AND patient <> 'o1') GROUP BY ALL",
        "story_defaults": "SELECT story_id, 1 AS relationships, 0 AS character_relations FROM st",
        "scoped_precondition": "SELECT DISTINCT story_id, event_id AS subject, 'shut' AS detail FROM s WHERE type = 'lock' AND k % 5 <> 0 AND CAST(split_part(story_id, '/', 2) AS INTEGER) % 3 = 0",
        "scoped_distance": "SELECT story_id AS scope, 'distant' AS relation, src, dst FROM st, (VALUES ('loc__1', 'loc__5'), ('loc__2', 'loc__6'), ('loc__6', 'loc__2')) v(src, dst)",
        "structured_physical_impossibility": "SELECT DISTINCT story_id, event_id AS subject, 'deaf' AS detail FROM s WHERE type IN ('hear', 'listen', 'eavesdrop')",
        "structured_non_edible_food": "SELECT DISTINCT story_id, event_id AS subject FROM s WHERE type = 'eat' AND k % 5 <> 0 AND patient <> 'o1'",
    }.items()}
