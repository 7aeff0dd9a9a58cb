"""The ruleset ``documented``: rules of possession, places by kind, verbs of focus, and deaths that count at once.

Each takes facts and returns findings like the rules of the other rulesets; ``check`` unites them. They also show how a
user's own rules look (``rules.check(..., own={...})``): dietary, pacifist and self-talk rules are at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fableguard.functions import knowledge as K
from fableguard.operators import fluents, rules, timeline
from fableguard.operators.rules import found
from fableguard.plans.facts import Facts

SET = "documented"


def possession(facts: Facts) -> DataFrame:
    """Dropping or giving what one doesn't have at the event's start, or using it as an instrument; the latest change counts."""
    patient, tool = ("patient", "instrument")
    thing = lambda role: facts.event_role.where(F.col("role") == role).select("story_id", "event_id", F.col("arg").alias("object"))
    acts = facts.acts().select("story_id", "event_id", "type", "agent", F.col("start_ord").alias("t_ord"))
    asked = acts.where(F.col("type").isin(K.LOSING)).join(thing(patient), ["story_id", "event_id"]).unionByName(acts.join(thing(tool), ["story_id", "event_id"])).distinct()
    kind = dict(facts.events.dtypes)["event_id"]
    change = fluents.possession(facts).select("story_id", "agent", "object", "t_ord", "has", F.lit(None).cast(kind).alias("event_id"))
    both = change.unionByName(asked.select("story_id", "agent", "object", "t_ord", F.lit(None).cast("int").alias("has"), "event_id")).where("t_ord is not null")
    # What is gained at the very start of an event is there, what is lost then, by the event itself perhaps, was there.
    turn = F.when(F.col("has") == 1, 0).when(F.col("has").isNull(), 1).otherwise(2)
    order = Window.partitionBy("story_id", "agent", "object").orderBy("t_ord", turn).rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("last", F.last("has", ignorenulls=True).over(order)).where("event_id is not null and coalesce(last, 0) = 0")
    return found(told, SET, "coherence", "possession", F.col("event_id"), F.col("object"))


def dead_agent(facts: Facts) -> DataFrame:
    """Acts at or after one's death, but for the death itself; ghosts are free to act."""
    death = rules.dead_after(facts, "general").groupBy("story_id", F.col("character").alias("agent")).agg(F.min("t_ord").alias("died"))
    late = facts.acts().where("type <> 'die'").join(death, ["story_id", "agent"]).where("died <= start_ord")
    return found(_alive(late, facts), SET, "coherence", "dead_agent", F.col("event_id"), F.col("agent"))


def _alive(acts: DataFrame, facts: Facts) -> DataFrame:
    return acts.join(facts.traits.where("trait = 'ghost'").select("story_id", F.col("character").alias("agent")), ["story_id", "agent"], "left_anti")


def _afraid(facts: Facts, trait: str, kinds: list[str], kind: str, entering: bool = False) -> DataFrame:
    at = facts.events.where("location is not null").select("story_id", "event_id", "location")
    if entering:
        goal = facts.event_role.where("role = 'destination'").select("story_id", "event_id", F.col("arg").alias("location"))
        at = at.unionByName(goal.join(facts.events.where("type = 'enter'").select("story_id", "event_id"), ["story_id", "event_id"]))
    of_kind = facts.location_types.where(F.col("kind").isin(kinds)).select("story_id", "location")
    afraid = facts.traits.where(F.col("trait") == trait).select("story_id", F.col("character").alias("agent"))
    there = at.join(of_kind, ["story_id", "location"], "left_semi")
    hit = facts.acts().select("story_id", "event_id", "agent").join(there, ["story_id", "event_id"]).join(afraid, ["story_id", "agent"], "left_semi")
    return found(hit, SET, "coherence", kind, F.col("event_id"))


def claustrophobia(facts: Facts) -> DataFrame:
    return _afraid(facts, "claustrophobic", K.ENCLOSED_KINDS, "claustrophobia", entering=True)


def acrophobia(facts: Facts) -> DataFrame:
    return _afraid(facts, "acrophobic", K.HIGH_KINDS, "acrophobia")


def aquaphobia(facts: Facts) -> DataFrame:
    return _afraid(facts, "aquaphobic", K.WATER_KINDS, "aquaphobia")


def focus_overlap(facts: Facts) -> DataFrame:
    """Overlapping acts of one character by verbs that need focus, whatever the events say."""
    acts = facts.acts().where(F.col("type").isin(K.FOCUS_VERBS)).select("story_id", "agent", "event_id", "start_ord", "end_ord")
    both = timeline.together_by_agent(acts, ["story_id", "agent"], facts.bucket).where("a_event_id < b_event_id").withColumnRenamed("a_story_id", "story_id")
    return found(both, SET, "coherence", "focus_overlap", F.col("a_event_id"), F.col("b_event_id"))


def stated_places(facts: Facts) -> DataFrame:
    """story_id, agent, place, start_ord, end_ord of fluents ``at(who, where)``, by their argument lists."""
    at = facts.fluents.where("pred = 'at' and size(args) = 2")
    return at.select("story_id", F.col("args")[0].alias("agent"), F.col("args")[1].alias("place"), "start_ord", "end_ord")


def place_at(facts: Facts, asked: DataFrame) -> DataFrame:
    """asked (story_id, agent, t_ord, ...) with the place that is stated for the agent at that point.

    An as-of lookup: of what starts at or before the point the latest counts (several places, if they start together),
    as long as it has not ended. What has no start holds from the beginning, what has no end until the next statement.
    Statements and questions are merged in order of time, so each is read once.
    """
    start = F.coalesce("start_ord", F.lit(timeline.LEAST)).alias("t_ord")
    said = stated_places(facts).groupBy("story_id", "agent", start).agg(F.collect_set(F.struct("place", "end_ord")).alias("said"))
    more = [c for c in asked.columns if c not in ("story_id", "agent", "t_ord")]
    rows = asked.withColumn("asks", F.lit(1)).unionByName(said.withColumn("asks", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("story_id", "agent").orderBy("t_ord", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("latest", F.last("said", ignorenulls=True).over(order)).where("asks = 1 and t_ord is not null")
    told = told.select("story_id", "agent", "t_ord", *more, F.explode("latest").alias("x")).where(~timeline.lt(F.col("x.end_ord"), F.col("t_ord")))
    return told.select("story_id", "agent", "t_ord", *more, "x.place")


def at_during(facts: Facts) -> DataFrame:
    """story_id, entity, location, event_id: where agents are in their events, by the event or by what fluents state at its start."""
    acts = facts.acts()
    told = acts.where("location is not null").select("story_id", F.col("agent").alias("entity"), "location", "event_id")
    asked = acts.select("story_id", "agent", F.col("start_ord").alias("t_ord"), "event_id").distinct()
    stated = place_at(facts, asked).select("story_id", F.col("agent").alias("entity"), F.col("place").alias("location"), "event_id")
    return told.unionByName(stated).distinct()


def ubiquity(facts: Facts) -> DataFrame:
    """Characters in two places at a time, by their events' places or stated ones: in two overlapping acts, or within one."""
    cast = facts.characters.select("story_id", F.col("id").alias("agent")).distinct()
    at = at_during(facts).withColumnRenamed("entity", "agent").join(cast, ["story_id", "agent"], "left_semi")
    when = facts.events.select("story_id", "event_id", "start_ord", "end_ord").distinct()
    both = timeline.together_by_agent(at.join(when, ["story_id", "event_id"]), ["story_id", "agent"], facts.bucket)
    both = both.where("a_location <> b_location and a_event_id <= b_event_id").withColumnRenamed("a_story_id", "story_id")
    return found(both, SET, "location", "ubiquity", F.col("a_event_id"), F.col("b_event_id"))


RULES: dict[str, Callable[[Facts], DataFrame]] = {f.__name__: f for f in (possession, dead_agent, claustrophobia, acrophobia, aquaphobia, focus_overlap, ubiquity)}


def check(facts: Facts) -> DataFrame:
    """All findings of the documented ruleset."""
    facts, out = rules.once(facts), None
    for f in RULES.values():
        out = f(facts) if out is None else out.unionByName(f(facts))
    return out.withColumn("ruleset", F.lit(SET)).distinct()


# --- rules that a user may add


def _own(facts: Facts, kind: str, trait: str, where: Column, patient: DataFrame | None = None) -> DataFrame:
    acts = facts.acts().where(where).join(facts.traits.where(F.col("trait") == trait).select("story_id", F.col("character").alias("agent")), ["story_id", "agent"], "left_semi")
    if patient is not None:
        what = facts.event_role.where("role = 'patient'").select("story_id", "event_id", F.col("arg").alias("id"))
        acts = acts.join(what, ["story_id", "event_id"]).join(patient, ["story_id", "id"], "left_semi")
    return found(acts, SET, "coherence", kind, F.col("event_id"))


def vegetarian(facts: Facts, ruleset: str = SET) -> DataFrame:
    return _own(facts, "dietary", "vegetarian", F.col("type") == "eat", facts.objects.where("obj_type = 'meat'").select("story_id", "id"))


def pacifist(facts: Facts, ruleset: str = SET) -> DataFrame:
    return _own(facts, "pacifist", "pacifist", F.col("type").isin("attack", "kill", "fight"))


def self_talk(facts: Facts, ruleset: str = SET) -> DataFrame:
    """Talking to oneself."""
    own = facts.event_role.where("role = 'patient'").select("story_id", "event_id", F.col("arg").alias("agent"))
    return found(facts.acts().where("type = 'talk'").join(own, ["story_id", "event_id", "agent"]), SET, "coherence", "self_talk", F.col("event_id"))
