"""Goldens of the rules on small stories, and the closed form of what holds against a naive fixpoint."""

import json
import random

import pytest

from fableguard.operators import documented, fluents, partial_order, rules, structured, timeline
from fableguard.plans.facts import Facts
from fableguard.sources.stories import parse_stories


def story(spark, **sections):
    docs = spark.createDataFrame([("s", json.dumps(sections))], "story_id string, json string")
    return structured.load(parse_stories(docs, "story_id", "json"))


def event(i, kind, agent, start, end=None, **more):
    return {"id": i, "type": kind, "agent": agent, "time": {"start": start, "end": end or start}, **more}


def found(df):
    return sorted((r["type"], r["subject"], r["detail"]) for r in df.collect())


#: Three people: one who can't see reads and dies, one hurts whom she loves while she is elsewhere, one sleeps and wakes.
HARBOUR = {
    "entities": {
        "characters": [{"id": "mara"}, {"id": "joss"}, {"id": "tilde"}],
        "objects": [{"id": "lamp", "type": "glass"}, {"id": "rope", "type": "tool"}],
        "locations": [{"id": "pier"}, {"id": "attic"}, {"id": "loft"}],
    },
    "events": [
        event("e1", "sleep", "joss", "t1", "t2", location="loft"),
        event("e2", "read", "tilde", "t1", "t3", location="pier"),
        event("e3", "wake", "joss", "t2", "t4", location="loft"),
        event("e4", "attack", "mara", "t3", "t5", patient="tilde", instrument="rope", location="pier"),
        event("e5", "whistle", "mara", "t4", "t6", location="attic"),
        event("e6", "die", "tilde", "t5", "t6"),
        event("e7", "sing", "tilde", "t7", "t8", location="loft"),
        event("e8", "wake", "mara", "t8"),
    ],
    "fluents": [{"id": "wet(mara)", "time": {"start": "t3", "end": "t5"}}],
    "traits": [{"character": "tilde", "trait": "blind"}],
    "relationships": [{"type": "loves", "from": "mara", "to": "tilde"}],
}


def test_harbour(spark):
    facts = story(spark, **HARBOUR)
    base = [("dead_agent", "e7", None), ("physical_impossibility", "e2", None), ("precondition_not_met", "e8", "asleep"), ("ubiquity", "e4", "e5"), ("ubiquity", "e5", "e4")]
    assert found(rules.check(facts, "base")) == base
    general = [("chekhov_gun", "lamp", "lamp"), ("dead_agent", "e7", "tilde"), ("effect_without_cause", "fluent(wet,mara)", "t3"), ("harm_loved", "e4", "tilde")]
    general += [("physical_impossibility", "e2", "blind"), ("ubiquity", "e4", "e5")]
    assert found(rules.check(facts, "general")) == general
    pairs = lambda df: sorted((r["e1"][1], r["e2"][1]) for r in df.collect())
    one_way = ["12", "13", "23", "24", "34", "35", "45", "46", "56", "78"]
    assert pairs(timeline.overlap(facts)) == sorted([(a, b) for a, b in one_way] + [(b, a) for a, b in one_way])
    after = {"1": "45678", "2": "5678", "3": "678", "4": "78", "5": "78", "6": "78"}
    assert pairs(timeline.precedes(facts)) == sorted((a, b) for a, bs in after.items() for b in bs)
    assert pairs(timeline.meets(facts)) == [("1", "3"), ("2", "4"), ("3", "5"), ("4", "6"), ("7", "8")]
    holds = lambda r, pred: sorted(x["t"] for x in fluents.holds_at(facts, r).where(f"pred = '{pred}'").collect())
    assert holds("base", "asleep") == ["t2", "t3"]
    assert holds("general", "asleep") == ["t2", "t3", "t5", "t6", "t7", "t8"]
    assert holds("base", "wet") == holds("general", "wet") == ["t3", "t4", "t5", "t6", "t7", "t8"]


def test_rules_and_distances_stay_in_their_story(spark):
    plain = HARBOUR | {"events": [event("e1", "sing", "mara", "t1", location="pier"), event("e2", "rest", "mara", "t1", location="attic")]}
    far = HARBOUR | {"rules": [{"type": "precondition", "head": "sing(X)", "body": ["ready(X)"]}], "location_graph": [{"relation": "distant", "from": "attic", "to": "pier"}]}
    docs = spark.createDataFrame([("a", json.dumps(far)), ("b", json.dumps(plain))], "story_id string, json string")
    both = structured.load(parse_stories(docs, "story_id", "json"))
    asked = rules.check(both, "base", ["precondition_not_met"]).collect()
    assert {(r["story_id"], r["subject"]) for r in asked} == {("a", "e7"), ("a", "e8")}
    assert rules.impossible_travel(both, "general").collect() == []


def test_stated_places(spark):
    """Places of fluents with two arguments, looked up as of an event's start; a later statement replaces an earlier one."""
    events = [event("e1", "rest", "mara", "t1", location="pier"), event("e2", "rest", "mara", "t2", "t3"), event("e3", "rest", "mara", "t4", location="loft")]
    stated = [{"id": "at(mara, attic)", "time": {"start": "t2", "end": "t3"}}, {"name": "at", "args": ["mara", "Loft"], "time": {"start": "t3", "end": "t4"}}]
    facts = story(spark, entities=HARBOUR["entities"], events=[*events, event("e4", "rest", "mara", "t3", location="pier")], fluents=stated)
    got = sorted((r["event_id"], r["location"]) for r in documented.at_during(facts).collect())
    assert got == [("e1", "pier"), ("e2", "attic"), ("e3", "loft"), ("e4", "loft"), ("e4", "pier")]
    assert found(documented.ubiquity(facts)) == [("ubiquity", "e2", "e4"), ("ubiquity", "e4", "e4")]


def test_documented(spark):
    events = [event("e1", "take", "ann", "t1", patient="cup"), event("e2", "give", "ann", "t2", patient="cup", recipient="bo"), event("e3", "drop", "ann", "t3", patient="cup"), event("e4", "drop", "bo", "t4", patient="cup")]
    events += [event("e5", "cut", "bo", "t5", instrument="saw"), event("e6", "die", "bo", "t6"), event("e7", "walk", "bo", "t6"), event("e8", "enter", "ann", "t7", destination="den"), event("e9", "die", "cy", "t6"), event("e10", "walk", "cy", "t8")]
    places = {"characters": [{"id": "ann"}], "objects": [{"id": "cup"}], "locations": [{"id": "den", "type": "cave"}]}
    facts = story(spark, entities=places, events=events, traits=[{"character": "ann", "trait": "claustrophobic"}, {"character": "cy", "trait": "ghost"}])
    got = found(documented.check(facts))
    assert got == [("claustrophobia", "e8", None), ("dead_agent", "e7", "bo"), ("possession", "e3", "cup"), ("possession", "e5", "saw")]


def test_validation(spark):
    docs = spark.createDataFrame([("s", json.dumps({"entities": {"characters": [{"id": "ann"}, {"id": "ann"}, {"id": "Bo"}]}, "events": [event("x1", "go", "ann", "t5", "t2", patient="door"), event("e2", "go", "ann", "noon")]}))], "story_id string, json string")
    got = {(r["problem"], r["ref"]) for r in structured.validate(parse_stories(docs, "story_id", "json")).collect()}
    assert got == {("duplicate_id", "ann"), ("malformed_id", "Bo"), ("malformed_event_id", "x1"), ("malformed_time", "noon"), ("missing_reference", "door"), ("ends_before_start", "x1")}


def test_demand_is_a_part_of_the_whole_answer(spark):
    """What holds at the points asked for is the same whether or not it is asked for, with and without starts and ends."""
    rng = random.Random(12)
    events, roles, stated = [], [], []
    for s in range(20):
        for k in range(8):
            t = rng.randrange(12)
            events.append((f"s{s}", k, rng.choice(["open", "close", "wait"]), None, t, t, t, t, False))
            roles.append((f"s{s}", k, "patient", rng.choice(["door", "gate"])))
        low = rng.choice([None, *range(12)])
        high = rng.choice([None, *range(low or 0, 12)])
        stated.append((f"s{s}", "open", "door", -1 if low is None else low, -2 if high is None else high, low, high))
    ev = spark.createDataFrame(events, "story_id string, event_id long, type string, location string, t_start long, t_end long, start_ord long, end_ord long, requires_focus boolean")
    fl = spark.createDataFrame(stated, "story_id string, pred string, arg string, t_start long, t_end long, start_ord long, end_ord long")
    facts = Facts(spark, ev, spark.createDataFrame(roles, "story_id string, event_id long, role string, arg string"), tables={"fluents": fl})
    points = timeline.time_points(facts).where("t_ord is not null and t % 3 = 0")
    demand = points.crossJoin(spark.sql("SELECT 'open' AS pred, explode(array('door', 'gate')) AS arg")).select("story_id", "pred", "arg", "t", "t_ord")
    for ruleset in ("base", "general", "inertial"):
        whole = {tuple(r) for r in fluents.holds_at(facts, ruleset).select("story_id", "pred", "arg", "t").collect()}
        part = {tuple(r) for r in fluents.holds_at(facts, ruleset, demand).select("story_id", "pred", "arg", "t").collect()}
        asked = {tuple(r) for r in demand.select("story_id", "pred", "arg", "t").collect()}
        assert part == whole & asked, ruleset


def test_edges(spark):
    both = [event("e2", "talk", ["a", "b"], "t1", "t2", location="x"), event("e10", "talk", ["a", "b"], "t2", "t3", location="y")]
    assert found(rules.ubiquity(story(spark, events=both), "general")) == [("ubiquity", "e10", "e2")]
    same = [event("e1", "die", "a", "t1"), event("e2", "walk", "a", "t1"), event("e3", "walk", "a", "t2")]
    assert found(rules.dead_agent(story(spark, events=same), "general")) == [("dead_agent", "e3", "a")]
    nothing = story(spark, events=[])
    assert rules.check(nothing, "general").collect() == []
    edges = spark.createDataFrame([("s", "t1", "t2"), ("s", "t2", "t1")], "story_id string, t1 string, t2 string")
    assert sorted((r["t1"], r["t2"]) for r in partial_order.circular(edges).collect()) == [("t1", "t1"), ("t1", "t2"), ("t2", "t1"), ("t2", "t2")]


def naive(base, seeds, negs, times):
    """seeds and negs by time; what holds at which time, step by step."""
    on, off = set(seeds), set(negs)
    if base:
        off |= {t for t in times for x in negs if x < t}
    while True:
        new = {t for t in times for x in on if x < t and t not in off} - on
        if not new:
            return on
        on |= new


@pytest.mark.parametrize("ruleset", ["base", "general"])
def test_closed_form(spark, ruleset):
    rng, want, events, roles = random.Random(4), {}, [], []
    for s in range(25):
        times = list(range(8))
        acts = [(rng.choice(["open", "close"]), rng.choice(times)) for _ in range(rng.randint(1, 4))]
        acts += [("wait", t) for t in times]
        for k, (kind, t) in enumerate(acts):
            events.append((f"s{s}", k, kind, None, t, t, t, t, False))
            roles.append((f"s{s}", k, "patient", "door"))
        got = naive(ruleset == "base", [t for kind, t in acts if kind == "open"], [t for kind, t in acts if kind == "close"], times)
        want[f"s{s}"] = sorted(got)
    ev = spark.createDataFrame(events, "story_id string, event_id long, type string, location string, t_start long, t_end long, start_ord long, end_ord long, requires_focus boolean")
    facts = Facts(spark, ev, spark.createDataFrame(roles, "story_id string, event_id long, role string, arg string"))
    got = {}
    for r in fluents.holds_at(facts, ruleset).collect():
        got.setdefault(r["story_id"], []).append(r["t"])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
