"""The dyadic interval index, and the fact store, against brute force and the plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from fableguard.operators import documented, fluents, rules, timeline
from fableguard.plans.facts import Facts
from fableguard.plans.store import PASSES, FactStore

INTERVALS = "story_id string, event_id long, start_ord long, end_ord long, t_start long, t_end long"


def intervals(spark, n=60):
    """Short, long, reversed, negative, open and unranked intervals; some rows come twice."""
    rng, rows = random.Random(5), []
    for k in range(n):
        low = rng.choice([None, rng.randint(-50, 300), rng.randint(-50, 300), rng.randint(0, 20)])
        high = None if rng.random() < 0.1 else (low or 0) + rng.choice([0, 1, 5, 40, -3, 400])
        rows.append((rng.choice(["a", "a", "b"]), k, low, high, k, k))
    return rows + rows[:3], spark.createDataFrame(rows + rows[:3], INTERVALS)


@pytest.mark.parametrize("bucket", [1, 7, 64])
def test_dyadic_index(spark, bucket):
    rows, df = intervals(spark)
    before = lambda x, y: x is not None and y is not None and x < y
    both = [(a, b) for a in rows for b in rows if a[0] == b[0]]
    meet = [(a[1], b[1]) for a, b in both if not before(a[3], b[2]) and not before(b[3], a[2])]
    ordered = [(a[1], b[1]) for a, b in both if before(a[3], b[2])]
    named = lambda out: sorted((r["a_event_id"], r["b_event_id"]) for r in out.collect())
    assert named(timeline.together(df, ["story_id"], bucket)) == sorted(meet)
    assert named(timeline.in_order(df, ["story_id"], bucket)) == sorted(ordered)
    points = [("a", 5, 5), ("a", 6, None), ("b", 7, 250), ("b", 8, -40), ("c", 9, 1)]
    facts = Facts(spark, df, df, bucket, {"fluents": df.select("story_id", F.lit("p").alias("pred"), F.col("event_id").cast("string").alias("arg"), "start_ord", "end_ord")})
    got = fluents.holds_at_interval(facts, spark.createDataFrame(points, "story_id string, t long, t_ord long")).collect()
    want = {(s, str(i), t) for s, t, o in points for r, i, low, high, *_ in rows if r == s and not before(o, low) and not before(high, o)}
    assert {(r["story_id"], r["arg"], r["t"]) for r in got} == want


def test_a_long_interval_costs_logarithmically_many_rows(spark):
    row = spark.range(1).selectExpr("3L first", "1000000L last", "20 top").select(F.size(timeline.cover("first", "last", "top")).alias("n"))
    assert row.first()["n"] <= 2 * 20
    assert spark.range(1).selectExpr("77L c", "20 top").select(F.size(timeline.ancestors("c", "top")).alias("n")).first()["n"] == 21


def test_a_cover_is_made_of_the_cells(spark):
    rng = random.Random(3)
    rows = [(low := rng.randint(-100, 100), low + rng.randint(0, 90), 9) for _ in range(200)]
    for r in spark.createDataFrame(rows, "low long, high long, top int").withColumn("n", timeline.cover("low", "high", "top")).collect():
        cells = [c for level, node in r["n"] for c in range(node << level, (node + 1) << level)]
        assert sorted(cells) == list(range(r["low"], r["high"] + 1))


def random_facts(spark, seed=2):
    """Some stories with everything that the passes of a store ask; nulls among them."""
    rng = random.Random(seed)
    stories, who, things, places = ["s1", "s2", "s3"], ["ann", "bo", "cy"], ["axe", "pie", "cup"], ["hut", "sea", "cave", None]
    verbs = ["eat", "kill", "murder", "die", "visit", "help", "trust", "see", "read", "speak", "enter", "swim", "consume", "natural", "celebrate", "open", "sleep"]
    pick, event_rows, roles = rng.choice, [], []
    for s in stories:
        for k in range(40):
            t = rng.randint(0, 60)
            end = pick([t, t + 2, t + 9, t - 1])
            ranked = rng.random() < 0.9
            for place in [pick(places)] if rng.random() < 0.8 else ["hut", "cave"]:
                event_rows.append((s, k, pick(verbs) if place != "cave" else "visit", place, t, end, t if ranked else None, end if ranked else None, rng.random() < 0.5))
            roles += [(s, k, "agent", a) for a in rng.sample(who, rng.randint(0, 2))] + [(s, k, "patient", p) for p in rng.sample(who + things, rng.randint(0, 2))]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    some = lambda p: [(s, k) for s in stories for k in range(40) if rng.random() < p]
    ids = lambda pool, p: [(s, x) for s in stories for x in pool if rng.random() < p]
    tables = {
        "characters": make([(s, w) for s in stories for w in who[:2]], "story_id string, id string"),
        "objects": make([(s, x, pick(["rock", "food", "tool", None])) for s in stories for x in [*things, "urn"]], "story_id string, id string, obj_type string"),
        "traits": make([(s, pick(who), pick(["blind", "mute", "claustrophobia", "acrophobic", "aquaphobic"])) for s in stories for _ in range(4)], "story_id string, character string, trait string"),
        "relationships": make([(s, pick(["loves", "hates", "fears", "distrusts"]), pick(who), pick(who)) for s in stories for _ in range(20)], "story_id string, rel string, src string, dst string"),
        "emotional_states": make([(s, w, pick(["happy", "sad", "calm"]), t, t) for s in stories for t in range(60) for w in who], "story_id string, character string, emotion string, t long, t_ord long"),
        "fluents": make([(s, "open", pick(["pie", None]), t, t + 3, t, t + 3) for s in stories for t in range(0, 20, 3)], "story_id string, pred string, arg string, t_start long, t_end long, start_ord long, end_ord long"),
        "initial_state": make([("s1", "open", None)], "story_id string, pred string, arg string"),
        "causal_chain": make([(s, 0, k) for s, k in some(0.3)], "story_id string, cause long, effect long"),
        "must_precede": make([(s, k, rng.randint(0, 39)) for s, k in some(0.2)], "story_id string, e1 long, e2 long"),
        "trust_earned": make([(s, pick(who), k) for s, k in some(0.4)], "story_id string, dst string, event_id long"),
        "location_graph": make([("*", "distant", "hut", "sea"), ("s1", "distant", "sea", "hut")], "scope string, relation string, src string, dst string"),
    }
    for hook in ("significant_event", "initial_event", "background_event", "justified_harm", "strategic_help", "forced_approach", "brave_moment", "allows_remote"):
        tables[hook] = make(some(0.4), "story_id string, event_id long")
    for hook in ("decorative", "prominently_introduced", "edible_tool"):
        tables[hook] = make(ids([*things, "urn"], 0.4), "story_id string, id string")
    ev = make(event_rows, "story_id string, event_id long, type string, location string, t_start long, t_end long, start_ord long, end_ord long, requires_focus boolean")
    return Facts(spark, ev, make(roles, "story_id string, event_id long, role string, arg string"), 8, tables)


@pytest.mark.parametrize("most", [10**6, 45])
def test_store_finds_what_the_rules_find(spark, most):
    """Every ruleset, over buckets and, where stories are too large for one, through the plain rules; with a user's rule."""
    facts = random_facts(spark)
    store = FactStore.write(facts, 3, most)
    assert (store.large is not None) == (most == 45)
    own = {"self_talk": documented.self_talk}
    for ruleset in ("base", "general", "narrative", "v2") if most > 45 else ("general",):
        want = sorted(map(str, rules.check(facts, ruleset, own=own).collect()))
        got = sorted(map(str, store.check(ruleset, own=own).collect()))
        assert len(want) > 30 and got == want, ruleset
        kinds = {r["type"] for r in store.check(ruleset).collect()}
        assert ruleset != "general" or len(kinds) >= 14, kinds
    for f, _ in PASSES:  # within a story all meet in one bucket
        plan = f(store, store.facts(), "general")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, f.__name__
    store.drop()
    assert not spark.sql("show tables").where(F.col("tableName").startswith(store.name)).collect()


def test_own_rules(spark):
    """A user's rule in check, beside those of the ruleset."""
    ev = spark.createDataFrame([("s", 1, "talk", None, 1, 1, 1, 1, False)], "story_id string, event_id long, type string, location string, t_start long, t_end long, start_ord long, end_ord long, requires_focus boolean")
    roles = spark.createDataFrame([("s", 1, "agent", "ann"), ("s", 1, "patient", "ann")], "story_id string, event_id long, role string, arg string")
    facts = rules.once(Facts(spark, ev, roles))
    got = rules.check(facts, "general", own={"self_talk": documented.self_talk}).collect()
    assert facts.events.storageLevel.useMemory
    facts.release()
    assert not facts.events.storageLevel.useMemory
    assert [(r["type"], r["subject"]) for r in got] == [("self_talk", "1")]
