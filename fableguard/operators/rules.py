"""The consistency rules. Each takes (facts, ruleset) and returns story_id, category, type, subject, detail, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fableguard.functions import knowledge as K
from fableguard.operators import fluents, partial_order, timeline
from fableguard.operators.timeline import lt
from fableguard.plans.facts import Facts, in_scope, small

Rule = Callable[[Facts, str], DataFrame]
#: name: (rule, the rulesets that have it)
RULES: dict[str, tuple[Rule, tuple[str, ...]]] = {}
LATER = ("general", "narrative", "v2")


def rule(*rulesets: str) -> Callable[[Rule], Rule]:
    def keep(f: Rule) -> Rule:
        RULES[f.__name__] = (f, rulesets or K.RULESETS)
        return f

    return keep


def found(df: DataFrame, ruleset: str, category: str, kind: str, subject: Column, detail: Column | None = None, message: Column | None = None, once: bool = False) -> DataFrame:
    """The findings, each once, as they are if the rows give each ``once``. ``narrative`` has a fixed text, ``v2`` its own message."""
    context = message if ruleset == "v2" and message is not None else F.lit(K.CONTEXT.get(kind)) if ruleset == "narrative" else F.lit(None)
    none = F.lit("none") if ruleset == "v2" else F.lit(None)
    out = df.select("story_id", F.lit(category).alias("category"), F.lit(kind).alias("type"), subject.cast("string").alias("subject"), (none if detail is None else detail).cast("string").alias("detail"), context.cast("string").alias("context"))
    return out if once else out.distinct()


def named(df: DataFrame, facts: Facts, **cols: str) -> DataFrame:
    """df with the names of entities: new column = id column; an id without a name is its own."""
    for out, c in cols.items():
        if facts.has("names"):
            names = facts.names.select("story_id", F.col("id").alias(c), F.col("name").alias(out))
            df = df.join(names, ["story_id", c], "left").withColumn(out, F.coalesce(out, F.col(c).cast("string")))
        else:
            df = df.withColumn(out, F.col(c).cast("string"))
    return df


def _unless(df: DataFrame, facts: Facts, hook: str, on: list[str], how: str = "left_anti") -> DataFrame:
    return df.join(getattr(facts, hook), on, how)


# --- temporal


@rule(*LATER)
def circular_time(facts: Facts, ruleset: str) -> DataFrame:
    """Points of a stated time order that come before each other. Ranked time points alone can't: without an order there is none."""
    if not facts.has("time_order"):
        return found(facts.time_order, ruleset, "temporal", "circular_time", F.col("t1"), F.col("t2"))
    loops = partial_order.circular(facts.time_order)
    message = F.format_string("Circular time ordering: %s < %s < %s", *(F.col(c).cast("string") for c in ("t1", "t2", "t1")))
    return found(loops, ruleset, "temporal", "circular_time", F.col("t1"), F.col("t2"), message)


@rule(*LATER)
def negative_duration(facts: Facts, ruleset: str) -> DataFrame:
    e = facts.events.where(lt(F.col("end_ord"), F.col("start_ord")))
    message = F.format_string("Event '%s' ends before it starts", F.col("event_id").cast("string"))
    return found(e, ruleset, "temporal", "negative_duration", F.col("event_id"), None if ruleset == "v2" else F.col("event_id"), message)


@rule(*LATER)
def explicit_order_violated(facts: Facts, ruleset: str) -> DataFrame:
    """Pairs that must be in order and aren't. Pairs that are told with their times aren't looked up among the events."""
    pairs = facts.must_precede
    if not (told := {"ends", "starts"} <= set(pairs.columns)):
        times = facts.events.select("story_id", "event_id", "start_ord", "end_ord")
        a = times.select("story_id", F.col("event_id").alias("e1"), F.col("end_ord").alias("ends"))
        b = times.select("story_id", F.col("event_id").alias("e2"), F.col("start_ord").alias("starts"))
        pairs = pairs.join(a, ["story_id", "e1"], "left").join(b, ["story_id", "e2"], "left")
    late = pairs.where(~lt(F.col("ends"), F.col("starts")))
    message = F.format_string("Temporal constraint violated: '%s' must precede '%s'", F.col("e1").cast("string"), F.col("e2").cast("string"))
    return found(late, ruleset, "temporal", "order_violated" if ruleset == "v2" else "explicit_order_violated", F.col("e1"), F.col("e2"), message, once=told)


@rule("v2")
def impossible_duration(facts: Facts, ruleset: str) -> DataFrame:
    e = facts.events.withColumn("took", F.col("end_ord") - F.col("start_ord")).join(facts.duration_constraint, "type")
    odd = e.where((F.col("took") < F.col("low")) | (F.col("took") > F.col("high")))
    message = F.format_string("Event '%s' has unrealistic duration: %d (expected %d-%d)", F.col("event_id").cast("string"), "took", "low", "high")
    return found(odd, ruleset, "temporal", "impossible_duration", F.col("event_id"), F.col("took"), message)


# --- location


def at_during(facts: Facts, ruleset: str) -> DataFrame:
    """story_id, entity, location, event_id: agents, and in the later rulesets patients that are characters."""
    placed = facts.events.where("location is not null").select("story_id", "event_id", "location")
    roles = facts.event_role.select("story_id", "event_id", "role", F.col("arg").alias("entity"))
    agents = placed.join(roles.where("role = 'agent'"), ["story_id", "event_id"])
    out = agents.select("story_id", "entity", "location", "event_id")
    if ruleset != "base":
        cast = facts.characters.select("story_id", F.col("id").alias("entity"))
        patients = placed.join(roles.where("role = 'patient'"), ["story_id", "event_id"]).join(cast, ["story_id", "entity"], "left_semi")
        out = out.unionByName(patients.select("story_id", "entity", "location", "event_id"))
    return out.distinct()


def _together(facts: Facts, acts: DataFrame) -> DataFrame:
    acts = acts.select("story_id", "agent", "event_id", "location", "type", "start_ord", "end_ord")
    return timeline.together_by_agent(acts, ["story_id", "agent"], facts.bucket).withColumnsRenamed({"a_story_id": "story_id", "a_agent": "agent"})


@rule()
def ubiquity(facts: Facts, ruleset: str) -> DataFrame:
    both = _together(facts, facts.acts().where("location is not null")).where("a_location <> b_location")
    both = both.where("a_event_id <> b_event_id" if ruleset == "base" else "a_event_id < b_event_id")
    both = named(both, facts, who="agent", at="a_location", other="b_location") if ruleset == "v2" else both.withColumns({c: F.lit("") for c in ("who", "at", "other")})
    return found(both, ruleset, "location", "ubiquity", F.col("a_event_id"), F.col("b_event_id"), F.format_string("Character '%s' simultaneously at '%s' and '%s'", "who", "at", "other"))


@rule(*LATER)
def proximity_required(facts: Facts, ruleset: str) -> DataFrame:
    acts = facts.acts().where("location is not null").join(facts.event_role.where("role = 'patient'").select("story_id", "event_id", F.col("arg").alias("patient")), ["story_id", "event_id"])
    if ruleset == "v2":
        place = facts.object_location.select("story_id", F.col("id").alias("patient"), "event_id", F.col("location").alias("there"))
        acts = _unless(acts, facts, "requires_proximity", ["story_id", "event_id"], "left_semi")
    else:
        place = at_during(facts, ruleset).select("story_id", F.col("entity").alias("patient"), "event_id", F.col("location").alias("there"))
    apart = _unless(acts.join(place, ["story_id", "patient", "event_id"]).where("location <> there"), facts, "allows_remote", ["story_id", "event_id"])
    message = F.format_string("Character '%s' at '%s' interacts with '%s' at '%s'", "agent", "location", "patient", "there")
    return found(apart, ruleset, "location", "proximity_required", F.col("event_id"), F.col("patient"), message)


@rule(*LATER)
def impossible_travel(facts: Facts, ruleset: str) -> DataFrame:
    acts = facts.acts().where("location is not null").select("story_id", "agent", "event_id", "location", "type", "t_start", "t_end", "start_ord", "end_ord")
    if ruleset == "v2":
        need = facts.travel_time.select("scope", F.col("src").alias("a_location"), F.col("dst").alias("b_location"), "min_time")
        near = timeline.soon_after(acts, need.agg(F.max("min_time").alias("most")), ["story_id", "agent"]).where("a_location <> b_location").withColumnsRenamed({"a_story_id": "story_id", "a_agent": "agent"})
        near = near.withColumn("took", F.col("b_start_ord") - F.col("a_end_ord"))
        hasty = named(in_scope(near, need, ["a_location", "b_location"]).where("took < min_time"), facts, who="agent", x="a_location", y="b_location")
        message = F.format_string("Character '%s' travels from '%s' to '%s' in %d time (requires %d)", "who", "x", "y", "took", "min_time")
        return found(hasty, ruleset, "location", "impossible_travel", F.col("a_event_id"), F.col("b_event_id"), message)
    still = acts.where(~F.col("type").isin(K.TRAVEL[ruleset]))
    a = still.select("story_id", "agent", F.col("event_id").alias("e1"), F.col("location").alias("src"), F.col("t_end").alias("t"))
    b = still.select("story_id", "agent", F.col("event_id").alias("e2"), F.col("location").alias("dst"), F.col("t_start").alias("t"))
    far = facts.location_graph.where("relation = 'distant'").select("scope", "src", "dst").distinct()
    both = in_scope(a.join(b, ["story_id", "agent", "t"]).where("e1 <> e2 and src <> dst"), far, ["src", "dst"])
    return found(both, ruleset, "location", "impossible_travel", F.col("e1"), F.col("e2"))


# --- causality


def used(facts: Facts, ruleset: str) -> DataFrame:
    out = fluents.role_arg(facts).select("story_id", F.col("arg").alias("id"))
    return (out.unionByName(facts.mentioned_in_event.select("story_id", "id")) if ruleset == "v2" else out).distinct()


def introduced(facts: Facts, ruleset: str) -> DataFrame:
    out = facts.characters.select("story_id", "id").unionByName(facts.objects.select("story_id", "id"))
    return (out.unionByName(facts.mentioned_object.select("story_id", "id")) if ruleset == "narrative" else out).distinct()


def caused(facts: Facts, ruleset: str) -> DataFrame:
    out = facts.causal_chain.select("story_id", F.col("effect").alias("event_id")).unionByName(facts.initial_event.select("story_id", "event_id"))
    out = out.unionByName(facts.events.where("type = 'natural'").select("story_id", "event_id"))
    return (out.unionByName(facts.background_event.select("story_id", "event_id")) if ruleset == "narrative" else out).distinct()


@rule(*LATER)
def chekhov_gun(facts: Facts, ruleset: str) -> DataFrame:
    idle = facts.objects.select("story_id", "id").distinct().join(used(facts, ruleset), ["story_id", "id"], "left_anti")
    idle = _unless(idle, facts, "decorative", ["story_id", "id"])
    if ruleset == "narrative":
        idle = _unless(idle, facts, "prominently_introduced", ["story_id", "id"], "left_semi")
    idle = named(idle, facts, name="id") if ruleset == "v2" else idle.withColumn("name", F.col("id"))
    message = F.format_string("Object '%s' introduced but never used (Chekhov's gun violation)", "name")
    return found(idle, ruleset, "causality", "chekhovs_gun" if ruleset == "v2" else "chekhov_gun", F.col("id"), None if ruleset == "v2" else F.col("id"), message)


@rule(*LATER)
def uncaused_event(facts: Facts, ruleset: str) -> DataFrame:
    e = facts.events.select("story_id", "event_id").join(facts.significant_event, ["story_id", "event_id"], "left_semi").join(caused(facts, ruleset), ["story_id", "event_id"], "left_anti")
    message = F.format_string("Significant event '%s' lacks causal explanation", F.col("event_id").cast("string"))
    return found(e, ruleset, "causality", "uncaused_event", F.col("event_id"), None if ruleset == "v2" else F.col("event_id"), message)


def fluent_text(pred: str = "pred", arg: str = "arg") -> Column:
    return F.when(F.col(arg).isNull(), F.col(pred)).otherwise(F.concat(F.lit("fluent("), F.col(pred), F.lit(","), F.col(arg), F.lit(")")))


@rule(*LATER)
def effect_without_cause(facts: Facts, ruleset: str) -> DataFrame:
    f = facts.fluents.select("story_id", "pred", "arg", F.col("t_start").alias("t")).distinct()
    alone = f.join(fluents.effects(facts, "pos").select("story_id", "pred", "arg", "t"), ["story_id", "pred", "arg", "t"], "left_anti")
    if ruleset in ("narrative", "v2"):
        alone = alone.alias("a").join(facts.initial_state.alias("i"), F.expr("a.story_id = i.story_id and a.pred = i.pred and a.arg <=> i.arg"), "left_anti")
    message = F.format_string("State '%s' becomes true without causal explanation", fluent_text())
    return found(alone, ruleset, "causality", "effect_without_cause", fluent_text(), F.col("t"), message)


@rule("base", "v2")
def precondition_not_met(facts: Facts, ruleset: str) -> DataFrame:
    asked = fluents.requires(facts, "pos")
    open_ = asked.join(fluents.holds_at(facts, ruleset, asked), ["story_id", "pred", "arg", "t"], "left_anti")
    message = F.format_string("Event '%s' missing required precondition '%s'", F.col("event_id").cast("string"), "pred")
    return found(open_, ruleset, "causality", "missing_precondition" if ruleset == "v2" else "precondition_not_met", F.col("event_id"), F.col("pred"), message)


@rule("base")
def precondition_violated(facts: Facts, ruleset: str) -> DataFrame:
    asked = fluents.requires(facts, "neg")
    hit = asked.join(fluents.holds_at(facts, ruleset, asked), ["story_id", "pred", "arg", "t"], "left_semi")
    return found(hit, ruleset, "causality", "precondition_violated", F.col("event_id"), F.col("pred"))


# --- coherence


def dead_after(facts: Facts, ruleset: str) -> DataFrame:
    """story_id, character, t, t_ord."""
    killing = ["kill", "murder"] if ruleset in ("narrative", "v2") else ["kill"]
    who = facts.acts().where("type = 'die'").withColumn("character", F.col("agent")).drop("agent")
    whom = facts.acts("patient").where(F.col("type").isin(killing)).withColumn("character", F.col("patient")).drop("patient")
    return who.unionByName(whom).select("story_id", "character", F.col("t_end").alias("t"), F.col("end_ord").alias("t_ord")).distinct()


@rule()
def dead_agent(facts: Facts, ruleset: str) -> DataFrame:
    # Ranks are total, so the first death is the one that counts.
    death = dead_after(facts, ruleset).groupBy("story_id", F.col("character").alias("agent")).agg(F.min("t_ord").alias("died"))
    acts = facts.acts()
    if ruleset == "v2":
        acts = acts.join(facts.characters.select("story_id", F.col("id").alias("agent")), ["story_id", "agent"], "left_semi")
    late = acts.join(death, ["story_id", "agent"]).where("died < start_ord")
    late = named(late, facts, name="agent") if ruleset == "v2" else late.withColumn("name", F.col("agent"))
    message = F.format_string("Dead character '%s' performs action: %s", "name", F.col("event_id").cast("string"))
    return found(late, ruleset, "coherence", "dead_agent", F.col("event_id"), None if ruleset == "base" else F.col("agent"), message)


def non_edible(facts: Facts, ruleset: str) -> DataFrame:
    bad = facts.objects.where(F.col("obj_type").isin(K.NON_EDIBLE[ruleset]))
    if ruleset == "narrative":
        bad = bad.where("obj_type <> 'tool'").unionByName(_unless(bad.where("obj_type = 'tool'"), facts, "edible_tool", ["story_id", "id"]).select("story_id", "id", "obj_type"))
    return bad.select("story_id", "id").distinct()


def edible(facts: Facts, ruleset: str) -> DataFrame:
    good = facts.objects.select("story_id", "id").join(non_edible(facts, ruleset), ["story_id", "id"], "left_anti")
    if ruleset == "v2":
        good = _unless(good, facts, "explicitly_inedible", ["story_id", "id"])
    return good.unionByName(facts.objects.where(F.col("obj_type").isin(K.EDIBLE[ruleset])).select("story_id", "id")).distinct()


@rule()
def non_edible_food(facts: Facts, ruleset: str) -> DataFrame:
    meals = facts.acts("patient").where(F.col("type").isin(K.EATING[ruleset])).withColumnRenamed("patient", "id")
    if ruleset == "v2":
        meals = named(meals.join(non_edible(facts, ruleset), ["story_id", "id"], "left_semi"), facts, name="id")
        message = F.format_string("Eating non-edible object '%s': %s", "name", F.col("event_id").cast("string"))
        return found(meals, ruleset, "coherence", "non_edible", F.col("event_id"), F.col("id"), message)
    meals = meals.join(edible(facts, ruleset), ["story_id", "id"], "left_anti")
    out = found(meals, ruleset, "coherence", "non_edible_food", F.col("event_id"), None if ruleset == "base" else F.col("id"))
    if ruleset == "narrative":
        ate = meals.where("type = 'consume'").select("story_id", F.col("event_id").cast("string").alias("subject")).distinct().withColumn("consumed", F.lit(True))
        out = out.join(ate, ["story_id", "subject"], "left").withColumn("context", F.when(F.col("consumed"), "Character attempts to consume something inedible").otherwise(F.col("context"))).select("story_id", "category", "type", "subject", "detail", "context")
    return out


def traits(facts: Facts, ruleset: str) -> DataFrame:
    """story_id, agent, trait; base also knows traits by other names."""
    own = facts.traits.select("story_id", F.col("character").alias("agent"), "trait")
    if ruleset == "base":
        other = F.broadcast(small(facts.spark, list(K.TRAIT_NAMES.items()), "trait", "as_trait"))
        own = own.unionByName(own.join(other, "trait").select("story_id", "agent", F.col("as_trait").alias("trait")))
    return own.distinct()


@rule()
def physical_impossibility(facts: Facts, ruleset: str) -> DataFrame:
    needs = small(facts.spark, [(t, v) for t, verbs in K.NEEDS[ruleset].items() for v in verbs], "trait", "type")
    hit = facts.acts().join(F.broadcast(needs), "type").join(traits(facts, ruleset), ["story_id", "agent", "trait"])
    hit = named(hit, facts, name="agent") if ruleset == "v2" else hit.withColumn("name", F.col("agent"))
    sense = F.when(F.col("trait") == "blind", "sight").when(F.col("trait") == "deaf", "hearing").when(F.col("trait") == "mute", "speech").otherwise("mobility")
    if ruleset == "narrative":
        text = F.concat(F.initcap("trait"), F.lit(" character performs action requiring "), sense)
        return found(hit.withColumn("text", text), "v2", "coherence", "physical_impossibility", F.col("event_id"), F.col("trait"), F.col("text"))
    message = F.format_string("%s character '%s' performs %s-requiring action: %s", F.initcap("trait"), F.col("name"), sense, F.col("type"))
    return found(hit, ruleset, "coherence", "physical_impossibility", F.col("event_id"), None if ruleset == "base" else F.col("trait"), message)


@rule()
def focus_overlap(facts: Facts, ruleset: str) -> DataFrame:
    both = _together(facts, facts.acts().where("requires_focus")).where("a_event_id < b_event_id")
    both = named(both, facts, who="agent") if ruleset == "v2" else both.withColumn("who", F.col("agent"))
    message = F.format_string("Character '%s' simultaneously: %s and %s", F.col("who"), F.col("a_event_id").cast("string"), F.col("b_event_id").cast("string"))
    return found(both, ruleset, "coherence", "focus_overlap", F.col("a_event_id"), F.col("b_event_id"), message)


def _fear(facts: Facts, trait: str, where: Column, kind: str) -> DataFrame:
    hit = facts.acts().where(where).join(traits(facts, "base").where(F.col("trait") == trait), ["story_id", "agent"], "left_semi")
    return found(hit, "base", "coherence", kind, F.col("event_id"))


@rule("base")
def claustrophobia(facts: Facts, ruleset: str) -> DataFrame:
    return _fear(facts, "claustrophobic", (F.col("type") == "enter") & F.col("location").isin(K.ENCLOSED), "claustrophobia")


@rule("base")
def acrophobia(facts: Facts, ruleset: str) -> DataFrame:
    return _fear(facts, "acrophobic", F.col("location").isin(K.HIGH), "acrophobia")


@rule("base")
def aquaphobia(facts: Facts, ruleset: str) -> DataFrame:
    return _fear(facts, "aquaphobic", (F.col("type") == "swim") | F.coalesce(F.col("location").isin(K.WATER), F.lit(False)), "aquaphobia")


# --- emotional


def _towards(facts: Facts, ruleset: str, kind: str, verbs: list[str] | None, rel: str, hooks: list[str], words: str) -> DataFrame:
    acts = facts.acts().where(F.col("type").isin(verbs)) if verbs else facts.acts()
    whom = facts.event_role.where("role = 'patient'").select("story_id", "event_id", F.col("arg").alias("patient"))
    if verbs and (facts.kept or facts.told):  # no patient of another event is sent to meet them
        whom = facts.acts("patient").where(F.col("type").isin(verbs)).select("story_id", "event_id", "patient")
    felt = facts.relationships.where(F.col("rel") == rel).select("story_id", F.col("src").alias("agent"), F.col("dst").alias("patient")).distinct()
    hit = acts.join(whom, ["story_id", "event_id"]).join(felt, ["story_id", "agent", "patient"])
    for hook in hooks:
        hit = _unless(hit, facts, hook, ["story_id", "event_id"])
    hit = named(hit, facts, who="agent", whom="patient") if ruleset == "v2" else hit.withColumns({"who": F.col("agent"), "whom": F.col("patient")})
    message = F.format_string(words, "who", "whom", "type")
    return found(hit, ruleset, "emotional", kind, F.col("event_id"), F.col("patient"), message)


@rule(*LATER)
def harm_loved(facts: Facts, ruleset: str) -> DataFrame:
    return _towards(facts, ruleset, "harm_loved", K.HARMFUL[ruleset], "loves", ["justified_harm"], "Character '%s' (who loves '%s') performs harmful action: %s")


@rule(*LATER)
def help_enemy(facts: Facts, ruleset: str) -> DataFrame:
    return _towards(facts, ruleset, "help_enemy", K.HELPFUL[ruleset], "hates", ["strategic_help"], "Character '%s' (who hates '%s') performs helpful action: %s")


@rule(*LATER)
def approach_feared(facts: Facts, ruleset: str) -> DataFrame:
    hooks = ["forced_approach", "brave_moment"] if ruleset == "narrative" else ["forced_approach"]
    return _towards(facts, ruleset, "approach_feared", K.APPROACH[ruleset], "fears", hooks, "Character '%s' (who fears '%s') approaches without necessity: %s")


@rule(*LATER)
def misplaced_trust(facts: Facts, ruleset: str) -> DataFrame:
    whom = facts.event_role.where("role = 'patient'").select("story_id", "event_id", F.col("arg").alias("dst"))
    acts = facts.acts().withColumnRenamed("agent", "src")
    acts = _unless(acts, facts, "involves_trust", ["story_id", "event_id"], "left_semi") if ruleset == "v2" else acts.where("type = 'trust'")
    hit = acts.join(whom, ["story_id", "event_id"]).join(facts.relationships.where("rel = 'distrusts'").select("story_id", "src", "dst").distinct(), ["story_id", "src", "dst"])
    hit = _unless(hit, facts, "trust_restored", ["story_id", "src", "dst", "event_id"]) if ruleset == "v2" else _unless(hit, facts, "trust_earned", ["story_id", "dst", "event_id"])
    message = F.format_string("Character '%s' trusts untrustworthy '%s': %s", F.col("src"), F.col("dst"), F.col("event_id").cast("string"))
    return found(hit, ruleset, "emotional", "misplaced_trust", F.col("event_id"), F.col("dst"), message)


@rule(*LATER)
def state_action_mismatch(facts: Facts, ruleset: str) -> DataFrame:
    odd = F.broadcast(small(facts.spark, K.CONTRADICTS[ruleset], "emotion", "type"))
    states = facts.emotional_states.select("story_id", F.col("character").alias("agent"), "emotion", F.col("t").alias("t_start"))
    hit = facts.acts().join(odd, "type").join(states, ["story_id", "agent", "t_start", "emotion"])
    message = F.format_string("Character '%s' in state '%s' performs contradictory action: %s", "agent", "emotion", "type")
    return found(hit, ruleset, "emotional", "state_mismatch" if ruleset == "v2" else "state_action_mismatch", F.col("event_id"), F.col("emotion"), message)


@rule("narrative")
def sudden_shift(facts: Facts, ruleset: str) -> DataFrame:
    odd = F.broadcast(small(facts.spark, K.OPPOSITE, "s1", "s2"))
    s = facts.emotional_states
    # Without a trigger between, only the first time of a state and the last of its opposite matter.
    if not facts.has("emotional_trigger"):
        first = s.groupBy("story_id", "character", F.col("emotion").alias("s1")).agg(F.min("t_ord").alias("o1"))
        last = s.groupBy("story_id", "character", F.col("emotion").alias("s2")).agg(F.max("t_ord").alias("o2"))
        hit = first.join(odd, "s1").join(last, ["story_id", "character", "s2"]).where("o1 < o2")
    else:
        a = s.select("story_id", "character", F.col("emotion").alias("s1"), F.col("t").alias("t1"), F.col("t_ord").alias("o1"))
        b = s.select("story_id", "character", F.col("emotion").alias("s2"), F.col("t").alias("t2"), F.col("t_ord").alias("o2"))
        hit = _unless(a.join(odd, "s1").join(b, ["story_id", "character", "s2"]).where("o1 < o2"), facts, "emotional_trigger", ["story_id", "character", "t1", "t2"])
    return found(hit, ruleset, "emotional", "sudden_shift", F.col("character"), F.col("s2"))


def once(facts: Facts) -> Facts:
    """The same facts, with events, roles and their join kept in memory or on local disks while rules read them many times.

    What an executor loses is computed again from the source. A session that checks many corpora calls once
    itself, hands the result to check and releases it (``facts.release()``) when the findings are written.
    """
    if facts.kept is not None:
        return facts
    keep = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    if facts.source is not None:  # one table has it all: nothing is joined to be kept
        return Facts(facts.spark, facts.events, facts.event_role, facts.bucket, facts.tables, dict(facts.told), [*facts.held, keep(facts.source)], facts.told)
    acts = {r: keep(facts.acts(r)) for r in ("agent", "patient")}
    return Facts(facts.spark, keep(facts.events), keep(facts.event_role), facts.bucket, facts.tables, acts, facts.held)


def check(facts: Facts, ruleset: str, only: list[str] | None = None, own: dict[str, Rule] | None = None) -> DataFrame:
    """All findings of a ruleset, with column ruleset; ``own`` adds rules of the user's.

    A rule gives each finding once, and no two rules one type, so only rules of the user's need telling apart.
    """
    facts = once(facts)
    rules = [f for name, (f, sets) in RULES.items() if ruleset in sets and (only is None or name in only)] + list((own or {}).values())
    out = None
    for f in rules:
        out = f(facts, ruleset) if out is None else out.unionByName(f(facts, ruleset))
    if out is None:
        raise ValueError(f"no rule of {only} in {ruleset}")
    out = out.withColumn("ruleset", F.lit(ruleset))
    return out.distinct() if own else out


def violation_text() -> Column:
    """``violation(a, b, ...)`` of a finding."""
    return F.concat(F.lit("violation("), F.concat_ws(", ", "category", "type", "subject", "detail"), F.lit(")"))
