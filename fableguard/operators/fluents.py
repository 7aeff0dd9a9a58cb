"""Time-varying properties: what events bring about, and what holds when."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fableguard.functions import knowledge as K
from fableguard.operators.timeline import lt, stab, time_points
from fableguard.plans.facts import Facts, in_scope


def role_arg(facts: Facts) -> DataFrame:
    """story_id, event_id, role, arg for agents, patients and instruments."""
    return facts.event_role.where(F.col("role").isin("agent", "patient", "instrument")).select("story_id", "event_id", "role", "arg").distinct()


def _of_types(facts: Facts, table: DataFrame, t: str, t_ord: str) -> DataFrame:
    """The participants (arg) of events in the roles of table (scope, type, pred, role), with t and t_ord of the event."""
    cols = ["story_id", "event_id", "type", t, t_ord]
    if not facts.told:
        return in_scope(facts.events.select(*cols), table, ["type"]).join(role_arg(facts), ["story_id", "event_id", "role"])
    each = [facts.told[r].select(*cols, F.lit(r).alias("role"), F.col(r).alias("arg")) for r in ("agent", "patient", "instrument") if r in facts.told]
    return in_scope(reduce(DataFrame.unionByName, each), table, ["type", "role"])


def effects(facts: Facts, polarity: str) -> DataFrame:
    """story_id, pred, arg, t, t_ord of the effects of this polarity, at the end of the events that have them."""
    table = facts.effects.where(F.col("polarity") == polarity).select("scope", "type", F.col("prop").alias("pred"), "role")
    at = _of_types(facts, table, "t_end", "end_ord")
    return at.select("story_id", "pred", "arg", F.col("t_end").alias("t"), F.col("end_ord").alias("t_ord")).distinct()


def fluent_caused(facts: Facts) -> DataFrame:
    """story_id, pred, arg, t of stated fluents that an event brings about at the very point at which they start."""
    f = facts.fluents.select("story_id", "pred", "arg", F.col("t_start").alias("t")).distinct()
    return f.join(effects(facts, "pos").select("story_id", "pred", "arg", "t"), ["story_id", "pred", "arg", "t"], "left_semi")


def holds_at_interval(facts: Facts, points: DataFrame | None = None) -> DataFrame:
    """story_id, pred, arg, t, t_ord: stated fluents at each time point of their closed interval, by the dyadic index."""
    points = time_points(facts) if points is None else points
    stated = facts.fluents.select("story_id", "pred", "arg", "start_ord", "end_ord")
    near = stab(points.select("story_id", "t", "t_ord"), stated, ["story_id"], "t_ord", "start_ord", "end_ord", facts.bucket)
    inside = ~lt(F.col("t_ord"), F.col("start_ord")) & ~lt(F.col("end_ord"), F.col("t_ord"))
    return near.where(inside).select("story_id", "pred", "arg", "t", "t_ord").distinct()


def holds_at(facts: Facts, ruleset: str, demand: DataFrame | None = None) -> DataFrame:
    """story_id, pred, arg, t: what holds at which time point.

    A fluent holds where it is stated or brought about, and later unless negated: in ``base`` from the first negation
    on, in the other rulesets only at the negation's own point; ``inertial`` lets the latest effect win. ``demand``
    (story_id, pred, arg, t, t_ord) restricts the answer to the points asked for, which is all that a rule needs: then
    only stated intervals of the fluents asked for meet only the points asked for.
    """
    if demand is not None and ruleset != "inertial":
        return _holds_where_asked(facts, ruleset, demand)
    fluent = ["story_id", "pred", "arg"]
    neg, caused = effects(facts, "neg"), effects(facts, "pos")
    if demand is None:
        seed = holds_at_interval(facts).unionByName(caused).distinct()
        asked = seed.select(*fluent).distinct().join(time_points(facts), "story_id")
        earliest = seed.select(*fluent, "t_ord")
    else:
        asked = demand.select(*fluent, "t", "t_ord").distinct()
        wanted = asked.select(*fluent).distinct()
        neg, caused = (x.join(wanted, fluent, "left_semi") for x in (neg, caused))
        stated = facts.fluents.join(wanted, fluent, "left_semi").select(*fluent, "start_ord", "end_ord")
        inside = ~lt(F.col("t_ord"), F.col("start_ord")) & ~lt(F.col("end_ord"), F.col("t_ord"))
        seed = asked.join(stated, fluent).where(inside).select(*fluent, "t", "t_ord").unionByName(caused).distinct()
        # A stated fluent holds from its start, or, without one, from the first point that its story has.
        loose = stated.where("start_ord is null").select(*fluent, "end_ord")
        first = loose.join(time_points(facts).groupBy("story_id").agg(F.min("t_ord").alias("t_ord")), "story_id").where(~lt(F.col("end_ord"), F.col("t_ord")))
        whole = stated.where(~lt(F.col("end_ord"), F.col("start_ord"))).select(*fluent, F.col("start_ord").alias("t_ord"))
        earliest = whole.unionByName(first.select(*fluent, "t_ord")).unionByName(caused.select(*fluent, "t_ord"))
    if ruleset == "inertial":
        changes = seed.withColumn("on", F.lit(1)).unionByName(neg.withColumn("on", F.lit(0))).where("t_ord is not null")
        if demand is not None:
            # Of a stated interval its last point before the one asked for counts, which is no question's: ask where it ends.
            changes = changes.unionByName(_last_stated(stated, asked, fluent))
        rows = changes.select(*fluent, "t_ord", "on", F.lit(None).cast("long").alias("t")).unionByName(asked.where("t_ord is not null").select(*fluent, "t_ord", F.lit(None).cast("int").alias("on"), "t"))
        # strictly before the point asked for: questions come first among equals
        order = Window.partitionBy(*fluent).orderBy("t_ord", F.col("on").isNotNull(), "on").rowsBetween(Window.unboundedPreceding, -1)
        told = rows.withColumn("last", F.last("on", ignorenulls=True).over(order)).where("t is not null and last = 1").select(*fluent, "t")
        return told.unionByName(asked.join(seed.select(*fluent, "t"), [*fluent, "t"], "left_semi").select(*fluent, "t")).distinct()
    here = seed.select(*fluent, "t")
    later = asked.join(earliest.groupBy(*fluent).agg(F.min("t_ord").alias("since")), fluent).where(lt(F.col("since"), F.col("t_ord")))
    if ruleset == "base":
        first = neg.groupBy(*fluent).agg(F.min("t_ord").alias("off"))
        later = later.join(first, fluent, "left").where(~F.coalesce(F.col("off") <= F.col("t_ord"), F.lit(False)))
    later = later.join(neg.select(*fluent, "t"), [*fluent, "t"], "left_anti")
    return asked.join(here, [*fluent, "t"], "left_semi").select(*fluent, "t").unionByName(later.select(*fluent, "t")).distinct()


def _holds_where_asked(facts: Facts, ruleset: str, demand: DataFrame) -> DataFrame:
    """The points of demand at which their fluent holds, in ``base`` or the later rulesets.

    All that is known of a fluent's points is dealt by fluent once, and told there; what is stated comes to it.
    """
    fluent, kinds = ["story_id", "pred", "arg"], ("asked", "caused", "neg")
    parts = zip(kinds, (demand, effects(facts, "pos"), effects(facts, "neg")), strict=True)
    rows = [df.select(*fluent, "t", "t_ord", *(F.lit(k == kind).alias(k) for k in kinds)) for kind, df in parts]
    rows = reduce(DataFrame.unionByName, rows).where(reduce(lambda a, c: a & F.col(c).isNotNull(), [*fluent, "t"], F.lit(True)))
    points = rows.repartition(*fluent).groupBy(*fluent, "t").agg(F.max("t_ord").alias("t_ord"), *(F.bool_or(k).alias(k) for k in kinds))
    of_fluent, least = Window.partitionBy(*fluent), lambda k: F.min(F.when(F.col(k), F.col("t_ord")))
    points = points.withColumns({"since": least("caused").over(of_fluent), "off": least("neg").over(of_fluent)}).where("asked")
    # A stated fluent holds from its start, or, without one, from the first point that its story has.
    stated = facts.fluents.select(*fluent, "start_ord", "end_ord")
    ends = [(facts.events, "start"), (facts.events, "end"), (facts.fluents, "start"), (facts.fluents, "end")]
    firsts = reduce(DataFrame.unionByName, [df.where(f"t_{x} is not null").select("story_id", F.col(f"{x}_ord").alias("first_ord")) for df, x in ends])
    firsts = firsts.groupBy("story_id").agg(F.min("first_ord").alias("first_ord"))
    loose = stated.where("start_ord is null").join(firsts, "story_id").select(*fluent, F.col("first_ord").alias("from_ord"), "start_ord", "end_ord")
    stated = loose.unionByName(stated.where("start_ord is not null").select(*fluent, F.col("start_ord").alias("from_ord"), "start_ord", "end_ord"))
    met = points.join(stated.withColumn("stated", F.lit(True)), fluent, "left")
    inside = F.coalesce("stated", F.lit(False)) & ~lt(F.col("t_ord"), F.col("start_ord")) & ~lt(F.col("end_ord"), F.col("t_ord"))
    start = F.least("since", F.when(~lt(F.col("end_ord"), F.col("from_ord")), F.col("from_ord")))
    later = ~F.col("neg") & lt(start, F.col("t_ord"))
    if ruleset == "base":
        later &= ~F.coalesce(F.col("off") <= F.col("t_ord"), F.lit(False))
    return met.where(F.col("caused") | inside | later).select(*fluent, "t").distinct()


def _last_stated(stated: DataFrame, asked: DataFrame, fluent: list[str]) -> DataFrame:
    """A stated interval as changes at its start and end, for those that the points asked for come after."""
    ends = F.explode(F.array("start_ord", "end_ord")).alias("t_ord")
    whole = stated.where(~lt(F.col("end_ord"), F.col("start_ord"))).select(*fluent, ends).where("t_ord is not null").withColumn("on", F.lit(1))
    return whole.withColumn("t", F.lit(None).cast(dict(asked.dtypes)["t"])).select(*fluent, "t", "t_ord", "on").distinct()


def requires(facts: Facts, polarity: str) -> DataFrame:
    """story_id, event_id, pred, arg, t, t_ord: what must (pos) or must not (neg) hold when an event starts."""
    table = facts.preconditions.where(F.col("polarity") == polarity).select("scope", "type", F.col("prop").alias("pred"), "role")
    at = _of_types(facts, table, "t_start", "start_ord")
    return at.select("story_id", "event_id", "pred", "arg", F.col("t_start").alias("t"), F.col("start_ord").alias("t_ord")).distinct()


def has_after(facts: Facts, verbs: list[str]) -> DataFrame:
    """story_id, agent, object, t: who has what from the end of which acquisition."""
    got = facts.acts().where(F.col("type").isin(verbs)).join(facts.event_role.where("role = 'patient'").select("story_id", "event_id", F.col("arg").alias("object")), ["story_id", "event_id"])
    return got.select("story_id", "agent", "object", F.col("t_end").alias("t")).distinct()


def possession(facts: Facts) -> DataFrame:
    """story_id, agent, object, t, t_ord, has: who gains (1) or loses (0) what at the end of which event.

    Taking gains; giving loses, and lets the recipient gain (without a recipient: a patient that is a character); dropping loses.
    """
    thing = facts.event_role.where("role = 'patient'").select("story_id", "event_id", F.col("arg").alias("object"))
    acts = facts.acts().join(thing, ["story_id", "event_id"]).select("story_id", "event_id", "type", "agent", "object", F.col("t_end").alias("t"), F.col("end_ord").alias("t_ord"))
    change = F.when(F.col("type").isin(K.ACQUIRING), 1).when(F.col("type").isin(K.LOSING), 0)
    own = acts.withColumn("has", change).where("has is not null")
    to = facts.event_role.where("role = 'recipient'").select("story_id", "event_id", F.col("arg").alias("to"))
    got = acts.where("type = 'give'").join(to, ["story_id", "event_id"]).withColumn("agent", F.col("to")).withColumn("has", F.lit(1))
    cols = ["story_id", "agent", "object", "t", "t_ord", "has"]
    return own.select(cols).unionByName(got.select(cols)).distinct()
