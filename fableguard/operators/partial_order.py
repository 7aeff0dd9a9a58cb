"""Time points whose order is stated and partial: loops, labels that tell what comes before what, and rules that ask them.

A stated order is a graph (story_id, t1, t2). Points that come before each other are its strongly connected components,
found by trimming what lies on no loop and by searches forward and backward from random points. On the condensed graph runs
of points with one predecessor and one successor are contracted by pointer jumping; what is left, the hubs, are few in
orders that are mostly chains. A point's label has its component, its run and place, and the hubs before and after it, so
that ``before`` compares labels and asks for pairs of hubs alone.

Rounds follow each other in tables of the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fableguard.operators import fluents
from fableguard.operators.timeline import closure
from fableguard.plans.facts import Facts
from fableguard.sources.shared import written

S = "story_id"


#: Steps along edges between two written tables.
STEPS = 3


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges whose source has no way in or whose target has no way out, for as long as there are any."""
    size = edges.count()
    while size:
        for _ in range(STEPS):
            entered, left = edges.select(S, F.col("t2").alias("t1")).distinct(), edges.select(S, F.col("t1").alias("t2")).distinct()
            edges = edges.join(entered, [S, "t1"], "left_semi").join(left, [S, "t2"], "left_semi")
        edges = written(edges, "trimmed")
        if (now := edges.count()) == size:
            break
        size = now
    return edges


def _spread(start: DataFrame, edges: DataFrame, back: bool) -> DataFrame:
    """start (story_id, t, color), with the largest color from which a point is reached along edges, or against them."""
    a, b = ("t2", "t1") if back else ("t1", "t2")
    colors, changed = start, True
    while changed:
        step = colors.withColumn("was", F.col("color"))
        for _ in range(STEPS):
            come = edges.join(step.select(S, F.col("t").alias(a), "color"), [S, a]).groupBy(S, F.col(b).alias("t")).agg(F.max("color").alias("come"))
            step = step.join(come, [S, "t"], "left").select(S, "t", F.greatest("color", "come").alias("color"), "was")
        step = written(step, "colors")
        changed = not step.where("color > was").isEmpty()
        colors = step.drop("was")
    return colors


@dataclass
class Contracted:
    """points: story_id, at, inner. runs: story_id, at, run, place, enter, leave of inner points. circles: story_id, at, least.

    hubs: story_id, t1, t2, each a step or a run from hub to hub.
    """

    points: DataFrame
    runs: DataFrame
    circles: DataFrame
    hubs: DataFrame

    @classmethod
    def of(cls, edges: DataFrame) -> Contracted:
        """edges (story_id, t1, t2), each once, none from a point to itself."""
        kind = edges.schema["t1"].dataType
        out = edges.groupBy(S, F.col("t1").alias("at")).agg(F.count("*").alias("outs"), F.min("t2").alias("next"))
        into = edges.groupBy(S, F.col("t2").alias("at")).agg(F.count("*").alias("ins"), F.min("t1").alias("last"))
        points = out.join(into, [S, "at"], "full").withColumn("inner", F.coalesce((F.col("ins") == 1) & (F.col("outs") == 1), F.lit(False)))
        points = written(points, "points")
        runs = points.where("inner").select(S, "at", F.col("next").alias("to"), F.lit(1).cast("long").alias("place"), F.col("at").alias("run"), "last", F.col("at").alias("least"), F.lit(True).alias("moved"))
        left = n = runs.count()
        # Pointer jumping: twice as far each round, until every point knows the hub where its run ends; a circle has none.
        while left:
            ahead = runs.select(S, F.col("at").alias("to"), F.col("to").alias("far"), F.col("place").alias("more"), F.col("run").alias("end"), F.col("least").alias("low"))
            step = runs.drop("moved").join(ahead, [S, "to"], "left")
            runs = written(step.select(
                S, "at", F.coalesce("far", "to").alias("to"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
                F.coalesce("end", "run").alias("run"), "last", F.least("least", "low").alias("least"), F.col("far").isNotNull().alias("moved"),
            ), "runs")
            left, n = (runs.where("moved").count(), n / 2) if n >= 1 else (0, 0)
        ended = runs.where("not moved")
        first = ended.groupBy(S, "run").agg(F.max(F.struct("place", "last"))["last"].alias("enter"))
        inside = ended.join(first, [S, "run"]).select(S, "at", "run", "place", "enter", F.col("to").alias("leave"))
        hub = points.where("not inner").select(S, F.col("at").alias("t1"))
        steps = edges.join(hub, [S, "t1"], "left_semi").join(inside.select(S, F.col("at").alias("t2"), "leave"), [S, "t2"], "left")
        circles = runs.where("moved").select(S, "at", "least")
        hubs = written(steps.select(S, "t1", F.coalesce("leave", "t2").cast(kind).alias("t2")).distinct(), "hub-steps")
        # What enters a circle isn't of it, and a point of a circle alone has no other way in: circles meet no hub.
        return cls(points, written(inside, "inside"), circles, hubs)


def _owned(edges: DataFrame) -> DataFrame:
    """story_id, t, owner: the components of two points and more of edges, by one of their points.

    Every point takes the largest random number of those that it is reached from. Points with one number are reached from its
    owner; those of them from which the owner is reached are its component. What is left goes another round.
    """
    kind = edges.schema["t1"].dataType
    found, turn = edges.select(S, F.col("t1").alias("t"), F.col("t1").alias("owner")).limit(0), 0
    while not edges.isEmpty():
        points = edges.select(S, F.col("t1").alias("t")).union(edges.select(S, "t2")).distinct()
        points = points.withColumn("color", F.struct(F.xxhash64("t", F.lit(turn)).alias("draw"), F.col("t").alias("owner")))
        colors = _spread(points, edges, back=False)
        ends = [colors.select(S, F.col("t").alias(c), F.col("color").alias(f"c{c}")) for c in ("t1", "t2")]
        alike = written(edges.join(ends[0], [S, "t1"]).join(ends[1], [S, "t2"]).where("ct1 = ct2").select(S, "t1", "t2"), "alike")
        none = F.struct(F.lit(None).cast("long").alias("draw"), F.lit(None).cast(kind).alias("owner"))
        marks = colors.withColumn("color", F.when(F.col("color.owner") == F.col("t"), F.col("color")).otherwise(none))
        reached = written(_spread(marks, alike, back=True).where("color.owner is not null").select(S, "t", "color.owner"), "component")
        several = reached.groupBy(S, "owner").agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(reached.join(several, [S, "owner"], "left_semi").select(S, "t", "owner"))
        gone = [reached.select(S, F.col("t").alias(c)) for c in ("t1", "t2")]
        edges = _trimmed(written(alike.join(gone[0], [S, "t1"], "left_anti").join(gone[1], [S, "t2"], "left_anti"), "left"))
        turn += 1
    return found


def components(edges: DataFrame) -> DataFrame:
    """story_id, t, component of all points that lie on a loop; a component is named by its smallest point.

    Runs are contracted first, so that rounds go from hub to hub; a run lies on a loop if its two hubs do together.
    """
    edges = written(edges.select(S, "t1", "t2").where("t1 is not null and t2 is not null").distinct(), "order")
    selves = edges.where("t1 = t2").select(S, F.col("t1").alias("t"), F.col("t1").alias("owner"))
    c = Contracted.of(edges.where("t1 <> t2"))
    hubs = _owned(_trimmed(c.hubs.where("t1 <> t2")))
    back = c.hubs.where("t1 = t2").select(S, F.col("t1").alias("t"), F.col("t1").alias("owner"))
    hubs = written(hubs.unionByName(back.join(hubs.select(S, "t"), [S, "t"], "left_anti")), "hub-components")
    owners = [hubs.select(S, F.col("t").alias(k), F.col("owner").alias(f"o_{k}")) for k in ("enter", "leave")]
    inner = c.runs.join(owners[0], [S, "enter"]).join(owners[1], [S, "leave"]).where("o_enter = o_leave")
    whole = hubs.unionByName(inner.select(S, F.col("at").alias("t"), F.col("o_enter").alias("owner")))
    whole = whole.unionByName(c.circles.select(S, F.col("at").alias("t"), F.col("least").alias("owner")))
    alone = selves.join(whole.select(S, "t"), [S, "t"], "left_anti")
    whole = written(whole.unionByName(alone), "owned")
    names = whole.groupBy(S, "owner").agg(F.min("t").alias("component"))
    return written(whole.join(names, [S, "owner"]).select(S, "t", "component"), "components")


def circular(edges: DataFrame) -> DataFrame:
    """story_id, t1, t2 where each is before the other: all pairs within a component, and no others."""
    c = components(edges)
    return c.select(S, "component", F.col("t").alias("t1")).join(c.select(S, "component", F.col("t").alias("t2")), [S, "component"]).select(S, "t1", "t2")


@dataclass
class Order:
    """labels: story_id, t, loop, at, run, place, enter, leave. hubs: story_id, u, v where hub u is before hub v.

    ``at`` is the point of the condensed graph, ``loop`` whether it stands for a loop; ``place`` counts down to the end of a
    ``run``; ``enter`` and ``leave`` are the hubs before and after it, a hub's own name for a hub.
    """

    labels: DataFrame
    hubs: DataFrame

    @classmethod
    def of(cls, edges: DataFrame) -> Order:
        edges = edges.select(S, "t1", "t2").where("t1 is not null and t2 is not null").distinct()
        loops = components(edges)
        end = lambda c: loops.select(S, F.col("t").alias(c), F.col("component").alias(f"{c}_at"))
        both = edges.join(end("t1"), [S, "t1"], "left").join(end("t2"), [S, "t2"], "left")
        both = both.select(S, F.coalesce("t1_at", "t1").alias("u"), F.coalesce("t2_at", "t2").alias("v")).where("u <> v").distinct()
        both = written(both, "condensed")
        points = edges.select(S, F.explode(F.array("t1", "t2")).alias("t")).distinct().join(loops, [S, "t"], "left")
        c = Contracted.of(both.withColumnsRenamed({"u": "t1", "v": "t2"}))
        hub, kind = F.col("at"), c.points.schema["at"].dataType
        # A loop from which nothing leads and which nothing enters is in no edge of the condensed graph.
        ats = points.select(S, F.coalesce("component", "t").alias("at")).distinct()
        hubs = ats.join(c.runs, [S, "at"], "left_anti").select(S, "at", F.lit(None).cast(kind).alias("run"), F.lit(0).cast("long").alias("place"), hub.alias("enter"), hub.alias("leave"))
        labels = points.withColumn("loop", F.col("component").isNotNull()).withColumn("at", F.coalesce("component", "t")).select(S, "t", "loop", "at")
        labels = written(labels.join(c.runs.unionByName(hubs), [S, "at"]), "labels")
        reach = closure(c.hubs)
        return cls(labels, written(reach.select(S, F.col("t1").alias("u"), F.col("t2").alias("v")), "hubs"))

    def before(self, pairs: DataFrame, x: str, y: str) -> DataFrame:
        """The rows of pairs (story_id, x, y, ...) where x is before y; points that the order doesn't know are before none."""
        cols = [c for c in self.labels.columns if c not in (S, "t")]
        label = lambda p, c: self.labels.select(S, F.col("t").alias(c), *(F.col(k).alias(f"{p}_{k}") for k in cols))
        both = pairs.join(label("x", x), [S, x]).join(label("y", y), [S, y])
        # On one loop; on one run, ahead; from one run to the next; else from hub to hub.
        same = (F.col("x_at") == F.col("y_at")) & F.col("x_loop")
        ahead = F.coalesce(F.col("x_run") == F.col("y_run"), F.lit(False)) & (F.col("x_place") > F.col("y_place"))
        meet = (F.col("x_leave") == F.col("y_enter")) & (F.col("x_at") != F.col("y_at"))
        hubs = self.hubs.select(S, F.col("u").alias("x_leave"), F.col("v").alias("y_enter"), F.lit(True).alias("reached"))
        return both.join(hubs, [S, "x_leave", "y_enter"], "left").where(same | ahead | meet | F.coalesce("reached", F.lit(False))).select(pairs.columns)


# --- rules over a stated order


def precedes(facts: Facts, order: Order, by_agent: bool = False) -> DataFrame:
    """story_id, e1, e2 where e1's end is before e2's start: of all pairs of points of a story, or of each agent's pairs of acts."""
    a = facts.events.select(S, F.col("event_id").alias("e1"), F.col("t_end").alias("x"))
    b = facts.events.select(S, F.col("event_id").alias("e2"), F.col("t_start").alias("y"))
    if by_agent:
        acts = facts.acts().select(S, "agent", "event_id", "t_start", "t_end")
        a = acts.select(S, "agent", F.col("event_id").alias("e1"), F.col("t_end").alias("x"))
        b = acts.select(S, "agent", F.col("event_id").alias("e2"), F.col("t_start").alias("y"))
        return order.before(a.join(b, [S, "agent"]), "x", "y").select(S, "e1", "e2").distinct()
    ends, starts = a.select(S, "x").distinct(), b.select(S, "y").distinct()
    ordered = order.before(ends.join(starts, S), "x", "y")
    return ordered.join(a, [S, "x"]).join(b, [S, "y"]).select(S, "e1", "e2")


def dead_agent(facts: Facts, order: Order, killing: tuple[str, ...] = ("kill",)) -> DataFrame:
    """story_id, event_id, agent of acts that start after a death of the agent."""
    died = facts.acts().where("type = 'die'").select(S, "agent", F.col("t_end").alias("x"))
    killed = facts.acts("patient").where(F.col("type").isin(*killing)).select(S, F.col("patient").alias("agent"), F.col("t_end").alias("x"))
    deaths = died.unionByName(killed).distinct()
    acts = facts.acts().select(S, "agent", "event_id", F.col("t_start").alias("y"))
    return order.before(acts.join(deaths, [S, "agent"]), "x", "y").select(S, "event_id", "agent").distinct()


def holds_at(facts: Facts, order: Order, ruleset: str, demand: DataFrame) -> DataFrame:
    """story_id, pred, arg, t of demand (the same columns) that hold, by stated fluents' ends and effects.

    A fluent holds at a point where it is stated to begin or end, or is brought about, and after it unless negated: in
    ``base`` at or before the point asked for, in the other rulesets at that point only.
    """
    fluent = [S, "pred", "arg"]
    ends = facts.fluents.select(*fluent, F.explode(F.array("t_start", "t_end")).alias("t"))
    kinds = ("asked", "on", "off")
    parts = [("asked", demand), ("on", ends), ("on", fluents.effects(facts, "pos")), ("off", fluents.effects(facts, "neg"))]
    rows = [df.select(*fluent, "t", *(F.lit(k == kind).alias(k) for k in kinds)) for kind, df in parts]
    rows = reduce(DataFrame.unionByName, rows).where(reduce(lambda a, c: a & F.col(c).isNotNull(), [*fluent, "t"], F.lit(True)))
    # A fluent's points are dealt once; they meet, and are told apart, where they lie.
    points = rows.repartition(*fluent).groupBy(*fluent, "t").agg(*(F.bool_or(k).alias(k) for k in kinds))
    here = points.where("asked and on").select(*fluent, "t")
    open_ = points.where("asked and not on and not off").select(*fluent, "t")
    change = points.where("on or off" if ruleset == "base" else "on").select(*fluent, F.col("t").alias("since"), "on", "off")
    told = order.before(open_.join(change.hint("merge"), fluent), "since", "t").groupBy(*fluent, "t").agg(F.bool_or("on").alias("on"), F.bool_or("off").alias("off"))
    return here.unionByName(told.where("on and not off" if ruleset == "base" else "on").select(*fluent, "t"))
