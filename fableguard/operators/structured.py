"""Structured stories to fact tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fableguard.functions.knowledge import DOMAIN_EFFECTS, EFFECTS, EMOTIONS, RELATION_OF
from fableguard.functions.symbols import parse_term, quote, role_from_var, sanitize_symbol
from fableguard.plans.facts import Facts, small


def story_defaults(stories: DataFrame) -> DataFrame:
    """Missing sections as empty ones."""
    for name, kind in stories.dtypes:
        if kind.startswith("array"):
            stories = stories.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return stories


def _several(c: Column) -> Column:
    """A participant field, one text or a list as JSON, as an array of symbols."""
    listed = F.from_json(c, "array<string>")
    many = F.when(F.trim(c).startswith("["), listed).otherwise(F.array(c))
    return F.transform(F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), sanitize_symbol)


def _rows(stories: DataFrame, section: str) -> DataFrame:
    return stories.select("story_id", F.posexplode(section).alias("pos", "x"))


def events(stories: DataFrame, strict: bool = False) -> DataFrame:
    """story_id, event_id, pos, type, location, t_start, t_end, requires_focus, is_significant, description, fragment.

    ``strict`` reads times from the nested form only; else flat ones count too. Without any time an event has none.
    """
    x = _rows(stories, "events")
    start, end = F.col("x.time.start"), F.col("x.time.end")
    has = F.col("x.time").isNotNull()
    if not strict:
        start, end = F.coalesce(start, "x.time_start"), F.coalesce(end, "x.time_end")
        has = has | start.isNotNull() | end.isNotNull()
    start = F.when(has, F.coalesce(start, F.lit("t0")))
    place = F.when(F.col("x.location").isNotNull() & (F.col("x.location") != ""), sanitize_symbol(F.col("x.location")))
    return x.select(
        "story_id", sanitize_symbol(F.col("x.id")).alias("event_id"), "pos", sanitize_symbol(F.col("x.type")).alias("type"), place.alias("location"), F.when(has, sanitize_symbol(start)).alias("t_start"), F.when(has, sanitize_symbol(F.coalesce(end, start))).alias("t_end"),
        F.coalesce("x.requires_focus", F.lit(False)).alias("requires_focus"), F.coalesce("x.is_significant", F.lit(False)).alias("is_significant"), F.col("x.description").alias("description"), quote(F.col("x.story_fragment"), 500).alias("fragment"),
    )


def event_role(stories: DataFrame) -> DataFrame:
    """story_id, event_id, role, arg: one row per participant."""
    x = _rows(stories, "events")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), _several(F.col(f"x.{r}")).alias("args")) for r in ("agent", "patient", "instrument", "recipient", "source", "destination")))
    each = x.select("story_id", sanitize_symbol(F.col("x.id")).alias("event_id"), F.explode(roles).alias("r"))
    return each.select("story_id", "event_id", "r.role", F.explode("r.args").alias("arg"))


def time_points_ranked(ev: DataFrame) -> DataFrame:
    """story_id, t, t_ord: times of events ranked by first appearance."""
    times = ev.where("t_start is not null").select("story_id", F.explode(F.array(F.struct(F.col("pos"), F.lit(0).alias("side"), F.col("t_start").alias("t")), F.struct(F.col("pos"), F.lit(1).alias("side"), F.col("t_end").alias("t")))).alias("p"))
    first = times.groupBy("story_id", F.col("p.t").alias("t")).agg(F.min(F.struct("p.pos", "p.side")).alias("at"))
    return first.select("story_id", "t", F.row_number().over(Window.partitionBy("story_id").orderBy("at")).cast("long").alias("t_ord"))


def time_order(points: DataFrame) -> DataFrame:
    """story_id, t1, t2: each time point and the next."""
    nxt = F.lead("t").over(Window.partitionBy("story_id").orderBy("t_ord"))
    return points.select("story_id", F.col("t").alias("t1"), nxt.alias("t2")).where("t2 is not null")


def entities(stories: DataFrame, kind: str) -> DataFrame:
    """story_id, id, name and, for objects, obj_type."""
    x = stories.select("story_id", F.explode(f"entities.{kind}").alias("x"))
    out = x.select("story_id", sanitize_symbol(F.col("x.id")).alias("id"), F.coalesce("x.name", "x.id").alias("name"), *([sanitize_symbol(F.col("x.type")).alias("obj_type")] if kind == "objects" else []))
    return out.distinct()


def _fluent_term(x: Column) -> Column:
    """A stated fluent as a term: its id, or its name or property with what it is told of."""
    made = F.when(x["name"].isNotNull(), F.concat(x["name"], F.lit("("), F.array_join(F.coalesce(x["args"], F.array().cast("array<string>")), ","), F.lit(")")))
    return F.coalesce(x["id"], made, F.concat(x["property"], F.lit("("), x["entity"], F.lit(")")))


def fluents(stories: DataFrame) -> DataFrame:
    """story_id, pred, arg, args, t_start, t_end, negated. ``arg`` is the argument of terms with one, ``args`` has all."""
    x, made = _rows(stories, "fluents"), _fluent_term(F.col("x"))
    x = x.withColumn("term", parse_term(made)).where("term is not null and term.functor is not null")
    arg = F.when(F.size("term.args") == 1, sanitize_symbol(F.col("term.args")[0]))
    args = F.transform("term.args", sanitize_symbol)
    time = lambda *cs: sanitize_symbol(F.coalesce(*cs, F.lit("t_unknown")))
    return x.select("story_id", sanitize_symbol(F.col("term.functor")).alias("pred"), arg.alias("arg"), args.alias("args"), time("x.time.start", "x.start", "x.time_start").alias("t_start"), time("x.time.end", "x.end", "x.time_end").alias("t_end"), F.col("term.negated").alias("negated"))


def relationships(stories: DataFrame, strict: bool = False) -> DataFrame:
    x = _rows(stories, "relationships").select("story_id", F.col("x.type").alias("rel"), F.col("x.from").alias("src"), F.col("x.to").alias("dst"))
    if not strict:
        x = x.unionByName(_rows(stories, "character_relations").select("story_id", F.col("x.relation").alias("rel"), F.col("x.character1").alias("src"), F.col("x.character2").alias("dst")))
    return x.select("story_id", *(sanitize_symbol(F.coalesce(c, F.lit("unknown"))).alias(c) for c in ("rel", "src", "dst"))).distinct()


def relationship_inference(rel: DataFrame) -> DataFrame:
    """Stated relations as the ones that rules know."""
    return rel.join(F.broadcast(small(rel.sparkSession, RELATION_OF, "rel", "known")), "rel").select("story_id", F.col("known").alias("rel"), "src", "dst").distinct()


def emotional_quotes(stories: DataFrame) -> DataFrame:
    """story_id, character, emotion, fragment: what the text says of a character's state."""
    x = _rows(stories, "emotional_states").where("x.story_fragment is not null")
    return x.select("story_id", sanitize_symbol(F.coalesce("x.character", F.lit("unknown"))).alias("character"), sanitize_symbol(F.coalesce("x.emotion", F.lit("neutral"))).alias("emotion"), quote(F.col("x.story_fragment"), 500).alias("fragment")).distinct()


def emotional_states(stories: DataFrame) -> DataFrame:
    x = _rows(stories, "emotional_states")
    return x.select("story_id", sanitize_symbol(F.coalesce("x.character", F.lit("unknown"))).alias("character"), sanitize_symbol(F.coalesce("x.emotion", F.lit("neutral"))).alias("emotion"), sanitize_symbol(F.coalesce("x.time.start", F.lit("t_unknown"))).alias("t")).distinct()


def location_graph(stories: DataFrame) -> DataFrame:
    x = _rows(stories, "location_graph").select("story_id", sanitize_symbol(F.coalesce("x.relation", F.lit("adjacent"))).alias("relation"), sanitize_symbol(F.col("x.from")).alias("src"), sanitize_symbol(F.col("x.to")).alias("dst"))
    return x.where(F.col("relation").isin("distant", "adjacent", "contains")).distinct()


def causal_chain(stories: DataFrame) -> DataFrame:
    return _rows(stories, "causal_chains").select("story_id", sanitize_symbol(F.col("x.cause_event")).alias("cause"), sanitize_symbol(F.col("x.effect_event")).alias("effect")).distinct()


def traits(stories: DataFrame) -> DataFrame:
    return _rows(stories, "traits").select("story_id", sanitize_symbol(F.col("x.character")).alias("character"), sanitize_symbol(F.col("x.trait")).alias("trait")).distinct()


def rules(stories: DataFrame) -> DataFrame:
    """story_id, kind (causes or precondition), type, polarity, prop, role of a story's own rules; bodies need one argument."""
    x = _rows(stories, "rules").select("story_id", F.lower("x.type").alias("kind"), F.col("x.head").alias("h"), F.explode("x.body").alias("b"))
    x = x.withColumns({"head": parse_term(F.col("h")), "body": parse_term(F.col("b"))})
    x = x.where("not head.negated and size(body.args) = 1 and kind in ('causes', 'causal', 'precondition')")
    kind = F.when(F.col("kind") == "precondition", "precondition").otherwise("causes")
    return x.select("story_id", kind.alias("kind"), sanitize_symbol(F.col("head.functor")).alias("type"), F.when(F.col("body.negated"), "neg").otherwise("pos").alias("polarity"), sanitize_symbol(F.col("body.functor")).alias("prop"), role_from_var(F.col("body.args")[0], F.col("head.args")).alias("role")).distinct()


def domain_distance(stories: DataFrame) -> DataFrame:
    x = _rows(stories, "constraints").where("x.type = 'distance'").select("story_id", sanitize_symbol(F.col("x.location1")).alias("src"), sanitize_symbol(F.col("x.location2")).alias("dst"))
    return x.unionByName(x.select("story_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def domain_emotions(fl: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Fluents that name an emotion, as states."""
    hit = fl.where(F.col("pred").rlike("|".join(words or EMOTIONS)) & F.col("arg").isNotNull())
    return hit.select("story_id", F.col("arg").alias("character"), F.col("pred").alias("emotion"), F.when(F.col("t_start") == "t_unknown", "t0").otherwise(F.col("t_start")).alias("t")).distinct()


def location_types(stories: DataFrame) -> DataFrame:
    """story_id, location, kind of places whose kind is told."""
    x = stories.select("story_id", F.explode("entities.locations").alias("x")).where("x.type is not null and x.type <> ''")
    return x.select("story_id", sanitize_symbol(F.col("x.id")).alias("location"), sanitize_symbol(F.col("x.type")).alias("kind")).distinct()


def domain_relationships(stories: DataFrame) -> DataFrame:
    """rel, src, dst of all stories together, where all three are told."""
    x = _rows(stories, "relationships")
    told = [F.coalesce(F.col(f"x.{c}"), F.lit("")) != "" for c in ("type", "from", "to")]
    x = x.where(told[0] & told[1] & told[2])
    return x.select(*(sanitize_symbol(F.col(f"x.{c}")).alias(n) for c, n in (("type", "rel"), ("from", "src"), ("to", "dst")))).distinct()


def domain_union(stories: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """kind, a, b, c: what a corpus' stories say together, each once.

    Distances (both ways), relationships, emotional states that fluents name, significant and first events, the default
    and the stories' own effects and preconditions (type and property), and ``marks`` (kind, id): decorative objects and
    justified harms, named by the user. A story is parsed and taken apart once, and its rows go through one exchange.
    """
    spark, stories = stories.sparkSession, story_defaults(stories)
    kind, text = "array<struct<kind:string,a:string,b:string,c:string>>", lambda c: F.coalesce(c, F.lit(""))

    def row(name: str, *cells: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), *(c.cast("string").alias(n) for c, n in zip([*cells, *[F.lit(None)] * (3 - len(cells))], "abc", strict=True)))

    def each(section: Column | str, where: Callable[[Column], Column], tell: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(section, where), tell)

    ends = ("location1", "location2"), ("location2", "location1")
    apart = lambda at: lambda x: row("distant", *(sanitize_symbol(x[c]) for c in at))
    near = [each("constraints", lambda x: x["type"] == "distance", apart(at)) for at in ends]
    told = ("type", "from", "to")
    relations = each("relationships", lambda x: (text(x[told[0]]) != "") & (text(x[told[1]]) != "") & (text(x[told[2]]) != ""), lambda x: row("relationship", *(sanitize_symbol(x[c]) for c in told)))
    start = lambda x: sanitize_symbol(F.coalesce(x["time"]["start"], x["start"], x["time_start"], F.lit("t_unknown")))
    stated = F.transform("fluents", lambda x: F.struct(parse_term(_fluent_term(x)).alias("term"), start(x).alias("t")))
    felt = lambda x: ~x["term"]["negated"] & x["term"]["functor"].isNotNull() & sanitize_symbol(x["term"]["functor"]).rlike("|".join(EMOTIONS)) & (F.size(x["term"]["args"]) == 1)
    emotions = each(stated, felt, lambda x: row("emotional_state", sanitize_symbol(F.get(x["term"]["args"], F.lit(0))), sanitize_symbol(x["term"]["functor"]), F.when(x["t"] == "t_unknown", "t0").otherwise(x["t"])))
    event = lambda name: lambda x: row(name, sanitize_symbol(x["id"]))
    events = [each("events", lambda x: x["is_significant"], event("significant_event")), F.transform(F.slice("events", 1, 1), event("initial_event"))]
    term = lambda r: F.transform(r["body"], lambda y: F.struct(F.lower(r["type"]).alias("kind"), parse_term(r["head"]).alias("head"), parse_term(y).alias("body")))
    own = F.flatten(F.transform(F.filter("rules", lambda r: r["body"].isNotNull()), term))
    ruled = lambda kinds: lambda x: ~x["head"]["negated"] & (F.size(x["body"]["args"]) == 1) & x["kind"].isin(kinds)
    rule = lambda name: lambda x: row(name, sanitize_symbol(x["head"]["functor"]), F.when(x["body"]["negated"], "neg").otherwise("pos"), sanitize_symbol(x["body"]["functor"]))
    effects, needs = each(own, ruled(["causes", "causal"]), rule("effect")), each(own, ruled(["precondition"]), rule("precondition"))
    every = F.concat(*(c.cast(kind) for c in (*near, relations, emotions, *events, effects, needs)))
    out = stories.select(F.explode(F.array_distinct(every)).alias("x")).select("x.*")
    defaults = small(spark, [*EFFECTS, *DOMAIN_EFFECTS], "type", "polarity", "prop", "role")
    out = out.unionByName(defaults.select(F.lit("effect").alias("kind"), F.col("type").alias("a"), F.col("polarity").alias("b"), F.col("prop").alias("c")))
    if marks is not None:
        none = F.lit(None).cast("string")
        out = out.unionByName(marks.select("kind", sanitize_symbol(F.col("id")).alias("a"), none.alias("b"), none.alias("c")))
    return out.distinct()


def validate(stories: DataFrame) -> DataFrame:
    """story_id, problem, ref: what is wrong with a structured story, by the ids that it states.

    duplicate_id (within a section), malformed_id, malformed_event_id, malformed_time, missing_reference (agent, patient
    or location that no entity has), ends_before_start (by the numbers of the times) of events, and of fluents too.

    A story is parsed and taken apart once: what its rows tell alone comes as problems, ids and references as candidates that
    are counted with them, in one exchange.
    """
    stories = story_defaults(stories)
    kind = "array<struct<problem:string,ref:string,section:int,known:boolean>>"

    def tell(refs: Column, problem: str, section: int | None = None, known: bool | None = None) -> Column:
        row = lambda ref: F.struct(F.lit(problem).alias("problem"), ref.alias("ref"), F.lit(section).cast("int").alias("section"), F.lit(known).cast("boolean").alias("known"))
        return F.coalesce(F.transform(refs, row), F.array()).cast(kind)

    ids = [F.coalesce(F.col(f"entities.{k}.id"), F.array().cast("array<string>")) for k in ("characters", "objects", "locations")]
    events, known = F.col("events.id"), F.concat(*ids)
    time = lambda i, start, end: F.struct(i.alias("id"), start.alias("start"), end.alias("end"))
    of_event = lambda e: time(e["id"], F.coalesce(e["time"]["start"], e["time_start"]), F.coalesce(e["time"]["end"], e["time_end"], e["time"]["start"], e["time_start"]))
    of_fluent = lambda x: time(F.coalesce(x["id"], x["name"], x["property"]), F.coalesce(x["time"]["start"], x["start"], x["time_start"]), F.coalesce(x["time"]["end"], x["end"], x["time_end"]))
    times = F.concat(F.transform("events", of_event), F.transform("fluents", of_fluent))
    number = lambda c: F.regexp_extract(c, "^t([0-9]+)$", 1).try_cast("long")
    names = F.flatten(F.transform("events", lambda e: F.flatten(F.array(*(_several(e[c]) for c in ("agent", "patient", "location"))))))
    told = [tell(x, "duplicate_id", n) for n, x in enumerate([*ids, events])]
    told += [
        tell(F.filter(known, lambda i: ~F.coalesce(i.rlike("^[a-z][a-z0-9_]*$"), F.lit(False))), "malformed_id"),
        tell(F.filter(events, lambda i: ~F.coalesce(i.rlike("^e[0-9]+$"), F.lit(False))), "malformed_event_id"),
        tell(F.filter(F.flatten(F.transform(times, lambda t: F.array_compact(F.array(t["start"], t["end"])))), lambda t: ~t.rlike("^t[0-9]+$")), "malformed_time"),
        tell(F.array_distinct(names), "missing_reference", known=False),
        tell(F.transform(known, sanitize_symbol), "missing_reference", known=True),
        tell(F.transform(F.filter(times, lambda t: number(t["end"]) < number(t["start"])), lambda t: t["id"]), "ends_before_start"),
    ]
    rows = stories.select("story_id", F.explode(F.concat(*told)).alias("x")).select("story_id", "x.*")
    most = F.greatest(*(F.count(F.when(F.col("section") == n, 1)) for n in range(4))).alias("most")
    each = rows.groupBy("story_id", "problem", "ref").agg(most, F.bool_or("known").alias("any"), F.bool_and("known").alias("all"))
    missing = ~F.col("any") | (F.col("story_id").isNull() & ~F.col("all"))
    return each.where(F.when(F.col("problem") == "duplicate_id", F.col("most") > 1).when(F.col("problem") == "missing_reference", missing).otherwise(True)).select("story_id", "problem", "ref")


def load(stories: DataFrame, scope: str = "story") -> Facts:
    """All facts of structured stories. With scope ``corpus`` first events of any story exempt equal ids in all.

    A story's own rules and distances hold in that story alone. What rules read many times is kept (``facts.release()`` lets
    it go): without that a rule's plan reads and ranks the stories once per mention of them.
    """
    held = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    spark, stories = stories.sparkSession, keep(story_defaults(stories))
    ev = keep(events(stories))
    points = time_points_ranked(ev)
    rank = lambda df, t, o: df.join(points.select("story_id", F.col("t").alias(t), F.col("t_ord").alias(o)), ["story_id", t], "left")
    timed = keep(rank(rank(ev, "t_start", "start_ord"), "t_end", "end_ord"))
    fl = fluents(stories).where("not negated").drop("negated")
    first = ev.where("pos = 0").select("story_id", "event_id")
    if scope == "corpus":
        first = ev.select("story_id", "event_id").join(first.select("event_id").distinct(), "event_id", "left_semi")
    own, of_story = keep(rules(stories)), F.col("story_id").alias("scope")
    tables = {
        "characters": entities(stories, "characters").select("story_id", "id"), "objects": entities(stories, "objects"), "locations": entities(stories, "locations").select("story_id", "id"),
        "fluents": keep(rank(rank(fl, "t_start", "start_ord"), "t_end", "end_ord")), "traits": traits(stories), "relationships": relationships(stories).unionByName(relationship_inference(relationships(stories))).distinct(),
        "emotional_states": rank(emotional_states(stories), "t", "t_ord"), "location_graph": location_graph(stories).select(of_story, "relation", "src", "dst").unionByName(domain_distance(stories).select(of_story, F.lit("distant").alias("relation"), "src", "dst")).distinct(), "location_types": location_types(stories),
        "causal_chain": causal_chain(stories), "significant_event": ev.where("is_significant").select("story_id", "event_id"), "initial_event": first,
        "names": entities(stories, "characters").select("story_id", "id", "name").unionByName(entities(stories, "objects").select("story_id", "id", "name")).unionByName(entities(stories, "locations").select("story_id", "id", "name")).dropDuplicates(["story_id", "id"]),
    }
    facts = Facts(spark, timed, keep(event_role(stories)), 32, tables, held=held)
    for table, kind in (("effects", "causes"), ("preconditions", "precondition")):
        facts.tables[table] = keep(getattr(Facts(spark, timed, timed), table).unionByName(own.where(F.col("kind") == kind).select(of_story, "type", "polarity", "prop", "role")).distinct())
    return facts
