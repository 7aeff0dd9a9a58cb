"""A fact store: the fact tables of a corpus, written once in buckets by story, and the rules as few passes over them.

All rules join within a story. Tables in equally many buckets by ``story_id`` meet without any exchange, whatever further
keys a join has. Beside the facts themselves the store keeps what most rules ask together: ``acts`` (an event with each agent), ``deeds`` (with each
patient too), ``cast`` (what is known of a character or object), ``ties``, ``moods`` and ``stated`` fluents. One pass over the
deeds finds what the rules of acts find one by one.

A story with more than ``most`` events isn't put into a bucket: it goes through the plain rules, which spread a story
over characters and time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.functions import knowledge as K
from fableguard.operators import fluents, rules, timeline
from fableguard.plans.facts import SCHEMAS, Facts
from fableguard.sources.shared import delete, new_folder, written

#: Joins of tables in buckets by story needn't have all their keys in the buckets' key.
COPARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
KEY = "story_id"
#: Hooks of an event and of an entity that the passes read as marks.
EVENT_MARKS = ("significant_event", "initial_event", "background_event", "justified_harm", "strategic_help", "forced_approach", "brave_moment", "allows_remote")
ENTITY_MARKS = ("decorative", "prominently_introduced", "edible_tool")
FINDING = ["story_id", "category", "type", "subject", "detail", "context"]


@dataclass
class FactStore:
    """Bucketed tables ``{name}_{table}`` in ``folder``; ``large`` holds the facts of stories that are too large for a bucket."""

    spark: SparkSession
    name: str
    folder: str
    held: list[str]
    plain: dict[str, DataFrame]
    bucket: int
    large: Facts | None

    @classmethod
    def write(cls, facts: Facts, buckets: int | None = None, most: int = 1_000_000) -> FactStore:
        """The store of facts. A bucket should hold some 100 MB; the default is the session's number of shuffle partitions."""
        spark = facts.spark
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(COPARTITION, "false")
        out = cls(spark, f"facts_{uuid.uuid4().hex}", new_folder(spark, "facts"), [], {}, facts.bucket, None)
        # At most 1 / most of all events' number of rows.
        large = facts.events.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > most).select(KEY)
        large = written(large, "large-stories")
        if split := not large.isEmpty():
            out.large = _restricted(facts, large, "left_semi")
            facts = _restricted(facts, large, "left_anti")
        tables = {"events": facts.events, "event_role": facts.event_role} | facts.tables
        jobs = {t: df for t, df in tables.items() if KEY in df.columns}
        out.plain = {t: df for t, df in tables.items() if KEY not in df.columns}
        out._save({t: df.repartition(n, KEY) for t, df in jobs.items()}, n)
        raw = out.facts()
        kept = {"acts": raw.acts(), "deeds": deeds(raw), "cast": cast(raw), "ties": ties(raw), "moods": moods(raw), "stated": stated(raw)}
        out._save(kept, n)
        if not split:
            delete(spark, large.inputFiles()[0].rpartition("/")[0])
        return out

    def _save(self, tables: dict[str, DataFrame], n: int) -> None:
        def save(item: tuple[str, DataFrame]) -> None:
            table, df = item
            writer = df.write.bucketBy(n, KEY).option("path", f"{self.folder}/{table}").option("compression", "zstd")
            writer.saveAsTable(f"{self.name}_{table}")

        with ThreadPoolExecutor(8) as pool:
            list(pool.map(save, tables.items()))
        self.held += tables

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def side(self, name: str) -> DataFrame:
        """A table that is joined by merging buckets: by its compressed files it may look small enough to be sent to all by the driver."""
        return self.table(name).hint("merge")

    def facts(self) -> Facts:
        """The facts as any rule reads them, from the buckets."""
        tables = {t: self.table(t) for t in self.held if t in SCHEMAS} | self.plain
        kept = {"agent": self.table("acts")} if "acts" in self.held else None
        return Facts(self.spark, self.table("events"), self.table("event_role"), self.bucket, tables, kept)

    def drop(self) -> None:
        """Forget the tables and delete their files."""
        for t in self.held:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{t}")
        delete(self.spark, self.folder)

    def check(self, ruleset: str, own: dict[str, rules.Rule] | None = None) -> DataFrame:
        """All findings of a ruleset, as rules.check gives them."""
        facts = self.facts()
        if ruleset == "v2":  # its messages have names in them: the plain rules over the buckets
            parts = [f(facts, ruleset) for f, sets in rules.RULES.values() if ruleset in sets]
        else:
            parts = [p(self, facts, ruleset) for p, sets in PASSES if ruleset in sets]
            parts += [rules.RULES[r][0](facts, ruleset) for r, needs in PLAIN.items() if ruleset in rules.RULES[r][1] and (needs is None or facts.has(needs))]
        parts += [f(facts, ruleset) for f in (own or {}).values()]
        out = parts[0].select(FINDING)
        for part in parts[1:]:
            out = out.unionByName(part.select(FINDING))
        out = out.withColumn("ruleset", F.lit(ruleset))
        if self.large:
            out = out.unionByName(rules.check(self.large, ruleset, own=own))
        return out.distinct() if own else out


def _restricted(facts: Facts, stories: DataFrame, how: str) -> Facts:
    """The facts of some stories."""
    some = lambda df: df.join(stories, KEY, how) if KEY in df.columns else df
    return Facts(facts.spark, some(facts.events), some(facts.event_role), facts.bucket, {t: some(df) for t, df in facts.tables.items()})


# --- what the store keeps beside the facts; each is made of bucketed tables, without an exchange


def _marks(facts: Facts, hooks: tuple[str, ...], key: str) -> DataFrame:
    """story_id, key, marks: the names of the hooks that hold."""
    out = None
    for hook in hooks:
        if facts.has(hook):
            rows = getattr(facts, hook).select(KEY, key, F.lit(hook).alias("mark"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        kind = dict(facts.events.dtypes)["event_id"] if key == "event_id" else "string"
        return facts.spark.sql(f"SELECT '' AS story_id, CAST(NULL AS {kind}) AS {key}, array('') AS marks WHERE false")
    return out.groupBy(KEY, key).agg(F.collect_set("mark").alias("marks"))


def deeds(facts: Facts) -> DataFrame:
    """The events with marks, where they take place, and a row for each agent and patient; either may be missing.

    ``is_agent``: the patient is an agent of the event too. ``earned``: trust in the patient is earned.
    """
    e, roles = facts.events, facts.event_role
    marks = _marks(facts, EVENT_MARKS, "event_id")
    chain = facts.causal_chain.select(KEY, F.col("effect").alias("event_id"))
    caused = chain.unionByName(e.where("type = 'natural'").select(KEY, "event_id")).distinct().withColumn("caused", F.lit(True))
    # An event may be told more than once, in several places.
    places = e.groupBy(KEY, "event_id").agg(F.collect_set("location").alias("places"))
    agents = roles.where("role = 'agent'").select(KEY, "event_id", F.col("arg").alias("agent")).distinct()
    patients = roles.where("role = 'patient'").select(KEY, "event_id", F.col("arg").alias("patient")).distinct()
    also = agents.select(KEY, "event_id", F.col("agent").alias("patient"), F.lit(True).alias("is_agent"))
    earned = facts.trust_earned.select(KEY, "event_id", F.col("dst").alias("patient"), F.lit(True).alias("earned")).distinct()
    patients = patients.join(also, [KEY, "event_id", "patient"], "left").join(earned, [KEY, "event_id", "patient"], "left")
    on = [KEY, "event_id"]
    out = e.join(marks, on, "left").join(caused, on, "left").join(places, on).join(agents, on, "left").join(patients, on, "left")
    none = F.array().cast("array<string>")
    return out.withColumn("marks", F.coalesce("marks", none)).fillna(False, ["caused", "is_agent", "earned"])


def cast(facts: Facts) -> DataFrame:
    """story_id, id and what is known of it: is_character, is_object, is_used, obj_types, traits, marks, died, murdered.

    ``died`` is the rank of the first death by dying or being killed, ``murdered`` also counts murder.
    """
    ids = facts.characters.select(KEY, "id").withColumn("is_character", F.lit(True))
    parts = [
        ids,
        facts.objects.select(KEY, "id", F.lit(True).alias("is_object"), "obj_type"),
        fluents.role_arg(facts).select(KEY, F.col("arg").alias("id"), F.lit(True).alias("is_used")),
        facts.traits.select(KEY, F.col("character").alias("id"), "trait"),
        rules.dead_after(facts, "general").select(KEY, F.col("character").alias("id"), F.col("t_ord").alias("died")),
        rules.dead_after(facts, "narrative").select(KEY, F.col("character").alias("id"), F.col("t_ord").alias("murdered")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    known = out.groupBy(KEY, "id").agg(
        flag("is_character"), flag("is_object"), flag("is_used"),
        F.collect_set("obj_type").alias("obj_types"), F.collect_set("trait").alias("traits"),
        F.min("died").alias("died"), F.min("murdered").alias("murdered"),
    )
    marks = _marks(facts, ENTITY_MARKS, "id")
    return known.join(marks, [KEY, "id"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<string>")))


def ties(facts: Facts) -> DataFrame:
    """story_id, agent, patient, rels: what the one feels for the other."""
    rows = facts.relationships.groupBy(KEY, F.col("src").alias("agent"), F.col("dst").alias("patient"))
    return rows.agg(F.collect_set("rel").alias("rels"))


def moods(facts: Facts) -> DataFrame:
    """story_id, agent, t_start, emotions of a character at a time."""
    rows = facts.emotional_states.groupBy(KEY, F.col("character").alias("agent"), F.col("t").alias("t_start"))
    return rows.agg(F.collect_set("emotion").alias("emotions"))


def stated(facts: Facts) -> DataFrame:
    """story_id, pred, arg, t, caused, initial: where stated fluents start, and whether by an event or from the beginning."""
    f = facts.fluents.select(KEY, "pred", "arg", F.col("t_start").alias("t")).distinct()
    caused = fluents.effects(facts, "pos").select(KEY, "pred", "arg", "t").distinct().withColumn("caused", F.lit(True))
    first = facts.initial_state.select(KEY, "pred", F.col("arg").alias("of")).distinct().withColumn("initial", F.lit(True))
    out = f.join(caused, [KEY, "pred", "arg", "t"], "left")
    same = (out[KEY] == first[KEY]) & (out["pred"] == first["pred"]) & out["arg"].eqNullSafe(first["of"])
    out = out.join(first, same, "left").select(out[KEY], out["pred"], "arg", "t", "caused", "initial")
    return out.fillna(False, ["caused", "initial"])


# --- passes


def _context(ruleset: str, kind: str) -> Column:
    return F.lit(K.CONTEXT.get(kind) if ruleset == "narrative" else None).cast("string")


def _hit(when: Column, ruleset: str, category: str, kind: str, subject: str, detail: Column | None = None, context: Column | None = None) -> Column:
    """A finding where ``when`` holds."""
    cells = {
        "category": F.lit(category),
        "type": F.lit(kind),
        "subject": F.col(subject).cast("string"),
        "detail": (F.lit(None) if detail is None else detail).cast("string"),
        "context": _context(ruleset, kind) if context is None else context,
    }
    return F.when(when, F.struct(*(c.alias(n) for n, c in cells.items())))


def _told(df: DataFrame, hits: list[Column]) -> DataFrame:
    """The findings of a pass, each once. A story is in one bucket, so telling them apart needs no exchange."""
    return df.select(KEY, F.explode(F.array_compact(F.array(*hits))).alias("x")).select(KEY, "x.*").distinct()


def _marked(mark: str) -> Column:
    return F.array_contains("marks", mark)


def acts_pass(store: FactStore, facts: Facts, ruleset: str) -> DataFrame:
    """Death, senses, food, feelings, moods, nearness and fears: all that an act and those who take part in it tell."""
    base, name = ruleset == "base", F.lit(None) if ruleset == "base" else F.col("agent")
    who = store.side("cast").select(KEY, F.col("id").alias("agent"), "traits", "died", "murdered")
    what = store.side("cast").select(KEY, F.col("id").alias("patient"), "is_character", "is_object", "obj_types", F.array_contains("marks", "edible_tool").alias("edible_tool"))
    d = store.table("deeds").join(who, [KEY, "agent"], "left").join(what, [KEY, "patient"], "left")
    d = d.join(store.side("ties"), [KEY, "agent", "patient"], "left")
    act, whom, verb = F.col("agent").isNotNull(), F.col("patient").isNotNull(), F.col("type")
    hits = [_hit(act & timeline.lt(F.col("murdered" if ruleset == "narrative" else "died"), F.col("start_ord")), ruleset, "coherence", "dead_agent", "event_id", name)]
    alias = {t: [t, *(old for old, new in K.TRAIT_NAMES.items() if new == t and base)] for t in K.NEEDS[ruleset]}
    for trait, verbs in K.NEEDS[ruleset].items():
        sense = {"blind": "sight", "deaf": "hearing", "mute": "speech"}.get(trait, "mobility")
        text = F.concat(F.initcap(F.lit(trait)), F.lit(f" character performs action requiring {sense}")) if ruleset == "narrative" else None
        has = F.arrays_overlap("traits", F.array(*map(F.lit, alias[trait])))
        hits.append(_hit(act & verb.isin(list(verbs)) & has, ruleset, "coherence", "physical_impossibility", "event_id", None if base else F.lit(trait), text))
    kinds = F.col("obj_types") if ruleset != "narrative" else F.when(F.col("edible_tool"), F.array_remove("obj_types", "tool")).otherwise(F.col("obj_types"))
    bad, good = (F.arrays_overlap(k, F.array(*map(F.lit, v[ruleset]))) for k, v in ((kinds, K.NON_EDIBLE), (F.col("obj_types"), K.EDIBLE)))
    food = F.coalesce(F.col("is_object") & (~bad | good), F.lit(False))
    ate = F.when(verb == "consume", "Character attempts to consume something inedible").otherwise(_context(ruleset, "non_edible_food")) if ruleset == "narrative" else None
    hits.append(_hit(whom & verb.isin(K.EATING[ruleset]) & ~food, ruleset, "coherence", "non_edible_food", "event_id", None if base else F.col("patient"), ate))
    if base:
        fears = lambda t: F.arrays_overlap("traits", F.array(F.lit(t), *(F.lit(o) for o, n in K.TRAIT_NAMES.items() if n == t)))
        place = F.col("location")
        hits += [
            _hit(act & (verb == "enter") & place.isin(K.ENCLOSED) & fears("claustrophobic"), ruleset, "coherence", "claustrophobia", "event_id"),
            _hit(act & place.isin(K.HIGH) & fears("acrophobic"), ruleset, "coherence", "acrophobia", "event_id"),
            _hit(act & ((verb == "swim") | F.coalesce(place.isin(K.WATER), F.lit(False))) & fears("aquaphobic"), ruleset, "coherence", "aquaphobia", "event_id"),
        ]
        return _told(d, hits)
    d = d.join(store.side("moods"), [KEY, "agent", "t_start"], "left")
    felt = lambda rel, kind, verbs, marks: _hit(act & whom & verb.isin(verbs) & F.array_contains("rels", rel) & ~F.arrays_overlap("marks", F.array(*map(F.lit, marks))), ruleset, "emotional", kind, "event_id", F.col("patient"))
    calm = ["forced_approach", "brave_moment"] if ruleset == "narrative" else ["forced_approach"]
    hits += [
        felt("loves", "harm_loved", K.HARMFUL[ruleset], ["justified_harm"]),
        felt("hates", "help_enemy", K.HELPFUL[ruleset], ["strategic_help"]),
        felt("fears", "approach_feared", K.APPROACH[ruleset], calm),
        _hit(act & whom & (verb == "trust") & F.array_contains("rels", "distrusts") & ~F.col("earned"), ruleset, "emotional", "misplaced_trust", "event_id", F.col("patient")),
    ]
    hits += [_hit(act & (verb == v) & F.array_contains("emotions", s), ruleset, "emotional", "state_action_mismatch", "event_id", F.lit(s)) for s, v in K.CONTRADICTS[ruleset]]
    elsewhere = F.size(F.array_except("places", F.array("location"))) > 0
    near = act & whom & F.col("location").isNotNull() & elsewhere & (F.col("is_agent") | F.coalesce("is_character", F.lit(False))) & ~_marked("allows_remote")
    hits.append(_hit(near, ruleset, "location", "proximity_required", "event_id", F.col("patient")))
    return _told(d, hits)


def pairs_pass(store: FactStore, facts: Facts, ruleset: str) -> DataFrame:
    """Acts of one character at one time: in two places, or both with focus."""
    cols = [KEY, "agent", "event_id", "location", "requires_focus", "start_ord", "end_ord"]
    acts = facts.acts().select(cols)
    both = timeline.together(acts, [KEY, "agent"], facts.bucket).where("a_event_id <> b_event_id").withColumnRenamed("a_story_id", KEY)
    first = F.col("a_event_id") < F.col("b_event_id")
    apart = F.col("a_location") != F.col("b_location")
    hits = [
        _hit(apart if ruleset == "base" else apart & first, ruleset, "location", "ubiquity", "a_event_id", F.col("b_event_id")),
        _hit(F.col("a_requires_focus") & F.col("b_requires_focus") & first, ruleset, "coherence", "focus_overlap", "a_event_id", F.col("b_event_id")),
    ]
    return _told(both, hits)


def things_pass(store: FactStore, facts: Facts, ruleset: str) -> DataFrame:
    """Objects that nothing is done with."""
    idle = F.col("is_object") & ~F.col("is_used") & ~_marked("decorative")
    if ruleset == "narrative":
        idle = idle & _marked("prominently_introduced")
    return _told(store.table("cast"), [_hit(idle, ruleset, "causality", "chekhov_gun", "id", F.col("id"))])


def events_pass(store: FactStore, facts: Facts, ruleset: str) -> DataFrame:
    """Events that end before they start, and significant ones without a cause."""
    known = F.col("caused") | _marked("initial_event")
    if ruleset == "narrative":
        known = known | _marked("background_event")
    hits = [
        _hit(timeline.lt(F.col("end_ord"), F.col("start_ord")), ruleset, "temporal", "negative_duration", "event_id", F.col("event_id")),
        _hit(_marked("significant_event") & ~known, ruleset, "causality", "uncaused_event", "event_id", F.col("event_id")),
    ]
    return _told(store.table("deeds"), hits)


def fluents_pass(store: FactStore, facts: Facts, ruleset: str) -> DataFrame:
    """Stated fluents that no event brings about."""
    alone = ~F.col("caused") & (~F.col("initial") if ruleset == "narrative" else F.lit(True))
    rows = store.table("stated").withColumn("text", rules.fluent_text())
    return _told(rows, [_hit(alone, ruleset, "causality", "effect_without_cause", "text", F.col("t"))])


#: The passes and the rulesets that have them.
PASSES: list[tuple[Callable[[FactStore, Facts, str], DataFrame], tuple[str, ...]]] = [
    (acts_pass, ("base", "general", "narrative")),
    (pairs_pass, ("base", "general", "narrative")),
    (things_pass, ("general", "narrative")),
    (events_pass, ("general", "narrative")),
    (fluents_pass, ("general", "narrative")),
]
#: Rules that no pass has, with the table without which they find nothing.
PLAIN = {
    "circular_time": "time_order",
    "explicit_order_violated": "must_precede",
    "impossible_travel": "location_graph",
    "precondition_not_met": None,
    "precondition_violated": None,
    "sudden_shift": "emotional_states",
}
