"""The bundle of fact tables that rules read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.functions import knowledge as K

#: Columns of each table; optional ones default to empty tables. ``event_id`` takes the events' own type.
SCHEMAS = {
    "characters": "story_id string, id string",
    "objects": "story_id string, id string, obj_type string",
    "locations": "story_id string, id string",
    "fluents": "story_id string, pred string, arg string, args array<string>, t_start TIME, t_end TIME, start_ord bigint, end_ord bigint",
    "time_points": "story_id string, t bigint, t_ord bigint",
    "traits": "story_id string, character string, trait string",
    "relationships": "story_id string, rel string, src string, dst string",
    "emotional_states": "story_id string, character string, emotion string, t bigint, t_ord bigint",
    "location_graph": "scope string, relation string, src string, dst string",
    "causal_chain": "story_id string, cause EVENT, effect EVENT",
    # hooks: a row exempts, or marks, what it names
    "significant_event": "story_id string, event_id EVENT",
    "initial_event": "story_id string, event_id EVENT",
    "background_event": "story_id string, event_id EVENT",
    "decorative": "story_id string, id string",
    "prominently_introduced": "story_id string, id string",
    "mentioned_object": "story_id string, id string",
    "mentioned_in_event": "story_id string, id string",
    "edible_tool": "story_id string, id string",
    "explicitly_inedible": "story_id string, id string",
    "initial_state": "story_id string, pred string, arg string",
    "justified_harm": "story_id string, event_id EVENT",
    "strategic_help": "story_id string, event_id EVENT",
    "forced_approach": "story_id string, event_id EVENT",
    "brave_moment": "story_id string, event_id EVENT",
    "trust_earned": "story_id string, dst string, event_id EVENT",
    "trust_restored": "story_id string, src string, dst string, event_id EVENT",
    "involves_trust": "story_id string, event_id EVENT",
    "allows_remote": "story_id string, event_id EVENT",
    "requires_proximity": "story_id string, event_id EVENT",
    "object_location": "story_id string, id string, location string, event_id EVENT",
    "must_precede": "story_id string, e1 EVENT, e2 EVENT",
    "emotional_trigger": "story_id string, character string, t1 bigint, t2 bigint",
    "time_order": "story_id string, t1 TIME, t2 TIME",
    "location_types": "story_id string, location string, kind string",
    "duration_constraint": "type string, low bigint, high bigint",
    "travel_time": "scope string, src string, dst string, min_time bigint",
    "effects": "scope string, type string, polarity string, prop string, role string",
    "preconditions": "scope string, type string, polarity string, prop string, role string",
    "names": "story_id string, id string, name string",
}


@dataclass
class Facts:
    """events: story_id, event_id, type, location, t_start, t_end, start_ord, end_ord, requires_focus.

    event_role: story_id, event_id, role, arg. Ords rank the time points of a story; null ones are comparable with none.
    ``bucket`` is the width, in ords, of the cells that interval joins look rows up in. ``scope`` is the story
    that a rule or a distance belongs to, or ``*`` where it belongs to all.
    Where the source tells a pair of ``must_precede`` in one row with its times, the pair is there once and has the columns ``ends``,
    the latest end of e1, and ``starts``, the earliest start of e2.
    ``told`` has acts of all the roles that event_role has, where the source tells events and roles in one row; ``source`` is
    the table that all of these are columns of.
    """

    spark: SparkSession
    events: DataFrame
    event_role: DataFrame
    bucket: int = 64
    tables: dict[str, DataFrame] = field(default_factory=dict)
    kept: dict[str, DataFrame] | None = None
    held: list[DataFrame] = field(default_factory=list)
    told: dict[str, DataFrame] = field(default_factory=dict)
    source: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            table = tables[name]
            if name == "fluents" and "args" not in table.columns:
                return table.withColumn("args", F.array("arg"))
            return table
        if name == "effects":
            return everywhere(small(self.spark, K.EFFECTS, "type", "polarity", "prop", "role"))
        if name == "preconditions":
            return everywhere(small(self.spark, K.PRECONDITIONS, "type", "polarity", "prop", "role"))
        if name in SCHEMAS:
            types = dict(self.events.dtypes)
            kinds = (x.split(" ") for x in SCHEMAS[name].replace("EVENT", types["event_id"]).replace("TIME", types["t_start"]).split(", "))
            # known to be empty when planned, so that joins with it cost nothing
            return self.spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {c}" for c, k in kinds) + " WHERE false")
        raise AttributeError(name)

    def has(self, name: str) -> bool:
        return name in self.tables

    def release(self) -> None:
        """Let go what rules.once and structured.load keep of these facts; they can still be read, from their source."""
        for df in (self.events, self.event_role, *(self.kept or {}).values(), *self.held):
            df.unpersist()

    def acts(self, role: str = "agent") -> DataFrame:
        """The events with one row per participant in ``role``."""
        if self.kept and role in self.kept:
            return self.kept[role]
        if role in self.told:
            return self.told[role]
        who = self.event_role.where(F.col("role") == role).select("story_id", "event_id", F.col("arg").alias(role))
        return self.events.join(who, ["story_id", "event_id"])


def everywhere(table: DataFrame) -> DataFrame:
    """A table of rules or distances that belong to all stories."""
    return table.select(F.lit("*").alias("scope"), "*")


def in_scope(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """df (story_id, ...) joined with the rows of table (scope, ...) that belong to its story or to all stories.

    Two equi-joins; what a story and all stories have in common is found twice.
    """
    own = table.where("scope <> '*'").withColumnRenamed("scope", "story_id")
    return df.join(own, ["story_id", *on]).unionByName(df.join(table.where("scope = '*'").drop("scope"), on))


def small(spark: SparkSession, rows: list[tuple[str, ...]], *names: str) -> DataFrame:
    """A table of a few fixed rows, as SQL values."""
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
