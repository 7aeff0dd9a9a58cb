"""Time points, their order, and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fableguard.plans.facts import Facts


def lt(a: Column, b: Column) -> Column:
    """Whether a is before b; false where either has no rank."""
    return F.coalesce(a < b, F.lit(False))


def time_points(facts: Facts) -> DataFrame:
    """story_id, t, t_ord of all times of events and fluents."""
    ends = [(facts.events, "t_start", "start_ord"), (facts.events, "t_end", "end_ord"), (facts.fluents, "t_start", "start_ord"), (facts.fluents, "t_end", "end_ord")]
    parts = [d.select("story_id", F.col(t).alias("t"), F.col(o).alias("t_ord")) for d, t, o in ends]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("t is not null").groupBy("story_id", "t").agg(F.max("t_ord").alias("t_ord"))


def before(points: DataFrame) -> DataFrame:
    """story_id, t1, t2 for all ranked pairs in order."""
    a, b = (points.select("story_id", F.col("t").alias(f"t{k}"), F.col("t_ord").alias(f"o{k}")) for k in (1, 2))
    return a.join(b, "story_id").where("o1 < o2").select("story_id", "t1", "t2")


def closure(edges: DataFrame) -> DataFrame:
    """The transitive closure of edges (story_id, t1, t2), by squaring; cycles give pairs of a point with itself.

    Every round doubles the length of the paths covered; each is cut off by a checkpoint that survives lost executors.
    """
    known = edges.select("story_id", "t1", "t2").distinct().checkpoint()
    size = known.count()
    while True:
        step = known.join(known.select("story_id", F.col("t1").alias("t2"), F.col("t2").alias("t3")), ["story_id", "t2"]).select("story_id", "t1", F.col("t3").alias("t2"))
        known = known.unionByName(step).distinct().checkpoint()
        if (grown := known.count()) == size:
            return known
        size = grown


#: Levels of what has no bounds, or no rank: one node that all of its keys meet.
OPEN, UNRANKED = 100, 101
NODE = "array<struct<level:int,node:bigint>>"
LEAST = -(2**63)
#: Rows of a node that are packed into one block at most.
BLOCK = 1024


def _cell(c: Column, bucket: int) -> Column:
    """The number of the cell of ``bucket`` ords that c lies in, rounded down."""
    return F.call_function("div", c - F.pmod(c, F.lit(bucket)), F.lit(bucket))


def cover(low: str, high: str, top: str) -> Column:
    """The dyadic nodes (level, node) that make up the cells from low to high, columns: at most two a level."""
    left, right = "s.l < s.r and (s.l & 1L) = 1L", "s.l + (s.l & 1L) < s.r and (s.r & 1L) = 1L"
    return F.expr(f"""aggregate(sequence(0, {top}),
      named_struct('l', {low}, 'r', {high} + 1L, 'n', cast(array() as {NODE})),
      (s, k) -> named_struct(
        'l', shiftright(s.l + (s.l & 1L), 1), 'r', shiftright(s.r - (s.r & 1L), 1),
        'n', concat(s.n, filter(array(
          if({left}, named_struct('level', k, 'node', s.l), null),
          if({right}, named_struct('level', k, 'node', s.r - 1L), null)), x -> x is not null))),
      s -> s.n)""")


def ancestors(cell: str, top: str) -> Column:
    """The dyadic nodes (level, node) above a cell, itself included: one a level."""
    return F.expr(f"transform(sequence(0, {top}), k -> named_struct('level', k, 'node', shiftright({cell}, k)))")


def quarters(cell: str, top: str, later: bool) -> Column:
    """The nodes (level, node) at which a cell meets the later, or earlier, cells of equal keys; every two cells share exactly one.

    Time is cut in four, again and again: two cells part at one level, and their node there is named by both of their quarters, so
    that no node has more than an eighth of a story's pairs unless time is uneven. Level 0 is the cell itself.
    """
    digit = f"(shiftright({cell}, 2 * k) & 3L)"
    part = f"shiftright({cell}, 2 * k + 2) * 16 + " + ("e * 4 + " + digit if later else digit + " * 4 + e")
    return F.expr(f"""concat(array(named_struct('level', 0, 'node', {cell})), flatten(transform(sequence(0, {top}), k -> transform(
      filter(array(0L, 1L, 2L, 3L), e -> e {'<' if later else '>'} {digit}), e -> named_struct('level', k + 1, 'node', {part})))))""")


def _node_if(where: Column, level: int) -> Column:
    return F.when(where, F.expr(f"cast(array(named_struct('level', {level}, 'node', 0L)) as {NODE})")).otherwise(F.expr(f"cast(array() as {NODE})"))


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, bucket: int, loose: bool = True) -> DataFrame:
    """Points with the intervals of equal keys whose cells reach theirs; but for the keys their columns differ.

    A dyadic index: an interval is at most two nodes a level, a point one node a level. Of an interval's nodes only one lies
    above a point, so an equi-join meets every pair once, and an interval as long as its story costs some twice log n rows.
    An interval that lacks a bound meets every point. A point without rank meets every interval, or, unless ``loose``, only
    those that lack a bound. The caller tests the exact bounds.
    """
    own, known = _at_nodes(points, intervals, at, low, high, bucket, loose)
    return own.join(known, [*keys, "level", "node"]).drop("level", "node")


def _at_nodes(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, bucket: int, loose: bool) -> tuple[DataFrame, DataFrame]:
    """Points and intervals once for each of their nodes (level, node)."""
    ends = _cell(F.col(low), bucket), _cell(F.col(high), bucket)
    bounded = F.col(low).isNotNull() & F.col(high).isNotNull()
    first, last = F.when(bounded, F.least(*ends)), F.when(bounded, F.greatest(*ends))
    level = F.ceil(F.log2(F.max(last - first + 1).cast("double"))).cast("int") + 1
    # One row: the highest level that a cover may need, and whether any interval is open.
    sizes = intervals.agg(F.coalesce(level, F.lit(0)).alias("top_"), F.coalesce(F.bool_or(~bounded), F.lit(False)).alias("open_"))
    known = intervals.crossJoin(F.broadcast(sizes)).withColumns({"first_": first, "last_": last})
    unranked = F.lit(False)
    if loose:
        known = known.crossJoin(F.broadcast(points.agg(F.coalesce(F.bool_or(F.col(at).isNull()), F.lit(False)).alias("unranked_"))))
        unranked = F.col("unranked_")
    down = F.when(F.col("first_").isNull(), _node_if(F.lit(True), OPEN)).otherwise(F.concat(cover("first_", "last_", "top_"), _node_if(unranked, UNRANKED)))
    own = points.crossJoin(F.broadcast(sizes)).withColumn("cell_", _cell(F.col(at), bucket))
    up = F.when(F.col("cell_").isNull(), _node_if(F.lit(loose), UNRANKED)).otherwise(ancestors("cell_", "top_"))
    own = own.withColumn("at_", F.explode(F.concat(up, _node_if(F.col("open_"), OPEN)))).select(*points.columns, "at_.level", "at_.node")
    known = known.withColumn("at_", F.explode(down)).select(*intervals.columns, "at_.level", "at_.node")
    return own, known


def _met_in_blocks(rows: DataFrame, others: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows with each block of the others (a list, ``ys_``) of equal keys and node.

    A block has ``block`` rows at most, so that a join holds and hands on one row for many pairs; what is in it stays the same if
    its task is run again. Nodes are dealt by number: by their bytes, which pairs don't show in, few tasks would get them all.
    """
    at, n = [*keys, "level", "node"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [c for c in others.columns if c not in at]
    number = F.row_number().over(Window.partitionBy(*at).orderBy(*own))
    packed = others.repartition(n, *at).withColumn("block_", F.floor((number - 1) / block)).groupBy(*at, "block_")
    packed = packed.agg(F.collect_list(F.struct(*own)).alias("ys_"))
    return rows.repartition(n, *at).join(packed, at).drop("level", "node", "block_")


def _sides(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    a, b = (df.select(*(F.col(k).alias(f"key{n}_") for n, k in enumerate(keys)), *(F.col(c).alias(f"{p}_{c}") for c in df.columns)) for p in "ab")
    return a, b


def together(df: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of rows of equal keys whose intervals (start_ord, end_ord) overlap, both ways round, prefixed a_ and b_.

    Intervals are closed; what has no rank overlaps with everything. A row is found by its start within the other's interval and
    turned round; where both start in one cell each finds the other. A row also overlaps with itself.
    """
    a, b = _sides(df, keys)
    ranked = F.col("a_start_ord").isNotNull() & F.col("a_end_ord").isNotNull()
    a = a.withColumn("from_", F.when(ranked, F.least("a_start_ord", "a_end_ord")))
    met = stab(a, b, [f"key{n}_" for n in range(len(keys))], "from_", "b_start_ord", "b_end_ord", bucket, loose=False)
    met = met.where(~lt(F.col("a_end_ord"), F.col("b_start_ord")) & ~lt(F.col("b_end_ord"), F.col("a_start_ord")))
    other = F.when(F.col("b_start_ord").isNotNull() & F.col("b_end_ord").isNotNull(), F.least("b_start_ord", "b_end_ord"))
    start = lambda c: F.coalesce(_cell(c, bucket), F.lit(LEAST))
    ways = F.when(start(other) < start(F.col("from_")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    met = met.withColumn("turned_", F.explode(ways))
    key = {k: F.col(f"key{n}_") for n, k in enumerate(keys)}  # the same on both sides, and what the rows are dealt by
    turned = lambda x, y, c: F.when(F.col("turned_"), F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}"))
    side = lambda x, y, c: (key[c] if c in key else turned(x, y, c)).alias(f"{x}_{c}")
    return met.select(*(side("a", "b", c) for c in df.columns), *(side("b", "a", c) for c in df.columns))


def together_by_agent(df: DataFrame, keys: list[str], bucket: int, few: int = 64) -> DataFrame:
    """What ``together`` gives, for keys that most often have few rows, such as a character's in a story.

    The rows of a key that has ``few`` at most meet each other at once, by one exchange of the rows as they are; the index, which
    copies a row once a level, is left to the busy keys.
    """
    busy = df.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") > few).select(*keys)
    a, b = _sides(df.join(busy, keys, "left_anti"), keys)
    on = [f"key{n}_" for n in range(len(keys))]
    met = a.join(b, on).where(~lt(F.col("a_end_ord"), F.col("b_start_ord")) & ~lt(F.col("b_end_ord"), F.col("a_start_ord")))
    key = {k: F.col(n) for n, k in zip(on, keys, strict=True)}
    direct = met.select(*(key[c].alias(f"{p}_{c}") if c in key else f"{p}_{c}" for p in "ab" for c in df.columns))
    return direct.unionByName(together(df.join(busy, keys, "left_semi"), keys, bucket))


def in_order(df: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of rows of equal keys, prefixed a_ and b_, where a ends before b starts; what has no rank precedes nothing.

    b's start is looked up in the time after a's end.
    """
    a, b = _sides(df, keys)
    last = df.agg(F.max("start_ord").alias("last_start_"))  # one row
    a = a.where("a_end_ord is not null").crossJoin(F.broadcast(last)).where("a_end_ord < last_start_")
    found = stab(b.where("b_start_ord is not null"), a, [f"key{n}_" for n in range(len(keys))], "b_start_ord", "a_end_ord", "last_start_", bucket)
    return found.where("a_end_ord < b_start_ord").select(*(f"{p}_{c}" for p in "ab" for c in df.columns))


def together_by_story(df: DataFrame, keys: list[str], bucket: int, block: int = BLOCK) -> DataFrame:
    """What ``together`` gives, for keys of very many rows, such as a story's events: rows meet blocks of rows."""
    ranked = F.col("start_ord").isNotNull() & F.col("end_ord").isNotNull()
    rows = df.withColumn("from_", F.when(ranked, F.least("start_ord", "end_ord")))
    rows = rows.withColumn("cell_at_", F.coalesce(_cell(F.col("from_"), bucket), F.lit(LEAST)))
    points, intervals = _at_nodes(rows, rows, "from_", "start_ord", "end_ord", bucket, loose=False)
    met = _met_in_blocks(points.drop("from_"), intervals.drop("from_"), keys, block)
    met = met.withColumn("turned_", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("y", F.explode("ys_"))
    met = met.where(~lt(F.col("end_ord"), F.col("y.start_ord")) & ~lt(F.col("y.end_ord"), F.col("start_ord")))
    met = met.where(~F.col("turned_") | (F.col("y.cell_at_") < F.col("cell_at_")))
    side = lambda c, turned: F.col(c) if c in keys else F.when(F.col("turned_") == turned, F.col(f"y.{c}")).otherwise(F.col(c))
    return met.select(*(side(c, p == "a").alias(f"{p}_{c}") for p in "ab" for c in df.columns))


def in_order_by_story(df: DataFrame, keys: list[str], bucket: int, block: int = BLOCK) -> DataFrame:
    """What ``in_order`` gives, without the ords, for keys of very many rows, such as a story's events: rows meet blocks of rows.

    The cell in which a ends and the one in which b starts meet at one node of ``quarters``.
    """
    cell = lambda c: _cell(F.col(c), bucket)
    low, high = F.min(F.least(cell("start_ord"), cell("end_ord"))), F.max(F.greatest(cell("start_ord"), cell("end_ord")))
    size = df.agg(low.alias("low_"), F.coalesce(F.ceil(F.log2((high - low + 1).cast("double")) / 2).cast("int"), F.lit(0)).alias("top_"))  # one row
    told = [c for c in df.columns if c not in ("start_ord", "end_ord")]

    def at(ord_: str, later: bool) -> DataFrame:
        rows = df.where(F.col(ord_).isNotNull()).crossJoin(F.broadcast(size)).withColumn("cell_", cell(ord_) - F.col("low_"))
        return rows.withColumn("at_", F.explode(quarters("cell_", "top_", later))).select(*told, ord_, "at_.level", "at_.node")

    met = _met_in_blocks(at("end_ord", False), at("start_ord", True), keys, block).withColumn("y", F.explode("ys_")).where("end_ord < y.start_ord")
    return met.select(*(F.col(c if c in keys or p == "a" else f"y.{c}").alias(f"{p}_{c}") for p in "ab" for c in told))


def soon_after(acts: DataFrame, most: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of intervals of the same keys, prefixed a_ and b_, where b starts after a's end by less than ``most`` (a row).

    Time is cut in slices as wide as ``most``: b starts in the slice in which a ends or in the next one.
    """
    wide = F.greatest(F.coalesce("most", F.lit(1)), F.lit(1))
    a = acts.select(*(F.col(c).alias(f"a_{c}") for c in acts.columns)).crossJoin(F.broadcast(most))
    b = acts.select(*(F.col(c).alias(f"b_{c}") for c in acts.columns)).crossJoin(F.broadcast(most)).withColumn("b_slice", F.floor(F.col("b_start_ord") / wide)).drop("most")
    at = F.floor(F.col("a_end_ord") / wide)
    a = a.where("a_end_ord is not null").withColumn("a_slice", F.explode(F.array(at, at + 1)))
    same = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    took = F.col("b_start_ord") - F.col("a_end_ord")
    return a.join(b, [*same, F.col("a_slice") == F.col("b_slice"), took > 0, took < F.col("most")]).drop("a_slice", "b_slice", "most")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_story_id").alias("story_id"), F.col("a_event_id").alias("e1"), F.col("b_event_id").alias("e2"))


def overlap(facts: Facts) -> DataFrame:
    """story_id, e1, e2 of overlapping events, both ways round."""
    e = facts.events.select("story_id", "event_id", "start_ord", "end_ord")
    return _named(together_by_story(e, ["story_id"], facts.bucket).where("a_event_id <> b_event_id"))


def precedes(facts: Facts) -> DataFrame:
    """story_id, e1, e2 where e1 ends before e2 starts."""
    e = facts.events.select("story_id", "event_id", "start_ord", "end_ord")
    return _named(in_order_by_story(e, ["story_id"], facts.bucket))


def meets(facts: Facts) -> DataFrame:
    """story_id, e1, e2 where e1 ends at the point at which e2 starts."""
    a = facts.events.select("story_id", F.col("event_id").alias("e1"), F.col("t_end").alias("t"))
    b = facts.events.select("story_id", F.col("event_id").alias("e2"), F.col("t_start").alias("t"))
    return a.join(b, ["story_id", "t"]).where("e1 <> e2").select("story_id", "e1", "e2")


def meets_count(facts: Facts) -> DataFrame:
    """story_id, n: how many pairs ``meets`` has, for stories that have any.

    Counted by point, ends times starts, without what an event makes with itself, so that the work grows with the events.
    """
    e = facts.events.where("event_id is not null")
    ends = e.select("story_id", "event_id", F.col("t_end").alias("t"), F.lit(1).cast("long").alias("ends"), F.lit(0).cast("long").alias("starts"))
    starts = e.select("story_id", "event_id", F.col("t_start").alias("t"), F.lit(0).cast("long").alias("ends"), F.lit(1).cast("long").alias("starts"))
    each = ends.unionByName(starts).where("t is not null").groupBy("story_id", "t", "event_id").agg(F.sum("ends").alias("ends"), F.sum("starts").alias("starts"))
    at = each.groupBy("story_id", "t").agg((F.sum("ends") * F.sum("starts") - F.sum(F.col("ends") * F.col("starts"))).alias("n"))
    return at.where("story_id is not null").groupBy("story_id").agg(F.sum("n").alias("n")).where("n > 0")


def concurrent(facts: Facts) -> DataFrame:
    """story_id, e1, e2 of overlapping events, both ways round, each pair once.

    The pairs themselves are never shuffled to tell them apart: equal rows of events are made one before they meet, and of the
    pairs of an event told with several intervals the first one that overlaps stays.
    """
    span = F.struct("start_ord", "end_ord")
    e = facts.events.groupBy("story_id", "event_id").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    e = e.select("story_id", "event_id", F.when(F.size("spans") > 1, F.col("spans")).alias("spans"), F.explode("spans").alias("x"))
    both = together_by_story(e.select("story_id", "event_id", "spans", "x.*"), ["story_id"], facts.bucket).where("a_event_id <> b_event_id")
    own = {p: F.struct(F.col(f"{p}_start_ord").alias("start_ord"), F.col(f"{p}_end_ord").alias("end_ord")) for p in "ab"}
    a, b = (F.coalesce(f"{p}_spans", F.array(own[p])) for p in "ab")
    met = lambda x: F.filter(b, lambda y: ~lt(x["end_ord"], y["start_ord"]) & ~lt(y["end_ord"], x["start_ord"]))
    every = F.flatten(F.transform(a, lambda x: F.transform(met(x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    first = F.get(every, F.lit(0)).eqNullSafe(F.struct(own["a"].alias("a"), own["b"].alias("b")))
    return _named(both.where(F.when(F.col("a_spans").isNull() & F.col("b_spans").isNull(), True).otherwise(first)))


def symmetric(df: DataFrame) -> DataFrame:
    return df.unionByName(df.select("story_id", F.col("e2").alias("e1"), F.col("e1").alias("e2"))).distinct()
