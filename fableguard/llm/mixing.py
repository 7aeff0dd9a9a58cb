"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. Its whole part is taken as
it is; of its fraction p the pivotal method makes 0 or 1: two documents at a time pass words to each other, at random
and without bias, until one of them is whole. A chunk of documents so leaves one that is still a fraction; the chunks'
remainders meet in chunks of the next level, and so on up a reduction tree, until one is left per source. As words are
passed on and never lost, a source misses its target by less than one document.

Rows of a source that are equal in id and size can't be told apart, so they are one unit with a count: among n of them
with fraction p each, the method makes floor(n p) whole and leaves the rest of n p with one. Only that one meets others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fableguard.llm.common import WORD, repeated, saved, table, uniform

MOST = 3
FIELDS = ("h", "doc_id", "size", "whole", "source_size", "target", "p", "u")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_units) plus target: weights 1, 2, 3, repeating in code point order, null last.

    Where a share would exceed MOST times the source's size it stops there and the excess is shared again by weight:
    the level at which all shares sum up is found from the running sums of the sources ordered by cap per weight.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("most", MOST * F.col("source_size"))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most")) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", level).withColumn("at", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("at", "level"))).over(everything)
    share = F.least(F.col("most").cast("double"), F.coalesce(first["level"] * F.col("weight"), F.col("most").cast("double")))
    return leveled.select("source", "source_size", share.alias("target"))


def _with_p(unit: Column, p: Column) -> Column:
    return F.struct(*(unit[x].alias(x) for x in FIELDS if x not in ("p", "u")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), unit["u"].alias("u"))


def _meet(acc: Column, b: Column) -> Column:
    """Let the unit that acc still holds and unit b pass words to each other until one of them is whole."""
    a = acc["left"]
    room_a, has_a = (1 - a["p"]) * a["size"], a["p"] * a["size"]
    room_b, has_b = (1 - b["p"]) * b["size"], b["p"] * b["size"]
    to_a, to_b = F.least(room_a, has_b), F.least(has_a, room_b)
    up = b["u"] * (to_a + to_b) < to_b
    a_whole = F.when(up, room_a <= has_b).otherwise(has_a <= room_b)
    p_a = F.when(a_whole, F.when(up, 1.0).otherwise(0.0)).when(up, a["p"] + to_a / a["size"]).otherwise(a["p"] - to_b / a["size"])
    p_b = F.when(~a_whole, F.when(up, 0.0).otherwise(1.0)).when(up, b["p"] - to_a / b["size"]).otherwise(b["p"] + to_b / b["size"])
    a, b = _with_p(a, p_a), _with_p(b, p_b)
    return F.struct(F.array_append(acc["done"], F.when(a_whole, a).otherwise(b)).alias("done"), F.when(a_whole, b).otherwise(a).alias("left"))


def _draw(depth: int, seed: int, n: int) -> list[Column]:
    """What the n-th draw of a level depends on: the unit, the seed and the level, never the place of a row."""
    return [F.col("doc_id"), F.col("size"), F.col("source"), F.lit(seed), F.lit(3 * depth + n)]


def _level(units: DataFrame, chunk: Column, depth: int, seed: int) -> DataFrame:
    """(source, done, left) per chunk of units. Units are dealt to chunks by hash, so no chunk grows with the input."""
    # Large documents meet first, so that the one left over, and with it the miss, tends to be small.
    unit = F.struct((-F.col("size")).alias("h"), "doc_id", "size", "whole", "source_size", "target", "p", uniform(*_draw(depth, seed, 1)).alias("u"))
    grouped = units.groupBy("source", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(unit)).alias("units"))
    start = F.struct(F.expr(f"cast(array() as {dict(grouped.dtypes)['units']})").alias("done"), F.col("units")[0].alias("left"))
    others = F.slice("units", F.lit(2), F.size("units"))
    return grouped.select("source", F.aggregate(others, start, _meet).alias("out")).select("source", "out.done", "out.left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, chunk: int = 256) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    A null text has size 0 and takes no words (0 copies); a null source is a source of its own, last in order.
    Ids may be of any type that can be sorted, missing or repeated; repeated rows count one by one. An empty table gives
    no rows. Draws depend on id, size, source and seed alone, so reruns agree.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(source_col).alias("source"))
    base = saved(base.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "mix-units")
    sizes = saved(base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_units")), "mix-sources")
    targets = source_targets(sizes.drop("n_units"))
    counts = sizes.select("source", "n_units")
    most = sizes.agg(F.max("n_units")).first()[0] or 0
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t, c = targets.withColumnRenamed("source", "t_source"), counts.withColumnRenamed("source", "c_source")
    plan = t.join(c, F.col("t_source").eqNullSafe(F.col("c_source"))).drop("c_source")
    units = base.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("share", share)
    units = units.withColumns({"whole": F.when(F.col("size") == 0, 0).otherwise(F.floor("share")).cast("long"), "mass": F.when(F.col("size") == 0, 0.0).otherwise((F.col("share") - F.floor("share")) * F.col("n"))})
    units = units.withColumn("more", F.floor("mass")).withColumn("p", F.col("mass") - F.col("more"))
    # Of a unit's rows `more` take one copy more than the whole part, one is open if a fraction is left.
    shares = F.array(F.struct((F.col("whole") + 1).alias("copies"), F.col("more").alias("rows")), F.struct(F.col("whole").alias("copies"), (F.col("n") - F.col("more") - (F.col("p") > 0).cast("long")).alias("rows")))
    fixed = units.select("doc_id", "size", "source_size", "target", F.explode(shares).alias("x"))
    result = [repeated(fixed.select("doc_id", "size", "source_size", "target", "x.copies", "x.rows"), "rows")]
    open_units, depth, n = units.where("p > 0").select("source", "n_units", "doc_id", "size", "source_size", "target", "whole", "p"), 0, most
    while True:
        chunks = F.ceil(F.col("n_units") / F.lit(float(chunk) ** (depth + 1)))
        where = F.pmod(F.xxhash64(*_draw(depth, seed, 2)), F.greatest(chunks, F.lit(1)))
        out = saved(_level(open_units, where, depth, seed), f"mix-level-{depth}")
        done = out.select(F.explode("done").alias("x"))
        n = -(-n // chunk)
        if n <= 1:
            last = out.select(F.col("left").withField("p", (F.col("left.u") < F.col("left.p")).cast("double")).alias("x"))
            done = done.unionByName(last)
        result.append(done.select("x.doc_id", "x.size", "x.source_size", "x.target", (F.col("x.whole") + F.col("x.p").cast("long")).alias("copies")))
        if n <= 1:
            break
        rest = out.select("source", "left.*").drop("h", "u")
        open_units = rest.join(c, F.col("source").eqNullSafe(F.col("c_source"))).drop("c_source")
        depth += 1
    whole = result[0]
    for x in result[1:]:
        whole = whole.unionByName(x)
    return whole.withColumn("taken", F.col("copies") * F.col("size"))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
