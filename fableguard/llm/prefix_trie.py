"""The prefix trie of conversations, from adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 16 bytes of a digest of its role and text, so a conversation is a byte string and a trie node a prefix of
whole ids. A node's name is made of four sums over its turns (each modulo a prime, the turns weighted by powers of a base),
so that a conversation can be cut into segments of bounded length whose names are found apart from each other. Tasks put
their segments into radix trees of bounded size; of a tree's nodes only those at whole turns are emitted, and what the
trees say of a node is combined by a plain sum: a prefix that very many conversations share is one row of each tree.

Sums over subtrees need no walk of the trie. The smallest member of a node owns it. Going down a conversation, its own
nodes follow on those of smaller ones, so every node of a subtree is an own node of exactly one member of the subtree's top,
and sums over the nodes become sums over the members, in a second pass of the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fableguard.llm.common import saved, table
from fableguard.llm.radix import Tree

WIDTH = 16
#: Moduli (the four largest primes below 2^31) and the bases whose powers weigh turns. A name has 4 bytes of each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 362436069, 521288629, 88675123)
#: Turns of a segment, turns of a radix tree, bytes of a piece of joined ids.
SEGMENT, TREE, PIECE = 1024, 65536, 1 << 20
LONGEST_BORROWED = 8

NODES = pa.schema(
    [("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("before", pa.int64())]
    + [(c, pa.int64()) for c in ("conv_id", "own", "n", "given", "leaves")]
)
NODES_DDL = "depth long, node binary, parent binary, before long, conv_id long, own long, n long, given long, leaves long"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id, size of every row with a conv_id: the turn's 16 bytes and the UTF-8 bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos from 0, id, size: each conversation's rows by turn (null first), then id.

    Ranges of (conv_id, turn, id) are numbered apart and moved up by what the ranges before hold, so a conversation
    of very many turns is the work of many tasks. Only one that spans ranges has an offset: two a range at most.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("id").asc()]
    dealt = rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    dealt = saved(dealt, "turns")
    held = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    same = Window.partitionBy("conv_id").orderBy("part")
    offsets = held.withColumn("offset", F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.where("offset > 0").select("conv_id", "part", "offset")
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("long")
    placed = dealt.withColumn("local", local).join(saved(offsets, "offsets"), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("local") - 1 + F.coalesce("offset", F.lit(0))).alias("pos"), "id", "size")


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base, if there are as many."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(rows: DataFrame) -> DataFrame:
    """rows (conv_id, pos, id, size) with the first turns of a conversation taken from conversation c - c % 5."""
    conv, own = F.col("conv_id"), F.col("conv_id") % 5
    convs = rows.where("pos = 0").select("conv_id", (conv - own).alias("base"), borrowed(conv).alias("take"))
    convs = convs.where("conv_id <> base")
    first = rows.where((own == 0) & (F.col("pos") < LONGEST_BORROWED))
    first = first.select(F.col("conv_id").alias("base"), "pos", "id", "size")
    given = convs.join(first, "base").where("pos < take").select("conv_id", "pos", "id", "size")
    have = first.groupBy("base").agg(F.count("*").alias("there"))
    kept = rows.where((own != 0) & (F.col("pos") >= borrowed(conv))).withColumn("base", conv - own).join(have, "base", "left")
    up = F.least(F.coalesce("there", F.lit(0)), borrowed(conv)) - borrowed(conv)
    kept = kept.select("conv_id", (F.col("pos") + up).alias("pos"), "id", "size")
    return rows.where(own == 0).select("conv_id", "pos", "id", "size").unionByName(given).unionByName(kept)


def _powers(start: int, n: int) -> np.ndarray:
    """base^(start + k) of each modulus, k below n, as (n, 4)."""
    out = np.empty((n, len(PRIMES)), np.int64)
    for j, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
        column = np.array([pow(base, start, p)], np.int64)
        while len(column) < n:  # twice as many each time
            column = np.concatenate([column, column * pow(base, len(column), p) % p])
        out[:, j] = column[:n]
    return out


def _terms(ids: bytes, start: int) -> np.ndarray:
    """What each turn adds to a name: (turns, 4)."""
    words = np.frombuffer(ids, ">u4").reshape(-1, len(PRIMES)).astype(np.int64) % PRIMES
    return words * _powers(start, len(words)) % PRIMES


def segments(turns: DataFrame, convs: DataFrame, length: int = SEGMENT) -> DataFrame:
    """conv_id, start, ids, sizes, at, before, total, last: a row for each ``length`` turns of a conversation.

    ``at`` is the name of the node where the segment starts, ``before`` the bytes of all turns before it; ``total`` and
    ``last`` are the conversation's bytes and the name of its last node. A conversation without turns has one empty segment.
    """
    packed = turns.groupBy("conv_id", F.floor(F.col("pos") / length).alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("t"))
    empty = convs.join(packed.where("k = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(None).alias("t"))
    packed = packed.unionByName(empty)
    rows = packed.select(
        "conv_id",
        (F.col("k") * length).alias("start"),
        F.coalesce(F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["id"])), "")), F.lit(b"")).alias("ids"),
        F.coalesce(F.transform("t", lambda x: x["size"]), F.array().cast("array<long>")).alias("sizes"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = [_terms(ids, start).sum(0) % PRIMES for ids, start in zip(pdf["ids"], pdf["start"], strict=True)]
            pdf[["s0", "s1", "s2", "s3"]] = np.array(sums, np.int64).reshape(-1, 4)
            yield pdf

    summed = rows.mapInPandas(run, "conv_id long, start long, ids binary, sizes array<long>, s0 long, s1 long, s2 long, s3 long")
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def name(over: Window) -> Column:
        parts = [F.lpad(F.hex(F.coalesce(F.sum(f"s{j}").over(over), F.lit(0)) % p), 8, "0") for j, p in enumerate(PRIMES)]
        return F.unhex(F.concat(*parts))

    bytes_of = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    out = summed.withColumn("bytes", bytes_of)
    return out.select(
        "conv_id", "start", "ids", "sizes",
        name(earlier).alias("at"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"),
        F.sum("bytes").over(whole).alias("total"),
        name(whole).alias("last"),
        (F.max(F.col("start") + F.size("sizes")).over(whole)).alias("length"),
    )


class _Forest:
    """One radix tree of segments. A key is the depth and name where a segment starts, in 24 bytes, then its turn ids."""

    LEAD = 24

    def __init__(self) -> None:
        self.tree, self.turns = Tree(), 0

    def add(self, conv: int, start: int, ids: bytes, sizes: np.ndarray, at: bytes, before: int, given: int, leaf: int) -> None:
        self.tree.insert(start.to_bytes(8, "big") + at + ids, conv, given, leaf, (start, ids, sizes, at, before))
        self.turns += len(sizes) + 1

    def emit(self) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in NODES]
        depths, nodes, parents, befores, *sums = columns
        for node, low, high in self.tree.nodes():
            # Turns end at these byte depths of the path; the start of a segment counts where it is the root.
            first, last = max(0, -(-(low + 1 - self.LEAD) // WIDTH)), (high - self.LEAD) // WIDTH
            start, ids, sizes, at, before = node.sample
            first += first == 0 and start > 0
            if high < self.LEAD or last < first:
                continue
            n = last - first + 1
            # Names down to the last turn of the path.
            base = np.frombuffer(at, ">u4").astype(np.int64)
            walk = np.vstack([base[None], _terms(ids[: last * WIDTH], start)]).cumsum(0) % PRIMES
            names = walk.astype(">u4").tobytes()
            passed = np.concatenate([[0], np.cumsum(sizes[:last])]) + before
            depths.extend(range(start + first, start + last + 1))
            nodes.extend(names[k * WIDTH : (k + 1) * WIDTH] for k in range(first, last + 1))
            parents.extend(names[(k - 1) * WIDTH : k * WIDTH] if k else b"" for k in range(first, last + 1))
            befores.extend(int(passed[k - 1]) if k else 0 for k in range(first, last + 1))
            for column, value in zip(sums, (node.least, node.own, node.n, node.given, node.leaves), strict=True):
                column.extend([value] * n)
            if len(depths) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODES, strict=True)], schema=NODES)
                for c in columns:
                    c.clear()
        if depths:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODES, strict=True)], schema=NODES)


def tree_nodes(weighted: DataFrame, turns: int = TREE) -> DataFrame:
    """Nodes of the whole trie with what they sum: depth, node, parent, before, conv_id, own, n, given, leaves.

    weighted: segments with ``given`` and ``leaves``. A tree holds about ``turns`` turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "start", "ids", "sizes", "at", "before", "given", "leaves")]
            for k in range(batch.num_rows):
                conv, start, ids, sizes, at, before, given, leaf = (c[k] for c in columns)
                forest.add(conv.as_py(), start.as_py(), ids.as_py(), sizes.values.to_numpy(), at.as_py(), before.as_py(), given.as_py(), leaf.as_py())
                if forest.turns >= turns:
                    yield from forest.emit()
                    forest = _Forest()
        yield from forest.emit()

    least = F.min(F.struct("conv_id", "own"))
    merged = weighted.mapInArrow(run, NODES_DDL).groupBy("depth", "node").agg(
        F.min("parent").alias("parent"), F.min("before").alias("before"), least.alias("least"),
        F.sum("n").alias("n"), F.sum("given").alias("given"), F.sum("leaves").alias("leaves"),
    )
    return merged.select("depth", "node", "parent", "before", "least.*", "n", "given", "leaves")


def ends(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """depth, node, ends_sha256 from members (depth, node, conv_id) that end there: their ids ascending, comma-joined.

    Ranges of sorted ids are joined to pieces of bounded size by many tasks; only hashing goes through a node's pieces in turn.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, size = None, [], 0
        for pdf in batches:
            out = []
            for depth, node, conv in zip(pdf["depth"], pdf["node"], pdf["conv_id"], strict=True):
                if (depth, node) != key or size >= piece:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids, size = (depth, node), [], 0
                ids.append(conv)
                size += 20
            yield pd.DataFrame(out, columns=["depth", "node", "first", "joined"])
        if ids:
            yield pd.DataFrame([(*key, ids[0], ",".join(map(str, ids)))], columns=["depth", "node", "first", "joined"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for depth, node, joined in zip(pdf["depth"], pdf["node"], pdf["joined"], strict=True):
                if (depth, node) == key:
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, node), hashlib.sha256()
                state.update(joined.encode())
            yield pd.DataFrame(out, columns=["depth", "node", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "node", "ends_sha256"])

    dealt = members.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    pieces = dealt.mapInPandas(join, "depth long, node binary, first long, joined string")
    by_node = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return by_node.mapInPandas(hashed, "depth long, node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, length: int = SEGMENT, tree: int = TREE, piece: int = PIECE) -> DataFrame:
    """A row per trie node of conversations given as turns (conv_id, pos from 0 without gaps, id, size) and convs (conv_id).

    Returns depth, node (16 bytes), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. convs holds every conversation once, those without turns too: they end at the root. Turns
    with equal id are equal. No conversation, no node. Conversations of any length and any number of equal ones are
    spread over tasks; ids fit longs.
    """
    held = saved(segments(turns, convs, length), "segments")
    plain = held.withColumn("given", F.lit(0).cast("long")).withColumn("leaves", F.lit(0).cast("long"))
    nodes = saved(tree_nodes(plain, tree).select("depth", "node", "parent", "before", "conv_id"), "nodes")
    kids = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node"))
    kids = saved(kids.groupBy("depth", "node").agg(F.count("*").alias("n_children")), "children")
    # What a conversation has from smaller ones: the bytes before its first own node, or all of them.
    owned = nodes.join(kids, ["depth", "node"], "left").groupBy("conv_id")
    owned = owned.agg(F.min(F.struct("depth", "before"))["before"].alias("given"), F.max(F.col("n_children").isNull().cast("long")).alias("leaves"))
    weighted = held.join(owned, "conv_id", "left").withColumn("given", F.coalesce("given", "total")).fillna({"leaves": 0})
    summed = tree_nodes(weighted, tree)
    tails = held.where(F.col("start") + F.size("sizes") == F.col("length"))
    closed = ends(tails.select(F.col("length").alias("depth"), F.col("last").alias("node"), "conv_id"), piece)
    out = summed.join(kids, ["depth", "node"], "left").join(closed, ["depth", "node"], "left")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # A parent of very many children is a hot key of this last join, whose side Spark splits.
    out = saved(out, "sums").join(above, ["depth", "parent"], "left")
    return out.select(
        "depth", "node", "conv_id", "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        # All that members have from smaller ones below the node's parent; the node's owner has its part from none of them.
        (F.col("given") - F.col("own") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_radix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations. Rows without conv_id take no part; rows of equal turn go by their turn ids."""
    rows = saved(numbered(turn_rows(table(spark, sf_dir, "conversations"))), "numbered")
    nodes = prefix_trie(rebuilt(rows), rows.where("pos = 0").select("conv_id"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = """list_reduce(range(8 * length(CAST({c} AS VARCHAR))), lambda crc, i: CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(CAST({c} AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) AS BIGINT)) ELSE crc END) % 2 = 1
  THEN xor((CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(CAST({c} AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) AS BIGINT)) ELSE crc END) // 2, CAST(3988292384 AS BIGINT))
  ELSE (CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(CAST({c} AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) AS BIGINT)) ELSE crc END) // 2 END, CAST(4294967295 AS BIGINT))"""

SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(struct_pack(id := id, size := octet_length(encode(text))) ORDER BY turn NULLS FIRST, id) AS turns,
         xor({_CRC.format(c="conv_id")}, CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM t GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, CASE WHEN o.conv_id % 5 = 0 THEN o.turns
         ELSE list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) END AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (
  SELECT conv_id, d AS depth, list_transform(turns[1:d], lambda x: x.id) AS path, turns[d].size AS size, len(turns) = d AS ended
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n, coalesce(max(size), 0) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.path),
below AS (
  SELECT path[1:d] AS path, CAST(sum((n - 1) * size) AS BIGINT) AS saved_tokens, CAST(sum(CAST(n_children = 0 AS BIGINT)) AS BIGINT) AS n_leaves
  FROM (SELECT path, n, size, n_children, unnest(range(depth + 1)) AS d FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON f.path = b.path LEFT JOIN full_nodes p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""
