"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard has a preference order over the slots of a prime-sized table. The shards take turns (a shard of weight w
takes w slots a turn) and claim their next free slot until the table is full. A key's hash picks a slot and the
broadcast table its shard, so placement takes constant time; when shards come or go few slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.llm.common import table

#: A prime, about 1000 slots for each of 64 shards. The table's size bounds what is broadcast.
SLOTS = 65537


def preference(name: str, slots: int) -> tuple[int, int]:
    """Where a shard's preference order starts, and by how much it steps."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def lookup_table(shards: dict[str, int] | list[str], slots: int = SLOTS) -> list[int]:
    """The shard number (in the order given) of each slot. ``slots`` must be a prime above the number of shards."""
    weights = shards if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or len(weights) > slots or any(w < 1 for w in weights.values()):
        raise ValueError("one shard at least, not more shards than slots, whole weights from 1")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime, not {slots}")
    owner = [-1] * slots
    free, turns = slots, [[*preference(name, slots), w] for name, w in weights.items()]
    while True:
        for k, turn in enumerate(turns):
            at, step, weight = turn
            for _ in range(weight):
                while owner[at] >= 0:
                    at = (at + step) % slots
                owner[at] = k
                free -= 1
                if not free:
                    return owner
            turn[0] = at


def slot_of(key: Column, slots: int) -> Column:
    """A key's slot. A null key counts as the empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def shard(df: DataFrame, key_cols: list[str], shards: dict[str, int] | list[str], slots: int = SLOTS, salt_cols: list[str] | None = None) -> DataFrame:
    """df's key columns with slot, shard and shard_name: one row per input row, no shuffle.

    Rows of one key share a shard. Where a key may hold a large part of all rows, name columns that tell its rows
    apart as ``salt_cols``: they join the key, and the rows spread over all shards. Null keys count as empty, repeated
    rows are placed one by one, an empty table gives no rows. A key column named slot, shard or shard_name is returned
    as key_slot, key_shard or key_shard_name.
    """
    names = list(shards)
    owners = lookup_table(shards, slots)
    filled = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owners))), ",")).alias("slot", "shard"))
    own = ("slot", "shard", "shard_name")
    filled = filled.select("slot", F.col("shard").cast("int").alias("shard"), F.element_at(F.array(*map(F.lit, names)), F.col("shard").cast("int") + 1).alias("shard_name"))
    kept = [*key_cols, *(salt_cols or [])]
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kept))
    keyed = df.select(slot_of(key, slots).alias("slot"), *(F.col(c).alias(f"key_{c}" if c in own else c) for c in kept))
    return keyed.join(F.broadcast(filled), "slot").select(*(c for c in keyed.columns if c != "slot"), *own)


SHARDS = [f"shard-{k:02d}" for k in range(64)]


def op1_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places every document by doc_id, so that a source with a third of all rows still spreads evenly."""
    return shard(table(spark, sf_dir, "documents"), ["doc_id"], SHARDS)


def sql() -> str:
    """The table as it must be, as a list in SQL (turn by turn, from each shard's whole preference list)."""
    orders = {k: [(start + i * step) % SLOTS for i in range(SLOTS)] for k, (start, step) in enumerate(preference(n, SLOTS) for n in SHARDS)}
    owner: dict[int, int] = {}
    pointer = dict.fromkeys(orders, 0)
    while len(owner) < SLOTS:
        for k, order in orders.items():
            while pointer[k] < SLOTS and order[pointer[k]] in owner:
                pointer[k] += 1
            if len(owner) < SLOTS:
                owner[order[pointer[k]]] = k
    owners = ",".join(str(owner[s]) for s in range(SLOTS))
    return f"""
WITH filled AS (SELECT [{owners}] AS owners),
placed AS (SELECT doc_id, (('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, owners[slot + 1]::INTEGER AS shard, printf('shard-%02d', owners[slot + 1]) AS shard_name FROM placed, filled
"""
