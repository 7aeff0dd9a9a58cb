"""Streaming forms of per-character rules: findings as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dead_agent_stream(acts: DataFrame, late: str = "1 hour") -> DataFrame:
    """story_id, character, event_id of acts after the character's death, from a stream of acts.

    acts: story_id, character, event_id, died (whether the act is the character's death), ts. Events may come ``late``,
    in any order: a character's state is its earliest death, which stays, and the acts not after it that the watermark has
    not yet passed, as an earlier death can still arrive. An act without a time is never after a death.
    """

    def step(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, held_ts, held_id = state.get if state.exists else (None, [], [])
        acts = list(zip(held_ts, held_id, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                rows = rows[rows["ts"].notna()]
                micros = rows["ts"].astype("datetime64[us]").astype("int64")
                deaths = micros[rows["died"].fillna(False).astype(bool)]
                first = min([x for x in (first, *deaths.tolist()) if x is not None], default=None)
                acts += zip(micros.tolist(), rows["event_id"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        hit = sorted(x for x in acts if first is not None and x[0] > first)
        open_ = sorted(x for x in acts if x[0] >= passed and (first is None or x[0] <= first))
        if first is not None or open_:
            state.update((first, [x[0] for x in open_], [x[1] for x in open_]))
            if open_:
                state.setTimeoutTimestamp(max(open_[0][0] // 1000, passed // 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"story_id": key[0], "character": key[1], "event_id": [x[1] for x in hit]}).astype({"event_id": "int64"})

    stamped = acts.withWatermark("ts", late).select("story_id", "character", "event_id", "died", "ts")
    return stamped.groupBy("story_id", "character").applyInPandasWithState(step, "story_id string, character string, event_id long", "first long, held_ts array<long>, held_id array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def activity_stream(acts: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """story_id, start, n: acts per story and window, as windows close."""
    return acts.withWatermark("ts", late).groupBy("story_id", F.window("ts", width)).agg(F.count("*").alias("n")).select("story_id", F.col("window.start").alias("start"), "n")
