"""Acts after death on a stream, against the batch rule: later than the character's earliest death."""

from datetime import datetime, timedelta

import pytest

from fableguard.streaming import live

SCHEMA = "story_id string, character string, event_id long, died boolean, ts timestamp"
START = datetime(2026, 1, 1)


def row(character, event_id, hours, died=False):
    return ("s", character, event_id, died, START + timedelta(hours=hours))


@pytest.mark.parametrize("late_death", [False, True])
def test_dead_agent_stream(spark, tmp_path, late_death):
    death, act = [row("a", 1, 0, True)], [row("a", 2, 0.5)]
    batches = [act, death] if late_death else [death, act]
    batches += [[row("b", 3, 30)], [row("b", 4, 48)], [row("a", 5, 72)], [row("b", 6, 100, True), row("b", 7, 101)], [row("c", 8, 300)], [row("c", 9, 600)]]
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
    query = lambda: live.dead_agent_stream(stream, "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        query().awaitTermination()
    rows = [r for batch in batches for r in batch]
    first = {c: min(r[4] for r in rows if r[1] == c and r[3]) for c in "ab"}
    want = sorted(r[2] for r in rows if r[1] in first and r[4] > first[r[1]])
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want == [2, 5, 7]
