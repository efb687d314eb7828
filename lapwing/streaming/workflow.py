"""Review events as a stream: the state of each case, and notices by key."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lapwing.operators import review
from lapwing.operators.stored import KeyedTable

STATE = "case_id long, state string, accepted long, rejected long"
_HELD = "state string, accepted long, rejected long, held string"


def review_states(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A row of each case whenever events of it are settled: its state after the last accepted one.

    ``events``: case_id, event_id, ts (timestamp), state.  Events may come up to
    ``delay`` behind the newest one: each waits in its case's state until the
    watermark has passed it, a timer wakes the case then, and what waited is folded in
    the order of time.  Later ones than that are left out.
    """
    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, accepted, rejected, held = state.get if state.exists else ("pending", 0, 0, "[]")
        waiting = [tuple(e) for e in json.loads(held)]
        if not state.hasTimedOut:
            for rows in batches:
                at = rows["ts"].astype("datetime64[us]").astype("int64")
                waiting += zip(at.tolist(), rows["event_id"].tolist(), rows["state"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        settled = [e for e in waiting if e[0] <= passed]
        waiting = waiting[len(settled) :]
        for _, _, new in settled:
            if new == now or new in review.TRANSITIONS.get(now, ()):
                now, accepted = new, accepted + 1
            else:
                rejected += 1
        state.update((now, accepted, rejected, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if settled:
            yield pd.DataFrame({"case_id": [key[0]], "state": [now], "accepted": [accepted], "rejected": [rejected]})

    timed = events.withWatermark("ts", delay).groupBy("case_id")
    return timed.applyInPandasWithState(step, STATE, _HELD, "update", GroupStateTimeout.EventTimeTimeout)


_NOTICE = "student_id string, submission_id long, type string, title string, ts timestamp, read boolean"


def _notices(spark: SparkSession, target: str) -> KeyedTable:
    return KeyedTable(spark, target, _NOTICE, ["student_id", "submission_id", "type"], ["student_id"])


def merge_notices(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest notice of each student, submission and type in ``target``, a :class:`KeyedTable` whose parts go by student."""
    def run(batch: DataFrame, batch_id: int) -> None:
        new = review.notices(batch).withColumn("submission_id", F.col("submission_id").cast("long"))
        _notices(batch.sparkSession, target).upsert(new, [F.desc("ts")], batch_id)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_notices(spark: SparkSession, target: str) -> DataFrame:
    return _notices(spark, target).read()
