"""Streams of test outcomes and suggestions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECAY, GAIN = 0.9, 0.1


def flakiness(outcomes: DataFrame) -> DataFrame:
    """Running (test_case_hash, runs, failures, flips, flakiness) of a stream (test_case_hash, event_id, failed, ts).

    State is five numbers for each test. Rows of a batch are taken in order of time; a late row counts when it comes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, failures, flips, score, last = state.get if state.exists else (0, 0, 0, 0.0, -1)
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        for failed in rows["failed"].astype(int):
            flip = int(last >= 0 and failed != last)
            runs, failures, flips, score, last = runs + 1, failures + failed, flips + flip, DECAY * score + GAIN * flip, failed
        state.update((runs, failures, flips, score, int(last)))
        yield pd.DataFrame([(key[0], runs, failures, flips, score)], columns=["test_case_hash", "runs", "failures", "flips", "flakiness"])

    out = "test_case_hash long, runs long, failures long, flips long, flakiness double"
    return outcomes.groupBy("test_case_hash").applyInPandasWithState(step, out, "runs long, failures long, flips long, score double, last int", "update", GroupStateTimeout.NoTimeout)


def daily_rollup(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts by day and kind of a stream (ts, event_type, value); days close ``late`` after their end."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def parsed(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(messages, dead letters) of a stream of JSON texts in ``value``."""
    rows = raw.select("value", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    bad = F.col("m").isNull() | F.col("m._corrupt_record").isNotNull()
    return rows.where(~bad).select("m.*").drop("_corrupt_record"), rows.where(bad).select("value")


def merging_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts the last row of each key; a repeated batch changes nothing."""
    from ..operators.relational import latest, upsert

    def merge(batch: DataFrame, epoch: int) -> None:
        new = latest(batch, keys, order, [c for c in batch.columns if c not in keys])
        write(upsert(read(), new, keys))

    return merge
