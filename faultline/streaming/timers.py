"""Decisions that fall due: when to train again, and when labels of deleted items may go. Both are keyed state with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000
DAY = 1440 * MINUTE


# training


@dataclass
class Policy:
    """When a model may be trained again; times in milliseconds."""

    threshold: int = 100
    interval: int = 60 * MINUTE
    cooldown: int = 5 * MINUTE
    nightly: int = 120 * MINUTE
    patience: int = 60 * MINUTE


@dataclass
class Trainings:
    """What is known of a model's trainings. ``shipped``, ``failed`` and ``asked`` are the times of the last model that was shipped, of the
    last attempt since that wasn't, and of a request that has no outcome yet; ``new`` counts the labels since ``shipped``."""

    shipped: int | None = None
    failed: int | None = None
    cold: bool = False
    asked: int | None = None
    new: int = 0
    waiting: bool = False
    tick: int | None = None

    def free_at(self, p: Policy, reason: str) -> int:
        """When nothing holds back a training of this reason any more. A model that was shipped holds back all reasons for an interval, a
        candidate that was rejected for a cooldown; an attempt without enough data holds back only what labels ask for."""
        ends = [0]
        if self.shipped is not None:
            ends.append(self.shipped + p.interval)
        if self.failed is not None and not (self.cold and reason != "events"):
            ends.append(self.failed + p.cooldown)
        if self.asked is not None:
            ends.append(self.asked + p.patience)
        return max(ends)

    def ask(self, p: Policy, reason: str, at: int) -> str:
        """train, below_threshold or debounced."""
        enough = reason != "events" or self.shipped is None or self.new >= p.threshold
        if at < self.free_at(p, reason):
            self.waiting |= reason == "events" and enough
            return "debounced"
        if not enough:
            return "below_threshold"
        self.asked, self.waiting = at, False
        return "train"

    def due(self, p: Policy) -> tuple[int, str]:
        """The next time that something falls due by itself, and its reason."""
        return min((self.free_at(p, "events"), "events") if self.waiting else (self.tick, "nightly"), (self.tick, "nightly"))

    def until(self, p: Policy, now: int) -> Iterator[tuple[int, str, str]]:
        """What falls due before ``now``, in order, as (at, reason, decision); of one time, it comes before the rows of that time."""
        while self.tick is not None:
            at, reason = self.due(p)
            if at >= now:
                return
            if reason == "nightly":
                self.tick += DAY
            yield at, reason, self.ask(p, reason, at)

    def take(self, p: Policy, at: int, kind: str, n: int) -> Iterator[tuple[int, str, str]]:
        if self.tick is None:
            self.tick = (at - p.nightly) // DAY * DAY + p.nightly + DAY
        yield from self.until(p, at + 1)
        if kind == "label":
            self.new += n
            decision = self.ask(p, "events", at)
            if decision == "train":
                yield at, "events", decision
        elif kind == "route":
            yield at, "route", self.ask(p, "route", at)
        elif kind == "shipped":
            self.shipped, self.failed, self.cold, self.asked, self.new, self.waiting = at, None, False, None, 0, False
        elif kind in ("rejected", "cold"):
            self.failed, self.cold, self.asked = at, kind == "cold", None


_STATE = "shipped long, failed long, cold boolean, asked long, new long, waiting boolean, tick long"
_DECISIONS = ["model", "at", "reason", "decision"]


class _Trainer(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("trainings", _STATE)

    def _kept(self, key, known: Trainings, rows: list) -> Iterator[pd.DataFrame]:
        self.state.update((known.shipped, known.failed, known.cold, known.asked, known.new, known.waiting, known.tick))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # what falls due at a time is decided when that time has passed
        self.handle.registerTimer(known.due(self.policy)[0] + 1)
        yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), reason, decision) for at, reason, decision in rows], columns=_DECISIONS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out = Trainings(*self.state.get()) if self.state.exists() else Trainings(), []
        for r in pd.concat(rows).sort_values(["at", "kind"]).itertuples():
            out += known.take(self.policy, int(r.at), r.kind, int(r.n))
        yield from self._kept(key, known, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = Trainings(*self.state.get())
        yield from self._kept(key, known, list(known.until(self.policy, expiredTimerInfo.getExpiryTimeInMs())))

    def close(self) -> None:
        pass


def retrain_requests(events: DataFrame, late: str = "10 minutes", policy: Policy | None = None) -> DataFrame:
    """(model, at, reason, decision) of a stream (model, at, kind): ``label`` a new label, ``route`` an explicit request, ``shipped``,
    ``rejected`` and ``cold`` the outcome of a training.

    Labels ask for a training when ``threshold`` came since the last model that was shipped (any does before the first), every night at
    two o'clock UTC asks too. What labels asked for in vain is asked again when nothing holds it back any more. A request without outcome
    holds back others for ``patience``. Labels that ask for nothing give no row. Rows are first counted by minute, each kind at the time
    of its last row of it, so a model of very many labels is few rows of state's input, and they reach the state in order of time,
    whatever the batches are; of one time, by kind. A row that is later than ``late`` isn't counted, nor is one without model or time.
    """
    at = events.where("model IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = at.groupBy(F.window("at", "1 minute"), "model", "kind").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    rows = rows.select("model", "kind", "n", F.unix_millis("last").alias("at"), F.window_time("window").alias("closed"))
    return rows.groupBy("model").transformWithStateInPandas(_Trainer(policy or Policy()), "model string, at timestamp, reason string, decision string", "Append", "EventTime")


# orphans


@dataclass
class Orphan:
    """Labels of an item: whether the item is there since ``changed``, and since when it has been seen to be missing."""

    present: bool = False
    changed: int | None = None
    labels: int = 0
    marked: int | None = None

    def until(self, grace: int, now: int) -> Iterator[tuple[int, str, int]]:
        if self.marked is not None and grace > 0 and self.marked + grace < now:
            at, labels = self.marked + grace, self.labels
            self.marked, self.labels = None, 0
            yield at, "swept", labels

    def take(self, grace: int, at: int, seen: int, kind: str) -> Iterator[tuple[int, str, int]]:
        """A row of time ``at`` that is seen at ``seen``, which is later for a late one."""
        yield from self.until(grace, seen)
        if kind == "label":
            self.labels += 1
        elif self.changed is None or at >= self.changed:
            self.present, self.changed = kind == "item", at
        if self.present and self.marked is not None:
            self.marked = None
            yield seen, "unmarked", self.labels
        elif not self.present and self.labels and self.marked is None:
            self.marked = seen
            yield seen, "marked", self.labels


class _Reaper(StatefulProcessor):
    def __init__(self, grace: int):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("orphan", "present boolean, changed long, labels long, marked long")

    def _kept(self, key, known: Orphan, rows: list) -> Iterator[pd.DataFrame]:
        if known.labels or known.changed is not None:
            self.state.update((known.present, known.changed, known.labels, known.marked))
        else:
            self.state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if known.marked is not None and self.grace > 0:
            self.handle.registerTimer(known.marked + self.grace + 1)
        yield pd.DataFrame([(*key, pd.Timestamp(at, unit="ms"), action, labels) for at, action, labels in rows], columns=["project_id", "item_id", "at", "action", "labels"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out = Orphan(*self.state.get()) if self.state.exists() else Orphan(), []
        # of one time, an item that is written comes before its labels, one that is deleted after them
        for r in pd.concat(rows).assign(place=lambda d: d["kind"].map({"item": 0, "label": 1, "gone": 2})).sort_values(["at", "place"]).itertuples():
            out += known.take(self.grace, int(r.at), max(int(r.at), timerValues.getCurrentWatermarkInMs()), r.kind)
        yield from self._kept(key, known, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = Orphan(*self.state.get())
        yield from self._kept(key, known, list(known.until(self.grace, expiredTimerInfo.getExpiryTimeInMs())))

    def close(self) -> None:
        pass


def orphans(events: DataFrame, grace_days: int = 30, late: str = "1 hour") -> DataFrame:
    """(project_id, item_id, at, action, labels) of a stream (project_id, item_id, at, kind): ``label`` a label of an item, ``item`` an item
    that is written, ``gone`` one that is deleted.

    An item that has labels and isn't there is ``marked`` when that is first seen, never at the older time of a label; ``unmarked`` when
    it is written again; ``swept``, with the number of labels to delete, when it is still missing after the days of grace. No days: no
    sweep. Late rows count too, when they come: of writing and deleting an item the later one holds. ``late`` is how far time lags behind
    the newest row, so a sweep waits that much longer.
    """
    timed = events.where("project_id IS NOT NULL AND item_id IS NOT NULL AND at IS NOT NULL AND kind IN ('label', 'item', 'gone')").withWatermark("at", late)
    # milliseconds carry no watermark, so no late row is dropped on its way to the state
    rows = timed.select("project_id", "item_id", F.unix_millis("at").alias("at"), "kind")
    out = "project_id long, item_id long, at timestamp, action string, labels long"
    return rows.groupBy("project_id", "item_id").transformWithStateInPandas(_Reaper(grace_days * DAY), out, "Append", "EventTime")
