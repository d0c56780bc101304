"""Edit sessions as a stream: the same steps as ``review.edit_session``, with events in any order inside the lateness that is allowed.

Events of an instance wait in its state until the watermark passes them, and are
then taken in the order of their time; so an event that comes late, but before the
watermark, is put in its place.  Instances may start from stored records.  Active
time adds up the gaps between events that are shorter than the idle time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glyphmill.operators import review
from glyphmill.operators.ordered import IDLE_SECONDS
from glyphmill.streaming.review import ROCKSDB

STATE = "state string, n_positive int, mask_source string, active_us long, n_events long, last_us long"
OUT = "key long, state string, n_positive int, has_mask boolean, mask_source string, active_seconds double, n_events long"


def step(state: str, n: int, mask: str | None, action: str) -> tuple[str, int, str | None]:
    """An instance after one action of a session."""
    edit = action in review.EDITS
    n = max(0, n + {"add_positive": 1, "delete_positive": -1}.get(action, 0))
    meant: str | None = action
    if action == "activate" and state == "proposed":
        meant = "open_mask" if mask else "open_points"
    elif edit and state == "needs_mask_review":
        meant = "back_to_points"
    elif action == "accept" and not (n > 0 and mask) or action == "confirm_points" and n == 0:
        meant = None
    to = review.TRANSITIONS.get((state, meant), state)
    again = edit or action == "confirm_points" and to != state
    if action == "manual_box":
        mask = "human_box"
    elif again:
        mask = "sam3_auto" if n > 0 else None
    return "needs_point_review" if again and n == 0 and to == "needs_mask_review" else to, n, mask


class Sessions(StatefulProcessor):
    """For each instance where it stands, and the events that wait for the watermark by their time."""

    def __init__(self, idle: float = IDLE_SECONDS):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", STATE)
        self.waiting = handle.getMapState("waiting", "us long, event_id long", "action string")

    def _start(self) -> tuple:
        return self.at.get() if self.at.exists() else ("proposed", 0, None, 0, 0, None)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.at.update((r["state"], int(r["n_positive"]), None if pd.isna(r["mask_source"]) else r["mask_source"], 0, 0, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for us, event, action in zip(part["us"], part["event_id"], part["action"]):
                self.waiting.updateValue((int(us), int(event)), (action,))
                # a time that passes after the event's own
                self.handle.registerTimer(int(us) // 1000 + 1)
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(((*place, action[0]) for place, action in self.waiting.iterator() if place[0] < passed), key=lambda e: e[:2])
        if not due:
            return
        state, n, mask, active, count, last = self._start()
        for us, event, action in due:
            state, n, mask = step(state, n, mask, action)
            gap = 0 if last is None else us - last
            active += gap if 0 < gap < self.idle * 1e6 else 0
            count, last = count + 1, us
            self.waiting.removeKey((us, event))
        self.at.update((state, n, mask, active, count, last))
        yield pd.DataFrame({"key": [key[0]], "state": [state], "n_positive": [n], "has_mask": [mask is not None], "mask_source": [mask], "active_seconds": [active / 1e6], "n_events": [count]})

    def close(self) -> None:
        pass


def edit_sessions(events: DataFrame, key: str, late: str = "1 hour", stored: DataFrame | None = None, idle: float = IDLE_SECONDS) -> DataFrame:
    """Where each instance stands after each step of the watermark, from a stream (key, ts, event_id, action); in update mode.

    ``stored`` are records (key, state, n_positive, mask_source) that instances
    start from.  Events that come after the watermark has passed them are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("time", ts).withWatermark("time", late).select(F.col(key).cast("long").alias("key"), "time", F.unix_micros("time").alias("us"), F.col("event_id").cast("long").alias("event_id"), "action")
    more = {} if stored is None else {"initialState": stored.select(F.col(key).cast("long").alias("key"), "state", "n_positive", "mask_source").groupBy("key")}
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Sessions(idle), outputStructType=OUT, outputMode="Update", timeMode="EventTime", **more)
