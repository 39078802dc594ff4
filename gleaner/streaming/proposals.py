"""Proposed changes to memories as keyed state of a stream: submitted, reviewed once, bound to a version, expiring.

One key is one owner's proposals. A request is a row (event_id, at, owner, action, back, evidence, memory, by_agent):
``propose`` submits the owner's next proposal (for a new memory where ``memory`` is null, else for that one as it is
now), ``accept`` and ``reject`` review the proposal that stands ``back`` submissions before the latest. Requests of a batch are taken in the
order of (at, event_id), those of a later batch after them.

The state is a count, the live proposals and the memories' versions. A proposal leaves it when it expires, by a timer of event time;
a request compares times itself, so outcomes do not depend on when timers fire. One key's requests are handled by one task, as
its limit of pending proposals demands; a batch holds them for the files it takes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The worker that sets up a processor's state on the driver does not see shipped packages: the class goes with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Proposals that an owner may have pending, records that one may cite, days until a pending one and a reviewed one expire.
CAPACITY, CITED, PENDING_DAYS, REVIEWED_DAYS = 100, 50, 7, 30
DAY = 86_400_000_000
OUTCOMES = "owner long, event_id long, number long, outcome string"


class Review(StatefulProcessor):
    """Decides requests; emits one row (owner, event_id, number, outcome) for each."""

    def __init__(self, capacity: int = CAPACITY, pending_days: int = PENDING_DAYS):
        self.capacity, self.pending_days = capacity, pending_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.proposals = handle.getMapState("proposals", "number long", "status string, base long, memory long, expires long")
        self.versions = handle.getMapState("versions", "memory long", "version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows)).sort_values(["at", "event_id"])
        n = self.count.get()[0] if self.count.exists() else 0
        live = {k[0]: list(v) for k, v in self.proposals.iterator()}
        versions = {k[0]: v[0] for k, v in self.versions.iterator()}
        touched: set[int] = set()
        out = []
        for r in requests.itertuples():
            now = int(r.at)
            for number in [k for k, p in live.items() if p[3] <= now]:
                del live[number]
                touched.add(number)
            memory = None if pd.isna(r.memory) else int(r.memory)
            if r.action == "propose":
                n += 1
                number = n
                if r.evidence > CITED:
                    outcome = "invalid"
                elif sum(p[0] == "pending" for p in live.values()) >= self.capacity:
                    outcome = "full"
                else:
                    outcome = "pending"
                    base = None if memory is None else versions.get(memory, 1)
                    live[number] = [outcome, base, memory, now + self.pending_days * DAY]
                    touched.add(number)
            else:
                number = n - int(r.back)
                p = live.get(number)
                done = "accepted" if r.action == "accept" else "rejected"
                if r.by_agent:
                    outcome = "forbidden"
                elif p is None:
                    outcome = "unknown"
                elif p[0] != "pending":
                    outcome = "repeated" if p[0] == done else "conflict"
                elif done == "accepted" and p[2] is not None and versions.get(p[2], 1) != p[1]:
                    outcome = "stale"
                else:
                    outcome = done
                    if done == "accepted" and p[2] is not None:
                        versions[p[2]] = p[1] + 1
                        self.versions.updateValue((p[2],), (p[1] + 1,))
                    p[0], p[3] = done, now + REVIEWED_DAYS * DAY
                    touched.add(number)
            out.append((int(key[0]), int(r.event_id), number, outcome))
        self.count.update((n,))
        for number in touched:
            if number in live:
                self.proposals.updateValue((number,), tuple(live[number]))
                self.handle.registerTimer(live[number][3] // 1000)
            elif self.proposals.containsKey((number,)):
                self.proposals.removeKey((number,))
        yield pd.DataFrame(out, columns=["owner", "event_id", "number", "outcome"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        for number in [k[0] for k, v in self.proposals.iterator() if v[3] // 1000 <= due]:
            self.proposals.removeKey((number,))
        yield pd.DataFrame({"owner": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "number": pd.Series(dtype="int64"), "outcome": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def requests(events: DataFrame) -> DataFrame:
    """The requests that stand in an event stream: purchases, sign-ups and clicks propose, views accept, errors reject."""
    k = F.get_json_object("props", "$.k").cast("long")
    action = F.when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "error", "reject").otherwise("propose")
    return events.select(
        (F.col("user_id") % 6).alias("owner"), "event_id", "time", F.unix_micros("time").alias("at"), action.alias("action"), (k % 40).alias("back"), (k % 60).alias("evidence"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).alias("memory"), (F.col("event_id") % 17 == 0).alias("by_agent"),
    )


def reviewed(stream: DataFrame, capacity: int = CAPACITY, pending_days: int = PENDING_DAYS, late: str = "40 days") -> DataFrame:
    """(owner, event_id, number, outcome) of every request of a stream of events; requests more than ``late`` behind are dropped."""
    timed = requests(stream.withColumn("time", F.col("ts").cast("timestamp"))).withWatermark("time", late)
    keyed = timed.groupBy("owner")
    return keyed.transformWithStateInPandas(statefulProcessor=Review(capacity, pending_days), outputStructType=OUTCOMES, outputMode="Update", timeMode="eventTime")
