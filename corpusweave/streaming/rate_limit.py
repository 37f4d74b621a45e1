"""The sliding-window rate limit as a stream: list state per client and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusweave import rules

OUTPUT = "key long, us long, requests long, accepted long, rejected long"
#: Lists in the state need a store that keeps more than one value for a client.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(recent: list[int], instants: list[tuple[int, int]], limit: int, width: int) -> list[tuple[int, int, int]]:
    """(instant, requests, accepted) of instants in time order; ``recent`` are accepted instants, at most ``limit`` of them, and changes.

    An accepted request counts for ``width`` microseconds, a rejected one is forgotten.
    """
    out = []
    for us, n in instants:
        while recent and recent[0] <= us - width:
            recent.pop(0)
        taken = min(n, limit - len(recent))
        recent.extend([us] * taken)
        out.append((us, n, taken))
    return out


class RateLimiter(StatefulProcessor):
    """Requests wait until the watermark has passed their instant, then they are decided in time order.

    ``recent`` holds at most ``limit`` accepted instants of a client, ``waiting`` the requests the watermark has not passed. A request
    that is delivered again while it waits is found there by its id; later than that it is late, so no ids need to be kept.
    """

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "us long")
        self.waiting = handle.getListState("waiting", "us long, id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["us", "id"]] for r in rows])
        self.waiting.appendList([(int(us), None if pd.isna(i) else int(i)) for us, i in zip(new["us"], new["id"])])
        # One timer for what came last; anything earlier is decided with it at the latest.
        self.handle.registerTimer(-(-int(new["us"].max()) // 1000))
        yield from self.decided(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.decided(key, timerValues)

    def decided(self, key: tuple, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due: dict[int, int] = {}
        later, known = [], set()
        for us, event in self.waiting.get():
            if event is not None and (us, event) in known:
                continue
            known.add((us, event))
            if us <= passed:
                due[us] = due.get(us, 0) + 1
            else:
                later.append((us, event))
        if not due:
            return
        recent = [us for us, in self.recent.get()]
        out = decide(recent, sorted(due.items()), self.limit, self.width)
        self.put(self.recent, [(us,) for us in recent])
        self.put(self.waiting, later)
        yield pd.DataFrame([(key[0], us, n, taken, n - taken) for us, n, taken in out], columns=["key", "us", "requests", "accepted", "rejected"])

    @staticmethod
    def put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def stream_rate_limit(
    events: DataFrame, limit: int = rules.RATE_LIMIT, seconds: int = rules.RATE_WINDOW_SECONDS, lateness: str = "10 minutes"
) -> DataFrame:
    """``user_id, us, requests, accepted, rejected`` of a streaming ``event_id, user_id, ts`` table, once an instant is final.

    An event that is delivered again is dropped, by its id or because it is late, so a repeated batch changes nothing; events without id
    all count. Events older than the watermark are late and not decided. The decisions are those of ``operators.logs.rate_limit`` over
    the whole table.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = events.withWatermark("ts", lateness)
    keyed = marked.select(F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("id"))
    decided = keyed.groupBy("user_id").transformWithStateInPandas(RateLimiter(limit, seconds * 1_000_000), OUTPUT, "append", "eventTime")
    return decided.withColumnRenamed("key", "user_id")
