"""Conversation state with a time to live, as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusweave import rules

OUTPUT = "user_id long, session long, events long, start_us long, end_us long, closed boolean"
STATE = "session long, events long, start_us long, end_us long"


def _advance(gap_us: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        """One open session per key: an event after the gap closes it, and so does the timeout."""
        user = key[0]
        if state.hasTimedOut:
            session, events, start, end = state.get
            state.update((session, 0, -1, -1))  # the next session of this key has the next number
            yield pd.DataFrame([(user, session, events, start, end, True)], columns=[c.split()[0] for c in OUTPUT.split(", ")])
            return
        session, events, start, end = state.get if state.exists else (0, 0, -1, -1)
        closed = []
        # The batches of one trigger hold only that trigger's events of the key.
        for us in sorted(u for b in batches for u in b["us"].tolist()):
            if end >= 0 and us - end <= gap_us:
                events, end = events + 1, max(end, us)
                continue
            if end >= 0:
                closed.append((user, session, events, start, end, True))
            session, events, start, end = session + 1, 1, us, us
        state.update((session, events, start, end))
        # Never before the watermark: a timestamp already passed is not accepted as a timeout.
        state.setTimeoutTimestamp(max((end + gap_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return update


def stream_sessions(events: DataFrame, gap_seconds: int = rules.CONVERSATION_TTL_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a streaming ``user_id, ts`` table; each is emitted when it is closed.

    State is one row per open conversation and expires with the watermark. The time to live is per
    key; a global cap with eviction of the oldest conversation has no keyed counterpart and is left
    to the size of the state store.
    """
    marked = events.withWatermark("ts", lateness).select(
        F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("us")
    )
    return marked.groupBy("user_id").applyInPandasWithState(
        _advance(gap_seconds * 1_000_000), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
