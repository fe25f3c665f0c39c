"""Leases on pieces of work as streaming state: claims that expire and failures that come back by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# How long a claim holds, when a failure may be tried again, and how often.
LEASE_MS, RETRY_MS, ATTEMPTS = 3_600_000, 3_600_000, 3

OUT = "work_id long, status string, attempts int, reason string, until_ms long"


class _Lease(StatefulProcessor):
    """One piece of work: its status, attempts, and the time at which its timer is due (0: none)."""

    def __init__(self, lease_ms: int, retry_ms: int, attempts: int) -> None:
        self.lease_ms, self.retry_ms, self.attempts = lease_ms, retry_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "status string, attempts int, until long")

    def _read(self) -> tuple[str, int, int]:
        return tuple(self.item.get()) if self.item.exists() else ("pending", 0, 0)

    def _write(self, status: str, attempts: int, due: int, before: int) -> None:
        if before:
            self.handle.deleteTimer(before)
        if due:
            self.handle.registerTimer(due)
        self.item.update((status, attempts, due))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        now = timerValues.getCurrentProcessingTimeInMs()
        status, attempts, until = self._read()
        events = pd.concat(list(rows)).sort_values(["at", "event"], kind="stable")["event"]
        out = []
        for event in events:
            before = until
            if event == "claimed" and status in ("pending", "retry") and attempts < self.attempts:
                status, attempts, until, reason = "processing", attempts + 1, now + self.lease_ms, "claimed"
            elif event == "failed" and status == "processing":
                again = attempts < self.attempts
                status, until, reason = ("failed", now + self.retry_ms, "failed") if again else ("given_up", 0, "attempts_used_up")
            elif event in ("done", "unsupported") and status == "processing":
                status, until, reason = event, 0, event
            else:  # a second claim, or news of work that nobody holds any more
                out.append((key[0], status, attempts, "ignored", until))
                continue
            self._write(status, attempts, until, before)
            out.append((key[0], status, attempts, reason, until))
        yield pd.DataFrame(out, columns=["work_id", "status", "attempts", "reason", "until_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        status, attempts, until = self._read()
        if not until or expiredTimerInfo.getExpiryTimeInMs() < until:
            return
        if status == "processing":
            status, reason = ("pending", "lease_expired") if attempts < self.attempts else ("given_up", "attempts_used_up")
        else:
            status, reason = "retry", "retry_due"
        self.item.update((status, attempts, 0))
        yield pd.DataFrame([(key[0], status, attempts, reason, 0)], columns=["work_id", "status", "attempts", "reason", "until_ms"])

    def close(self) -> None:
        pass


def leases(events: DataFrame, lease_ms: int = LEASE_MS, retry_ms: int = RETRY_MS, attempts: int = ATTEMPTS) -> DataFrame:
    """What becomes of work, from a stream of events (work_id, event, at): work_id, status, attempts, reason, until_ms.

    An event is claimed, done, failed or unsupported. A claim holds for ``lease_ms``; if nothing
    is heard by then the work is pending again. Failed work may be claimed again after
    ``retry_ms``; unsupported and done work may not, nor what was claimed ``attempts`` times.
    Timers run on processing time and fire without new events. Claims of held or finished work,
    and news of work that isn't held, are ignored and say so. Null ids are one piece of work.

    The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return events.select("work_id", "event", "at").groupBy("work_id").transformWithStateInPandas(
        statefulProcessor=_Lease(lease_ms, retry_ms, attempts), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime"
    )
