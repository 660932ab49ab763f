"""Keyed stream state: quotas, running statistics, circuit state, hash chains."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.operations import NEUTRAL, POLICY_OPEN

FAILURE_THRESHOLD = 5
COOLDOWN_SECONDS = 60


def daily_counts(stream: DataFrame, at: str = "at") -> DataFrame:
    """Requests per source and calendar day; emit in update mode.

    No watermark: a late attempt still counts for its day. The state is one number per source and day.
    """
    return stream.groupBy("source", F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def adapter_totals(stream: DataFrame) -> DataFrame:
    """Running counts and mean latency per (source, adapter); neutral outcomes do not count."""
    failed = ~F.col("success") & ~F.col("status").isin(*NEUTRAL)
    counted = F.col("success") | failed
    return stream.groupBy("source", "adapter").agg(
        F.count_if("success").alias("success_count"), F.count_if(failed).alias("failure_count"),
        F.avg(F.when(counted, F.col("latency_ms"))).alias("average_latency_ms"))


CIRCUIT_OUT = "source string, adapter string, event_id long, at timestamp, state string, consecutive long, cooldown_until timestamp"
CIRCUIT_STATE = "state string, consecutive long, cooldown_until timestamp, last_ms long"
WAITING = "attempts binary"
DUE = "end_ms long"
# A waiting attempt: time in microseconds, id (if known) and what it does, a place in OUTCOMES.
ATTEMPT = np.dtype([("at", "i8"), ("id", "i8"), ("known", "?"), ("outcome", "u1")])
# (success, status) that stand for what an attempt does.
OUTCOMES = [(True, None), (False, NEUTRAL[0]), (False, POLICY_OPEN[0]), (False, None)]
# Attempts of so many slots wait in one entry of the state; so many bytes of one trigger are collected before they are put there.
SLOTS_PER_BLOCK = 36
COLLECTED_BYTES = 32 << 20
# Attempts are ordered and folded by slots of so many seconds.
SLOT_SECONDS = 600
EPOCH = datetime(1970, 1, 1)


# What an attempt does to a circuit, by the state it finds and its outcome: the state it leaves, the count of
# failures in a row (0, kept or one more) and the end of the cooldown (none, kept or set anew).
RESET, KEEP, MORE, RESTART = "reset", "keep", "more", "restart"
TRANSITIONS = {
    **{(state, "success"): ("closed", RESET, RESET) for state in ("closed", "half_open", "open")},
    **{(state, "neutral"): (state, KEEP, KEEP) for state in ("closed", "half_open", "open")},
    **{(state, "tripped"): ("open", MORE, RESTART) for state in ("closed", "half_open", "open")},
    ("closed", "failure"): ("closed", MORE, KEEP),
    ("half_open", "failure"): ("half_open", MORE, KEEP),
    ("open", "failure"): ("closed", MORE, KEEP),
}


def next_circuit(state: str, consecutive: int, until, at, success: bool, status: str,
                 threshold: int = FAILURE_THRESHOLD, cooldown: int = COOLDOWN_SECONDS):
    """State after one attempt; once its cooldown is over, an open circuit meets the attempt half open."""
    found = "half_open" if state == "open" and until and until <= at else state
    trips = status in POLICY_OPEN or consecutive + 1 >= threshold
    outcome = "success" if success else "neutral" if status in NEUTRAL else "tripped" if trips else "failure"
    left, count, clock = TRANSITIONS[found, outcome]
    counts = {RESET: 0, KEEP: consecutive, MORE: consecutive + 1}
    clocks = {RESET: None, KEEP: until, RESTART: at + timedelta(seconds=cooldown)}
    return left, counts[count], clocks[clock]


class CircuitProcessor(StatefulProcessor):
    """The circuit of one (source, adapter), fed in time order whatever the order of arrival.

    Attempts wait in blocks of slots of ``slot_seconds``, packed, one entry per block in map state, with one event-time timer at the end of
    the earliest slot. When the watermark passes that, no earlier attempt can come any more: all slots that it has passed are sorted, folded into
    the circuit block by block and forgotten, and the timer is set for the earliest slot left. So calls and state accesses grow with
    triggers and blocks, not with slots; memory holds one block of one circuit; and the result doesn't depend on how the input was cut into triggers.
    A circuit in its first state takes no room: it is dropped and begun anew with the next failure. One that rested for
    ``idle_seconds`` is dropped in any state, if that is given.
    """

    def __init__(self, slot_seconds: int = SLOT_SECONDS, idle_seconds: int | None = None,
                 threshold: int = FAILURE_THRESHOLD, cooldown: int = COOLDOWN_SECONDS):
        self.slot_ms, self.idle_ms = slot_seconds * 1000, idle_seconds and idle_seconds * 1000
        self.block_ms = self.slot_ms * SLOTS_PER_BLOCK
        self.threshold, self.cooldown = threshold, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.circuit = handle.getValueState("circuit", CIRCUIT_STATE)
        self.waiting = handle.getMapState("waiting", "block long", WAITING)
        self.due = handle.getValueState("due", DUE)

    def _slot_end(self, micros):
        return (micros // 1000 // self.slot_ms + 1) * self.slot_ms

    def _held(self, block: int) -> bytes:
        held = self.waiting.getValue((block,))
        return b"" if held is None else bytes(held[0])

    def _keep(self, new: dict[int, list[bytes]]) -> None:
        for block, pieces in new.items():
            self.waiting.updateValue((block,), (b"".join([self._held(block), *pieces]),))
        new.clear()

    def _wait(self, end: int) -> None:
        if not self.due.exists() or end < self.due.get()[0]:
            self.handle.registerTimer(end)
            self.due.update((end,))

    def handleInputRows(self, key, rows, timerValues):
        new, size, first = {}, 0, None
        for part in rows:
            made = np.zeros(len(part), ATTEMPT)
            made["at"] = part["at"].astype("datetime64[us]").astype("int64")
            made["known"] = part["event_id"].notna()
            made["id"] = part["event_id"].fillna(0).astype("int64")
            neutral, policy = part["status"].isin(NEUTRAL), part["status"].isin(POLICY_OPEN)
            made["outcome"] = np.select([part["success"].eq(True), neutral, policy], [0, 1, 2], 3)
            blocks = made["at"] // 1000 // self.block_ms
            for block in np.unique(blocks):
                new.setdefault(int(block), []).append(made[blocks == block].tobytes())
            if len(made):
                first = int(made["at"].min()) if first is None else min(first, int(made["at"].min()))
            size += made.nbytes
            if size > COLLECTED_BYTES:
                self._keep(new)
                size = 0
        self._keep(new)
        if first is not None:
            self._wait(self._slot_end(first))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if self.due.exists() and self.due.get()[0] <= passed:
            self.due.clear()
            for block in sorted(k[0] for k in list(self.waiting.keys())):
                held = np.frombuffer(self._held(block), ATTEMPT)
                over = self._slot_end(held["at"]) <= passed
                left = held[~over]
                if len(left) < len(held):
                    if len(left):
                        self.waiting.updateValue((block,), (left.tobytes(),))
                    else:
                        self.waiting.removeKey((block,))
                    yield self._fold(key, held[over])
                if len(left):
                    self._wait(self._slot_end(int(left["at"].min())))
                    break
        if self.idle_ms and self.circuit.exists():
            rested = self.circuit.get()[3] + self.idle_ms + 1
            if rested <= passed:
                self.circuit.clear()
            else:
                self.handle.registerTimer(rested)
        yield pd.DataFrame()

    def _fold(self, key, attempts):
        """The circuit after each of the attempts, whose slots are over and come after all that were folded before."""
        attempts = attempts[np.lexsort((attempts["id"], ~attempts["known"], attempts["at"]))]
        held = self.circuit.get() if self.circuit.exists() else None
        now, last = (tuple(held[:3]), held[3]) if held else (("closed", 0, None), None)
        slot, out = None, []
        for micros, end, outcome in zip(attempts["at"].tolist(), self._slot_end(attempts["at"]).tolist(), attempts["outcome"].tolist()):
            if self.idle_ms and end != slot and last is not None and last + self.idle_ms + 1 <= end:
                now = ("closed", 0, None)
            now = next_circuit(*now, EPOCH + timedelta(microseconds=micros), *OUTCOMES[outcome], self.threshold, self.cooldown)
            slot, last = end, micros // 1000
            out.append(now)
        if now == ("closed", 0, None):
            self.circuit.clear()
        else:
            self.circuit.update((*now, last))
        ids = pd.Series(attempts["id"]) if attempts["known"].all() else pd.Series(pd.arrays.IntegerArray(attempts["id"].copy(), ~attempts["known"]))
        states, counts, untils = zip(*out)
        return pd.DataFrame({"source": key[0], "adapter": key[1], "event_id": ids, "at": attempts["at"].astype("datetime64[us]"), "state": states, "consecutive": counts,
                             "cooldown_until": pd.Series(untils, dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def circuit_states(stream: DataFrame, lateness: str = "1 hour", **options) -> DataFrame:
    """One row per attempt with the circuit state that follows it, in time order however the attempts arrive.

    An attempt is answered when the watermark, ``lateness`` behind the newest attempt of any circuit, has passed its slot;
    one that comes even later is dropped by the watermark and counted in the stream's progress. Attempts without a time have no
    place in the order and are left out; split them off before. The query needs the RocksDB state store (``runs.ROCKS``).
    """
    timed = stream.select("source", "adapter", "event_id", "success", "status", "at").where(F.col("at").isNotNull()).withWatermark("at", lateness)
    return timed.groupBy("source", "adapter").transformWithStateInPandas(CircuitProcessor(**options), CIRCUIT_OUT, "append", "eventTime")
