"""Observations of controls as they arrive: late, future and repeated ones refused, and a window of days kept for each key.

The same fold runs over a table (rows in the order of their arrival) and over a
stream, where it is the state of a key: it lives on in the checkpoint and
expires when the watermark has passed the key's window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.folds import fold_sorted

SECOND, DAY = 1_000_000, 86_400_000_000
OUTPUT = "event_id long, key long, status string, passes long, fails long, verdict string"
STATE = "latest long, days array<long>, passes array<long>, fails array<long>, ids array<long>, times array<long>"


@dataclass(frozen=True)
class Rules:
    """Seconds that a clock may be ahead, hours after which an event is stale, days of the window, and the least share of passes."""

    skew: int = 300
    hours: int = 24
    days: int = 30
    least: float = 1.0
    least_events: int = 3


@dataclass
class Observed:
    """A key's state: counts of each day of the window, and the ids that could come again."""

    latest: int = 0
    days: dict[int, list[int]] = field(default_factory=dict)
    ids: dict[int, int] = field(default_factory=dict)

    def take(self, rules: Rules, event_id: int | None, at: int | None, seen: int | None, passed: bool | None) -> tuple[str, int, int, str]:
        """(status, passes, fails, verdict) after an event; all but accepted ones leave the state as it is."""
        status = self._status(rules, event_id, at, seen, passed)
        if status == "accepted":
            self.latest = max(self.latest, at)
            self.days.setdefault(at // DAY, [0, 0])[0 if passed else 1] += 1
            self.ids[event_id] = at
            first = self.latest // DAY - rules.days + 1
            self.days = {d: n for d, n in self.days.items() if d >= first}
            # what is older than a day before the latest event seen would be stale; twice that covers its skew
            if len(self.ids) > 64:
                self.ids = {i: t for i, t in self.ids.items() if t >= self.latest - 2 * rules.hours * 3600 * SECOND}
        passes, fails = (sum(n[k] for n in self.days.values()) for k in (0, 1))
        enough = passes + fails >= rules.least_events
        return status, passes, fails, "INSUFFICIENT_DATA" if not enough else "COMPLIANT" if passes >= rules.least * (passes + fails) else "NON_COMPLIANT"

    def _status(self, rules: Rules, event_id, at, seen, passed) -> str:
        if event_id is None or at is None or seen is None or passed is None:
            return "invalid"
        if event_id in self.ids:
            return "repeated"
        if at > seen + rules.skew * SECOND:
            return "future"
        return "stale" if at < seen - rules.hours * 3600 * SECOND else "accepted"

    def packed(self) -> tuple:
        days = sorted(self.days)
        return self.latest, days, [self.days[d][0] for d in days], [self.days[d][1] for d in days], list(self.ids), list(self.ids.values())

    @classmethod
    def unpacked(cls, latest, days, passes, fails, ids, times) -> Observed:
        return cls(latest, {d: [p, f] for d, p, f in zip(days, passes, fails, strict=True)}, dict(zip(ids, times, strict=True)))


def arrivals(events: DataFrame, key: str, at: str, seen: str, passed) -> DataFrame:
    """(event_id, key, at, seen, passed) with times in microseconds, as both folds read them."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return events.select(F.col("event_id").cast("long").alias("event_id"), F.col(key).cast("long").alias("key"), micros(at).alias("at"), micros(seen).alias("seen"), passed.alias("passed"), F.col(seen).cast("timestamp").alias("watermark_ts"))


def observe(arrived: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(event_id, key, status, passes, fails, verdict) of each arrival of a table, in the order of (seen, event_id)."""

    def step(state: Observed, r: dict) -> tuple:
        return (r["event_id"], r["key"], *state.take(rules, r["event_id"], r["at"], r["seen"], r["passed"]))

    return fold_sorted(arrived.drop("watermark_ts"), "key", ["seen", "event_id", "at"], Observed, step, OUTPUT)


def observe_stream(arrived: DataFrame, rules: Rules = Rules(), *, late: str = "1 hour") -> DataFrame:  # noqa: B008
    """The same of a stream whose micro-batches come in the order of arrival.

    A key's state goes when the watermark (``late`` behind the latest arrival) has passed its window: what comes
    later than that would begin a new one anyway.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Observed.unpacked(*state.get) if state.exists else Observed()
        rows = pd.concat(list(frames)).sort_values(["seen", "event_id", "at"], na_position="first")
        there = lambda x: None if pd.isna(x) else x
        whole = lambda x: None if pd.isna(x) else int(x)
        out = [(whole(r.event_id), there(key[0]), *own.take(rules, whole(r.event_id), whole(r.at), whole(r.seen), there(r.passed))) for r in rows.itertuples()]
        state.update(own.packed())
        state.setTimeoutTimestamp(max((own.latest + rules.days * DAY) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "key", "status", "passes", "fails", "verdict"])

    timed = arrived.withWatermark("watermark_ts", late)
    return timed.groupBy("key").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
