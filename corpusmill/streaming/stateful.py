"""Operators that keep state for each key of a stream; the batch operators with the same results are named beside them.

They need a state store that holds timers: ``spark.sql.streaming.stateStore.providerClass`` has to name RocksDB's provider.
State of a key goes when its timer fires, so what is kept is bounded by the keys that were active lately.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64")).tolist()


class _Spaced(StatefulProcessor):
    """Keeps a row if the last one kept of its key is some seconds older."""

    def __init__(self, ts: str, order: str, seconds: int):
        self.ts, self.order, self.gap = ts, order, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "kept long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.order])
        last, keep = (self.last.get()[0] if self.last.exists() else None), []
        for t in _micros(pdf[self.ts]):
            keep.append(last is None or t - last >= self.gap)
            last = t if keep[-1] else last
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        # once the watermark is that far, no row can come too soon any more
        self.handle.registerTimer((last + self.gap) // 1000 + 1)
        yield pdf[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held open."""


def spaced(events: DataFrame, keys: list[str], ts: str, order: str, seconds: int, late: str) -> DataFrame:
    """Events of a stream that come ``seconds`` or more after the last one kept of their keys (``quality.without_repeats``).

    Rows of one batch are taken in order of time; a row that comes after later ones of its key and isn't ``late`` is compared
    with the last one kept as well.
    """
    rows = events.select(*keys, ts, order).withWatermark(ts, late)
    return rows.groupBy(*keys).transformWithStateInPandas(_Spaced(ts, order, seconds), rows.schema, "append", "EventTime", eventTimeColumnName=ts)


class _Keys(StatefulProcessor):
    """Walks a key through active, resting until a time, and blocked."""

    def __init__(self, key: str, ts: str, rest: int):
        self.key, self.ts, self.rest = key, ts, rest * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until, self.blocked = handle, handle.getValueState("until", "until long"), handle.getValueState("blocked", "blocked boolean")

    def _rows(self, key, found: list[tuple[int, str, int | None]]) -> Iterator[pd.DataFrame]:
        if found:
            at, state, until = zip(*found)
            stamp = lambda x: pd.to_datetime(pd.Series(x, dtype="Int64"), unit="us")
            yield pd.DataFrame({self.key: key[0], self.ts: stamp(at), "state": state, "until": stamp(until)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.blocked.exists():
            return
        pdf = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        until, found = (self.until.get()[0] if self.until.exists() else None), []
        # by place: a column that is only renamed comes under its old name
        for t, kind in zip(_micros(pdf[self.ts]), pdf.iloc[:, 2]):
            if until is not None and t > until:
                found.append((until, "active", None))
                until = None
            if kind == "blocked":
                found.append((t, "blocked", None))
                self.blocked.update((True,))
                until = None
                break
            if kind == "exhausted":
                until = t + self.rest
                found.append((t, "resting", until))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is None:
            self.until.clear()
        else:
            self.until.update((until,))
            self.handle.registerTimer(until // 1000 + 1)
        yield from self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.until.exists():
            until = self.until.get()[0]
            self.until.clear()
            yield from self._rows(key, [(until, "active", None)])

    def close(self) -> None:
        """Nothing is held open."""


def key_states(events: DataFrame, key: str, ts: str, kind: Column, rest: int, late: str) -> DataFrame:
    """What becomes of each key of a pool, row by row: resting (``until`` a time), active again, blocked for good.

    ``kind`` is ``exhausted`` (the key rests for ``rest`` seconds from then), ``blocked`` or anything else. A key that rests
    becomes active when its time is over, without any event: a timer sees to it. ``key_transitions`` gives the same of a table.
    """
    rows = events.select(key, ts, kind.alias("_kind")).withWatermark(ts, late)
    types = dict(rows.dtypes)
    schema = f"{key} {types[key]}, {ts} timestamp, state string, until timestamp"
    return rows.groupBy(key).transformWithStateInPandas(_Keys(key, ts, rest), schema, "append", "EventTime", eventTimeColumnName=ts)


def key_transitions(events: DataFrame, key: str, ts: str, kind: Column, rest: int, now: Column) -> DataFrame:
    """``key_states`` of a table up to ``now``: ``key``, ``ts``, ``state`` and ``until``."""
    rows = events.select(F.col(key), F.col(ts), kind.alias("_kind")).where(F.col("_kind").isin("exhausted", "blocked"))
    blocked = rows.where("_kind = 'blocked'").groupBy(key).agg(F.min(ts).alias("_blocked"))
    ends = rows.where("_kind = 'exhausted'").join(blocked, key, "left").where(F.col("_blocked").isNull() | (F.col(ts) < F.col("_blocked")))
    until = F.timestamp_add("SECOND", F.lit(rest), F.col(ts))
    resting = ends.select(key, F.col(ts), until.alias("until"), F.lead(ts).over(Window.partitionBy(key).orderBy(ts)).alias("_next"), "_blocked")
    over = F.col("until") < F.least(F.coalesce("_next", now), F.coalesce("_blocked", now), now)
    out = resting.select(key, ts, F.lit("resting").alias("state"), "until")
    out = out.unionByName(resting.where(over).select(key, F.col("until").alias(ts), F.lit("active").alias("state"), F.lit(None).cast("timestamp").alias("until")))
    return out.unionByName(blocked.select(key, F.col("_blocked").alias(ts), F.lit("blocked").alias("state"), F.lit(None).cast("timestamp").alias("until")))

