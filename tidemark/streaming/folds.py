"""Stateful steps per key: pure step functions, run over a table in order or over a stream with kept state.

A step takes the state (a tuple or None) and a row and returns (state, emitted). Batch runs sort each key's rows within
hash partitions and stream them past one state, so a key of any size needs the memory of one state. Streams keep the same
state in Spark's state store. Both give the same rows for the same input in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = tuple | None
Step = Callable[[State, tuple], tuple[State, object]]


def cooldown(seconds: float, profit_escape: float | None = None) -> Step:
    """Row: (time, rank, profit). Emits unless the key emitted within `seconds`, but for a higher rank, or (if given)
    more than profit_escape times the last emitted profit."""

    def step(state: State, row: tuple) -> tuple[State, object]:
        ts, rank, profit = row
        if state is not None and ts - state[0] < seconds:
            if rank <= state[1] and not (profit_escape is not None and profit > profit_escape * state[2]):
                return state, False
        return (ts, rank, profit), True

    return step


def dedup_window(seconds: float) -> Step:
    """Row: (time, value, ok). A value within `seconds` of its last recorded time is a duplicate; a changed value starts
    anew; rows that did not succeed are passed but not recorded."""

    def step(state: State, row: tuple) -> tuple[State, object]:
        ts, value, ok = row
        if state is not None and state[1] == value and ts - state[0] < seconds:
            return state, False
        return ((ts, value) if ok else state), True

    return step


def baseline_spike(delta: float, ratio: float) -> Step:
    """Row: (time, price, volume). The first sight sets the baseline; a spike is emitted and becomes the baseline."""

    def step(state: State, row: tuple) -> tuple[State, object]:
        _, price, volume = row
        if state is None:
            return (price, volume), False
        hit = (state[0] > 0 and abs(price - state[0]) / state[0] >= delta) or (state[1] > 0 and volume / state[1] >= ratio)
        return ((price, volume) if hit else state), hit

    return step


def failure_streak(limit: int, pause: float) -> Step:
    """Row: (time, failed). Emits closed, open or tripped: `limit` failures in a row open the circuit for `pause`
    seconds; a success closes it."""

    def step(state: State, row: tuple) -> tuple[State, object]:
        ts, failed = row
        n, until = state or (0, 0.0)
        if ts < until:
            return (n, until), "open"
        n = n + 1 if failed else 0
        return ((0, ts + pause), "tripped") if n >= limit else ((n, 0.0), "closed")

    return step


def fold(df: DataFrame, keys: list[str], order: list[str], fields: list[str], step: Step, out: str, kind: str) -> DataFrame:
    """Every row with the step's result in column `out` (type `kind`); `order` must be total within a key."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in parts:
            result = []
            for key, row in zip(pdf[keys].itertuples(index=False, name=None), pdf[fields].itertuples(index=False, name=None)):
                if key != at:
                    at, state = key, None
                state, emitted = step(state, row)
                result.append(emitted)
            yield pdf[names].assign(**{out: result})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def stream(df: DataFrame, keys: list[str], order: list[str], fields: list[str], step: Step, state_schema: str, ttl_ms: int | None = None) -> DataFrame:
    """The rows a stream's step emits (result true), with the state kept per key; batches are taken in `order`. With
    ttl_ms a key that rests so long (processing time) forgets its state."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")
        keep = []
        for row in rows[fields].itertuples(index=False, name=None):
            now, emitted = step(now, row)
            keep.append(bool(emitted))
        if now is not None:
            state.update(tuple(now))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield rows.loc[keep, names]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", timeout)


def epoch(column: str) -> Column:
    return F.col(column).cast("timestamp").cast("double")
