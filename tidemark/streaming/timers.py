"""State that ends: steps per key whose record is released by an event-time timer, a later row, or an explicit one.

A step (see folds) keeps a record whose first field is its time. The record holds for `seconds`; then it is released, which
the stream emits as a row of its own, and the key's state is gone. A row that comes after a record's end in the same batch
releases it too, so the rows don't depend on how the stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .folds import Step

#: Timers need a state store that can be searched by time.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiring(StatefulProcessor):
    """keys: names of the grouping columns; id: column that names a row; fields: what the step sees, its time first; free:
    boolean column of rows that only release the record."""

    def __init__(self, keys: list[str], id: str, order: list[str], fields: list[str], step: Step, schema: str, seconds: float, free: str | None):
        self.keys, self.id, self.order, self.fields, self.step, self.schema, self.seconds, self.free = keys, id, order, fields, step, schema, seconds, free

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.record = handle, handle.getValueState("record", self.schema)

    def _ms(self, record: tuple) -> int:
        return round((record[0] + self.seconds) * 1000)

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=[self.id, "at", "kind"]).astype({self.id: "Int64"})
        return rows.assign(**dict(zip(self.keys, key)))[[*self.keys, self.id, "at", "kind"]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A key's rows of one batch, whose size the source's options bound, in order."""
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        before = tuple(self.record.get()) if self.record.exists() else None
        now, out = before, []
        frees = batch[self.free] if self.free else [False] * len(batch)
        for name, free, row in zip(batch[self.id], frees, batch[self.fields].itertuples(index=False, name=None)):
            if now is not None and row[0] - now[0] >= self.seconds:
                out.append((None, now[0] + self.seconds, "released"))
                now = None
            if free:
                if now is not None:
                    out.append((name, row[0], "freed"))
                now = None
                continue
            now, passed = self.step(now, row)
            if passed:
                out.append((name, row[0], "passed"))
        if now != before:
            if before is not None:
                self.handle.deleteTimer(self._ms(before))
            if now is None:
                self.record.clear()
            else:
                self.record.update(tuple(now))
                self.handle.registerTimer(self._ms(now))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.record.exists():
            end = tuple(self.record.get())[0] + self.seconds
            self.record.clear()
            yield self._rows(key, [(None, end, "released")])

    def close(self) -> None:
        pass


def expiring(df: DataFrame, keys: list[str], id: str, at: str, delay: str, order: list[str], fields: list[str], step: Step, schema: str, seconds: float, free: str | None = None) -> DataFrame:
    """keys, id (null for releases), at (seconds) and kind (passed, freed, released) of a stream whose event time is `at` and
    whose rows are at most `delay` late; later ones are dropped, as Spark drops them from any state."""
    fields_of = {f.name: f.dataType for f in df.schema.fields}
    out = StructType([*(StructField(k, fields_of[k]) for k in keys), StructField(id, LongType()), StructField("at", DoubleType()), StructField("kind", StringType())])
    processor = Expiring(keys, id, order, fields, step, schema, seconds, free)
    return df.withWatermark(at, delay).groupBy(*keys).transformWithStateInPandas(processor, out, "append", "eventTime")
