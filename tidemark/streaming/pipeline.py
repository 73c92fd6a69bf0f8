"""The event stream: typed events, dead letters, expiry, exactly-once sinks and rolling rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENTS


def sorted_out(events: DataFrame, event_type: str, payload: str = "payload") -> DataFrame:
    """Events of one type and of none that is known, in one pass: kind is good (with the decoded payload in `e`), dead (the
    payload doesn't decode) or unknown (no known type)."""
    mine = F.coalesce(F.col("event_type") == event_type, F.lit(False))
    none = ~F.coalesce(F.col("event_type").isin(*EVENTS), F.lit(False))
    parsed = events.where(mine | none).withColumn("e", F.when(mine, F.from_json(payload, f"{EVENTS[event_type]}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
    return parsed.withColumn("kind", F.when(none, "unknown").when(bad, "dead").otherwise("good")).withColumn("e", F.col("e").dropFields("_bad"))


def typed(events: DataFrame, event_type: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows of one type with the decoded payload in `e`, dead letters whose payload doesn't decode). Works on streams
    and tables; every consumer reads the stream with a query and checkpoint of its own."""
    rows = sorted_out(events, event_type, payload)
    return rows.where("kind = 'good'").drop("kind"), rows.where("kind = 'dead'").drop("e", "kind")


def unknown_types(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.col("event_type").isin(*EVENTS), F.lit(False)))


def replay_status(attempts: Column, status: Column, most: int = 3) -> Column:
    """What a replay makes of an event: failed once it was tried often enough, else pending; done stays."""
    return F.when(status == "consumed", status).when(attempts >= most, "failed").otherwise("pending")


def split_expired(events: DataFrame, at: str, asof: Column, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(fresh, expired): late pending events are set aside for audit, not lost."""
    old = F.coalesce(F.col(at) < asof - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)), F.lit(False))
    return events.where(~old), events.where(old)


def fresh_evidence(expires_at: Column, asof: Column) -> Column:
    """0 and null never expire."""
    return (F.coalesce(expires_at, F.lit(0)) == 0) | (expires_at > asof)


def promoted(stock: Column, made_at: Column, seconds: int) -> Column:
    """Evidence of an event: its own, or for events of before there was any, one that expires `seconds` after the record
    was made."""
    return F.coalesce(stock, F.struct(F.lit("record").alias("origin"), (made_at + F.lit(float(seconds))).alias("expires_at")))


def recovery(events: DataFrame, type_col: str, order: str, turns: list[str], caps: dict[str, int]) -> DataFrame:
    """Pending events with the turn of their type in a recovery; beyond a type's cap they come later. Other types are
    left out."""
    turn = F.array_position(F.array(*[F.lit(t) for t in turns]), F.col(type_col)).cast("int") - 1
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(type_col)]
    keys = [events.where(F.col(type_col) == t).orderBy(order).limit(n).agg(F.max(order).alias("_last")).withColumn(type_col, F.lit(t)) for t, n in caps.items()]
    last = keys[0]
    for k in keys[1:]:
        last = last.unionByName(k)
    known = events.where(F.col(type_col).isin(*turns)).join(F.broadcast(last), type_col, "left")
    return known.withColumn("turn", turn).withColumn("later", cap.isNotNull() & (F.coalesce(F.col(order) > F.col("_last"), F.lit(False)))).drop("_last")


def once(events: DataFrame, id_col: str, at: str, delay: str = "6 hours") -> DataFrame:
    """Each id once within the watermark's delay, on a stream."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col])


def rates(events: DataFrame, at: str, keys: list[str], length: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rows per sliding window and key; on a stream late rows within `delay` count."""
    marked = events.withWatermark(at, delay) if events.isStreaming else events
    return marked.groupBy(F.window(at, length, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def last_beats(events: DataFrame, at: str, source: str) -> DataFrame:
    return events.groupBy(source).agg(F.max(at).alias("last_emit_at"), F.count(F.lit(1)).alias("emit_count"))


def write_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """For foreachBatch: a batch that is run again overwrites its own folder, so its rows are there once."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
