"""State that ends, consumers that stop, keyed tables that change in part."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import change, upsert
from tidemark.sources.keyed import KeyedTable
from tidemark.streaming import backlog, consumers, folds, pipeline, polling, timers

HOUR = 3600.0
SCHEMA = "event_id LONG, item STRING, s DOUBLE, v INT, ok BOOLEAN, free BOOLEAN"


def run_timed(spark, root, step=None, seconds=6 * HOUR):
    """One run over the files in root/in, as a stream that goes on from its checkpoint."""
    e = spark.readStream.schema(SCHEMA).parquet(f"{root}/in/*").withColumn("ts", F.timestamp_seconds("s"))
    out = timers.expiring(e, ["item"], "event_id", "ts", "1 hour", ["s", "event_id"], ["s", "v", "ok"], step or folds.dedup_window(seconds), "s DOUBLE, v INT", seconds, "free")
    spark.conf.set(timers.PROVIDER, timers.ROCKS)
    try:
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
        q.awaitTermination()
    finally:
        spark.conf.unset(timers.PROVIDER)
    rows = sorted((r["item"], r["at"] / HOUR, r["kind"], r["event_id"]) for r in spark.read.schema(out.schema).parquet(f"{root}/out").collect())
    return rows, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def add(spark, root, n, rows):
    spark.createDataFrame([(i, item, h * HOUR, v, ok, free) for i, item, h, v, ok, free in rows], SCHEMA).write.parquet(f"{root}/in/part-{n}")


def test_release_at_six_hours_and_not_before(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    add(spark, root, 0, [(1, "a", 10.0, 1, True, False), (2, "b", 10.5, 1, False, False), (3, "c", 11.0, 1, True, False)])
    rows, left = run_timed(spark, root)
    assert rows == [("a", 10.0, "passed", 1), ("b", 10.5, "passed", 2), ("c", 11.0, "passed", 3)]
    assert left > 0
    # The watermark comes to 15.9 h: a's record, which ends at 16, still holds; c's evidence expires.
    add(spark, root, 1, [(4, "a", 15.95, 1, True, False), (5, "z", 16.9, 1, False, False), (6, "c", 12.0, 1, True, True), (7, "c", 16.0, 1, True, False)])
    more, left = run_timed(spark, root)
    assert set(more) - set(rows) == {("z", 16.9, "passed", 5), ("c", 16.0, "passed", 7)} | ({("c", 12.0, "freed", 6)} if ("c", 12.0, "freed", 6) in more else set())
    assert not any(r[2] == "released" for r in more)
    # Past 16 h, then past everything: each record is released at its end, and nothing is left.
    add(spark, root, 2, [(8, "z", 17.1, 1, False, False)])
    third, _ = run_timed(spark, root)
    assert ("a", 16.0, "released", None) in third and [r for r in third if r[2] == "released"] == [("a", 16.0, "released", None)]
    add(spark, root, 3, [(9, "z", 40.0, 1, False, False)])
    last, left = run_timed(spark, root)
    assert ("c", 22.0, "released", None) in last
    assert left == 0


def test_cut_into_batches_changes_nothing(spark):
    rows = [(i, "ab"[i % 2], 1 + i * 1.7, i % 2, i % 5 != 0, i % 7 == 3) for i in range(40)]
    results = []
    for cuts in ([rows], [rows[:13], rows[13:14], rows[14:]]):
        root = tempfile.mkdtemp(prefix="spark-")
        for n, part in enumerate([*cuts, [(99, "z", 500.0, 0, False, False)]]):
            add(spark, root, n, part)
            got = run_timed(spark, root)
        results.append(got)
    assert results[0] == results[1]
    assert results[0][1] == 0


def mtimes(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "/rows/" in d}


def test_merge_touches_only_its_buckets(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    t = KeyedTable(spark, path, ["id"], "id LONG, v LONG", 8)
    latest = lambda old, new: upsert.upsert_latest(old, new, ["id"], [F.col("v")])
    assert t.read().count() == 0 and t.versions() == []
    assert t.merge(spark.range(200).selectExpr("id", "id v"), 0, latest) == set(range(8))
    before = mtimes(path)
    touched = t.merge(spark.createDataFrame([(5, 500), (5, 7)], "id LONG, v LONG"), 1, latest)
    assert len(touched) == 1
    after = mtimes(path)
    assert all(after[f] == m for f, m in before.items())
    assert {f.rpartition("bucket=")[2].split("/")[0] for f in set(after) - set(before)} == {str(b) for b in touched}
    assert {r["id"]: r["v"] for r in t.read().collect()} == {i: 500 if i == 5 else i for i in range(200)}
    assert {r["v"] for r in t.read(0).where("id = 5").collect()} == {5}
    assert t.read(of=spark.createDataFrame([(5,)], "id LONG")).count() == sum(1 for _ in t.read(of=spark.createDataFrame([(5,)], "id LONG")).collect()) < 200
    # A version that is there is not merged again; one without a manifest never was.
    assert t.merge(spark.createDataFrame([(5, 900)], "id LONG, v LONG"), 1, latest) == set()
    os.remove(f"{path}/manifest/1/_SUCCESS")
    assert t.versions() == [0] and t.read().where("id = 5").first()["v"] == 5
    t.merge(spark.createDataFrame([(5, 900)], "id LONG, v LONG"), 1, latest)
    assert t.read().where("id = 5").first()["v"] == 900
    t.merge(spark.createDataFrame([], "id LONG, v LONG"), 2, latest)
    t.vacuum()
    assert t.versions() == [2] and t.read().count() == 200


def test_merge_may_empty_a_bucket(spark):
    t = KeyedTable(spark, tempfile.mkdtemp(prefix="spark-"), ["id"], "id LONG, v LONG", 2)
    rows = spark.createDataFrame([(1, 1)], "id LONG, v LONG")
    t.merge(rows, 0, lambda old, new: old.unionByName(new))
    t.merge(rows, 1, lambda old, new: upsert.delete_keys(old, new, ["id"]))
    assert t.read().count() == 0


@pytest.mark.parametrize("crash", [0, 1, 2])
def test_consumers_stop_and_go_on(spark, crash):
    schema = "id LONG, kind STRING, ok BOOLEAN"
    parts = [[(i, "x" if i % 2 else "y", i % 4 == n) for i in range(10)] for n in range(3)]
    two = [consumers.Consumer("x", F.col("kind") == "x", F.col("ok")), consumers.Consumer("rest", F.col("kind") != "x", F.lit(None).cast("boolean"))]
    results = []
    for stop in (None, crash):
        root = tempfile.mkdtemp(prefix="spark-")
        for n, p in enumerate(parts):
            spark.createDataFrame(p, schema).write.parquet(f"{root}/in/part-{n}")
            stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
            consumers.consume(stream, two, root, "id", crash_in=stop if n == stop else None)
        consumers.consume(spark.readStream.schema(schema).parquet(f"{root}/in/*"), two, root, "id")
        results.append({c.name: sorted(tuple(r) for r in consumers.sink(spark, root, c.name).read().collect()) for c in two})
    assert results[0] == results[1]
    assert results[0]["rest"] == [(i, 3, "failed") for i in range(0, 10, 2)]
    assert results[0]["x"] == [(i, 3, "consumed" if i % 4 in (0, 1, 2) else "failed") for i in range(1, 10, 2)]


def test_poll_run_again(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    p = polling.DeltaPoller(spark, root, "id", ["v"], 2, lambda rows: F.col("v") != 3)
    for n, v in enumerate([[1, 2, 3, 4], [1, 2, 3, 5]]):
        rows = spark.createDataFrame(list(enumerate(v)), "id LONG, v LONG")
        p.poll(rows, n)
        p.poll(rows, n)
    log = sorted((r["batch"], r["id"], r["change"], r["handled"]) for r in p.log().collect())
    assert log == [(0, 0, "new", "done"), (0, 1, "new", "done"), (0, 2, "new", "waiting"), (0, 3, "new", "waiting"), (1, 2, "new", "failed"), (1, 3, "new", "done")]
    assert sorted((r["id"], r["batch"]) for r in p.marked.read().collect()) == [(0, 0), (1, 0), (3, 1)]


def test_late_rows_are_kept(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for n, hours in enumerate([[10, 1], [9, 3, 20], [13, 15]]):
        rows = spark.createDataFrame([(h,) for h in hours], "h INT").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
        consumers.split_late(rows, n, "ts", 6 * 3600, root)
    got = sorted((r["batch"], r["h"], r["late"]) for r in spark.read.parquet(f"{root}/rows").collect())
    assert got == [(0, 1, "false"), (0, 10, "false"), (1, 3, "true"), (1, 9, "false"), (1, 20, "false"), (2, 13, "true"), (2, 15, "false")]


def test_backlog_takes_by_priority(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    deliveries = [[(2, 1, "a"), (2, 2, "b"), (1, 9, "c"), (2, 3, "d"), (None, 7, "n")], [(0, 5, "e"), (2, 0, "f"), (2, 2, "g"), (2, 2, "g")], []]
    for n, rows in enumerate(deliveries):
        spark.createDataFrame(rows, "turn INT, id INT, name STRING").coalesce(1).write.parquet(f"{root}/in/part-{n}")
    waiting, want, left = backlog.Backlog(spark, f"{root}/log", ["turn", "id"], 2), [], []
    assert waiting.left() == 0 and waiting.taken() is None and waiting.waiting() is None

    def twice(rows, number):
        waiting.take(rows, number)
        waiting.take(rows, number)

    for n, rows in enumerate(deliveries):
        twice(spark.read.parquet(f"{root}/in/part-{n}"), n)
        left = sorted([*left, *rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want += [(n, *r) for r in left[:2]]
        left = left[2:]
        assert waiting.left() == len(left)
    assert waiting.waiting().count() == len(left) > 0
    for n in range(3, 7):
        twice(None, n)
        want += [(n, *r) for r in left[:2]]
        left = left[2:]
    got = [(r["batch"], r["turn"], r["id"], r["name"]) for r in waiting.taken().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 9
    assert waiting.waiting() is None


def test_backlog_batch_that_stopped(spark, monkeypatch):
    """A batch that wrote its rows but no marks is taken again, from the same state."""
    root = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame([(i % 3, i) for i in range(20)], "turn INT, id INT")
    waiting = backlog.Backlog(spark, root, ["turn", "id"], 6)
    waiting.take(rows, 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "merge", lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
        with pytest.raises(RuntimeError):
            waiting.take(rows, 1)
    assert waiting.left() == 14
    waiting.take(rows, 1)
    assert waiting.left() == 28
    got = sorted((r["batch"], r["turn"], r["id"]) for r in waiting.taken().collect())
    first = sorted((i % 3, i) for i in range(20))
    second = sorted([*first[6:], *first])
    assert got == sorted([(0, *r) for r in first[:6]] + [(1, *r) for r in second[:6]])


def test_backlog_over_files_of_a_stream(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).selectExpr("id % 2 turn", "id").coalesce(1).write.parquet(f"{root}/in/part-{n}")
    waiting = backlog.Backlog(spark, f"{root}/log", ["turn", "id"], 8)
    stream = spark.readStream.schema("turn LONG, id LONG").option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(waiting.take).start().awaitTermination()
    sizes = {r["batch"]: r["count"] for r in waiting.taken().groupBy("batch").count().collect()}
    assert sizes == {0: 8, 1: 8, 2: 8} and waiting.left() == 6
    # All even numbers come before any odd one that was delivered no earlier.
    assert waiting.waiting().where("turn = 0").count() == 0


def snapshot(spark, rows, buckets=8):
    t = KeyedTable(spark, tempfile.mkdtemp(prefix="spark-"), ["id"], "id LONG, v STRING, w STRING", buckets)
    t.merge(spark.createDataFrame(rows, t.schema), 0, lambda old, new: new)
    return t


def test_bucket_diff_joins_only_what_differs(spark):
    rows = [(i, f"v{i}", None) for i in range(300)]
    a, b = snapshot(spark, rows), snapshot(spark, rows[::-1])
    assert change.differing(a, b) == set()
    assert {r["change"] for r in change.bucket_diff(a, b, ["v", "w"]).collect()} == {"same"}
    moved = [(i, None, f"v{i}") if i == 7 else (i, v, w) for i, v, w in rows]  # the same values in other columns
    c = snapshot(spark, moved)
    assert len(change.differing(a, c)) == 1
    diff = change.bucket_diff(a, c, ["v", "w"])
    assert sorted(map(tuple, diff.collect())) == sorted(map(tuple, change.snapshot_diff(a.read(), c.read(), "id", ["v", "w"]).collect()))
    bucket = next(iter(change.differing(a, c)))
    assert [f for f in diff.inputFiles() if a.path in f] and all(f"bucket={bucket}/" in f for f in diff.inputFiles() if a.path in f)


def test_bucket_diff_of_versions(spark):
    t = snapshot(spark, [(i, "x", "y") for i in range(100)])
    t.merge(spark.createDataFrame([(5, "z", "y"), (200, "n", None)], t.schema), 1, lambda old, new: upsert.upsert_latest(old, new, ["id"], [F.lit(0)]))
    t.merge(spark.createDataFrame([(9, "x", "y")], t.schema), 2, lambda old, new: upsert.upsert_latest(old, new, ["id"], [F.lit(0)]))
    assert change.differing(t, t, 1, 1) == set()
    assert change.differing(t, t, 1, 2) == set()  # rewritten, but with the same rows
    got = {r["id"]: r["change"] for r in change.bucket_diff(t, t, ["v", "w"], 0, 2).collect()}
    assert got == {i: {5: "changed", 200: "new"}.get(i, "same") for i in [*range(100), 200]}
    empty = KeyedTable(spark, tempfile.mkdtemp(prefix="spark-"), ["id"], t.schema, 8)
    assert {r["change"] for r in change.bucket_diff(t, empty, ["v", "w"]).collect()} == {"stale"}
    assert change.bucket_diff(empty, empty, ["v", "w"]).count() == 0
    with pytest.raises(ValueError):
        change.differing(t, snapshot(spark, [(1, "x", "y")], 4))


def test_windows_close_once_and_late_rows_count(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    parts = [[0, 30, 65], [62, 100, 20], [40, 300]]  # minutes; the delay is half an hour
    out = None
    for n, part in enumerate(parts):
        spark.createDataFrame([(m, "a") for m in part], "m INT, kind STRING").withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).write.parquet(f"{root}/in/part-{n}")
        stream = spark.readStream.schema("m INT, kind STRING, ts TIMESTAMP").parquet(f"{root}/in/*")
        out = pipeline.rates(stream, "ts", ["kind"], "30 minutes", "10 minutes", "30 minutes")
        q = out.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda b, i: pipeline.write_once(b, i, f"{root}/rows")).start()
        q.awaitTermination()
    got = sorted((r["start"].minute + 60 * r["start"].hour + 1440 * (r["start"].day - 1 if r["start"].year == 1970 else -1), r["n"]) for r in spark.read.schema(out.schema).parquet(f"{root}/rows").selectExpr("cast(start as timestamp_ntz) start", "n").collect())
    want, closed = {}, -(10**9)
    for part in parts:
        for m in part:
            for s in (m // 10 * 10 - 10 * h for h in range(3)):
                if s + 30 > closed:
                    want[s] = want.get(s, 0) + 1
        closed = max(closed, max(part) - 30)
    assert got == sorted((s, n) for s, n in want.items() if s + 30 <= closed)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == sum(s + 30 > closed for s in want)
