"""Operators whose edges the catalog doesn't reach."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import change, match, price, report, rules, upsert
from tidemark.sources import files, nested
from tidemark.streaming import folds, pipeline


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_schemas_conform(spark):
    df = spark.createDataFrame([("7", "x", "junk")], "product_id STRING, size STRING, sell_now_price STRING")
    out = schemas.conform(df, "market_prices")
    assert out.columns == [f.name for f in schemas.schema("market_prices").fields]
    r = out.first()
    assert (r["product_id"], r["size"], r["sell_now_price"], r["fetched_at"]) == (7, "x", None, None)
    assert all(schemas.schema(t) for t in schemas.TABLES)


def test_latest_batch_keeps_ties(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 2, 7), (2, 9, 1)], "k INT, ts INT, v INT")
    assert rows(price.latest_batch(df, ["k"], "ts"), "k", "v") == [(1, 6), (1, 7), (2, 1)]
    assert rows(price.latest_row(df, ["k"], [F.col("ts"), F.col("v")]), "k", "v") == [(1, 7), (2, 1)]


def test_merge_size_prices(spark):
    a = spark.createDataFrame([("270", 10, None), ("280", 20, 5)], "size STRING, ask INT, last INT")
    b = spark.createDataFrame([("270", 7), ("280", 8), ("290", 9)], "size STRING, last INT")
    assert rows(price.merge_size_prices(a, b, ["size"], "last").na.fill(-1), "size", "ask", "last") == [("270", 10, 7), ("280", 20, 5), ("290", -1, 9)]


def test_small_changes_are_dropped(spark):
    df = spark.createDataFrame([(0, 999), (0, 1000), (100_000, 100_999), (100_000, 101_000), (10_000, 10_500)], "a BIGINT, b BIGINT")
    assert [r[0] for r in df.select(change.significant(F.col("a"), F.col("b"))).collect()] == [False, True, False, True, True]


def test_changes_over_the_cap_are_carried(spark):
    now, later = change.cap_changes(spark.range(5), "id", 2)
    assert rows(now, "id") == [(0,), (1,)]
    assert rows(later, "id") == [(2,), (3,), (4,)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k INT, ts INT, v STRING")
    new = spark.createDataFrame([(1, 5, "c"), (3, 1, "d"), (3, 2, "e")], "k INT, ts INT, v STRING")
    assert rows(upsert.upsert_latest(old, new, ["k"], [F.col("ts")]), "k", "v") == [(1, "c"), (2, "b"), (3, "e")]
    assert rows(upsert.insert_ignore(old, new, ["k"], [F.col("ts")]), "k", "v") == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(upsert.delete_keys(old, new, ["k"]), "k") == [(2,)]
    assert rows(upsert.retain(old.unionByName(old.select("k", F.lit(None).cast("int").alias("ts"), "v")), F.col("ts") == 5), "k") == [(1,), (2,)]


def test_token_join_and_size_check(spark):
    a = spark.createDataFrame([(1, "b", ["x", "y", "z"])], "id INT, brand STRING, w ARRAY<STRING>")
    b = spark.createDataFrame([(7, "b", ["x", "y"]), (8, "b", ["x"]), (9, "c", ["x", "y"])], "id INT, brand STRING, w ARRAY<STRING>")
    assert rows(match.token_join(a, b, "id", "id", "w", "w", "brand"), "lid", "rid", "shared") == [(1, 7, 2)]
    texts = spark.createDataFrame([(1, "a redbolt here"), (2, "bolt"), (3, "bol"), (4, "nothing"), (4, "nothing"), (5, None), (6, "xredbox")], "id INT, t STRING")
    words = spark.createDataFrame([("redb",), ("bolts",), ("hing",), ("abc",), (None,)], "w STRING")
    for few in (0, 100):
        got = match.substring_join(texts, words, F.col("t"), F.col("w"), few=few)
        assert sorted(r["id"] for r in got.collect()) == [1, 2, 4, 4, 6]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "product_id BIGINT, size INT, sell BIGINT, ts TIMESTAMP, price BIGINT, in_stock BOOLEAN, volume BIGINT")
    assert price.opportunities(e, e, e.select("product_id", "volume")).count() == 0
    assert report.order_stats(e, ["product_id"], "sell").count() == 0
    assert report.hit_rate(e, F.col("in_stock"), F.col("in_stock"), F.col("sell"), F.col("sell")).first()["hit_rate"] is None


def test_json_lines_with_bad_ones(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    good, bad = files.read_json_lines(spark, str(p), "a INT")
    assert rows(good, "a") == [(1,), (2,)]
    assert bad.count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"products": [{"id": 1, "name": "x"}, {"id": 2, "name": None}]}))
    assert files.read_json_array(spark, str(tmp_path / "d.json"), "products", "id: INT, name: STRING").count() == 2
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a/p/1 </loc></url><url><loc>https://a/q</loc></url></urlset>")
    assert rows(files.read_sitemap(spark, str(tmp_path / "s.xml"), "%/p/%"), "url") == [("https://a/p/1",)]
    (tmp_path / "log").write_text("x ERROR y\nWARNING z\nERROR\nERRORS\n")
    assert tuple(files.log_counts(spark, str(tmp_path / "log")).first()) == (2, 1)
    assert files.optional_table(spark, "no_such_table", "a INT").count() == 0
    files.append(spark.range(3), str(tmp_path / "t"))
    files.append(spark.range(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    (tmp_path / "w.json").write_text('{"id": 1}\n{"id": 2, "gap": 5}\n')
    assert rows(files.read_state(spark, str(tmp_path / "w.json"), "id INT, gap INT", {"gap": F.lit(0)}), "id", "gap") == [(1, 0), (2, 5)]


def test_graph_resolution():
    flat = [["Reactive", 1], {"a": 2, "b": 3, "c": 6, "self": 1}, "x", ["Set", 4, 5], 10, None, ["Map", 2, 4]]
    assert nested.resolve(flat) == {"a": "x", "b": [10, None], "c": {"x": 10}, "self": None}
    assert nested.resolve([{"n": -1, "o": 99}]) == {"n": None, "o": None}
    assert nested.resolve([["null", "k", 1], 5]) == {"k": 5}
    assert nested.find_values({"k": 1, "x": [{"k": {"k": 2}}]}, "k") == [1, {"k": 2}, 2]
    assert nested.find_objects([{"a": 1, "b": 2}, {"a": 1}], frozenset(("a", "b"))) == [{"a": 1, "b": 2}]


def test_graph_column(spark):
    df = spark.createDataFrame([('[{"a": 1}, 7]',), ("bad",), (None,), ("{}",)], "x STRING")
    assert [r[0] for r in df.select(nested.resolve_graph("x")).collect()] == ['{"a": 7}', None, None, None]


def test_nested_columns(spark):
    df = spark.createDataFrame([("240,168,1/245,0,1/x/ 250,2,1/",)], "x STRING")
    r = df.select(nested.packed_options(F.col("x")).alias("o")).select("o", nested.stocked_sizes(F.col("o")).alias("s")).first()
    assert [(o["size"], o["stock"], o["in_stock"]) for o in r["o"]] == [("240", 168, True), ("245", 0, False), (" 250", 2, True)]
    assert r["s"] == ["240", "250"]
    h = spark.createDataFrame([('<script id="D" type="x">{"a": {"b": 5}}</script><title> T </title>',)], "h STRING")
    got = h.select(nested.dig(nested.script_json(F.col("h"), 'id="D"'), "a", "b"), nested.title(F.col("h"))).first()
    assert tuple(got) == ("5", "T")


def test_steps():
    step, state, out = folds.cooldown(10), None, []
    for row in ((0, 1, 5), (5, 1, 9), (6, 2, 1), (15, 2, 1), (16, 2, 1)):
        state, e = step(state, row)
        out.append(e)
    assert out == [True, False, True, False, True]
    step, state = folds.dedup_window(10), None
    state, a = step(state, (0, "v", False))
    state, b = step(state, (1, "v", True))
    state, d = step(state, (2, "v", True))
    state, e = step(state, (3, "w", True))
    assert (a, b, d, e) == (True, True, False, True)
    step, state, out = folds.failure_streak(2, 5), None, []
    for row in ((0, True), (1, True), (3, False), (7, True), (8, False)):
        state, e = step(state, row)
        out.append(e)
    assert out == ["closed", "tripped", "open", "closed", "closed"]


def test_typed_events_and_dead_letters(spark):
    df = spark.createDataFrame([("AlertSent", '{"alert_id": 1, "signal": "buy"}'), ("AlertSent", "junk"), ("Other", "{}"), (None, None)], "event_type STRING, payload STRING")
    good, dead = pipeline.typed(df, "AlertSent")
    assert good.select("e.alert_id").collect()[0][0] == 1
    assert dead.count() == 1
    assert pipeline.unknown_types(df).count() == 2


def test_whole_tables_are_read(spark, data):
    from tidemark.plans import catalog

    orders, parts = (spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("orders", "part"))
    assert catalog.QUERIES["followup_sold"](spark, data).count() == orders
    assert catalog.QUERIES["hit_status"](spark, data).select("lid").distinct().count() == parts


def test_matches_do_not_pair_rows_under_a_key(spark):
    """20,000 rows on each side under one key would be 400 million pairs."""
    from tidemark.operators import match, quality

    n = 20_000
    left = spark.range(n).selectExpr("id as lid", "'k' as k", "array('red') as lt")
    right = spark.range(n).selectExpr("id as rid", "'k' as k", "array('blue', if(id % 2 = 1, 'red', 'green')) as rt")
    got = match.colour_pick(left, right, "k", "lid", "rid", "lt", "rt")
    assert got.groupBy("rid", "shared", "hits").count().collect() == [(1, 1, n, n)]
    assert match.hit_summary(left.drop("lt"), right.drop("rt"), "k", "rid").groupBy("rid", "hits", "status").count().collect() == [(None, n, "ambiguous", n)]
    f = spark.range(n).selectExpr("id", "1 as pid", "cast(null as int) as size", "id as at", "10 as p")
    s = spark.range(n).selectExpr("1 as pid", "cast(id % 5 as int) as size", "id as sold", "id % 20 as price")
    out = quality.sold_after(f, s, "pid", "size", "at", "p", "sold", "price")
    assert {r["sold"]: r["count"] for r in out.groupBy("sold").count().collect()} == {True: n - 1, False: 1}


def test_models_late_in_a_document_are_found(spark, tmp_path):
    from tidemark.plans import catalog

    rows = [(1, "word " * 100 + "DQ8423-100 tail"), (2, "word " * 100), (3, None)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["model"] for r in catalog.QUERIES["document_models"](spark, str(tmp_path)).collect()}
    assert got == {1: "DQ8423-100", 2: None}


def test_deep_json_is_null_and_spares_the_rest(spark):
    chain = lambda n: json.dumps([[i + 1] for i in range(n)] + [7])
    rows = [(chain(2000),), (chain(50_000),), ("[" * 100_000,), ("[" * 100_000 + "]" * 100_000,), ('[{"a": 1}, 7]',)]
    df = spark.createDataFrame(rows, "x STRING").coalesce(1)
    got = [r[0] for r in df.select(nested.resolve_graph("x")).collect()]
    assert got[0] == "[" * 2000 + "7" + "]" * 2000 and got[1:4] == [None, None, None] and got[4] == '{"a": 7}'
    assert [r[0] for r in df.select(nested.deep_values(F.col("x"), "a")).collect()][1:4] == [[], [], []]


def test_rules_by_source(spark):
    texts = [(1, "a", "신발AB123-45운동화"), (2, "b", "신발AB123-45운동화"), (3, "a", "none"), (4, "b", "none"), (5, "c", "AB123-45"), (6, "a", None), (7, None, "AB123-45"), (8, "a", "XAB123-451 AB1-23 AB9-87x")]
    rows_ = spark.createDataFrame(texts, "id INT, source STRING, t STRING")
    table = spark.createDataFrame([("a", 2, r"[A-Z]+\d+", "first", True), ("a", 1, r"([A-Z]+\d+)-(\d\d)", "first", False), ("b", 1, r"[A-Z]+\d+", "last", False)], rules.RULES)
    got = {r["id"]: (r["model"], r["status"]) for r in rules.codes_by_rule(rows_, table, "t").collect()}
    assert got == {1: ("AB123-45", "code"), 2: ("AB123", "code"), 3: (None, "hold"), 4: (None, "drop"), 5: (None, "drop"), 6: (None, "hold"), 7: (None, "drop"), 8: ("AB1-23", "code")}
    assert rules.codes_by_rule(rows_.limit(0), table, "t").count() == 0
    assert {r["status"] for r in rules.codes_by_rule(rows_, table.limit(0), "t").collect()} == {"drop"}
    with pytest.raises(ValueError):
        rules.codes_by_rule(rows_, table, "t", most=2)
    plan = rules.codes_by_rule(rows_, table, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_fallbacks_meet_one_row_a_key(spark):
    left = spark.createDataFrame([(1, "ab"), (2, "ax"), (3, "zz"), (4, None)], "id INT, k STRING")
    right = spark.createDataFrame([("ab", 9, "p"), ("ab", 8, "q"), ("a", 7, "r"), ("a", 6, "s"), (None, 1, "t")], "key STRING, rid INT, v STRING")
    got = match.fallback_join(left, right, [F.col("k"), F.substring("k", 1, 1)], "key", ["id"], "rid")
    assert rows(got, "id", "variant", "key", "rid", "v") == [(1, 0, "ab", 8, "q"), (2, 1, "a", 6, "s")]


def test_numbers_over_stretches(spark):
    df = spark.createDataFrame([(i * i - 50,) for i in range(40)], "k BIGINT")
    assert rows(report.numbered(df.repartition(5), "k", "n", width=16), "k", "n") == [(i * i - 50, i + 1) for i in range(40)]


def test_dictionaries_of_odd_words(spark):
    texts = spark.createDataFrame([(1, "ab\0cd"), (2, "xxabcdxx"), (3, "bcde"), (4, "deab"), (5, ""), (6, None)], "id INT, t STRING")
    words = spark.createDataFrame([("abcde",), ("abcd",)], "w STRING")
    for few in (0, 100):
        assert sorted(r["id"] for r in match.substring_join(texts, words, F.col("t"), F.col("w"), few=few).collect()) == [2, 3]
        assert match.substring_join(texts, words.limit(0), F.col("t"), F.col("w"), few=few).count() == 0


def test_site_maps_of_any_form(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<urlset>\n<url><loc> https://s/p/1 </loc><lastmod>x</lastmod></url><url><loc>\nhttps://s/p/2\n</loc></url><url><loc>https://s/n/3</loc></url></urlset> https://s/p/9")
    (tmp_path / "b.xml").write_text("<loc>https://s/p/1</loc><loc>two words</loc><loc></loc><loc>https://s/p/4")
    assert rows(files.read_sitemap(spark, str(tmp_path), "%/p/%"), "url") == [("https://s/p/1",), ("https://s/p/2",)]


def test_sales_of_later_days_count(spark):
    from tidemark.operators import quality

    f = spark.sql("""SELECT * FROM VALUES (1, 'p', 's', TIMESTAMP '2024-01-01 10:00', 50), (2, 'p', NULL, TIMESTAMP '2024-01-02 10:00', 70), (3, 'p', 's', TIMESTAMP '2024-01-03 12:00', 10), (4, 'q', 's', TIMESTAMP '2024-01-01', 1), (5, NULL, 's', TIMESTAMP '2024-01-01', 1), (6, 'p', 's', CAST(NULL AS TIMESTAMP), 1), (7, 'p', 's', TIMESTAMP '2024-01-02 09:00', 61) AS t(id, key, size, at, price)""")
    s = spark.sql("""SELECT * FROM VALUES ('p', 's', TIMESTAMP '2024-01-01 09:00', 99), ('p', 's', TIMESTAMP '2024-01-02 11:00', 60), ('p', 'x', TIMESTAMP '2024-01-05 11:00', 75), ('p', 's', TIMESTAMP '2024-01-03 12:00', 20), (NULL, 's', TIMESTAMP '2024-01-05', 9) AS t(key, size, sold, got)""")
    out = quality.sold_after(f, s, "key", "size", "at", "price", "sold", "got")
    assert rows(out, "id", "best", "sold") == [(1, 60, True), (2, 75, True), (3, None, False), (4, None, False), (5, None, False), (6, None, False), (7, 60, False)]


def test_places_in_large_groups(spark):
    """One group holds most rows, null is a group, and the ranges cut through groups."""
    rows = [("hot" if i % 10 else None if i % 20 else f"g{i % 7}", i * 7919 % 101, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, v INT, id INT").repartition(7)
    got = {(r["g"], r["id"]): r["n"] for r in report.placed(df, ["g"], [F.desc("v"), F.asc("id")], "n").collect()}
    want, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[g, i] = seen[g]
    assert got == want
    assert report.placed(df.limit(0), ["g"], [F.col("id")], "n").count() == 0


def test_events_sorted_out_in_one_pass(spark):
    e = spark.createDataFrame([(1, "AlertSent", '{"alert_id": 4}'), (2, "AlertSent", '{"alert'), (3, "Nope", "{}"), (4, None, "{}"), (5, "CatalogDumped", "{}"), (6, "AlertSent", None)], "id INT, event_type STRING, payload STRING")
    rows = pipeline.sorted_out(e, "AlertSent")
    assert {r["id"]: r["kind"] for r in rows.collect()} == {1: "good", 2: "dead", 3: "unknown", 4: "unknown", 6: "dead"}
    assert rows.where("id = 1").first()["e"]["alert_id"] == 4
    assert str(rows._jdf.queryExecution().optimizedPlan()).count("LogicalRDD") == 1
