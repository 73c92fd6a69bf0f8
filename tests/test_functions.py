"""Column functions on known values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import money, sizes, text, tiers, times
from tidemark.operators import gates, score


@pytest.fixture
def ev(spark):
    """Value of an expression over literal arguments."""

    def run(expr, schema, *values):
        return spark.createDataFrame([values], schema).select(expr.alias("r")).first()["r"]

    return run


c = F.col


@pytest.mark.parametrize("price, fee", [(130000, 11330), (0, 2750), (500000, 35750), (167000, 13772)])
def test_fees(ev, price, fee):
    assert ev(money.sell_fee(c("p")), "p BIGINT", price) == fee
    assert ev(money.total_fees(c("p")), "p BIGINT", price) == fee + 5500


@pytest.mark.parametrize("cost, sell, profit", [(80000, 130000, 33170), (120000, 130000, -6830)])
def test_profit(ev, cost, sell, profit):
    assert ev(money.net_profit(c("s"), c("k")), "s BIGINT, k BIGINT", sell, cost) == profit


@pytest.mark.parametrize("profit, volume, want", [(954, 10, "none"), (50000, 0, "none"), (50000, None, "none"), (30000, 1, "strong_buy"), (15000, 1, "buy"), (5000, 1, "watch"), (4999, 1, "none")])
def test_signal(ev, profit, volume, want):
    assert ev(money.signal(c("p"), c("v")), "p BIGINT, v INT", profit, volume) == want


def test_roi_and_discount(ev):
    assert ev(money.roi(c("p"), c("k")), "p BIGINT, k BIGINT", 1, 0) == 0.0
    assert ev(money.discount_rate(c("s"), c("o")), "s BIGINT, o BIGINT", 75, 100) == 0.25
    assert ev(money.discount_rate(c("s"), c("o")), "s BIGINT, o BIGINT", 100, 100) == 0.0


@pytest.mark.parametrize("raw, want", [("1,234.5", 12345), ("0", None), ("-", None), (None, None), ("9,900원", 9900)])
def test_digits(ev, raw, want):
    assert ev(money.digits(c("x")), "x STRING", raw) == want


def test_prices(ev):
    assert ev(money.real_price(c("x")), "x BIGINT", 8_000_000) is None
    assert ev(money.real_price(c("x")), "x BIGINT", 7_999_999) == 7_999_999
    assert ev(money.price_or_zero(c("x")), "x STRING", "12,300원") == 12300
    assert ev(money.price_or_zero(c("x")), "x STRING", None) == 0
    assert ev(money.price_insane(c("s"), c("k")), "s BIGINT, k BIGINT", 500, 100) is False
    assert ev(money.price_insane(c("s"), c("k")), "s BIGINT, k BIGINT", 501, 100) is True
    assert ev(money.price_insane(c("s"), c("k")), "s BIGINT, k BIGINT", 501, 0) is False


def test_state_hash_tells_null_from_zero(ev):
    a = ev(money.state_hash(c("a"), c("b")), "a INT, b INT", None, 1)
    b = ev(money.state_hash(c("a"), c("b")), "a INT, b INT", 1, None)
    assert a != b


@pytest.mark.parametrize("raw, want", [(" dq8423  100 ", "DQ8423-100"), ("a--b", "A-B"), ("-x-", "X"), (None, "")])
def test_normalize_model(ev, raw, want):
    assert ev(text.normalize_model(c("x")), "x STRING", raw) == want


@pytest.mark.parametrize("a, b, want", [("dq8423 100", "DQ8423-100", True), ("DQ8423100", "DQ8423-100", True), ("DQ8423", "DQ8423-100", False), ("", "", False), (None, "x", False), ("25-002", "CU9225-002", False)])
def test_models_match(ev, a, b, want):
    assert ev(text.models_match(c("a"), c("b")), "a STRING, b STRING", a, b) is want


@pytest.mark.parametrize("name, want", [
    ("Low Dunk DQ8423-100", "DQ8423-100"), ("574 U7408PL", "U7408PL"), ("Samba OG B75806", "B75806"), ("로우 W - 세일:화이트 / IO4244-100", "IO4244-100"), ("NBPDGS197F / U204LMMA (BROWN)", "U204LMMA"),
    ("XT-위스퍼_L47801400", "L47801400"), ("그레이1203A529-100", "1203A529-100"), ("x 1203A759103", "1203A759-103"), ("cap 15131628", "15131628"), ("sale 20240101", None), ("x 409183-01", "409183-01"),
    ("x 563508C", "563508C"), ("x 1J793C", "1J793C"), ("TH7S2N-100", "TH7S2N-100"), ("", None), (None, None), ("no code", None),
])
def test_extract_model(ev, name, want):
    assert ev(text.extract_model(c("x")), "x STRING", name) == want


def test_names(ev):
    assert ev(text.is_collab(c("x")), "x STRING", "Jordan 1 Travis Scott") is True
    assert ev(text.collab_mismatch(c("a"), c("b")), "a STRING, b STRING", "Union LA", "plain") is True
    assert ev(text.collab_mismatch(c("a"), c("b")), "a STRING, b STRING", "plain", "Union LA") is False
    words = text.keywords(c("x"))
    assert ev(words, "x STRING", "A-b /(A) c_d") == ["a", "b", "c", "d"]
    assert ev(text.extra_subtypes(text.keywords(c("m")), text.keywords(c("s"))), "m STRING, s STRING", "x 레트로", "x Retro PRM") == ["premium"]
    assert ev(text.brand_slug(c("x")), "x STRING", "New-Balance 1") == "newbalance1"
    assert ev(text.style_colour(c("a"), c("b")), "a STRING, b STRING", "AB1", "001") == "AB1-001"
    assert ev(text.style_colour(c("a"), c("b")), "a STRING, b STRING", "AB1", "red") == "AB1"
    assert ev(text.underscore_model(c("x")), "x STRING", "409183_01") == "409183-01"
    assert ev(text.underscore_model(c("x")), "x STRING", "nope") == ""
    assert ev(text.style_digits(c("x")), "x STRING", "25528B2") == "25528"
    assert ev(text.bracket_collab(c("x")), "x STRING", "[A x B] shoe") is True
    assert ev(text.thousands(c("x")), "x BIGINT", 1234567) == "1,234,567"
    assert ev(text.unescape_html(c("x")), "x STRING", "a &lt;b&gt; &amp;amp;") == "a <b> &amp;"
    assert ev(text.sku_from_url(c("x")), "x STRING", "https://h/p/3me.100/?a=1") == "3ME-100"
    assert ev(text.search_phrase(c("x"), ("nike",)), "x STRING", "Nike (W) Air Max 90 OG") == "Air Max 90"


@pytest.mark.parametrize("raw, want", [("270", "270"), ("270mm", "270"), ("27", "270"), ("27cm", "270"), ("27.5", "275"), ("m", "M"), ("nan", "NAN"), ("", ""), (None, "")])
def test_normalize_size(ev, raw, want):
    assert ev(sizes.normalize_size(c("x")), "x STRING", raw) == want


def test_sizes(ev):
    match = sizes.sizes_match(c("a"), c("b"))
    assert ev(match, "a STRING, b STRING", "free", "OS") is True
    assert ev(match, "a STRING, b STRING", "270(US9)", "270") is True
    assert ev(match, "a STRING, b STRING", "270", "280") is False
    assert ev(sizes.size_order(c("x")), "x STRING", "27.5") == 0
    assert ev(sizes.label_size(c("x")), "x STRING", "095(M)") == "M"
    assert ev(sizes.to_mm(c("x")), "x STRING", "24.5") == "245"


@pytest.mark.parametrize("v, tier, days", [(None, "unknown", 0), (-1, "unknown", 0), (0, "cold", 90), (4, "warm", 7), (5, "hot", 3)])
def test_tiers(ev, v, tier, days):
    assert ev(tiers.volume_tier(c("v")), "v INT", v) == tier
    assert ev(tiers.check_interval(c("v"), F.lit(False)), "v INT", v) == days * 86400


def test_jitter_is_stable_and_bounded(spark):
    r = spark.range(500).select(tiers.hash_offset(F.col("id").cast("string"), F.lit(1000)).alias("o"), tiers.quarantine_seconds(F.col("id"), F.lit("http_404")).alias("q"))
    a, b = r.collect(), r.collect()
    assert a == b
    assert all(-100 <= x["o"] <= 100 and 81 * 86400 <= x["q"] <= 99 * 86400 for x in a)
    assert len({x["o"] for x in a}) > 490


def test_spikes(ev):
    s = tiers.volume_spike(c("a"), c("b"))
    assert ev(s, "a INT, b INT", 0, 3) == math.inf
    assert ev(s, "a INT, b INT", 0, 2) is None
    assert ev(s, "a INT, b INT", 3, 7) == 2.33
    w = tiers.watcher_spike(c("p"), c("q"), c("a"), c("b"))
    assert ev(w, "p BIGINT, q BIGINT, a INT, b INT", 100, 105, 0, 9) == "price"
    assert ev(w, "p BIGINT, q BIGINT, a INT, b INT", 0, 105, 1, 2) == "volume"
    assert ev(w, "p BIGINT, q BIGINT, a INT, b INT", 0, 105, 0, 2) is None


def test_stock_gate(ev):
    g = tiers.stock_gate(c("s"), c("z"), c("e"), F.lit(100.0))
    schema = "s STRING, z ARRAY<STRING>, e DOUBLE"
    assert ev(g, schema, "IN", ["270"], 0.0) == "pass"
    assert ev(g, schema, "IN", ["270"], 99.0) == "hold"
    assert ev(g, schema, "IN", [], 0.0) == "drop"
    assert ev(g, schema, "OUT", None, 0.0) == "drop"
    assert ev(g, schema, None, None, None) == "hold"


def test_schedules(ev):
    assert [ev(tiers.retry_backoff(c("n")), "n INT", n) for n in (0, 1, 2, 3)] == [21600, 21600, 86400, 604800]
    assert [ev(tiers.research_days(c("n")), "n INT", n) for n in (0, 1, 2)] == [7, 30, None]
    assert ev(tiers.scan_ttl(c("p"), c("b")), "p STRING, b BOOLEAN", "hot", True) == 1
    assert ev(tiers.pull_forward(c("a"), c("b")), "a INT, b INT", None, 5) == 5
    assert ev(tiers.http_state(c("s"), c("b")), "s INT, b BOOLEAN", 404, False) == "gone"


def test_scores(ev):
    l = money.liquidity(c("a"), c("b"))  # noqa: E741
    assert [ev(l, "a INT, b INT", *x) for x in ((0, 5), (10, 0), (20, 5))] == [0.0, 1.0, 0.8]
    assert ev(score.volatility(F.lit(None), c("n"), c("m"), c("s")), "n INT, m DOUBLE, s DOUBLE", 1, 5.0, None) == 0.5
    assert ev(score.velocity(c("g")), "g DOUBLE", None) == 0.0
    assert ev(score.price_position(c("x"), c("n"), c("a"), c("b")), "x BIGINT, n INT, a BIGINT, b BIGINT", 15, 4, 10, 20) == 0.5


def test_gates(ev):
    bad = gates.below_floors(c("p"), c("r"), c("v"))
    g = gates.first_reason(bad)
    schema = "p BIGINT, r DOUBLE, v INT"
    assert [ev(g, schema, *x) for x in ((1, 1.0, 0), (10000, 1.0, 0), (10000, 5.0, None), (10000, 5.0, 1))] == ["profit_floor", "roi_floor", "volume_floor", "pass"]
    assert ev(gates.prefilter_price(c("t"), c("l")), "t BIGINT, l BIGINT", 0, None) is False
    assert ev(gates.prefilter_volume(c("f"), c("v")), "f BOOLEAN, v INT", True, None) is True
    assert ev(gates.sent_status(c("s")), "s INT", None) is True
    assert ev(gates.purpose_in(c("s"), ["bg"]), "s STRING", "bg:x") is True
    assert ev(gates.purpose_in(c("s"), ["bg"]), "s STRING", "bgx") is False


def test_times(ev):
    d = times.parse_date(c("x"))
    assert ev(d, "x STRING", "2024-01-02 03:04:05") == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert ev(d, "x STRING", "2024.01.02") == dt.datetime(2024, 1, 2)
    assert ev(d, "x STRING", "1704164645") == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert ev(d, "x STRING", "1704164645000") == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert ev(d, "x STRING", "soon") is None
    assert ev(times.epoch_iso(c("x")), "x BIGINT", 0) is None
    assert ev(times.epoch_iso(c("x")), "x BIGINT", 1704164645) == "2024-01-02T03:04:05"
    week = times.within_days(c("t"), F.lit(dt.datetime(2024, 1, 10)), 7)
    assert ev(week, "t TIMESTAMP", dt.datetime(2024, 1, 2, 0, 0, 1)) is True
    assert ev(week, "t TIMESTAMP", dt.datetime(2024, 1, 2)) is False
